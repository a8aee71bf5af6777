"""A deterministic case file on the driver's star schema: one row for each order with line items.

The mapping is one SQL text that Spark and the oracle both run, so that operators start from the same rows. It is only shaped like a
case file. Every literal that takes part in arithmetic is a DOUBLE; sums are exact decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseworks.sources.working import kept

#: Columns of persons: ages, relations to the head, employment status.
AGES, RELATIONS, EMPLOYMENT = ["age1", "age2", "age3"], ["rel1", "rel2", "rel3"], ["empsta1", "empsta2", "empsta3"]
ELEMENTS = ["element1", "element2", "element3"]
INCOMES = ["fswages", "fsslfemp", "fssocsec", "fsothun"]
DEDUCTIONS = ["fsstdded", "fsernded", "fssltded"]
POLICY = ["ReportingRequirements", "CertificationPeriods", "BBCE", "DemonstrationsElderlyDisability", "SUAs", "CAP"]

CASES = """
SELECT case_id, state, regioncd, year, fsusize, ctprhh, status, fswages, fsslfemp, fssocsec, fsothun, fsearn, fsunearn, fsgrinc, fsernded, fsstdded,
  fssltded, fstotded, fssltexp, fsnetinc, benmax, minimum_ben, fsben, rawben, amterr, CAST(CASE WHEN amterr > 52e0 THEN 1 ELSE 0 END AS INT) AS over_threshold,
  CAST(CASE WHEN amterr > 0e0 THEN 1 ELSE 0 END AS INT) AS error_flag, fywgt, age1, age2, age3, rel1, rel2, rel3, empsta1, empsta2, empsta3,
  raceth1, expedser, element1, element2, element3, lastcert, certmth, children_present, elderly_present, fsndis, cat_elig, homeded, actntype, timeper1
FROM (
SELECT *, CASE WHEN err > 0 AND k % 14 = 0 THEN abs(fsben - rawben) + 20e0 ELSE abs(fsben - rawben) END AS amterr
FROM (
SELECT *, CASE WHEN status = 'overissuance' THEN least(benmax, fsben + err) WHEN status = 'underissuance' THEN greatest(0e0, fsben - err) ELSE fsben END AS rawben
FROM (
SELECT *, CASE WHEN status IN ('overissuance', 'underissuance') THEN 1e1 + k % 240 ELSE 0e0 END AS err,
  greatest(23e0, least(benmax, round(benmax - 3e-1 * fsnetinc))) AS fsben
FROM (
SELECT *, greatest(0e0, fsearn + fsunearn - fstotded) AS fsnetinc, fsearn + fsunearn AS fsgrinc
FROM (
SELECT *, fsstdded + fssltded + fsernded AS fstotded, 291e0 + 24e1 * (fsusize - 1) AS benmax, 23e0 AS minimum_ben
FROM (
SELECT *, round(2e-1 * fsearn) AS fsernded, 193e0 + 1e1 * (k % 3) AS fsstdded, round(r / 5e2) AS fssltded, round((r + q) / 2e2) AS fssltexp
FROM (
SELECT *, fswages + fsslfemp AS fsearn, fssocsec + coalesce(fsothun, 0e0) AS fsunearn
FROM (
SELECT k, k AS case_id, n_name AS state, CAST(n_regionkey AS INT) AS regioncd, CAST(extract(YEAR FROM o_orderdate) + 22 AS INT) AS year, r, q,
  CAST(1 + k % 6 AS INT) AS fsusize, CAST(1 + k % 6 + CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END AS INT) AS ctprhh,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' THEN 'overissuance'
       WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'P' THEN 'underissuance'
       WHEN k % 211 = 0 THEN NULL ELSE 'amount correct' END AS status,
  CASE WHEN c % 3 = 0 THEN 0e0 ELSE round(a / 6e1) END AS fswages,
  CASE WHEN c % 7 = 0 THEN round(a / 15e1) ELSE 0e0 END AS fsslfemp,
  CASE WHEN c % 5 = 0 THEN round(n / 1e2) ELSE 0e0 END AS fssocsec,
  CASE WHEN c % 11 = 0 THEN NULL WHEN c % 2 = 0 THEN round(n / 15e1) ELSE 0e0 END AS fsothun,
  1e0 + q / 1e2 AS fywgt,
  CAST(CASE WHEN k % 37 = 0 THEN NULL ELSE c % 90 END AS INT) AS age1,
  CAST(CASE WHEN k % 6 >= 1 THEN c * 7 % 85 END AS INT) AS age2, CAST(CASE WHEN k % 6 >= 2 THEN c * 13 % 18 END AS INT) AS age3,
  'Head' AS rel1, CASE WHEN k % 6 >= 1 THEN CASE WHEN c % 3 = 0 THEN 'Spouse' ELSE 'Child' END END AS rel2, CASE WHEN k % 6 >= 2 THEN 'Child' END AS rel3,
  CASE c % 9 WHEN 0 THEN 'Not in labor force and not looking for work' WHEN 1 THEN 'Unemployed and looking for work' WHEN 2 THEN 'Active-duty military'
    WHEN 3 THEN 'Self-employed, farming' WHEN 4 THEN 'Self-employed, nonfarming' WHEN 5 THEN 'Employed by other' WHEN 6 THEN 'Migrant farm laborer' WHEN 7 THEN 'Unknown' END AS empsta1,
  CASE WHEN k % 6 >= 1 THEN CASE c % 4 WHEN 0 THEN 'Employed by other' WHEN 1 THEN 'Self-employed, nonfarming' ELSE 'Unknown' END END AS empsta2,
  CAST(NULL AS VARCHAR(20)) AS empsta3,
  CASE c % 6 WHEN 0 THEN 'hispanic_white' WHEN 1 THEN 'not_hispanic_white' WHEN 2 THEN 'not_hispanic_asian' WHEN 3 THEN 'not_hispanic_multiple_races_other'
    WHEN 4 THEN 'race_ethnicity_not_recorded' ELSE 'not_hispanic_black_or_african_american' END AS raceth1,
  CAST(CASE WHEN k % 19 = 0 THEN NULL ELSE 1 + k % 3 END AS INT) AS expedser,
  CASE WHEN NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('O', 'P')) AND k % 211 <> 0 THEN NULL
    ELSE CASE c % 7 WHEN 0 THEN 'wages and salaries' WHEN 1 THEN 'Self-Employment' WHEN 2 THEN 'rsdi benefits' WHEN 3 THEN 'other unearned income'
      WHEN 4 THEN 'wages and salaries' WHEN 5 THEN 'unit composition' ELSE 'contributions' END END AS element1,
  CASE WHEN k % 29 = 0 THEN 'unit composition' END AS element2, CAST(NULL AS VARCHAR(20)) AS element3,
  CAST(k % 13 AS INT) AS lastcert, CAST(6 + c % 7 AS INT) AS certmth,
  CAST(CASE WHEN k % 6 >= 2 THEN 1 ELSE 0 END AS INT) AS children_present, CAST(CASE WHEN c % 90 >= 60 THEN 1 ELSE 0 END AS INT) AS elderly_present,
  CAST(CASE WHEN c % 8 = 0 THEN 1 WHEN c % 17 = 0 THEN NULL ELSE 0 END AS INT) AS fsndis, CAST(k % 3 AS INT) AS cat_elig,
  CASE WHEN c % 23 = 0 THEN 'Homeless deduction' WHEN c % 31 = 0 THEN NULL ELSE 'Not homeless' END AS homeded,
  CASE k % 5 WHEN 0 THEN 'recertification' WHEN 4 THEN 'other' ELSE 'certification' END AS actntype,
  CASE WHEN c % 3 = 0 THEN 'before most recent action by agency' WHEN c % 10 = 0 THEN NULL ELSE 'at time of most recent action by agency' END AS timeper1
FROM (
SELECT o_orderkey AS k, o_custkey AS c, o_orderdate, o_orderpriority, o_orderstatus, n_name, n_regionkey, s.a, s.n, s.r, s.q
FROM (
SELECT l_orderkey,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE CAST(0 AS DECIMAL(18, 2)) END) AS DOUBLE) AS a,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE CAST(0 AS DECIMAL(18, 2)) END) AS DOUBLE) AS n,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE CAST(0 AS DECIMAL(18, 2)) END) AS DOUBLE) AS r,
  CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS q
FROM {lineitem} GROUP BY l_orderkey) s
JOIN {orders} ON o_orderkey = s.l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
) t1) t2) t3) t4) t5) t6) t7) t8) t9
"""

POLICIES = """
SELECT n_name AS "State", CASE n_nationkey % 3 WHEN 0 THEN 'Simplified reporting only' WHEN 1 THEN 'Simplified and change reporting' ELSE 'Under review' END AS "ReportingRequirements",
  CASE n_nationkey % 4 WHEN 0 THEN '12 months only' WHEN 1 THEN '4 to 24 months' ELSE '6 to 12 months' END AS "CertificationPeriods",
  CASE n_nationkey % 2 WHEN 0 THEN 'BBCE' ELSE 'No BBCE' END AS "BBCE", CASE n_nationkey % 5 WHEN 0 THEN 'SMD and ESAP' WHEN 1 THEN 'ESAP' ELSE 'No SMD or ESAP' END AS "DemonstrationsElderlyDisability",
  CASE n_nationkey % 2 WHEN 0 THEN 'Mandatory SUAs' ELSE 'Optional SUAs' END AS "SUAs", CASE n_nationkey % 3 WHEN 0 THEN 'CAP' WHEN 1 THEN 'No CAP' ELSE 'N/A' END AS "CAP",
  'unused' AS "TBA"
FROM {nation}
"""
TABLES = ("lineitem", "orders", "customer", "nation")


def oracle_cases() -> str:
    return CASES.format(**{t: t for t in TABLES})


def oracle_policies() -> str:
    return POLICIES.format(nation="nation")


def _run(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(text.replace('"', "`"), **frames)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case file, ingested once for each application and source folder, and stored by column."""
    return kept(spark, "cases", sf_dir, lambda: _run(spark, sf_dir, CASES, TABLES))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each state: a dimension of fixed, small size."""
    return _run(spark, sf_dir, POLICIES, ("nation",))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, error_threshold and over_threshold, as a table of its own."""
    return cases(spark, sf_dir).selectExpr("case_id", "52e0 AS error_threshold", "over_threshold")
