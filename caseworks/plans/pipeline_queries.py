"""Queries for sources, projections, filters, joins, set operations, scalar functions and the feature pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from caseworks.functions import semantics as S
from caseworks.operators import features as X
from caseworks.plans.registry import each
from caseworks.sources import case_view as V
from caseworks.sources.text_tables import read_csv, write_csv
from caseworks.sources.working import shared_dir

c = F.col
cases, policies = V.cases, V.policies


def recovered(spark, d):
    return X.error_strata(X.recover_income(cases(spark, d)))


def on_cases(name, sql, function):
    each(name, sql, lambda spark, d: function(cases(spark, d)))


def on_recovered(name, columns, sql_columns, function=lambda df: df):
    each(name, f"SELECT case_id, {sql_columns} FROM strata", lambda spark, d: function(recovered(spark, d)).select("case_id", *columns))


RENAMES = {
    "fsusize": "cert_hh_size", "ctprhh": "people_in_hh", "fsnetinc": "net_income", "fsben": "benefit_amount", "rawben": "raw_benefit_amount", "benmax": "maximum_benefit",
    "amterr": "total_error_amount", "fstotded": "total_deductions", "status": "status_c", "actntype": "action_type_c",
}

# Sources, projections and schema
each("a02_parquet_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity"))
each("b01_column_subset", 'SELECT "State", ' + ", ".join(f'"{p}"' for p in V.POLICY) + " FROM policy", lambda s, d: policies(s, d).select("State", *V.POLICY))
on_cases("b02_rename_map", "SELECT case_id, " + ", ".join(f"{a} AS {b}" for a, b in RENAMES.items()) + " FROM cases", lambda df: df.select("case_id", *RENAMES).withColumnsRenamed(RENAMES))
on_cases("b03_derived_chain", "SELECT case_id, fsearn + fsunearn AS gross, (fsearn + fsunearn) - fstotded AS net, (fsearn + fsunearn) - fstotded > 0e0 AS positive FROM cases", lambda df: df.withColumn("gross", c("fsearn") + c("fsunearn")).withColumn("net", c("gross") - c("fstotded")).withColumn("positive", c("net") > 0).select("case_id", "gross", "net", "positive"))
on_cases("b04_select_range", "SELECT case_id, rel1, rel2, rel3 FROM cases", lambda df: df.select("case_id", *df.columns[df.columns.index("rel1") : df.columns.index("rel3") + 1]))
on_cases("b05_drop_columns", "SELECT * EXCLUDE (age1, age2, age3, rel1, rel2, rel3, empsta1, empsta2, empsta3, expedser, fsndis) FROM cases", lambda df: df.drop(*V.AGES, *V.RELATIONS, *V.EMPLOYMENT, "expedser", "fsndis"))
on_cases("b06_casts", "SELECT case_id, TRY_CAST(trunc(fstotded / 7e0) AS INTEGER) AS whole, CAST(year AS VARCHAR) AS year_level, CAST(fsusize AS DOUBLE) AS size_number FROM cases", lambda df: df.select("case_id", S.truncated(c("fstotded") / 7).alias("whole"), c("year").cast("string").alias("year_level"), c("fsusize").cast("double").alias("size_number")))
on_cases("b07_reorder", "SELECT year, state, case_id FROM cases", lambda df: df.select("year", "state", "case_id"))
on_cases("b08_constant_column", "SELECT case_id, 'state' AS geography_type, 52e0 AS error_threshold FROM cases", lambda df: df.select("case_id", F.lit("state").alias("geography_type"), F.lit(52.0).alias("error_threshold")))
each("b09_feature_presence", "SELECT * FROM (VALUES ('absent_feature')) t(missing)", lambda s, d: s.createDataFrame([(m,) for m in ["fsearn", "absent_feature", "state"] if m not in cases(s, d).columns], "missing string"))


def useful_predictors(df, group, predictors):
    """Predictors with more than one value in each group: one aggregation for all."""
    counted = df.groupBy(group).agg(*(F.count_distinct(p).alias(p) for p in predictors))
    return counted.unpivot(group, predictors, "predictor", "n_values").filter("n_values > 1")


PREDICTORS = ["fsusize", "cat_elig", "fsndis", "minimum_ben", "expedser"]
each("b10_useful_predictors", "WITH n AS (SELECT state, " + ", ".join(f"count(DISTINCT {p}) AS {p}" for p in PREDICTORS) + " FROM cases GROUP BY state) " + " UNION ALL ".join(f"SELECT state, '{p}' AS predictor, {p} AS n_values FROM n WHERE {p} > 1" for p in PREDICTORS), lambda s, d: useful_predictors(cases(s, d), "state", PREDICTORS))
on_cases("b11_relevel", "SELECT status, CASE status WHEN 'underissuance' THEN 0 WHEN 'amount correct' THEN 1 WHEN 'overissuance' THEN 2 ELSE 3 END AS level, count(*) AS n FROM cases GROUP BY ALL", lambda df: df.withColumn("level", F.when(c("status") == X.UNDER, 0).when(c("status") == X.CORRECT, 1).when(c("status") == X.OVER, 2).otherwise(3)).groupBy("status", "level").agg(F.count(F.lit(1)).alias("n")))
on_cases("b12_conditional_overwrite", "SELECT case_id, CASE WHEN fsndis > 0 THEN 99 ELSE fsusize END AS size FROM cases", lambda df: df.select("case_id", S.overwrite(c("fsusize"), c("fsndis") > 0, F.lit(99)).alias("size")))

# Filters
on_cases("c01_comparison", "SELECT case_id FROM cases WHERE year >= 2017 AND rawben <= benmax", lambda df: df.filter("year >= 2017 AND rawben <= benmax").select("case_id"))
on_cases("c02_null_tests", "SELECT case_id, fsothun IS NULL AS unknown FROM cases WHERE status IS NOT NULL", lambda df: df.filter(c("status").isNotNull()).select("case_id", c("fsothun").isNull().alias("unknown")))
on_cases("c03_membership", "SELECT case_id FROM cases WHERE coalesce(year IN (2022, 2023), false) AND coalesce(element1 IN ('contributions', 'rsdi benefits'), false)", lambda df: df.filter(c("year").isin(2022, 2023) & S.in_set(c("element1"), ["contributions", "rsdi benefits"])).select("case_id"))
on_cases("c04_and_or", "SELECT case_id FROM cases WHERE (timeper1 = 'at time of most recent action by agency' AND actntype = 'certification') OR (status = 'amount correct' AND actntype = 'certification')", lambda df: X.at_certification(df).select("case_id"))
on_cases("c05_not_both", "SELECT case_id FROM cases WHERE NOT (status = 'amount correct' AND amterr > 0e0)", lambda df: df.filter(~((c("status") == X.CORRECT) & (c("amterr") > 0))).select("case_id"))
on_cases("c06_partition_recombine", "SELECT case_id, status FROM cases WHERE status = 'amount correct' UNION ALL SELECT case_id, status FROM cases WHERE status <> 'amount correct' AND abs(abs(fsben - rawben) - amterr) <= 5e0", lambda df: X.reconcilable(df).filter("status IS NOT NULL").select("case_id", "status"))
on_cases("c07_not_in_keeps_null", "SELECT case_id, element1 FROM cases WHERE NOT coalesce(element1 IN ('contributions', 'wages and salaries'), false)", lambda df: df.filter(~S.in_set(c("element1"), ["contributions", "wages and salaries"])).select("case_id", "element1"))
on_cases("c08_complete_rows", "SELECT case_id FROM cases WHERE fsothun IS NOT NULL AND age1 IS NOT NULL AND fsndis IS NOT NULL", lambda df: df.dropna(subset=["fsothun", "age1", "fsndis"]).select("case_id"))
on_cases("c09_bracket_filter", "SELECT case_id FROM cases WHERE fsndis > 0", lambda df: df.filter(c("fsndis") > 0).select("case_id"))
each("c10_stratum", "SELECT case_id, error_status FROM strata WHERE error_status = 'earned_overissuance' OR status_clean = 'amount correct'", lambda s, d: recovered(s, d).filter((c("error_status") == "earned_overissuance") | (c("status_clean") == X.CORRECT)).select("case_id", "error_status"))
each("c11_clean_or_income_error", "SELECT case_id, CASE WHEN status = 'amount correct' THEN 0e0 ELSE amterr END AS error_amount FROM strata WHERE status = 'amount correct' OR error_category <> 'other'", lambda s, d: recovered(s, d).filter((c("status") == X.CORRECT) | (c("error_category") != "other")).select("case_id", F.when(c("status") == X.CORRECT, 0.0).otherwise(c("amterr")).alias("error_amount")))
on_cases("c12_case_insensitive", "SELECT case_id FROM cases WHERE lower(upper(status)) = 'overissuance'", lambda df: df.filter(F.lower(F.upper("status")) == X.OVER).select("case_id"))

# Joins
each("d01_inner_join", "SELECT cases.case_id, 52e0 AS error_threshold, amterr FROM cases", lambda s, d: cases(s, d).join(V.details(s, d).hint("merge"), "case_id").select("case_id", "error_threshold", "amterr"))
each("d02_join_other_name", 'SELECT case_id, cases.state, "BBCE" AS bbce, "CAP" AS cap FROM cases JOIN policy ON cases.state = policy."State"', lambda s, d: (lambda a, p: a.join(p, a["state"] == p["State"]).select("case_id", a["state"], c("BBCE").alias("bbce"), c("CAP").alias("cap")))(cases(s, d), policies(s, d)))


def expand_grid(spark, **ranges):
    """Cartesian product of ranges with grid_id; the first range varies fastest."""
    out, size = None, 1
    grid_id = F.lit(0)
    for name, (start, stop, by) in ranges.items():
        one = S.steps_table(spark, start, stop, by, name).withColumn(f"_{name}", F.row_number().over(W.orderBy(name)) - 1)
        grid_id = grid_id + c(f"_{name}") * size
        size *= len(S.steps(start, stop, by))
        out = one if out is None else out.crossJoin(one)
    return out.withColumn("grid_id", grid_id.cast("long")).select("grid_id", *ranges)


GRID = {"t1": (0, 600, 50), "t2": (0, 1, 0.1), "t3": (0, 1, 0.1)}
GRID_SQL = "SELECT CAST(i + 13 * (j + 11 * k) AS BIGINT) AS grid_id, least(6e2, 0e0 + i * 5e1) AS t1, least(1e0, 0e0 + j * 1e-1) AS t2, least(1e0, 0e0 + k * 1e-1) AS t3 FROM range(13) a(i), range(11) b(j), range(11) c(k)"
each("d03_expand_grid", GRID_SQL, lambda s, d: expand_grid(s, **GRID))
each("d04_grid_bounds", f"SELECT * FROM ({GRID_SQL}) WHERE t2 <= t3", lambda s, d: expand_grid(s, **GRID).filter("t2 <= t3"))
each("d07_semi_join", "SELECT case_id, state FROM cases WHERE state IN (SELECT state FROM cases GROUP BY state ORDER BY sum(over_threshold) DESC, state LIMIT 9)", lambda s, d: (lambda a: a.join(a.groupBy("state").agg(F.sum("over_threshold").alias("n")).orderBy(c("n").desc(), "state").limit(9), "state", "left_semi").select("case_id", "state"))(cases(s, d)))

# Set operations
on_cases("h01_union_by_name", "SELECT case_id, amterr, NULL AS fsben FROM cases WHERE status = 'overissuance' UNION ALL SELECT case_id, NULL, fsben FROM cases WHERE status = 'underissuance'", lambda df: df.filter(c("status") == X.OVER).select("case_id", "amterr").unionByName(df.filter(c("status") == X.UNDER).select("case_id", "fsben"), allowMissingColumns=True))
on_cases("h02_union_same_schema", "SELECT case_id, year FROM cases WHERE year = 2022 UNION ALL SELECT case_id, year FROM cases WHERE year = 2023", lambda df: df.filter("year = 2022").select("case_id", "year").union(df.filter("year = 2023").select("case_id", "year")))
on_cases("h03_unique", "SELECT DISTINCT state FROM cases", lambda df: df.select("state").distinct())

# Scalar functions
on_cases("i01_math", "SELECT case_id, abs(fsben - rawben) AS a, sqrt(fstotded) AS b, floor(fsearn / 7e0) AS c, floor(log2(fsusize)) AS d FROM cases", lambda df: df.select("case_id", F.abs(c("fsben") - c("rawben")).alias("a"), F.sqrt("fstotded").alias("b"), F.floor(c("fsearn") / 7).cast("double").alias("c"), F.floor(F.log2("fsusize")).cast("double").alias("d")))
on_cases("i02_null_keeping_bounds", "SELECT case_id, CASE WHEN fsothun IS NULL THEN NULL ELSE greatest(0e0, fsothun - 2e2) END AS low, CASE WHEN fsothun IS NULL THEN NULL ELSE least(5e2, fsothun) END AS high FROM cases", lambda df: df.select("case_id", S.at_least(c("fsothun") - 200, 0).alias("low"), S.at_most(c("fsothun"), 500).alias("high")))
on_cases("i03_modulo", "SELECT case_id, fsearn > 0e0 AND fsearn % 1e1 = 0e0 AS round_earn FROM cases", lambda df: df.select("case_id", ((c("fsearn") > 0) & (c("fsearn") % 10 == 0)).alias("round_earn")))
on_cases("i04_division", "SELECT case_id, fsunearn / nullif(fsearn, 0e0) AS share FROM cases", lambda df: df.select("case_id", S.ratio(c("fsunearn"), c("fsearn")).alias("share")))
on_cases("i05_conditionals", "SELECT case_id, CASE WHEN fsndis > 0 THEN 'yes' WHEN fsndis = 0 THEN 'no' ELSE 'other' END AS fall_through, CASE WHEN fsndis IS NULL THEN NULL WHEN fsndis > 0 THEN 1e0 ELSE 0e0 END AS strict FROM cases", lambda df: df.select("case_id", F.when(c("fsndis") > 0, "yes").when(c("fsndis") == 0, "no").otherwise("other").alias("fall_through"), F.when(c("fsndis").isNull(), None).when(c("fsndis") > 0, 1.0).otherwise(0.0).alias("strict")))
on_cases("i06_typed_null", "SELECT case_id, CAST(NULL AS VARCHAR) AS nothing, age1 IS NULL AS no_age FROM cases", lambda df: df.select("case_id", F.lit(None).cast("string").alias("nothing"), c("age1").isNull().alias("no_age")))
on_cases("i07_case_and_trim", "SELECT case_id, upper(status) AS up, trim(chr(9) || ' ' || lower(element1) || chr(10), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM cases", lambda df: df.select("case_id", F.upper("status").alias("up"), S.trimmed(F.concat(F.lit("\t "), F.lower("element1"), F.lit("\n"))).alias("clean")))
on_cases("i08_regex", "SELECT DISTINCT state, regexp_replace(state, '[AEIOU]', '_') AS once, regexp_replace(state, '[ _]+', '-', 'g') AS every, upper(substr(lower(state), 1, 1)) || substr(lower(state), 2) AS title FROM cases WHERE state NOT LIKE '% %'", lambda df: df.filter(~c("state").contains(" ")).select("state", F.regexp_replace("state", "^(.*?)[AEIOU]", "$1_").alias("once"), F.regexp_replace("state", "[ _]+", "-").alias("every"), F.initcap("state").alias("title")).distinct())
on_cases("i09_string_building", "SELECT case_id, concat_ws('/', state, CAST(year AS VARCHAR)) AS label, state || '_' || CAST(year AS VARCHAR) AS joined, printf('%05d', fsusize) AS padded FROM cases", lambda df: df.select("case_id", F.concat_ws("/", "state", c("year").cast("string")).alias("label"), F.concat("state", F.lit("_"), c("year").cast("string")).alias("joined"), F.format_string("%05d", "fsusize").alias("padded")))
each("i10_sequence", "SELECT least(1e0, 0e0 + i * 1e-1) AS t FROM range(11) r(i)", lambda s, d: S.steps_table(s, 0, 1, 0.1, "t"))
on_cases("i11_colour_ramp", "SELECT case_id, CAST(round_even(sqrt(least(1e0, fsben / benmax)) * 1e2, 0) + 1 AS INTEGER) AS colour FROM cases", lambda df: df.select("case_id", (F.bround(F.sqrt(S.at_most(S.ratio(c("fsben"), c("benmax")), 1)) * 100, 0) + 1).cast("int").alias("colour")))
on_cases("i12_basis_powers", "SELECT case_id, fsearn / 1e3 AS x1, (fsearn / 1e3) * (fsearn / 1e3) AS x2, (fsearn / 1e3) * (fsearn / 1e3) * (fsearn / 1e3) AS x3, (fsearn / 1e3) * fsusize AS x_by_size FROM cases", lambda df: df.withColumn("x1", c("fsearn") / 1000).select("case_id", "x1", (c("x1") * c("x1")).alias("x2"), (c("x1") * c("x1") * c("x1")).alias("x3"), (c("x1") * c("fsusize")).alias("x_by_size")))

# Feature pipeline
J = "SELECT case_id, "
on_cases("j01_overpayment", J + "CASE WHEN status = 'overissuance' AND over_threshold = 1 THEN 1 WHEN (status = 'overissuance' AND over_threshold = 1) IS NULL THEN NULL ELSE 0 END AS payment_error FROM cases", lambda df: df.select("case_id", X.overpayment(c("status"), c("over_threshold")).alias("payment_error")))
on_cases("j02_reconcilable", "SELECT case_id FROM cases WHERE status = 'amount correct' OR abs(abs(fsben - rawben) - amterr) <= 5e0", lambda df: X.reconcilable(df).select("case_id"))
on_cases("j03_income_errors", "SELECT case_id, element1 FROM cases WHERE (coalesce(element1 IN (" + ", ".join("'" + e.replace("'", "''") + "'" for e in X.EARNED_ELEMENTS + X.UNEARNED_ELEMENTS) + "), false) OR coalesce(status = 'amount correct', false)) AND NOT (status = 'amount correct' AND amterr > 0e0)", lambda df: X.income_errors(df).select("case_id", "element1"))
on_cases("j04_feasible", "SELECT case_id FROM cases WHERE rawben <= benmax", lambda df: X.feasible(df).select("case_id"))
on_recovered("j05_error_class", ["has_earned_inc_error", "has_unearned_inc_error"], "has_earned_inc_error, has_unearned_inc_error")
on_recovered("j06_original_net", ["original_net_income"], "original_net_income")
on_recovered("j07_recovered_earned", ["recovered_earned"], "recovered_earned")
on_recovered("j08_recovered_unearned", ["recovered_unearned"], "recovered_unearned")
on_recovered("j09_original_deductions", ["original_deductions"], "original_deductions")
on_recovered("j10_verification", ["verified_gross", "verified_net", "verified_benefit"], "verified_gross, verified_net, verified_benefit")
on_recovered("j11_match_quality", ["benefit_gap", "good_match"], "benefit_gap, good_match")
REPORT = "count(*) AS n, CAST(sum(CAST(good_match AS INTEGER)) AS DOUBLE) * 1e2 / count(good_match) AS pct_good, CAST(sum(CAST(benefit_gap AS DECIMAL(28, 6))) AS DOUBLE) / count(benefit_gap) AS mean_gap, median(benefit_gap) AS median_gap, max(benefit_gap) AS max_gap FROM strata"
each("j12_match_report", "SELECT " + REPORT, lambda s, d: X.match_report(recovered(s, d)))
each("j12_match_report_by_error", "SELECT error_category, " + REPORT + " GROUP BY error_category", lambda s, d: X.match_report(recovered(s, d), ["error_category"]))
on_recovered("j13_error_strata", ["error_category", "status_clean", "error_status"], "error_category, status_clean, error_status")
on_recovered("j14_uncapped_ratio", ["ratio_uncapped"], "(benmax - 3e-1 * (recovered_earned + recovered_unearned - original_deductions)) / nullif(benmax, 0e0) AS ratio_uncapped", lambda df: df.withColumn("ratio_uncapped", X.uncapped_ratio()))
on_recovered("j15_per_person", ["earned", "unearned", "deductions", "gross"], "recovered_earned / nullif(fsusize, 0) AS earned, recovered_unearned / nullif(fsusize, 0) AS unearned, original_deductions / nullif(fsusize, 0) AS deductions, TRY_CAST(trunc(verified_gross / nullif(fsusize, 0)) AS INTEGER) AS gross", lambda df: df.select("case_id", X.per_person(c("recovered_earned")).alias("earned"), X.per_person(c("recovered_unearned")).alias("unearned"), X.per_person(c("original_deductions")).alias("deductions"), S.truncated(X.per_person(c("verified_gross"))).alias("gross")))
on_recovered("j16_shelter_ratio", ["shelter"], "TRY_CAST(trunc(fssltexp / nullif(verified_gross + 1e0, 0e0)) AS INTEGER) AS shelter", lambda df: df.withColumn("shelter", X.shelter_ratio()))
_count = lambda cols, test: " + ".join(f"CASE WHEN {test.replace('x', k)} THEN 1 ELSE 0 END" for k in cols)
on_cases("j17_type_counts", J + _count(V.INCOMES, "x > 0e0") + " AS n_incomes, " + _count(V.DEDUCTIONS, "x > 0e0") + " AS n_deductions FROM cases", lambda df: df.select("case_id", X.type_count(V.INCOMES).alias("n_incomes"), X.type_count(V.DEDUCTIONS).alias("n_deductions")))
on_cases("j18_round_numbers", J + _count(V.INCOMES + V.DEDUCTIONS, "x > 0e0 AND x % 1e1 = 0e0") + " AS by_10, " + _count(V.INCOMES + V.DEDUCTIONS, "x > 0e0 AND x % 1e2 = 0e0") + " AS by_100 FROM cases", lambda df: df.select("case_id", X.round_numbers(V.INCOMES + V.DEDUCTIONS).alias("by_10"), X.round_numbers(V.INCOMES + V.DEDUCTIONS, 100).alias("by_100")))
AGE_SQL = "coalesce(CAST(least(age1, age2, age3) AS DOUBLE), 'Infinity'::DOUBLE) AS lo, coalesce(CAST(greatest(age1, age2, age3) AS DOUBLE), '-Infinity'::DOUBLE) AS hi"
on_cases("j19_labour_force", f"SELECT case_id, CASE WHEN lo > 17 AND hi < 60 THEN 'all working age' WHEN hi < 18 OR lo > 59 THEN 'no working age' ELSE 'mixed age' END AS labour FROM (SELECT case_id, {AGE_SQL} FROM cases)", lambda df: df.select("case_id", X.labour_force(V.AGES).alias("labour")))
on_cases("j20_household_flags", J + "expedser < 3 AS expedited, fsndis > 0 AS disabled, CAST(coalesce(rel1 = 'Spouse', false) OR coalesce(rel2 = 'Spouse', false) OR coalesce(rel3 = 'Spouse', false) AS INTEGER) AS married, homeded <> 'Not homeless' AS homeless, elderly_present = 1 OR fsndis > 0 AS elderly_or_disabled FROM cases", lambda df: X.household_flags(df, V.RELATIONS).select("case_id", "expedited", "disabled", "married", "homeless", "elderly_or_disabled"))
on_cases("j21_capped_ratio", J + "CASE WHEN rawben / benmax > 1e0 THEN 1e0 ELSE rawben / benmax END AS share FROM cases", lambda df: df.select("case_id", X.capped_ratio().alias("share")))
on_cases("j22_hh_size_ratio", J + "ctprhh / nullif(fsusize, 0) AS share FROM cases", lambda df: df.select("case_id", S.ratio(c("ctprhh"), c("fsusize")).alias("share")))
on_cases("j23_outcome_class", J + "CASE WHEN status <> 'amount correct' AND over_threshold = 1 THEN 'above_threshold_error' WHEN status <> 'amount correct' AND error_flag = 1 THEN 'uncounted_error' WHEN status = 'amount correct' THEN 'amount correct' END AS outcome FROM cases", lambda df: df.select("case_id", X.outcome_class().alias("outcome")))


def recode_sql(column: str, groups: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN ({', '.join(repr(v) for v in values)}) THEN '{name}'" for name, values in groups.items()) + " END"


on_cases("j24_labour_status", J + recode_sql("empsta1", X.LABOUR_GROUPS) + " AS head_status FROM cases", lambda df: df.select("case_id", X.recode(c("empsta1"), X.LABOUR_GROUPS).alias("head_status")))
_any = lambda values: " OR ".join(f"coalesce({e} IN ({values}), false)" for e in V.EMPLOYMENT)
on_cases("j25_anyone_working", J + f"CAST({_any(chr(39) + 'Self-employed, nonfarming' + chr(39) + ', ' + chr(39) + 'Employed by other' + chr(39))} AS INTEGER) AS working, CAST({_any(repr('Self-employed, nonfarming'))} AS INTEGER) AS self_employed, CAST({_any(repr('Employed by other'))} AS INTEGER) AS by_other FROM cases", lambda df: df.select("case_id", *(S.any_of([c(e) for e in V.EMPLOYMENT], v).cast("int").alias(n) for n, v in (("working", ["Self-employed, nonfarming", "Employed by other"]), ("self_employed", ["Self-employed, nonfarming"]), ("by_other", ["Employed by other"])))))
on_cases("j26_origin_recode", J + recode_sql("raceth1", X.ORIGIN_GROUPS) + " AS origin FROM cases", lambda df: df.select("case_id", X.recode(c("raceth1"), X.ORIGIN_GROUPS).alias("origin")))
on_cases("j27_unit_composition", J + "CAST(" + " OR ".join(f"coalesce({e} = 'unit composition', false)" for e in V.ELEMENTS) + " AS INTEGER) AS unit_error FROM cases", lambda df: df.select("case_id", S.any_of([c(e) for e in V.ELEMENTS], ["unit composition"]).cast("int").alias("unit_error")))
on_cases("j28_at_certification", "SELECT case_id FROM cases WHERE (timeper1 = 'at time of most recent action by agency' AND actntype IN ('certification', 'recertification')) OR (status = 'amount correct' AND actntype IN ('certification', 'recertification'))", lambda df: X.at_certification(df, ["certification", "recertification"]).select("case_id"))
WEIGHT_SQL = "fywgt / (CAST(sum(CAST(fywgt AS DECIMAL(28, 6))) OVER (PARTITION BY state, year) AS DOUBLE) / count(fywgt) OVER (PARTITION BY state, year)) AS weight FROM cases"
on_cases("j29_rescaled_weight", J + WEIGHT_SQL, lambda df: df.select("case_id", X.rescaled_weight().alias("weight")))
each("j30_prepared_cases", "SELECT case_id, error_status, ratio_c, payment_error FROM (SELECT * EXCLUDE (state), state AS st, CASE WHEN rawben / benmax > 1e0 THEN 1e0 ELSE rawben / benmax END AS ratio_c, CASE WHEN status = 'overissuance' AND over_threshold = 1 THEN 1 ELSE 0 END AS payment_error FROM strata) JOIN policy ON st = policy.\"State\" WHERE year BETWEEN 2017 AND 2023 AND status IS NOT NULL AND (status = 'amount correct' OR abs(abs(fsben - rawben) - amterr) <= 5e0) AND (status = 'amount correct' OR coalesce(element1 IN (" + ", ".join("'" + e.replace("'", "''") + "'" for e in X.EARNED_ELEMENTS + X.UNEARNED_ELEMENTS) + "), false)) AND NOT (status = 'amount correct' AND amterr > 0e0) AND rawben <= benmax", lambda s, d: X.prepare_cases(cases(s, d), V.details(s, d), policies(s, d)).select("case_id", "error_status", c("ratio_capped").alias("ratio_c"), "payment_error"))


def csv_round_trip(spark, d):
    """The policy table through a CSV file and back under its declared schema."""
    path = f"{shared_dir(spark)}/policy-{uuid.uuid4().hex}.csv"
    table = policies(spark, d)
    write_csv(table, path, one_file=True)
    return read_csv(spark, path, table.schema)


each("a01_csv_scan", "SELECT * FROM policy", csv_round_trip)
