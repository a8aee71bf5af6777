"""Queries for aggregations, window operators, sorting and sampling on the case view."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseworks.functions import semantics as S
from caseworks.operators import features as X, report as R
from caseworks.plans.pipeline_queries import on_cases, recovered
from caseworks.plans.registry import each

c = F.col
def rows():
    return F.count(F.lit(1)).alias("n")



def dsum(x: str) -> str:
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(28, 6))) AS DOUBLE), 0e0)"


def mean(x: str):
    return S.exact_sum(c(x)) / F.count(x)


on_cases("e01_global_summary", f"SELECT count(*) AS n, 1e2 * sum(CAST(amterr > 52e0 AS INTEGER)) / count(amterr) AS pct_large, {dsum('amterr')} / count(amterr) AS mean_err, median(amterr) AS median_err, max(amterr) AS max_err FROM cases", lambda df: df.agg(rows(), (100.0 * F.sum((c("amterr") > 52).cast("int")) / F.count("amterr")).alias("pct_large"), mean("amterr").alias("mean_err"), F.median("amterr").alias("median_err"), F.max("amterr").alias("max_err")))
on_cases("e02_grouped_summary", f"SELECT state, count(*) AS n, {dsum('amterr')} AS dollars, {dsum('fsearn')} / count(fsearn) AS mean_earned FROM cases GROUP BY state", lambda df: df.groupBy("state").agg(rows(), S.exact_sum(c("amterr")).alias("dollars"), mean("fsearn").alias("mean_earned")))
on_cases("e03_count", "SELECT state, year, count(*) AS n FROM cases GROUP BY ALL", lambda df: df.groupBy("state", "year").agg(rows()))
on_cases("e04_group_by_expression", "SELECT amterr > 52e0 AS large, count(*) AS n FROM cases GROUP BY ALL", lambda df: df.groupBy((c("amterr") > 52).alias("large")).agg(rows()))
on_cases("e05_contingency", "SELECT status, element1, count(*) AS n FROM cases WHERE status IS NOT NULL AND element1 IS NOT NULL GROUP BY ALL", lambda df: R.contingency(df, "status", "element1"))
on_cases("e05_contingency_with_null", "SELECT status, element1, count(*) AS n FROM cases GROUP BY ALL", lambda df: R.contingency(df, "status", "element1", keep_null=True))
on_cases("e05_contingency_wide", "SELECT year, count(*) FILTER (WHERE status = 'amount correct') AS correct, count(*) FILTER (WHERE status = 'overissuance') AS over_n, count(*) FILTER (WHERE status = 'underissuance') AS under_n FROM cases GROUP BY year", lambda df: df.groupBy("year").pivot("status", [X.CORRECT, X.OVER, X.UNDER]).agg(F.count(F.lit(1))).select("year", *(F.coalesce(c(f"`{s}`"), F.lit(0)).alias(a) for s, a in ((X.CORRECT, "correct"), (X.OVER, "over_n"), (X.UNDER, "under_n")))))
on_cases("e06_proportions", "SELECT actntype, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM cases GROUP BY actntype", lambda df: R.shares(R.contingency(df, "actntype")))
on_cases("e07_conditional_counts", "SELECT state, count(*) FILTER (WHERE amterr > 52e0) AS large, count(*) FILTER (WHERE fsndis > 0) AS disabled FROM cases GROUP BY state", lambda df: df.groupBy("state").agg(F.count_if(c("amterr") > 52).alias("large"), F.count_if(c("fsndis") > 0).alias("disabled")))
on_cases("e08_weighted_dollars", "SELECT state, CAST(sum(CAST(amterr AS DECIMAL(18, 2)) * CAST(fywgt AS DECIMAL(10, 4))) AS DOUBLE) AS dollars FROM cases GROUP BY state", lambda df: df.groupBy("state").agg(F.sum(c("amterr").cast("decimal(18,2)") * c("fywgt").cast("decimal(10,4)")).cast("double").alias("dollars")))
on_cases("e09_weighted_mean", "SELECT year, CAST(sum(CAST(fsothun AS DECIMAL(18, 2)) * CAST(fywgt AS DECIMAL(10, 4))) AS DOUBLE) / CAST(sum(CAST(fywgt AS DECIMAL(10, 4))) AS DOUBLE) AS m FROM cases WHERE fsothun IS NOT NULL GROUP BY year", lambda df: df.filter(c("fsothun").isNotNull()).groupBy("year").agg((F.sum(c("fsothun").cast("decimal(18,2)") * c("fywgt").cast("decimal(10,4)")).cast("double") / F.sum(c("fywgt").cast("decimal(10,4)")).cast("double")).alias("m")))
on_cases("e10_median", "SELECT state, median(fsnetinc) AS m FROM cases GROUP BY state", lambda df: df.groupBy("state").agg(F.median("fsnetinc").alias("m")))
on_cases("e11_quantile", "SELECT year, round(quantile_cont(fsearn, 0.29), 6) AS q FROM cases GROUP BY year", lambda df: df.groupBy("year").agg(F.round(F.percentile("fsearn", F.lit(0.29)), 6).alias("q")))
on_cases("e12_five_numbers", f"SELECT status, min(fsben) AS lowest, quantile_cont(fsben, 0.25) AS q1, quantile_cont(fsben, 0.5) AS q2, quantile_cont(fsben, 0.75) AS q3, {dsum('fsben')} / count(fsben) AS mean, max(fsben) AS highest FROM cases GROUP BY status", lambda df: R.five_numbers(df, "fsben", "status"))
on_cases("e13_distinct_rows", "SELECT DISTINCT state, year, status FROM cases", lambda df: df.select("state", "year", "status").distinct())
on_cases("e14_zero_inflation", f"SELECT state, avg(CASE WHEN amterr = 0e0 THEN 1e0 ELSE 0e0 END) AS zero_share, {dsum('CASE WHEN amterr <> 0e0 THEN amterr END')} / nullif(count(CASE WHEN amterr <> 0e0 THEN 1 END), 0) AS mean_nonzero FROM cases GROUP BY state", lambda df: df.groupBy("state").agg((F.count_if(c("amterr") == 0) / F.count(F.lit(1))).alias("zero_share"), S.ratio(S.exact_sum(F.when(c("amterr") != 0, c("amterr"))), F.count_if(c("amterr") != 0)).alias("mean_nonzero")))
on_cases("e15_group_guard", "SELECT case_id, state FROM cases WHERE state IN (SELECT state FROM cases GROUP BY state HAVING sum(CAST(amterr AS DECIMAL(28, 6))) >= 15000)", lambda df: R.enough(df.select("case_id", "state", "amterr"), ["state"], F.sum(c("amterr").cast("decimal(28,6)")), 15000).select("case_id", "state"))
on_cases("e16_horizontal_range", "SELECT case_id, coalesce(CAST(least(age1, age2, age3) AS DOUBLE), 'Infinity'::DOUBLE) AS youngest, coalesce(CAST(greatest(age1, age2, age3) AS DOUBLE), '-Infinity'::DOUBLE) AS oldest FROM cases", lambda df: df.select("case_id", S.lowest([c("age1"), c("age2"), c("age3")]).alias("youngest"), S.highest([c("age1"), c("age2"), c("age3")]).alias("oldest")))
on_cases("e17_any_match", "SELECT case_id, coalesce(rel1 = 'Spouse', false) OR coalesce(rel2 = 'Spouse', false) OR coalesce(rel3 = 'Spouse', false) AS spouse FROM cases", lambda df: df.select("case_id", S.any_of([c("rel1"), c("rel2"), c("rel3")], ["Spouse"]).alias("spouse")))
on_cases("e18_row_counts", "SELECT case_id, CASE WHEN age1 < 18 THEN 1 ELSE 0 END + CASE WHEN age2 < 18 THEN 1 ELSE 0 END + CASE WHEN age3 < 18 THEN 1 ELSE 0 END AS minors FROM cases", lambda df: df.select("case_id", S.count_where(c(a) < 18 for a in ("age1", "age2", "age3")).alias("minors")))

on_cases("f01_grouped_mutate", "SELECT case_id, fywgt / (CAST(sum(CAST(fywgt AS DECIMAL(28, 6))) OVER (PARTITION BY state, year) AS DOUBLE) / count(fywgt) OVER (PARTITION BY state, year)) AS w FROM cases", lambda df: df.select("case_id", X.rescaled_weight().alias("w")))
each("f02_share_of_total", "SELECT error_category, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM strata GROUP BY error_category", lambda s, d: R.shares(R.contingency(recovered(s, d), "error_category")))
on_cases("f03_first_per_group", "SELECT state, case_id, amterr FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY amterr DESC, case_id) AS rn FROM cases) WHERE rn = 1", lambda df: R.first_per_group(df.select("state", "case_id", "amterr"), ["state"], [c("amterr").desc_nulls_last(), c("case_id")]))
on_cases("f04_top_with_ties", "SELECT state, case_id, amterr FROM (SELECT *, rank() OVER (PARTITION BY state ORDER BY amterr DESC) AS rk FROM cases) WHERE rk <= 10", lambda df: R.top_with_ties(df.select("state", "case_id", "amterr"), ["state"], [c("amterr").desc_nulls_last()], 10))
on_cases("f05_lowest_with_ties", "SELECT state, case_id, fsnetinc FROM (SELECT *, rank() OVER (PARTITION BY state ORDER BY fsnetinc) AS rk FROM cases) WHERE rk <= 5", lambda df: R.top_with_ties(df.select("state", "case_id", "fsnetinc"), ["state"], [c("fsnetinc").asc_nulls_last()], 5))
on_cases("f06_average_rank", "SELECT case_id, rank() OVER (PARTITION BY state ORDER BY amterr DESC) + (count(*) OVER (PARTITION BY state, amterr) - 1) / 2e0 AS r FROM cases", lambda df: df.select("case_id", R.average_rank(["state"], c("amterr").desc_nulls_last(), "amterr").alias("r")))
on_cases("f07_level_share", "SELECT case_id, CASE WHEN t = 0e0 THEN 5e-1 ELSE greatest(0e0, least(1e0, amterr / t)) END AS share FROM (SELECT case_id, amterr, CAST(sum(CAST(amterr AS DECIMAL(28, 6))) OVER (PARTITION BY fsusize) AS DOUBLE) AS t FROM cases)", lambda df: df.select("case_id", R.level_share(c("amterr"), "fsusize").alias("share")))
on_cases("f08_first_k", "SELECT state, case_id, place FROM (SELECT state, case_id, CAST(row_number() OVER (PARTITION BY state ORDER BY fsben DESC, case_id) AS INTEGER) AS place FROM cases) WHERE place <= 5", lambda df: R.padded_sequence(df.select("state", "case_id", "fsben"), "state", [c("fsben").desc(), c("case_id")], 5).filter(c("case_id").isNotNull()).select("state", "case_id", "place"))
on_cases("f09_padded_sequence", "WITH r AS (SELECT state, element1, count(*) AS n FROM cases WHERE element1 IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, element1) AS place FROM r) SELECT g.state, CAST(g.place AS INTEGER) AS place, o.element1, CAST(o.n AS DOUBLE) AS n FROM (SELECT DISTINCT state, place FROM r, range(1, 9) t(place)) g LEFT JOIN o ON g.state = o.state AND g.place = o.place", lambda df: R.padded_sequence(R.contingency(df, "state", "element1"), "state", [c("n").desc(), c("element1")], 8).select("state", "place", "element1", c("n").cast("double").alias("n")))

on_cases("g01_sorted", "SELECT case_id, fsothun, state FROM cases ORDER BY state, fsothun DESC NULLS LAST, case_id", lambda df: df.select("case_id", "fsothun", "state").orderBy(c("state").asc_nulls_last(), c("fsothun").desc_nulls_last(), "case_id"))


def best_by(df, metric):
    return R.first_per_group(df.select("state", "case_id", c(metric).alias("value")), ["state"], [c("value").desc_nulls_last(), c("case_id")])


on_cases("g02_dynamic_sort_key", "SELECT state, case_id, value FROM (SELECT state, case_id, fsben AS value, row_number() OVER (PARTITION BY state ORDER BY fsben DESC NULLS LAST, case_id) AS rn FROM cases) WHERE rn = 1", lambda df: best_by(df, "fsben"))
on_cases("g03_top_5_per_group", "SELECT state, case_id, fsearn FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY fsearn DESC, case_id) AS rn FROM cases WHERE amterr > 0e0) WHERE rn <= 5", lambda df: R.first_per_group(df.filter(c("amterr") > 0).select("state", "case_id", "fsearn"), ["state"], [c("fsearn").desc(), c("case_id")], 5))
on_cases("g04_global_top", "SELECT case_id, fsearn FROM cases ORDER BY fsearn DESC, case_id LIMIT 9", lambda df: df.select("case_id", "fsearn").orderBy(c("fsearn").desc(), "case_id").limit(9))
on_cases("g05_random_sample", None, lambda df: df.select("case_id", "state").orderBy(F.rand(7)).limit(50))
