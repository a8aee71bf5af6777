"""Queries for rule mining, rule application and precision-recall surfaces. The oracles evaluate every rule on every case."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseworks.functions.semantics import steps
from caseworks.operators import rules as K
from caseworks.operators.features import CORRECT, OVER, UNDER
from caseworks.operators.report import first_per_group
from caseworks.plans.registry import each
from caseworks.sources.case_view import cases

c = F.col
EARNED = [
    K.Axis("earned_by_size", ">=", tuple(steps(1, 501, 50))), K.Axis("rawben_rel", "band", lower=tuple(steps(0.4, 1, 0.05)), upper=(1.0, 1.01)),
    K.Axis("shelter_by_size", "<=", tuple(steps(0, 2000, 250))), K.Axis("shelter_ratio", ">=", (0.0, 2.0)),
]
UNEARNED = [
    K.Axis("unearned_by_size", ">=", tuple(steps(0, 600, 100))), K.Axis("fssltexp", "band", lower=tuple(steps(0, 1000, 250)), upper=tuple(steps(0, 1000, 250))),
    K.Axis("deductions_by_size", "<=", tuple(steps(0, 800, 200))), K.Axis("rawben_rel", ">=", (0.4, 0.6, 0.8)), K.Axis("fsusize", ">=", (1.0, 3.0, 5.0)),
]
UNDERPAID = [K.Axis("earned_by_size", ">=", tuple(steps(0, 600, 50))), K.Axis("rawben_rel", "band", lower=tuple(steps(0, 1, 0.1)), upper=tuple(steps(0.5, 1, 0.1))), K.Axis("shelter_by_size", "<", tuple(steps(0, 800, 100)))]
SURFACE = [K.Axis("fsearn", ">=", tuple(steps(200, 1300, 100))), K.Axis("other_by_size", ">=", tuple(steps(0, 400, 50))), K.Axis("shelter_ratio", "<", tuple(steps(0, 4, 0.25)))]

RULED_SQL = """ruled AS (SELECT *, fsearn / nullif(fsusize, 0) AS earned_by_size, fsunearn / nullif(fsusize, 0) AS unearned_by_size, fsgrinc / nullif(fsusize, 0) AS gross_by_size,
  fstotded / nullif(fsusize, 0) AS deductions_by_size, rawben / nullif(benmax, 0e0) AS rawben_rel, fssltexp / nullif(fsusize, 0) AS shelter_by_size,
  fssltexp / nullif(fsgrinc + 1, 0e0) AS shelter_ratio, fsothun / nullif(fsusize, 0) AS other_by_size FROM cases)"""


def ruled(spark, d):
    return K.with_rule_columns(cases(spark, d))


def _values(name: str, values) -> str:
    return f"(SELECT unnest([{', '.join(f'{float(v)!r}::DOUBLE' for v in values)}]) AS {name})"


def grid_sql(axes) -> str:
    lists = [(n, v) for a in axes for n, v in (zip(a.names, (a.lower, a.upper)) if a.op == "band" else [(a.names[0], a.bounds)])]
    bands = [f"{a.names[0]} <= {a.names[1]}" for a in axes if a.op == "band"]
    return "SELECT * FROM " + ", ".join(_values(n, v) for n, v in lists) + (" WHERE " + " AND ".join(bands) if bands else "")


def test_sql(axes) -> str:
    return " AND ".join(f"{a.column} >= {a.names[0]} AND {a.column} < {a.names[1]}" if a.op == "band" else f"{a.column} {a.op} {a.names[0]}" for a in axes)


def mined_sql(axes, target=OVER, sig="amterr > 52e0", false="amterr <= 52e0", where="true", least=1000) -> str:
    other = UNDER if target == OVER else OVER
    names = ", ".join(K.bounds_of(axes))
    used = ", ".join(dict.fromkeys(a.column for a in axes))
    dollars = f"CASE WHEN status = '{target}' THEN CAST(amterr AS DECIMAL(18, 2)) * CAST(fywgt AS DECIMAL(10, 4)) ELSE 0 END"
    return f"""{RULED_SQL},
pop AS (SELECT state, {used}, {dollars} AS captured, CAST(amterr AS DECIMAL(18, 2)) AS flat, CAST(coalesce({sig}, false) AS INTEGER) AS s, CAST(coalesce(amterr > 0e0, false) AS INTEGER) AS e,
  CAST(coalesce({false}, false) AS INTEGER) AS f FROM ruled WHERE status IS NOT NULL AND status <> '{other}' AND {where}),
tot AS (SELECT state, sum(captured) AS dollars, count(*) AS total_n FROM pop GROUP BY state HAVING sum(captured) >= {least}),
grid AS ({grid_sql(axes)}),
hits AS (SELECT state, {names}, sum(captured) AS cap, sum(flat) AS flat, count(*) AS n, sum(s) AS s, sum(e) AS e, sum(f) AS f FROM pop JOIN grid ON {test_sql(axes)} GROUP BY ALL),
mined AS (SELECT 'state' AS geography_type, state AS geography_value, CAST(dollars AS DOUBLE) AS geography_total_error, {names}, CAST(cap AS DOUBLE) AS error_dollars_captured, n AS n_flagged,
  CAST(s AS BIGINT) AS n_sig_errors_flagged, CAST(e AS BIGINT) AS n_errors_flagged, CAST(f AS BIGINT) AS n_false_positives, CAST(cap AS DOUBLE) / nullif(CAST(dollars AS DOUBLE), 0e0) AS dollar_recall,
  CAST(s AS DOUBLE) / n AS precision, CAST(e AS DOUBLE) / n AS pct_any_error, CAST(f AS DOUBLE) / n AS fpr_flagged, CAST(flat AS DOUBLE) / n AS dollars_per_case,
  CAST(n AS DOUBLE) / total_n AS pct_flagged, total_n FROM hits JOIN tot USING (state))"""


def best_sql(axes, by="dollars_per_case", fit="precision >= 2e-1 AND pct_flagged <= 3e-1", n=1) -> str:
    order = ", ".join([f"{by} DESC", *reversed(K.bounds_of(axes))])
    return f"best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY geography_value ORDER BY {order}) AS rn FROM mined WHERE {fit}) WHERE rn <= {n})"


LIMITS = {"min_precision": 0.2, "max_flagged": 0.3}
UNDER_ARGS = {"target": UNDER, "over_flag": "over_threshold"}
UNDER_SQL = {"target": UNDER, "sig": "over_threshold = 1", "false": "over_threshold <> 1 OR amterr = 0e0"}

each("k01_earned_grid", "WITH " + mined_sql(EARNED) + " SELECT * FROM mined", lambda s, d: K.mine_rules(ruled(s, d), EARNED))
each("k02_unearned_grid", "WITH " + mined_sql(UNEARNED) + " SELECT * FROM mined", lambda s, d: K.mine_rules(ruled(s, d), UNEARNED))
each("k03_underissuance_grid", "WITH " + mined_sql(UNDERPAID, **UNDER_SQL) + " SELECT * FROM mined", lambda s, d: K.mine_rules(ruled(s, d), UNDERPAID, **UNDER_ARGS))
each("k04_metric_block", "WITH " + mined_sql(EARNED[:1]) + " SELECT * FROM mined", lambda s, d: K.mine_rules(ruled(s, d), EARNED[:1]))
each("k05_false_positives", "WITH " + mined_sql(EARNED[:1], sig="over_threshold = 1", false="over_threshold <> 1 OR amterr = 0e0") + " SELECT geography_value, earned_by_size_bound, n_false_positives FROM mined", lambda s, d: K.mine_rules(ruled(s, d), EARNED[:1], over_flag="over_threshold").select("geography_value", "earned_by_size_bound", "n_false_positives"))
each("k06_geography_guard", "WITH " + mined_sql(EARNED[:2], least=20000) + " SELECT geography_value, count(*) AS n_rules FROM mined GROUP BY ALL", lambda s, d: K.mine_rules(ruled(s, d), EARNED[:2], min_dollars=20000).groupBy("geography_value").agg(F.count(F.lit(1)).alias("n_rules")))
each("k07_best_rule", "WITH " + mined_sql(EARNED) + ", " + best_sql(EARNED) + " SELECT * FROM best", lambda s, d: K.best_rules(K.mine_rules(ruled(s, d), EARNED), EARNED, **LIMITS))
each("k08_top_5_by_recall", "WITH " + mined_sql(EARNED) + ", " + best_sql(EARNED, "dollar_recall", "precision >= 2e-1", 5) + " SELECT geography_value, " + ", ".join(K.bounds_of(EARNED)) + ", dollar_recall FROM best", lambda s, d: first_per_group(K.mine_rules(ruled(s, d), EARNED).filter("precision >= 0.2"), ["geography_value"], [c("dollar_recall").desc(), *(c(b) for b in reversed(K.bounds_of(EARNED)))], 5).select("geography_value", *K.bounds_of(EARNED), "dollar_recall"))


def tested_sql(axes, mined: str) -> str:
    return f"""{mined}, {best_sql(axes)},
j AS (SELECT b.geography_type, b.geography_value, b.dollar_recall AS train_dollar_recall, b.precision AS train_precision, b.n_flagged AS train_n_flagged, b.pct_flagged AS train_pct_flagged,
  coalesce({test_sql(axes)}, false) AS hit, over_threshold = 1 AS sig, coalesce(status IN ('overissuance', 'underissuance'), false) AS err, amterr, CAST(amterr AS DECIMAL(18, 2)) AS flat,
  CAST(amterr AS DECIMAL(18, 2)) * CAST(fywgt AS DECIMAL(10, 4)) AS money FROM ruled r JOIN best b ON r.state = b.geography_value WHERE r.year > 2020),
g AS (SELECT geography_type, geography_value, train_dollar_recall, train_precision, train_n_flagged, train_pct_flagged, CAST(coalesce(sum(money) FILTER (WHERE sig), 0) AS DOUBLE) AS test_total_error,
  CAST(coalesce(sum(money) FILTER (WHERE hit AND err), 0) AS DOUBLE) AS test_error_captured, count(*) FILTER (WHERE hit) AS test_n_flagged, count(*) FILTER (WHERE hit AND sig) AS test_n_sig_errors_flagged,
  count(*) FILTER (WHERE hit AND amterr > 0e0) AS test_n_errors_flagged, count(*) FILTER (WHERE hit AND (NOT sig OR amterr = 0e0)) AS test_n_false_positives, count(*) AS test_total_cases,
  CAST(coalesce(sum(flat) FILTER (WHERE hit AND sig), 0) AS DOUBLE) AS flat FROM j GROUP BY ALL),
h AS (SELECT * EXCLUDE (flat), CASE WHEN test_total_error > 0e0 THEN test_error_captured / test_total_error ELSE 0e0 END AS test_dollar_recall,
  CASE WHEN test_n_flagged > 0 THEN test_n_sig_errors_flagged / test_n_flagged ELSE 0e0 END AS test_precision, test_n_flagged / test_total_cases AS test_pct_flagged,
  CASE WHEN test_n_sig_errors_flagged > 0 THEN flat / test_n_sig_errors_flagged ELSE 0e0 END AS test_dollars_per_case FROM g),
tested AS (SELECT *, test_dollar_recall - train_dollar_recall AS recall_change, test_precision - train_precision AS precision_change FROM h)"""


def tested(axes, **args):
    def run(spark, d):
        train, test = ruled(spark, d).filter("year <= 2020"), ruled(spark, d).filter("year > 2020")
        best = K.best_rules(K.mine_rules(train, axes, **args), axes, **LIMITS)
        return K.apply_rules(K.as_rules(best, axes), test, [a.column for a in axes])

    return run


EARNED_TESTED = "WITH " + tested_sql(EARNED, mined_sql(EARNED, where="year <= 2020"))
each("k09_apply_over_rules", EARNED_TESTED + " SELECT * FROM tested", tested(EARNED))
each("k10_apply_under_rules", "WITH " + tested_sql(UNDERPAID, mined_sql(UNDERPAID, where="year <= 2020", **UNDER_SQL)) + " SELECT * FROM tested", tested(UNDERPAID, **UNDER_ARGS))
each("k11_train_test_change", EARNED_TESTED + " SELECT geography_value, recall_change, precision_change FROM tested", lambda s, d: tested(EARNED)(s, d).select("geography_value", "recall_change", "precision_change"))
_dec = lambda x: f"CAST(sum(CAST({x} AS DECIMAL(28, 9))) AS DOUBLE)"
each("k12_overall_summary", EARNED_TESTED + f" SELECT count(*) AS n_geographies, {_dec('test_dollar_recall * test_total_error')} / {_dec('test_total_error')} AS recall, {_dec('test_precision * test_n_flagged')} / nullif(sum(test_n_flagged), 0) AS precision, CAST(sum(test_n_flagged) AS BIGINT) AS n_flagged, CAST(sum(test_total_cases) AS BIGINT) AS n_cases, {_dec('recall_change')} / count(recall_change) AS mean_recall_change FROM tested", lambda s, d: K.overall_summary(tested(EARNED)(s, d)))
each("k13_degraded", EARNED_TESTED + " SELECT geography_value FROM tested WHERE recall_change < -5e-2 OR precision_change < -5e-2", lambda s, d: K.degraded(tested(EARNED)(s, d)).select("geography_value"))
each("d06_rule_lookup", EARNED_TESTED.replace("WITH ", "WITH ", 1) + " SELECT geography_value, count(*) AS n FROM j WHERE hit GROUP BY ALL", lambda s, d: tested(EARNED)(s, d).filter("test_n_flagged > 0").select("geography_value", c("test_n_flagged").alias("n")))
each("d05_rules_by_cases", "WITH " + mined_sql(EARNED, least=0) + " SELECT geography_value, " + ", ".join(K.bounds_of(EARNED)) + ", n_flagged FROM mined", lambda s, d: K.mine_rules(ruled(s, d), EARNED, min_dollars=0).select("geography_value", *K.bounds_of(EARNED), "n_flagged"))
FLAG_SQL = "coalesce(earned_by_size >= 151e0 AND rawben_rel >= 5e-1 AND shelter_by_size <= 6e2, false)"
each("k14_hand_coded_flag", f"WITH {RULED_SQL} SELECT state, {FLAG_SQL} AS flag, amterr > 52e0 AS large, count(*) AS n FROM ruled GROUP BY ALL", lambda s, d: ruled(s, d).groupBy("state", F.coalesce((c("earned_by_size") >= 151) & (c("rawben_rel") >= 0.5) & (c("shelter_by_size") <= 600), F.lit(False)).alias("flag"), (c("amterr") > 52).alias("large")).agg(F.count(F.lit(1)).alias("n")))

SURFACE_SQL = f"""{RULED_SQL}, grid AS ({grid_sql(SURFACE)}),
x AS (SELECT state, {', '.join(K.bounds_of(SURFACE))}, coalesce(over_threshold = 1, false) AS pos, {test_sql(SURFACE)} AS hit FROM ruled, grid),
y AS (SELECT state, {', '.join(K.bounds_of(SURFACE))}, count(*) FILTER (WHERE hit AND pos) AS tp, count(*) FILTER (WHERE hit AND NOT pos) AS fp, count(*) FILTER (WHERE NOT hit AND pos) AS fn, count(*) FILTER (WHERE NOT hit AND NOT pos) AS tn FROM x GROUP BY ALL),
surface AS (SELECT *, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, fp / nullif(fp + tn, 0) AS fpr, tp + fp AS n_pred_pos FROM y WHERE tp + fp > 0)"""


def surface(spark, d):
    return K.pr_surface(ruled(spark, d), SURFACE, "state", c("over_threshold") == 1)


each("k15_pr_surface", f"WITH {SURFACE_SQL} SELECT * FROM surface", surface)
TIER_SQL = f"""{SURFACE_SQL}, tiers AS (SELECT *, CASE WHEN precision >= 75e-2 THEN 'high' WHEN precision >= 5e-1 THEN 'medium' WHEN precision >= 33e-2 THEN 'low' ELSE 'very low' END AS option FROM surface),
picked AS (SELECT * EXCLUDE (rk) FROM (SELECT *, rank() OVER (PARTITION BY state, option ORDER BY recall DESC NULLS LAST) AS rk FROM tiers) WHERE rk = 1)"""
each("k16_tradeoff_tiers", f"WITH {TIER_SQL} SELECT state, option, recall, precision, {', '.join(K.bounds_of(SURFACE))} FROM picked", lambda s, d: K.pr_tiers(surface(s, d), "state").select("state", "option", "recall", "precision", *K.bounds_of(SURFACE)))
each("k17_fpr_constraint", f"WITH {TIER_SQL} SELECT state, option, fpr, fpr < 5e-1 AS meets_fpr, {', '.join(K.bounds_of(SURFACE))} FROM picked", lambda s, d: K.pr_tiers(surface(s, d), "state").select("state", "option", "fpr", "meets_fpr", *K.bounds_of(SURFACE)))
each("k18_leaf_verification", f"WITH {RULED_SQL} SELECT count(*) AS n, CAST(sum(CAST(amterr AS DECIMAL(28, 6))) AS DOUBLE) / count(*) AS mean_error FROM ruled WHERE year >= 2022 AND earned_by_size >= 5e2 AND rawben_rel < 8e-1 AND coalesce(status, '') <> '{CORRECT}'", lambda s, d: ruled(s, d).filter((c("year") >= 2022) & (c("earned_by_size") >= 500) & (c("rawben_rel") < 0.8) & (F.coalesce("status", F.lit("")) != CORRECT)).agg(F.count(F.lit(1)).alias("n"), (F.sum(c("amterr").cast("decimal(28,6)")).cast("double") / F.count(F.lit(1))).alias("mean_error")))

# The reference's whole grids: the ranges of its runs, and the defaults of its functions. DuckDB joins every case with every rule, which is too slow here, so that
# tests hold these grids against brute force instead; the smaller grids above keep their oracles.
EARNED_RUN = [
    K.Axis("earned_by_size", ">=", tuple(steps(1, 501, 50))), K.Axis("rawben_rel", "band", lower=tuple(steps(0.4, 1, 0.05)), upper=(1.0,)),
    K.Axis("shelter_by_size", "<=", tuple(steps(0, 2000, 100))), K.Axis("shelter_ratio", ">=", (0.0, 2.0)),
]
EARNED_DEFAULT = [
    K.Axis("earned_by_size", ">=", tuple(steps(0, 600, 50))), K.Axis("rawben_rel", "band", lower=tuple(steps(0, 1, 0.1)), upper=tuple(steps(0, 1, 0.1))),
    K.Axis("shelter_by_size", "<=", tuple(steps(0, 800, 100))), K.Axis("shelter_ratio", ">=", tuple(steps(0, 2, 0.1))),
]
UNEARNED_RUN = [
    K.Axis("unearned_by_size", ">=", tuple(steps(0, 1000, 100))), K.Axis("fssltexp", "band", lower=tuple(steps(100, 1500, 100)), upper=tuple(steps(100, 1500, 100))),
    K.Axis("deductions_by_size", "<=", (2000.0,)), K.Axis("rawben_rel", ">=", tuple(steps(0.4, 1, 0.05))), K.Axis("fsusize", ">=", (1.0,)),
]
UNEARNED_DEFAULT = [
    K.Axis("unearned_by_size", ">=", tuple(steps(0, 600, 50))), K.Axis("fssltexp", "band", lower=tuple(steps(0, 1000, 100)), upper=tuple(steps(0, 1000, 100))),
    K.Axis("deductions_by_size", "<=", tuple(steps(0, 800, 100))), K.Axis("rawben_rel", ">=", tuple(steps(0, 1, 0.1))), K.Axis("fsusize", ">=", tuple(steps(1, 6, 1))),
]
UNDERPAID_RUN = [K.Axis("earned_by_size", ">=", tuple(steps(0, 600, 50))), K.Axis("rawben_rel", "band", lower=tuple(steps(0.1, 0.9, 0.05)), upper=tuple(steps(0.1, 0.9, 0.05))), K.Axis("shelter_by_size", "<", tuple(steps(0, 2000, 100)))]
UNDERPAID_DEFAULT = [K.Axis("earned_by_size", ">=", tuple(steps(0, 600, 50))), K.Axis("rawben_rel", "band", lower=tuple(steps(0.5, 1, 0.05)), upper=tuple(steps(0.5, 1, 0.05))), K.Axis("shelter_by_size", "<", tuple(steps(0, 800, 100)))]
SURFACE_RUN = [K.Axis("fsearn", ">=", tuple(steps(200, 1300, 50))), K.Axis("rawben_rel", ">=", tuple(steps(0.1, 1, 0.05))), K.Axis("shelter_ratio", "<", tuple(steps(0, 4, 0.05)))]


def surface_run(spark, d):
    return K.pr_surface(ruled(spark, d), SURFACE_RUN, "state", c("over_threshold") == 1)


def tiers_run(spark, d):
    return K.pr_tiers(surface_run(spark, d), "state")


for _name, _axes, _args in (
    ("k01_earned_grid_run", EARNED_RUN, {}), ("k01_earned_grid_default", EARNED_DEFAULT, {}), ("k02_unearned_grid_run", UNEARNED_RUN, {}), ("k02_unearned_grid_default", UNEARNED_DEFAULT, {}),
    ("k03_underissuance_grid_run", UNDERPAID_RUN, UNDER_ARGS), ("k03_underissuance_grid_default", UNDERPAID_DEFAULT, UNDER_ARGS),
):
    each(_name, None, lambda s, d, axes=_axes, args=_args: K.mine_rules(ruled(s, d), axes, **args))
each("k07_best_rule_run", None, lambda s, d: K.best_rules(K.mine_rules(ruled(s, d), EARNED_RUN), EARNED_RUN, **LIMITS))
each("k08_top_5_by_recall_run", None, lambda s, d: first_per_group(K.mine_rules(ruled(s, d), EARNED_RUN).filter("precision >= 0.2"), ["geography_value"], [c("dollar_recall").desc(), *(c(b) for b in reversed(K.bounds_of(EARNED_RUN)))], 5).select("geography_value", *K.bounds_of(EARNED_RUN), "dollar_recall"))
each("k09_apply_over_rules_run", None, tested(EARNED_RUN))
each("k10_apply_under_rules_run", None, tested(UNDERPAID_RUN, **UNDER_ARGS))
each("k11_train_test_change_run", None, lambda s, d: tested(EARNED_RUN)(s, d).select("geography_value", "recall_change", "precision_change"))
each("k12_overall_summary_run", None, lambda s, d: K.overall_summary(tested(EARNED_RUN)(s, d)))
each("k13_degraded_run", None, lambda s, d: K.degraded(tested(EARNED_RUN)(s, d)).select("geography_value"))
each("k15_pr_surface_run", None, surface_run)
each("k16_tradeoff_tiers_run", None, lambda s, d: tiers_run(s, d).select("state", "option", "recall", "precision", *K.bounds_of(SURFACE_RUN)))
each("k17_fpr_constraint_run", None, lambda s, d: tiers_run(s, d).select("state", "option", "fpr", "meets_fpr", *K.bounds_of(SURFACE_RUN)))
