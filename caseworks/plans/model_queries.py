"""Queries for trees and models. What has no SQL form is checked by the tests against plain versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from caseworks.operators import features as X, models as M, trees as T
from caseworks.operators.report import top_with_ties
from caseworks.plans.pipeline_queries import recovered
from caseworks.plans.registry import each
from caseworks.sources.case_view import cases
from caseworks.sources.working import kept, shared_dir

c = F.col
FEATURES = ["fsearn", "fsunearn", "fssltexp", "fsusize", "fstotded", "cat_elig", "actntype", "homeded"]
ROOT_FEATURES = ["fsearn", "fsunearn", "fssltexp"]
_grown: dict[tuple[str, str, str], T.Forest] = {}


def forest(spark, d, kind: str) -> T.Forest:
    """Trees for each state, or for each stratum of error beside the correct cases; grown once for each application and source."""
    key = (spark.sparkContext.applicationId, kind, f"{shared_dir(spark)} {d}")
    if key not in _grown:
        if kind == "state":
            _grown[key] = T.grow(cases(spark, d).filter("status IS NOT NULL AND status <> 'underissuance'"), "amterr", FEATURES, "state")
        else:
            df = recovered(spark, d).filter("year IN (2022, 2023)")
            strata = F.array(F.lit("earned_overissuance"), F.lit("unearned_overissuance"), F.lit("underissuance"))
            mine = F.when(c("status_clean") == X.CORRECT, strata).when(c("error_status").isNotNull(), F.array("error_status"))
            _grown[key] = T.grow(df.withColumn("stratum", F.explode(mine)), "amterr", FEATURES, "stratum")
    return _grown[key]


ROOT_SQL = (
    "WITH long AS ("
    + " UNION ALL ".join(f"SELECT state, '{f}' AS feature, {k + 1} AS place, {f} AS value, CAST(amterr AS DECIMAL(18, 2)) AS y FROM cases WHERE {f} IS NOT NULL" for k, f in enumerate(ROOT_FEATURES))
    + """), sums AS (SELECT state, feature, place, value, count(*) AS n, sum(y) AS s FROM long GROUP BY ALL),
runs AS (SELECT state, feature, place, value, lead(value) OVER w AS nxt, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS nl, CAST(sum(s) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS sl,
  sum(n) OVER (PARTITION BY state, feature) AS nt, CAST(sum(s) OVER (PARTITION BY state, feature) AS DOUBLE) AS st FROM sums WINDOW w AS (PARTITION BY state, feature ORDER BY value)),
gains AS (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain FROM runs WHERE nt >= 20 AND nl >= 7 AND nt - nl >= 7),
best AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY gain DESC, place, (value + nxt) / 2) AS rn FROM gains WHERE gain > 0)
SELECT state, feature, (value + nxt) / 2 AS threshold, CAST(nl AS BIGINT) AS n_left, CAST(nt - nl AS BIGINT) AS n_right FROM best WHERE rn = 1"""
)


def root_split(spark, d):
    rows = cases(spark, d).select(c("state").alias("group"), F.lit(1).alias("node"), F.lit(0.0).alias("root_sse"), c("amterr").cast("decimal(18,2)").alias("y"), *ROOT_FEATURES)
    best = T.best_splits(T.split_gains(rows, ROOT_FEATURES, T.Limits()))
    return best.select(c("group").alias("state"), "feature", "threshold", c("nl").alias("n_left"), c("nr").alias("n_right"))


each("l01_root_split", ROOT_SQL, root_split)
each("l01_tree_nodes", None, lambda s, d: forest(s, d, "state").nodes)
each("l02_trees_by_error_type", None, lambda s, d: forest(s, d, "stratum").nodes)
each("l03_fit_trees", None, lambda s, d: T.split_table(forest(s, d, "state"), 5).join(T.summary(forest(s, d, "state")), "group"))
each("l04_predictions", None, lambda s, d: T.predictions(forest(s, d, "state")))
each("l05_split_table", None, lambda s, d: T.split_table(forest(s, d, "state"), 8))
each("l06_capture_by_depth", None, lambda s, d: T.capture_by_depth(forest(s, d, "state")))
each("l07_false_positive_rate", None, lambda s, d: T.false_positive_rate(forest(s, d, "state")))
_dec = "CAST(sum(CAST(amterr AS DECIMAL(18, 2))) AS DOUBLE)"
each("l08_outcome_totals", f"SELECT state AS \"group\", count(*) AS n_cases, {_dec} / count(*) AS mean_error, median(amterr) AS median_error, {_dec} AS total_actual_error FROM cases WHERE status IS NOT NULL AND status <> 'underissuance' GROUP BY state", lambda s, d: T.summary(forest(s, d, "state")).select("group", "n_cases", "mean_error", "median_error", "total_actual_error"))
each("l08_summary", None, lambda s, d: T.summary(forest(s, d, "stratum")))
each("l09_first_splits", None, lambda s, d: T.split_table(forest(s, d, "stratum"), 8).filter("split_order <= 5"))
each("l10_importance", None, lambda s, d: top_with_ties(T.importance(forest(s, d, "state")), ["group"], [c("rank")], 5))
each("l11_node_colours", None, lambda s, d: T.node_colours(forest(s, d, "state")))


def dot_files(spark, d):
    nodes = forest(spark, d, "stratum").nodes.collect()  # at most 127 nodes for each of three trees
    groups = sorted({r["group"] for r in nodes})
    return spark.createDataFrame([(g, T.to_dot([r for r in nodes if r["group"] == g], g)) for g in groups], "tree string, dot string")


each("l12_tree_graphs", None, dot_files)

NUMBERS = ["fsearn", "fsunearn", "fssltexp", "fsusize", "fstotded"]

PENALTIES = [0.0, *(10.0 ** (-6 + k / 3) for k in range(19))]


@dataclass(frozen=True)
class Job:
    """How much the model queries fit. The registered ones fit this much, tuning the reference's whole grid; WHOLE has them in the reference's size."""

    trees: int = 50
    class_trees: int = 100
    folds: int = 5
    ablation_folds: int = 2
    specified_trees: int = 250
    rounds: int = 20
    penalties: tuple[float, ...] = tuple(PENALTIES)
    tuning_folds: int = 5


WHOLE_JOB = Job(500, 1000, 5, 5, 2500, 1500, tuple(PENALTIES), 5)


#: What the model queries read of a case.
LABELLED = ["case_id", "state", "actntype", "homeded", "fywgt", "amterr", *NUMBERS]


def labelled(spark, d, seed: int = 1, k: int = 4):
    """Cases with a 0/1 label for a counted payment error and a fold. They are dealt once for each application and source, not at each pass of a fit."""
    rows = lambda: cases(spark, d).filter("status IS NOT NULL").select(*LABELLED, (c("over_threshold") == 1).cast("int").alias("error"))
    return kept(spark, f"labelled-{seed}", d, lambda: M.dealt(rows(), "error", seed)).withColumn("fold", (c("place") % k).cast("int")).drop("place")


def scores(spark, rows, *kinds: str):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} {t}" for n, t in zip(kinds[::2], kinds[1::2], strict=True)))


MD5_FOLD = "(row_number() OVER (PARTITION BY CAST(over_threshold = 1 AS INTEGER) ORDER BY md5('1:' || CAST(case_id AS VARCHAR)), case_id) - 1)"


def model_jobs(job: Job) -> dict:
    """The model queries whose work has a size, by key."""

    def forest_error(s, d):
        rows = M.vectors(labelled(s, d, k=job.folds), NUMBERS, c("amterr"))
        return scores(s, [(M.fold_error(rows, M.RandomForestRegressor(numTrees=job.trees, seed=1), job.folds),)], "rmse", "double")

    def forest_importance(s, d):
        found = M.forest_regression(M.vectors(labelled(s, d), NUMBERS, c("amterr")), job.trees).featureImportances.toArray()
        return scores(s, [(n, float(v)) for n, v in zip(NUMBERS, found, strict=True)], "variable", "string", "importance", "double")

    def forest_area(s, d):
        rows = M.vectors(labelled(s, d, k=job.folds), NUMBERS, c("error"))
        return scores(s, [(M.fold_area(rows, M.forest_classifier(job.class_trees, "3", 14), job.folds),)], "area_under_pr", "double")

    def ablation(s, d):
        found = M.ablation(labelled(s, d, k=job.ablation_folds), NUMBERS, c("amterr"), M.RandomForestRegressor(numTrees=job.trees, seed=1), job.ablation_folds)
        return scores(s, found, "left_out", "string", "rmse", "double")

    def chances(estimator):
        def run(s, d):
            rows = M.vectors(labelled(s, d), NUMBERS, c("error"))
            return estimator.fit(rows).transform(rows).select("case_id", M.probability().alias("p"))

        return run

    def tuning(s, d):
        rows = M.vectors(labelled(s, d, k=job.tuning_folds), NUMBERS, c("error")).select("features", "label", "fold")
        model = M.tuned_logit(rows, job.penalties, job.tuning_folds)
        return scores(s, [(float(p), float(a)) for p, a in zip(job.penalties, model.avgMetrics, strict=True)], "penalty", "double", "area_under_roc", "double")

    return {
        "m01_forest_regression": forest_error, "m01_forest_importance": forest_importance, "m02_forest_classification": forest_area, "m03_ablation": ablation,
        "m04_forest_specification": lambda s, d: chances(M.forest_classifier(job.specified_trees, per_split="all"))(s, d),
        "m05_boosted_trees": lambda s, d: chances(M.boosted_classifier(job.rounds, depth=8))(s, d), "m11_tuning": tuning,
    }


WHOLE = model_jobs(WHOLE_JOB)
for _name, _job in model_jobs(Job()).items():
    each(_name, None, _job)


def multinomial(spark, d):
    df = cases(spark, d).withColumn("outcome", X.outcome_class()).filter("outcome IS NOT NULL")
    label = F.when(c("outcome") == "amount correct", 0).when(c("outcome") == "uncounted_error", 1).otherwise(2)
    rows = M.vectors(df, NUMBERS, label)
    model = M.multinomial_logit(0.01).fit(rows)
    names = ["amount correct", "uncounted_error", "above_threshold_error"]
    values = model.coefficientMatrix.toArray()
    return scores(spark, [(names[i], n, float(values[i][j])) for i in range(values.shape[0]) for j, n in enumerate(NUMBERS)], "outcome", "string", "term", "string", "coefficient", "double")


each("m06_multinomial", None, multinomial)


def gaussian(spark, d):
    model = M.linear_probability().fit(M.vectors(labelled(spark, d), NUMBERS, c("error")))
    return scores(spark, [("intercept", float(model.intercept)), *((n, float(v)) for n, v in zip(NUMBERS, model.coefficients.toArray(), strict=True))], "term", "string", "coefficient", "double")


each("m07_linear_probability", None, gaussian)
each("m08_state_slopes", None, lambda s, d: M.state_slopes(labelled(s, d), ["fsearn", "fsunearn"], "state", c("error"), "fywgt"))
each("m09_recipe", None, lambda s, d: (lambda df: M.recipe(NUMBERS, ["actntype", "homeded"]).fit(df).transform(df).select("case_id", M.vector_to_array("features").alias("features")))(labelled(s, d)))
each("m10_stratified_folds", f"SELECT case_id, CAST(over_threshold = 1 AS INTEGER) AS error, CAST({MD5_FOLD} % 5 AS INTEGER) AS fold FROM cases WHERE status IS NOT NULL", lambda s, d: labelled(s, d, k=5).select("case_id", "error", "fold"))
each("m10_stratified_split", f"SELECT case_id, {MD5_FOLD} % 4 < 3 AS train FROM cases WHERE status IS NOT NULL", lambda s, d: labelled(s, d, k=4).select("case_id", (c("fold") < 3).alias("train")))
GUESS_SQL = "CASE WHEN rawben >= 5e-1 * benmax AND fsearn > 0e0 THEN 1 ELSE 0 END"
each("m12_confusion", f"SELECT over_threshold AS truth, {GUESS_SQL} AS guess, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY over_threshold) AS share FROM cases GROUP BY over_threshold, {GUESS_SQL}", lambda s, d: M.confusion(cases(s, d).select(c("over_threshold").alias("truth"), F.when((c("rawben") >= 0.5 * c("benmax")) & (c("fsearn") > 0), 1).otherwise(0).alias("guess")), "truth", "guess"))
