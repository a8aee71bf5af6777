"""Regression trees grown level by level for all groups at once, and what is read off them.

At each level one aggregation sums the outcome by (group, node, feature, value); running sums over the values give the gain of every split; the best
split of each node moves its rows to child nodes 2k and 2k + 1. Outcomes are summed as decimals, so that results do not depend on
the order of rows; ties go to the feature that comes first, then to the smaller threshold. Rows whose value is null go to the larger child.
The levels of a text feature are put in the order of their mean outcome at each node and then split like numbers; a node names the levels that go left.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseworks.functions.semantics import ratio
from caseworks.operators.report import average_rank, padded_sequence
from caseworks.sources.working import settle


@dataclass(frozen=True)
class Limits:
    """cp is the least gain as a share of the root's error; min_leaf is a third of min_split. digits rounds features, which bounds their distinct values."""

    max_depth: int = 6
    min_split: int = 20
    min_leaf: int = 7
    cp: float = 1e-6
    digits: int | None = None


@dataclass
class Forest:
    """nodes: group, node, depth, n, mean, sse, total, feature, threshold, gain, left_levels (of a text feature), is_leaf; rows: group, case_id, y, node (the leaf)."""

    nodes: DataFrame
    rows: DataFrame


def texts_among(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [f for f in features if df.schema[f].dataType.simpleString() == "string"]


def _number(name: str, limits: Limits) -> Column:
    """A feature as the splits see it."""
    value = F.col(name).cast("double")
    return F.round(value, limits.digits) if limits.digits is not None else value


def _long(rows: DataFrame, values: list[Column], names: list[str], as_name: str) -> DataFrame:
    key = ["group", "node", "root_sse", "y"]
    return rows.select(*key, *values).unpivot(key, names, "feature", as_name).filter(F.col(as_name).isNotNull())


def level_means(rows: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Count, sum and mean of the outcome for each level of each text feature at each node."""
    long = _long(rows, [F.col(f) for f in texts], [*texts], "level")
    sums = long.groupBy("group", "node", "root_sse", "feature", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    return sums.withColumn("value", F.col("s").cast("double") / F.col("n"))


def split_gains(rows: DataFrame, features: Sequence[str], limits: Limits) -> DataFrame:
    """Every admissible split of each (group, node): feature, place of the feature, threshold, gain, and whether nulls go left."""
    texts = texts_among(rows, features)
    numbers = [f for f in features if f not in texts]
    parts, shape = [], ["group", "node", "root_sse", "feature", "value", "n", "s"]
    if numbers:
        long = _long(rows, [_number(f, limits).alias(f) for f in numbers], numbers, "value")
        parts.append(long.groupBy(*shape[:5]).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).select(shape))
    if texts:  # a level's value is its mean outcome; levels of equal mean go together
        parts.append(level_means(rows, texts).groupBy(*shape[:5]).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(shape))
    sums = reduce(DataFrame.unionByName, parts)
    upto = W.partitionBy("group", "node", "feature").orderBy("value")
    whole = W.partitionBy("group", "node", "feature")
    sums = sums.select(
        "group", "node", "root_sse", "feature", "value", F.lead("value").over(upto).alias("next"), F.sum("n").over(upto.rowsBetween(W.unboundedPreceding, 0)).alias("nl"),
        F.sum("s").over(upto.rowsBetween(W.unboundedPreceding, 0)).cast("double").alias("sl"), F.sum("n").over(whole).alias("nt"), F.sum("s").over(whole).cast("double").alias("st"),
    )
    c = F.col
    nr, sr = c("nt") - c("nl"), c("st") - c("sl")
    gain = c("sl") * c("sl") / c("nl") + sr * sr / nr - c("st") * c("st") / c("nt")
    fit = sums.filter((c("nt") >= limits.min_split) & (c("nl") >= limits.min_leaf) & (nr >= limits.min_leaf)).withColumn("gain", gain).filter((c("gain") > 0) & (c("gain") >= limits.cp * c("root_sse")))
    place = F.array_position(F.array(*(F.lit(f) for f in features)), c("feature"))
    return fit.select("group", "node", "feature", place.alias("place"), ((c("value") + c("next")) / 2).alias("threshold"), "gain", (c("nl") >= nr).alias("null_left"), "nl", nr.alias("nr"))


def best_splits(gains: DataFrame) -> DataFrame:
    order = [F.col("gain").desc(), F.col("place"), F.col("threshold")]
    return gains.withColumn("_n", F.row_number().over(W.partitionBy("group", "node").orderBy(*order))).filter("_n = 1").drop("_n", "place")


def with_left_levels(best: DataFrame, rows: DataFrame, texts: Sequence[str]) -> DataFrame:
    """best with the levels that go left where the feature is a text: no more than the feature has."""
    if not texts:
        return best.withColumn("left_levels", F.lit(None).cast("array<string>"))
    chosen = level_means(rows, texts).join(best.select("group", "node", "feature", "threshold"), ["group", "node", "feature"])
    left = chosen.groupBy("group", "node").agg(F.array_sort(F.collect_list(F.when(F.col("value") < F.col("threshold"), F.col("level")))).alias("left_levels"))
    return best.join(left, ["group", "node"], "left")


def _node_stats(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("group", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("double").alias("s"), F.sum((F.col("y") * F.col("y")).cast("decimal(38,6)")).cast("double").alias("q"))
    return sums.select("group", "node", "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("sse"), F.col("s").alias("total"))


def grow(df: DataFrame, outcome: str, features: Sequence[str], group: Column | str, limits: Limits = Limits()) -> Forest:
    """Grow a tree for each group; rows without an outcome or group are left out."""
    group = F.col(group) if isinstance(group, str) else group
    texts = texts_among(df, features)
    columns = [F.col(f) if f in texts else F.col(f).cast("double").alias(f) for f in features]
    rows = df.filter(F.col(outcome).isNotNull()).select(group.alias("group"), "case_id", F.col(outcome).cast("decimal(18,2)").alias("y"), *columns, F.lit(1).cast("long").alias("node")).filter("group IS NOT NULL")
    roots = _node_stats(rows).select("group", F.col("sse").alias("root_sse"))
    active, leaves, nodes = settle(rows.join(roots, "group"), "tree-rows"), [], []
    keep = ["group", "case_id", "y", "node"]
    for depth in range(limits.max_depth + 1):
        stats = _node_stats(active).withColumn("depth", F.lit(depth))
        if depth == limits.max_depth:
            nodes.append(stats)
            leaves.append(active.select(keep))
            break
        best = settle(with_left_levels(best_splits(split_gains(active, features, limits)), active, texts), "tree-splits")
        nodes.append(stats.join(best.select("group", "node", "feature", "threshold", "gain", "left_levels"), ["group", "node"], "left"))
        leaves.append(active.join(best, ["group", "node"], "left_anti").select(keep))
        if best.isEmpty():
            break
        # One row for each node of each group: the planner sends it to the rows where it is small.
        moved = active.join(best, ["group", "node"])
        numbers = [f for f in features if f not in texts]
        value = reduce(lambda rest, f: F.when(F.col("feature") == f, _number(f, limits)).otherwise(rest), numbers, F.lit(None).cast("double"))
        level = reduce(lambda rest, f: F.when(F.col("feature") == f, F.col(f)).otherwise(rest), texts, F.lit(None).cast("string"))
        left = F.coalesce(value < F.col("threshold"), F.array_contains("left_levels", level), F.col("null_left"))
        active = settle(moved.withColumn("node", 2 * F.col("node") + F.when(left, 0).otherwise(1)).select(*active.columns), "tree-rows")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), nodes)
    if "feature" not in every.columns:
        every = every.withColumns({"feature": F.lit(None).cast("string"), "threshold": F.lit(None).cast("double"), "gain": F.lit(None).cast("double"), "left_levels": F.lit(None).cast("array<string>")})
    every = every.withColumn("is_leaf", F.col("feature").isNull())
    return Forest(settle(every, "tree-nodes"), settle(reduce(DataFrame.unionByName, leaves), "tree-leaves"))


def predictions(forest: Forest) -> DataFrame:
    """group, case_id, y, node, depth and the leaf's mean."""
    leaf = forest.nodes.filter("is_leaf").select("group", "node", "depth", F.col("mean").alias("predicted"))
    return forest.rows.join(leaf, ["group", "node"]).withColumn("y", F.col("y").cast("double"))


def preorder(node: Column) -> Column:
    """Sort key of a node in the order parent, left, right: its path from the root."""
    return F.substring(F.bin(node), 2, 64)


def split_table(forest: Forest, k: int) -> DataFrame:
    """The first k splits of each tree in preorder, padded with nulls."""
    inner = forest.nodes.filter(~F.col("is_leaf")).withColumn("path", preorder(F.col("node")))
    padded = padded_sequence(inner, "group", [F.col("path")], k, forest.nodes)
    return padded.select("group", F.col("place").alias("split_order"), F.col("feature").alias("variable"), F.col("threshold").alias("split_value"), "node", F.col("mean").alias("node_mean"), "depth")


def capture_by_depth(forest: Forest, max_depth: int = 6) -> DataFrame:
    """Share of a tree's dollars that lie in leaves at depth d or above with a positive prediction, for each d."""
    p = predictions(forest)
    money = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("y").cast("decimal(18,2)"))), F.lit(0)).cast("double")
    total = money(F.lit(True))
    return p.groupBy("group").agg(*(ratio(money((F.col("depth") <= d) & (F.col("predicted") > 0)), total).alias(f"error_capture_depth_{d}") for d in range(1, max_depth + 1)))


def false_positive_rate(forest: Forest) -> DataFrame:
    """Predicted dollars on cases without error over predicted dollars."""
    money = F.col("predicted").cast("decimal(28,9)")
    zero = F.sum(F.when((F.col("y") == 0) & (F.col("predicted") > 0), money).otherwise(F.lit(0).cast("decimal(28,9)"))).cast("double")
    return predictions(forest).groupBy("group").agg(ratio(zero, F.sum(F.when(F.col("predicted") > 0, money).otherwise(F.lit(0).cast("decimal(28,9)"))).cast("double")).alias("fpr"))


def summary(forest: Forest, max_depth: int = 6) -> DataFrame:
    """One row for each tree: cases, mean and median error, totals, false positives and capture by depth."""
    p = predictions(forest)
    base = p.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_cases"), (F.sum(F.col("y").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("mean_error"), F.median("y").alias("median_error"),
        F.sum(F.col("y").cast("decimal(18,2)")).cast("double").alias("total_actual_error"), F.sum(F.col("predicted").cast("decimal(28,9)")).cast("double").alias("total_predicted_error"),
    )
    return base.join(false_positive_rate(forest), "group").join(capture_by_depth(forest, max_depth), "group")


def fit_trees(df: DataFrame, outcome: str, features: Sequence[str], group: str, n_top: int = 5, limits: Limits = Limits()) -> DataFrame:
    """Grow and assemble: the summary of each tree beside its first splits."""
    forest = grow(df, outcome, features, group, limits)
    return split_table(forest, n_top).join(summary(forest, limits.max_depth), "group")


def importance(forest: Forest) -> DataFrame:
    """Gain summed over splits for each feature, with its rank in the tree; equal gains share the mean rank."""
    summed = forest.nodes.filter(~F.col("is_leaf")).groupBy("group", F.col("feature").alias("variable")).agg(F.sum(F.col("gain").cast("decimal(28,6)")).cast("double").alias("importance"))
    return summed.withColumn("rank", average_rank(["group"], F.col("importance").desc(), "importance"))


def node_colours(forest: Forest) -> DataFrame:
    """Step of a ramp of 101 colours by the root of a node's mean over the largest in its tree, and the share of its level's dollars."""
    top = F.max("mean").over(W.partitionBy("group"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("mean"), top)))))
    level = F.sum(F.col("total").cast("decimal(28,6)")).over(W.partitionBy("group", "depth")).cast("double")
    share = F.when(level == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("total") / level)))
    return forest.nodes.select("group", "node", "depth", (F.bround(F.coalesce(scaled, F.lit(0.0)) * 100, 0) + 1).cast("int").alias("colour"), share.alias("level_share"))


def to_dot(nodes: Sequence, title: str) -> str:
    """Graph description of one tree's node rows, for any renderer."""
    lines = [f'digraph "{title}" {{', "node [shape=box];"]
    for r in sorted(nodes, key=lambda r: r["node"]):
        test = "" if r["is_leaf"] else f"\\n{r['feature']} < {r['threshold']:.4g}" if r["left_levels"] is None else f"\\n{r['feature']} in {', '.join(r['left_levels'])}"
        lines.append(f'n{r["node"]} [label="mean {r["mean"]:.2f}\\nn = {r["n"]}{test}"];')
        lines += [] if r["is_leaf"] else [f"n{r['node']} -> n{2 * r['node']} [label=yes];", f"n{r['node']} -> n{2 * r['node'] + 1} [label=no];"]
    return "\n".join([*lines, "}"])
