"""Summaries, shares, ranks and samples, as general operators on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseworks.functions.semantics import exact_sum


def contingency(df: DataFrame, *by: str, keep_null: bool = False) -> DataFrame:
    """Counts of the combinations that occur; rows with a null key are left out unless asked for."""
    return (df if keep_null else df.dropna(subset=[*by])).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def shares(counted: DataFrame, *within: str) -> DataFrame:
    """Add each count's share of its group's total; without groups, of the grand total, which is joined as the one row it is."""
    if within:
        return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*within)))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def first_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; order must break ties."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def top_with_ties(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The rows of each group whose rank is at most n; rows that tie come together."""
    return df.withColumn("_n", F.rank().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def average_rank(by: Sequence[str], order: Column, tied: str) -> Column:
    """Rank in the group where rows with equal values share the mean of their places."""
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(*by, tied)) - 1) / 2


def level_share(value: Column, level: str) -> Column:
    """Share of the level's total, one half where that is 0, within 0 and 1. The value is summed in decimals."""
    total = F.sum(value.cast("decimal(28,6)")).over(W.partitionBy(level)).cast("double")
    return F.when(total == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / total)))


def five_numbers(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum."""
    x = F.col(column)
    quartiles = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.min(x).alias("lowest"), quartiles.alias("_q"), (exact_sum(x) / F.count(x)).alias("mean"), F.max(x).alias("highest")).select(*by, "lowest", *(F.col("_q")[k].alias(f"q{k + 1}") for k in range(3)), "mean", "highest")


def padded_sequence(df: DataFrame, by: str, order: Sequence[Column], k: int, groups: DataFrame | None = None) -> DataFrame:
    """Number the rows of each group and keep k numbers in each, with nulls where a group has fewer rows; groups adds those that have none."""
    numbered = df.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    frame = (df if groups is None else groups).select(by).distinct().withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return frame.join(numbered, [by, "place"], "left")


def enough(df: DataFrame, by: Sequence[str], total: Column, least: float) -> DataFrame:
    """The rows of groups whose total reaches the least value."""
    return df.join(df.groupBy(*by).agg(total.alias("_total")).filter(F.col("_total") >= least).select(*by), [*by], "left_semi")
