"""Mixing sources to target weights: hash-random keys, range-sorted within each source, cut at exact budgets.

Every row gets a random key from its identifier. The key's leading digits deal each source over many key ranges; sizes
are summed per range, prefix sums over ranges say where each range begins, and prefix sums inside a range finish the
order. A hot source is so spread over all ranges. A source takes whole epochs, then rows in key order until its budget
is reached; the row at the cut is taken in part.

Behaviour at the edges: null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows
that repeat share a key, and which of them is cut makes no difference to the result; rows without an identifier get their key from the
text; texts of any length count whole; empty tables give no rows; a source without words has target 0. Working columns carry a prefix, columns beside doc_id, source
and text are ignored by mix() and passed on by repeated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseworks.llm.workspace import WORD_CLASS, settle, word_count

#: Hexadecimal digits of the key that name its range: 16 to this power ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """A row for each source (source, _size): its target, by weight, at most ceiling times its size, the excess dealt again.

    Targets are min(ceiling * size, weight * level) for the one level at which they add up. Sorted by size over weight, the
    capped sources come first, so the level follows from running sums.
    """
    order, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = W.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    after = filled.rowsBetween(0, W.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("_size").over(everything)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    return (
        sizes.withColumn("_weight", pick.cast("double"))
        .withColumn("_cap", F.lit(float(ceiling)) * F.col("_size"))
        .withColumn("_level", level)
        .withColumn("_open", F.when(F.col("_weight") * F.col("_level") <= F.col("_cap"), F.col("_level")))
        .withColumn("_water", F.max("_open").over(everything))
        .withColumn("target", F.when(F.col("_water").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.col("_water"))))
        .select("source", F.col("_size").alias("source_size"), "target")
    )


def placed_rows(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix", size: Column | None = None
) -> DataFrame:
    """For each row of docs (doc_id, source, text): doc_id, source, text_key (hash of the text), size, source_size, target and taken (words taken, repeats counted)."""
    size = word_count(F.col("text")) if size is None else size.cast("long")
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    key = F.md5(F.concat_ws(":", F.lit(seed), named))
    rows = settle(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), size.alias("size"), key.alias("_key")).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)), "mix-rows")
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    ahead = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_sum").alias("_size")), weights, share, ceiling)
    t, r = targets.alias("t"), ranges.alias("r")
    starts = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select(F.col("r.source").alias("_source"), F.col("r._range").alias("_part"), "_before", "source_size", "target")
    inside = W.partitionBy("source", "_range").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size", "text_key").rowsBetween(W.unboundedPreceding, -1)
    ordered = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ordered.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_part")))
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5D) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_inside")))
    taken = epochs * F.col("size") + part
    return joined.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """For each row of docs (doc_id, source, text): doc_id, size, source_size, target and taken (words taken, repeats counted)."""
    return placed_rows(docs, weights, share, ceiling, seed, size).select("doc_id", "size", "source_size", "target", "taken")


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as the mix takes it whole, and its first words where it is cut.

    mixed has a row (doc_id, source, text_key, size, taken) for each document. A document with taken 0 goes, unless it has no words. Rows alike
    in identifier, source and text are one document that the mix takes as often as all of them together.
    """
    names = {"doc_id": "__cw_id", "source": "__cw_source", "text_key": "__cw_key"}
    take = mixed.groupBy(*(F.col(k).alias(v) for k, v in names.items())).agg(F.max("size").alias("__cw_size"), F.sum("taken").alias("__cw_taken"), F.count(F.lit(1)).alias("__cw_rows"))
    size, taken = F.col("__cw_size"), F.col("__cw_taken")
    whole = F.when(size > 0, F.expr("__cw_taken div __cw_size")).otherwise(F.col("__cw_rows"))
    cut = F.when(size > 0, taken % size).otherwise(F.lit(0))
    times = (whole + F.when(cut > 0, 1).otherwise(0)).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD_CLASS}+)"), F.lit(1)), F.lit(1), cut.cast("int")), " ")
    same = F.col("doc_id").eqNullSafe(F.col("__cw_id")) & F.col("source").eqNullSafe(F.col("__cw_source")) & (F.xxhash64("text") == F.col("__cw_key"))
    joined = docs.join(take.hint("merge"), same).filter(times > 0)
    once = joined.filter("__cw_rows > 1").dropDuplicates([*names.values()])
    joined = joined.filter("__cw_rows = 1").unionByName(once) if not take.filter("__cw_rows > 1").isEmpty() else joined
    copies = joined.withColumn("__cw_copy", F.explode(F.sequence(F.lit(1), times)))
    text = F.when((F.col("__cw_copy") > whole) & (cut > 0), head).otherwise(F.col("text"))
    return copies.withColumn("text", text).select(*docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight,
             CAST(2 AS DOUBLE) * source_size AS cap FROM s),
l AS (SELECT *, (15e-1 * sum(source_size) OVER ()
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
m AS (SELECT *, max(CASE WHEN weight * lev <= cap THEN lev END) OVER () AS water FROM l),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
             CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 5e-1) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
