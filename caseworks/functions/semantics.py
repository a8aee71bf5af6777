"""Value semantics that the operators rely on, where they differ from Spark's defaults.

Membership is never null; maxima and minima against a constant keep null; division by zero is null; integers are truncated and overflow to null;
sequences are start + i * step, clamped to the end, never accumulated.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def in_set(col: Column, values: Iterable[str]) -> Column:
    """Membership; null is not a member."""
    return F.coalesce(col.isin(*values), F.lit(False))


def at_least(col: Column, floor: float) -> Column:
    """max(floor, col); null stays null."""
    return F.when(col.isNull(), None).otherwise(F.greatest(F.lit(float(floor)), col))


def at_most(col: Column, ceiling: float) -> Column:
    """min(ceiling, col); null stays null."""
    return F.when(col.isNull(), None).otherwise(F.least(F.lit(float(ceiling)), col))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient; null where the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def truncated(col: Column) -> Column:
    """Integer part; null where it overflows."""
    return col.try_cast("int")


def trimmed(col: Column) -> Column:
    """Without spaces, tabs and line ends around."""
    return F.regexp_replace(col, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def overwrite(col: Column, where: Column, value) -> Column:
    """value where the condition holds; a null condition leaves the column as it is."""
    return F.when(where, value).otherwise(col)


def any_of(cols: Sequence[Column], values: Iterable[str]) -> Column:
    """Whether any column is a member of the values; never null."""
    values = list(values)
    return reduce(lambda a, b: a | b, (in_set(c, values) for c in cols))


def count_where(conditions: Iterable[Column]) -> Column:
    """Number of conditions that hold; null counts as no."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(False)).cast("int") for c in conditions))


def lowest(cols: Sequence[Column]) -> Column:
    """Smallest value that is not null; plus infinity if there is none."""
    return F.coalesce(F.array_min(F.array(*cols)).cast("double"), F.lit(math.inf))


def highest(cols: Sequence[Column]) -> Column:
    """Largest value that is not null; minus infinity if there is none."""
    return F.coalesce(F.array_max(F.array(*cols)).cast("double"), F.lit(-math.inf))


def steps(start: float, stop: float, by: float) -> list[float]:
    """start, start + by, ...; the last is at most stop."""
    return [min(float(stop), start + i * by) for i in range(int(math.floor((stop - start) / by + 1e-10)) + 1)]


def steps_table(spark: SparkSession, start: float, stop: float, by: float, name: str) -> DataFrame:
    n = int(math.floor((stop - start) / by + 1e-10))
    return spark.range(n + 1).select(F.least(F.lit(float(stop)), F.lit(float(start)) + F.col("id") * F.lit(float(by))).alias(name))


def exact_sum(col: Column) -> Column:
    """Sum in decimals, 0 over nothing, as a double: the same whatever the order of rows."""
    return F.coalesce(F.sum(col.cast("decimal(28,6)")), F.lit(0).cast("decimal(28,6)")).cast("double")
