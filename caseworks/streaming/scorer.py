"""Rules applied to cases as they arrive: a join of a stream of cases with the few rules of its geographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caseworks.operators.rules import meets


def flag_stream(cases: DataFrame, rules: DataFrame, columns: list[str], geo: str = "state") -> DataFrame:
    """Each arriving case with flagged: whether it meets its geography's rule; cases without a rule are not flagged. Stateless."""
    rule = rules.select(F.col("geography_value").alias(geo), "conditions")
    joined = cases.join(rule, geo, "left")
    return joined.withColumn("flagged", F.coalesce(meets(F.col("conditions"), columns), F.lit(False))).drop("conditions")
