"""CSV tables: read under a declared schema, written with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Types are declared, never inferred; a row that does not fit is an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of files with a header, without row names; one_file is for small results that go to people."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True)
