"""Shared working folders, shipping of this package to executors, and column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local one serves a local master, and a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(os.path.join(tempfile.gettempdir(), "caseworks-shared"))
        named = context._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps do not depend on earlier executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete working tables that no result still reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that settle() wrote and no result still reads."""
    for table in tables:
        files = table.inputFiles()
        if files:
            discard(table.sparkSession, files[0].rpartition("/")[0])


_shipped: set[str] = set()

#: Rows and bytes of a batch that goes to a Python worker, for sessions that do not set them: Spark's own 10,000 rows are many whole texts, and
#: the executor and the worker hold several batches each.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for the Python workers to import; bound the batches they get."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="caseworks-zip-")
    archive = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD_CLASS}+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bitmaps of BITS bits each, so many, mark hit keys: 4 MB, whatever the number of rows.
BITS, BITMAPS = 32768, 1024


def maybe_in(rows: DataFrame, key: Column, hits: Column, of: DataFrame) -> DataFrame:
    """rows with __cw_hit: true wherever key may be among the hits, false only where it surely isn't.

    Keys and hits are longs. The marks fit in a broadcast of fixed size, so that rows without one need not move for a join.
    """
    slots = BITS * BITMAPS
    place = F.pmod(hits, F.lit(slots))
    bitmaps = of.select(place.alias("__cw_p")).groupBy((F.col("__cw_p") / BITS).cast("int").alias("__cw_map")).agg(F.bitmap_construct_agg(F.col("__cw_p") % BITS).alias("__cw_bits"))
    here = rows.withColumn("__cw_place", F.pmod(key, F.lit(slots))).withColumn("__cw_of", (F.col("__cw_place") / BITS).cast("int"))
    byte = F.conv(F.hex(F.substring("__cw_bits", F.lit(1) + ((F.col("__cw_place") % BITS) / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, (F.col("__cw_place") % 8).cast("int"))
    joined = here.join(F.broadcast(bitmaps), F.col("__cw_of") == F.col("__cw_map"), "left")
    return joined.withColumn("__cw_hit", F.coalesce(bit == 1, F.lit(False))).drop("__cw_place", "__cw_of", "__cw_map", "__cw_bits")


#: A key is hot with more than HOT_ROWS rows and more than one in HOT_KEYS of all rows: at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 256, 1000


def join_hot(rows: DataFrame, of: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows with what `of` has for their key; `of` holds each key once, with __cw_n, the number of rows that have it, of total in all.

    Rows of hot keys stay where they are and meet a broadcast of at most HOT_KEYS rows; the others are joined by shuffle, whatever size Spark
    expects. Rows without a key, or with one that `of` lacks, go from an inner join and have nulls in a left one.
    """
    more = [name for name in of.columns if name not in (key, "__cw_n")]
    hot = of.filter(F.col("__cw_n") > max(HOT_ROWS, total / HOT_KEYS)).select(F.col(key).alias("__cw_hot"), F.struct(*more).alias("__cw_of"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__cw_hot"), "left")
    stay = marked.filter("__cw_hot IS NOT NULL").select(*rows.columns, *(F.col("__cw_of")[name].alias(name) for name in more))
    move = marked.filter("__cw_hot IS NULL").select(*rows.columns).join(of.drop("__cw_n").hint("merge"), key, how).select(*rows.columns, *more)
    return stay.unionByName(move)


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys (compared null-safe) are a row of gone; only rows that may be gone are moved."""
    spread = F.xxhash64(*keys)
    marked = maybe_in(docs, spread, F.xxhash64(*gone.columns), gone)
    same = [k.eqNullSafe(gone[c]) for k, c in zip(keys, gone.columns, strict=True)]
    match = same[0]
    for more in same[1:]:
        match = match & more
    doubtful = marked.filter("__cw_hit").join(gone.hint("merge"), match, "left_anti")
    return marked.filter("NOT __cw_hit").unionByName(doubtful).drop("__cw_hit")
