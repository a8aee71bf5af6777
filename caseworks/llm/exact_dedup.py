"""Exact deduplication as a streaming aggregation over disk-backed keyed state.

A ledger of the rows (digest, identifier, row number, and where the content lies: file and row index in it) is streamed into a state store
that never expires: for each digest it keeps the smallest identifier, the number of that row in the ledger, by which its content is found, and
a count. Where a digest is hit more than once, the full normalised texts are compared, those of earlier batches as the ledger locates them;
texts that share a digest but differ are then told apart by their bytes. Only DataFrame functions run on the way.

Behaviour at the edges: null text counts as empty; among rows with the same identifier and equal text one stays; rows
without identifier stay behind those with one; texts of any length are compared whole; empty tables give no rows; columns beside doc_id and
text are ignored, and passed on by without_duplicates(). Hot digests, of which there can be
at most HOT_PARTS, are known by a broadcast of that bounded list and dealt over SALTS parts wherever rows meet by digest.
"""

from __future__ import annotations

from contextlib import contextmanager, suppress

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caseworks.llm.workspace import SPACE_CLASS, discard, drop, fresh_path, maybe_in, settle, without

#: A digest is hot if it has more than one in so many rows: at most so many are.
HOT_PARTS = 1000
SALTS = 64
#: State on local disk and, by change logs, in the shared folder; without disk set aside in advance, for there are many small stores, and with
#: one bound for the memory of all stores of an executor. That bound leaves out what each open store needs for itself; executors look for stores
#: whose stream has ended, and close them, as often as maintenance comes.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _conf(spark: SparkSession, settings: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def keyed_state(ledger: DataFrame, path: str) -> DataFrame:
    """Stream what is new in the ledger's folder into the state; returns digest, keep_id, keep_at and n from the state store.

    The state's folder lies beside the ledger's, so a later call over a ledger that has grown continues where the last one ended.
    """
    spark, state = ledger.sparkSession, f"{path}-state"
    stream = spark.readStream.schema(ledger.schema).parquet(path)
    keyed = stream.groupBy("digest").agg(F.min("doc_id"), F.min_by("at", "doc_id"), F.max(-F.col("at")), F.count(F.lit(1)))
    with _conf(spark, STORE):
        query = keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    stored = spark.read.format("statestore").load(state)
    # The aggregates' buffers in order; min_by has two. Another layout must not pass unseen.
    names, own = ["keep_id", "_best", "_by", "_first", "n"], ledger.schema["doc_id"].dataType.simpleString()
    fields = stored.schema["value"].dataType.fields
    if [f.dataType.simpleString() for f in fields] != [own, "bigint", own, "bigint", "bigint"]:
        raise TypeError(f"the state store keeps {[f.simpleString() for f in fields]}")
    value = [F.col("value")[field.name].alias(name) for field, name in zip(fields, names, strict=True)]
    return stored.select(F.col("key")["digest"].alias("digest"), *value).select("digest", "keep_id", F.coalesce("_best", -F.col("_first")).alias("keep_at"), "n")


def _located(docs: DataFrame) -> DataFrame:
    """doc_id, text, and where the row's content lies: file and row index of a table in files, else nulls."""
    try:
        return docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("file_row"))
    except AnalysisException:  # rows that come from no file
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("file_row"))


def content(spark: SparkSession, ledger: DataFrame) -> DataFrame:
    """doc_id, digest and text of rows of the ledger, read again from where they lie."""
    files = [r["file"] for r in ledger.select("file").distinct().collect()]  # names of files, as a listing of the input has them
    if None in files:
        raise ValueError("an earlier batch was not read from files, so that its texts cannot be compared")
    if not files:
        return ledger.select("doc_id", "digest", F.lit(None).cast("string").alias("text"))
    there = spark.read.parquet(*files).select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("file_row"))
    return ledger.select("doc_id", "digest", "file", "file_row").join(there, ["file", "file_row"]).select("doc_id", "digest", "text")


def exact_duplicates(docs: DataFrame, digest=sha256, path: str | None = None) -> DataFrame:
    """For each row: doc_id, keep_id (identifier of the row that stays), group_size, kept and text_sha256 of the normalised text.

    path names a ledger that lasts: the rows of docs are then a further batch, and are held against all batches before.
    """
    spark = docs.sparkSession
    lasting, path = path is not None, path or fresh_path(spark, "ledger")
    text = _located(docs).withColumn("_norm", normalised(F.col("text")))
    hashed = text.select("doc_id", digest(F.col("_norm")).alias("digest"), F.sha2("_norm", 256).alias("text_sha256") if digest is not sha256 else F.lit(None).cast("string").alias("text_sha256"), "file", "file_row", "_norm")
    begin = 0
    if lasting:
        with suppress(AnalysisException):  # no batch yet
            begin = spark.read.parquet(path).agg(F.coalesce(F.max("at") + 1, F.lit(0))).first()[0]
    hashed.drop("_norm").withColumn("at", F.monotonically_increasing_id() + F.lit(begin)).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    ledger = every.filter(F.col("at") >= begin)
    total = every.count()
    state = keyed_state(every, path)
    hot = F.broadcast(state.filter(F.col("n") * HOT_PARTS > total).select(F.col("digest").alias("_hot")))

    def dealt(rows: DataFrame, by: Column) -> DataFrame:
        """Rows with _salt: spread over SALTS where the digest is hot, 0 elsewhere."""
        return rows.join(hot, F.col("digest") == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(by, F.lit(SALTS))).cast("int")).drop("_hot")

    def copied(states: DataFrame) -> DataFrame:
        """States with a copy for each salt that their rows can have."""
        salts = F.when(F.col("n") * HOT_PARTS > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        return states.withColumn("_salt", F.explode(salts))

    # Full bytes of every hit: one row for each digest and text; a digest with two texts is a collision.
    several = copied(state.filter("n > 1")).select("digest", "_salt").hint("merge")
    compared = hashed.select("doc_id", "digest", "_norm")
    maybe = maybe_in(compared, F.xxhash64("digest"), F.xxhash64("digest"), state.filter("n > 1")).filter("__cw_hit").drop("__cw_hit")  # other texts stay where they are
    if begin:  # texts of earlier batches that this one hits
        again = settle(every.filter(F.col("at") < begin).join(ledger.select("digest").distinct(), "digest", "left_semi"), "hit-before")
        maybe = maybe.unionByName(content(spark, again).select("doc_id", "digest", normalised(F.col("text")).alias("_norm")))
    hits = dealt(maybe, F.xxhash64("doc_id")).join(several, ["digest", "_salt"])
    texts = hits.groupBy("digest", "_salt", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    texts = texts.groupBy("digest", "_norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    apart = settle(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("digest"), "collisions")

    joined = dealt(ledger, F.col("at")).join(copied(state).hint("merge"), ["digest", "_salt"])
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.col("text_sha256")
    out = joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("at") == F.col("keep_at")).alias("kept"), sha.alias("text_sha256"), "digest")
    if not apart.isEmpty():  # texts of these digests go by their bytes; of rows alike in identifier and text one may stay
        mine = compared.join(apart, "digest").groupBy("doc_id", "digest", "_norm").agg(F.count(F.lit(1)).alias("_rows"))
        own = mine.join(texts.join(apart, "digest"), ["digest", "_norm"]).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_row") == 1)
        own = own.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.sha2("_norm", 256).alias("text_sha256"), "digest")
        out = out.join(apart, "digest", "left_anti").select(own.columns).unionByName(own)
    out = settle(out.drop("digest"), "duplicates")
    if not lasting:
        discard(spark, path, f"{path}-state")
    drop(apart)
    return out


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_duplicates drops, all columns kept; of rows alike in identifier and text one stays."""
    marks = exact_duplicates(docs)
    twin = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    keys = [F.col("doc_id").alias("__cw_id"), F.col("text_sha256").alias("__cw_sha")]
    gone = marks.filter(~F.col("kept") & ~twin).select(*keys).distinct()
    sha = F.sha2(normalised(F.col("text")), 256)
    rest = without(docs.withColumn("__cw_own", sha), [F.col("doc_id"), F.col("__cw_own")], gone)
    twins = marks.filter(~F.col("kept") & twin)
    if not twins.isEmpty():  # rows alike in identifier and text
        rest = rest.dropDuplicates(["doc_id", "__cw_own"])
    return rest.drop("__cw_own")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
