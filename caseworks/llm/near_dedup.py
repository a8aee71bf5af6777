"""Near-duplicate groups by minhash: many universal hash minima, banding, signature check, full sets, connected components.

Documents with equal shingle sets are one class, and only the smallest identifier of a class goes on. Classes that share a band meet in a
bucket; there each is compared with one pivot, not with all others. Buckets connect classes into families, and the links found split a family
into components. Where there is more than one, the classes outside the largest are compared with all of their family, in blocks of bounded
volume that only emit links. No bucket is cut and no candidate dropped. Signatures rule pairs out only six standard deviations below the
threshold; every link is confirmed on the full shingle sets of the two texts.

Tables that grow with the rows are joined by hint: some bytes a row in parquet, they seem small enough to broadcast to Spark, which would build
them in the driver.

Every row has a number of its own, so that rows which share an identifier are compared and placed each by its own text.

Behaviour at the edges: null text, or text without words, has an empty set and links with nothing; a text with fewer words than a
shingle has its whole word sequence as one shingle; very long texts have all their shingles compared; rows that repeat are one class and
have the same component; rows without identifier form no links and are kept; empty tables give no rows; columns other than doc_id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from caseworks.llm.components import components
from caseworks.llm.memory import Memo, for_task, held
from caseworks.llm.workspace import discard, drop, fresh_path, join_hot, maybe_in, settle, ship, without

ROWS, BANDS = 6, 42
#: Shingles, and documents, of either side in a block of documents that are compared with each other in one place.
BLOCK, BLOCK_ROWS = 1_500_000, 200
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case. Bytes split at just the six characters that separate words."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    found = words(text)
    if len(found) < width:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(width)), strict=False))


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Signer:
    """Minima of universal hash functions over the shingles of a text."""

    def __init__(self, width: int, rows: int = ROWS, bands: int = BANDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.rows, self.bands = width, rows, bands
        self.a = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
        self.fold = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.tag = rng.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.word_hash = held("near dedup", lambda: Memo(xxhash.xxh3_64_intdigest))

    def hashes(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        found = words(text)
        n, width = len(found), min(self.width, len(found))
        if not n:
            return np.empty(0, np.uint64)
        each = np.fromiter(map(self.word_hash.__getitem__, found), np.uint64, n)
        total = np.full(n - width + 1, width, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + each[k : n - width + 1 + k]
        return np.unique(_scatter(total))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.rows * self.bands, np.uint64(1) << np.uint64(32))
        short = hashes >> np.uint64(32)
        for start in range(0, len(short), 256):
            np.minimum(least, ((short[start : start + 256, None] * self.a + self.b) >> np.uint64(32)).min(axis=0), out=least)
        return least

    def keys(self, least: np.ndarray) -> np.ndarray:
        return _scatter((least.reshape(self.bands, self.rows) * self.fold).sum(axis=1, dtype=np.uint64) + self.tag).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, class (digest of the set), bands (keys) and sketch (a byte of each minimum) of each row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for text in part.column(2):
                    hashes = signer.hashes(text.as_py())
                    least = signer.minima(hashes)
                    some = len(hashes) > 0
                    for column, value in zip(out, (len(hashes), hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if some else None, signer.keys(least) if some else None, least.astype(np.uint8).tobytes() if some else None), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "text_key", "n_shingles", "class", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(for_task(run), f"doc_id {kind}, text_key long, n_shingles long, class binary, bands array<long>, sketch binary")


def _beside(pairs: DataFrame, of: DataFrame, what: str) -> DataFrame:
    """Pairs (u, v) with what `of` (node, what) has for either node, as a and b."""
    side = lambda node, name: of.select(F.col("node").alias(node), F.col(what).alias(name))
    return pairs.join(side("u", "a").hint("merge"), "u").join(side("v", "b").hint("merge"), "v").select("u", "v", "a", "b")


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose signatures do not rule the threshold out."""
    n = ROWS * BANDS
    share = percent / 100
    least = share - 6 * math.sqrt(share * (1 - share) / n) if percent < 100 else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, n) for k in (2, 3))
                keep = pa.array((a == b).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    return _beside(pairs, sketches, "sketch").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, set()
        for batch in batches:
            keep = []
            for v, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if v != last:  # rows come sorted by v, a row's own number
                    last, mine = v, shingles(b.as_py(), width)
                other = shingles(a.as_py(), width)
                both = len(mine & other)
                keep.append(both > 0 and 100 * both >= percent * (len(mine) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return _beside(pairs, texts, "text").sortWithinPartitions("v").mapInArrow(for_task(run), "u long, v long")


def _across(loose: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between components of a family: for each document outside the largest component, one to each component that it reaches.

    The documents outside meet all of their family in blocks of bounded volume. No pair leaves a block unless it is a link.
    """
    ship(loose.sparkSession)
    spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asks = loose.filter("comp <> top_comp").withColumns({"row": spread("long"), "col": F.explode(F.sequence(F.lit(0), F.col("wide") - 1)), "asks": F.lit(True)})
    all_of = loose.withColumns({"col": spread("wide"), "row": F.explode(F.sequence(F.lit(0), F.col("long") - 1)), "asks": F.lit(False)})
    rows = asks.select("family", "row", "col", "asks", "node", "comp").unionByName(all_of.select("family", "row", "col", "asks", "node", "comp"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([signer.hashes(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "hashes"])

    def links(asking: list[tuple], held: list[tuple]) -> list[tuple]:
        sizes = np.array([len(h) for _, _, h in held])
        every = np.concatenate([h for _, _, h in held])
        owner = np.repeat(np.arange(len(held)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        comps, out = [c for _, c, _ in held], []
        for node, comp, mine in asking:
            low, high = np.searchsorted(every, mine), np.searchsorted(every, mine, "right")
            count = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(held))
            done = {comp}
            for k in np.flatnonzero(100 * both >= percent * (sizes + len(mine) - both)):
                if comps[k] not in done:
                    done.add(comps[k])
                    out.append((node, held[k][0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, held = None, [], []

        def told() -> pa.RecordBatch:
            found = links(asking, held) if asking and held else []
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for family, row, col, asks, node, comp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, row, col) != now:
                    if now is not None:
                        yield told()
                    now, asking, held = (family, row, col), [], []
                (asking if asks else held).append((node, comp, np.frombuffer(hashes, np.uint64)))
        if now is not None:
            yield told()

    hashed = texts.join(loose.select("node").hint("merge"), "node", "left_semi").mapInArrow(for_task(sets), "node long, hashes binary")
    dealt = rows.join(hashed.hint("merge"), "node").select("family", "row", "col", "asks", "node", "comp", "hashes").repartition("family", "row", "col").sortWithinPartitions("family", "row", "col")
    return dealt.mapInArrow(for_task(run), "u long, v long")


def placed_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """For each row: doc_id, text_key, n_shingles, component_id (smallest identifier reachable by links) and first (the one row that stands for its component)."""
    spark = docs.sparkSession
    signed = settle(signatures(docs, width).withColumn("node", F.monotonically_increasing_id()), "signatures")
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # A class is a set of shingles; the row with its smallest identifier stands for it.
    classes = settle(linkable.groupBy("class").agg(F.min(F.struct("doc_id", "node")).alias("least"), F.count(F.lit(1)).alias("n")).select("class", "least.node", "least", "n"), "classes")
    firsts = linkable.select("node", "bands").join(classes.select("node").hint("merge"), "node", "left_semi")
    keyed = firsts.select(F.col("node").alias("id"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("__cw_n")).filter("__cw_n > 1")
    members = join_hot(keyed, buckets, "key", BANDS * classes.count()).filter("id <> pivot")
    stars = settle(members.select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct(), "stars")
    wanted = settle(stars.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "wanted")
    # Sketches and texts of the documents in buckets, by marks of fixed size: the others stay where they are.
    node = F.xxhash64("node")
    marked = maybe_in(linkable.select("node", "doc_id", "text_key", "n_shingles", "sketch"), node, node, wanted).filter("__cw_hit").drop("__cw_hit")
    sketches = settle(marked.join(wanted.hint("merge"), "node", "left_semi"), "sketches")
    text = F.xxhash64("doc_id", "text_key")
    mine = maybe_in(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), text, text, sketches).filter("__cw_hit").drop("__cw_hit")
    found = mine.join(sketches.select("doc_id", "text_key", "node").hint("merge"), ["doc_id", "text_key"])
    texts = settle(found.groupBy("node").agg(F.first("text").alias("text")), "texts")  # rows that repeat give a node's text more than once

    path = fresh_path(spark, "confirmed")
    pairs_so_far = lambda: spark.read.schema("u long, v long").parquet(path)

    def compare(pairs: DataFrame) -> None:
        """Add the links among the pairs to those found."""
        ordered = pairs.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct()
        _confirmed(_alike(ordered, sketches, percent), texts, width, percent).write.mode("append").parquet(path)

    compare(stars)
    found = components(pairs_so_far())
    # What buckets hold beside the pivots' links: families, which buckets connect, with more than one component.
    family = components(stars)
    of = lambda links, name: links.select(F.col("u").alias("node"), F.col("v").alias(name))
    placed = sketches.select("node", F.col("n_shingles").alias("size")).join(of(family, "family").hint("merge"), "node", "left").join(of(found, "comp").hint("merge"), "node", "left")
    placed = settle(placed.select("node", "size", F.coalesce("family", "node").alias("family"), F.coalesce("comp", "node").alias("comp")), "placed")
    by_comp = placed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    split = by_comp.groupBy("family").agg(F.max(F.struct("n", "comp", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("comps")).filter("comps > 1 AND n > 2")
    blocks = lambda size, n: F.ceil(F.greatest(size / BLOCK, n / BLOCK_ROWS)).cast("int")
    split = split.select("family", F.col("top.comp").alias("top_comp"), blocks(F.col("size"), F.col("n")).alias("wide"), blocks(F.col("size") - F.col("top.size"), F.col("n") - F.col("top.n")).alias("long"))
    loose = settle(placed.join(split.hint("merge"), "family"), "loose")
    if not loose.isEmpty():
        compare(_across(loose, texts, width, percent))
        merged = components(pairs_so_far().unionByName(found))
        drop(found)
        found = merged

    # Smallest identifier, and the row that has it, of each component; a class that links with nothing is its own.
    linked = settle(of(found, "comp").unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()).join(classes.hint("merge"), "node"), "linked")
    least = linked.groupBy("comp").agg(F.min("least").alias("best"))
    of_class = classes.join(linked.join(least.hint("merge"), "comp").select("class", "best").hint("merge"), "class", "left").select("class", F.coalesce("best", "least").alias("best"), F.col("n").alias("__cw_n"))
    rows = join_hot(linkable.select("doc_id", "text_key", "n_shingles", "node", "class"), of_class, "class", linkable.count())
    out = rows.select("doc_id", "text_key", "n_shingles", F.col("best.doc_id").alias("component_id"), (F.col("node") == F.col("best.node")).alias("first"))
    # A row without words, or without identifier, stands alone.
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    out = settle(out.unionByName(alone), "near-duplicates")
    drop(signed, classes, stars, wanted, sketches, texts, placed, loose, linked, found, family)
    discard(spark, path)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (smallest identifier reachable by links) and kept (it is its own component_id)."""
    return placed_rows(docs, width, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, all columns kept; rows without words or identifier all stay."""
    marks = placed_rows(docs, width, percent).select(F.col("doc_id").alias("__cw_id"), F.col("text_key").alias("__cw_key"), "first")
    stays = marks.groupBy("__cw_id", "__cw_key").agg(F.max("first").alias("stays"), F.min("first").alias("all_stay"))
    keyed = docs.withColumn("__cw_text", F.xxhash64("text"))
    keys = [F.col("doc_id"), F.col("__cw_text")]
    rest = without(keyed, keys, stays.filter("NOT stays").select("__cw_id", "__cw_key"))
    twins = settle(stays.filter("stays AND NOT all_stay").select("__cw_id", "__cw_key"), "twins")
    if not twins.isEmpty():  # rows alike in identifier and text, of which one stays
        once = rest.join(twins.hint("merge"), keys[0].eqNullSafe(twins["__cw_id"]) & (keys[1] == twins["__cw_key"]), "left_semi").dropDuplicates(["doc_id", "__cw_text"])
        rest = without(rest, keys, twins).unionByName(once)
    return rest.drop("__cw_text")
