"""Language identification as inference of a mixture: expectation-maximisation over n-gram likelihoods.

Training counts hashed letter trigrams for each language. A document's trigrams are then taken as drawn from a mixture of the
languages; its proportions are estimated by expectation-maximisation, and languages leave the set as long as that costs less
likelihood than the penalty for keeping them. The language with the largest proportion is predicted, the proportion is the score.

Behaviour at the edges: null text, or text without a letter, gives `und` with score 0, as does every text when nothing could be
learned; ties go to the language first by code point; rows without identifier count as training rows; rows that repeat count and are returned
as often as they occur; texts of any length count whole; columns beside doc_id, text and lang are ignored, whatever their names; empty tables
give no rows. The model has BINS numbers for each language: more than LANGUAGES of them are an error, so that what is sent to all tasks stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caseworks.llm.workspace import ship

BINS = 1 << 15
LANGUAGES = 1000
SMOOTHING = 0.5
#: Trigrams of a text overlap, so that each language is charged three times the usual half logarithm of their number.
PENALTY = 1.5
#: Estimation goes on until no proportion moves by more than STILL; so many rounds end it in any case.
STILL, ROUNDS = 1e-6, 5000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    table[points] = points
    return table


def trigrams(text: str | None) -> np.ndarray:
    """Bins of the letter trigrams; a run of other characters counts as one space."""
    points = _letters()[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")]
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + points[2:]
    return ((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(49)).astype(np.int64)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point and the probability of each bin in each language, from (text, lang) rows."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(trigrams(text.as_py()), minlength=BINS)
                sums[lang] = sums[lang] + found if lang in sums else found
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bin", "n"])

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, bin int, n long")
    table = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()  # at most BINS rows a language
    langs = sorted(set(table["lang"].to_pylist()), key=lambda s: [*map(ord, s)])
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the model is sent to every task and holds at most {LANGUAGES}")
    counts = np.zeros((BINS, len(langs)))
    counts[table["bin"].to_numpy(), [langs.index(x) for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    return langs, (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BINS)


def mixture(bins: np.ndarray, likelihood: np.ndarray) -> np.ndarray:
    """Proportion of each language (column of likelihood) in the text; languages outside the chosen set have 0."""
    counts = np.bincount(bins, minlength=len(likelihood))
    at = np.flatnonzero(counts)
    q, c, n = likelihood[at], counts[at].astype(float), float(len(bins))
    share = np.zeros(q.shape[1])
    single = c @ np.log(q)
    best = int(np.argmax(single))
    # The likelihood is concave: if moving towards no other language raises it, the best single language is the whole answer.
    if np.all(c @ (q / q[:, best : best + 1]) <= n * (1 + 1e-9)):
        share[best] = 1.0
        return share

    def estimate(chosen: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        p, of = start / start.sum(), q[:, chosen]
        for _ in range(ROUNDS):
            total = of @ p
            new = p * (of.T @ (c / total)) / n
            done = np.abs(new - p).max() < STILL
            p = new
            if done:
                break
        return p, float(c @ np.log(of @ p))

    chosen = np.arange(q.shape[1])
    p, fit = estimate(chosen, np.full(len(chosen), 1.0))
    while len(chosen) > 1:
        drop = int(np.argmin(p))
        rest = np.delete(chosen, drop)
        fewer, less = estimate(rest, np.delete(p, drop) + 1e-6) if len(rest) > 1 else (np.ones(1), float(single[rest[0]]))
        if fit - less > PENALTY * np.log(n):
            break
        chosen, p, fit = rest, fewer, less
    share[chosen] = p
    return share


def identify(docs: DataFrame, langs: list[str], likelihood: np.ndarray) -> DataFrame:
    """doc_id, held_out as given, lang_pred, score and the mixture (languages with their proportions) of each whole text."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(likelihood)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, mixtures = [], [], []
            for text in batch.column(2):
                bins = trigrams(text.as_py())
                share = mixture(bins, model.value) if len(bins) and langs else np.zeros(1)
                top = int(np.argmax(share))
                known = share[top] > 0
                names.append(langs[top] if known else "und")
                scores.append(min(1.0, float(share[top])))
                mixtures.append(" ".join(f"{langs[k]}={share[k]:.3f}" for k in np.argsort(-share, kind="stable") if share[k] > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores, pa.float64()), pa.array(mixtures)], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, mixture string")


def language_id(docs: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """Learn from rows with a language whose identifier's crc32 leaves another remainder than part, and predict for all rows."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), parts, part).alias("held_out"))
    langs, likelihood = learn(marked.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"))
    return identify(marked, langs, likelihood)
