"""Quality classifier: cumulative-link (ordinal) regression on graded ratings over hashed text features.

Grades are ordered. One weight vector over hashed words, word shapes and repetition marks is shared by all grades, and ordered
thresholds cut its score: P(grade >= k) = logistic(w.x - t_k). The expected grade ranks documents; the tail probability of the highest
grade selects them.

The model is fitted on a bounded sample of labelled rows, SAMPLE at most, those with the smallest hash of the identifier; all rows are
scored. Behaviour at the edges: null text counts as empty and has only the mark of an empty text; without labels every document gets the
middle of the grades and is kept; repeated labels of a document count each; rows that repeat are scored each; equal hashes of identifiers go by
identifier and grade; texts of any length are read whole; empty tables give no rows; columns beside doc_id and text are ignored, and passed on by select().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from caseworks.llm.memory import Memo, for_task, held
from caseworks.llm.workspace import ship

#: Most labelled rows that the model is fitted on.
SAMPLE = 12_000
BINS = 1 << 18
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.05, 2e-5
GRADES = 3

_UPPER, _LOWER, _DIGIT = regex.compile(r"\p{Lu}+"), regex.compile(r"[\p{Ll}\p{Lo}]+"), regex.compile(r"\p{N}+")


def _bin(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\t{value}") % BINS


def _word_bins(word: str) -> tuple[int, int]:
    """Bins of a word: of the word itself without marks around it, and of its shape."""
    shape = _LOWER.sub("x", _DIGIT.sub("9", _UPPER.sub("X", word)))[:12]
    return _bin("word", word.lower().strip(".,;:!?\"'()[]#*$%&|<>")), _bin("shape", shape)


def _known() -> Memo:
    return held("quality", lambda: Memo(_word_bins))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins and values: 1 for each distinct word, five times the root of its share for each shape, 1 for marks of repetition."""
    counts = Counter((text or "").split())
    total = sum(counts.values())
    if not total:
        return np.array([_bin("mark", "empty")], np.int32), np.ones(1, np.float32)
    pairs = [*map(_known().__getitem__, counts)]
    shapes: Counter = Counter()
    for (_, shape), n in zip(pairs, counts.values(), strict=True):
        shapes[shape] += n
    bins = {word for word, _ in pairs}
    marks = [_bin("top", str(int(10 * max(counts.values()) / total))), _bin("distinct", str(int(10 * len(counts) / total))), _bin("length", str(total.bit_length()))]
    values = [*np.ones(len(bins)), *(5 * np.sqrt(np.fromiter(shapes.values(), float) / total)), *np.ones(len(marks))]
    return np.array([*bins, *shapes, *marks], np.int32), np.array(values, np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds from (grade, bins, values) by AdaGrad; rows that repeat count each."""
    rng = np.random.default_rng(3)
    seen = Counter(int(b) for _, bins, _ in rows for b in bins)
    common = np.zeros(BINS, bool)
    common[[b for b, n in seen.items() if n >= 4]] = True  # bins of fewer rows only tell these rows apart
    rows = [(g, b[common[b]], v[common[b]]) for g, b, v in rows]
    weight, power = np.zeros(BINS, np.float64), np.full(BINS, 1e-4)
    share = np.cumsum(np.bincount([g for g, _, _ in rows], minlength=grades)[::-1])[::-1][1:] / len(rows)
    cut = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    cut_power = np.full(grades - 1, 1e-4)
    mean, half = np.zeros(BINS), EPOCHS // 2
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[start : start + BATCH]]
            size = [len(b) for _, b, _ in part]
            bins, values = np.concatenate([b for _, b, _ in part]), np.concatenate([v for _, _, v in part])
            owner = np.repeat(np.arange(len(part)), size)
            score = np.bincount(owner, weight[bins] * values, minlength=len(part))
            above = _sigmoid(score[:, None] - np.sort(cut))
            target = np.array([g for g, _, _ in part])
            # Likelihood of a grade is the difference of neighbouring tails; with tails a_k its slope in the score is 1 - a_low - a_high.
            tails = np.concatenate([np.ones((len(part), 1)), above, np.zeros((len(part), 1))], axis=1)
            low, high = tails[np.arange(len(part)), target], tails[np.arange(len(part)), target + 1]
            slope = 1 - low - high
            chance = np.maximum(low - high, 1e-6)
            of_cut = np.zeros(grades - 1)
            for k in range(grades - 1):
                edge = above[:, k] * (1 - above[:, k]) / chance
                of_cut[k] = np.sum(edge[target == k]) - np.sum(edge[target == k + 1])
            gradient = np.bincount(bins, slope[owner] * values, minlength=0)
            at = np.flatnonzero(gradient)
            step = gradient[at] / len(part) - DECAY * weight[at]
            power[at] += step**2
            weight[at] += RATE * step / np.sqrt(power[at])
            step = of_cut / len(part)
            cut_power += step**2
            cut = np.sort(cut + RATE * step / np.sqrt(cut_power))
        if epoch >= half:
            mean += weight / (EPOCHS - half)
    return mean.astype(np.float32), cut


def graded(labels: DataFrame) -> DataFrame:
    """Ratings as grades: 0 for poor text, 1 for good but toxic text, 2 for good text; rows without a quality or toxic rating are left out."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") >= 1, 1).otherwise(2)
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", grade.cast("int").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Fit on the sample, in one task; None without labelled documents."""
    ship(docs.sparkSession)
    chosen = grades.select(F.col("doc_id").alias("_id"), "grade").orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=["doc_id", "grade", "bins", "vals"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(i, g, np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for batch in batches for i, g, b, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if held:
            held.sort(key=lambda r: (str(r[0]), r[1], r[2].tobytes()))
            weight, cut = fit([r[1:] for r in held])
            yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()]), pa.array([cut.tobytes()])], names=["weight", "cut"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sparse = rows.select("doc_id", "grade", "text").mapInArrow(for_task(extract), f"doc_id {kind}, grade int, bins binary, vals binary")
    model = sparse.repartition(1).mapInArrow(for_task(learn), "weight binary, cut binary").collect()
    return (np.frombuffer(model[0][0], np.float32), np.frombuffer(model[0][1])) if model else None


def above_each(model: tuple[np.ndarray, np.ndarray], text: str | None) -> np.ndarray:
    """Probability of each grade but the lowest, or a higher one."""
    bins, values = features(text)
    return _sigmoid(float(model[0][bins] @ values) - model[1])


def tail_of(model: tuple[np.ndarray, np.ndarray], text: str | None) -> float:
    return float(above_each(model, text)[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the highest grade) and kept (tail at least `least`) of each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = [], []
            for text in batch.column(1):
                above = np.full(GRADES - 1, 0.5) if shared.value is None else above_each(shared.value, text.as_py())
                expected.append(float(above.sum()))
                tail.append(float(above[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array([t >= least for t in tail])], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(for_task(run), f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    return score(docs, train(docs, graded(labels)), least)


def select(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, least: float = 0.5) -> DataFrame:
    """The rows that score() keeps, with all their columns; nothing is shuffled."""
    ship(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value is None or tail_of(shared.value, t.as_py()) >= least for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(for_task(run), docs.schema)
