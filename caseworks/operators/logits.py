"""Cross-validation of a binary logit over many penalties: all folds and penalties share each pass over the cases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, functions as F

from caseworks.sources.working import settle

#: Scores of a model that are ranked in one place, about.
RANKED = 250_000
ROWS = 2048
PASSES = 100


def _tables(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Fold, numbers and labels of at most size rows of one fold, from batches of (fold, label, numbers)."""
    for batch in batches:
        fold, label, *numbers = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
        table = np.column_stack(numbers)
        for f in np.unique(fold):
            x, y = table[fold == f], label[fold == f]
            for at in range(0, len(y), size):
                yield int(f), x[at : at + size], y[at : at + size]


def _slopes(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, points: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each model's training rows, those not in the fold it leaves out: first and second derivatives of the loss at its point."""
    d = points.shape[1]
    upper = np.triu_indices(d)

    def run(batches):
        first, second = np.zeros((len(out), d)), np.zeros((len(out), len(upper[0])))
        for f, x, y in _tables(batches, ROWS):
            use = np.flatnonzero(out != f)
            x = np.column_stack([np.ones(len(y)), (x - mean) / scale])
            p = x @ points[use].T
            np.clip(p, -500, 500, out=p)
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            second[use] += (p - p * p).T @ (x[:, upper[0]] * x[:, upper[1]])
            p -= y[:, None]
            first[use] += p.T @ x
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.hstack([first, second]).tobytes()], pa.binary())})

    total = np.zeros((len(out), d + len(upper[0])))
    for (sums,) in rows.mapInArrow(run, "sums binary").collect():  # one a task, of fixed size: 22 KB for 100 models of five numbers
        total += np.frombuffer(sums).reshape(total.shape)
    full = np.zeros((len(out), d, d))
    full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = total[:, d:]
    return total[:, :d], full


def fold_logits(rows: DataFrame, penalties: np.ndarray, k: int) -> np.ndarray:
    """Intercept and coefficients, fold left out by penalty, from rows (fold, label, numbers): Newton steps until none moves a model by more than 1e-9.

    The penalty is that of Spark's logit: half of it times the squared coefficients of numbers standardised over the training rows.
    """
    names = rows.columns[2:]
    moments = rows.groupBy("fold").agg(F.count(F.lit(1)), *(F.avg(n) for n in names), *(F.var_pop(n) for n in names)).collect()
    d = len(names)
    fold, n = np.array([r[0] for r in moments]), np.array([r[1] for r in moments], float)
    means, spreads = np.array([r[2 : 2 + d] for r in moments], float), np.array([r[2 + d :] for r in moments], float)

    def pooled(keep):
        mean = n[keep] @ means[keep] / n[keep].sum()
        return n[keep].sum(), mean, n[keep] @ (spreads[keep] + (means[keep] - mean) ** 2) / max(n[keep].sum() - 1, 1)

    for f in range(k):
        if f not in fold or (fold == f).all():
            raise ValueError(f"fold {f} or the folds beside it are empty")
    _, mean, spread = pooled(fold >= 0)
    scale = np.where(spread > 0, np.sqrt(spread), 1.0)
    out = np.repeat(np.arange(k), len(penalties))
    trained = [pooled(fold != f) for f in range(k)]
    size = np.repeat([t[0] for t in trained], len(penalties))
    varies = np.repeat([np.r_[True, t[2] > 0] for t in trained], len(penalties), axis=0)
    ridge = np.repeat([np.r_[0.0, t[2] / scale**2] for t in trained], len(penalties), axis=0) * np.tile(penalties, k)[:, None]
    points = np.zeros((len(out), d + 1))
    step, fall, tried = np.zeros_like(points), np.full(len(out), np.inf), points.copy()
    active = np.arange(len(out))
    for _ in range(PASSES):
        first, second = _slopes(rows, mean, scale, tried[active], out[active])
        first = (first / size[active, None] + ridge[active] * tried[active]) * varies[active]
        second = second / size[active, None, None] * (varies[active, :, None] & varies[active, None, :])
        second[:, np.arange(d + 1), np.arange(d + 1)] += ridge[active]
        over = (first * step[active]).sum(axis=1) > 0.9 * fall[active]  # past the lowest point of the line, and steeper than it began
        going = []
        for i, a in enumerate(active):
            if over[i]:
                step[a] /= 2
                fall[a] /= 2
            else:
                points[a] = tried[a]
                step[a] = -np.linalg.lstsq(second[i], first[i], rcond=1e-14)[0]
                fall[a] = -(first[i] @ step[a])
            tried[a] = points[a] + step[a]
            if np.abs(step[a]).max() > 1e-9:
                going.append(a)
        active = np.array(going, int)
        if not len(active):
            break
    slopes = tried[:, 1:] / scale
    return np.column_stack([tried[:, 0] - slopes @ mean, slopes]).reshape(k, len(penalties), d + 1)


def _scores(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed number by number, so that equal rows have equal scores wherever they are."""
    z = np.full(len(x), b[0])
    for j in range(x.shape[1]):
        z += x[:, j] * b[j + 1]
    return z


def fold_areas(rows: DataFrame, models: np.ndarray, ranked: int = RANKED) -> np.ndarray:
    """Area under the ROC curve of each model on the fold it leaves out, exact, ties counted half; a row without a pair of labels is nan.

    Scores are dealt to ranges that are ranked apart. A few rows place the bounds of ranges; whatever these are, areas are the same.
    """
    k, many = models.shape[:2]
    largest = rows.groupBy("fold").count().agg(F.max("count")).first()[0]
    parts = -(-largest // ranked)
    bounds = {}
    if parts > 1:
        share = min(1.0, 4000 * k / (largest * k))
        few = np.array([tuple(r) for r in rows.select("fold", *rows.columns[2:]).sample(share, 1).collect()], float)
        for f in range(k):
            for m in range(many):
                z = _scores(few[:, 1:], models[f, m])
                bounds[f, m] = np.quantile(z, np.arange(1, parts) / parts) if len(z) else np.zeros(0)

    def send(batches):
        held: dict[int, list] = {}

        def flush(f):
            x, y = (np.concatenate(v) for v in zip(*held.pop(f), strict=True))
            for m in range(many):
                z = _scores(x, models[f, m])
                order = np.argsort(z)
                z, labels = z[order], y[order] > 0
                cuts = [0, *np.searchsorted(z, bounds.get((f, m), [])), len(z)]
                some = [(r, a, b) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_pydict({
                    "model": pa.array([f * many + m] * len(some), pa.int32()), "part": pa.array([r for r, _, _ in some], pa.int32()),
                    "scores": pa.array([z[a:b].tobytes() for _, a, b in some], pa.binary()), "labels": pa.array([labels[a:b].tobytes() for _, a, b in some], pa.binary()),
                })

        for f, x, y in _tables(batches, 1 << 20):
            held.setdefault(f, []).append((x, y))
            if sum(len(v) for _, v in held[f]) >= 50_000:
                yield from flush(f)
        for f in [*held]:
            yield from flush(f)

    def rank(table):
        z = np.frombuffer(b"".join(table["scores"].to_pylist()))
        y = np.frombuffer(b"".join(table["labels"].to_pylist()), bool)
        order = np.argsort(z)
        z, y = z[order], y[order]
        starts = np.flatnonzero(np.r_[True, z[1:] != z[:-1]])
        ones = np.add.reduceat(y, starts, dtype=np.int64)
        zeros = np.diff(np.r_[starts, len(z)]) - ones
        halves = int((ones * (2 * (np.cumsum(zeros) - zeros) + zeros)).sum())  # twice the pairs in order, exact in whole numbers
        return pa.table({"model": table["model"][:1], "part": table["part"][:1], "ones": pa.array([int(ones.sum())]), "zeros": pa.array([int(zeros.sum())]), "halves": pa.array([halves])})

    sent = rows.mapInArrow(send, "model int, part int, scores binary, labels binary")
    found: dict[int, list] = {}
    for r in sent.groupBy("model", "part").applyInArrow(rank, "model int, part int, ones long, zeros long, halves long").collect():
        found.setdefault(r["model"], []).append((r["part"], r["ones"], r["zeros"], r["halves"]))
    areas = np.full(k * many, np.nan)
    for model, ranges in found.items():
        halves = below = ones = 0
        for _, o, z, h in sorted(ranges):
            halves, below, ones = halves + h + 2 * o * below, below + z, ones + o
        if ones and below:
            areas[model] = halves / (2 * ones * below)
    return areas.reshape(k, many)


class LogitCrossValidator(CrossValidator):
    """Cross-validation of a plain logit over a grid of penalties, as its parent's, with exact areas under the ROC curve.

    The parent makes a fit and a sort for each penalty and fold, each with passes of its own; here all share some ten passes.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        estimator, points, k = self.getEstimator(), self.getEstimatorParamMaps(), self.getNumFolds()
        plain = isinstance(estimator, LogisticRegression) and all([p.name for p in point] == ["regParam"] for point in points)
        if not plain or estimator._paramMap or self.getEvaluator().getMetricName() != "areaUnderROC" or not self.getFoldCol():
            raise ValueError("a logit as it is by default, a grid of regParam, areaUnderROC and a fold column are needed")
        penalties = np.array([v for point in points for v in point.values()], float)
        width = len(dataset.select("features").first()[0])
        x = vector_to_array("features")
        rows = settle(dataset.select(F.col(self.getFoldCol()).cast("int").alias("fold"), F.col("label").cast("double").alias("label"), *(x[j].alias(f"x{j}") for j in range(width))), "logits")
        areas = fold_areas(rows, fold_logits(rows, penalties, k))
        best = estimator.fit(dataset, points[int(np.argmax(areas.mean(axis=0)))])
        return CrossValidatorModel(best, areas.mean(axis=0).tolist(), None, areas.std(axis=0).tolist())
