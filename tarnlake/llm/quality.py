"""Operator 9: a quality classifier by Bradley-Terry pairwise ranking.

Each document gets features of its whole text. From labelled rows that are not held out, preference pairs
(a good document over a poor one) are drawn; the chance that one wins is the logistic of the difference of
their scores, and the weights minimise the logistic loss on feature differences. The score's cut is the
quantile of the training scores that parts the labels best; scores are shifted so that it falls on 0.7.

The model is fitted on ``SAMPLE`` labelled rows at most (those with the smallest hash of the id) and
``PAIRS`` pairs; every document is featured and scored.

Nulls: a null text is empty, and empty texts have all features 0 and are scored; labels with a null id or
quality are not used, nor are held-out ones; a null id is not held out. Repeated rows are each scored; of an
id with several labels each counts. Without labels of both kinds every score is the cut (0.7, kept). Empty
tables give no rows. Other columns are carried and clash with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, flat, small_batches, table, window_hashes, word_hashes, word_spans

SAMPLE, PAIRS, CUT, RIDGE, SEED = 20_000, 60_000, 0.7, 1e-3, 11

_MARKS = [b"!", b"|", b"#", b"%&*$", b".", b",", b"\n", b"0123456789", b"()[]{}<>=_/\\", b"\"':;?-+@~^`"]
_N_FEATURES = 11 + len(_MARKS)


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text; all 0 for a text without words."""
    data, offsets = flat(texts)
    out = np.zeros((len(texts), _N_FEATURES))
    if not len(data):
        return out
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = np.diff(first)
    full = np.flatnonzero(words > 0)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    count = np.maximum(words, 1).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    def of_words(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(values)))
        return (total[first[1:]] - total[first[:-1]]) / count

    upper = (data >= 65) & (data <= 90)
    cols = [share(upper), share(data >= 0x80)]
    for marks in _MARKS:
        kind = np.zeros(256, bool)
        kind[list(marks)] = True
        cols.append(share(kind[data]))
    lengths = (ends - starts).astype(float)
    mean = of_words(lengths)
    cols += [
        np.minimum(mean, 40) / 10,
        np.log1p(words) / 10,
        of_words(upper[starts]),
        of_words(~(((data[ends - 1] | 0x20) >= 97) & ((data[ends - 1] | 0x20) <= 122) | (data[ends - 1] >= 0x80))),
    ]
    hashes = word_hashes(LOWER[data], starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][full]] = False
    cols.append(of_words(again))
    cols = [*cols, *np.zeros((4, len(texts)))]
    out[:] = np.stack(cols, 1)
    runs = window_hashes(hashes, 3)
    for k in full.tolist():
        a, b = int(first[k]), int(first[k + 1])
        _, n = np.unique(hashes[a:b], return_counts=True)
        out[k, -4:-2] = len(n) / (b - a), n.max() / (b - a)
        if b - a >= 3:
            out[k, -2] = 1 - len(np.unique(runs[a : b - 2])) / (b - a - 2)
        out[k, -1] = out[k, -2] * min(1.0, (b - a) / 50)
    out[words == 0] = 0
    return out


def _features(texts: pa.Array) -> pa.Array:
    rows = features(texts)
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, _N_FEATURES, dtype=np.int32), pa.array(rows.ravel()))


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Weights of standardised features, and the cut among the scores."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED):
        self.mean, self.scale, self.weights, self.cut = np.zeros(_N_FEATURES), np.ones(_N_FEATURES), np.zeros(_N_FEATURES), 0.0
        winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(winners) or not len(losers):
            return
        self.mean, scale = x.mean(0), x.std(0)
        self.scale = np.where(scale > 1e-12, scale, 1.0)
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        n = min(pairs, 20 * len(x))
        diff = z[rng.choice(winners, n)] - z[rng.choice(losers, n)]
        w = self.weights
        for _ in range(50):  # Newton steps on the mean logistic loss with a small ridge
            p = 1 / (1 + np.exp(np.clip(diff @ w, -35, 35)))
            slope = RIDGE * w - diff.T @ p / n
            curve = (diff * (p * (1 - p))[:, None]).T @ diff / n + RIDGE * np.eye(len(w))
            step = np.linalg.solve(curve, slope)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w
        raw = z @ w
        at = np.quantile(raw, np.linspace(0, 1, 401))
        cuts = (at[1:] + at[:-1]) / 2
        right = [((raw >= c) == good).mean() for c in cuts]
        best = np.flatnonzero(np.isclose(right, max(right)))
        self.cut = float(cuts[best[len(best) // 2]])

    def score(self, values: Column) -> Column:
        w = self.weights / self.scale
        shift = float(-(self.mean @ w) - self.cut + np.log(CUT / (1 - CUT)))
        terms = [values[k] * F.lit(float(c)) for k, c in enumerate(w)]
        raw = F.lit(shift)
        for t in terms:
            raw = raw + t
        return 1 / (1 + F.exp(-F.least(F.greatest(raw, F.lit(-35.0)), F.lit(35.0))))


def _x(text: Column) -> Column:
    return F.arrow_udf(_features, "array<double>")(text)


def fitted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE) -> Model:
    """The model; ``sample`` labels at most are broadcast, and as many rows at most come to the driver."""
    known = labels.select(F.col("doc_id"), F.col(label_col).alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    known = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.select("doc_id", "label", _x(F.col("text")).alias("x"))
    rows = rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "label", "x").limit(sample).collect()
    x = np.array([r.x for r in rows], float).reshape(-1, _N_FEATURES)
    return Model(x, np.array([r.label == 1 for r in rows], bool))


def scored(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document; with ``carry`` also ``row``, all its columns."""
    small_batches(docs.sparkSession)
    model = fitted(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _x(F.col(text_col)).alias("x"), *([F.struct("*").alias("row")] if carry else []))
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("x")).alias("score"), *(["row"] if carry else []))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The documents that the classifier does not reject."""
    return scored(docs, labels, carry=True, **names).where("predicted = 1").select("row.*")


def op9_quality(spark, sf_dir):
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")
