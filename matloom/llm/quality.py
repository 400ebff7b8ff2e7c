"""A quality classifier on document statistics.

Statistics of the whole text (shares of character classes, word lengths, repetition) are standardised and
mapped to random Fourier features, whose inner products approximate a Gaussian kernel. Tasks sum
the normal equations of their rows, Spark adds these up, and a ridge regression is solved from the sums.
Isotonic regression on labelled rows held back from the fit turns its output into probabilities.

The fit takes at most about SAMPLE labelled rows, by hash of the doc_id. Null counts as empty; empty
texts are scored from statistics that are all zero; repeated rows are scored alike. Equal outputs of different labels
have one probability. Null labels don't count; without
labels of both kinds, the score is the labels' mean, or 1 without any. Extra columns stay; of scored(), `score` is the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import vectext as V

#: Bound of the labelled rows that are fitted on.
SAMPLE = 20_000
FEATURES, WIDTH, RIDGE, SEED = 256, 4.0, 1.0, 7

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "$%&*#<>{}[]=_~^\\@+/`"]] = True
_PUNCTUATION = V.table_of((33, 47), (58, 64), (91, 96), (123, 126))
_CLASSES = {
    "letters": V.table_of((65, 90), (97, 122), (128, 255)),
    "upper": V.table_of((65, 90)),
    "digits": V.table_of((48, 57)),
    "punctuation": _PUNCTUATION,
    "symbols": _SYMBOL,
    "bangs": V.table_of((33, 33)),
    "bars": V.table_of((124, 124)),
    "spaces": V.table_of((9, 13), (32, 32)),
    "lines": V.table_of((10, 10)),
    "wide": V.table_of((128, 255)),
}
NAMES = [*_CLASSES, "size", "word_length", "word_spread", "shouted", "marked", "repeated", "lagged", "distinct", "top", "distinct_3", "entropy"]


def _per_row(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive firsts."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def _variety(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the count of distinct values and of the most frequent one."""
    n = len(firsts) - 1
    row = np.repeat(np.arange(n), np.diff(firsts))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate([at, [len(h)]]))
    distinct = np.bincount(r[at], minlength=n)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[at], runs)
    return distinct, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by NAMES."""
    n, size = len(offsets) - 1, np.diff(offsets)
    each = np.maximum(size, 1)
    out = np.zeros((n, len(NAMES)))
    counts = {k: _per_row(t[data], offsets) for k, t in _CLASSES.items()}
    for j, k in enumerate(_CLASSES):
        out[:, j] = counts[k] / (np.maximum(counts["letters"], 1) if k == "upper" else each)
    starts, ends, firsts = V.spans(data, offsets, V.UNSPACED)
    words, length = np.maximum(np.diff(firsts), 1), (ends - starts).astype(np.float64)
    hashes = V.hashed(data, starts, ends)
    mean = _per_row(length, firsts) / words
    spread = np.sqrt(np.maximum(_per_row(length**2, firsts) / words - mean**2, 0))
    upper = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
    letters = np.concatenate([[0], np.cumsum(_CLASSES["letters"][data])])
    marks = np.concatenate([[0], np.cumsum(_PUNCTUATION[data])])
    shouted = (letters[ends] - letters[starts] > 1) & (2 * (upper[ends] - upper[starts]) > letters[ends] - letters[starts])
    marked = marks[ends] - marks[starts] >= 2
    row = np.repeat(np.arange(n), np.diff(firsts))
    same = np.zeros((2, len(hashes)), bool)
    for lag in (1, 2):
        same[lag - 1, lag:] = (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
    distinct, most = _variety(hashes, firsts)
    triples, made = V.shingled(hashes, firsts, 3)
    distinct_3, _ = _variety(triples, np.concatenate([[0], np.cumsum(made)]))
    histogram = np.bincount(np.repeat(np.arange(n) * 256, size) + V.LOWER[data], minlength=n * 256).reshape(n, 256) / each[:, None]
    entropy = -(histogram * np.log2(histogram, where=histogram > 0, out=np.zeros_like(histogram))).sum(1)
    rest = [np.log1p(size) / 10, np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, _per_row(shouted, firsts) / words, _per_row(marked, firsts) / words, _per_row(same[0], firsts) / words, _per_row(same[1], firsts) / words, distinct / words**0.75, most / words, distinct_3 / np.maximum(made, 1), entropy / 8]
    for j, x in enumerate(rest):
        out[:, len(_CLASSES) + j] = x
    out[size == 0] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # rising raw outputs, and the probability at each
    levels: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        return features((x - self.mean) / self.scale)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.levels[0])
        raw = self.mapped(x) @ self.weights
        # The isotonic steps hold ties; a thousandth of the raw order breaks them.
        return 0.999 * np.interp(raw, self.steps, self.levels) + 0.001 * np.clip(raw, 0, 1)


def features(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of the given width, the standardised values and a constant."""
    random = np.random.default_rng(SEED)
    w, b = random.normal(0, 1 / WIDTH, (z.shape[1], FEATURES)), random.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip(z, -5, 5)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), z / 10, np.ones((len(z), 1))], 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising (x, mean y) with one point at either end of each pool. Equal x are one pool from the start."""
    at, of = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # sum, count, least x, largest x
    for a, b, n in zip(at.tolist(), np.bincount(of, weights=y).tolist(), np.bincount(of).tolist(), strict=True):
        pools.append([b, n, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    return np.array([v for p in pools for v in (p[2], p[3])]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, part, x) from (y, part, text)."""
    for batch in batches:
        x = np.concatenate([statistics(data, offsets) for _, _, data, offsets in V.rows_in(batch, "text")] or [np.zeros((0, len(NAMES)))])
        columns = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), columns], ["y", "part", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), len(NAMES))


def sampled(labels: DataFrame, limit: int) -> DataFrame:
    """About limit rows at most of labels (doc_id, y), by hash of the doc_id; a doc_id of several labels has their mean, rounded."""
    rows = labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))
    n = rows.count()
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, limit / max(n, 1))))


def train(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Fitted on documents (doc_id, text) with labels (doc_id, y), y 0 or 1."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    picked = documents.select("doc_id", "text").join(F.broadcast(sampled(labels, limit)), "doc_id").select("y", part.alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(picked.mapInArrow(_measured, "y double, part long, x array<double>"), "measured")
    none = np.zeros(0)
    told = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(len(NAMES))], *[F.stddev_pop(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(len(NAMES))]).first()
    if not told["n"] or told["y"] in (0.0, 1.0):
        return Model(none, none, none, none, np.array([told["y"] if told["n"] else 1.0]))
    mean, scale = (np.array([told[f"{k}{j}"] for j in range(len(NAMES))]) for k in "ms")
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), none, none, none)
    size = FEATURES + len(NAMES) + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's part of X'X and X'y, a row of the matrix each."""
        total = np.zeros((size, size + 1))
        for batch in batches:
            phi = model.mapped(_matrix(batch.column(1)))
            total += phi.T @ np.concatenate([phi, batch.column(0).to_numpy()[:, None]], 1)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "v"])

    sums = rows.filter("part > 0").select("y", "x").mapInArrow(summed, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(size * (size + 1))
    total[sums["at"].to_numpy()] = sums["v"].to_numpy()
    total = total.reshape(size, size + 1)
    model.weights = np.linalg.solve(total[:, :size] + RIDGE * np.eye(size), total[:, size])

    held = rows.filter("part = 0").select("y", "x").toPandas()
    if not len(held):
        held = rows.select("y", "x").toPandas()
    raw = model.mapped(np.stack(held["x"].to_list())) @ model.weights
    model.steps, model.levels = isotonic(raw, held["y"].to_numpy(float))
    return model


def scored(documents: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """documents with score, the probability of label 1."""
    rest = documents.drop("score")
    keep = [c for c in rest.columns if keep_text or c != text]
    schema = T.StructType([*rest.select(*keep).schema.fields]).add("score", "double")
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.scores(statistics(data, offsets)) for _, _, data, offsets in V.rows_in(batch, text)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(score)], schema.names)

    return rest.mapInArrow(run, schema)


def selected(documents: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The documents whose score is least or more, with their own columns."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.scores(statistics(data, offsets)) for _, _, data, offsets in V.rows_in(batch, text)]
            yield batch.filter(pa.array((np.concatenate(found) if found else np.zeros(0)) >= least))

    return documents.mapInArrow(run, documents.schema)
