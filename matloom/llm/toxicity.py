"""A counterfactual-regularised toxicity classifier.

Features are a text's words and word beginnings, present or not. From a bounded sample of labelled rows,
Spark counts in how many texts of either label each stands, and the VOCABULARY most telling
ones are kept, with the identity terms. Logistic regression is fitted on these with a penalty:
in each sampled text that names a group, the term is swapped with each other term of its
list, and the squared change of the score is added to the loss, so weights can't rest on the mention
of a group. Tasks swap and sum the changes' products; the driver gets the sums.

Null counts as empty; an empty text scores the intercept. Words are runs of ASCII letters, digits and
non-ASCII characters, A-Z lower-cased; a text of any length is scored whole. Repeated rows
score alike and count once in the fit; null labels don't count; without labels of both kinds the score is their mean, or 0 without any. Extra
columns stay, but for `score`, which is the operator's own.
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
from .quality import sampled

#: Bound of the labelled rows that are fitted on.
SAMPLE = 20_000
VOCABULARY, LEAST_TEXTS, LEAST_Z = 512, 4, 4.0
RIDGE, FAIRNESS = 0.5, 4.0
#: Bytes of the word beginnings that count as features beside the word.
STEMS = (4, 5)
#: Terms that may stand for each other without a text becoming more or less toxic: a parameter, extend it by language.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("disabled", "elderly", "young"),
    ("femmes", "hommes"),
    ("musulmans", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


def _of_word(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All features of single words: (feature, word number)."""
    data, offsets = V.spelled(pa.array(words, pa.string()))
    f, row = _features(data, offsets)
    return f, row


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each word occurrence, and its row."""
    data = V.LOWER[data]
    starts, ends, firsts = V.spans(data, offsets, V.ALPHANUMERIC)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    found, rows = [V.hashed(data, starts, ends)], [row]
    for n in STEMS:
        long = ends - starts > n
        found.append(V.mixed(V.hashed(data, starts[long], starts[long] + n) + np.uint64(n)))
        rows.append(row[long])
    return np.concatenate(found), np.concatenate(rows)


def _distinct(features: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((features, rows))
    f, r = features[order], rows[order]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
    return f[new], r[new]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts of label 0, of label 1), summed over each slice."""
    for batch in batches:
        y = batch.column(0).to_numpy() > 0.5
        for a, b, data, offsets in V.rows_in(batch, "text", 8 * V.SLICE_BYTES):
            f, r = _distinct(*_features(data, offsets))
            keys, at = np.unique(f, return_inverse=True)
            n1 = np.bincount(at, weights=y[a:b][r], minlength=len(keys)).astype(np.int64)
            n = np.bincount(at, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n - n1), pa.array(n1)], ["feature", "n0", "n1"])


@dataclass
class Vocabulary:
    keys: np.ndarray  # sorted

    def __post_init__(self) -> None:
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def present(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows by vocabulary, 0 or 1."""
        out = np.zeros((len(offsets) - 1, len(self.keys)), np.float32)
        if not len(self.keys):
            return out
        f, r = _features(data, offsets)
        some = self.filter[(f >> np.uint64(48)).astype(np.int64)]
        f, r = f[some], r[some]
        at = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        known = self.keys[at] == f
        out[r[known], at[known]] = 1
        return out


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.vocabulary.present(data, offsets) @ self.weights + self.intercept)))


def swapped(words: list[bytes], identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> Iterator[tuple[bytes, float]]:
    """For each term of a list that the lower-cased words hold and each other term of the list: the words with the two
    exchanged, and the weight of this swap among the term's."""
    held = set(words)
    for terms in identities:
        raw = [t.encode() for t in terms]
        for i, t in enumerate(raw):
            for j, u in enumerate(raw):
                if t in held and i != j and not (u in held and j < i):  # a text with both is one swap
                    yield b" ".join(u if w == t else t if w == u else w for w in words), 1 / (len(raw) - 1)


def changes(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> np.ndarray:
    """The weighted changes of the feature rows by all swaps in all texts."""
    data = V.LOWER[data]
    starts, ends, firsts = V.spans(data, offsets, V.ALPHANUMERIC)
    terms = np.unique(_hashes([t for x in identities for t in x])) if identities else np.zeros(0, np.uint64)
    named = np.flatnonzero(np.isin(V.hashed(data, starts, ends), terms))
    out = [np.zeros((0, len(vocabulary.keys)), np.float32)]
    for r in np.unique(np.searchsorted(firsts, named, "right") - 1).tolist():
        words = [data[s:e].tobytes() for s, e in zip(starts[firsts[r] : firsts[r + 1]], ends[firsts[r] : firsts[r + 1]], strict=True)]
        own = vocabulary.present(data[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))
        for text, weight in swapped(words, identities):
            other = vocabulary.present(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            out.append((other - own) * np.float32(np.sqrt(weight)))
    return np.concatenate(out)


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = V.spelled(pa.array(words, pa.string()))
    return V.hashed(data, offsets[:-1], offsets[1:])


def fitted(x: np.ndarray, y: np.ndarray, changed: np.ndarray, ridge: float = RIDGE, fairness: float = FAIRNESS, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for the penalised logistic loss: ridge on weights, fairness on squared score changes.

    changed: the sum of the changes' products, features by features.
    """
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    penalty = ridge * np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-6
    penalty[:-1, :-1] += fairness * changed
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x1 @ w)))
        gradient = x1.T @ (p - y) + penalty @ w
        hessian = (x1 * (p * (1 - p) + 1e-9)[:, None].astype(x.dtype)).T @ x1 + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, limit: int = SAMPLE, identities: tuple[tuple[str, ...], ...] = IDENTITIES, fairness: float = FAIRNESS) -> Model:
    """Fitted on documents (doc_id, text) with labels (doc_id, y), y 0 or 1."""
    picked = documents.select("doc_id", "text").join(F.broadcast(sampled(labels, limit)), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text"))
    # Exact copies of a text would make its words look telling.
    rows = written(picked.groupBy(F.xxhash64("text").alias("h"), "y").agg(F.first("text").alias("text")).select("y", "text"), "labelled")
    n1, n = rows.agg(F.sum("y"), F.count("*")).first()
    if not n or n1 in (0.0, float(n)):
        share = (n1 / n) if n else 0.0
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    n0 = n - n1
    p = (F.col("n0") + F.col("n1")) / n
    z = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    counts = rows.mapInArrow(_counted, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    telling = counts.filter(F.col("n0") + F.col("n1") >= LEAST_TEXTS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(VOCABULARY)
    keys = np.array([r["feature"] for r in telling.collect()], np.int64).view(np.uint64)
    named = [_of_word(list(t))[0] for t in identities]
    vocabulary = Vocabulary(np.unique(np.concatenate([keys, *named])))

    def rowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vocabulary.present(data, offsets) for _, _, data, offsets in V.rows_in(batch, "text")]
            x = np.concatenate(found) if found else np.zeros((0, len(vocabulary.keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.flatnonzero(r).tolist() for r in x], pa.list_(pa.int32()))], ["y", "at"])

    sample = rows.mapInArrow(rowed, "y double, at array<int>").toPandas()
    x = np.zeros((len(sample), len(vocabulary.keys)), np.float32)
    for i, at in enumerate(sample["at"]):
        x[i, list(at)] = 1
    size = len(vocabulary.keys)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's part of the changes' products."""
        total = np.zeros((size, size))
        for batch in batches:
            for _, _, data, offsets in V.rows_in(batch, "text"):
                c = changes(data, offsets, vocabulary, identities).astype(np.float64)
                total += c.T @ c
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "v"])

    sums = rows.select("text").mapInArrow(summed, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    changed = np.zeros(size * size)
    changed[sums["at"].to_numpy(np.int64)] = sums["v"].to_numpy(float)
    weights, intercept = fitted(x, sample["y"].to_numpy(float), changed.reshape(size, size), fairness=fairness)
    return Model(vocabulary, weights, intercept)


def scored(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents without the text, with score, the probability of label 1."""
    rest = documents.drop("score")
    keep = [c for c in rest.columns if c != text]
    schema = T.StructType([*rest.select(*keep).schema.fields]).add("score", "double")
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.scores(data, offsets) for _, _, data, offsets in V.rows_in(batch, text)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(np.concatenate(found) if found else np.zeros(0))], schema.names)

    return rest.mapInArrow(run, schema)
