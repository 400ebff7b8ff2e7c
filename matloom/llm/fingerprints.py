"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text falls into paragraphs: words up to the end of a line, cut on at content-chosen words, one in
SPARSE. Among the first OPENING words, sentences end paragraphs too and one word in DENSE is chosen, so that
short texts have several. White space doesn't count. Each is hashed with its number among equal ones, so a
repeated paragraph counts as often as it stands. The fingerprint is a table of CELLS cells
(count, XOR of digests, XOR of checks); each digest goes into three of them. Subtracting two tables
leaves the digests on which the texts differ, and peeling cells that hold one digest recovers
these. If that fails, larger tables are built, from the size that the least digests of both make likely
and each twice the last, until it succeeds.

likeness(A, B) = 2 * shared / (count A + count B), with shared from the recovered
difference: 1 for equal texts and for two without a word, 0 if nothing is shared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V

CELLS = 24
OPENING, DENSE, SPARSE = 48, 4, 16
#: Least digests of either text that are compared to guess a table's size.
SAMPLE = 16
_HASHES = 3
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def digests(texts: list[str]) -> list[np.ndarray]:
    """For each text, one 64-bit digest a paragraph; equal ones differ by their number."""
    data, offsets = V.spelled(pa.array(texts, pa.string()))
    return [x for a, b in V.sliced(offsets, 4 * V.SLICE_BYTES) for x in _digests(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, firsts = V.spans(data, offsets, V.UNSPACED)
    n = len(starts)
    if not n:
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    words = V.hashed(data, starts, ends)
    place = np.arange(n) - np.repeat(firsts[:-1], np.diff(firsts))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    opening = place < OPENING
    cut = (opening & _ENDS[data[ends - 1]]) | (words % np.where(opening, DENSE, SPARSE).astype(np.uint64) == 0)
    cut[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    cut[firsts[1:][np.diff(firsts) > 0] - 1] = True
    at = np.flatnonzero(cut)
    begin = np.concatenate([[0], at[:-1] + 1])
    power, inverse = V.powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=sums[1:])
    keys = V.mixed((sums[at + 1] - sums[begin]) * inverse[begin])
    row = np.searchsorted(firsts, begin, "right") - 1
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    number = np.arange(len(k)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    again = number > 0
    k[again] = V.mixed(k[again] + number[again].astype(np.uint64))
    return np.split(k, np.searchsorted(r, np.arange(1, len(offsets) - 1)))


class Sketches:
    """Tables of cells cells for each of n documents."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells, self.width = n, cells, cells // _HASHES
        self.count = np.zeros(n * cells, np.int64)
        self.keys = np.zeros(n * cells, np.uint64)
        self.checks = np.zeros(n * cells, np.uint64)

    @staticmethod
    def _check(keys: np.ndarray) -> np.ndarray:
        return V.mixed(keys ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)

    def _places(self, keys: np.ndarray, of: np.ndarray) -> Iterator[np.ndarray]:
        for j in range(_HASHES):
            h = V.mixed(keys + np.uint64((0xE7037ED1A0B428DB * (j + 1) + self.cells) & (1 << 64) - 1))
            yield of * self.cells + j * self.width + (h % np.uint64(self.width)).astype(np.int64)

    def add(self, keys: np.ndarray, of: np.ndarray, sign: np.ndarray | int = 1) -> None:
        checks = self._check(keys)
        for at in self._places(keys, of):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peeled(self) -> tuple[np.ndarray, np.ndarray]:
        """Takes out what can be recovered; the number of digests and whether that is all, by document."""
        sizes = np.zeros(self.n, np.int64)
        at = np.arange(len(self.count))
        while True:
            at = at[(np.abs(self.count[at]) == 1) & (self._check(self.keys[at]) == self.checks[at])]
            if not len(at):
                break
            of, keys = at // self.cells, self.keys[at]
            first = _first(of, keys)
            of, keys, sign = of[first], keys[first], self.count[at[first]]
            np.add.at(sizes, of, 1)
            self.add(keys, of, -sign)
            at = np.unique(np.concatenate(list(self._places(keys, of))))
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return sizes, ~left.reshape(self.n, self.cells).any(1)

    def spelled(self, k: int) -> str:
        own = slice(k * self.cells, (k + 1) * self.cells)
        return base64.b64encode(self.count[own].astype("<i4").tobytes() + self.keys[own].astype("<u8").tobytes() + self.checks[own].astype("<u4").tobytes()).decode()


def _first(of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The first place of each pair."""
    order = np.lexsort((keys, of))
    o, k = of[order], keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    return order[new]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.concatenate(lists) if len(lists) else np.zeros(0, np.uint64), np.repeat(np.arange(len(lists)), sizes)


def sketches(lists: list[np.ndarray], cells: int = CELLS) -> Sketches:
    out = Sketches(len(lists), cells)
    out.add(*_flat(lists))
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray], first: Sketches) -> np.ndarray:
    """How many digests each pair doesn't share. first: the subtracted tables of the usual size."""
    sizes, whole = first.peeled()
    left = np.flatnonzero(~whole)
    need = np.zeros(len(a), np.int64)
    for i in left.tolist():
        x, y = a[i][:SAMPLE], b[i][:SAMPLE]
        likely = (len(a[i]) + len(b[i])) * (1 - len(set(x.tolist()) & set(y.tolist())) / max(len(x), len(y), 1))
        need[i] = first.cells * 2 ** max(1, int(np.ceil(np.log2(max(1.0, 1.5 * likely / first.cells)))))
    for _ in range(16):
        if not len(left):
            return sizes
        for cells in np.unique(need[left]).tolist():
            now = left[need[left] == cells]
            table = Sketches(len(now), cells)
            table.add(*_flat([a[i] for i in now]))
            table.add(*_flat([b[i] for i in now]), -1)
            sizes[now], whole = table.peeled()
            need[now[whole]] = 0
            need[now[~whole]] *= 2
        left = left[need[left] > 0]
    for i in left:  # sixteen tables in a row failed: compare the digests themselves
        sizes[i] = len(np.setxor1d(a[i], b[i]))
    return sizes


def likeness(a: list[np.ndarray], b: list[np.ndarray], first: Sketches) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.int64)
    apart = differences(a, b, first)
    return np.where(total > 0, (total - apart) / np.maximum(total, 1), 1.0)


def fingerprints(documents: DataFrame, text: str = "text", cells: int = CELLS) -> DataFrame:
    """documents with fingerprint; null counts as empty, whose table is all zero. Rows of one batch are sketched at once."""
    rest = documents.drop("fingerprint")
    schema = T.StructType([*rest.schema.fields]).add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made: list[str] = []
            for at in range(0, len(texts), 256):
                own = sketches(digests([t or "" for t in texts[at : at + 256]]), cells)
                made += [own.spelled(k) for k in range(own.n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], schema.names)

    return rest.mapInArrow(run, schema)


_LOWEST = -(1 << 63)

RESULT = T.StructType().add("doc_id", "long").add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string").add("near_edited", "double").add("near_next", "double").add("n_paragraphs", "long")


def compared(documents: DataFrame, cells: int = CELLS) -> DataFrame:
    """Each document (doc_id, text) against its edited text and the next document by doc_id.

    The edited text has the last floor(n / 4) code points replaced by the first as many
    (or all) of the next document; after the last comes the first. Null texts are
    empty; a null doc_id stands before all others; equal ids are ordered by text; a
    single document is its own next.

    Documents are dealt by ranges of doc_id whose bounds are quantiles of the ids; only
    the first document of each range is sent twice, to its own range and the one before.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.coalesce("doc_id", F.lit(_LOWEST)))
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.select("k").approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    bounds = np.array([int(x) for x in cuts], np.int64)

    @F.pandas_udf("int")
    def range_of(k):  # noqa: ANN001, ANN202
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), "right").astype("int32"))

    # The first key of each range: as many rows as ranges, however many documents.
    firsts = {r["b"]: r["first"] for r in docs.select("k").select(range_of("k").alias("b"), "k").groupBy("b").agg(F.min("k").alias("first")).collect()}
    used = sorted(firsts)
    if not used:
        return spark.createDataFrame([], RESULT)
    keys, targets = np.array([firsts[b] for b in used], np.int64), np.array([used[i - 1] for i in range(len(used))], np.int32)

    @F.pandas_udf("int")
    def ahead_of(k):  # noqa: ANN001, ANN202
        """The range that the document also goes to, if it is the first of its own; else -1."""
        at = np.minimum(np.searchsorted(keys, k.to_numpy()), len(keys) - 1)
        return pd.Series(np.where(keys[at] == k.to_numpy(), targets[at], -1).astype("int32"))

    placed = docs.withColumn("b", range_of("k")).withColumn("ahead", ahead_of("k"))
    sent = placed.select("doc_id", "text", "k", F.explode(F.when(F.col("ahead") < 0, F.array(F.struct(F.col("b"), F.lit(0).alias("look")))).otherwise(F.array(F.struct(F.col("b"), F.lit(0).alias("look")), F.struct(F.col("ahead").alias("b"), F.lit(1).alias("look"))))).alias("p"))
    sent = sent.select("doc_id", "text", "k", "p.b", "p.look").repartition(F.col("b")).sortWithinPartitions("b", "look", "k", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # (range, look, doc_id, text), from the last that has no next yet
        for batch in batches:
            names = batch.schema.names
            for b, look, doc, text in zip(*[batch.column(names.index(c)).to_pylist() for c in ("b", "look", "doc_id", "text")], strict=True):
                if look and rows and rows[-1][0] == b and rows[-1][1]:
                    continue
                rows.append((b, look, doc, text))
                if len(rows) >= 512:
                    yield _told(rows, cells)
                    rows = rows[-1:]
        if len(rows) > 1:
            yield _told(rows, cells)

    return sent.mapInArrow(run, RESULT)


def _told(rows: list[tuple], cells: int) -> pa.RecordBatch:
    """Results of all rows but the last; each one's next is the row that follows in its range."""
    own = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
    edited = []
    for x, y in own:
        cut = len(x[3]) // 4
        edited.append(x[3][: len(x[3]) - cut] + y[3][:cut] if cut else x[3])
    every = digests([x[3] for x in rows])
    mine, theirs = ([every[k + step] for k, x in enumerate(rows[:-1]) if not x[1] and x[0] == rows[k + 1][0]] for step in (0, 1))
    changed = digests(edited)
    a, e, n = (sketches(lists, cells) for lists in (mine, changed, theirs))
    columns = [
        pa.array([x[2] for x, _ in own], pa.int64()),
        pa.array([len(x[3]) for x, _ in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([a.spelled(k) for k in range(a.n)], pa.string()),
        pa.array([e.spelled(k) for k in range(e.n)], pa.string()),
        pa.array(likeness(mine, changed, a.minus(e)), pa.float64()),
        pa.array(likeness(mine, theirs, a.minus(n)), pa.float64()),
        pa.array([len(x) for x in mine], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, RESULT.names)

