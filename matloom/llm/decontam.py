"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z) and cut to words of ASCII letters, digits and non-ASCII
characters. The patterns are the windows of WINDOW consecutive words of each
benchmark item; an item of fewer words is one window. For all windows of one length m, the shift
table says for each block of BLOCK words how far the search may move on: to the nearest place of the
block in any window, or m - BLOCK + 1 if none has it. Where the shift is zero, the block, as the
windows' suffix, selects a bucket of windows; these are compared word by word. The search
runs on many stretches of text at once, each a lane of a NumPy vector.

The benchmark's windows are sent to the workers in blocks of about PATTERN_WORDS words. Where there are several, each block has a
pass of its own over the texts, whose hits are written before the next block is sent; so driver and workers hold one block at
a time (a single item is never split). At the end the hits of all blocks are joined by a 128-bit hash of the text.

Null and empty texts have no words, no hits and aren't contaminated; null and wordless items
have no window; repeated item texts count as items each; all items without an id count as one, which the digest leaves out. Repeated rows are
marked each for itself. An empty benchmark hits nothing. Extra columns stay; those that marked() adds replace any of the same name, clean() adds none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import vectext as V

WINDOW = 13
BLOCK = 2
LANE = 1024
#: Largest set of patterns that is sent to the workers at once, in words of benchmark text (some 600 bytes each at the most).
PATTERN_WORDS = 400_000


def worded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and the count of words before each row."""
    data = V.LOWER[data]
    return data, *V.spans(data, offsets, V.ALPHANUMERIC)


class Windows:
    """All windows of one length m, as word hashes and spelled words, with the Wu-Manber tables."""

    def __init__(self, m: int, rows: np.ndarray, texts: list[bytes], items: list[list]):
        self.m, self.rows, self.texts, self.items = m, rows, texts, items
        self.block = min(BLOCK, m)
        span = m - self.block + 1
        keys, shifts = [], []
        for j in range(span):
            keys.append(_blocks(rows[:, j : j + self.block]))
            shifts.append(np.full(len(rows), span - 1 - j))
        key, shift = np.concatenate(keys), np.concatenate(shifts)
        order = np.lexsort((shift, key))
        key, shift = key[order], shift[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        self.keys, self.shifts, self.most = key[first], shift[first], span
        # Most blocks of a text are in no window: a bit table tells so in one step.
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        suffix = _blocks(rows[:, m - self.block :])
        self.by_suffix = np.argsort(suffix, kind="stable")
        self.suffixes = suffix[self.by_suffix]

    def shift_of(self, blocks: np.ndarray) -> np.ndarray:
        out = np.full(len(blocks), self.most)
        some = np.flatnonzero(self.filter[(blocks >> np.uint64(44)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.keys, blocks[some]), len(self.keys) - 1)
            known = self.keys[at] == blocks[some]
            out[some[known]] = self.shifts[at[known]]
        return out

    def search(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of each occurrence whose word hashes agree."""
        m, b = self.m, self.block
        sizes = np.diff(firsts)
        # Lanes overlap by m - 1 words: each has the starts [from, from + LANE) of one row.
        lanes = np.maximum(0, -(-(sizes - m + 1) // LANE))
        row = np.repeat(np.arange(len(sizes)), lanes)
        number = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = firsts[row] + number * LANE
        end = np.minimum(at + LANE, firsts[row + 1] - m + 1)
        found_at, found = [], []
        while len(at):
            last = at + m - b
            blocks = _blocks(np.stack([words[last + j] for j in range(b)], 1))
            shift = self.shift_of(blocks)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                lo, hi = np.searchsorted(self.suffixes, blocks[hit], "left"), np.searchsorted(self.suffixes, blocks[hit], "right")
                n = hi - lo
                place = np.repeat(at[hit], n)
                which = self.by_suffix[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                for j in range(m):
                    same = self.rows[which, j] == words[place + j]
                    place, which = place[same], which[same]
                found_at.append(place)
                found.append(which)
            at = at + np.maximum(shift, 1)
            live = at < end
            at, end = at[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


def _blocks(rows: np.ndarray) -> np.ndarray:
    h = rows[:, 0].copy()
    for j in range(1, rows.shape[1]):
        h = V.mixed(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return V.mixed(h)


def compiled(items: list[tuple], window: int = WINDOW) -> list[Windows]:
    """Windows by length, from (item id, text)."""
    column = pa.array([t for _, t in items], pa.string())
    data, starts, ends, firsts = worded(*V.spelled(column))
    hashes = V.hashed(data, starts, ends)
    by_length: dict[int, dict[bytes, tuple[np.ndarray, list]]] = {}
    for i, (item, _) in enumerate(items):
        a, b = firsts[i], firsts[i + 1]
        m = min(window, b - a)
        for j in range(a, b - m + 1) if m else ():
            text = b" ".join(data[s:e].tobytes() for s, e in zip(starts[j : j + m], ends[j : j + m], strict=True))
            own = by_length.setdefault(int(m), {}).setdefault(text, (hashes[j : j + m], []))[1]
            if item not in own:
                own.append(item)
    return [Windows(m, np.stack([r for r, _ in found.values()]), list(found), [x for _, x in found.values()]) for m, found in sorted(by_length.items())]


def occurrences(windows: list[Windows], data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, int, list]]:
    """(first words, length, item ids) of windows that occur; each occurrence is confirmed on the words' bytes."""
    hashes = V.hashed(data, starts, ends)
    for w in windows:
        places, which = w.search(hashes, firsts)
        sure: dict[int, list[int]] = {}
        for p, k in zip(places.tolist(), which.tolist(), strict=True):
            if b" ".join(data[s:e].tobytes() for s, e in zip(starts[p : p + w.m], ends[p : p + w.m], strict=True)) == w.texts[k]:
                sure.setdefault(k, []).append(p)
        for k, at in sure.items():
            yield np.array(at), w.m, w.items[k]


def _pattern_blocks(benchmark: DataFrame, limit: int) -> tuple[int, Callable[[int], list[tuple]]]:
    """The number of blocks of about limit words of six bytes, and what gets a block's items; they are dealt by hash of id and text."""
    items = benchmark.select("item_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    n = max(1, -(-size // (limit * 6)))

    def block(k: int) -> list[tuple]:
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        return [(r["item_id"], r["text"]) for r in part.toLocalIterator()]

    return n, block


OWN = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def marked(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, pattern_words: int = PATTERN_WORDS, share: int = 20) -> DataFrame:
    """documents with n_words, n_hit, n_items, items_sha256, contaminated and hit_spans.

    hit_spans: (from, to) word ranges, the end exclusive, of all words in occurring windows.
    contaminated: some word is hit, and share * n_hit >= n_words. items_sha256 is over the occurring
    items' ids, sorted as strings and joined by commas.
    """
    out = documents.drop(*[c for c in documents.columns if c.lower() in OWN and c != text])
    names = out.columns
    n, block = _pattern_blocks(benchmark, pattern_words)
    if n == 1:
        out = _passed(out, compiled(block(0), window), text)
    else:
        out = _passed(out, [], text).drop("hit_spans", "_items")
        hits = None
        for k in range(n):
            windows = compiled(block(k), window)
            found = _passed(documents.select(*_key(F.col(text)), F.col(text).alias("text")), windows, "text").filter(F.size("_items") > 0)
            # Equal texts have equal hits.
            found = written(found.select("_k0", "_k1", "hit_spans", "_items").dropDuplicates(["_k0", "_k1"]), "hits")
            hits = found if hits is None else hits.unionByName(found)
        merged = hits.groupBy("_k0", "_k1").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
        merged = merged.select("_k0", "_k1", _united(F.array_sort("_spans")).alias("hit_spans"), "_items")
        none = [F.coalesce(c, F.array().cast(merged.schema[c].dataType)).alias(c) for c in ("hit_spans", "_items")]
        out = out.select("*", *_key(F.col(text))).join(merged, ["_k0", "_k1"], "left").select(*names, "n_words", *none)
    ids = F.array_sort(F.col("_items"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    out = out.withColumn("n_hit", hit).withColumns({"n_items": F.size("_items").cast("long"), "items_sha256": F.sha2(F.array_join(ids, ",").cast("binary"), 256), "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))})
    return out.select(*names, *OWN)


def _key(text: Column) -> list[Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("_k0"), F.xxhash64(F.lit(1), t).alias("_k1")]


def _united(spans: Column) -> Column:
    """Sorted spans, with those that overlap or touch made one."""
    reach = lambda i: F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda y: y["to"])), F.lit(-1))
    first = F.filter(F.transform(spans, lambda x, i: F.struct(x["from"].alias("from"), i.alias("i"))), lambda x: x["from"] > reach(x["i"]))
    ends = F.transform(first, lambda x, k: F.array_max(F.transform(F.slice(spans, x["i"] + 1, F.coalesce(F.get(first, k + 1)["i"], F.size(spans)) - x["i"]), lambda y: y["to"])))
    return F.transform(F.arrays_zip(first.alias("f"), ends.alias("e")), lambda x: F.struct(x["f"]["from"].alias("from"), x["e"].alias("to")))


def _passed(documents: DataFrame, windows: list[Windows], text: str) -> DataFrame:
    base = documents.schema.fields
    schema = T.StructType([*base]).add("n_words", "long").add("hit_spans", T.ArrayType(T.StructType().add("from", "long").add("to", "long"))).add("_items", T.ArrayType(T.StringType()))
    shipped = documents.sparkSession.sparkContext.broadcast(windows)
    span_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            n_words = np.zeros(batch.num_rows, np.int64)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            ids: list[set] = [set() for _ in range(batch.num_rows)]
            for a, b, data, offsets in V.rows_in(batch, text):
                data, starts, ends, firsts = worded(data, offsets)
                n_words[a:b] = np.diff(firsts)
                found = list(occurrences(shipped.value, data, starts, ends, firsts))
                if not found:
                    continue
                hit = np.zeros(len(starts) + 1, bool)
                rows = []
                for places, m, items in found:
                    for j in range(m):
                        hit[places + j] = True
                    rows.append((np.searchsorted(firsts, places, "right") - 1, items))
                for r, items in rows:
                    for i in np.unique(r):
                        ids[a + i].update(None if x is None else str(x) for x in items)
                for i in np.unique(np.concatenate([r for r, _ in rows])):
                    own = hit[firsts[i] : firsts[i + 1]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                    spans[a + i] = [{"from": int(s), "to": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
            kept = [batch.column(names.index(f.name)) for f in base]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), pa.array(spans, span_type), pa.array([sorted(x, key=lambda v: (v is None, v or "")) for x in ids], pa.list_(pa.string()))], schema.names)

    return documents.mapInArrow(run, schema)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options: int) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    names = [f"c{k}" for k in range(len(documents.columns))]
    found = marked(documents.toDF(*names), benchmark, names[documents.columns.index(text)], **options)
    return found.filter(~F.col("contaminated")).select(*names).toDF(*documents.columns)
