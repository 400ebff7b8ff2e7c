"""Language identification by prediction by partial matching.

Per language, a byte context tree of orders 0 to ORDER with escape probabilities (method
C: a context with n symbols of which d differ escapes with d / (n + d)) is counted
by Spark and then frozen. A text costs, in each language, the exact sum of its bytes' code
lengths; the shortest code names the language.

Under frozen statistics the code length of a byte after its context is a function of
ORDER + 1 bytes alone, so scoring looks up each position's window in
one table of all windows seen in training; an unseen window pays the escape
of its longest known context and goes on with the next shorter one.

Bytes are case-folded (A-Z); digits count as one symbol, white space and other ASCII
marks as a space, as they say nothing of the language. Null texts and
texts without a letter are `und` with score 0; repeated rows are scored each for itself; a text
of any length is coded whole. An empty training set gives `und` for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

ORDER = 3

_FOLD = V.LOWER.copy()
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[48:58] = 48
_LETTER = regex.compile(r"\p{L}")


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte, itself as the low byte with the order bytes before it; spaces stand before a row."""
    folded = _FOLD[data].astype(np.uint32)
    gram = folded.copy()
    row_at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, order + 1):
        back = np.empty_like(folded)
        back[:j], back[j:] = 32, folded[:-j] if j < len(folded) else folded[:0]
        back[row_at < j] = 32
        gram |= back << np.uint32(8 * j)
    return gram


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): what a task's texts add to each language's counts of full windows."""
    sums: dict[str, pd.Series] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, data, offsets in V.rows_in(batch, "text"):
            grams = _grams(data, offsets, ORDER)
            row_langs = np.repeat(langs[a:b], np.diff(offsets))
            for lang in set(langs[a:b]):
                key, n = np.unique(grams[row_langs == lang], return_counts=True)
                new = pd.Series(n, key)
                sums[lang] = new if lang not in sums else sums[lang].add(new, fill_value=0)
    for lang, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s.index.to_numpy().astype(np.int64)), pa.array(s.to_numpy().astype(np.int64))], ["lang", "gram", "n"])


@dataclass
class Model:
    """Frozen code lengths in bits. keys[o]: sorted windows of o + 1 bytes; cost[o]: for each and language;
    escape[o]: the bits that a language pays when the window's context of o bytes is known but the byte not."""

    langs: list[str]
    keys: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def fit(cls, frame: pd.DataFrame) -> Model:
        """From rows (lang, gram, n) of full windows."""
        langs = sorted(frame["lang"].unique())
        order_keys, order_cost, order_ctx, order_esc = [], [], [], []
        lower: np.ndarray | None = None
        for o in range(ORDER + 1):
            mask = (1 << (8 * (o + 1))) - 1
            gram = frame["gram"].to_numpy() & mask
            keys = np.unique(gram)
            n = np.zeros((len(keys), len(langs)))
            np.add.at(n, (np.searchsorted(keys, gram), frame["lang"].map(langs.index).to_numpy() if len(frame) else []), frame["n"].to_numpy())
            # A context is a window without its low byte, which is the coded symbol.
            context, of = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(context), len(langs))), np.zeros((len(context), len(langs)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(n / (total + distinct)[of])
            if lower is None:
                fallback = np.full((len(keys), len(langs)), 8.0)
            else:
                fallback = lower[np.searchsorted(order_keys[-1], keys & (mask >> 8))]
            lower = np.where(n > 0, seen, esc[of] + fallback)
            order_keys.append(keys.astype(np.uint32))
            order_cost.append(lower.astype(np.float32))
            order_ctx.append(context.astype(np.uint32))
            order_esc.append(esc.astype(np.float32))
        return cls(langs, order_keys, order_cost, order_ctx, order_esc)


class Scorer:
    """The model with an open hash table over full windows."""

    def __init__(self, model: Model):
        self.model = model
        keys = model.keys[ORDER]
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slot_keys = np.zeros(1 << self.bits, np.uint32)
        left, at, tries = np.arange(len(keys), dtype=np.int32), self._slot(keys), 0
        while len(left):
            free = self.slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.slots[at[take]], self.slot_keys[at[take]] = left[take], keys[left[take]]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, at, tries = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1), tries + 1
        self.tries = tries

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def found(self, grams: np.ndarray) -> np.ndarray:
        """The number of each window in the table, or -1."""
        at = self._slot(grams)
        out = np.where(self.slot_keys[at] == grams, self.slots[at], -1)
        miss = np.flatnonzero((out < 0) & (self.slots[at] >= 0))
        at = at[miss]
        for _ in range(self.tries):
            if not len(miss):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.slot_keys[at] == grams[miss]
            out[miss[hit]] = self.slots[at[hit]]
            go = ~hit & (self.slots[at] >= 0)
            miss, at = miss[go], at[go]
        return out

    def _unseen(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Bits of windows that order's table lacks: escapes down to an order that has them."""
        m, bits = self.model, np.zeros((len(grams), len(self.model.langs)), np.float32)
        if not len(grams):
            return bits
        context = grams >> np.uint32(8)
        at = np.minimum(np.searchsorted(m.contexts[order], context), len(m.contexts[order]) - 1)
        known = m.contexts[order][at] == context
        bits[known] += m.escape[order][at[known]]
        if order == 0:
            return bits + np.float32(8)
        short = grams & np.uint32((1 << (8 * order)) - 1)
        at = np.minimum(np.searchsorted(m.keys[order - 1], short), len(m.keys[order - 1]) - 1)
        known = m.keys[order - 1][at] == short
        bits[known] += m.cost[order - 1][at[known]]
        bits[~known] += self._unseen(short[~known], order - 1)
        return bits

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits, rows by languages."""
        grams = _grams(data, offsets, ORDER)
        found = self.found(grams)
        miss = np.flatnonzero(found < 0)
        other = self._unseen(grams[miss], ORDER)
        out = np.zeros((len(offsets) - 1, len(self.model.langs)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        found[miss] = 0
        for k in range(len(self.model.langs)):
            each = self.model.cost[ORDER][:, k][found]
            each[miss] = other[:, k]
            if len(full):
                out[full, k] = np.add.reduceat(each, offsets[:-1][full], dtype=np.float64)
        return out


def train(documents: DataFrame) -> Model:
    """The model of documents (text, lang) with a lang.

    Counted over all texts. Windows of ORDER + 1 folded bytes are added up in each task and then by Spark, so
    what the driver gets are the distinct windows of each language, which texts of any length and number repeat.
    """
    rows = documents.select("lang", "text").filter("lang is not null and text is not null")
    sums = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model.fit(sums.toPandas().sort_values(["lang", "gram"]))


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """documents without the text, with lang_pred and score.

    score is the posterior of the language under a uniform prior, with code lengths of long
    texts scaled to 64 bytes so that it keeps telling sure from unsure.
    """
    keep = [c for c in documents.columns if c not in (text, "lang_pred", "score")]
    schema = documents.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value) if shipped.value.langs else None
        for batch in batches:
            langs, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if scorer:
                for a, b, data, offsets in V.rows_in(batch, text):
                    bits = scorer.lengths(data, offsets)
                    size = np.maximum(64, np.diff(offsets))
                    odds = np.exp2((bits.min(1, keepdims=True) - bits) / size[:, None] * 64)
                    langs[a:b], scores[a:b] = np.array(scorer.model.langs, object)[bits.argmin(1)], 1 / odds.sum(1)
            column = batch.column(batch.schema.get_field_index(text))
            for i, t in enumerate(column.to_pylist()):
                if t is None or not _LETTER.search(t):
                    langs[i], scores[i] = "und", 0.0
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores)], schema.names)

    return documents.select(*keep, text).mapInArrow(run, schema)


