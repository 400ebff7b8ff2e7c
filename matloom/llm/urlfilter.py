"""URL filters: all glob rules in one bit-parallel wildcard automaton.

Globs over the canonical URL host + path: `?` is one character but `/`, `*` any run
of characters but `/`, `**` any run. Every glob takes its length + 1 bits of
a multiword mask; a step of the Shift-And recurrence moves all globs of all URLs of
a batch by one byte: D' = ((D << 1) & B[c]) | (D & S[c]), where B[c] has the states that
byte c enters and S[c] the states that a wildcard holds on c.

Null URLs and URLs without `://` have an empty host and path. Empty tables
give empty results; repeated rows are judged each for itself; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectext as V

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """verdict for the host and its subdomains, where the path starts with /path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


def rules_from(text: str) -> list[Rule]:
    """Rules such as `block com/en/, allow example.com/en/7`."""
    found = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        verdict, place = item.split()
        host, slash, path = place.partition("/")
        found.append(Rule(verdict, host, slash + path))
    return found


class Automaton:
    """Compiled globs; owner[i] is the caller's number of glob i's rule."""

    def __init__(self, globs: list[str], owners: list[int]):
        plain, other = np.ones(256, bool), np.ones(256, bool)
        other[ord("/")] = False
        states: list[tuple[np.ndarray | None, np.ndarray | None]] = []
        self.starts, self.accepts, self.owners = [], [], owners
        for glob in globs:
            self.starts.append(len(states))
            states.append((None, None))
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i] == ord("*"):
                    wide = raw[i : i + 2] == b"**"
                    held = plain if wide else other
                    old = states[-1][1]
                    states[-1] = (states[-1][0], held if old is None else held | old)
                    i += 1 + wide
                    continue
                takes = other.copy() if raw[i] == ord("?") else np.arange(256) == raw[i]
                states.append((takes, None))
                i += 1
            self.accepts.append(len(states) - 1)
        self.words = max(1, -(-len(states) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.hold = np.zeros((256, self.words), np.uint64)
        self.initial = np.zeros(self.words, np.uint64)
        for k, (takes, held) in enumerate(states):
            bit = np.uint64(1 << (k % 64))
            if takes is not None:
                self.enter[takes, k // 64] |= bit
            if held is not None:
                self.hold[held, k // 64] |= bit
        for k in self.starts:
            self.initial[k // 64] |= np.uint64(1 << (k % 64))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row and glob, whether the glob fits the whole row."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        state = np.repeat(self.initial[None, :], len(order), 0)
        sorted_lengths, firsts = -lengths[order], offsets[:-1][order]
        for j in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(sorted_lengths, -j, "left"))
            byte, d = data[firsts[:live] + j], state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.enter[byte]) | (d & self.hold[byte])
        out = np.zeros((len(order), len(self.accepts)), bool)
        for g, k in enumerate(self.accepts):
            out[order, g] = (state[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) != 0
        return out


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (null without one) and verdict.

    The longest rule that fits wins, the first listed among equals; default is
    the verdict where none fits. The rules, a parameter, are all that workers are sent.
    """
    automaton = Automaton([g for r in rules for g in r.globs], [i for i, r in enumerate(rules) for _ in r.globs])
    length = np.array([len(r.name) for r in rules] or [0])
    rank = np.lexsort((np.arange(len(rules)), -length[: len(rules)]))
    clean = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")])
    split = clean.withColumns({"host": F.coalesce(host_of(F.col(url)), F.lit("")), "path": F.coalesce(path_of(F.col(url)), F.lit(""))})
    own = "_canonical"
    while own in {c.lower() for c in clean.columns}:
        own += "_"
    split = split.withColumn(own, F.concat("host", "path"))
    schema = clean.schema.add("host", "string").add("path", "string").add("rule", "string").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            for a, b, data, offsets in V.rows_in(batch, own):
                fits = automaton.matches(data, offsets)
                for i in reversed(rank):
                    globs = [g for g, o in enumerate(automaton.owners) if o == i]
                    best[a:b][fits[:, globs].any(1)] = i
            kept = [batch.column(k) for k, n in enumerate(batch.schema.names) if n != own]
            names = [n for n in batch.schema.names if n != own]
            rule = pa.array([rules[i].name if i >= 0 else None for i in best], pa.string())
            verdict = pa.array([rules[i].verdict if i >= 0 else default for i in best], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, rule, verdict], [*names, "rule", "verdict"])

    return split.mapInArrow(run, schema)
