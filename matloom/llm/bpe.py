"""Byte-level BPE encoding and decoding in overlapping chunks.

Texts of up to CHUNK code points are encoded as they are. Longer ones are cut into
overlapping chunks that are pre-tokenised in parallel tasks. Two neighbouring chunks are
stitched where both put a pre-token boundary at the same place of their overlap, after a
character that isn't white space: from there on both would go on alike, and the text on either
side can be encoded by itself. Where an overlap has no such place, the piece so far is scanned on from its start, which
is a boundary for certain, and parted at the last one found; an endless word stays one piece. Each piece is then encoded in parallel, and a text's
ids are the pieces' ids in order; decoding concatenates the ids' raw bytes.

Null counts as empty; an empty text has no ids. Repeated keys and rows are kept apart by a row
number of their own. An empty table gives an empty one. Extra columns stay, but for those of the names that encoded() returns.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as V

CHUNK = 16_384
OVERLAP = 512


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("matloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def boundaries(text: str, pattern: str, near: tuple[int, int]) -> list[int]:
    """Ends of pre-tokens in the range near that don't hang on what follows text and come after no white space."""
    found = []
    for m in _pattern(pattern).finditer(text):
        if m.end() >= len(text) or m.end() > near[1]:
            break
        if m.end() >= near[0] and not text[m.end() - 1].isspace():
            found.append(m.end())
    return found


def _digest(ids: list[int] | np.ndarray) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _parts(batch: pa.RecordBatch, column: str, limit: int = V.SLICE_BYTES) -> Iterator[list[dict]]:
    """The batch's rows in slices of so many bytes of the column: as Python objects, a whole batch of long texts would take hundreds of MB a worker."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    for a, b in V.sliced(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), limit):
        yield batch.slice(a, b - a).to_pylist()


def _lists(raw: list[bytes]) -> pa.Array:
    """Ids, as little-endian bytes, as lists."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encoded(documents: DataFrame, rank_file: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, keep_ids: bool = False) -> DataFrame:
    """documents without the text, with n_tokens, ids_sha256, decoded_sha256, and the ids themselves as token_ids if keep_ids.

    rank_file: a rank file that every executor has at this path.
    """
    keep = [c for c in documents.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")]
    # The columns go under numbers, so that none of their names can clash with those used here.
    own = [f"c{k}" for k in range(len(keep))]
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    base = documents.select(*keep).schema
    schema = base.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if keep_ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))

    def made(kept: list[pa.Array], n: list[int], coded: list[str], decoded: list[str], raw: list[bytes]) -> pa.RecordBatch:
        columns = [*kept, pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, _lists(raw)] if keep_ids else columns, schema.names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            _, offsets = V.spelled(batch.column(at))
            for a, b in V.sliced(offsets):
                part = batch.slice(a, b - a)
                n, coded, decoded, raw = [], [], [], []
                for t in part.column(at).to_pylist():
                    ids = enc.encode_ordinary(t)  # Python integers of one text at a time
                    own_ids = _digest(ids)
                    n.append(len(ids))
                    coded.append(hashlib.sha256(own_ids).hexdigest())
                    decoded.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                    if keep_ids:
                        raw.append(own_ids)
                yield made([part.column(k) for k in range(len(keep))], n, coded, decoded, raw)

    done = rows.filter(F.length("_text") <= chunk).mapInArrow(short, schema)

    long = rows.filter(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id())
    # _row is drawn anew by a retried task, alike as long as its input split is; _key keeps a row's chunks together in any case.
    long = long.withColumn("_key", F.concat_ws(":", F.col("_row"), F.xxhash64("_text")))
    head = F.struct(*own) if keep else F.struct(F.lit(0).alias("_none"))
    starts = F.expr(f"sequence(0L, greatest(0L, cast(length(_text) as long) - 1L), {chunk}L)")
    chunks = long.select(
        "_key",
        head.alias("_head"),
        F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(F.col("_text"), s + 1, F.lit(chunk + overlap)).alias("part")))).alias("_n", "_c"),
    ).select("_key", F.when(F.col("_n") == 0, F.col("_head")).alias("_head"), F.col("_n").cast("long").alias("_n"), F.col("_c.part").alias("_part"))
    chunks = chunks.repartition(F.col("_key"), F.col("_n"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in _parts(batch, "_part"):
                for r in found:
                    r["_early"] = boundaries(r["_part"][: 2 * overlap], pattern, (1, overlap)) if r["_n"] else []
                    r["_late"] = [e - chunk for e in boundaries(r["_part"], pattern, (chunk + 1, chunk + overlap))]
                yield V.record_batch(found, scan_schema)

    scan_schema = T.StructType([*chunks.schema.fields]).add("_early", T.ArrayType(T.IntegerType())).add("_late", T.ArrayType(T.IntegerType()))
    piece_schema = T.StructType([f for f in chunks.schema.fields if f.name != "_part"]).add("_piece", "string")
    coded_schema = T.StructType([f for f in chunks.schema.fields if f.name != "_part"]).add("_ids", "binary")

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces, cut where neighbours agree. Rows come sorted by key and number."""
        now: dict | None = None
        late: list[int] = []
        for part in (x for batch in batches for x in _parts(batch, "_part")):
            out = []
            for r in part:
                own = r["_part"][:chunk]
                if now is None or r["_key"] != now["_key"]:
                    if now is not None:
                        out.append(now)
                    now = {"_key": r["_key"], "_head": r["_head"], "_n": 0, "_piece": own}
                elif (cut := next((e for e in sorted(set(r["_early"]) & set(late))), None)) is None:
                    # This chunk's boundaries may all be wrong: the piece is scanned from its start, which is one.
                    whole, end = now["_piece"] + r["_part"], len(now["_piece"]) + len(own)
                    found = boundaries(whole, pattern, (1, end + overlap))
                    cut = max((e for e in found if e <= end), default=0)
                    if cut:
                        out.append(now | {"_piece": whole[:cut]})
                        now = {"_key": now["_key"], "_head": None, "_n": now["_n"] + 1, "_piece": whole[cut:end]}
                    else:
                        now["_piece"] = whole[:end]
                    late = [e - end for e in found if e > end]
                    continue
                else:
                    out.append(now | {"_piece": now["_piece"] + own[:cut]})
                    now = {"_key": now["_key"], "_head": None, "_n": now["_n"] + 1, "_piece": own[cut:]}
                late = r["_late"]
            yield V.record_batch(out, piece_schema)
        if now is not None:
            yield V.record_batch([now], piece_schema)

    pieces = chunks.mapInArrow(scanned, scan_schema).repartition(F.col("_key")).sortWithinPartitions("_key", "_n").mapInArrow(stitched, piece_schema)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for part in (x for batch in batches for x in _parts(batch, "_piece")):
            yield V.record_batch([{**r, "_ids": _digest(enc.encode_ordinary(r["_piece"]))} for r in part], coded_schema)

    coded = pieces.repartition(F.col("_key"), F.col("_n")).mapInArrow(ids_of, coded_schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a text: its ids are hashed as they pass; only keep_ids holds them all."""
        enc, now = encoding(rank_file, pattern), None

        def ended(s: dict) -> dict:
            row = {c: s["head"][n] for c, n in zip(keep, own, strict=True)} | {"n_tokens": s["count"], "ids_sha256": s["ids"].hexdigest(), "decoded_sha256": s["text"].hexdigest()}
            return row | {"token_ids": np.frombuffer(b"".join(s["all"]), "<i4")} if keep_ids else row

        for part in (x for batch in batches for x in _parts(batch, "_ids")):
            out = []
            for r in part:
                if now is None or now["key"] != r["_key"]:
                    if now:
                        out.append(ended(now))
                    now = {"key": r["_key"], "head": r["_head"], "count": 0, "ids": hashlib.sha256(), "text": hashlib.sha256(), "all": []}
                ids = np.frombuffer(r["_ids"], "<u4").tolist()
                now["count"] += len(ids)
                now["ids"].update(r["_ids"])
                now["text"].update(enc.decode_bytes(ids))
                if keep_ids:
                    now["all"].append(r["_ids"])
            yield V.record_batch(out, schema)
        if now:
            yield V.record_batch([ended(now)], schema)

    ended_rows = coded.repartition(F.col("_key")).sortWithinPartitions("_key", "_n").mapInArrow(joined, schema)
    return done.unionByName(ended_rows)
