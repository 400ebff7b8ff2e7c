"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct k-word shingles. Equal sets are one node. Each node's signature of
TREES * DEPTH MinHash values gives TREES sorted orders; in each, nodes whose
longest common prefix has DEPTH values or more stand in one region, and neighbours in a region
are candidates. At similarity 0.8 and 32 trees of depth 4, a pair shares no region with
probability (1 - 0.8^4)^32 < 1e-7.

Depth adapts by region. First, all nodes of a region are compared with its least node alone, which is
linear in its size; what links is merged. Only regions that then still hold several
components are searched deeper: their nodes are sorted by 128 further signature bits, in an order of
each region's own, and each is compared with its neighbour by longest common prefix and with the region's centre, the node nearest to the majority of
those bits. What is left after that is compared in full, but for pairs that prefix filtering on the nodes'
shingles, signature bits or set sizes rule out. So a large group of near copies costs a few
comparisons a node and tree, while no candidate link between components is skipped. Links are confirmed on full shingle sets.

A pair whose signature bits agree in fewer than AGREE of 128 is passed over: at similarity 0.8 that has a probability under 1e-12.

Null, empty and wordless texts have an empty set and are linked with nothing; a document of fewer words
than k has its whole sequence as one shingle; equal rows share a component, as do rows of one doc_id
with equal sets. A row without doc_id has a null component and is kept. Extra columns don't matter; deduplicated() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import written
from . import vectext as V
from .components import components, extended

TREES, DEPTH = 32, 4
#: Of 128 one-bit MinHash values, a pair of similarity 0.8 agrees in 115 on average, standard deviation 3.4.
AGREE = 88
#: A region's sorted order is cut into runs of about so many nodes, so that no task holds a large region.
RUN = 4096

_random = np.random.default_rng(20240229)
_A = (_random.integers(0, 1 << 31, TREES * DEPTH, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _random.integers(0, 1 << 32, TREES * DEPTH, dtype=np.int64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in ascending order, and row offsets into them."""
    data = V.LOWER[data]
    starts, ends, firsts = V.spans(data, offsets, V.UNSPACED)
    hashes, counts = V.shingled(V.hashed(data, starts, ends), firsts, k)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values, TREES * DEPTH by rows with a set."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    firsts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((TREES * DEPTH, len(firsts)), np.uint32)
    for p in range(TREES * DEPTH):
        out[p] = np.minimum.reduceat(low * _A[p] + _B[p], firsts)
    return out


_SIGNED = T.StructType().add("doc_id", "long").add("key", "long").add("n", "long").add("node", "long").add("twin", "long").add("keys", T.ArrayType(T.LongType())).add("bits0", "long").add("bits1", "long")


def _signer(k: int, seed: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for a, b, data, offsets in V.rows_in(batch, "text"):
                hashes, at = shingle_sets(data, offsets, k)
                n = np.diff(at)
                full = np.flatnonzero(n > 0)
                node, twin = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                raw = hashes.tobytes()
                for i in full:
                    d = xxhash.xxh3_128_intdigest(raw[at[i] * 8 : at[i + 1] * 8], seed)
                    node[i], twin[i] = np.array([d >> 64, d & 0xFFFFFFFFFFFFFFFF], np.uint64).view(np.int64)
                empty = n == 0
                regions = np.zeros((b - a, TREES), np.int64)
                bits = np.zeros((b - a, 2), np.int64)
                if len(full):
                    sig = signatures(hashes, at)
                    for t in range(TREES):
                        h = np.full(len(full), t, np.uint64)
                        for j in range(DEPTH):
                            h = V.mixed(h * np.uint64(0xD6E8FEB86659FD93) + sig[t * DEPTH + j].astype(np.uint64))
                        regions[full, t] = h.view(np.int64)
                    # The low bit of a + b mod 2^32 is no hash bit; a finalised one is.
                    one = (V.mixed(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
                    bits[full] = np.ascontiguousarray(np.packbits(one.T, axis=1)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        keys.slice(a, b - a),
                        pa.array(n.astype(np.int64)),
                        pa.array(node, mask=empty),
                        pa.array(twin, mask=empty),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * TREES), pa.array(regions.ravel())),
                        pa.array(bits[:, 0].copy()),
                        pa.array(bits[:, 1].copy()),
                    ],
                    _SIGNED.names,
                )

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, key, text): key tells the texts of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _signed(documents: DataFrame, k: int) -> DataFrame:
    """The written table of all documents' nodes; drawn anew with another seed if two different sets met in one 64-bit node."""
    for seed in range(8):
        found = written(_keyed(documents).mapInArrow(_signer(k, seed), _SIGNED), "signed")
        if not found.filter("node is not null").groupBy("node").agg((F.min("twin") != F.max("twin")).alias("bad")).filter("bad").limit(1).count():
            return found
    raise RuntimeError("no seed tells all shingle sets apart")


def _texts(documents: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, text) of the nodes that have a neighbour at all, written: the text of one document each."""
    wanted = nodes.select("node", F.col("doc").alias("doc_id"), "key").join(shared.select("node").distinct(), "node", "left_semi")
    # Repeated rows of a document are one text.
    return written(_keyed(documents).join(wanted, ["doc_id", "key"]).select("node", "text").dropDuplicates(["node"]), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose full sets reach percent. Adaptive execution splits a node of many pairs."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.concatenate([[0], np.cumsum(sum(np.diff(V.spelled(batch.column(j))[1]) for j in (2, 3)))])
            linked = np.zeros(batch.num_rows, bool)
            for a, b in V.sliced(size, 4 * V.SLICE_BYTES):
                part = batch.slice(a, b - a)
                (hu, au), (hv, av) = (shingle_sets(*V.spelled(part.column(j)), k) for j in (2, 3))
                for i in range(b - a):
                    x, y = hu[au[i] : au[i + 1]], hv[av[i] : av[i + 1]]
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    linked[a + i] = 100 * inter >= percent * (len(x) + len(y) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(linked)), batch.column(1).filter(pa.array(linked))], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Without the pairs that set sizes or signature bits rule out."""
    side = lambda x: nodes.select(F.col("node").alias(x), *[F.col(c).alias(x + c) for c in ("n", "bits0", "bits1")])
    return pairs.join(side("u"), "u").join(side("v"), "v").filter(_close("u", "v", percent)).select("u", "v")


def _close(x: str, y: str, percent: int):  # noqa: ANN202
    c = F.col
    apart = F.bit_count(c(x + "bits0").bitwiseXOR(c(y + "bits0"))) + F.bit_count(c(x + "bits1").bitwiseXOR(c(y + "bits1")))
    return (apart <= 128 - AGREE) & (100 * F.least(x + "n", y + "n") >= percent * F.greatest(x + "n", y + "n"))


def _undecided(shared: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(region, node, c, n, bits0, bits1) of the regions that hold several components, written."""
    member = shared.select("region", "node").join(groups, "node", "left").select("region", "node", F.coalesce("component", "node").alias("c"))
    several = member.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("region")
    return written(member.join(several, "region", "left_semi").join(nodes.select("node", "n", "bits0", "bits1"), "node"), "regions")


def _centres(member: DataFrame) -> DataFrame:
    """(region, size, centre): the node whose signature bits are nearest to the region's majority."""
    ones = [F.sum(F.shiftrightunsigned(f"bits{w}", i).bitwiseAND(F.lit(1))).alias(f"o{w}_{i}") for w in (0, 1) for i in range(64)]
    counted = member.groupBy("region").agg(F.count("*").alias("size"), *ones)
    word = lambda w: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft((2 * F.col(f"o{w}_{i}") > F.col("size")).cast("long"), i) for i in range(64)])
    major = counted.select("region", "size", word(0).alias("m0"), word(1).alias("m1"))
    apart = F.bit_count(F.col("bits0").bitwiseXOR(F.col("m0"))) + F.bit_count(F.col("bits1").bitwiseXOR(F.col("m1")))
    # Ties fall differently in each region, so that the regions of one group have several centres.
    ranked = member.join(major, "region").groupBy("region").agg(F.first("size").alias("size"), F.min(F.struct(apart.alias("d"), F.xxhash64("node", "region").alias("h"), *["node", "c", "n", "bits0", "bits1"])).alias("x"))
    return ranked.select("region", "size", *[F.col(f"x.{c}").alias("u" + ("" if c == "node" else c)) for c in ("node", "c", "n", "bits0", "bits1")])


def _deeper(member: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components: each node with its region's centre, and with its neighbour by longest common prefix of the further bits."""
    centres = written(_centres(member), "centres")
    v = [F.col(c).alias("v" + ("" if c == "node" else c)) for c in ("node", "c", "n", "bits0", "bits1")]
    u = ["u", "uc", "un", "ubits0", "ubits1"]
    star = member.select("region", *v).join(centres, "region").select(*u, *[c.replace("u", "v", 1) for c in u])
    turned = F.expr("shiftrightunsigned(bits0, pmod(region, 64)) | shiftleft(bits0, pmod(64 - region, 64))")
    run = F.pmod(F.xxhash64("node", "region"), F.ceil(F.col("size") / RUN))
    order = W.partitionBy("region", "run").orderBy(turned, "node")
    cut = member.join(centres.select("region", "size"), "region").withColumn("run", run)
    beside = cut.withColumns({"u": F.lag("node").over(order), **{f"u{c}": F.lag(c).over(order) for c in ("c", "n", "bits0", "bits1")}}).select(*u, *v)
    pairs = star.unionByName(beside).filter((F.col("uc") != F.col("vc")) & _close("u", "v", percent))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(tried, ["u", "v"], "left_anti")


def _prefixed(member: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """All pairs (u, v) of member (node, c) of different components that can be linked at all, by prefix filtering.

    Sets of sizes n and m at a similarity of percent share a = ceil(percent * (n + m) / (100 + percent)) shingles. So, with
    shingles in one order, both have a shared one among their first n - a + 1 and m - a + 1. Shingles of one
    component alone, which edits make, stand first, then those that few members have: a member of too many edits is ruled out alone.
    """
    texts = texts.join(member.join(nodes.select("node", "n"), "node"), "node").select("node", "c", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in V.rows_in(batch, "text"):
                hashes, at = shingle_sets(data, offsets, k)
                own = batch.slice(a, b - a)
                found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), found], ["node", "c", "n", "shingles"])

    sets = written(texts.mapInArrow(run, "node long, c long, n long, shingles array<long>"), "sets")
    tokens = sets.select("node", "c", "n", F.explode("shingles").alias("t"))
    known = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("t", "df")
    by_node = W.partitionBy("node")
    ranked = tokens.join(known, "t").withColumn("r", F.row_number().over(by_node.orderBy("df", "t"))).withColumn("known", F.count("*").over(by_node))
    prefix = ranked.withColumn("at", F.col("n") - F.col("known") + F.col("r")).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = written(prefix.join(nodes.select("node", "bits0", "bits1"), "node").select("node", "c", "n", "bits0", "bits1", "at", "t"), "prefix")
    x, y = (prefix.select("t", *[F.col(c).alias(s + ("" if c == "node" else c)) for c in ("node", "c", "n", "bits0", "bits1", "at")]) for s in "uv")
    least = F.ceil(percent * (F.col("un") + F.col("vn")) / (100 + percent))
    fit = (F.col("u") < F.col("v")) & (F.col("uc") != F.col("vc")) & (F.col("uat") + least <= F.col("un") + 1) & (F.col("vat") + least <= F.col("vn") + 1) & _close("u", "v", percent)
    return x.join(y, "t").filter(fit).select("u", "v").distinct()


def _grouped(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written rows of _SIGNED, and (node, c) of all nodes: those of one c are linked."""
    signed = _signed(documents, k)
    least = F.min(F.struct("doc_id", "key"))
    rows = signed.filter("node is not null and doc_id is not null").groupBy("node").agg(least.alias("least"), *[F.first(c).alias(c) for c in ("n", "bits0", "bits1", "keys")])
    nodes = written(rows.select("node", F.col("least.doc_id").alias("doc"), F.col("least.key").alias("key"), "n", "bits0", "bits1", "keys"), "nodes")
    placed = nodes.select("node", F.explode("keys").alias("region"))
    # A region's least node; regions of one node, which are nearly all, go.
    least = placed.groupBy("region").agg(F.min("node").alias("u"), F.count("*").alias("size")).filter("size > 1").select("region", "u")
    shared = written(placed.join(least, "region").select("region", "node", "u"), "shared")
    texts = _texts(documents, nodes, shared)
    first = written(_possible(shared.filter("node != u").select("u", F.col("node").alias("v")).distinct(), nodes, percent), "stars")
    groups = components(_confirmed(first, texts, k, percent))

    # Regions that hold several components still are searched deeper.
    tried = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = written(_deeper(_undecided(shared, groups, nodes), tried, percent), "neighbours")
    if pairs.limit(1).count():
        tried = tried.unionByName(pairs)
        groups = extended(groups, _confirmed(pairs, texts, k, percent))

    # What is left is compared in full.
    member = _undecided(shared, groups, nodes).select("node", "c").distinct()
    pairs = written(_prefixed(member, nodes, texts, k, percent).join(tried, ["u", "v"], "left_anti"), "pairs")
    if pairs.limit(1).count():
        groups = extended(groups, _confirmed(pairs, texts, k, percent))
    return signed, nodes.select("node", "doc").join(groups, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("c"))


def linked(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, kept."""
    signed, named_groups = _grouped(documents, k, percent)
    smallest = written(named_groups.groupBy("c").agg(F.min("doc").alias("component_id")), "smallest")
    of_node = named_groups.join(smallest, "c").select("node", "component_id")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(of_node, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: that of the least doc_id, and of its texts the one of the least hash.

    Rows are told apart by doc_id and text, so another text of a doc_id stays or goes by its own component;
    of rows that repeat both, one stays. Rows without words stay once for each doc_id and text, rows without doc_id all.
    """
    signed, named_groups = _grouped(documents, k, percent)
    rows = signed.filter("doc_id is not null").groupBy("doc_id", "key").agg(F.first("node").alias("node"), F.count("*").alias("times"))
    rows = written(rows.join(named_groups.select("node", "c"), "node", "left"), "rows")
    # Written, so that adaptive execution can split a large component's rows in the join.
    best = written(rows.filter("c is not null").groupBy("c").agg(F.min(F.struct("doc_id", "key")).alias("x")).select("c", F.col("x.doc_id").alias("best_id"), F.col("x.key").alias("best_key")), "best")
    told = rows.filter("c is not null").join(best, "c")
    gone = told.filter((F.col("doc_id") != F.col("best_id")) | (F.col("key") != F.col("best_key"))).select("doc_id", "key")
    own, key = (_free(documents, c) for c in ("_own", "_key"))
    named = lambda df: df.select(F.col("doc_id").alias(own), F.col("key").alias(key))
    marked = documents.withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    kept = marked.join(named(gone), [own, key], "left_anti")
    again = rows.filter("times > 1").select("doc_id", "key")
    if again.limit(1).count():
        kept = kept.join(named(again), [own, key], "left_anti").unionByName(kept.join(named(again), [own, key], "left_semi").dropDuplicates([own, key]))
    return kept.select(*documents.columns)


def _free(df: DataFrame, name: str) -> str:
    """name, or one like it that df lacks."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
