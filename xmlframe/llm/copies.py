"""Near copies by exact shingle similarity; positional byte postings give the candidates only.

The texts of one set of shingles are one node. A node is posted under the bytes of two fingerprints: its SimHash under every
choice of six of eight bytes, and a wide one of 120 bytes, one for the smallest hash of the set under each of 120 functions, in
24 runs of five. Two sets of similarity s share a byte of the wide one with chance s, so a pair at 0.8 meets under some run
with chance 1 - (1 - 0.8^5)^24 = 0.9999, whatever bits its SimHashes differ in.

Nodes that meet are compared set by set. First each is compared with up to four nodes of its posting. Postings that then still
hold several components make families: nodes that such postings connect. A family is cut into blocks of bounded size, and each
pair of blocks is compared in one place: the tally of wide bytes that two nodes share at equal positions has to reach
``LEAST`` of 120 (pairs at 0.8 share 96 on average, 5.5 standard deviations above that), and what reaches it is verified by its
sets unless the two are known to be linked already. So every pair that meets is linked or compared, and a group of near
copies gives a few rows a member instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmlframe.llm.common import components, ship, written
from xmlframe.llm.simhash import shingle_hashes, simhash_of

RUNS, RUN = 24, 5
#: Wide bytes that two nodes share at least, and the most nodes and hashes of a block.
LEAST, BLOCK_NODES, BLOCK_HASHES = 72, 1024, 1 << 20
_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 2**64, RUNS * RUN, np.uint64)
_TIMES = _RNG.integers(0, 2**64, RUNS * RUN, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFTS = np.arange(RUN, dtype=np.uint64) * np.uint64(8)
_MASKS = np.array([sum(255 << 8 * p for p in c) for c in combinations(range(8), 6)], np.uint64)


def wide_bytes(hashes: np.ndarray) -> np.ndarray:
    """The wide fingerprint of a non-empty set."""
    low = np.full(RUNS * RUN, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048, None] ^ _FLIP) * _TIMES).min(axis=0))
    return ((low * _MIX) >> np.uint64(56)).astype(np.uint8)


def wide(hashes: np.ndarray) -> np.ndarray:
    """Its runs, as numbers of five bytes."""
    return (wide_bytes(hashes).astype(np.uint64).reshape(RUNS, RUN) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def _posts(text: str | None, width: int, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(node, set of shingle hashes, keys of its postings)."""
    hashes = shingle_hashes(text, width, seed)
    own = np.unique(hashes)
    if not len(own):
        return 0, own, np.zeros(0, np.uint64)
    mixed = (own ^ (own >> np.uint64(31))) * _MIX
    node = int((mixed ^ (mixed >> np.uint64(29))).sum(dtype=np.uint64))
    return node, own, np.concatenate((np.uint64(simhash_of(hashes)) & _MASKS, wide(own)))


def _pairs(nodes: np.ndarray, sizes: np.ndarray, level: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one posting with its first and last two nodes, where sizes allow the similarity."""
    order = np.argsort(nodes)
    nodes, sizes = nodes[order], sizes[order]
    for i in sorted({0, 1, len(nodes) - 2, len(nodes) - 1}):
        fits = (level[1] * np.minimum(sizes, sizes[i]) >= level[0] * np.maximum(sizes, sizes[i])) & (nodes != nodes[i])
        if fits.any():
            other = nodes[fits]
            yield np.minimum(other, nodes[i]), np.maximum(other, nodes[i])


def _similar(a: int, b: int, both: int, level: tuple[int, int]) -> bool:
    return level[1] * both >= level[0] * (a + b - both)


def _links(nodes: list[int], roots: list[int], blocks: np.ndarray, sets: list[np.ndarray], level: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join components, among the nodes of one block or between those of two."""
    bytes_ = np.stack([wide_bytes(x.view(np.uint64)) for x in sets])
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(nodes)) if len(set(blocks.tolist())) == 1 else np.flatnonzero(blocks == blocks.min())
    right = left if len(left) == len(nodes) else np.flatnonzero(blocks != blocks.min())
    tally = np.zeros((len(left), len(right)), np.uint8)
    for k in range(bytes_.shape[1]):
        tally += bytes_[left, k][:, None] == bytes_[right, k][None, :]
    low, high = np.minimum(sizes[left][:, None], sizes[right]), np.maximum(sizes[left][:, None], sizes[right])
    own = np.array(roots)
    rows, cols = np.nonzero((tally >= LEAST) & (level[1] * low >= level[0] * high) & (own[left][:, None] != own[right]))
    up = {r: r for r in roots}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    held: dict[int, set] = {}
    out = []
    for i, j in zip(left[rows].tolist(), right[cols].tolist()):
        if (left is not right or i < j) and (x := root(roots[i])) != (y := root(roots[j])):
            a, b = (held.get(k) or held.setdefault(k, set(sets[k].tolist())) for k in (i, j))
            if _similar(len(a), len(b), len(a & b), level):
                up[max(x, y)] = min(x, y)
                out.append((nodes[i], nodes[j]))
    return out


def near_copies(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42, level: tuple[int, int] = (4, 5)) -> DataFrame:
    """(row_id, text_key, root, component_id) for every row: links join texts of shingle similarity ``level`` (a fraction) or more.

    root names the group; component_id is its smallest id, null where no row of it has one; text_key is ``xxhash64`` of the text.
    Null and empty texts are one node and link with no other. Repeated rows give repeated rows, an empty table an empty table.
    """
    ship(df.sparkSession)
    ddl = "id long, text_key long, node long, size int, hashes array<long>, posts array<long>"
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("hashes", pa.list_(pa.int64())), ("posts", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                got = [_posts(x.as_py(), width, seed) for x in b.column(2)]
                node = np.array([x[0] for x in got], np.uint64).view(np.int64)
                size = [len(x[1]) for x in got]
                lists = [pa.array([x[k].view(np.int64) for x in got], pa.list_(pa.int64())) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(size, pa.int32()), *lists], schema=schema)

    rows = df.select(F.col(row_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("text"))
    rows = written(rows.mapInArrow(read, ddl), "copies-rows")
    # The rows of a node are equal in size, set and postings: any of them will do.
    posted = rows.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("posts").alias("posts"))
    posted = posted.select("node", "size", F.posexplode("posts").alias("choice", "key"))
    lists = posted.groupBy("choice", "key").agg(F.collect_list(F.struct("node", "size")).alias("held")).where(F.size("held") > 1)
    lists = written(lists, "copies-postings")
    needed = written(lists.select(F.explode("held.node").alias("node")).distinct(), "copies-needed")
    sets = rows.select("node", "hashes").join(needed, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    sets = written(sets, "copies-sets")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n = [], [], 0
            for held in b.column(0):
                x = held.values
                nodes, sizes = (x.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for low, high in _pairs(nodes, sizes, level):
                    a.append(low), c.append(high)
                    n += len(low)
                    if n > 65536:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])
                        a, c, n = [], [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                keep.append(_similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), level))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(lists.select("held").mapInArrow(meet, "a long, b long").distinct(), "copies-pairs")
    left, right = (sets.select(F.col("node").alias(f"_{k}"), F.col("hashes").alias(f"{k}_hashes")) for k in "ab")
    full = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    links = written(full.select("a", "b", "a_hashes", "b_hashes").mapInArrow(verify, "a long, b long"), "copies-links")
    roots = written(components(links, "copies").withColumnRenamed("node", "_node"), "copies-roots")

    # Families: postings that still hold several components connect their nodes.
    again = lists.where(F.size("held") > 4).select("choice", "key", F.explode("held.node").alias("node")).join(roots, F.col("node") == F.col("_node"), "left")
    again = again.select("choice", "key", "node", F.coalesce("root", "node").alias("root"))
    open_lists = again.groupBy("choice", "key").agg(F.min("node").alias("first"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    open_lists = open_lists.select(F.col("choice").alias("_c"), F.col("key").alias("_k"), "first")
    met = again.join(open_lists, (F.col("choice") == F.col("_c")) & (F.col("key") == F.col("_k"))).select(F.col("node").alias("a"), F.col("first").alias("b"))
    family = components(met, "copies-families").select("node", F.col("root").alias("family"))
    family = written(family.join(roots, F.col("node") == F.col("_node"), "left").select("node", "family", F.coalesce("root", "node").alias("root")), "copies-families")
    own = sets.select(F.col("node").alias("_node"), "hashes").join(family, F.col("_node") == F.col("node"))
    width_of = own.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum(F.size("hashes")) / BLOCK_HASHES)).alias("blocks"))
    own = own.join(width_of.withColumnRenamed("family", "_f"), F.col("family") == F.col("_f")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = own.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block", "hashes")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found = _links(group.column("node").to_pylist(), group.column("root").to_pylist(), group.column("block").to_numpy(), [x.values.to_numpy(zero_copy_only=False) for x in group.column("hashes")], level)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rest = written(own.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long"), "copies-rest")
    roots = components(links.union(rest), "copies")
    firsts = rows.groupBy("node").agg(F.min("id").alias("first_id")).withColumnRenamed("node", "_n")
    named = written(firsts.join(roots, F.col("_n") == F.col("node"), "left").select("_n", F.coalesce("root", "_n").alias("root"), "first_id"), "copies-named")
    lows = named.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = written(named.join(lows, F.col("root") == F.col("_root")).select("_n", "root", "component_id"), "copies-groups")
    out = rows.select("id", "text_key", "node").join(named, F.col("node") == F.col("_n"))
    return out.select(F.col("id").alias(row_id), "text_key", "root", "component_id")
