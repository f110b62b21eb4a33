"""SimHash near-duplicates: positional byte index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most two bits differ in at most two bytes, so they share at
least six bytes at equal positions: the count that a pair must reach. The index posts every distinct fingerprint under the
bytes of two of four byte pairs, six postings in all, and two bytes cannot spoil all six. A posting is held by what agrees in
four bytes, whatever the other four are. Within it the bytes that each pair shares by position are tallied, pairs that reach six
are retained, and their bits are verified.

A posting of more than ``MOST`` fingerprints is refined: its members are posted again under each choice of two of the four
bytes that are left. Such a posting has two free bytes, hence at most 65,536 distinct fingerprints whatever the input. Links
are reduced to (fingerprint, smallest fingerprint linked to it) edges, so a dense group gives a row a member and not all its
pairs. Links between fingerprints are found without loss; documents with the same fingerprint are one node of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmlframe.llm.common import components, ship, spread, written

_ONES = np.array([i.bit_count() for i in range(256)], np.uint8)
#: Fingerprints that a posting on four bytes holds before it is refined.
MOST = 256
#: Byte positions of the six postings, and for each the pairs of further positions that refine it.
POSTINGS = [tuple(p for k in c for p in (2 * k, 2 * k + 1)) for c in combinations(range(4), 2)]
REFINED = [list(combinations([p for p in range(8) if p not in own], 2)) for own in POSTINGS]


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """Words are runs of bytes other than blank and the five ASCII white spaces, A-Z lower-cased; shingles of ``width`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both of them
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of the text's shingles; 0 without a word."""
    return simhash_of(shingle_hashes(text, width, seed))


def fingerprints(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(row_id, fp): fp is the 64-bit fingerprint as a signed long. A null text counts as empty, with fingerprint 0."""
    ship(df.sparkSession)
    schema = pa.schema([(row_id, pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return df.select(F.col(row_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{row_id}` long, fp long")


def _smallest(near: np.ndarray) -> np.ndarray:
    """For tables of links (tables, n, n): the first member of each member's group."""
    n = near.shape[1]
    root = np.broadcast_to(np.arange(n), near.shape[:2])
    while True:
        low = np.minimum(root, np.where(near, root[:, None, :], n).min(axis=2))
        low = np.take_along_axis(low, low, axis=1)
        if (low == root).all():
            return root
        root = low


def _tallied(u: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of the same row of ``u`` share the bytes they must and differ in few enough bits."""
    apart = (u[:, :, None] ^ u[:, None, :]).view(np.uint8).reshape(*u.shape, u.shape[1], 8)
    near = (apart == 0).sum(axis=3, dtype=np.uint8) >= 8 - bits
    at = np.nonzero(near)
    near[at] = _ONES[apart[at]].sum(axis=1) <= bits
    return near


def _linked(lists: list[np.ndarray], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprint, smallest fingerprint of its group) edges of postings of the same size."""
    u = np.sort(np.stack(lists).view(np.uint64), axis=1)
    n = u.shape[1]
    step = max(1, (1 << 18) // (n * n))
    for at in range(0, len(u), step):
        part = u[at : at + step]
        root = _smallest(_tallied(part, bits))
        row, col = np.nonzero(root != np.arange(n))
        if len(row):
            yield part[row, col].view(np.int64), part[row, root[row, col]].view(np.int64)


def _linked_by_table(fps: np.ndarray, free: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a refined posting: six bytes are shared, so look the few values of the others within ``bits`` up."""
    u = fps.view(np.uint64)
    value = np.zeros(len(u), np.int64)
    for p in free:
        value = value << 8 | ((u >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)
    width = 8 * len(free)
    masks = [sum(1 << b for b in c) for k in range(1, bits + 1) for c in combinations(range(width), k)]
    order = np.argsort(value)
    v, n = value[order], len(value)
    place = np.full(1 << width, n, np.int64)
    place[v] = np.arange(n)
    root = np.append(np.arange(n), n)
    while True:
        low = root.copy()
        for m in masks:
            np.minimum(low[:n], root[place[v ^ m]], out=low[:n])
        low = low[low]
        if (low == root).all():
            break
        root = low
    at = np.flatnonzero(root[:n] != np.arange(n))
    return fps[order[at]], fps[order[root[at]]]


def _masked(fp: str, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << 8 * p for p in positions)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def link_fingerprints(fps: DataFrame, *, fp: str = "fp", bits: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fingerprints ``fps`` at ``bits`` or fewer differing bits."""
    if not 0 <= bits <= 2:
        raise ValueError("a posting is bounded for at most two differing bits")
    fps = spread(fps.select(F.col(fp).alias("fp")), each=1 << 17)
    posts = F.array(*(F.struct(F.lit(i).alias("choice"), _masked("fp", own).alias("bytes")) for i, own in enumerate(POSTINGS)))
    posted = fps.select("fp", F.explode(posts).alias("post")).select("fp", "post.choice", "post.bytes")
    sizes = posted.groupBy("choice", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    posted = written(posted.join(sizes, ["choice", "bytes"]), "simhash-postings")
    lists = posted.where(F.col("n") <= MOST).groupBy("choice", "bytes").agg(F.collect_list("fp").alias("fps")).select(F.lit(-1).alias("free"), "fps")
    further = [[tuple(p for p in range(8) if p not in (*own, *two)) for two in pairs] for own, pairs in zip(POSTINGS, REFINED)]
    free = sorted({f for pairs in further for f in pairs})
    again = F.array(*(F.struct(F.lit(i).alias("free"), _masked("fp", tuple(p for p in range(8) if p not in f)).alias("bytes")) for i, f in enumerate(free)))
    choices = F.array(*(F.array(*(F.lit(free.index(f)) for f in pairs)) for pairs in further))
    # A fingerprint that several large postings hold is posted once for each choice of free bytes.
    large = posted.where(F.col("n") > MOST).select("fp", F.explode(F.get(choices, F.col("choice"))).alias("free")).distinct()
    large = large.withColumn("bytes", F.get(again, F.col("free"))["bytes"]).groupBy("free", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of_size: dict[int, list[np.ndarray]] = {}
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for own, values in zip(b.column(0).to_pylist(), b.column(1)):
                x = values.values.to_numpy(zero_copy_only=False)
                if own < 0 or len(x) <= MOST:
                    of_size.setdefault(len(x), []).append(x)
                else:
                    out.append(_linked_by_table(x, free[own], bits))
            for same in of_size.values():
                out += _linked(same, bits)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in (0, 1)], schema=schema)

    return lists.union(large.select("free", "fps")).mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, *, row_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, bits: int = 2) -> DataFrame:
    """(row_id, fingerprint as 16 hex digits, component_id): component_id is the smallest id reachable over links, itself included.

    Null and empty texts have fingerprint zero and are linked like others. A row without an id belongs to its group but
    never names it; the component_id of a group without any id is null. Repeated rows give repeated rows. An empty table
    gives an empty table; other columns aren't looked at.
    """
    own = written(fingerprints(df, row_id=row_id, text=text, width=width, seed=seed), "simhash-fps")
    firsts = written(own.groupBy("fp").agg(F.min(row_id).alias("first_id")), "simhash-firsts")
    roots = components(link_fingerprints(firsts, bits=bits), "simhash")
    named = firsts.join(roots, firsts.fp == roots.node, "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), "first_id")
    lows = named.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = written(named.join(lows, F.col("root") == F.col("_root")).select("_fp", "component_id"), "simhash-named")
    # A written table with a row for each fingerprint: adaptive execution splits a fingerprint that very many rows share.
    joined = own.join(named, F.col("fp") == F.col("_fp"))
    return joined.select(row_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
