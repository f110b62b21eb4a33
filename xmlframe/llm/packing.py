"""Packing token sequences: non-negative least squares over shallow length combinations, the rest packed greedily.

A document of n ids gives whole windows of 4096, a head of k units (a unit is 256 ids, k < 16) and a tail of t < 256 ids. Heads
are packed into windows of 16 units and tails into windows of one unit, by the same steps:

* enumerate the combinations of a few lengths whose sum is the window exactly;
* solve for non-negative repeat counts that reproduce the histogram of lengths in the least-squares sense;
* round down and raise the counts again as far as the histogram allows;
* pack the residual greedily: cut each piece at powers of two and lay these out by falling size. A piece then starts at a multiple
  of its size, so none crosses a window and no window but the last has a gap.

Full tail windows are units: they follow the heads' residual. The last window is cut at powers of two, which need no
padding. So every sequence is full, or has a length of a power of two.

A document is cut at multiples of 4096 and 256 even where it would fit a window whole: heads of few lengths are what lets the
counts come out and sequences have no padding.

Only histograms of at most 255 lengths reach the driver, one for each of at most 16,384 parts of the rows. The plan is a function of
(length, rank among the pieces of this length), so placing a piece needs its rank and no further shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xmlframe.llm.common import fresh, placed, ship, tidy, written
from xmlframe.llm.tokens import CACHE_WORDS, ids_of

WINDOW, UNIT = 4096, 256
UNITS = WINDOW // UNIT
END_ID = 2


def combinations(window: int, depth: int) -> list[tuple[int, ...]]:
    """Rising tuples of two to ``depth`` lengths that fill ``window`` exactly."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        low = head[-1] if head else 1
        if head and left >= low:
            out.append((*head, left))
        if len(head) + 2 <= depth:
            for x in range(low, left // 2 + 1):
                grow((*head, x), left - x)

    grow((), window)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by active sets. Needs room for ``a`` and a few of its columns, not for their products."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    slack = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        gradient = np.where(passive, -np.inf, a.T @ (b - a @ x))
        j = int(gradient.argmax())
        if gradient[j] <= slack:
            break
        passive[j] = True
        while True:
            own = np.flatnonzero(passive)
            part = a[:, own]
            square = part.T @ part
            square[np.diag_indices_from(square)] += 1e-10  # columns may depend on one another
            goal = np.linalg.solve(square, part.T @ b)
            if (goal > 0).all():
                x[:] = 0
                x[own] = goal
                break
            falling = goal <= 0
            step = float((x[own][falling] / np.maximum(x[own][falling] - goal[falling], 1e-300)).min())
            x[own] += step * (goal - x[own])
            passive[own[x[own] <= 1e-12 * max(1.0, float(x.max()))]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


@dataclass
class Level:
    """The plan of one window size. Pieces of a length are used up by rank: first the combinations, then the residual."""

    window: int
    runs: dict[int, list[tuple[int, int, int, list[int]]]]  # length: (first rank, items a window, first window, offsets)
    used: dict[int, int]  # length: rank from which pieces are residual
    windows: int  # filled by combinations
    base: dict[int, int]  # power of two: where its pieces begin in the residual stream
    before: dict[int, dict[int, int]]  # power of two: length: pieces of this power from shorter lengths
    residual: int  # size of the residual stream

    def place(self, length: int, rank: int) -> tuple[int, int] | None:
        """(window, offset) of a piece that a combination uses, or None."""
        if rank >= self.used.get(length, 0):
            return None
        for first, each, window, offsets in reversed(self.runs[length]):
            if rank >= first:
                at = rank - first
                return window + at // each, offsets[at % each]
        raise AssertionError("a used piece has a place")

    def cut(self, length: int, rank: int) -> list[tuple[int, int]]:
        """(size, start in the residual stream) of the powers of two into which a residual piece is cut."""
        at = rank - self.used.get(length, 0)
        return [(p, self.base[p] + (self.before[p].get(length, 0) + at) * p) for p in self.base if length & p]


def plan(histogram: dict[int, int], window: int, depth: int) -> Level:
    have = Counter({k: n for k, n in histogram.items() if n > 0})
    options = combinations(window, depth)
    options = [c for c in options if all(k in have for k in c)]
    counts = np.zeros(len(options), np.int64)
    if options:
        lengths = sorted(have)
        row = {k: i for i, k in enumerate(lengths)}
        a = np.zeros((len(lengths), len(options)))
        for j, c in enumerate(options):
            for k in c:
                a[row[k], j] += 1
        total = sum(have.values())
        counts = np.floor(nnls(a, np.array([have[k] / total for k in lengths])) * total + 1e-6).astype(np.int64)
    left, chosen = Counter(have), Counter()
    for wanted in (counts, np.full(len(options), np.iinfo(np.int64).max)):  # rounded down, then as far as it goes
        for j in np.argsort(-counts, kind="stable"):
            need = Counter(options[j])
            n = min([int(wanted[j]), *(left[k] // m for k, m in need.items())])
            if n > 0:
                chosen[options[j]] += n
                for k, m in need.items():
                    left[k] -= n * m
    runs: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    used: Counter = Counter()
    windows = 0
    for c, n in sorted(chosen.items()):
        offsets: dict[int, list[int]] = {}
        at = 0
        for k in c:
            offsets.setdefault(k, []).append(at)
            at += k
        for k, o in offsets.items():
            runs.setdefault(k, []).append((used[k], len(o), windows, o))
            used[k] += n * len(o)
        windows += n
    base, before, at = {}, {}, 0
    p = window // 2
    while p:
        base[p], before[p], n = at, {}, 0
        for k in sorted(have):
            before[p][k] = n
            n += left[k] if k & p else 0
        at += n * p
        p //= 2
    return Level(window, runs, dict(used), windows, base, before, at)


def tokenized(df: DataFrame, vocabulary: str, *, row_id: str = "doc_id", text: str = "text", keep_ids: bool = False, cache_words: int = CACHE_WORDS, at: str | None = None) -> DataFrame:
    """(row_id, n, crcs[, ids][, at]): ids with the end id counted, and the CRC-32 of every piece that packing may cut.

    ``crcs`` are those of the whole windows, the head, the tail, the head's and the tail's powers of two. ``vocabulary`` is the
    path of the vocabulary file on every machine. A null text has the end id only. ``cache_words`` trades memory of the workers
    for time, the result is the same. ``at`` names a column that is kept.
    """
    ship(df.sparkSession)
    fields = [("row_id", pa.int64()), ("n", pa.int64()), ("crcs", pa.list_(pa.int64())), *[("ids", pa.list_(pa.int32()))] * keep_ids, *[("at", pa.int64())] * (at is not None)]
    schema = pa.schema(fields)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        encoder = ids_of(vocabulary, cache_words)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [encoder.of(x.as_py()) + end for x in part.column(1)]
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([[zlib.crc32(x[4 * s : 4 * (s + n)]) for s, n in cuts(len(x) // 4)] for x in ids], pa.list_(pa.int64()))]
                if keep_ids:
                    cols.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                if at is not None:
                    cols.append(part.column(2))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "row_id long, n long, crcs array<long>" + ", ids array<int>" * keep_ids + ", at long" * (at is not None)
    return df.select(F.col(row_id).cast("long"), F.col(text).cast("string"), *([] if at is None else [F.col(at).cast("long")])).mapInArrow(run, ddl)


def _powers(n: int) -> list[int]:
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of every piece that a document of n ids may be cut into, in the order of ``crcs``."""
    full, rest = divmod(n, WINDOW)
    head, tail = rest // UNIT * UNIT, rest % UNIT
    out = [(i * WINDOW, WINDOW) for i in range(full)]
    start = full * WINDOW
    out += [(start, head)] * (head > 0) + [(start + head, tail)] * (tail > 0)
    for at, size in ((start, head), (start + head, tail)):
        for p in _powers(size):
            out.append((at, p))
            at += p
    return out


def _last_sequences(total: int) -> list[tuple[int, int]]:
    """(start, length) of the sequences of a stream: full windows are left out, the rest is cut at powers of two."""
    at, out = total // WINDOW * WINDOW, []
    for p in _powers(total % WINDOW):
        out.append((at, p))
        at += p
    return out


@dataclass
class Layout:
    """Where the pieces of a histogram's rows go: whole windows, combinations of heads, the stream of what is left."""

    heads: Level
    tails: Level
    first_heads: int  # sequences: whole windows before these
    first_stream: int
    stream_tails: int  # where the tails begin in the stream
    total: int
    last: list[tuple[int, int]]

    @classmethod
    def of(cls, whole: np.ndarray, depths: tuple[int, int]) -> Layout:
        """``whole``: the whole windows, the heads of 0 to 15 units, the tails of 0 to 255 ids."""
        heads = plan({k: int(whole[1 + k]) for k in range(1, UNITS)}, UNITS, depths[0])
        tails = plan({t: int(whole[1 + UNITS + t]) for t in range(1, UNIT)}, UNIT, depths[1])
        stream_tails = heads.residual * UNIT
        total = stream_tails + tails.windows * UNIT + tails.residual
        return cls(heads, tails, int(whole[0]), int(whole[0]) + heads.windows, stream_tails, total, _last_sequences(total))

    def in_stream(self, at: int) -> tuple[int, int]:
        if self.last and at >= self.last[0][0]:
            i = max(i for i, (s, _) in enumerate(self.last) if s <= at)
            return self.first_stream + self.total // WINDOW + i, at - self.last[i][0]
        return self.first_stream + at // WINDOW, at % WINDOW

    def pieces(self, full: int, head: int, tail: int, full_rank: int, head_rank: int, tail_rank: int) -> Iterator[tuple[int, int] | None]:
        """(sequence, offset) of each used piece in the order of ``cuts``; None for a piece that is used cut or uncut instead."""
        yield from ((full_rank + i, 0) for i in range(full))
        parts: list[tuple[int, int] | None] = []
        behind = self.stream_tails + self.tails.windows * UNIT
        for level, size, rank, unit in ((self.heads, head, head_rank, UNIT), (self.tails, tail, tail_rank, 1)):
            if not size:
                continue
            at = level.place(size, rank)
            if at is None:
                yield None
                for _, s in level.cut(size, rank):
                    parts.append(self.in_stream(s * UNIT if unit == UNIT else behind + s))
            else:
                yield (self.first_heads + at[0], at[1] * UNIT) if unit == UNIT else self.in_stream(self.stream_tails + at[0] * UNIT + at[1])
                parts += [None] * size.bit_count()
        yield from parts


_PIECES = pa.schema([("row_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("n", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECES_DDL = "row_id long, start long, length long, crc long, n long, sequence_id long, offset long"


def pack(tokens: DataFrame, *, depths: tuple[int, int] = (4, 3), parts: int | None = None, part_rows: int = 1 << 11, most_parts: int = 1 << 14, seed: int = 11) -> DataFrame:
    """Pieces of all documents of ``tokens`` (written rows as ``tokenized`` gives them, whose ids may be left out).

    Gives row_id, start, length, crc (null if ``tokens`` has no crcs), n, sequence_id, offset: each id lies in one piece, pieces of a
    sequence lie gapless from 0, a sequence holds 4096 ids or a power of two. Null and repeated row ids are packed like
    others; an empty table gives no piece. Rows are ranked in parts of about ``part_rows`` rows, larger ones only above ``most_parts`` of
    these; rows alike in id and ids are parted by the files they lie in.
    """
    spark = tokens.sparkSession
    ship(spark)
    parts = parts or min(most_parts, max(1, -(-tokens.count() // part_rows)))
    rest = F.col("n") % WINDOW
    rows = tokens.select("row_id", "n", "crcs").withColumns({"full": F.floor(F.col("n") / WINDOW).cast("long"), "head": F.floor(rest / UNIT).cast("int"), "tail": (rest % UNIT).cast("int")})
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row_id", "n", "crcs", F.input_file_name()), F.lit(parts)).cast("int"))
    # At most ``parts`` times 255 + 15 + 1 sums, whatever the input.
    sums = rows.groupBy("part", "head", "tail").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f"))
    sums = sums.selectExpr("part", "stack(3, 0, 0, f, 1, head, c, 2, tail, c) as (kind, size, c)")
    sums = sums.groupBy("part", "kind", "size").agg(F.sum("c").alias("c")).toArrow()
    before = np.zeros((parts, UNITS + UNIT + 1), np.int64)
    col = np.array([0, 1, 1 + UNITS])[sums.column("kind").to_numpy()] + sums.column("size").to_numpy()
    np.add.at(before, (sums.column("part").to_numpy(), col), sums.column("c").to_numpy())
    whole = before.sum(axis=0)
    offsets = spark.sparkContext.broadcast(np.cumsum(before, axis=0) - before)  # at most ``most_parts`` times 273 numbers

    own = Window.partitionBy("part")
    order = ["row_id", "n", "crcs"]
    rows = rows.withColumn("full_rank", F.coalesce(F.sum("full").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("head_rank", F.row_number().over(Window.partitionBy("part", "head").orderBy(*order)) - 1)
    rows = rows.withColumn("tail_rank", F.row_number().over(Window.partitionBy("part", "tail").orderBy(*order)) - 1)

    layout = Layout.of(whole, depths)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("part", "n", "full", "head", "tail", "full_rank", "head_rank", "tail_rank")
        for b in batches:
            at = {name: b.column(b.schema.get_field_index(name)).to_pylist() for name in names}
            ids, crcs = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("row_id", "crcs"))
            out: list[list] = [[] for _ in _PIECES]
            for i, (part, n, full, head, tail, fr, hr, tr) in enumerate(zip(*(at[name] for name in names))):
                own = offsets.value[part]
                found = layout.pieces(full, head, tail, fr + int(own[0]), hr + int(own[1 + head]), tr + int(own[1 + UNITS + tail]))
                for j, ((start, length), to) in enumerate(zip(cuts(n), found, strict=True)):
                    if to is not None:
                        for x, v in zip(out, (ids[i], start, length, crcs[i][j] if crcs[i] else None, n, *to)):
                            x.append(v)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _PIECES)], schema=_PIECES)
                    out = [[] for _ in _PIECES]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, _PIECES)], schema=_PIECES)

    return rows.mapInArrow(run, _PIECES_DDL)


def pack_in_order(tokens: DataFrame, *, run_rows: int = 1 << 12, depths: tuple[int, int] = (4, 3)) -> DataFrame:
    """Pieces as of ``pack``, with the sequences in the order of ``at``, the gapless place of each row of ``tokens`` from 0.

    Every run of ``run_rows`` rows is planned and packed by itself, in one task: all its sequences come before those of the next
    run, and within a run a sequence comes by its earliest piece. At the end of a run are up to 12 sequences of powers of two.
    """
    spark = tokens.sparkSession
    ship(spark)
    rows = tokens.select("row_id", "n", "crcs", "at", F.floor(F.col("at") / run_rows).cast("long").alias("run"))
    # One number for each run; a run's sequences are full but for the powers of two of what is left.
    sums = {r.run: r.n for r in rows.groupBy("run").agg(F.sum("n").alias("n")).collect()}
    firsts, at = {}, 0
    for run in sorted(sums):
        firsts[run] = at
        at += sums[run] // WINDOW + (sums[run] % WINDOW).bit_count()
    shared = spark.sparkContext.broadcast(firsts)

    def pack_run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        ids, lengths, crcs = (group.column(x).to_pylist() for x in ("row_id", "n", "crcs"))
        cut = [(n // WINDOW, n % WINDOW // UNIT, n % UNIT) for n in lengths]
        whole = np.zeros(1 + UNITS + UNIT, np.int64)
        ranks = []
        for full, head, tail in cut:
            ranks.append((int(whole[0]), int(whole[1 + head]), int(whole[1 + UNITS + tail])))
            whole[[0, 1 + head, 1 + UNITS + tail]] += (full, 1, 1)
        layout = Layout.of(whole, depths)
        first, order = shared.value[group.column("run")[0].as_py()], {}
        out: list[list] = [[] for _ in _PIECES]
        for i, n in enumerate(lengths):
            for j, ((start, length), to) in enumerate(zip(cuts(n), layout.pieces(*cut[i], *ranks[i]), strict=True)):
                if to is not None:
                    sequence = first + order.setdefault(to[0], len(order))
                    for x, v in zip(out, (ids[i], start, length, crcs[i][j] if crcs[i] else None, n, sequence, to[1])):
                        x.append(v)
        return pa.table([pa.array(x, t.type) for x, t in zip(out, _PIECES)], schema=_PIECES)

    return rows.groupBy("run").applyInArrow(pack_run, _PIECES_DDL)


def sequences(pieces: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>): the token sequences, from ``tokens`` with ids; row ids have to be unique and not null."""
    own = pieces.join(tokens.select("row_id", "ids"), "row_id")
    own = own.select("sequence_id", F.struct("offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids")).alias("piece"))
    return own.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))


def pack_documents(df: DataFrame, vocabulary: str, *, row_id: str = "doc_id", text: str = "text", cache_words: int = CACHE_WORDS, in_order: bool = False, **options) -> DataFrame:
    """Tokenize and pack all rows of ``df``; see ``pack``. The narrow token table is written once to the shared folder.

    ``in_order``: the sequences follow the rows (of files: in the order of their names); see ``pack_in_order``.
    """
    if in_order:
        (at,) = fresh(df, "_at")
        return pack_in_order(written(tokenized(placed(df, at), vocabulary, row_id=row_id, text=text, cache_words=cache_words, at=at), "tokens"), **options)
    return pack(written(tokenized(df, vocabulary, row_id=row_id, text=text, cache_words=cache_words), "tokens"), **options)
