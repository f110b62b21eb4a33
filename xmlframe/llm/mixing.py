"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Rows of a source are shuffled by a seeded hash and cut into blocks. Were all sources served at once, each at its weight, then
block j of a source would be served from time t(j / w) to t((j + 1) / w), where t(v) is the sum over the sources of the lesser of
v w and all their blocks: a source that ends leaves the others scaled up. The block may start at that time rounded down and
must end by that time rounded up, in slots of one block each. Earliest deadline first over the released blocks meets every
deadline, so after any number of slots each source has had its share to within less than one block.

Releases and deadlines are computed from the exact weights in integers, so nothing drifts however many rows there are. Whose
block is next is worked out on the driver, in time that grows with the blocks and in memory that grows with the classes of
sources alike in size and weight; the plan goes to the shared folder as it is made. Nothing depends on the size of the
input. Every row is placed exactly once: none is dropped or repeated.
"""

from __future__ import annotations

import heapq
import json
import math
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.llm.common import bits_for, fresh, key_of, put_parts, ranked, written


class _Fluid:
    """t(v) for classes of alike sources (blocks, whole weight, sources), exactly: v is given as a fraction a / b."""

    def __init__(self, classes: Sequence[tuple[int, int, int]]) -> None:
        self.ends = sorted((Fraction(n, w), n * m, w * m) for n, w, m in classes)
        self.near = [float(e) for e, _, _ in self.ends]
        self.done, self.rate = [0], [sum(w for _, _, w in self.ends)]
        for _, n, w in self.ends:
            self.done.append(self.done[-1] + n)
            self.rate.append(self.rate[-1] - w)

    def at(self, a: int, b: int) -> tuple[int, int]:
        """t(a / b), rounded down and up."""
        i = bisect_right(self.near, a / b)
        while i < len(self.ends) and self.ends[i][0].numerator * b <= a * self.ends[i][0].denominator:
            i += 1
        while i and self.ends[i - 1][0].numerator * b > a * self.ends[i - 1][0].denominator:
            i -= 1
        low, rest = divmod(self.done[i] * b + self.rate[i] * a, b)
        return low, low + (rest > 0)


def _earliest(classes: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(class, first place, places, slot): earliest deadline first among the released blocks, in runs of slots.

    Block j of source i of a class of m sources has the place j m + i. Alike sources have equal deadlines, so a class takes
    its places in order, without a gap.
    """
    fluid = _Fluid(classes)
    ready: list[tuple[int, int, int, int, int]] = []  # deadline, class, block, sources served, release of the block behind it
    for c, (_, w, _) in enumerate(classes):
        release, deadline = fluid.at(1, w)
        ready.append((deadline, c, 0, 0, release))
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int]] = []
    t = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            _, c, j = heapq.heappop(waiting)
            release, deadline = fluid.at(j + 1, classes[c][1])
            heapq.heappush(ready, (deadline, c, j, 0, release))
        deadline, c, j, i, release = heapq.heappop(ready)
        n, _, m = classes[c]
        run = min(m - i, waiting[0][0] - t) if waiting else m - i
        yield c, j * m + i, run, t
        t += run
        if i + run < m:
            heapq.heappush(ready, (deadline, c, j, i + run, release))
        elif j + 1 < n:
            heapq.heappush(waiting, (release, c, j + 1))


def _whole(weights: Sequence[float]) -> list[int]:
    """Whole numbers in exactly the proportion of these."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact))
    return [int(w * unit) for w in exact]


def schedule(slots: Mapping[str, int]) -> list[tuple[str, int]]:
    """One cycle in which each key has its slots: (key, block of that key) for each."""
    own = placed(slots, slots)
    return [x for _, x in sorted((t, (k, j)) for k, at in own.items() for j, t in enumerate(at))]


def placed(blocks: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, array]:
    """The slots of each key's blocks in order, by the exact weights."""
    alike: dict[tuple[int, float], list[str]] = {}
    for k in sorted(k for k, n in blocks.items() if n > 0):
        alike.setdefault((blocks[k], weights[k]), []).append(k)
    out = {k: array("q") for own in alike.values() for k in own}
    keys = list(alike.values())
    classes = [(n, w, len(own)) for (n, _), w, own in zip(alike, _whole([w for _, w in alike]), keys)]
    for c, place, run, t in _earliest(classes):
        for x in range(run):
            out[keys[c][(place + x) % len(keys[c])]].append(t + x)
    return out


def _slots(classes: Sequence[tuple[int, int, int]], cycle: int) -> Iterator[tuple[int, int, list[int]]]:
    """(class, chunk, slots of its ``cycle`` places): at most one open chunk of each class is held."""
    held, chunk = [array("q") for _ in classes], [0] * len(classes)
    for c, _, run, t in _earliest(classes):
        while run:
            n = min(run, cycle - len(held[c]))
            held[c].extend(range(t, t + n))
            run, t = run - n, t + n
            if len(held[c]) == cycle:
                yield c, chunk[c], held[c].tolist()
                held[c], chunk[c] = array("q"), chunk[c] + 1
    yield from ((c, chunk[c], own.tolist()) for c, own in enumerate(held) if own)


def _table(spark: SparkSession, rows: Iterable[dict], ddl: str, tag: str) -> DataFrame:
    """Rows of a plan as JSON files in the shared folder, read by Spark."""
    return spark.read.schema(ddl).json(put_parts(spark, (json.dumps(r) + "\n" for r in rows), tag))


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, *, power: float = 0.5, row_id: str = "doc_id", source: str = "source", ties: Sequence[str] = (), block: int = 16, cycle: int = 1000, seed: int = 23, most_blocks: int | None = None, most_sources: int | None = None) -> DataFrame:
    """Add ``mix_block`` (block of the source), ``mix_slot`` (the block's slot) and ``mix_position`` (order of all rows).

    ``weights`` gives each source's target; where it is None a source of n rows gets n to the power ``power``. Sources
    that ``weights`` does not name share the smallest given weight. A null source is a source of its own. Positions
    rise without repetition; they skip the free places at the end of a source's last block. A block has ``block`` rows and
    each source is scheduled by itself, however many there are. Only who gives bounds gets a coarser mixture above them:
    blocks that grow with the rows over ``most_blocks``, and of more than ``most_sources`` sources those whose names share one
    of so many hashes as one source with the sum of their weights. ``cycle`` blocks are one row of the plan. Null ids hash
    like any value, ``ties`` order rows with equal ids, an empty table gives an empty table. Columns of ``df`` with
    the new names are replaced, all others are kept whatever they are called.
    """
    spark: SparkSession = df.sparkSession
    df = df.drop("mix_block", "mix_slot", "mix_position")
    own, hash_col, rank, size, key, chunk, slots, target, name, kind, member, members, place = fresh(df, "_source", "_hash", "_rank", "_size", "_k", "_chunk", "_slots", "_target", "_name", "_kind", "_member", "_members", "_place")
    counts = written(df.groupBy(key_of(source).alias(own)).agg(F.count(F.lit(1)).alias("n")), "mixing-counts")
    if weights:
        named = {("n" if k is None else f"v{k}"): float(w) for k, w in weights.items() if w > 0}
        given = _table(spark, ({key: k, target: w} for k, w in named.items()), f"`{key}` string, `{target}` double", "mixing-weights")
        counts = counts.join(given, F.col(own) == F.col(key), "left").select(own, "n", F.coalesce(target, F.lit(min(named.values(), default=1.0))).alias("w"))
    else:
        counts = counts.withColumn("w", F.pow("n", F.lit(power)))
    found = counts.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    group = F.col(own)
    if most_sources is not None and found.sources > most_sources:
        group = F.concat(F.lit("h"), F.pmod(F.xxhash64(own), F.lit(most_sources)))
        counts = counts.groupBy(group.alias(own)).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    if most_blocks is not None:
        block = max(block, -(-found.total // most_blocks))
    # Sources alike in blocks and weight are a class: the driver plans for classes, a source has its rank there.
    counts = counts.withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    counts = counts.select(F.col(own).alias(name), "blocks", "w", F.concat_ws(" ", "blocks", "w").alias(kind), F.xxhash64(own).alias("h"))
    sources = written(ranked(counts, kind, "h", [name], member, members, bits_for(found.sources)), "mixing-sources")
    # At most as many rows as source sizes differ, the square root of twice the rows, if the weights don't.
    alike = sources.groupBy(kind, "blocks", "w").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("m")).collect()
    alike.sort(key=lambda r: r.first)
    classes = [(r.blocks, w, r.m) for r, w in zip(alike, _whole([r.w for r in alike]))]
    rows = ({key: alike[c][kind], chunk: i, slots: at} for c, i, at in _slots(classes, cycle))
    table = _table(spark, rows, f"`{key}` string, `{chunk}` long, `{slots}` array<long>", "mixing-slots")
    df = df.withColumns({own: key_of(source), hash_col: F.xxhash64(F.lit(seed), F.col(row_id), *ties)}).withColumn(own, group)
    df = ranked(df, own, hash_col, [row_id, *ties], rank, size, bits_for(found.total), sources.select(name, kind, member, members))
    df = df.withColumn("mix_block", F.floor(F.col(rank) / block).cast("long")).withColumn(place, F.col("mix_block") * F.col(members) + F.col(member))
    df = df.join(table, (F.col(kind) == F.col(key)) & (F.floor(F.col(place) / cycle).cast("long") == F.col(chunk)))
    df = df.withColumn("mix_slot", F.get(slots, (F.col(place) % cycle).cast("int")))
    df = df.withColumn("mix_position", F.col("mix_slot") * block + F.col(rank) % block)
    return df.drop(own, hash_col, rank, size, key, chunk, slots, kind, member, members, place)
