"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; row r of n gets the fractional rank (r + 1/2) / n. Sorting
all rows by it interleaves the sources in proportion everywhere, and cutting the sorted sequence into equal runs
gives shards that all hold the same mixture and differ by at most one row.

Neither sort passes through one task: ranks within a source are taken over (source, leading bits of the hash), and
the overall position over equal slices of the fractional rank, each with the counts of what comes before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xmlframe.llm.common import bits_for, fresh, key_of, ranked


def stratified_shards(df: DataFrame, shards: int, *, row_id: str = "doc_id", source: str = "source", ties: Sequence[str] = (), seed: int = 17, slice_rows: int = 1 << 16) -> DataFrame:
    """Add ``shard`` int (0 to shards-1) and ``slot`` long (gapless from 0 within the shard) to the rows of ``df``.

    Shard sizes differ by at most one row, and each source's share of a shard by about one row from its share of
    the whole. A null source is a source of its own; null ids hash like any value; repeated rows are placed one by one;
    ``ties`` are hashed with the id and order rows with equal ids. An empty table gives an empty table. Columns of ``df`` with
    these two names are replaced, all others are kept whatever they are called. Parts and slices hold about ``slice_rows``
    rows whatever the input; only rows alike in id and ``ties`` can't be parted.
    """
    df = df.drop("shard", "slot")
    own, hash_col, rank, size, frac, piece, inside, s, before, every, at = fresh(df, "_source", "_hash", "_rank", "_size", "_frac", "_slice", "_in", "_s", "_before", "_all", "_at")
    total = df.count()
    slices = max(1, -(-total // slice_rows))
    df = df.withColumns({own: key_of(source), hash_col: F.xxhash64(F.lit(seed), F.col(row_id), *ties)})
    df = ranked(df, own, hash_col, [row_id, *ties], rank, size, bits_for(total, min(slice_rows, 1 << 13)))
    df = df.withColumn(frac, (F.col(rank) + 0.5) / F.col(size))
    df = df.withColumn(piece, F.floor(F.col(frac) * slices).cast("int"))
    # One row for each ``slice_rows`` rows of the input, three numbers each: small enough to order in one task and to broadcast.
    earlier = Window.orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(F.col(piece).alias(s)).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(s, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(before), F.lit(total).cast("long").alias(every))
    df = df.withColumn(inside, F.row_number().over(Window.partitionBy(piece).orderBy(frac, own, hash_col, row_id, *ties)) - 1)
    df = df.join(F.broadcast(counts), F.col(piece) == F.col(s)).withColumn(at, F.col(before) + F.col(inside))
    df = df.withColumn("shard", F.expr(f"cast((`{at}` * {shards}) div `{every}` as int)"))
    df = df.withColumn("slot", F.expr(f"`{at}` - ((shard * `{every}` + {shards - 1}) div {shards})"))
    return df.drop(own, hash_col, rank, size, frac, piece, inside, s, before, every, at)
