"""What several operators share: the shared folder, written tables, ranks without one large task, components.

Everything written here goes to the folder that ``spark.checkpoint.dir`` names, so a lost executor loses nothing
that a later stage needs.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import json
import math
import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster ships it with --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def tidy() -> None:
    """Give memory that earlier stages have used and freed in this Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where none is named."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="xmlframe-")
        _until_the_end(spark, named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/xmlframe-{tag}-{uuid.uuid4().hex}"


_left: dict[str, SparkSession] = {}


def _sweep() -> None:
    """Delete what this application wrote to the shared folder and has not deleted yet."""
    for path, spark in _left.items():
        try:
            _file_system(spark, path).delete(_hadoop_path(spark, path), True)
        except Exception:  # the JVM has gone before: nothing can be done
            return


def _until_the_end(spark: SparkSession, path: str) -> None:
    if not _left:
        atexit.register(_sweep)  # after the gateway's own, so it runs before that one
    _left[path] = spark


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut, nothing is computed twice.

    The folder goes when the application ends, or before that by ``forget``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    _until_the_end(spark, path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def put(spark: SparkSession, data: bytes, tag: str) -> str:
    """A file of these bytes in the shared folder; gives its path."""
    path = fresh_path(spark, tag)
    fs = _file_system(spark, path)
    _until_the_end(spark, path)
    stream = fs.create(_hadoop_path(spark, path))
    stream.write(bytearray(data))
    stream.close()
    return path


def put_parts(spark: SparkSession, lines: Iterable[str], tag: str, each: int = 4 << 20) -> str:
    """A folder in the shared one with files of about ``each`` characters of these lines, of which no more is held at once."""
    path = fresh_path(spark, tag)
    fs = _file_system(spark, path)
    _until_the_end(spark, path)
    lines, n, more = iter(lines), 0, True
    while more:
        own, size = [], 0
        while size < each and (more := (line := next(lines, None)) is not None):
            own.append(line)
            size += len(line)
        stream = fs.create(_hadoop_path(spark, f"{path}/part-{n:05}"))
        stream.write(bytearray("".join(own).encode()))
        stream.close()
        n += 1
    return path


def forget(df: DataFrame) -> None:
    """Delete the folder of a written table that nothing reads any more."""
    path = df._written_to
    _file_system(df.sparkSession, path).delete(_hadoop_path(df.sparkSession, path), True)
    _left.pop(path, None)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def placed(df: DataFrame, out: str) -> DataFrame:
    """Add the gapless place of each row from 0: by the names of the files that ``df`` is read from, then by row in the file.

    What isn't read straight from files is written first, its partitions one file each.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = written(df, "placed-rows")
    spark = df.sparkSession
    path, row, key, before = fresh(df, "_path", "_row", "_key", "_before")
    df = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    # One row for each file. Part numbers of more than five digits make names longer.
    counts = sorted((len(r[0]), r[0], r[1]) for r in df.groupBy(path).agg(F.count(F.lit(1))).collect())
    firsts = itertools.accumulate((n for *_, n in counts), initial=0)
    lines = (json.dumps({key: name, before: first}) + "\n" for (_, name, _), first in zip(counts, firsts))
    table = spark.read.schema(f"`{key}` string, `{before}` long").json(put_parts(spark, lines, "placed-files"))
    df = df.join(F.broadcast(table), F.col(path) == F.col(key))
    return df.withColumn(out, F.col(before) + F.col(row)).drop(path, row, key, before)


def spread(df: DataFrame, each: int) -> DataFrame:
    """A written table dealt to as many tasks as it has ``each`` rows, and at least one a core: small rows may stand for much work."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each)))


def bits_for(rows: int, each: int = 1 << 13) -> int:
    """How many leading bits of a hash cut so many rows into parts of about ``each``."""
    return min(30, max(0, math.ceil(math.log2(max(1, rows) / each))))


def key_of(name: str) -> Column:
    """A non-null grouping key of a nullable column: null and the empty string stay apart."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(name).cast("string")))


def ranked(df: DataFrame, group: str, hash_col: str, ties: Sequence[str], out: str, size: str, bits: int, more: DataFrame | None = None) -> DataFrame:
    """Add the 0-based rank of each row within its group in hash order, and the group's row count.

    A group may hold most of all rows: its rows are dealt by (group, leading ``bits`` of the hash), ranked there, and
    the counts of the earlier parts of the group are added. No task sees a whole group; ``bits_for`` the row count bounds a part.
    The first column of ``more`` is a group, of which each has one row there; its further columns are added.
    """
    part, g, p, before = fresh(df, "_part", "_g", "_p", "_before")
    df = df.withColumn(part, F.shiftrightunsigned(F.shiftrightunsigned(F.col(hash_col), 63 - bits), 1))
    counts = df.groupBy(group, part).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)
    counts = counts.select(
        F.col(group).alias(g),
        F.col(part).alias(p),
        F.coalesce(F.sum("_n").over(own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before),
        F.sum("_n").over(own).alias(size),
    )
    if more is not None:
        counts = counts.join(more, F.col(g) == F.col(more.columns[0])).drop(more.columns[0])
    inside = Window.partitionBy(group, part).orderBy(hash_col, *ties)
    df = df.withColumn(out, F.row_number().over(inside) - 1)
    df = df.join(counts, (F.col(group) == F.col(g)) & (F.col(part) == F.col(p)))
    return df.withColumn(out, F.col(out) + F.col(before)).drop(part, g, p, before)


def _larger_to_smaller(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star_round(edges: DataFrame) -> DataFrame:
    """One step towards stars: every node hands its larger neighbours, then its smaller ones, to the smallest it knows.

    Both keep what is connected connected. Hubs meet their minimum in plain equi-joins, which adaptive execution splits.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).withColumnRenamed("a", "u")
    handed = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    low = handed.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "u")
    met = handed.join(low, F.col("a") == F.col("u"))
    pair = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
    return met.select(F.explode(pair).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row per node of an edge to another, (node, root), root the smallest node reachable.

    Rounds of stars until every node hangs on a root that hangs on nothing. Distances shrink by half or more in a round, so a
    chain of 10,000 nodes takes 14. Each round writes one table of at most as many rows as there are distinct edges and deletes
    the one before. There is no cap on rounds.
    """
    now = written(_larger_to_smaller(edges), tag)
    while True:
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if open_ends.isEmpty():
            break
        now, old = written(_star_round(now), tag), now
        forget(old)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
