"""Where Python workers find this package, and names for working columns."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver has it (a cluster ships it with --py-files)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


#: Rows that stay in one task, and rows of a task where more than that are spread.
FEW_ROWS, TASK_ROWS = 10_000, 100_000


def spread(df: DataFrame) -> DataFrame:
    """The rows of a scan in as many parts as their number asks for, if the scan is a few long tasks.

    A scan is cut by bytes and never inside of a row group: a million short rows may be one task, in which a message made of each takes hours.
    """
    counts = [r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    rows, cores = sum(counts), df.sparkSession.sparkContext.defaultParallelism
    if max(counts, default=0) <= max(FEW_ROWS, min(rows / cores * 1.5, 10 * TASK_ROWS)):
        return df
    return df.repartition(max(min(cores, -(-rows // FEW_ROWS)), -(-rows // TASK_ROWS)))


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
