"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut in two halves, each with its own codebook; the pairs of codes are the cells of a product grid, and every
vector lies in the cell of its two nearest codes. A search walks the cells by rising distance (the sum of the squared
distances of the halves to the cell's codes). In the two sorted code lists the cells walked so far form a staircase,
so the walk up to a distance is found by a search in one list for each entry of the other. It goes as far beyond the own
cell as the target recall needs for links at the threshold, measured on a bounded sample and its own links, and compares with every vector in the cells it meets.

A pair is found when either of the two walks meets the other's cell, and is counted once: both know whether the other's walk
met them. Exact copies are one class. Cells are split into blocks of bounded size on both sides, each pair of blocks is
compared as one matrix product, and a block gives link counts and one edge to the smallest linked vector instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xmlframe.llm.common import components, ship, written

HOME_BLOCK, WALK_BLOCK = 512, 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are scaled by powers of two first, which is exact, so no square over- or underflows."""
    x = np.asarray(vectors, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)[None, :]


def codebook(x: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means from a seeded choice of rows; a code that loses all its rows stays where it is."""
    codes = x[np.random.default_rng(seed).choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_apart(x[at : at + 4096], codes).argmin(axis=1) for at in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, own, x)
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    slack: float = 0.0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _apart(x[:, :half], self.first), _apart(x[:, half:], self.second)

    def homes(self, d: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return d[0].argmin(axis=1) * len(self.second) + d[1].argmin(axis=1)

    def reach(self, d: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return d[0].min(axis=1) + d[1].min(axis=1) + self.slack

    def walk(self, a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
        """Cells within ``reach`` of one vector, given its distances to both codebooks."""
        order_a, order_b = a.argsort(kind="stable"), b.argsort(kind="stable")
        steps = np.searchsorted(b[order_b], reach - a[order_a], side="right")
        rows = np.repeat(order_a, steps)
        cols = order_b[np.arange(len(rows)) - np.repeat(np.cumsum(steps) - steps, steps)]
        return rows * len(self.second) + cols


def _beyond(index: Index, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far beyond its own cell the nearer of the two walks of each pair has to go to meet the other's."""
    beyond = []
    for at in range(0, len(a), 1024):
        da, db = index.distances(a[at : at + 1024]), index.distances(b[at : at + 1024])
        ways = []
        for d, e in ((da, db), (db, da)):
            home = index.homes(e)
            rows = np.arange(len(home))
            ways.append(d[0][rows, home // len(index.second)] + d[1][rows, home % len(index.second)] - (index.reach(d) - index.slack))
        beyond.append(np.minimum(*ways))
    return np.concatenate(beyond)


def _neighbours(sample: np.ndarray, threshold: float, pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of the sample the ``pairs`` links nearest the threshold (rows a, rows b), and each row's nearest other row."""
    nearest = np.zeros(len(sample), np.int64)
    a, b, c = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
    for at in range(0, len(sample), 512):
        cosines = sample[at : at + 512] @ sample.T
        rows = np.arange(len(cosines))
        cosines[rows, at + rows] = -2.0
        nearest[at : at + 512] = cosines.argmax(axis=1)
        i, j = np.nonzero((cosines >= threshold) & (np.arange(len(sample)) > at + rows[:, None]))
        a, b, c = np.concatenate((a, at + i)), np.concatenate((b, j)), np.concatenate((c, cosines[i, j]))
        if len(c) > pairs:
            few = np.argpartition(c, pairs)[:pairs]
            a, b, c = a[few], b[few], c[few]
    return a, b, nearest


def build(sample: np.ndarray, codes: int, threshold: float, recall: float, seed: int, pairs: int = 4000) -> Index:
    """Codebooks on the sample's halves, and the slack that reaches the recall for the hardest of four kinds of links.

    These are the sample's own links nearest the threshold, and vectors at exactly the threshold from sample vectors: in random
    directions, in directions drawn with the sample's covariance, and towards the nearest other vector of the sample. Data
    near a subspace vary where the codebooks do, so their links go farther than random directions tell.
    """
    half = sample.shape[1] // 2
    index = Index(codebook(sample[:, :half], codes, seed), codebook(sample[:, half:], codes, seed + 1))
    rng = np.random.default_rng(seed + 2)
    at = rng.integers(0, len(sample), pairs)
    a = sample[at]
    first, second, nearest = _neighbours(sample, threshold, pairs)
    kinds = [(sample[first], sample[second])]
    centred = sample - sample.mean(axis=0)
    drawn = rng.normal(size=(pairs, len(a[0]))) @ np.linalg.cholesky(centred.T @ centred / len(sample) + 1e-12 * np.eye(len(a[0]))).T
    for side in (rng.normal(size=a.shape), drawn, sample[nearest[at]]):
        side = side - (side * a).sum(axis=1, keepdims=True) * a
        fine = (side * side).sum(axis=1) > 1e-18
        kinds.append((a[fine], threshold * a[fine] + math.sqrt(1 - threshold**2) * unit(side[fine])))
    index.slack = max(float(np.quantile(_beyond(index, x, y), recall)) for x, y in kinds if len(x)) + 1e-9
    return index


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(home: pa.Table, walk: pa.Table, index: Index, threshold: float) -> tuple[list, list, list]:
    """(id, copies linked, smallest linked id or itself) of one block against another."""
    h, q = (unit(np.stack(t.column("vector").to_numpy())) for t in (home, walk))
    hid, qid = (t.column("id").to_numpy() for t in (home, walk))
    hn, qn = (t.column("copies").to_numpy() for t in (home, walk))
    i, j = np.nonzero(q @ h.T >= threshold)
    other = qid[i] != hid[j]
    i, j = i[other], j[other]
    if not len(i):
        return [], [], []
    d = index.distances(h)
    reach, back = index.reach(d), index.homes(index.distances(q))[i]
    met_back = d[0][j, back // len(index.second)] + d[1][j, back % len(index.second)] <= reach[j]
    once = ~met_back | (qid[i] > hid[j])
    i, j = i[once], j[once]
    if not len(i):
        return [], [], []
    ids, place = np.unique(np.concatenate((qid[i], hid[j])), return_inverse=True)
    a, b = place[: len(i)], place[len(i) :]
    links = np.bincount(a, weights=hn[j], minlength=len(ids)) + np.bincount(b, weights=qn[i], minlength=len(ids))
    return ids.tolist(), links.astype(np.int64).tolist(), ids[_roots(len(ids), a, b)].tolist()


def near_duplicates(df: DataFrame, *, row_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.99, sample_rows: int = 8192, per_cell: int = 512, most_codes: int = 2048, seed: int = 3) -> DataFrame:
    """(row_id, n_links, component_id, kept) for every row of ``df``.

    Links join vectors of one length whose cosine in double precision is ``threshold`` or more; none below it is given, and the
    share found is calibrated to ``recall`` or more on a sample, which also trains the codebooks: of at most ``sample_rows`` classes,
    or 16 a code if that is more, so never above 16 x ``most_codes``. Vectors of each length have an index of their own. n_links counts
    the other rows linked directly, exact copies included; component_id is the smallest id reachable, itself included.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing: 0 links, their own id, kept.
    Rows without an id are linked like others but name no component; where no row of one has an id, component_id is null.
    Repeated rows are copies, rows that share an id and differ in their vectors are rows of their own. An empty table
    gives an empty table. Cells grow beyond ``per_cell`` only above ``most_codes`` squared times ``per_cell`` vectors (2 billion).
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(~odd & F.exists("vector", lambda x: x != 0), F.lit(False))
    # A vector of one component is its sign.
    rows = rows.withColumn("vector", F.when(fine, F.when(F.size("vector") == 1, F.transform("vector", lambda x: F.signum(x))).otherwise(F.col("vector"))))
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "embed-classes")
    known = classes.select(F.col("vector").alias("_vector"), "class")
    members = written(rows.join(known, F.col("vector") == F.col("_vector"), "left").select("id", "class"), "embed-members")
    widths = classes.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("size > 1 and n > 1").orderBy("size").collect()
    found = spark.createDataFrame([], "id long, links long, root long")
    for w in widths:  # almost always one
        own = classes.where(F.size("vector") == w["size"]) if len(widths) > 1 else classes
        found = found.union(_search(own, w["n"], threshold, recall, sample_rows, per_cell, most_codes, seed))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "_id")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "embed").withColumnRenamed("node", "_node")
    named = classes.select(F.col("class").alias("_class"), "first_id", "copies").join(links, F.col("_class") == F.col("_id"), "left").join(roots, F.col("_class") == F.col("_node"), "left")
    named = written(named.select("_class", "first_id", "copies", "links", F.coalesce("root", "_class").alias("root")), "embed-named")
    lows = named.groupBy("root").agg(F.min("first_id").alias("low")).withColumnRenamed("root", "_root")
    named = written(named.join(lows, F.col("root") == F.col("_root")).select("_class", "copies", "links", "low"), "embed-components")
    out = members.join(named, F.col("class") == F.col("_class"), "left")
    links = F.when(F.col("class").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("low"))
    return out.select(F.col("id").alias(row_id), links.alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _search(classes: DataFrame, count: int, threshold: float, recall: float, sample_rows: int, per_cell: int, most_codes: int, seed: int) -> DataFrame:
    """(id, links, root) rows of the linked classes (class, vector, copies), vectors of one length: links to other classes, and one of them."""
    spark = classes.sparkSession
    codes = min(most_codes, max(2, math.ceil(math.sqrt(count / per_cell))))
    sample = classes.select("class", "vector").orderBy(F.xxhash64(F.lit(seed), "vector"), "class").limit(max(sample_rows, 16 * codes)).toArrow()
    index = build(unit(np.stack(sample.column("vector").to_numpy())), codes, threshold, recall, seed)
    grid = len(index.first) * len(index.second)

    def distances(table: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return index.distances(unit(np.stack(table.column("vector").to_numpy(zero_copy_only=False))))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = (np.zeros(grid, np.int64) for _ in range(2))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                d = distances(whole.slice(at, 256))
                reach = index.reach(d)
                np.add.at(held, index.homes(d), 1)
                for i in range(len(reach)):
                    met[index.walk(d[0][i], d[1][i], reach[i])] += 1  # a walk meets a cell once
        at = np.flatnonzero(held + met)
        for part in np.array_split(at, max(1, len(at) >> 16)):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(part, pa.int64()), "held": pa.array(held[part], pa.int64()), "met": pa.array(met[part], pa.int64())})

    # One row a cell, at most ``most_codes`` squared.
    sums = classes.select("vector").mapInArrow(tally, "cell long, held long, met long").groupBy("cell").agg(F.sum("held").alias("held"), F.sum("met").alias("met")).toArrow()
    held, met = (np.zeros(grid, np.int64) for _ in range(2))
    held[sums.column("cell").to_numpy()], met[sums.column("cell").to_numpy()] = sums.column("held").to_numpy(), sums.column("met").to_numpy()
    # How many blocks a cell has on either side, none where one of them is empty: two numbers a cell.
    both = (held > 0) & (met > 0)
    blocks = spark.sparkContext.broadcast(tuple(np.where(both, -(-n // size), 0).astype(np.int32) for n, size in ((held, HOME_BLOCK), (met, WALK_BLOCK))))
    schema = pa.schema([("cell", pa.int64()), ("hb", pa.int64()), ("wb", pa.int64()), ("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("copies", pa.int64())])
    ddl = "cell long, hb long, wb long, id long, vector array<double>, copies long"

    def spans(n: np.ndarray) -> np.ndarray:
        """0 to n - 1 for each of the counts, end to end."""
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    def dealt(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home_blocks, walk_blocks = blocks.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    d, salt = distances(b), b.column("salt").to_numpy()
                    if kind == "home":
                        home = index.homes(d)
                        n = walk_blocks[home]
                        take = np.repeat(np.arange(b.num_rows), n)
                        cell, hb, wb = home[take], salt[take] % np.maximum(1, home_blocks[home[take]]), spans(n)
                    else:
                        reach = index.reach(d)
                        walks = [index.walk(d[0][i], d[1][i], reach[i]) for i in range(b.num_rows)]
                        row, met_cells = np.repeat(np.arange(b.num_rows), [len(w) for w in walks]), np.concatenate(walks)
                        n = home_blocks[met_cells]
                        take, cell, hb = np.repeat(row, n), np.repeat(met_cells, n), spans(n)
                        wb = salt[take] % np.maximum(1, walk_blocks[cell])
                    own = b.select(["class", "vector", "copies"]).take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (cell, hb, wb)), *own.columns], schema=schema)

        return classes.select("class", "vector", "copies", F.abs(F.xxhash64("class") % 1_000_003).alias("salt")).mapInArrow(run, ddl)

    def compare(home: pa.Table, walk: pa.Table) -> pa.Table:
        got = _compare(home, walk, index, threshold) if home.num_rows and walk.num_rows else ([], [], [])
        return pa.table([pa.array(x, pa.int64()) for x in got], names=["id", "links", "root"])

    keys = ("cell", "hb", "wb")
    return written(dealt("home").groupBy(*keys).cogroup(dealt("walk").groupBy(*keys)).applyInArrow(compare, "id long, links long, root long"), "embed-links")
