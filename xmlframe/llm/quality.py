"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating has ordered grades 0 to K. All grades share one score z, the sum of the weights of a text's hashed features, and
K ordered thresholds cut it: P(grade <= k) = sigmoid(threshold k - z). The model gives the expected grade and tail
probabilities P(grade >= k), by which documents are selected.

Features are the distinct words of the whole text (lower-cased, outer punctuation off), their prefixes of four to six
characters, once more those that two or more distinct words share, and a few bucketed measures of its style, hashed to ``bits`` bits. Weights are fitted on the driver on at most ``sample_rows`` labelled rows, chosen by a hash of
their ids; features of fewer than ``least_rows`` of these get no weight, nor do words and prefixes whose rows
are graded like all others (``least_z`` standard deviations at no grade), so the model is as bounded as the sample.
Scoring reads every document once, where it lies.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xmlframe.llm.common import fresh, ship

_EDGE = ".,;:!?\"'()[]{}<>|«»„“”…"
_LETTER, _UPPER, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
for _c in b"#$%&*+/<=>@\\^_`|~!":
    _MARK[_c] = True
_REPEAT = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)


def _bucket(x: float, steps: int = 4) -> int:
    """Buckets that get narrower towards zero."""
    return round(steps * math.log2(1 + 255 * min(1.0, max(0.0, x))) / 2)


def features(text: str | None, bits: int) -> list[int]:
    """Distinct hashed features of a text, its style above 2**bits; a null text is empty."""
    text = text or ""
    mask = (1 << bits) - 1
    words = text.lower().split()
    kinds = {w.strip(_EDGE) for w in set(words)}
    kinds.discard("")
    out = {zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in kinds}
    stems = Counter(w[:k] for w in kinds for k in PREFIXES if len(w) >= k)
    for stem, n in stems.items():
        own = zlib.crc32(b"\x01" + stem.encode("utf-8", "surrogatepass"))
        out.add(own & mask)
        if n > 1:
            out.add(zlib.crc32(b"\x02", own) & mask)
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, int(data.sum()))
    lines = [x for x in text.split("\n") if x]
    style = {
        "upper": _bucket(data[_UPPER].sum() / max(1, int(data[_LETTER].sum()))),
        "mark": _bucket(data[_MARK].sum() / n),
        "digit": _bucket(data[_DIGIT].sum() / n),
        "again": _bucket(1 - len(kinds) / max(1, len(words))) if len(words) >= 20 else -1,
        "next": _bucket(sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))),
        "lines": _bucket(1 - len(set(lines)) / max(1, len(lines))) if len(lines) >= 3 else -1,
        "long": min(12, len(text) // max(1, len(words))),
    }
    return [*out, *(zlib.crc32(f"{k}\x00{v}".encode()) & mask | mask + 1 for k, v in style.items())]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Sorted hashed features, their weights and the ordered thresholds; no thresholds: nothing could be learned."""

    bits: int
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    _weight: dict[int, float] | None = None

    def score(self, text: str | None) -> float:
        if self._weight is None:
            self._weight = dict(zip(self.keys.tolist(), self.weights.tolist()))
        return math.fsum(filter(None, map(self._weight.get, features(text, self.bits))))

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to K in columns."""
        return _sigmoid(np.asarray(z)[:, None] - self.thresholds[None, :])


def fit(rows: list[list[int]], grades: list[int], **options) -> Model:
    """``fit_flat`` for a list of features for each row."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    return fit_flat(np.fromiter((f for r in rows for f in r), np.int64, int(lengths.sum())), lengths, np.asarray(grades, np.int64), **options)


def fit_flat(flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, *, bits: int, least_rows: int = 4, least_z: float = 0.0, steps: int = 200, rate: float = 0.08, decay: float = 5e-4) -> Model:
    """Maximum likelihood with weight decay by full-batch Adam; deterministic."""
    none = Model(bits, np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    if len(np.unique(y)) < 2:
        return none
    row = np.repeat(np.arange(len(y)), lengths)
    keys, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    kept = count >= least_rows
    if least_z > 0:
        apart = np.zeros(len(keys))
        for k in range(1, int(y.max()) + 1):
            p = float((y >= k).mean())
            if 0 < p < 1:
                above = np.bincount(at, weights=(y >= k)[row], minlength=len(keys))
                apart = np.maximum(apart, np.abs(above - count * p) / np.sqrt(count * p * (1 - p)))
        kept &= (apart >= least_z) | (keys >> bits > 0)
    place = np.cumsum(kept) - 1
    use = kept[at]
    row, col, keys = row[use], place[at[use]], keys[kept].astype(np.int64)
    top, n, m = int(y.max()), len(y), len(keys)
    share = np.clip(np.array([(y <= k).mean() for k in range(top)]), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    gaps = np.concatenate(([t[0]], np.log(np.maximum(np.diff(t), 1e-2))))  # thresholds stay ordered
    w = np.zeros(m)
    decay = np.where(keys >> bits > 0, 0.0, decay)  # every text has its style features: they carry the level, words what departs from it
    state = [np.zeros(m), np.zeros(m), np.zeros(top), np.zeros(top)]
    for step in range(1, steps + 1):
        t = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
        z = np.bincount(row, weights=w[col], minlength=n)
        edges = np.concatenate(([-np.inf], t, [np.inf]))
        hi, lo = _sigmoid(edges[y + 1] - z), _sigmoid(edges[y] - z)
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_w = np.bincount(col, weights=(d_hi - d_lo)[row], minlength=m) / n + decay * w
        g_t = np.array([d_lo[y == k + 1].sum() - d_hi[y == k].sum() for k in range(top)]) / n
        g_gaps = np.array([g_t.sum()] + [np.exp(gaps[k]) * g_t[k:].sum() for k in range(1, top)])
        for x, g, i in ((w, g_w, 0), (gaps, g_gaps, 2)):
            state[i] += 0.1 * (g - state[i])
            state[i + 1] += 0.001 * (g * g - state[i + 1])
            x -= rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.999**step)) + 1e-8)
    return Model(bits, keys, w, gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:])))))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 well written but toxic, 2 well written and not toxic; the lowest of several ratings counts."""
    grade = F.when(F.col("quality") < 1, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null").select("doc_id", grade.cast("int").alias("grade"))
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, *, row_id: str = "doc_id", text: str = "text", sample_rows: int = 8000, bits: int = 26, seed: int = 5, least_z: float = 4.0, **options) -> Model:
    """Fit on at most ``sample_rows`` of ``ratings`` (doc_id, grade), with the texts of ``docs``: one for each id, by a hash of the texts."""
    ship(docs.sparkSession)
    # At most ``sample_rows`` pairs of numbers, so the join may send them to every task.
    sample = ratings.select(F.col("doc_id").cast("long").alias("_id"), "grade").orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(row_id).cast("long").alias("_row"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), F.col("_row") == F.col("_id"))
    # However many rows an id has, one text of it is learned from.
    rows = rows.groupBy("_row", "grade").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text"))["_text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [features(x.as_py(), bits) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own, pa.list_(pa.int32()))], names=["row", "grade", "own"])

    got = rows.select("_row", "_text", "grade").mapInArrow(run, "row long, grade int, own array<int>").toArrow().sort_by("row")
    own = got.column("own").combine_chunks()
    lengths = np.diff(own.offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
    return fit_flat(own.flatten().to_numpy() if len(got) else np.zeros(0, np.int64), lengths, got.column("grade").to_numpy().astype(np.int64), bits=bits, least_z=least_z, **options)


def score(docs: DataFrame, model: Model, *, text: str = "text", at_least: int = 2, least: float = 0.5) -> DataFrame:
    """Add ``expected_grade``, ``p_good`` (P(grade >= ``at_least``)) and ``kept`` (p_good >= ``least``) to all rows of ``docs``.

    A null text is scored as an empty one. Without any rating to learn from, the two numbers are null and every row
    is kept. Repeated rows get equal results, an empty table gives an empty table, and columns of ``docs`` called like a new one
    are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("expected_grade", "p_good", "kept")
    k = min(at_least, len(model.thresholds)) - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected_grade: double, p_good: double>")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            z = np.fromiter((shared.value.score(x) for x in batch), np.float64, len(batch))
            tails = shared.value.tails(z)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1).round(6), "p_good": tails[:, k].round(6)})

    if k < 0:
        nothing: Column = F.lit(None).cast("double")
        return docs.withColumns({"expected_grade": nothing, "p_good": nothing, "kept": F.lit(True)})
    (rated,) = fresh(docs, "_rated")
    out = docs.withColumn(rated, rate(F.col(text).cast("string")))
    return out.withColumns({"expected_grade": F.col(rated)["expected_grade"], "p_good": F.col(rated)["p_good"], "kept": F.col(rated)["p_good"] >= least}).drop(rated)
