from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from xmlframe.llm import mixing, sharding


@pytest.mark.parametrize("slots", [{"a": 1}, {"a": 3, "b": 4}, {"a": 500, "b": 300, "c": 150, "d": 50}, {str(i): 7 + i for i in range(23)}])
def test_schedule_stays_within_one_block(slots):
    n, done = sum(slots.values()), Counter()
    for t, (k, j) in enumerate(mixing.schedule(slots), 1):
        assert j == done[k] and t - 1 >= j * n // slots[k] and t <= -(-(j + 1) * n // slots[k])
        done[k] += 1
        assert all(abs(done[x] - Fraction(t * slots[x], n)) < 1 for x in slots)
    assert done == slots


def _docs(spark):
    rows = [(i, f"s{min(i % 7, 3)}" if i % 50 else None, "t", "clash") for i in range(3000)]
    rows += [(1, "s1", "t", "clash")] * 3 + [(None, "s1", "t", "clash")] * 2
    return spark.createDataFrame(rows, "doc_id long, source string, text string, shard string"), rows


def test_mix(spark):
    df, rows = _docs(spark)
    weights = {"s0": 5, "s1": 3, "s2": 1, "s3": 1, None: 1}
    out = mixing.mix(df, weights, block=8, cycle=110).orderBy("mix_position").collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter(r[:2] for r in rows)
    assert len({r.mix_position for r in out}) == len(out)
    blocks = list(dict.fromkeys((r.mix_slot, r.source) for r in out))
    assert len({s for s, _ in blocks}) == len(blocks)
    total, done = sum(weights.values()), Counter()
    first_end = min(i for k in weights for i in [max(j for j, (_, s) in enumerate(blocks) if s == k)])
    for t, (_, s) in enumerate(blocks[:first_end], 1):
        done[s] += 1
        assert all(abs(done[k] - t * w / total) < 1.001 for k, w in weights.items())
    again = mixing.mix(df.repartition(3), weights, block=8, cycle=110).orderBy("mix_position").collect()
    assert [(r.doc_id, r.source) for r in again] == [(r.doc_id, r.source) for r in out]
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards(spark, shards):
    df, rows = _docs(spark)
    out = sharding.stratified_shards(df, shards).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter(r[:2] for r in rows)
    sizes = Counter(r.shard for r in out)
    assert sorted(sizes) == list(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    by = Counter((r.shard, r.source) for r in out)
    for source, n in Counter(r[1] for r in rows).items():
        assert all(abs(by[s, source] - n / shards) <= 2 for s in sizes)


def test_shards_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert [(r.shard, r.slot) for r in sharding.stratified_shards(df, 24).collect()] == [(0, 0)]
    assert sharding.stratified_shards(df.limit(0), 24).count() == 0


def test_plans_have_no_python(spark):
    df, _ = _docs(spark)
    for out in (mixing.mix(df), sharding.stratified_shards(df, 24)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapInArrow"))


def test_exact_weights_over_many_cycles(spark):
    weights = {"big": 1 / 3, **{f"s{i:02}": 2 / 3 / 19 for i in range(19)}}
    rows = [(i, k) for k, w in weights.items() for i in range(int(30_000 * w))]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=1, cycle=100)
    order = [r.source for r in out.orderBy("mix_position").collect()]
    total, done, ends = sum(map(Fraction, weights.values())), Counter(), Counter(k for _, k in rows)
    for t, k in enumerate(order, 1):
        done[k] += 1
        if t % 97 == 0:
            assert all(abs(done[x] - t * Fraction(w) / total) < 1 for x, w in weights.items())
        if done[k] == ends[k]:
            break
    assert t > 29_000 and len(order) == len(rows)


def test_weights_of_many_sources():
    weights = {f"s{i:04}": 1.0 for i in range(1500)} | {"big": 1500.0}
    own = mixing.placed({k: 3000 if k == "big" else 2 for k in weights}, weights)
    assert sum(t < 1500 for t in own["big"]) in (749, 750, 751)


def _plain_edf(blocks, weights, slots):
    """Slot by slot, everything recomputed from the exact weights; sources don't end."""
    w = {k: Fraction(x) / sum(map(Fraction, weights.values())) for k, x in weights.items()}
    done, out = Counter(), []
    for t in range(slots):
        released = [k for k in w if done[k] < blocks[k] and (done[k] / w[k]).__floor__() <= t]
        k = min(released, key=lambda k: (((done[k] + 1) / w[k]).__ceil__(), k))
        done[k] += 1
        out.append(k)
        assert all(abs(done[x] - (t + 1) * w[x]) < 1 for x in w)
    return out


@pytest.mark.parametrize("weights", [{"a": 1, "b": 2}, {"a": 1, "b": 3.141592653589793}, {"a": 1 / 3, **{f"s{i:02}": 0.01 + i / 700 for i in range(25)}}])
def test_order_against_plain_edf(weights):
    slots = 3000
    own = mixing.placed({k: 2 * slots for k in weights}, weights)
    order = dict(sorted((t, k) for k, at in own.items() for t in at))
    assert [order[t] for t in range(slots)] == _plain_edf({k: 2 * slots for k in weights}, weights, slots)


@pytest.mark.parametrize("other", [2.0, 3.141592653589793])
def test_deviation_over_many_slots(other):
    weights = {"a": 1.0, "b": other}
    own = mixing.placed({k: 100_000 for k in weights}, weights)
    for k, w in weights.items():
        share = Fraction(w) / sum(map(Fraction, weights.values()))
        assert all(abs(j + 1 - (t + 1) * share) < 1 and abs(j - t * share) < 1 for j, t in enumerate(own[k]) if t < 100_000)


def test_sources_that_end_leave_the_others_scaled_up():
    own = mixing.placed({"a": 10, "b": 400, "c": 200}, {"a": 1, "b": 2, "c": 1})
    assert sorted(t for at in own.values() for t in at) == list(range(610))
    assert max(own["a"]) <= 40  # a ends at 4 x 10 slots, then b and c share 2 to 1
    assert all(abs(sum(x < t for x in own["b"]) - (20 + (t - 40) * Fraction(2, 3))) < 1 for t in range(40, 600, 7))


def test_many_sources_and_grown_blocks(spark):
    df = spark.range(30_000).selectExpr("id doc_id", "concat('d', id % 10007) source", "'x' _source", "'y' _k", "'z' _size")
    out = mixing.mix(df, most_sources=64, most_blocks=500)
    assert out.columns[:5] == df.columns and out.select("_source", "_k", "_size").distinct().collect() == [("x", "y", "z")]
    rows = out.select("doc_id", "mix_position", "mix_slot").collect()
    assert sorted(r.doc_id for r in rows) == list(range(30_000)) and len({r.mix_position for r in rows}) == 30_000
    assert max(r.mix_slot for r in rows) < 500 + 64


def test_a_hundred_thousand_sources(spark):
    df = spark.range(200_000).selectExpr("id doc_id", "cast(id % 100000 as string) source")
    out = mixing.mix(df)
    assert out.count() == 200_000 and out.select("mix_position").distinct().count() == 200_000


def test_shards_keep_clashing_columns_and_part_rows_without_ids(spark):
    df = spark.range(3000).selectExpr("cast(null as long) doc_id", "id text", "'s' source", "'a' _size", "'b' _hash", "'c' _s", "'d' _g")
    out = sharding.stratified_shards(df, 5, ties=["text"], slice_rows=64)
    assert out.columns == [*df.columns, "shard", "slot"] and sorted(Counter(r.shard for r in out.collect()).values()) == [600] * 5
    assert out.select("_size", "_hash", "_s", "_g").distinct().collect() == [("a", "b", "c", "d")]


def test_shards_against_plain_python(spark):
    df, _ = _docs(spark)
    hashed = df.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "text")).collect()
    by = {}
    for r in hashed:
        by.setdefault("n" if r.source is None else "v" + r.source, []).append((r.h % 2**64, r.doc_id is not None, r.doc_id or 0))
    order = sorted(((i + 0.5) / len(own), k, *row) for k, own in by.items() for i, row in enumerate(sorted(own)))
    n, want = len(order), Counter()
    for at, (_, k, _, there, i) in enumerate(order):
        want[(i if there else None, k, at * 7 // n)] += 1
    got = sharding.stratified_shards(df, 7, ties=["text"], slice_rows=100).collect()
    assert Counter((r.doc_id, "n" if r.source is None else "v" + r.source, r.shard) for r in got) == want


def _order_by_plain_edf(blocks, weights):
    """All blocks slot by slot, every source by itself: the fluid time recomputed from all sources, the earliest deadline first."""
    w = {k: Fraction(x) for k, x in weights.items()}
    t = lambda v: sum(min(v * w[k], blocks[k]) for k in w)
    done, slots = Counter(), {k: [] for k in w}
    for at in range(sum(blocks.values())):
        open_ = [k for k in w if done[k] < blocks[k] and t(done[k] / w[k]).__floor__() <= at]
        k = min(open_, key=lambda k: (t((done[k] + 1) / w[k]).__ceil__(), min(x for x in w if (blocks[x], w[x]) == (blocks[k], w[k])), k))
        done[k] += 1
        slots[k].append(at)
    return slots


def test_classes_of_alike_sources_against_plain_edf():
    sizes = {"a0": 40, "a1": 7, "a2": 7, "a3": 7, "b0": 3, "b1": 3, "b2": 1, **{f"c{i}": 1 for i in range(20)}}
    for weights in (sizes, {k: n**0.5 for k, n in sizes.items()}):
        assert {k: at.tolist() for k, at in mixing.placed(sizes, weights).items()} == _order_by_plain_edf(sizes, weights)


def test_blocks_and_sources_do_not_depend_on_the_size(spark):
    """Of more than 65,536 sources each keeps blocks of its own, of one source's 16 rows; none is mixed with another."""
    df = spark.range(70_000 * 2 + 4000).selectExpr("id doc_id", "cast(if(id < 140000, id % 70000, -1) as string) source")
    out = mixing.mix(df).groupBy("mix_slot").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n"), F.max("source").alias("source"))
    got = out.selectExpr("count(*)", "max(sources)", "max(n)", "count_if(source = '-1')").first()
    assert tuple(got) == (70_000 + 250, 1, 16, 250)
    own = mixing.mix(df, cycle=7).where("source = '-1'").select("mix_slot").distinct().orderBy("mix_slot").collect()
    # Weights are 4000 ** 0.5 for the large source and 2 ** 0.5 for each other.
    weights = {"-1": 4000**0.5, **{str(i): 2**0.5 for i in range(70_000)}}
    assert [r.mix_slot for r in own] == mixing.placed({k: 250 if k == "-1" else 1 for k in weights}, weights)["-1"].tolist()
