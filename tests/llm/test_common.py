import os
import random

import pytest

from xmlframe.llm.common import components, forget, fresh, shared_root, written


def _frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_chains(spark, shuffled):
    ids = list(range(10_000))
    if shuffled:
        random.Random(1).shuffle(ids)
    got = {r.node: r.root for r in components(_frame(spark, list(zip(ids, ids[1:])))).collect()}
    assert got == dict.fromkeys(range(10_000), 0)


def test_against_plain_python(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1300)] + [(7, k) for k in range(4000, 4400)] + [(9, 9), (-5, 9), (2**62, -(2**62))]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    joined = {x for e in edges if e[0] != e[1] for x in e}
    got = components(_frame(spark, edges)).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in joined} and len(got) == len(joined)
    assert components(_frame(spark, [])).count() == 0 and components(_frame(spark, [(4, 4)])).count() == 0


def test_tables_are_left_behind_once(spark):
    own = written(spark.range(5), "here")
    folders = lambda: {x for x in os.listdir(shared_root(spark).removeprefix("file:")) if "-chain-" in x}
    before = folders()
    components(_frame(spark, [(i, i + 1) for i in range(50)]), "chain").count()
    assert len(folders() - before) == 1 and own.count() == 5
    forget(own)
    assert not os.path.exists(own._written_to.removeprefix("file:"))


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id", "id _u", "id _U_", "id other")
    assert fresh(df, "_u", "_v", "_v") == ["_u__", "_v", "_v_"]
