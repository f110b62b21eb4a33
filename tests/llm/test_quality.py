import numpy as np

from xmlframe.llm import quality

SF = "/root/testdata/sf0.1"


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 30, 6).tolist())) for _ in range(300)]
    grades = [min(2, len([f for f in r if f < 10])) for r in rows]
    model = quality.fit(rows, grades, bits=26, steps=400, decay=0.0)
    assert (np.diff(model.thresholds) > 0).all()
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    assert min(weight[f] for f in range(10)) > max(weight[f] for f in range(10, 30))
    tails = model.tails(np.array([sum(weight[f] for f in r) for r in rows]))
    assert ((tails > 0.5).sum(axis=1) == grades).mean() > 0.95


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ratings = quality.graded(labels)
    model = quality.train(docs, ratings.where("doc_id % 2 = 0"), sample_rows=2000)
    out = quality.score(docs, model).join(ratings.where("doc_id % 2 = 1"), "doc_id").select("grade", "kept", "expected_grade").toPandas()
    kept = out.groupby("grade").kept.mean()
    assert kept[2] > 0.98 and kept[0] < 0.03 and kept[1] < kept[2]
    assert out.expected_grade.corr(out.grade) > 0.8


def test_graded(spark):
    rows = [(1, 0, 0), (2, 1, 1), (3, 1, 0), (3, 0, None), (4, 1, None), (None, 1, 0), (5, None, 1)]
    out = quality.graded(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert {(r.doc_id, r.grade) for r in out} == {(1, 0), (2, 1), (3, 0), (4, 2)}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "Good plain words.", "c"), (2, None, "c"), (3, "", "c"), (3, "", "c"), (None, "x " * 100_000, "c")], "doc_id long, text string, kept string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    out = quality.score(docs, none).collect()
    assert len(out) == 5 and all(r.kept is True and r.p_good is None for r in out)
    model = quality.train(docs, spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int"), least_rows=1)
    out = quality.score(docs, model).collect()
    assert len(out) == 5 and [r.p_good for r in out][1:4] == [out[1].p_good] * 3
    assert quality.score(docs.limit(0), model).count() == 0


def test_held_out_toxic_recall_by_language(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ratings = quality.graded(labels)
    model = quality.train(docs, ratings.where("doc_id % 2 = 0"))
    out = quality.score(docs, model).join(ratings.where("doc_id % 2 = 1"), "doc_id").select("grade", "kept", "lang").toPandas()
    assert out[out.grade == 2].kept.mean() > 0.99
    passed = out[out.grade == 1].groupby("lang").kept.mean()
    assert len(passed) == 4 and (passed < 0.4).all(), passed


def test_ids_of_many_rows_are_learned_from_once(spark):
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad words") for i in range(40)] + [(1, "good words")] * 500, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(40)], "doc_id long, grade int")
    once = quality.train(docs.dropDuplicates(["doc_id", "text"]), ratings)
    model = quality.train(docs, ratings)
    assert (model.weights == once.weights).all() and (model.thresholds == once.thresholds).all()
    out = quality.score(docs.withColumn("_rated", docs.doc_id), model)
    assert out.columns == ["doc_id", "text", "_rated", "expected_grade", "p_good", "kept"]
