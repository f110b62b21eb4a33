import re

import corpus_pipeline
from xmlframe.llm import packing, quality
from xmlframe.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "mixture", "packing"]
    good = corpus_pipeline.keep_good(spark, docs, SF)
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    want = {i for i, t in texts.items() if model.tails([model.score(t)])[0, 1] >= 0.5}
    assert {r.doc_id for r in good.collect()} == want and good.columns == list(corpus_pipeline.COLUMNS)
    single = corpus_pipeline.drop_copies(spark, good, SF)
    # The stage's contract by brute force: five-word shingles, similarity of 0.8 or more, the first of each group stays.
    sets = {}
    for i in sorted(want):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (texts[i] or "").encode().lower())
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    linked = lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    kept, todo = set(), set(want)
    while todo:
        first = min(todo)
        kept.add(first)
        group = [first]
        for a in group:
            group += sorted(b for b in todo if b not in group and linked(a, b))
        todo -= set(group)
    assert {r.doc_id for r in single.collect()} == kept
    mixed = corpus_pipeline.mix_sources(spark, single, SF)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(kept) and mixed.columns == list(corpus_pipeline.COLUMNS)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept and sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    assert vocabulary().endswith("word_bpe_49k.json") and packing.WINDOW == 4096


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", None, 3), (None, "nameless words of one document", None, "s", None), (None, "nameless words of one document", None, "s", None), (2, "", "en", "s", 0), (3, "x " * 50_000, "en", "s", 1), (3, "x " * 50_000, "en", "s", 1)]
    for own in (rows, []):
        docs = spark.createDataFrame([(*r, "more") for r in own], "doc_id long, text string, lang string, source string, n_chars long, kept string")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert bool(out) == bool(own)


def test_packing_follows_the_mixture(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * (50 + i % 70), "en", f"s{i % 3 // 2}", 9) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    places = {r.doc_id: at for at, r in enumerate(mixed.collect())}
    for stream, place in ((mixed, places), (docs.coalesce(1).orderBy("doc_id"), {i: i for i in range(400)})):
        first = {}
        for r in corpus_pipeline.pack_sequences(spark, stream, SF).collect():
            first[r.sequence_id] = min(first.get(r.sequence_id, 400), place[r.doc_id])
        assert [first[s] for s in sorted(first)] == sorted(first.values()) and len(first) > 10
