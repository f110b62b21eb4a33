import random

import corpus_pipeline
from xmlframe.llm import copies, simhash


def _texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(150)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 4, 6):
            own = list(base)
            for at in rng.sample(range(150), changes):
                own[at] = word()
            texts.append(" ".join(own))
    base = [word() for _ in range(120)]  # a large group, not all of whose pairs are links
    for _ in range(120):
        own = list(base)
        for at in rng.sample(range(120), 2):
            own[at] = word()
        texts.append(" ".join(own))
    return texts


def _groups(texts):
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                high, low = max(root[i], root[j]), min(root[i], root[j])
                root = [low if r == high else r for r in root]
    return root


def test_against_all_pairs(spark):
    texts = _texts()
    want = _groups(texts)
    far = [(simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(t, 5)).bit_count() for t in texts[1:4]]
    assert max(far) > 2  # beyond the two bits of op9
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in copies.near_copies(df).collect()} == dict(enumerate(want))
    docs = df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()} == set(want)


def test_repeated_ids_with_different_texts(spark):
    a, b = _texts()[0], _texts()[6]
    rows = [(1, a), (2, b), (2, a), (3, b), (3, a + " more"), (4, None), (4, ""), (5, "one text"), (5, "another"), (5, "one text")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert got == sorted([(1, a), (2, b), (4, ""), (5, "one text"), (5, "another")])
