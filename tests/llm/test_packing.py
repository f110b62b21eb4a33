import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from xmlframe.llm import packing
from xmlframe.llm.tokens import Ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cached_words_give_the_library_ids():
    own, plain = Ids(PATH, words=5), Tokenizer.from_file(PATH)
    texts = ["It's naïve, isn't it? ÉA ß (x) <|endoftext|>y", "a\x1cb", "İstanbul ΣΑΣ é ́q 12ab a_b *** $$$", "", "don't,*** we'll l'eau", "x " * 500 + "\n\ty\xa0z "]
    for t in texts:
        assert list(np.frombuffer(own.of(t), "<u4")) == plain.encode(t, add_special_tokens=False).ids
    assert own.of(None) == b""


def test_one_bounded_encoder_a_worker():
    from xmlframe.llm import tokens

    own = tokens.ids_of(PATH, 50)
    whole = Ids(PATH)
    for i in range(40):
        text = " ".join(f"w{chr(97 + i % 26)}x{chr(97 + j % 26)}{'y' * (j % 9)}," for j in range(i, i + 30))
        assert own.of(text) == whole.of(text)
    assert all(len(x) <= 50 and len(x.old) <= 50 for x in (own.runs, own.words))
    assert tokens.ids_of(PATH, 50) is own and tokens.ids_of(PATH) is not own and len(tokens._loaded) == 1


def test_nnls_against_random_problems():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((8, 5)), rng.random(5) * (rng.random(5) < 0.6)
        got = packing.nnls(a, a @ x)
        assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)


def test_combinations_fill_the_window():
    for c in packing.combinations(16, 4):
        assert sum(c) == 16 and 2 <= len(c) <= 4 and list(c) == sorted(c)
    assert len(packing.combinations(16, 2)) == 8


def _check(pieces, ids):
    at = defaultdict(int)
    for r in sorted(pieces, key=lambda r: (str(r.row_id), r.n, r.start)):
        own = ids[r.row_id]
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.crc and r.n == len(own)
        at[r.row_id] += r.length
    padding = 0
    rows = defaultdict(list)
    for r in pieces:
        rows[r.sequence_id].append((r.offset, r.length))
    for own in rows.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 4096
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    return at, padding


def test_every_id_once_without_padding(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta,", "gamma.", "délta", "***", "Ω"]
    texts = {i: " ".join(rng.choice(words, n)) for i, n in enumerate([0, 1, 5, 4095, 4096, 9000, *rng.integers(1, 900, 200)])}
    texts |= {1000 + i: "the same copy " * 70 for i in range(150)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(5000, None, 1)], "doc_id long, text string, n long")
    plain = Tokenizer.from_file(PATH)
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()} | {5000: np.array([2], "<u4")}
    pieces = packing.pack_documents(df, PATH, parts=16).collect()
    at, padding = _check(pieces, ids)
    assert padding == 0 and dict(at) == {i: len(x) for i, x in ids.items()}


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(i, "some words here " * (i * 40 + 1)) for i in range(30)], "doc_id long, text string")
    tokens = packing.tokenized(df, PATH, keep_ids=True).cache()
    pieces = packing.pack(tokens, parts=4)
    out = packing.sequences(pieces, tokens).collect()
    assert sum(len(r.ids) for r in out) == sum(r.n for r in tokens.collect())
    assert sum(x == 2 for r in out for x in r.ids) == 30


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "x"), (1, "x"), (None, "y")]])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack_documents(df, PATH, parts=4).collect()
    assert sum(r.length for r in out) == sum(1 + (t is not None) for _, t in rows)


def test_equal_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "the very same words")] * 4000, "doc_id long, text string").repartition(8)
    out = packing.pack_documents(df, PATH, part_rows=256).collect()
    places = {(r.sequence_id, r.offset + i) for r in out for i in range(r.length)}
    assert len(places) == sum(r.length for r in out) == 4000 * out[0].n


@pytest.mark.parametrize("files", [1, 3])
def test_sequences_in_the_order_of_the_rows(spark, files):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(["alpha", "beta,", "***", "Ω"], n)) for i, n in enumerate([0, 5000, *rng.integers(1, 700, 300)])}
    order = rng.permutation(list(texts)).tolist()
    df = spark.createDataFrame([(at, i, texts[i]) for at, i in enumerate(order)], "place long, doc_id long, text string")
    df = df.repartitionByRange(files, "place").sortWithinPartitions("place")
    plain = Tokenizer.from_file(PATH)
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    pieces = packing.pack_documents(df, PATH, in_order=True, run_rows=64).collect()
    at, padding = _check(pieces, ids)
    assert padding == 0 and dict(at) == {i: len(x) for i, x in ids.items()}
    place, first, runs = {i: at for at, i in enumerate(order)}, {}, defaultdict(set)
    for r in pieces:
        first[r.sequence_id] = min(first.get(r.sequence_id, len(order)), place[r.row_id])
        runs[r.sequence_id].add(place[r.row_id] // 64)
    assert sorted(first) == list(range(len(first))) and all(len(x) == 1 for x in runs.values())
    assert [first[s] for s in sorted(first)] == sorted(first.values())
