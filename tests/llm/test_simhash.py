import re

import numpy as np
import xxhash

from xmlframe.llm import simhash


def plain(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    own = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    for t in (None, "", " \t", "One", "one TWO", "a b c", "a  b\u00a0c d\x0be", "ÄÖ É x y z " * 50, "w" * 10_000, "same same same same same"):
        assert simhash.fingerprint(t) == plain(t)


def groups(fps, bits=2):
    root = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                x, y = i, j
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    out = []
    for i in range(len(fps)):
        while root[i] != root[root[i]]:
            root[i] = root[root[i]]
        out.append(root[i])
    return out


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 60)] + [0, 2**64 - 1]
    fps = list(base)
    for a in base:
        for _ in range(6):
            fps.append(a ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    fps += [base[0] ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)] + [base[0] ^ i for i in range(500)]  # large postings
    fps = list(dict.fromkeys(fps))
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))
    from xmlframe.llm.common import components

    got = {r.node: r.root for r in components(edges).collect()}
    want = groups(fps)
    label = {}
    for i, s in enumerate(signed):
        label.setdefault(want[i], set()).add(got.get(s, s))
    assert all(len(x) == 1 for x in label.values()) and len(set().union(*label.values())) == len(label)


def test_operator(spark):
    rows = [(4, "a b c d e"), (2, "A  b\tC d E"), (9, None), (3, ""), (7, "   "), (5, "other words stand here"), (2, "A  b\tC d E"), (None, "a b c d e"), (None, "nameless"), (8, "long text " * 20_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string")
    out = simhash.near_duplicates(df).collect()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    fp = lambda t: f"{plain(t):016x}"
    assert len(out) == len(rows)
    assert got == {(4, fp("a b c d e")): 2, (2, fp("a b c d e")): 2, (9, "0" * 16): 3, (3, "0" * 16): 3, (7, "0" * 16): 3, (5, fp(rows[5][1])): 5, (None, fp("a b c d e")): 2, (None, fp("nameless")): None, (8, fp(rows[9][1])): 8}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
