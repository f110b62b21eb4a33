import gzip
import hashlib

import pytest

from xmlframe.llm import warc
from xmlframe.llm.common import written

ROWS = [(5, "http://a/", "x" * 200), (3, "http://b/", "x" * 200), (9, None, "x" * 200), (1, "http://c/", "short"), (2, "http://d/", "short"), (4, "u\r\nWARC-Type: bad", None), (None, "n", "x" * 200), (3, "http://b/", "x" * 200), (7, "l", "ü<p>" * 40_000)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string")
    archives = warc.write_archives(df, size=500)
    out = {}
    for r in warc.read_archives(written(archives, "test")).collect():
        out.setdefault(r.row_id, []).append(r)
    assert sum(map(len, out.values())) == len(ROWS)
    for i, _, t in ROWS:
        data = (t or "").encode()
        for r in out[i]:
            assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
            assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    kinds = {i: (rs[0].record_type, rs[0].refers_to) for i, rs in out.items()}
    assert kinds == {5: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), None: ("revisit", 3), 7: ("response", None)}
    assert [r.record_type for r in out[3]] == ["response", "response"]
    files = warc.export_archives(archives, str(tmp_path)).collect()
    read = warc.read_archives(spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.gz"), with_payload=False)
    assert read.count() == len(ROWS) == sum(f.records for f in files)


def test_pieces_may_cut_anywhere():
    members = [warc.member(i, "u", b"p" * i, hashlib.sha256(b"p" * i).hexdigest(), i, None) for i in range(5)]
    data = b"".join(members)
    for step in (1, 7, 1000, len(data)):
        assert [len(r.payload) for r in warc.read_records(data[i : i + step] for i in range(0, len(data), step))] == list(range(5))


def test_damage_is_found():
    good = warc.member(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None)
    plain = gzip.decompress(good)
    for bad in (good[:-9], gzip.compress(plain.replace(b"payload", b"pAyload")), gzip.compress(plain[:-1]), gzip.compress(b"no record"), gzip.compress(plain.replace(b"Content-Length: ", b"Content-Length: 1"))):
        with pytest.raises(Exception):
            list(warc.read_records([bad]))


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).count() == 0
