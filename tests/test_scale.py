"""What only larger tables show: far dates, and messages that aren't plain in great number."""

import duckdb
from pyspark.sql import functions as F

from xmlframe.functions import types as T
from xmlframe.queries import NS, elements, record, schema


def test_seconds_beyond_the_year_9999(spark):
    seconds = [0, 951_782_400, 253_402_300_799, 253_402_300_800, 86_413 * 6_000_000, 86_413 * 36_000_000 + 1]
    writer = schema(record("row", elements("at:dateTime"))).writer(f"{{{NS}}}row")
    want = [duckdb.execute("SELECT strftime(make_timestamp(CAST(? AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ')", [s]).fetchall()[0][0] for s in seconds]
    assert want[3] == "10000-01-01T00:00:00Z"
    for python in (False, True):
        df = spark.createDataFrame([(s,) for s in seconds], "s long").coalesce(1)
        got = [r[0] for r in df.select(F.regexp_extract(writer.column(F.struct(F.col("s").alias("at")), python=python), "<at>(.*)</at>", 1)).collect()]
        assert got == want
    assert T.stamp(str(10**18 + 1)).startswith("31688740476-")


def test_one_row_group_is_spread(spark, tmp_path):
    from xmlframe.queries import table

    for rows in (9_000, 30_000):
        spark.range(rows).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
        parts = [r[0] for r in table(spark, str(tmp_path), "part").groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(parts) == rows and max(parts) <= 10_000


def _row(inner: str, more: str = "") -> str:
    return f'<p:row xmlns:p="{NS}"{more}>{inner}</p:row>'


XSI = ' xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def test_messages_that_are_not_plain_are_read_by_projections(spark):
    """The same as in one expression, without it: that took milliseconds a message."""
    own = schema(record("row", elements("id:long", "name:string") + '<element name="seg" type="string" nillable="true"/>'))
    reader = own.reader(f"{{{NS}}}row")
    good = "<id>1</id><name>a</name>"
    texts = [
        _row(good + '<seg xsi:nil="true"/>', XSI), _row(good + "<seg>x</seg>", XSI), _row(good + "<xsi:seg>x</xsi:seg>", XSI), _row(good + '<seg xmlns="urn:o"/>'), _row(good),
        _row("<name>a</name><id>1</id><seg>x</seg>"), _row(good + "<seg>x</seg><more/>"), _row("<id>z</id><name>a</name><seg>x</seg>"), _row("<!-- <id> -->" + good + "<seg>x</seg>"), "<row", "<row/>", None, "",
        _row(good + '<o:seg xmlns:o="urn:o">x</o:seg>'), _row("<name>a</name><id>1</id><seg>x</seg>", XSI), f'<q:row xmlns:q="urn:o">{good}<seg>x</seg></q:row>',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, xml string").coalesce(1)
    want = {r.n: (r.r.data, r.r.errors) for r in df.select("n", reader.column(F.col("xml")).alias("r")).collect()}
    out = reader.frame(df, "xml", "PERMISSIVE", ("n",))
    got = {r.n: ((r.id, r.name, r.seg, r.seg__nil), r.errors) for r in out.collect()}
    assert {n: (tuple(d) if d else (None,) * 4, e) for n, (d, e) in want.items()} == got
    assert [n for n in sorted(got) if not got[n][1]] == [0, 1, 8, 11]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("from_xml" in line and "lambdafunction(struct(data" in line for line in plan.splitlines())


def test_too_few_and_too_many_are_plain(spark):
    from xmlframe.operators.reader_fast import FastReader

    own = schema(record("row", elements("id:long") + '<element name="x" type="int" minOccurs="2" maxOccurs="3"/>'))
    reader = own.reader(f"{{{NS}}}row")
    df = spark.createDataFrame([(n, _row("<id>1</id>" + "<x>7</x>" * n)) for n in range(6)], "n int, xml string").coalesce(1)
    fast = FastReader(reader.element, reader.options)
    assert df.select(fast.plain(fast.whole(F.col("xml")), fast.skeleton(fast.whole(F.col("xml"))))).distinct().collect() == [(True,)]
    got = {r.n: (r.x, r.errors) for r in reader.frame(df, "xml", "PERMISSIVE", ("n",)).collect()}
    want = {r.n: (r.r.data and r.r.data.x, r.r.errors) for r in df.select("n", reader.column(F.col("xml")).alias("r")).collect()}
    assert got == want and [n for n in got if not got[n][1]] == [2, 3]


def test_short_ways_of_numbers_are_those_of_the_whole_check():
    from xmlframe.operators.values import DataError, read_simple, write_simple
    from xmlframe.plans.model import Options, Simple

    texts = ["0", "7", "007", "127", "128", "32768", "2147483648", "9223372036854775808", "18446744073709551615", "1" * 38, "1" * 39, "-1", "+1", " 5", "5.", ".5", ".", "1.5", "1.2.3", "", "٣", "²", "1_0", "1e3", "INF"]
    for b in T.BUILTINS.values():
        if b.kind not in ("integer", "decimal", "float"):
            continue
        for text in texts:
            try:
                want = T.value(b, text) if T.valid(b, text) else None
            except (ValueError, ArithmeticError):
                want = None
            try:
                got = read_simple(Simple(b.name, builtin=b), text, "", Options())
            except DataError:
                got = None
            assert (got, type(got)) == (want, type(want)), (b.name, text)
            assert T.plain_value(b, text) in (None, want)
        for x in (-(2**63) - 1, -129, -1, 0, 1, 200, 2**31, 2**63, 2**64):
            try:
                want = T.value(b, str(x)) is not None and T.valid(b, str(x))
            except (ValueError, ArithmeticError):
                want = False
            try:
                assert write_simple(Simple(b.name, builtin=b), x, "", Options()) == str(x) and want
            except DataError:
                assert not want
