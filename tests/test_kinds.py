"""Simple values: each kind's texts in both tiers, facets, lists, unions, nil, defaults, names, durations, numbers of any size.

One table of texts per kind; what the Python reader says of a text is what the native one has to say, and good values survive writing.
"""

import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from xmlframe.engine import XmlSchema
from xmlframe.functions import durations, facets, names, types
from xmlframe.operators.values import DataError
from xmlframe.sources.xml import XmlError

NS, XSD, XSI = "urn:kinds", "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2001/XMLSchema-instance"


def float32(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


def of(kind: str, *steps: str, extra: str = "") -> XmlSchema:
    """A schema of element ``it``: a built-in kind, restricted by facets where given."""
    if steps:
        facets_ = "".join(f'<{name} value="{value}"/>' for name, _, value in (s.partition("=") for s in steps))
        body = f'<element name="it"><simpleType><restriction base="{kind}">{facets_}</restriction></simpleType></element>'
    else:
        body = f'<element name="it" type="{kind}"/>'
    return XmlSchema(f'<schema xmlns="{XSD}" xmlns:k="{NS}" targetNamespace="{NS}">{extra}{body}</schema>')


def reader(own: XmlSchema, **options):
    return own.reader(f"{{{NS}}}it", elements_qualified="NONE", **options)


def outcome(own: XmlSchema, text: str, **options):
    """(value, None) or (None, what is wrong)."""
    try:
        return reader(own, **options).read(f"<it>{text}</it>"), None
    except (DataError, XmlError) as e:
        return None, str(e).replace(f"{{{NS}}}", "")


def native(spark, own: XmlSchema, texts: list[str], **options) -> list[tuple]:
    """The same for all texts by frame, and by column as well; both have to agree."""
    r = reader(own, **options)
    assert r.native, r.why
    df = spark.createDataFrame([(i, f"<it>{t}</it>") for i, t in enumerate(texts)], "i int, xml string")
    rows = sorted(r.frame(df, mode="PERMISSIVE", keep=("i",)).collect())
    by_column = sorted(df.select("i", r.column(F.col("xml")).alias("c")).collect())
    # The parser behind ``column`` takes a text of blanks only for none.
    assert [repr((x.value, x.errors)) for x, t in zip(rows, texts) if t.strip() or not t] == [repr((x.c.data, x.c.errors)) for x, t in zip(by_column, texts) if t.strip() or not t]
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else v
    return [(plain(x.value), None) if not x.errors else (None, x.errors[0].message.replace(f"{{{NS}}}", "")) for x in rows]


TEXTS = {
    "boolean": "true false 1 0 True no 2",
    "byte": "12 -128 127 128 -129 1.0",
    "unsignedShort": "0 65535 65536 -1 +9",
    "int": "2147483647 -2147483648 2147483648 007 0x1 ٣",
    "unsignedLong": "18446744073709551615 18446744073709551616 0",
    "integer": f"5 -5 {'9' * 38} {'9' * 39} -{'8' * 38} 1e3 1.",
    "negativeInteger": f"-1 0 1 -{'7' * 30}",
    "nonNegativeInteger": "-0 0 +4 -4",
    "decimal": f"2.50 -.75 3. {'6' * 20}.5 {'6' * 21}.5 0.{'1' * 18} 0.{'1' * 19} 0.{'1' * 18}000 1e2 NaN",
    "double": "2.5 -1e-7 INF -INF NaN 1d 0x1p3 Infinity 1e400 .5 5.",
    "float": "0.1 1E+2 inf",
    "hexBinary": "CAFE cafe 0 0G",
    "base64Binary": "Z2FyZGVu Z2FyZGU= Z2FyZG Z===",
    "date": "2024-02-29 2024-02-30 2024-13-01 -0044-03-15 2024-2-9 2024-05-06Z",
    "dateTime": "2023-08-09T10:11:12 2023-08-09T10:11:12.5+05:30 2023-08-09 2023-08-09T25:00:00",
    "time": "23:59:59 24:00:00 24:00:01 7:00:00",
    "gYear": "1999 99 -0001", "gYearMonth": "2020-12 2020-00", "gMonth": "--11 --13 11", "gDay": "---31 ---32", "gMonthDay": "--06-30 --6-30",
    "duration": "P3Y PT9M P1Y2M3DT4H5M6.7S -P8D 3Y P1H", "dayTimeDuration": "P2DT3H P2Y", "yearMonthDuration": "P2Y3M P2D",
    "NCName": "fern größe _x a:b 9a", "language": "pt pt-BR pt_BR toolonglang", "NMTOKEN": "a.b", "anyURI": "http://h/p?q", "string": "x&amp;y",
}


@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_both_tiers_say_the_same(spark, kind):
    own = of(kind)
    texts = [*TEXTS[kind].split(), "", " ", f"  {TEXTS[kind].split()[0]}\n"]
    want = [outcome(own, t) for t in texts]
    got = native(spark, own, texts)
    for t, (value, wrong), (other, other_wrong) in zip(texts, want, got):
        assert wrong == other_wrong, t
        assert (float32(value) if kind == "float" and value is not None else value) == other or value != value and other != other, t
    assert want[0][1] is None
    for value, wrong in want:
        if wrong is None:
            again = own.writer(f"{{{NS}}}it", elements_qualified="NONE").write(value)
            kept = reader(own).read(again)
            assert kept == value or value != value


def test_numbers_at_random(spark):
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"{rng.choice(('', '-', '+'))}{digits(rng.randint(1, 42))}" for _ in range(80)] + [f"{rng.choice(('', '-'))}{digits(rng.randint(0, 23))}.{digits(rng.randint(0, 21))}" for _ in range(80)]
    for kind in ("integer", "decimal", "long", "unsignedInt", "double"):
        own = of(kind)
        assert native(spark, own, texts) == [outcome(own, t) for t in texts]


@pytest.mark.parametrize("kind, big", [("integer", "4" * 39), ("decimal", "4" * 30 + "." + "5" * 30)])
def test_big_numbers(spark, kind, big):
    own = of(kind)
    for check in (True, False):  # no null in silence, whatever is checked
        assert native(spark, own, [big, "1"], check_values=check)[0] == outcome(own, big, check_values=check) == (None, f"illegal value `{big}' for type {{{XSD}}}{kind} at it")
    assert native(spark, own, [big], big_numbers="string") == [outcome(own, big, big_numbers="string")] == [(big, None)]
    bounded = of(kind, f"maxInclusive={big}")
    more, less = big.replace("4", "5", 1), "-" + big
    for text, ok in ((big, True), (less, True), (more, False), ("0", True), (big + "0", kind == "decimal")):
        got = native(spark, bounded, [text], big_numbers="string")[0]
        assert got == outcome(bounded, text, big_numbers="string") and (got[1] is None) is ok, text


def test_a_value_that_spark_cannot_hold_ends_no_job(spark):
    own = of("integer")
    r = reader(own, order_check="python", hooks=[], any_type=lambda path, node: "")
    assert not r.native
    rows = r.frame(spark.createDataFrame([("<it>7</it>",), (f"<it>{'7' * 40}</it>",), ("<it>8</it>",)], "xml string"), mode="PERMISSIVE").collect()
    assert [(r.value, len(r.errors)) for r in rows] == [(Decimal(7), 0), (None, 1), (Decimal(8), 0)]


FACETS = [
    ("short", ["minInclusive=-3", "maxInclusive=3"], "-3 3", "-4 4"),
    ("double", ["minExclusive=0.5", "maxExclusive=0.75"], "0.6", "0.5 0.75 9"),
    ("decimal", ["totalDigits=4", "fractionDigits=1"], "123.4 9", "12345 1.23"),
    ("string", ["minLength=2", "maxLength=4"], "ab abcd", "a abcde"),
    ("string", ["length=5"], "fiver", "four sixsix"),
    ("hexBinary", ["length=2"], "BEEF", "BE BEEFED"),
    ("token", ["enumeration=red", "enumeration=green"], "red green", "blue"),
    ("string", ["pattern=[b-d]{2}[0-9]?"], "bc dd7", "ab b7"),
    ("string", [r"pattern=\i\c*", "pattern=#[1-9]"], "x-1 #4", "-x #0"),
    ("date", ["minInclusive=2020-06-01"], "2021-01-01", "2019-12-31"),
    ("duration", ["maxInclusive=P10D"], "P9D PT5H", "P2M"),
    ("dateTime", ["explicitTimezone=prohibited"], "2022-01-02T03:04:05", "2022-01-02T03:04:05Z"),
]


@pytest.mark.parametrize("kind, steps, good, bad", FACETS, ids=lambda x: x if isinstance(x, str) else "")
def test_facets(spark, kind, steps, good, bad):
    own = of(kind, *steps)
    texts = good.split() + bad.split()
    got = native(spark, own, texts)
    assert got == [outcome(own, t) for t in texts]
    assert [wrong is None for _, wrong in got] == [True] * len(good.split()) + [False] * len(bad.split())
    assert all(w.endswith("at it#facet") for _, w in got if w)
    if kind != "hexBinary":
        for t in bad.split():
            with pytest.raises(DataError):
                own.writer(f"{{{NS}}}it").write(t)
    assert all(w is None for _, w in native(spark, own, texts, ignore_facets=True))


def test_white_space(spark):
    for mode, want in (("preserve", " a\t b\n"), ("replace", " a  b "), ("collapse", "a b")):
        assert native(spark, of("string", f"whiteSpace={mode}"), [" a\t b\n"]) == [(want, None)] == [outcome(of("string", f"whiteSpace={mode}"), " a\t b\n")]


def test_lists_and_unions(spark):
    ages = '<simpleType name="ages"><list itemType="unsignedByte"/></simpleType>'
    own = of("k:ages", extra=ages)
    assert native(spark, own, ["3 44\n255", "", "256"]) == [([3, 44, 255], None), ([], None), (None, outcome(own, "256")[1])]
    assert own.writer(f"{{{NS}}}it", elements_qualified="NONE").write([1, 2]) == "<it>1 2</it>"
    pair = of("k:ages", "length=2", extra=ages)
    assert [w is None for _, w in native(spark, pair, ["1 2", "1", "1 2 3"])] == [True, False, False]
    either = of("k:either", extra='<simpleType name="either"><union memberTypes="date boolean"/></simpleType>')
    assert native(spark, either, ["2020-01-02", " true ", "maybe"]) == [("2020-01-02", None), ("true", None), outcome(either, "maybe")]
    assert "no match for `maybe' in union" in outcome(either, "maybe")[1]


def test_nil(spark):
    own = XmlSchema(f'<schema xmlns="{XSD}" targetNamespace="{NS}"><element name="it"><complexType><sequence><element name="a" type="int" nillable="true"/><element name="b" type="int" nillable="true" minOccurs="0" maxOccurs="3"/></sequence></complexType></element></schema>')
    head = f'<it xmlns:xsi="{XSI}">'
    xml = head + '<a xsi:nil="1"/><b>6</b><b xsi:nil="true"/></it>'
    assert reader(own).read(xml) == {"a": None, "a__nil": True, "b": [{"_": 6, "nil": False}, {"_": None, "nil": True}]}
    assert reader(own, nil_mode="null").read(xml) == {"a": None, "b": [6, None]}
    assert reader(own, nil_mode="string").read(xml) == {"a": "NIL", "b": [6, "NIL"]}
    rows = reader(own).frame(spark.createDataFrame([(xml,), ("<it><a>4</a></it>",)], "xml string")).collect()
    assert [(r.a, r.a__nil, r.b and [(x["_"], x.nil) for x in r.b]) for r in rows] == [(None, True, [(6, False), (None, True)]), (4, False, None)]
    with pytest.raises(DataError, match="`a' missing"):
        reader(own).read("<it/>")
    assert reader(own, interpret_nillable_as_optional=True).read("<it/>") == {}


def test_defaults_and_fixed_values():
    own = XmlSchema(f'<schema xmlns="{XSD}" targetNamespace="{NS}"><element name="it"><complexType><sequence><element name="pot" type="string" default="clay"/><element name="lid" type="int" fixed="2"/></sequence></complexType></element></schema>')
    got = {m: reader(own, default_values=m).read("<it><pot>clay</pot></it>") for m in ("EXTEND", "IGNORE", "MINIMAL")}
    assert got == {"EXTEND": {"pot": "clay", "lid": 2}, "IGNORE": {"pot": "clay", "lid": 2}, "MINIMAL": {"pot": None, "lid": 2}}
    assert reader(own).read("<it/>") == {"pot": "clay", "lid": 2} and reader(own, default_values="IGNORE").read("<it/>") == {"lid": 2}
    write = lambda data, mode: own.writer(f"{{{NS}}}it", elements_qualified="NONE", default_values=mode).write(data)
    assert (write({}, "EXTEND"), write({"pot": "clay"}, "MINIMAL"), write({"pot": "clay"}, "IGNORE")) == ("<it><pot>clay</pot></it>", "<it/>", "<it><pot>clay</pot></it>")
    for given in (lambda: reader(own).read("<it><lid>3</lid></it>"), lambda: write({"lid": 3}, "IGNORE")):
        with pytest.raises(DataError, match="`2', got `3'"):
            given()


def test_times_from_numbers(spark):
    own = of("dateTime")
    writer = own.writer(f"{{{NS}}}it", elements_qualified="NONE")
    texts = {"0": "1970-01-01T00:00:00Z", "86399.5": "1970-01-01T23:59:59.5Z", "4102444800": "2100-01-01T00:00:00Z", "2001-02-03T04:05:06": "2001-02-03T04:05:06"}
    for given, want in texts.items():
        assert writer.write(given) == f"<it>{want}</it>"
    assert writer.write(86400) == "<it>1970-01-02T00:00:00Z</it>"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for python in (False, True):
        assert [r.x for r in df.select(writer.column(F.col("t"), python=python).alias("x")).collect()] == [f"<it>{t}</it>" for t in texts.values()]


def test_names():
    own = of("QName")
    assert reader(own).read('<it xmlns:z="urn:z">z:yew</it>') == "{urn:z}yew" and reader(own).read("<it>oak</it>") == "oak"
    assert own.writer(f"{{{NS}}}it", elements_qualified="NONE", prefixes={"z": "urn:z"}).write("{urn:z}yew") == '<it xmlns:z="urn:z">z:yew</it>'
    assert names.unpack_type(names.pack_type("urn:z", "yew")) == ("urn:z", "yew") and names.unpack_id(names.pack_id("urn:z", "7")) == ("urn:z", "7")
    assert (names.odd_elements([5, 6, 7, 8, 9]), names.even_elements([5, 6, 7, 8, 9])) == ([6, 8], [5, 7, 9])
    assert facets.digits("+007.250") == "7250" and types.lineage("short")[:3] == ["short", "int", "long"]


def test_durations(spark):
    day = 86400
    for text, secs in (("P3D", 3 * day), ("-PT2H", -7200), ("PT0.125S", 0.125), ("P1DT1M1S", day + 61)):
        assert durations.duration2secs(text) == pytest.approx(secs)
        row = spark.range(1).select(durations.duration2secs_col(F.lit(text)).alias("s"), F.unix_timestamp(durations.add_duration_col(F.lit(text), F.timestamp_seconds(F.lit(10**9)))).alias("t")).first()
        assert row.s == pytest.approx(secs) and row.t == int(durations.add_duration(text, 10**9))
    with pytest.raises(ValueError, match="illegal duration"):
        durations.duration2secs("P5Q")
