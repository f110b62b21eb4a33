"""The engine on Spark: modes, tiers, hooks, codecs, rewriting, sinks, templates, streaming, the catalog."""

import json

import pytest
from pyspark.sql import functions as F

from xmlframe import cli
from xmlframe.engine import Hook, XmlSchema, register
from xmlframe.operators.values import DataError
from xmlframe.plans.catalog import SchemaError
from xmlframe.plans.shape import ShapeError
from xmlframe.sources.xml import XmlError, add_schema_dirs, known_namespace, parse, scan_files, scan_records, serialize
from xmlframe.streaming.messages import error_rates, file_stream, read_stream

T, XSD = "urn:t", "http://www.w3.org/2001/XMLSchema"
ORDER = """
<complexType name="line"><sequence><element name="sku" type="string"/><element name="qty" type="int"/></sequence></complexType>
<element name="order"><complexType><sequence><element name="id" type="long"/><element name="note" type="string" minOccurs="0"/>
<element name="line" type="me:line" minOccurs="0" maxOccurs="unbounded"/></sequence><attribute name="day" type="date"/></complexType></element>"""


def schema(body=ORDER, **options):
    return XmlSchema(f'<schema targetNamespace="{T}" xmlns="{XSD}" xmlns:me="{T}">{body}</schema>', **options)


def order(i, lines=2, note=None):
    body = "".join(f"<line><sku>s{k} &amp; co</sku><qty>{k}</qty></line>" for k in range(lines))
    return f'<p:order xmlns:p="{T}" day="2020-01-0{i}"><id>{i}</id>{f"<note>{note}</note>" if note else ""}{body}</p:order>'


GOOD = [order(1), order(2, 0, "n"), order(3, 3)]
BAD = ["<p:order xmlns:p='urn:t'><id>x</id></p:order>", "<order/>", "no xml", "<p:order xmlns:p='urn:t'><note>a</note><id>1</id></p:order>"]


@pytest.mark.parametrize("ordered", ["python", True, False])
def test_modes(spark, ordered):
    reader = schema().reader(f"{{{T}}}order", order_check=ordered)
    assert reader.native is (ordered != "python")
    df = spark.createDataFrame([(x,) for x in [*GOOD, *BAD[:3], None]], "xml string")
    rows = reader.frame(df, mode="PERMISSIVE").collect()
    assert [r.id for r in rows] == [1, 2, 3, None, None, None, None]
    assert [(r.errors[0].code if r.errors else None) for r in rows] == [None, None, None, "value", "root" if ordered == "python" else rows[4].errors[0].code, "xml", None]
    assert [(x.sku, x.qty) for x in rows[0].line] == [("s0 & co", 0), ("s1 & co", 1)] and rows[1].note == "n" and rows[0].day == "2020-01-01"
    assert reader.frame(df.where("xml is not null"), mode="DROPMALFORMED").count() == 3
    with pytest.raises(Exception, match="illegal value `x' for type"):
        reader.frame(df.where("xml like '%>x<%'")).collect()


def test_order_in_both_tiers(spark):
    df = spark.createDataFrame([(BAD[3],)], "xml string")
    own = schema()
    for check, code in ((True, "order"), ("python", "missing")):
        assert own.reader(f"{{{T}}}order", order_check=check).frame(df, mode="PERMISSIVE").first().errors[0].code == code
    swapped = GOOD[0].replace("<sku>s1 &amp; co</sku><qty>1</qty>", "<qty>1</qty><sku>s1</sku>")  # inside a repeated element
    mixed = spark.createDataFrame([(x,) for x in (*GOOD, swapped, swapped.replace("p:order", "order").replace("xmlns:p", "xmlns"))], "xml string")
    for check in (True, "python"):
        out = own.reader(f"{{{T}}}order", order_check=check).frame(mixed, mode="PERMISSIVE").collect()
        assert [bool(r.errors) for r in out] == [False, False, False, True, True]
    assert own.reader(f"{{{T}}}order", order_check=False).frame(df, mode="PERMISSIVE").first().id == 1


def test_round_trip_in_catalyst(spark):
    own = schema()
    df = spark.createDataFrame([(x,) for x in GOOD], "xml string")
    rows = own.reader(f"{{{T}}}order", order_check=False).frame(df)
    text = rows.select(own.writer(f"{{{T}}}order", prefixes={"p": T}).column(F.struct("*")).alias("xml"))
    assert [r.xml for r in text.collect()] == GOOD
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    slow = rows.select(own.writer(f"{{{T}}}order", prefixes={"p": T}).column(F.struct("*"), python=True).alias("xml"))
    assert [r.xml for r in slow.collect()] == GOOD


def test_required_value_missing(spark):
    own = schema()
    df = spark.createDataFrame([(None,)], "id long")
    with pytest.raises(Exception, match="required value for element `id' missing"):
        df.select(own.writer(f"{{{T}}}order").column(F.struct("id", F.lit(None).alias("note"), F.lit(None).cast("array<struct<sku:string,qty:int>>").alias("line"), F.lit(None).alias("day")))).collect()


def test_hooks_and_codecs():
    full, seen = f"{{{T}}}order", []
    xml = order(1)
    read = lambda h, **o: schema().reader(full, hooks=[h], **o).read(xml)
    assert read(Hook(replace="SKIP", path=f"{full}/note"))["id"] == 1
    assert read(Hook(replace="SKIP", type=f"{{{T}}}line"))["line"] == ["SKIPPED", "SKIPPED"]
    assert read(Hook(after=[lambda node, value, path, kind: seen.append(path) or value], type="line"))["line"][0]["qty"] == 0 and len(seen) == 2
    assert read(Hook(before=[lambda node, path, kind: None], path=f"{full}/note", action="WRITER")) == schema().reader(full).read(xml)
    meta = read(Hook(after=["ELEMENT_ORDER", "ATTRIBUTE_ORDER", "NODE_TYPE", "INCLUDE_PATH"], path=full))
    assert (meta["_ELEMENT_ORDER"], meta["_ATTRIBUTE_ORDER"], meta["_NODE_TYPE"], meta["_PATH"]) == (["id", "line", "line"], ["day"], full, full)
    assert read(Hook(replace="XML_NODE", type="line"))["line"][0].startswith("<line>")
    assert read(Hook(replace=lambda node, path, e, go: go()["qty"] + 1, extends=f"{{{T}}}line"))["line"] == [1, 2]
    own = schema(typemap={f"{{{T}}}line": lambda action, value, path: (value["sku"], value["qty"]) if action == "READER" else {"sku": value[0], "qty": value[1]}})
    data = own.reader(full).read(xml)
    assert data["line"] == [("s0 & co", 0), ("s1 & co", 1)] and own.writer(full, prefixes={"p": T}).write(data) == xml
    with pytest.raises(ValueError, match="unknown type"):
        schema(typemap={"{urn:t}none": str}).reader(full)
    text = schema().writer(full, hooks=[Hook(after=[lambda text, path, value, kind: text.upper()], path=f"{full}/note")]).write({"id": 1, "note": "n"})
    assert "<NOTE>N</NOTE>" in text
    assert "note" not in schema().writer(full, hooks=[Hook(replace="SKIP", path=f"{full}/note")]).write({"id": 1, "note": "n"})


def test_key_rewrite_and_clashes():
    own = schema('<element name="r"><complexType><sequence><element name="a-B" type="int"/></sequence><attribute name="c-D" type="int"/></complexType></element>')
    read = lambda *rules: own.reader(f"{{{T}}}r", key_rewrite=list(rules), prefixes={"x": T}).read(f'<p:r xmlns:p="{T}" c-D="2"><a-B>1</a-B></p:r>')
    assert read("SIMPLIFIED") == {"a_b": 1, "c_d": 2} and read("UNDERSCORES") == {"a_B": 1, "c_D": 2} and read("PREFIXED") == {"x_a-B": 1, "x_c-D": 2}
    assert read("SIMPLIFIED", "PREFIXED(x)") == {"x_a_b": 1, "x_c_d": 2} and read({"a-B": "k"}, lambda ns, local: local.upper()) == {"K": 1, "C-D": 2}
    with pytest.raises(ShapeError, match="key_rewrite"):
        schema('<element name="r"><complexType><sequence><element name="a" type="int"/></sequence><attribute name="a" type="string"/></complexType></element>').reader(f"{{{T}}}r")


def test_catalog(spark, tmp_path):
    own = schema()
    assert own.elements() == [f"{{{T}}}order"] and own.types() == [f"{{{T}}}line"]
    assert own.index(kinds=("element",)) == [(T, "element", "order", False, False)]
    again = f'<schema targetNamespace="{T}" xmlns="{XSD}"><element name="order" type="int" id="o1"/></schema>'
    own.import_definitions(again)
    assert own.import_definitions(again) is own.import_definitions(again) and len(own.fragments) == 2
    assert own.reader(f"{{{T}}}order").read(f'<order xmlns="{T}">7</order>') == 7
    assert own.reader(f"{T}#o1").element.local == "order"
    other = XmlSchema()
    other.use_schema(own)
    assert other.find("element", f"{{{T}}}order") is not None
    (tmp_path / "o.xsd").write_text(again)
    add_schema_dirs(str(tmp_path))
    known_namespace("urn:known", "o.xsd")
    assert XmlSchema("o.xsd").elements() == XmlSchema("urn:known").elements() == XmlSchema((tmp_path / "o.xsd").open()).elements()
    assert XmlSchema(f"<w><x>{again}</x></w>").elements() == [f"{{{T}}}order"]
    for bad in ("<x/>", "none.xsd", '<schema xmlns="urn:no"/>', 5):
        with pytest.raises((SchemaError, XmlError)):
            XmlSchema(bad)
    with pytest.raises(SchemaError, match="cannot find"):
        own.reader("{urn:no}x")
    assert own.type_reader(f"{{{T}}}w", f"{{{XSD}}}int").read(f'<w xmlns="{T}">3</w>') == 3
    register("COUNT", lambda e, options: e.local)
    assert own.compile("COUNT", f"{{{T}}}order") == "order" and own.compile("READER", f"{{{T}}}order").read(f'<order xmlns="{T}">7</order>') == 7
    assert own.index_df(spark).count() == 2


def test_xml_is_parsed_safely():
    for bad in ('<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', '<!DOCTYPE a [<!ENTITY x SYSTEM "file:///etc/passwd">]><a>&x;</a>', "<a>", "<p:a/>"):
        with pytest.raises(XmlError):
            parse(bad)
    assert serialize(parse('﻿<a b="&lt;&quot;">&amp;<c/></a>')) == '<a b="&lt;&quot;">&amp;<c/></a>'


def test_templates():
    own = schema()
    text = own.template("XML", f"{{{T}}}order", prefixes={"p": T})
    plain = own.template("XML", f"{{{T}}}order", comments="NONE", prefixes={"p": T})
    assert "<!-- occurs 0 <= # <= unbounded times -->" in text and "<!--" not in plain
    assert own.reader(f"{{{T}}}order").read(plain)["line"] == [{"sku": "example", "qty": 42}]
    data = own.template("DATA", f"{{{T}}}order")
    assert "# is optional" in data and "'sku': 'example'," in data
    assert eval("{" + own.template("DATA", f"{{{T}}}order", comments="NONE") + "}")["order"]["line"][0]["qty"] == "42"
    assert own.template("TREE", f"{{{T}}}order")["children"][1]["local"] == "id"


def test_files_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i, x in enumerate(GOOD):
        (tmp_path / "in" / f"{i}.xml").write_text(x)
    (tmp_path / "s.xsd").write_text(f'<schema targetNamespace="{T}" xmlns="{XSD}" xmlns:me="{T}">{ORDER}</schema>')
    own = XmlSchema(str(tmp_path / "s.xsd"))
    assert own.reader(f"{{{T}}}order").frame(scan_files(spark, str(tmp_path / "in"))).count() == 3
    (tmp_path / "big.xml").write_text("<all>" + "".join(f"<r><a>{i}</a></r>" for i in range(9)) + "</all>")
    assert scan_records(spark, str(tmp_path / "big.xml"), "r").count() == 9
    assert cli.main(["xml2json", str(tmp_path / "in/0.xml"), str(tmp_path / "s.xsd")]) == 0
    assert json.loads(capsys.readouterr().out)["order"]["line"][1] == {"sku": "s1 & co", "qty": 1}
    cli.main(["xml2yaml", str(tmp_path / "in/1.xml"), str(tmp_path / "s.xsd"), "--root", "off"])
    assert 'id: 2\nnote: "n"' in capsys.readouterr().out
    cli.main(["schema2example", str(tmp_path / "s.xsd"), "--type", f"{{{T}}}order", "--output", "XML", "--show", "NONE"])
    assert "<sku>example</sku>" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, x in enumerate([*GOOD, BAD[0]]):
        (tmp_path / "in" / f"{i}.xml").write_text(x)
    own = schema().reader(f"{{{T}}}order", order_check=False)
    stream = read_stream(file_stream(spark, str(tmp_path / "in")), own)
    q = stream.writeStream.format("memory").queryName("messages").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("messages").count() == 4 and spark.table("messages").where("size(errors) > 0").count() == 1
    timed = spark.table("messages").withColumn("at", F.timestamp_seconds(F.coalesce("id", F.lit(0)) * 40))
    assert [(r.messages, r.broken) for r in error_rates(timed, "at").orderBy("start").collect()] == [(2, 1), (1, 0), (1, 0)]


def test_writer_errors():
    own = schema()
    write = own.writer(f"{{{T}}}order").write
    for data, text in (({}, "`id' missing"), ({"id": 1, "x": 2}, "tag `x' not used"), ({"id": "q"}, "illegal value `q'"), (5, "requires a record"), ({"id": [1, 2]}, "only one value")):
        with pytest.raises(DataError, match=text):
            write(data)


def test_catalyst_writer_checks(spark):
    own = schema(
        '<simpleType name="small"><restriction base="int"><maxInclusive value="9"/></restriction></simpleType>'
        '<element name="r"><complexType><sequence><element name="n" type="me:small" maxOccurs="2"/><element name="d" type="date" minOccurs="0"/>'
        '<element name="f" type="string" fixed="x" minOccurs="0"/></sequence><attribute name="k" type="me:small" use="required"/></complexType></element>'
    )
    writer = own.writer(f"{{{T}}}r", prefixes={"p": T})
    kind = "n array<int>, d string, f string, k int"
    good = spark.createDataFrame([([1, 9], "2020-01-01", "x", 3)], kind)
    assert good.select(writer.column(F.struct("*")).alias("x")).first().x == f'<p:r xmlns:p="{T}" k="3"><n>1</n><n>9</n><d>2020-01-01</d><f>x</f></p:r>'
    for row, text in (
        (([10], None, None, 1), "too large inclusive 10, max 9"), (([1, 2, 3], None, None, 1), "too many elements for `n', max 2 found 3"), (([], None, None, 1), "`n' missing"),
        (([1], "2020-1-1", None, 1), "illegal value `2020-1-1'"), (([1], None, "y", 1), "has value fixed to `x', got `y'"), (([1], None, None, None), "attribute `k' is required"), (([1], None, None, 10), "too large inclusive 10"),
    ):
        df = spark.createDataFrame([row], kind)
        for python in (False, True):
            with pytest.raises(Exception, match=text):
                df.select(writer.column(F.struct("*"), python=python)).collect()
