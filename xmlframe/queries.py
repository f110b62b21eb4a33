"""Queries that run each operator over the driver's tables, with the same result in SQL.

A query builds messages from a table, sends them through the operator under test and returns plain columns; its SQL says what
must come out, straight from the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.engine import Hook, XmlSchema
from xmlframe.functions import durations, names
from xmlframe.workers import ship, spread

NS = "urn:shop"
XSD = "http://www.w3.org/2001/XMLSchema"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def schema(body: str, extra: str = "", **options) -> XmlSchema:
    return XmlSchema(f'<schema xmlns="{XSD}" xmlns:s="{NS}" targetNamespace="{NS}" {extra}>{body}</schema>', **options)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def esc(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c.cast("string"), F.lit(a), F.lit(b))
    return c


def tag(name: str, *parts: Column | str, attrs: str = "") -> Column:
    """<name attrs>parts</name>; a part is a column, or text as it is."""
    inner = [F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(f"<{name}{' ' * bool(attrs)}{attrs}>"), *inner, F.lit(f"</{name}>"))


def root(name: str, *parts: Column | str, attrs: str = "") -> Column:
    return tag(f"p:{name}", *parts, attrs=f'xmlns:p="{NS}" {attrs}'.strip())


def leaf(name: str, c: str | Column | None = None) -> Column:
    c = F.col(c or name) if not isinstance(c, Column) else c
    return F.when(c.isNotNull(), tag(name, esc(c)))


def elements(*specs: str) -> str:
    """``name:type?`` short forms as element declarations."""
    out = []
    for s in specs:
        m = re.fullmatch(r"([\w.-]+):([\w:]+)(\?|\*|\+)?(?:=(.*))?", s)
        low = ' minOccurs="0"' if m[3] in ("?", "*") else ""
        high = ' maxOccurs="unbounded"' if m[3] in ("*", "+") else ""
        out.append(f'<element name="{m[1]}" type="{m[2]}"{low}{high}{f" default={chr(34)}{m[4]}{chr(34)}" if m[4] is not None else ""}/>')
    return "".join(out)


def record(name: str, inner: str, attrs: str = "", kind: str = "sequence") -> str:
    return f'<element name="{name}"><complexType><{kind}>{inner}</{kind}>{attrs}</complexType></element>'


def read(df: DataFrame, xml: Column, own: XmlSchema, name: str, mode: str = "FAILFAST", keep: tuple = (), **options) -> DataFrame:
    return own.reader(f"{{{NS}}}{name}", **options).frame(df.withColumn("xml", xml), "xml", mode, keep)


REGION = record("region", elements("r_regionkey:int", "r_name:string"))


@query("rd_sequence", "SELECT r_regionkey, r_name FROM region")
def rd_sequence(spark, d):
    return read(table(spark, d, "region"), root("region", leaf("r_regionkey"), leaf("r_name")), schema(REGION), "region")


@query("rd_sequence_python", "SELECT r_regionkey, r_name FROM region")
def rd_sequence_python(spark, d):
    return read(table(spark, d, "region"), root("region", leaf("r_regionkey"), leaf("r_name")), schema(REGION), "region", order_check="python")


@query("rd_sequence_native", "SELECT r_regionkey, r_name FROM region")
def rd_sequence_native(spark, d):
    return read(table(spark, d, "region"), root("region", leaf("r_regionkey"), leaf("r_name")), schema(REGION), "region", order_check=False)


SUPPLIER = record("supplier", elements("s_suppkey:long", "s_name:string") + f"<sequence>{elements('s_nationkey:int', 's_acctbal:double')}</sequence>")


def supplier_xml() -> Column:
    return root("supplier", leaf("s_suppkey"), leaf("s_name"), leaf("s_nationkey"), leaf("s_acctbal"))


@query("rd_nested_sequence", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def rd_nested_sequence(spark, d):
    return read(table(spark, d, "supplier"), supplier_xml(), schema(SUPPLIER), "supplier")


NATION_ATTRS = '<attribute name="n_nationkey" type="int" use="required"/><attribute name="n_regionkey" type="int"/>'


def nation_xml(keyed: bool | Column = True) -> Column:
    attrs = F.concat(F.lit(' n_regionkey="'), F.col("n_regionkey").cast("string"), F.lit('"'))
    own = F.concat(F.lit(' n_nationkey="'), F.col("n_nationkey").cast("string"), F.lit('"'))
    own = own if keyed is True else F.when(keyed, own).otherwise("")
    return F.concat(F.lit(f'<p:nation xmlns:p="{NS}"'), own, attrs, F.lit(">"), leaf("n_name"), F.lit("</p:nation>"))


@query("rd_attribute", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
def rd_attribute(spark, d):
    return read(table(spark, d, "nation"), nation_xml(), schema(record("nation", elements("n_name:string"), NATION_ATTRS)), "nation")


@query("rd_attribute_required", "SELECT n_nationkey AS id, n_nationkey % 3 = 0 AS missing FROM nation")
def rd_attribute_required(spark, d):
    df = table(spark, d, "nation").withColumn("id", F.col("n_nationkey"))
    own = schema(record("nation", elements("n_name:string"), NATION_ATTRS))
    out = read(df, nation_xml(F.col("n_nationkey") % 3 != 0), own, "nation", "PERMISSIVE", ("id",))
    return out.select("id", (F.coalesce(F.get("errors", F.lit(0))["code"], F.lit("")) == "attribute").alias("missing"))


@query("rd_attribute_prohibited", "SELECT n_nationkey AS id, true AS refused FROM nation")
def rd_attribute_prohibited(spark, d):
    df = table(spark, d, "nation").withColumn("id", F.col("n_nationkey"))
    own = schema(record("nation", elements("n_name:string"), NATION_ATTRS.replace('type="int"/>', 'type="int" use="prohibited"/>')))
    out = read(df, nation_xml(), own, "nation", "PERMISSIVE", ("id",))
    return out.select("id", F.get("errors", F.lit(0))["message"].contains("is prohibited").alias("refused"))


@query("rd_attribute_group", "SELECT c_name, c_custkey AS id, c_nationkey AS nation FROM customer")
def rd_attribute_group(spark, d):
    own = schema(
        '<attributeGroup name="keys"><attribute name="id" type="long" use="required"/><attribute name="nation" type="int"/></attributeGroup>'
        + record("customer", elements("c_name:string"), '<attributeGroup ref="s:keys"/>')
    )
    xml = F.concat(F.lit(f'<p:customer xmlns:p="{NS}" id="'), F.col("c_custkey").cast("string"), F.lit('" nation="'), F.col("c_nationkey").cast("string"), F.lit('">'), leaf("c_name"), F.lit("</p:customer>"))
    return read(table(spark, d, "customer"), xml, own, "customer")


def rich(c: str = "c_acctbal") -> Column:
    return F.when(F.col(c) >= 0, F.col(c))


@query("rd_optional", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def rd_optional(spark, d):
    own = schema(record("customer", elements("c_custkey:long", "c_acctbal:double?")))
    return read(table(spark, d, "customer"), root("customer", leaf("c_custkey"), leaf("c_acctbal", rich())), own, "customer")


@query("rd_required_missing", "SELECT c_custkey AS id, c_acctbal < 0 AS missing FROM customer")
def rd_required_missing(spark, d):
    own = schema(record("customer", elements("c_custkey:long", "c_acctbal:double")))
    df = table(spark, d, "customer").withColumn("id", F.col("c_custkey"))
    out = read(df, root("customer", leaf("c_custkey"), leaf("c_acctbal", rich())), own, "customer", "PERMISSIVE", ("id",))
    return out.select("id", (F.size("errors") > 0).alias("missing"))


def orders(spark, d) -> DataFrame:
    """Orders with their lines as an array in line order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


LINE = f"<complexType name=\"line\"><sequence>{elements('l_linenumber:int', 'l_partkey:long', 'l_quantity:double')}</sequence></complexType>"
LINES_SQL = "SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def line_xml(name: str) -> Column:
    body = lambda x: F.concat(F.lit(f"<{name}><l_linenumber>"), x["l_linenumber"].cast("string"), F.lit("</l_linenumber><l_partkey>"), x["l_partkey"].cast("string"), F.lit("</l_partkey><l_quantity>"), x["l_quantity"].cast("string"), F.lit(f"</l_quantity></{name}>"))
    return F.array_join(F.transform("lines", body), "")


def order_schema() -> XmlSchema:
    return schema(LINE + record("order", elements("o_orderkey:long", "line:s:line*")))


def line_rows(out: DataFrame, key: str = "line") -> DataFrame:
    return out.select("o_orderkey", F.explode(key).alias("x")).select("o_orderkey", "x.*")


@query("rd_array", LINES_SQL)
def rd_array(spark, d):
    return line_rows(read(orders(spark, d), root("order", leaf("o_orderkey"), line_xml("line")), order_schema(), "order"))


@query("rd_array_native", LINES_SQL)
def rd_array_native(spark, d):
    return line_rows(read(orders(spark, d), root("order", leaf("o_orderkey"), line_xml("line")), order_schema(), "order", order_check=False))


@query("rd_occurs_bounds", "SELECT l_orderkey AS id, count(*) < 2 OR count(*) > 4 AS broken FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def rd_occurs_bounds(spark, d):
    own = schema(LINE + record("order", elements("o_orderkey:long") + '<element name="line" type="s:line" minOccurs="2" maxOccurs="4"/>'))
    df = orders(spark, d).withColumn("id", F.col("o_orderkey"))
    out = read(df, root("order", leaf("o_orderkey"), line_xml("line")), own, "order", "PERMISSIVE", ("id",))
    return out.select("id", (F.size("errors") > 0).alias("broken"))


def flat_lines() -> Column:
    body = lambda x: F.concat(F.lit("<l_linenumber>"), x["l_linenumber"].cast("string"), F.lit("</l_linenumber><l_partkey>"), x["l_partkey"].cast("string"), F.lit("</l_partkey><l_quantity>"), x["l_quantity"].cast("string"), F.lit("</l_quantity>"))
    return F.array_join(F.transform("lines", body), "")


TRIPLE = elements("l_linenumber:int", "l_partkey:long", "l_quantity:double")


def _repeated(kind: str, inner: str, label: str) -> Query:
    def run(spark, d):
        own = schema(f'<group name="lines"><sequence>{TRIPLE}</sequence></group>' + record("order", elements("o_orderkey:long") + inner))
        return line_rows(read(orders(spark, d), root("order", leaf("o_orderkey"), flat_lines()), own, "order"), label)

    return run


for _kind, _inner, _label in (
    ("sequence", f'<sequence minOccurs="0" maxOccurs="unbounded">{TRIPLE}</sequence>', "seq_l_linenumber"),
    ("all", f'<all minOccurs="0" maxOccurs="unbounded">{TRIPLE}</all>', "all_l_linenumber"),
    ("group", '<group ref="s:lines" minOccurs="0" maxOccurs="unbounded"/>', "gr_lines"),
):
    query(f"rd_repeated_{_kind}", LINES_SQL)(_repeated(_kind, _inner, _label))

KINDS = "SELECT DISTINCT event_type FROM events"


def kinds(spark, d) -> list[str]:
    return sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())


def event_xml(name: str = "event") -> Column:
    return root(name, F.concat(F.lit("<"), F.col("event_type"), F.lit(">"), F.col("event_id").cast("string"), F.lit("</"), F.col("event_type"), F.lit(">")))


@query("rd_choice", "SELECT event_id AS id, event_type AS kind FROM events")
def rd_choice(spark, d):
    own = schema(record("event", elements(*(f"{k}:long" for k in kinds(spark, d))), kind="choice"))
    out = read(table(spark, d, "events"), event_xml(), own, "event")
    return out.select(F.coalesce(*out.columns).alias("id"), F.coalesce(*(F.when(F.col(c).isNotNull(), c) for c in out.columns)).alias("kind"))


@query("rd_repeated_choice", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, event_type AS kind, event_id AS id FROM events")
def rd_repeated_choice(spark, d):
    ks = kinds(spark, d)
    own = schema(record("user", elements("user_id:long") + f'<choice minOccurs="0" maxOccurs="unbounded">{elements(*(f"{k}:long" for k in ks))}</choice>'))
    per = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("es"))
    body = F.array_join(F.transform("es", lambda x: F.concat(F.lit("<"), x["event_type"], F.lit(">"), x["event_id"].cast("string"), F.lit("</"), x["event_type"], F.lit(">"))), "")
    out = read(per, root("user", leaf("user_id"), body), own, "user").select("user_id", F.posexplode(f"cho_{ks[0]}").alias("pos", "x"))
    return out.select("user_id", "pos", F.coalesce(*(F.when(F.col(f"x.{k}").isNotNull(), k) for k in ks)).alias("kind"), F.coalesce(*(F.col(f"x.{k}") for k in ks)).alias("id"))


PART = record("part", elements("p_partkey:long", "p_name:string", "p_size:int"), kind="all")
PART_SQL = "SELECT p_partkey, p_name, p_size FROM part"


def part_xml(*order: str, extra: Column | str = "", name: str = "part") -> Column:
    return root(name, *(leaf(x) for x in order or ("p_partkey", "p_name", "p_size")), extra)


@query("rd_all", PART_SQL)
def rd_all(spark, d):
    xml = F.when(F.col("p_partkey") % 2 == 0, part_xml()).otherwise(part_xml("p_size", "p_partkey", "p_name"))
    return read(table(spark, d, "part"), xml, schema(PART), "part")


@query("rd_group", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def rd_group(spark, d):
    own = schema(f'<group name="state"><sequence>{elements("o_orderstatus:string", "o_totalprice:double")}</sequence></group>' + record("order", elements("o_orderkey:long") + '<group ref="s:state"/>'))
    return read(table(spark, d, "orders"), root("order", leaf("o_orderkey"), leaf("o_orderstatus"), leaf("o_totalprice")), own, "order")


SEQ_PART = record("part", elements("p_partkey:long", "p_name:string", "p_size:int"))


for _name, _options in (("rd_order_violation", {}), ("rd_order_violation_python", {"order_check": "python"})):
    @query(_name, "SELECT p_partkey AS id, p_partkey % 2 = 1 AS broken FROM part")
    def rd_order_violation(spark, d, options=_options):
        xml = F.when(F.col("p_partkey") % 2 == 0, part_xml()).otherwise(part_xml("p_partkey", "p_size", "p_name"))
        df = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
        return read(df, xml, schema(SEQ_PART), "part", "PERMISSIVE", ("id",), **options).select("id", (F.size("errors") > 0).alias("broken"))


def _leftover(native: bool) -> Query:
    def run(spark, d):
        df = table(spark, d, "part").withColumn("id", F.col("p_partkey"))
        xml = part_xml(extra=F.when(F.col("p_size") > 25, F.lit("<more>1</more>")))
        out = read(df, xml, schema(PART if native else SEQ_PART), "part", "PERMISSIVE", ("id",))
        return out.select("id", F.coalesce(F.get("errors", F.lit(0))["code"] == "leftover", F.lit(False)).alias("extra"))

    return run


query("rd_leftover", "SELECT p_partkey AS id, p_size > 25 AS extra FROM part")(_leftover(False))
query("rd_leftover_native", "SELECT p_partkey AS id, p_size > 25 AS extra FROM part")(_leftover(True))


@query("rd_drop_malformed", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size <= 25")
def rd_drop_malformed(spark, d):
    return read(table(spark, d, "part"), part_xml(extra=F.when(F.col("p_size") > 25, F.lit("<more>1</more>"))), schema(PART), "part", "DROPMALFORMED")


BALANCE = '<complexType name="balance"><simpleContent><extension base="double"><attribute name="nation" type="int"/></extension></simpleContent></complexType>'


def balance_xml(key: str, nation: str, bal: str) -> Column:
    return root("row", leaf("id", key), F.concat(F.lit('<bal nation="'), F.col(nation).cast("string"), F.lit('">'), F.col(bal).cast("string"), F.lit("</bal>")))


@query("rd_simple_content", "SELECT s_suppkey AS id, s_acctbal AS bal, s_nationkey AS nation FROM supplier")
def rd_simple_content(spark, d):
    own = schema(BALANCE + record("row", elements("id:long", "bal:s:balance")))
    out = read(table(spark, d, "supplier"), balance_xml("s_suppkey", "s_nationkey", "s_acctbal"), own, "row", order_check=False)
    return out.select("id", F.col("bal._").alias("bal"), F.col("bal.nation").alias("nation"))


PERSON = f'<complexType name="base"><sequence>{elements("c_custkey:long", "c_name:string")}</sequence><attribute name="lang" type="string"/></complexType>'


@query("rd_extension", "SELECT c_custkey, c_name, c_mktsegment, 'en' AS lang FROM customer")
def rd_extension(spark, d):
    own = schema(PERSON + f'<complexType name="more"><complexContent><extension base="s:base"><sequence>{elements("c_mktsegment:string")}</sequence></extension></complexContent></complexType><element name="c" type="s:more"/>')
    return read(table(spark, d, "customer"), root("c", leaf("c_custkey"), leaf("c_name"), leaf("c_mktsegment"), attrs='lang="en"'), own, "c")


@query("rd_restriction", "SELECT c_custkey, 'en' AS lang FROM customer")
def rd_restriction(spark, d):
    own = schema(PERSON + f'<complexType name="less"><complexContent><restriction base="s:base"><sequence>{elements("c_custkey:long")}</sequence></restriction></complexContent></complexType><element name="c" type="s:less"/>')
    return read(table(spark, d, "customer"), root("c", leaf("c_custkey"), attrs='lang="en"'), own, "c")


@query("rd_sc_restriction", "SELECT c_custkey AS id, c_acctbal < 0 AS broken FROM customer")
def rd_sc_restriction(spark, d):
    own = schema(BALANCE + '<complexType name="rich"><simpleContent><restriction base="s:balance"><minInclusive value="0"/></restriction></simpleContent></complexType>' + record("row", elements("id:long", "bal:s:rich")))
    df = table(spark, d, "customer").withColumn("key", F.col("c_custkey"))
    out = read(df, balance_xml("c_custkey", "c_nationkey", "c_acctbal"), own, "row", "PERMISSIVE", ("key",), order_check=False)
    return out.select(F.col("key").alias("id"), (F.size("errors") > 0).alias("broken"))


@query("rd_ref_element", "SELECT n_nationkey AS id, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def rd_ref_element(spark, d):
    own = XmlSchema([f'<schema xmlns="{XSD}" targetNamespace="urn:other"><element name="region" type="string"/></schema>', f'<schema xmlns="{XSD}" xmlns:o="urn:other" targetNamespace="{NS}">{record("nation", elements("id:int") + "<element ref=" + chr(34) + "o:region" + chr(34) + "/>")}</schema>'])
    df = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return read(df, root("nation", leaf("id", "n_nationkey"), F.concat(F.lit('<o:region xmlns:o="urn:other">'), esc("r_name"), F.lit("</o:region>"))), own, "nation")


def event_group(spark, d, many: str = "") -> XmlSchema:
    heads = "".join(f'<element name="{k}" type="long" substitutionGroup="s:happening"/>' for k in kinds(spark, d))
    return schema(f'<element name="happening" type="long" abstract="true"/>{heads}' + record("log", elements("user_id:long") + f'<element ref="s:happening"{many}/>'))


def happening(x: Callable[[str], Column]) -> Column:
    return F.concat(F.lit("<p:"), x("event_type"), F.lit(">"), x("event_id").cast("string"), F.lit("</p:"), x("event_type"), F.lit(">"))


@query("rd_substitution", "SELECT user_id, event_type AS kind, event_id AS id FROM events")
def rd_substitution(spark, d):
    out = read(table(spark, d, "events"), root("log", leaf("user_id"), happening(F.col)), event_group(spark, d), "log")
    ks = [c for c in out.columns if c != "user_id"]
    return out.select("user_id", F.coalesce(*(F.when(F.col(c).isNotNull(), c) for c in ks)).alias("kind"), F.coalesce(*ks).alias("id"))


@query("rd_substitution_repeat", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS pos, event_type AS kind, event_id AS id FROM events")
def rd_substitution_repeat(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("es"))
    body = F.array_join(F.transform("es", lambda x: happening(lambda n: x[n])), "")
    out = read(per, root("log", leaf("user_id"), body), event_group(spark, d, ' maxOccurs="unbounded"'), "log").select("user_id", F.posexplode("happening").alias("pos", "x"))
    ks = kinds(spark, d)
    return out.select("user_id", "pos", F.coalesce(*(F.when(F.col(f"x.{k}").isNotNull(), k) for k in ks)).alias("kind"), F.coalesce(*(F.col(f"x.{k}") for k in ks)).alias("id"))


@query("rd_abstract", "SELECT count(*) AS refused FROM events")
def rd_abstract(spark, d):
    xml = root("log", leaf("user_id"), F.concat(F.lit("<p:happening>"), F.col("event_id").cast("string"), F.lit("</p:happening>")))
    out = read(table(spark, d, "events"), xml, event_group(spark, d), "log", "PERMISSIVE")
    return out.agg(F.sum((F.get("errors", F.lit(0))["code"] == "abstract").cast("bigint")).alias("refused"))


SHAPES = f'<complexType name="thing"><sequence>{elements("p_partkey:long")}</sequence></complexType><complexType name="big"><complexContent><extension base="s:thing"><sequence>{elements("p_size:int")}</sequence></extension></complexContent></complexType>' + record("box", elements("thing:s:thing"))
XSI_NS = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


@query("rd_xsi_type", f"SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS p_size, CASE WHEN p_size > 25 THEN '{{{NS}}}big' ELSE '{{{NS}}}thing' END AS kind FROM part")
def rd_xsi_type(spark, d):
    big = F.concat(F.lit('<thing xsi:type="p:big">'), leaf("p_partkey"), leaf("p_size"), F.lit("</thing>"))
    xml = root("box", F.when(F.col("p_size") > 25, big).otherwise(tag("thing", leaf("p_partkey"))), attrs=XSI_NS)
    out = read(table(spark, d, "part"), xml, schema(SHAPES), "box", xsi_type={f"{{{NS}}}thing": "AUTO"})
    return out.select("thing.p_partkey", "thing.p_size", F.col("thing.XSI_TYPE").alias("kind"))


SIZES = '<simpleType name="sizes"><list itemType="int"/></simpleType>'


@query("rd_list", "SELECT l_orderkey AS id, l_linenumber AS x FROM lineitem")
def rd_list(spark, d):
    own = schema(SIZES + record("row", elements("id:long", "xs:s:sizes")))
    df = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("xs"))
    out = read(df, root("row", leaf("id", "l_orderkey"), leaf("xs", F.array_join("xs", " "))), own, "row", order_check=False)
    return out.select("id", F.explode("xs").alias("x"))


@query("rd_list_facets", "SELECT l_orderkey AS id, count(*) > 3 AS broken FROM lineitem GROUP BY 1")
def rd_list_facets(spark, d):
    own = schema(SIZES + '<simpleType name="few"><restriction base="s:sizes"><maxLength value="3"/></restriction></simpleType>' + record("row", elements("id:long", "xs:s:few")))
    df = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("xs")).withColumn("key", F.col("l_orderkey"))
    out = read(df, root("row", leaf("id", "l_orderkey"), leaf("xs", F.array_join("xs", " "))), own, "row", "PERMISSIVE", ("key",), order_check=False)
    return out.select(F.col("key").alias("id"), (F.size("errors") > 0).alias("broken"))


@query("rd_union", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END AS v, event_id % 3 = 2 AS broken FROM events")
def rd_union(spark, d):
    own = schema('<simpleType name="u"><union memberTypes="int"><simpleType><restriction base="string"><enumeration value="none"/></restriction></simpleType></union></simpleType>' + record("row", elements("id:long", "v:s:u")))
    text = F.when(F.col("event_id") % 3 == 0, "none").when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise("other")
    out = read(table(spark, d, "events").withColumn("key", F.col("event_id")), root("row", leaf("id", "event_id"), leaf("v", text)), own, "row", "PERMISSIVE", ("key",), order_check=False)
    return out.select(F.col("key").alias("id"), "v", (F.size("errors") > 0).alias("broken"))


ANY = f'<element name="bag"><complexType><sequence>{elements("id:long")}<any namespace="##other" minOccurs="0" maxOccurs="unbounded" processContents="lax"/></sequence><anyAttribute namespace="##other"/></complexType></element>'


def bag_xml() -> Column:
    return F.concat(F.lit(f'<p:bag xmlns:p="{NS}" xmlns:o="urn:o" o:size="'), F.col("p_size").cast("string"), F.lit('">'), leaf("id", "p_partkey"), F.lit("<o:brand>"), esc("p_brand"), F.lit("</o:brand></p:bag>"))


@query("rd_any_element", "SELECT p_partkey AS id, '{urn:o}brand' AS k, '<o:brand xmlns:o=\"urn:o\">' || p_brand || '</o:brand>' AS v FROM part")
def rd_any_element(spark, d):
    out = read(table(spark, d, "part"), bag_xml(), schema(ANY), "bag", any_element="TAKE_ALL")
    return out.select("id", F.explode("_any").alias("k", "vs")).select("id", "k", F.col("vs")[0].alias("v"))


@query("rd_any_attribute", "SELECT p_partkey AS id, '{urn:o}size' AS k, CAST(p_size AS VARCHAR) AS v FROM part")
def rd_any_attribute(spark, d):
    out = read(table(spark, d, "part"), bag_xml(), schema(ANY), "bag", any_attribute="TAKE_ALL")
    return out.select("id", F.explode("_any_attribute").alias("k", "v"))


@query("rd_any_skip", "SELECT p_partkey AS id FROM part")
def rd_any_skip(spark, d):
    return read(table(spark, d, "part"), bag_xml(), schema(ANY), "bag")


@query("rd_anytype", "SELECT p_partkey AS id, p_brand AS v FROM part")
def rd_anytype(spark, d):
    own = schema(record("row", elements("id:long", "v:anyType")))
    return read(table(spark, d, "part"), root("row", leaf("id", "p_partkey"), leaf("v", "p_brand")), own, "row")


NIL = '<element name="seg" type="string" nillable="true"/>'


def nil_xml() -> Column:
    return root("row", leaf("id", "c_custkey"), F.when(F.col("c_acctbal") < 0, F.lit('<seg xsi:nil="true"/>')).otherwise(leaf("seg", "c_mktsegment")), attrs=XSI_NS)


for _name, _options in (("rd_nil", {}), ("rd_nil_native", {"order_check": False})):
    @query(_name, "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg, c_acctbal < 0 AS seg__nil FROM customer")
    def rd_nil(spark, d, options=_options):
        return read(table(spark, d, "customer"), nil_xml(), schema(record("row", elements("id:long") + NIL)), "row", **options)


@query("rd_nil_string", "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE 'NIL' END AS seg FROM customer")
def rd_nil_string(spark, d):
    return read(table(spark, d, "customer"), nil_xml(), schema(record("row", elements("id:long") + NIL)), "row", nil_mode="string")


@query("rd_nil_complex", "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg, c_acctbal < 0 AS nil FROM customer")
def rd_nil_complex(spark, d):
    own = schema(record("row", elements("id:long") + f'<element name="c" nillable="true"><complexType><sequence>{elements("seg:string")}</sequence></complexType></element>'))
    xml = root("row", leaf("id", "c_custkey"), F.when(F.col("c_acctbal") < 0, F.lit('<c xsi:nil="true"/>')).otherwise(tag("c", leaf("seg", "c_mktsegment"))), attrs=XSI_NS)
    return read(table(spark, d, "customer"), xml, own, "row").select("id", "c.seg", F.col("c__nil").alias("nil"))


@query("rd_nillable_optional", "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS seg FROM customer")
def rd_nillable_optional(spark, d):
    xml = root("row", leaf("id", "c_custkey"), F.when(F.col("c_acctbal") >= 0, leaf("seg", "c_mktsegment")))
    return read(table(spark, d, "customer"), xml, schema(record("row", elements("id:long") + NIL)), "row", interpret_nillable_as_optional=True, nil_mode="null")


DEFAULTS = record("row", elements("id:long", "status:string=F"), '<attribute name="level" type="int" default="3"/>')


def default_xml() -> Column:
    even = F.col("o_orderkey") % 2 == 0
    attr = F.when(even, F.concat(F.lit(' level="'), (F.col("o_orderkey") % 5).cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit(f'<p:row xmlns:p="{NS}"'), attr, F.lit(">"), leaf("id", "o_orderkey"), F.coalesce(F.when(even, leaf("status", "o_orderstatus")), F.lit("")), F.lit("</p:row>"))


for _mode, _status, _level in (
    ("extend", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'F' END", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 5 AS INTEGER) ELSE 3 END"),
    ("ignore", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END", "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 5 AS INTEGER) END"),
    ("minimal", "CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN o_orderstatus END", "CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 3 THEN CAST(o_orderkey % 5 AS INTEGER) END"),
):
    for _tier, _options in (("", {}), ("_native", {"order_check": False})):
        @query(f"rd_default_{_mode}{_tier}", f"SELECT o_orderkey AS id, {_status} AS status, {_level} AS level FROM orders")
        def rd_default(spark, d, mode=_mode, options=_options):
            return read(table(spark, d, "orders"), default_xml(), schema(DEFAULTS), "row", default_values=mode.upper(), **options)


_ATTR_MODES = " ".join(f'<attribute name="{n}" type="{t}" default="{v}"/>' for n, t, v in (("size", "int", "9"), ("brand", "string", "none")))
for _mode, _size, _brand in (("extend", "CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 9 END", "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END"), ("ignore", "CASE WHEN p_partkey % 3 = 0 THEN p_size END", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END"), ("minimal", "CASE WHEN p_partkey % 3 = 0 AND p_size <> 9 THEN p_size END", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END")):
    for _tier, _options in (("", {}), ("_python", {"order_check": "python"})):
        @query(f"rd_attr_default_{_mode}{_tier}", f"SELECT p_partkey, {_size} AS size, {_brand} AS brand FROM part")
        def rd_attr_default(spark, d, mode=_mode, options=_options):
            own = schema(record("row", elements("p_partkey:long", "p_name:string"), _ATTR_MODES))
            given = [F.when(when, F.concat(F.lit(f' {n}="'), esc(c), F.lit('"'))).otherwise("") for n, c, when in (("size", "p_size", F.col("p_partkey") % 3 == 0), ("brand", "p_brand", F.col("p_partkey") % 2 == 0))]
            xml = F.concat(F.lit(f'<p:row xmlns:p="{NS}"'), *given, F.lit(">"), leaf("p_partkey"), leaf("p_name"), F.lit("</p:row>"))
            return read(table(spark, d, "part"), xml, own, "row", default_values=mode.upper(), **options).select("p_partkey", "size", "brand")


for _tier, _options in (("", {}), ("_native", {"order_check": False})):
    @query(f"rd_fixed{_tier}", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 OR o_orderstatus = 'F' THEN 'F' END AS status, o_orderkey % 2 = 0 AND o_orderstatus <> 'F' AS broken FROM orders")
    def rd_fixed(spark, d, options=_options):
        own = schema(record("row", elements("id:long") + '<element name="status" type="string" fixed="F"/>'))
        xml = root("row", leaf("id", "o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, leaf("status", "o_orderstatus")))
        out = read(table(spark, d, "orders").withColumn("key", F.col("o_orderkey")), xml, own, "row", "PERMISSIVE", ("key",), **options)
        return out.select(F.col("key").alias("id"), "status", (F.size("errors") > 0).alias("broken"))


MIXED = f'<element name="doc"><complexType mixed="true"><sequence>{elements("lang:string")}</sequence><attribute name="id" type="long"/></complexType></element>'


def mixed_xml() -> Column:
    return F.concat(F.lit(f'<p:doc xmlns:p="{NS}" id="'), F.col("doc_id").cast("string"), F.lit('">'), esc("source"), tag("lang", esc("lang")), F.lit(" end</p:doc>"))


@query("rd_mixed_textual", "SELECT doc_id AS id, source || lang || ' end' AS text FROM documents")
def rd_mixed_textual(spark, d):
    return read(table(spark, d, "documents"), mixed_xml(), schema(MIXED), "doc", mixed_elements="TEXTUAL").select("id", F.col("_").alias("text"))


@query("rd_mixed_structural", "SELECT doc_id AS id, lang FROM documents")
def rd_mixed_structural(spark, d):
    return read(table(spark, d, "documents"), mixed_xml(), schema(MIXED), "doc", mixed_elements="STRUCTURAL").select("id", "lang")


@query("rd_mixed_string", f"SELECT '<p:doc xmlns:p=\"{NS}\" id=\"' || doc_id || '\">' || source || '<lang>' || lang || '</lang> end</p:doc>' AS value FROM documents")
def rd_mixed_string(spark, d):
    return read(table(spark, d, "documents"), mixed_xml(), schema(MIXED), "doc", mixed_elements="XML_STRING")


@query("rd_qname", "SELECT n_nationkey AS id, '{urn:q}' || replace(n_name, ' ', '_') AS q FROM nation")
def rd_qname(spark, d):
    own = schema(record("row", elements("id:int", "q:QName")))
    return read(table(spark, d, "nation"), root("row", leaf("id", "n_nationkey"), leaf("q", F.concat(F.lit("q:"), F.replace("n_name", F.lit(" "), F.lit("_")))), attrs='xmlns:q="urn:q"'), own, "row")


@query("rd_recursive", "SELECT n_name AS name, r_name AS inner_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def rd_recursive(spark, d):
    own = schema(record("place", elements("name:string") + '<element ref="s:place" minOccurs="0"/>'))
    df = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    inner = tag("p:place", leaf("name", "n_name"), tag("p:place", leaf("name", "r_name")))
    out = read(df, root("place", tag("name", "world"), inner), own, "place")
    return out.select("place.name", F.variant_get(F.try_parse_json("place.place"), "$.name", "string").alias("inner_name"))


REWRITE = record("row", elements("s-Key:long", "s-Name:string"))
for _rule, _names in (("simplified", ("s_key", "s_name")), ("underscores", ("s_Key", "s_Name")), ("prefixed", ("shop_s-Key", "shop_s-Name")), ("table", ("key", "name")), ("code", ("S-KEY", "S-NAME"))):
    @query(f"rd_key_rewrite_{_rule}", f'SELECT s_suppkey AS "{_names[0]}", s_name AS "{_names[1]}" FROM supplier')
    def rd_key_rewrite(spark, d, rule=_rule):
        rules = {"table": [{"s-Key": "key", f"{{{NS}}}s-Name": "name"}], "code": [lambda ns, local: local.upper()]}.get(rule, [rule.upper()])
        return read(table(spark, d, "supplier"), root("row", leaf("s-Key", "s_suppkey"), leaf("s-Name", "s_name")), schema(REWRITE), "row", key_rewrite=rules, prefixes={"shop": NS})


@query("rd_block_namespace", "SELECT c_custkey AS id FROM customer")
def rd_block_namespace(spark, d):
    own = XmlSchema([f'<schema xmlns="{XSD}" targetNamespace="urn:b"><complexType name="secret"><sequence>{elements("x:string?")}</sequence></complexType></schema>', f'<schema xmlns="{XSD}" xmlns:b="urn:b" targetNamespace="{NS}">{record("row", elements("id:long") + "<element name=" + chr(34) + "s" + chr(34) + " type=" + chr(34) + "b:secret" + chr(34) + "/>")}</schema>'])
    return read(table(spark, d, "customer"), root("row", leaf("id", "c_custkey"), "<s/>"), own, "row", block_namespace=["urn:b"]).select("id")


for _form, _prefix in (("qualified", "p:"), ("unqualified", "")):
    @query(f"rd_form_{_form}", "SELECT r_regionkey, r_name FROM region")
    def rd_form(spark, d, form=_form, prefix=_prefix):
        xml = root("region", leaf(f"{prefix}r_regionkey", "r_regionkey"), leaf(f"{prefix}r_name", "r_name"))
        return read(table(spark, d, "region"), xml, schema(REGION, f'elementFormDefault="{form}"'), "region")


for _tier, _options in (("", {}), ("_python", {"order_check": "python"})):
    @query(f"rd_wrong_namespace_root{_tier}", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS name, n_nationkey % 3 = 0 AS broken FROM nation")
    def rd_wrong_namespace_root(spark, d, options=_options):
        own = schema(record("nation", elements("n_nationkey:int", "n_name:string")))
        df = table(spark, d, "nation").withColumn("id", F.col("n_nationkey"))
        ns = F.when(F.col("id") % 3 == 0, "urn:other").otherwise(NS)
        xml = F.concat(F.lit('<q:nation xmlns:q="'), ns, F.lit('">'), leaf("n_nationkey"), leaf("n_name"), F.lit("</q:nation>"))
        out = read(df, xml, own, "nation", "PERMISSIVE", ("id",), **options)
        return out.select("id", F.col("n_name").alias("name"), (F.size("errors") > 0).alias("broken"))

    @query(f"rd_wrong_namespace_child{_tier}", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN o_orderstatus END AS status, o_orderkey % 4 >= 2 AS broken FROM orders")
    def rd_wrong_namespace_child(spark, d, options=_options):
        own = schema(record("order", elements("o_orderkey:long", "o_orderstatus:string")), 'elementFormDefault="qualified"')
        df = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
        k = F.col("id") % 4  # by prefix, by default, unqualified, in another namespace
        head = F.when(k == 1, F.lit(f'<order xmlns="{NS}">')).when(k == 2, F.lit(f'<q:order xmlns:q="{NS}">')).otherwise(F.lit(f'<q:order xmlns:q="{NS}" xmlns:o="urn:o">'))
        p, r = F.when(k == 0, "q:").when(k == 3, "o:").otherwise(""), F.when(k == 1, "").otherwise("q:")
        part = lambda name: F.concat(F.lit("<"), p, F.lit(f"{name}>"), esc(name), F.lit("</"), p, F.lit(f"{name}>"))
        xml = F.concat(head, part("o_orderkey"), part("o_orderstatus"), F.lit("</"), r, F.lit("order>"))
        out = read(df, xml, own, "order", "PERMISSIVE", ("id",), **options)
        return out.select("id", F.col("o_orderstatus").alias("status"), (F.size("errors") > 0).alias("broken"))


def _upper(node, path, kind):
    node.children = [c.upper() if isinstance(c, str) else c for c in node.children]
    return node


for _hook, _make, _sql in (
    ("before", lambda: Hook(before=[_upper], path=f"{{{NS}}}part/p_name"), "upper(p_name)"),
    ("replace_skip", lambda: Hook(replace="SKIP", path=f"{{{NS}}}part/p_name"), "'SKIPPED'"),
    ("after", lambda: Hook(after=[lambda node, value, path, kind: f"{value}!"], path=f"{{{NS}}}part/p_name"), "p_name || '!'"),
):
    @query(f"rd_hook_{_hook}", f"SELECT p_partkey, {_sql} AS p_name, p_size FROM part")
    def rd_hook(spark, d, make=_make):
        return read(table(spark, d, "part"), part_xml(), schema(SEQ_PART), "part", hooks=[make()])


@query("rd_element_order", "SELECT p_partkey, 'p_partkey p_name p_size' AS names FROM part")
def rd_element_order(spark, d):
    out = read(table(spark, d, "part"), part_xml(), schema(SEQ_PART), "part", hooks=[Hook(after=["ELEMENT_ORDER"], path=f"{{{NS}}}part")])
    return out.select("p_partkey", F.array_join("_ELEMENT_ORDER", " ").alias("names"))


@query("rd_typemap", "SELECT p_partkey, 'brand ' || p_brand AS brand FROM part")
def rd_typemap(spark, d):
    own = schema('<simpleType name="b"><restriction base="string"/></simpleType>' + record("row", elements("p_partkey:long", "brand:s:b")))
    codec = lambda action, value, path: f"brand {value}"
    return read(table(spark, d, "part"), root("row", leaf("p_partkey"), leaf("brand", "p_brand")), own, "row", typemap={f"{{{NS}}}b": codec})


@query("rd_permit_href", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN '<name href=\"#x\"/>' ELSE n_name END AS name FROM nation")
def rd_permit_href(spark, d):
    own = schema(record("row", elements("id:int", "name:string")))
    xml = root("row", leaf("id", "n_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.lit('<name href="#x"/>')).otherwise(leaf("name", "n_name")))
    return read(table(spark, d, "nation"), xml, own, "row", permit_href=True)


LINEITEM = record("li", elements("l_orderkey:long", "l_linenumber:int", "l_quantity:double", "l_extendedprice:double", "l_discount:double", "l_returnflag:string"))
LI_COLS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
LI_SQL = f"SELECT {', '.join(LI_COLS)} FROM lineitem"


@query("rd_no_validation", LI_SQL)
def rd_no_validation(spark, d):
    return read(table(spark, d, "lineitem"), root("li", *(leaf(c) for c in LI_COLS)), schema(LINEITEM), "li", validation=False, order_check=False)


@query("rt_lineitem", LI_SQL)
def rt_lineitem(spark, d):
    own = schema(LINEITEM)
    df = table(spark, d, "lineitem").select(own.writer(f"{{{NS}}}li").column(F.struct(*LI_COLS)).alias("xml"))
    return own.reader(f"{{{NS}}}li", order_check=False).frame(df)


@query("rt_lineitem_ordered", LI_SQL)
def rt_lineitem_ordered(spark, d):
    own = schema(LINEITEM)
    df = table(spark, d, "lineitem").select(own.writer(f"{{{NS}}}li").column(F.struct(*LI_COLS)).alias("xml"))
    return own.reader(f"{{{NS}}}li", order_check="python").frame(df)


@query("rt_lineitem_checked", LI_SQL)
def rt_lineitem_checked(spark, d):
    own = schema(LINEITEM)
    df = table(spark, d, "lineitem").select(own.writer(f"{{{NS}}}li").column(F.struct(*LI_COLS)).alias("xml"))
    return own.reader(f"{{{NS}}}li").frame(df)


@query("rt_orders_nested", LINES_SQL)
def rt_orders_nested(spark, d):
    own = order_schema()
    df = orders(spark, d).select(own.writer(f"{{{NS}}}order").column(F.struct("o_orderkey", F.col("lines").alias("line"))).alias("xml"))
    return line_rows(own.reader(f"{{{NS}}}order", order_check=False).frame(df))


for _name, _sloppy in (("rd_sloppy_ints", True), ("rd_bigints", False)):
    @query(_name, f"SELECT CAST(o_orderkey AS {'BIGINT' if _sloppy else 'VARCHAR'}) AS k FROM orders")
    def rd_ints(spark, d, sloppy=_sloppy):
        out = read(table(spark, d, "orders"), root("k", esc("o_orderkey")), schema('<element name="k" type="integer"/>'), "k", sloppy_integers=sloppy)
        return out.select(F.col("value").cast("bigint" if sloppy else "string").alias("k"))


# --- built-in types: every text of a column against one type, as (id, value or null, broken) -----------------------


def typed(name: str, kind: str, src: str, key: str, text: Callable[[], Column], shown: Callable[[Column], Column], sql_value: str, sql_ok: str, sql_text: str) -> None:
    """``sql_value`` and ``sql_ok`` speak about column t of (id, t)."""

    @query(name, f"WITH x AS (SELECT {key} AS id, {sql_text} AS t FROM {src}) SELECT id, CASE WHEN {sql_ok} THEN {sql_value} END AS v, NOT ({sql_ok}) AS broken FROM x")
    def run(spark, d):
        own = schema(kind if kind.startswith("<") else f'<element name="v" type="{kind}"/>')
        df = table(spark, d, src).select(F.col(key).alias("id"), text().alias("t"))
        out = read(df, root("v", esc("t")), own, "v", "PERMISSIVE", ("id",))
        return out.select("id", shown(F.col("value")).alias("v"), (F.size("errors") > 0).alias("broken"))


_same = lambda c: c
_INT_TEXT = (lambda: (F.col("event_id") * 37 - 1000).cast("string"), "CAST(event_id * 37 - 1000 AS VARCHAR)")
for _kind, _low, _high in (("byte", -128, 127), ("short", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1), ("long", -(2**63), 2**63 - 1), ("unsignedByte", 0, 255), ("unsignedShort", 0, 65535), ("unsignedInt", 0, 2**32 - 1), ("unsignedLong", 0, 2**64 - 1), ("positiveInteger", 1, 10**30), ("negativeInteger", -(10**30), -1), ("nonNegativeInteger", 0, 10**30), ("nonPositiveInteger", -(10**30), 0)):
    typed(f"ty_{_kind}", _kind, "events", "event_id", _INT_TEXT[0], lambda c: c.cast("bigint"), "CAST(t AS BIGINT)", f"CAST(t AS HUGEINT) BETWEEN {_low} AND {_high}", _INT_TEXT[1])
typed("ty_decimal", "decimal", "lineitem", "l_orderkey", lambda: F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_partkey").cast("string")), lambda c: c.cast("double"), "CAST(t AS DOUBLE)", "true", "CAST(l_linenumber AS VARCHAR) || '.' || CAST(l_partkey AS VARCHAR)")
typed("ty_double", "double", "events", "event_id", lambda: F.when(F.col("event_id") % 7 == 0, "INF").when(F.col("event_id") % 7 == 1, "x1").otherwise(F.col("value").cast("string")), lambda c: F.when(c != float("inf"), c), "CASE WHEN t <> 'INF' THEN TRY_CAST(t AS DOUBLE) END", "t <> 'x1'", "CASE WHEN event_id % 7 = 0 THEN 'INF' WHEN event_id % 7 = 1 THEN 'x1' ELSE CAST(value AS VARCHAR) END")
typed("ty_boolean", "boolean", "events", "event_id", lambda: F.element_at(F.array(*map(F.lit, ("true", "false", "1", "0", "yes"))), (F.col("event_id") % 5 + 1).cast("int")), _same, "t IN ('true', '1')", "t <> 'yes'", "['true', 'false', '1', '0', 'yes'][event_id % 5 + 1]")
typed("ty_hex", "hexBinary", "documents", "doc_id", lambda: F.hex(F.encode("source", "UTF-8")), lambda c: F.hex(c), "t", "true", "hex(source)")
typed("ty_base64", "base64Binary", "documents", "doc_id", lambda: F.base64(F.encode("source", "UTF-8")), lambda c: F.decode(c, "UTF-8"), "decode(from_base64(t))", "true", "base64(encode(source))")
# Numbers that DECIMAL holds and numbers that it doesn't: an error each, or all of them as texts.
for _tier, _options in (("", {}), ("_python", {"hooks": [Hook(before=[lambda node, path, kind: node], type="none")]})):
    for _kind, _made, _made_sql in (
        ("integer", lambda: F.concat((F.col("l_orderkey") + 1).cast("string"), F.repeat(F.lit("7"), F.col("l_linenumber") * 8)), "CAST(l_orderkey + 1 AS VARCHAR) || repeat('7', l_linenumber * 8)"),
        ("decimal", lambda: F.concat(F.col("l_linenumber").cast("string"), F.repeat(F.lit("3"), F.col("l_linenumber") * 4), F.lit("."), F.repeat(F.lit("5"), (F.col("l_partkey") % 25).cast("int")), F.lit("1")), "CAST(l_linenumber AS VARCHAR) || repeat('3', l_linenumber * 4) || '.' || repeat('5', l_partkey % 25) || '1'"),
    ):
        _fits = "length(t) <= 38" if _kind == "integer" else "strpos(t, '.') <= 21 AND length(t) - strpos(t, '.') <= 18"

        @query(f"ty_{_kind}_overflow{_tier}", f"WITH x AS (SELECT l_orderkey, l_linenumber, {_made_sql} AS t FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN {_fits} THEN t END AS v, CASE WHEN {_fits} THEN 0 ELSE 1 END AS errors FROM x")
        def overflow(spark, d, kind=_kind, made=_made, options=_options):
            own = schema(f'<element name="v" type="{kind}"/>')
            out = read(table(spark, d, "lineitem"), root("v", made()), own, "v", "PERMISSIVE", ("l_orderkey", "l_linenumber"), **options)
            shown = F.regexp_replace(F.col("value").cast("string"), r"(\..*?[1-9])0+$", "$1")
            return out.select("l_orderkey", "l_linenumber", shown.alias("v"), F.size("errors").alias("errors"))

        @query(f"ty_{_kind}_text{_tier}", f"WITH x AS (SELECT l_orderkey, l_linenumber, {_made_sql} AS t FROM lineitem) SELECT l_orderkey, l_linenumber, t AS v FROM x")
        def as_text(spark, d, kind=_kind, made=_made, options=_options):
            own = schema(f'<element name="v" type="{kind}"/>')
            out = read(table(spark, d, "lineitem"), root("v", made()), own, "v", keep=("l_orderkey", "l_linenumber"), big_numbers="string", **options)
            return out.select("l_orderkey", "l_linenumber", F.col("value").alias("v"))


_D = (lambda: F.date_format("o_orderdate", "yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')")
for _kind, _py, _sql, _re in (
    ("date", _D[0], _D[1], r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}"),
    ("dateTime", lambda: F.concat(_D[0](), F.lit("T10:20:30Z")), f"{_D[1]} || 'T10:20:30Z'", r".*T.*"),
    ("time", lambda: F.concat(F.lit("10:"), F.lpad((F.col("o_orderkey") % 75).cast("string"), 2, "0"), F.lit(":00")), "'10:' || lpad(CAST(o_orderkey % 75 AS VARCHAR), 2, '0') || ':00'", r"10:[0-5][0-9]:00"),
    ("gYear", lambda: F.date_format("o_orderdate", "yyyy"), "strftime(o_orderdate, '%Y')", r"[0-9]{4}"),
    ("gYearMonth", lambda: F.date_format("o_orderdate", "yyyy-MM"), "strftime(o_orderdate, '%Y-%m')", r"[0-9]{4}-[0-9]{2}"),
    ("gMonth", lambda: F.concat(F.lit("--"), F.lpad((F.col("o_orderkey") % 15).cast("string"), 2, "0")), "'--' || lpad(CAST(o_orderkey % 15 AS VARCHAR), 2, '0')", r"--(0[1-9]|1[0-2])"),
    ("gDay", lambda: F.concat(F.lit("---"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0")), "'---' || lpad(CAST(o_orderkey % 40 AS VARCHAR), 2, '0')", r"---(0[1-9]|[12][0-9]|3[01])"),
    ("gMonthDay", lambda: F.concat(F.lit("--"), F.date_format("o_orderdate", "MM-dd")), "'--' || strftime(o_orderdate, '%m-%d')", r"--[0-9]{2}-[0-9]{2}"),
):
    typed(f"ty_{_kind.lower()}", _kind, "orders", "o_orderkey", _py, _same, "t", f"regexp_full_match(t, '{_re}')", _sql)
typed("ty_duration", "duration", "events", "event_id", lambda: F.concat(F.lit("P"), (F.col("event_id") % 9).cast("string"), F.element_at(F.array(*map(F.lit, ("Y", "M", "D", "Q"))), (F.col("event_id") % 4 + 1).cast("int"))), _same, "t", "t NOT LIKE '%Q'", "'P' || (event_id % 9) || ['Y', 'M', 'D', 'Q'][event_id % 4 + 1]")
_TEXT = (lambda: F.concat(F.lit(" "), F.col("lang"), F.lit("\t"), F.col("source"), F.lit("\n ")), "' ' || lang || chr(9) || source || chr(10) || ' '")
for _kind, _sql in (("string", "t"), ("normalizedString", "replace(replace(t, chr(9), ' '), chr(10), ' ')"), ("token", "trim(regexp_replace(t, '[\\t\\r\\n]+', ' ', 'g'), ' ')"), ("anyURI", "trim(regexp_replace(t, '[\\t\\r\\n]+', ' ', 'g'), ' ')"), ("NMTOKEN", "regexp_replace(t, '\\s+', '', 'g')")):
    typed(f"ty_{_kind.lower()}", _kind, "documents", "doc_id", _TEXT[0], _same, _sql, "true", _TEXT[1])
typed("ty_nmtokens", "NMTOKENS", "documents", "doc_id", _TEXT[0], lambda c: F.array_join(c, "|"), "replace(trim(regexp_replace(t, '\\s+', ' ', 'g'), ' '), ' ', '|')", "true", _TEXT[1])
typed("ty_ncname", "NCName", "documents", "doc_id", lambda: F.concat("lang", F.when(F.col("doc_id") % 2 == 0, ":").otherwise("_"), "source"), _same, "t", "t NOT LIKE '%:%'", "lang || CASE WHEN doc_id % 2 = 0 THEN ':' ELSE '_' END || source")
typed("ty_language", "language", "documents", "doc_id", lambda: F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.concat("lang", F.lit("_x"))), _same, "t", "t NOT LIKE '%!_%' ESCAPE '!'", "CASE WHEN doc_id % 2 = 0 THEN lang ELSE lang || '_x' END")


# --- facets: a restricted type over a column -----------------------------------------------------------------------


def faceted(name: str, base: str, facets: str, src: str, key: str, text: Callable[[], Column], sql_text: str, sql_ok: str, shown: Callable[[Column], Column] = _same, sql_value: str = "t") -> None:
    kind = f'<element name="v"><simpleType><restriction base="{base}">{facets}</restriction></simpleType></element>'
    typed(name, kind, src, key, text, shown, sql_value, sql_ok, sql_text)


_status = (lambda: F.col("o_orderstatus"), "o_orderstatus")
_brand = (lambda: F.col("p_brand"), "p_brand")
_qty = (lambda: F.col("l_quantity").cast("string"), "CAST(l_quantity AS VARCHAR)")
_price = (lambda: F.col("p_retailprice").cast("string"), "CAST(p_retailprice AS VARCHAR)")
_asis = lambda c: c.cast("double")
faceted("fx_enumeration", "string", '<enumeration value="F"/><enumeration value="O"/>', "orders", "o_orderkey", *_status, "t IN ('F', 'O')")
faceted("fx_pattern", "string", '<pattern value="[A-Za-z]+#[1-3]\\d"/>', "part", "p_partkey", *_brand, "regexp_full_match(t, '[A-Za-z]+#[1-3][0-9]')")
faceted("fx_min_max_inclusive", "double", '<minInclusive value="10"/><maxInclusive value="40"/>', "lineitem", "l_orderkey", *_qty, "CAST(t AS DOUBLE) BETWEEN 10 AND 40", _asis, "CAST(t AS DOUBLE)")
faceted("fx_min_max_exclusive", "double", '<minExclusive value="10"/><maxExclusive value="40"/>', "lineitem", "l_orderkey", *_qty, "CAST(t AS DOUBLE) > 10 AND CAST(t AS DOUBLE) < 40", _asis, "CAST(t AS DOUBLE)")
faceted("fx_length", "string", '<length value="8"/>', "part", "p_partkey", *_brand, "length(t) = 8")
faceted("fx_min_max_length", "string", '<minLength value="12"/><maxLength value="20"/>', "part", "p_partkey", lambda: F.col("p_name"), "p_name", "length(t) BETWEEN 12 AND 20")
_DIGITS = "length(replace(regexp_replace(t, '^0+', ''), '.', ''))"
faceted("fx_total_digits", "double", '<totalDigits value="5"/>', "part", "p_partkey", *_price, f"{_DIGITS} <= 5", _asis, "CAST(t AS DOUBLE)")
faceted("fx_fraction_digits", "double", '<fractionDigits value="1"/>', "part", "p_partkey", *_price, "true", _asis, "CAST(regexp_replace(t, '([.][0-9]).*', '\\1') AS DOUBLE)")
faceted("fx_total_fraction", "double", '<totalDigits value="6"/><fractionDigits value="1"/>', "part", "p_partkey", *_price, f"{_DIGITS} <= 6 AND length(split_part(t, '.', 2)) <= 1", _asis, "CAST(t AS DOUBLE)")
for _space, _sql in (("preserve", "t"), ("replace", "replace(replace(t, chr(9), ' '), chr(10), ' ')"), ("collapse", "trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'), ' ')")):
    faceted(f"fx_whitespace_{_space}", "string", f'<whiteSpace value="{_space}"/>', "documents", "doc_id", *_TEXT, "true", _same, _sql)
faceted("fx_date_bounds", "date", '<minInclusive value="1995-01-01"/><maxExclusive value="1997-01-01"/>', "orders", "o_orderkey", *_D, "t > '1995-01-01' AND t < '1997-01-01'")
faceted("fx_timezone", "time", '<explicitTimezone value="required"/>', "orders", "o_orderkey", lambda: F.concat(F.lit("10:00:00"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise("")), "'10:00:00' || CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE '' END", "t LIKE '%Z'")
faceted("fx_duration_bounds", "duration", '<minInclusive value="P4D"/>', "events", "event_id", lambda: F.concat(F.lit("P"), (F.col("event_id") % 9).cast("string"), F.lit("D")), "'P' || (event_id % 9) || 'D'", "CAST(substr(t, 2, 1) AS INTEGER) >= 4")
faceted("fx_big_bounds", "integer", '<maxInclusive value="123456789012345678905"/>', "events", "event_id", lambda: F.concat(F.lit("12345678901234567890"), (F.col("event_id") % 10).cast("string")), "'12345678901234567890' || (event_id % 10)", "event_ok", lambda c: c.cast("string"), "t")
ORACLES["fx_big_bounds"] = ORACLES["fx_big_bounds"].replace("event_ok", "CAST(right(t, 1) AS INTEGER) <= 5")


# --- writing ---------------------------------------------------------------------------------------------------------

PFX = {"p": NS}
HEAD = f'xmlns:p="{NS}"'


def write(name: str, sql: str, body: str, element: str, src: str, data: Callable[[], Column], python: bool | None = None, prepare: Callable[[SparkSession, str], DataFrame] | None = None, **options) -> None:
    """One query for each tier that can write the element: Catalyst, and the checking Python writer as ``_python``."""
    for tier in ((False, True) if python is None else (python,)):

        @query(name + ("_python" if tier and python is None else ""), f"SELECT {sql} AS xml FROM {src}")
        def run(spark, d, tier=tier):
            own = schema(body) if isinstance(body, str) else body()
            df = prepare(spark, d) if prepare else table(spark, d, src)
            return df.select(own.writer(f"{{{NS}}}{element}", prefixes=PFX, **options).column(data(), python=tier).alias("xml"))


def _sql_row(name: str, *parts: str, attrs: str = "") -> str:
    return f"'<p:{name} {HEAD}'{attrs} || '>' || " + " || ".join(parts) + f" || '</p:{name}>'"


def _sql_leaf(name: str, expr: str) -> str:
    return f"'<{name}>' || {expr} || '</{name}>'"


write("wr_sequence", _sql_row("region", _sql_leaf("r_regionkey", "r_regionkey"), _sql_leaf("r_name", "r_name")), REGION, "region", "region", lambda: F.struct("r_regionkey", "r_name"))
write("wr_attribute", _sql_row("nation", _sql_leaf("n_name", "n_name"), attrs=" || ' n_nationkey=\"' || n_nationkey || '\" n_regionkey=\"' || n_regionkey || '\"'"), record("nation", elements("n_name:string"), NATION_ATTRS), "nation", "nation", lambda: F.struct("n_name", "n_nationkey", "n_regionkey"))
write("wr_optional", _sql_row("customer", _sql_leaf("c_custkey", "c_custkey"), "CASE WHEN c_custkey % 2 = 0 THEN '<c_name>' || c_name || '</c_name>' ELSE '' END"), record("customer", elements("c_custkey:long", "c_name:string?")), "customer", "customer", lambda: F.struct("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name")))
write("wr_simple_content", _sql_row("row", "'<bal nation=\"' || s_nationkey || '\">' || s_suppkey || '</bal>'"), BALANCE.replace('base="double"', 'base="long"') + record("row", elements("bal:s:balance")), "row", "supplier", lambda: F.struct(F.struct(F.col("s_suppkey").alias("_"), F.col("s_nationkey").alias("nation")).alias("bal")))
write("wr_all", _sql_row("part", _sql_leaf("p_partkey", "p_partkey"), _sql_leaf("p_name", "p_name"), _sql_leaf("p_size", "p_size")), PART, "part", "part", lambda: F.struct("p_size", "p_name", "p_partkey"))
write("wr_choice", _sql_row("row", "CASE WHEN p_size > 25 THEN '<big>' || p_size || '</big>' ELSE '<small>' || p_size || '</small>' END"), record("row", elements("big:int", "small:int"), kind="choice"), "row", "part", lambda: F.struct(F.when(F.col("p_size") > 25, F.col("p_size")).alias("big"), F.when(F.col("p_size") <= 25, F.col("p_size")).alias("small")))
write("wr_list", _sql_row("row", _sql_leaf("xs", "p_partkey || ' ' || p_size")), SIZES.replace("int", "long") + record("row", elements("xs:s:sizes")), "row", "part", lambda: F.struct(F.array(F.col("p_partkey"), F.col("p_size").cast("long")).alias("xs")))
write("wr_union", _sql_row("row", _sql_leaf("v", "CASE WHEN p_size > 25 THEN 'none' ELSE CAST(p_size AS VARCHAR) END")), '<simpleType name="u"><union memberTypes="int"><simpleType><restriction base="string"><enumeration value="none"/></restriction></simpleType></union></simpleType>' + record("row", elements("v:s:u")), "row", "part", lambda: F.struct(F.when(F.col("p_size") > 25, "none").otherwise(F.col("p_size").cast("string")).alias("v")))
write("wr_nil", f"CASE WHEN p_size > 25 THEN '<p:row {HEAD} xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\"><seg xsi:nil=\"true\"/></p:row>' ELSE '<p:row {HEAD} xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\"><seg>' || p_size || '</seg></p:row>' END", record("row", '<element name="seg" type="int" nillable="true"/>'), "row", "part", lambda: F.struct(F.when(F.col("p_size") <= 25, F.col("p_size")).alias("seg"), (F.col("p_size") > 25).alias("seg__nil")), python=False)
for _mode, _sql in (("extend", "'<status>' || coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'F') || '</status>'"), ("ignore", "CASE WHEN o_orderkey % 2 = 0 THEN '<status>' || o_orderstatus || '</status>' ELSE '' END"), ("minimal", "CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN '<status>' || o_orderstatus || '</status>' ELSE '' END")):
    write(f"wr_default_{_mode}", _sql_row("row", _sql_leaf("id", "o_orderkey"), _sql), record("row", elements("id:long", "status:string=F")), "row", "orders", lambda: F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status")), default_values=_mode.upper())
write("wr_namespaces", f"'<r:region xmlns:r=\"{NS}\"><r:r_name>' || r_name || '</r:r_name></r:region>'", lambda: schema(record("region", elements("r_name:string")), 'elementFormDefault="qualified"'), "region", "region", lambda: F.struct("r_name"), python=False)
QUERIES["wr_namespaces"] = lambda spark, d: table(spark, d, "region").select(schema(record("region", elements("r_name:string")), 'elementFormDefault="qualified"').writer(f"{{{NS}}}region", prefixes={"r": NS}).column(F.struct("r_name")).alias("xml"))
write("wr_substitution", _sql_row("log", "CASE WHEN p_size > 25 THEN '<p:big>' || p_size || '</p:big>' ELSE '<p:small>' || p_size || '</p:small>' END"), '<element name="thing" type="int" abstract="true"/><element name="big" type="int" substitutionGroup="s:thing"/><element name="small" type="int" substitutionGroup="s:thing"/>' + record("log", '<element ref="s:thing"/>'), "log", "part", lambda: F.struct(F.when(F.col("p_size") > 25, F.col("p_size")).alias("big"), F.when(F.col("p_size") <= 25, F.col("p_size")).alias("small")), python=True)
_XSI = 'xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\"'
write("wr_xsi_type", f"'<p:box {HEAD} {_XSI}><thing xsi:type=\"p:big\"><p_partkey>' || p_partkey || '</p_partkey><p_size>' || p_size || '</p_size></thing></p:box>'", SHAPES, "box", "part", lambda: F.struct(F.struct(F.lit(f"{{{NS}}}big").alias("XSI_TYPE"), "p_partkey", "p_size").alias("thing")), python=True, xsi_type={f"{{{NS}}}thing": "AUTO"})
write("wr_any", f"'<p:bag {HEAD}><id>' || p_partkey || '</id><o:b xmlns:o=\"urn:o\">' || p_size || '</o:b></p:bag>'", ANY, "bag", "part", lambda: F.struct(F.col("p_partkey").alias("id"), F.create_map(F.lit("{urn:o}b"), F.array(F.concat(F.lit('<o:b xmlns:o="urn:o">'), F.col("p_size").cast("string"), F.lit("</o:b>")))).alias("_any")), python=True)
write("wr_mixed", f"'<p:doc {HEAD} id=\"' || doc_id || '\">' || source || '<lang>' || lang || '</lang></p:doc>'", MIXED, "doc", "documents", lambda: F.struct(F.col("doc_id").alias("id"), F.concat("source", F.lit("<lang>"), "lang", F.lit("</lang>")).alias("_")), python=True)
write("wr_hook", _sql_row("row", _sql_leaf("p_name", "upper(p_name)")), record("row", elements("p_name:string")), "row", "part", lambda: F.struct("p_name"), python=True, hooks=[Hook(before=[lambda value, path, kind: value.upper()], path=f"{{{NS}}}row/p_name")])
write("wr_array", f"'<p:order {HEAD}><o_orderkey>' || o_orderkey || '</o_orderkey>' || (SELECT string_agg('<line><l_linenumber>' || l_linenumber || '</l_linenumber><l_partkey>' || l_partkey || '</l_partkey></line>', '' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) || '</p:order>'", '<complexType name="line"><sequence>' + elements("l_linenumber:int", "l_partkey:long") + "</sequence></complexType>" + record("order", elements("o_orderkey:long", "line:s:line*")), "order", "orders", lambda: F.struct("o_orderkey", F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"))).alias("line")), prepare=lambda s, d: orders(s, d))
ORACLES["wr_array"] += " WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"
ORACLES["wr_array_python"] = ORACLES["wr_array"]
write("wr_repeated_block", f"'<p:order {HEAD}>' || (SELECT string_agg('<l_linenumber>' || l_linenumber || '</l_linenumber><l_partkey>' || l_partkey || '</l_partkey>', '' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) || '</p:order>'", record("order", f'<sequence maxOccurs="unbounded">{elements("l_linenumber:int", "l_partkey:long")}</sequence>'), "order", "orders", lambda: F.struct(F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"))).alias("seq_l_linenumber")), prepare=lambda s, d: orders(s, d))
for _tier in ("", "_python"):
    ORACLES["wr_repeated_block" + _tier] += " WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"


write("wr_fixed", _sql_row("row", _sql_leaf("id", "p_partkey"), "CASE WHEN p_size > 25 THEN '<unit>kg</unit>' ELSE '' END", attrs=" || CASE WHEN p_size % 2 = 0 THEN ' rev=\"4\"' ELSE '' END"), record("row", elements("id:long") + '<element name="unit" type="string" fixed="kg" minOccurs="0"/>', '<attribute name="rev" type="int" fixed="4"/>'), "row", "part", lambda: F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "kg").alias("unit"), F.when(F.col("p_size") % 2 == 0, F.lit(4)).alias("rev")))
write("wr_xsi_everywhere", f"'<p:part {HEAD} xmlns:x0=\"{XSD}\" {_XSI}><p_partkey xsi:type=\"x0:long\">' || p_partkey || '</p_partkey><p_name xsi:type=\"x0:string\">' || p_name || '</p_name></p:part>'", record("part", elements("p_partkey:long", "p_name:string")), "part", "part", lambda: F.struct("p_partkey", "p_name"), xsi_type_everywhere=True)
write("wr_epoch", _sql_row("row", _sql_leaf("at", "strftime(make_timestamp(event_id * 86413 * 1000000), '%Y-%m-%dT%H:%M:%SZ')"), _sql_leaf("exact", "strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '.25Z' ELSE 'Z' END")), record("row", elements("at:dateTime", "exact:dateTime")), "row", "events", lambda: F.struct((F.col("event_id") * 86413).alias("at"), F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".25").otherwise("")).alias("exact")))
write("wr_cdata", _sql_row("row", _sql_leaf("note", "'<![CDATA[<' || p_name || ' & ]]]]><![CDATA[>]]>'"), _sql_leaf("plain", "'&lt;' || p_name")), record("row", elements("note:string", "plain:string")), "row", "part", lambda: F.struct(F.concat(F.lit("<"), "p_name", F.lit(" & ]]>")).alias("note"), F.concat(F.lit("<"), "p_name").alias("plain")), cdata=[f"{{{NS}}}row/note"])


def _failing(kind: str) -> tuple[str, Callable[[], Column]]:
    """(schema of an element, data that it doesn't take)."""
    size = F.col("p_size")
    return {
        "missing": (record("row", elements("a:int", "b:int")), lambda: F.struct(size.alias("a"), F.lit(None).cast("int").alias("b"))),
        "fixed": (record("row", '<element name="a" type="int" fixed="99"/>'), lambda: F.struct(size.alias("a"))),
        "fixed_attribute": (record("row", "", '<attribute name="a" type="int" fixed="99"/>'), lambda: F.struct(size.alias("a"))),
        "required_attribute": (record("row", "", '<attribute name="a" type="int" use="required"/>'), lambda: F.struct(F.lit(None).cast("int").alias("a"))),
        "facet": (record("row", '<element name="a"><simpleType><restriction base="int"><minInclusive value="99"/></restriction></simpleType></element>'), lambda: F.struct(size.alias("a"))),
        "too_many": (record("row", '<element name="a" type="int" maxOccurs="2"/>'), lambda: F.struct(F.array(size, size, size).alias("a"))),
    }[kind]


@query("wr_errors", "SELECT * FROM (VALUES ('facet', true), ('fixed', true), ('fixed_attribute', true), ('missing', true), ('required_attribute', true), ('too_many', true), ('none', false)) AS k(kind, refused) CROSS JOIN (VALUES ('native'), ('python')) AS t(tier)")
def wr_errors(spark, d):
    """One part each, written with data that the schema refuses and with data that it takes."""
    one = table(spark, d, "part").where("p_size < 99").orderBy("p_partkey").limit(1)
    out = []
    for kind in ("missing", "fixed", "fixed_attribute", "required_attribute", "facet", "too_many", "none"):
        body, data = (record("row", elements("a:int")), lambda: F.struct(F.col("p_size").alias("a"))) if kind == "none" else _failing(kind)
        for tier in ("native", "python"):
            try:
                one.select(schema(body).writer(f"{{{NS}}}row").column(data(), python=tier == "python")).collect()
            except Exception as e:  # Spark's or the worker's
                out.append((kind, tier, any(w in str(e) for w in ("required", "fixed", "too small", "too many"))))
            else:
                out.append((kind, tier, False))
    return spark.createDataFrame(out, "kind string, tier string, refused boolean")


# --- sinks, utilities, catalog ---------------------------------------------------------------------------------------


@query("js_orders", "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS json FROM orders")
def js_orders(spark, d):
    own = schema(record("order", elements("o_orderkey:long", "o_orderstatus:string")))
    out = read(table(spark, d, "orders"), root("order", leaf("o_orderkey"), leaf("o_orderstatus")), own, "order", order_check=False)
    return out.select(F.to_json(F.struct("*")).alias("json"))


@query("ut_pack_unpack", "SELECT n_nationkey AS id, '{urn:n}' || n_name AS packed, 'urn:n' AS ns, n_name AS local, 'urn:n#' || n_name AS pid, n_name AS own FROM nation")
def ut_pack_unpack(spark, d):
    df = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), names.pack_type_col(F.lit("urn:n"), F.col("n_name")).alias("packed"), names.pack_id_col(F.lit("urn:n"), F.col("n_name")).alias("pid"))
    ns, local = names.unpack_type_cols(F.col("packed"))
    return df.select("id", "packed", ns.alias("ns"), local.alias("local"), "pid", names.unpack_id_cols(F.col("pid"))[1].alias("own"))


@query("ut_odd_even", "SELECT o_orderkey AS id, 'b d' AS odd, 'a c' AS even FROM orders")
def ut_odd_even(spark, d):
    items = F.array(*map(F.lit, "abcd"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(names.odd_elements_col(items), " ").alias("odd"), F.array_join(names.even_elements_col(items), " ").alias("even"))


@query("ut_duration2secs", "SELECT event_id AS id, CAST((event_id % 5) * 365.256 * 86400 + (event_id % 7) * 30.4 * 86400 + (event_id % 11) * 86400 + (event_id % 13) * 3600 AS BIGINT) AS secs FROM events")
def ut_duration2secs(spark, d):
    n = lambda k: (F.col("event_id") % k).cast("string")
    text = F.concat(F.lit("P"), n(5), F.lit("Y"), n(7), F.lit("M"), n(11), F.lit("DT"), n(13), F.lit("H"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.round(durations.duration2secs_col(text)).cast("bigint").alias("secs"))


@query("ut_add_duration", "SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate) + INTERVAL 14 MONTH + (date_part('day', o_orderdate) - 1 + 3) * INTERVAL 1 DAY, '%Y-%m-%d') AS day FROM orders")
def ut_add_duration(spark, d):
    since = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(durations.add_duration_col(F.lit("P1Y2M3D"), since), "yyyy-MM-dd").alias("day"))


def shop() -> XmlSchema:
    return schema('<import namespace="urn:i" schemaLocation="i.xsd"/>' + SIZES + PERSON + REGION + SHAPES + '<attribute name="a" type="int"/><group name="g"><sequence/></group>')


@query("cat_elements", f"SELECT * FROM (VALUES ('{{{NS}}}box'), ('{{{NS}}}region')) AS t(element)")
def cat_elements(spark, d):
    return shop().elements_df(spark)


@query("cat_types", f"SELECT * FROM (VALUES ('{{{NS}}}base'), ('{{{NS}}}big'), ('{{{NS}}}sizes'), ('{{{NS}}}thing')) AS t(type)")
def cat_types(spark, d):
    return shop().types_df(spark)


@query("cat_index", f"SELECT '{NS}' AS namespace, kind, name, false AS abstract, false AS \"final\" FROM (VALUES ('attribute', 'a'), ('complexType', 'base'), ('complexType', 'big'), ('complexType', 'thing'), ('element', 'box'), ('element', 'region'), ('group', 'g'), ('simpleType', 'sizes')) AS t(kind, name)")
def cat_index(spark, d):
    return shop().index_df(spark)


@query("cat_imports", "SELECT 'urn:i' AS namespace, 'i.xsd' AS location")
def cat_imports(spark, d):
    return shop().imports_df(spark)


@query("cat_extends", "SELECT * FROM (VALUES ('big', 'thing', true), ('thing', 'big', false), ('int', 'integer', true), ('int', 'string', false)) AS t(type, base, extends)")
def cat_extends(spark, d):
    own = shop()
    full = lambda n: f"{{{XSD if n in ('int', 'integer', 'string') else NS}}}{n}"
    pairs = (("big", "thing"), ("thing", "big"), ("int", "integer"), ("int", "string"))
    return spark.createDataFrame([(a, b, own.does_extend(full(a), full(b))) for a, b in pairs], "type string, base string, extends boolean")


TEMPLATE_OF = SIZES + record("crate", elements("label:string", "weight:decimal?", "xs:s:sizes*") + '<any namespace="##other" minOccurs="0"/>', '<attribute name="code" type="int" use="required"/><attribute name="old" type="int" use="prohibited"/>')
#: What the templates of a crate have to be, line by line.
TEMPLATES = {
    "data": (f"# is a unnamed {{{NS}}}crate", "'crate': {", "  'code': '42',  # {XSD}int, attribute is required", "  # is a {XSD}string", "  'label': 'example',", "  # is a {XSD}decimal", "  # is optional", "  'weight': '3.1415',", "  # is a list of {XSD}int", "  # occurs 0 <= # <= unbounded times", "  'xs': ['42 42', ],", "  # any element in any namespace but urn:shop, is optional", "},"),
    "xml": (f'<x0:crate xmlns:x0="{NS}" code="42">', "  <label>example</label>", "  <weight>3.1415</weight>", "  <xs>42 42</xs>", "  <!-- any element in any namespace but urn:shop, is optional -->", "</x0:crate>"),
    "hooked": ("'crate': {", "  'code': '42',  # {XSD}int, attribute is required", "  # content collapsed", "  'weight': '',", "  # made up", "  'xs': ['1 2 3', ],", "  # any element in any namespace but urn:shop, is optional", "},"),
}


def _lines(lines: tuple[str, ...]) -> str:
    lines = tuple(x.replace("{XSD}", f"{{{XSD}}}") for x in lines)
    quoted = (f"({i}, '{x.replace(chr(39), chr(39) * 2)}')" for i, x in enumerate(lines))
    return f"SELECT CAST(line AS INTEGER) AS line, text FROM (VALUES {', '.join(quoted)}) AS t(line, text)"


def _template(spark: SparkSession, output: str, comments: str = "NONE", **options) -> DataFrame:
    text = schema(TEMPLATE_OF).template(output, f"{{{NS}}}crate", comments=comments, **options)
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


@query("tp_data", _lines(TEMPLATES["data"]))
def tp_data(spark, d):
    return _template(spark, "DATA", "type,occur")


@query("tp_xml", _lines(TEMPLATES["xml"]))
def tp_xml(spark, d):
    return _template(spark, "XML")


@query("tp_hooked", _lines(TEMPLATES["hooked"]))
def tp_hooked(spark, d):
    at = f"{{{NS}}}crate"
    made = Hook(replace=lambda path, e, tree: tree | {"example": "1 2 3", "notes": ["made up"]}, path=f"{at}/xs", action="TEMPLATE")
    return _template(spark, "DATA", "NOTES", hooks=[Hook(replace="SKIP", path=f"{at}/label"), Hook(replace="COLLAPSE", path=f"{at}/weight", action="TEMPLATE"), made])


@query("tp_tree", "SELECT * FROM (VALUES (0, 'crate', '', 'element'), (1, 'label', '', 'element'), (2, 'weight', 'is optional', 'element'), (3, 'xs', 'occurs 0 <= # <= unbounded times', 'element'), (4, '', 'is optional', 'any')) AS t(n, name, occurs, kind)")
def tp_tree(spark, d):
    tree = schema(TEMPLATE_OF).template("TREE", f"{{{NS}}}crate")
    rows = [(x.get("key", ""), x["occurs"], x["kind"]) for x in (tree, *(c for c in tree["children"] if c["kind"] != "block"))]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, name string, occurs string, kind string")


@query("pg_scan_html", f"SELECT page_id AS id, page_id % 2 = 0 AS broken FROM pages")
def pg_scan_html(spark, d):
    """Raw pages are refused; every other one is put into a message as escaped text, and read."""
    own = schema(record("html", elements("x:string")))
    page = F.regexp_replace(F.coalesce("html", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    df = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, F.coalesce("html", F.lit(""))).otherwise(root("html", tag("x", esc(page)))).alias("xml"))
    return own.reader(f"{{{NS}}}html").frame(df, "xml", "PERMISSIVE", ("id",)).select("id", (F.size("errors") > 0).alias("broken"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
