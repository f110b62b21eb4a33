"""Whole documents of a plant nursery: what content models, attributes, derivation, switches and wildcards do in either direction."""

from itertools import permutations

import pytest

from xmlframe.engine import XmlSchema
from xmlframe.operators.values import DataError
from xmlframe.plans.model import Options

NS, XSD, XSI = "urn:nursery", "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2001/XMLSchema-instance"


def nursery(body: str, form: str = "unqualified") -> XmlSchema:
    return XmlSchema(f'<xs:schema xmlns:xs="{XSD}" xmlns:n="{NS}" targetNamespace="{NS}" elementFormDefault="{form}">{body}</xs:schema>')


def element(name: str, kind: str = "xs:string", low: int = 1, high: int | str = 1, **more) -> str:
    extra = "".join(f' {k}="{v}"' for k, v in more.items())
    return f'<xs:element name="{name}" type="{kind}" minOccurs="{low}" maxOccurs="{high}"{extra}/>'


def holder(name: str, model: str, attributes: str = "", **more) -> str:
    extra = "".join(f' {k}="{v}"' for k, v in more.items())
    return f'<xs:element name="{name}"{extra}><xs:complexType>{model}{attributes}</xs:complexType></xs:element>'


def seq(*parts: str, low: int = 1, high: int | str = 1) -> str:
    return f'<xs:sequence minOccurs="{low}" maxOccurs="{high}">{"".join(parts)}</xs:sequence>'


def one_of(*parts: str, low: int = 1, high: int | str = 1) -> str:
    return f'<xs:choice minOccurs="{low}" maxOccurs="{high}">{"".join(parts)}</xs:choice>'


class Desk:
    """Reads and writes one element of a schema, without namespaces in the text."""

    def __init__(self, own: XmlSchema, name: str, **options) -> None:
        self.own, self.name, self.options = own, f"{{{NS}}}{name}", {"elements_qualified": "NONE", **options}

    def read(self, xml: str, **more):
        return self.own.reader(self.name, **self.options | more).read(xml)

    def write(self, data, **more) -> str:
        return self.own.writer(self.name, include_namespaces=False, **self.options | more).write(data)

    def both(self, xml: str, data, written: str | None = None) -> None:
        assert self.read(xml) == data
        text = self.write(data)
        assert text == (written or xml) and self.read(text) == data

    def refuses(self, *, xml: str | None = None, data=None, **more) -> str:
        with pytest.raises(DataError) as e:
            self.read(xml, **more) if xml is not None else self.write(data, **more)
        return str(e.value).replace(f"{{{NS}}}", "")


# --- content models ------------------------------------------------------------------------------------------------

BED = holder("bed", seq(element("soil"), element("row", "xs:short", 2, 4), element("sign", low=0), element("worm", "xs:long", 0, "unbounded")))


@pytest.mark.parametrize("rows, sign, worms", [((7, 9), None, ()), ((1, 2, 3, 4), "roses", (10**12,)), ((5, 5, 5), "", (3, 2, 1))])
def test_a_bed_has_rows_signs_and_worms(rows, sign, worms):
    xml = "<soil>loam</soil>" + "".join(f"<row>{r}</row>" for r in rows) + (f"<sign>{sign}</sign>" if sign else "<sign/>" if sign == "" else "") + "".join(f"<worm>{w}</worm>" for w in worms)
    data = {"soil": "loam", "row": list(rows)} | ({"sign": sign} if sign is not None else {}) | ({"worm": list(worms)} if worms else {})
    Desk(nursery(BED), "bed").both(f"<bed>{xml}</bed>", data)


def test_beds_that_do_not_fit():
    desk = Desk(nursery(BED), "bed")
    assert "`row' missing at bed" in desk.refuses(xml="<bed><soil>clay</soil><row>1</row></bed>")
    assert "`soil' missing" in desk.refuses(xml="<bed><row>1</row><row>2</row></bed>")
    assert "`gnome' not processed" in desk.refuses(xml="<bed><soil>a</soil><row>1</row><row>2</row><gnome/></bed>")
    assert "not processed" in desk.refuses(xml="<bed><soil>a</soil>" + "<row>1</row>" * 5 + "</bed>")
    assert "too many elements for `row', max 4 found 6" in desk.refuses(data={"soil": "a", "row": [1] * 6})
    assert "tag `gnome' not used at bed" in desk.refuses(data={"soil": "a", "row": [1, 2], "gnome": 1})
    assert desk.write({"soil": "a", "row": [1, 2], "gnome": 1}, ignore_unused_tags="gn.me") == "<bed><soil>a</soil><row>1</row><row>2</row></bed>"


def test_tours_repeat_whole_blocks():
    tour = holder("tour", seq(element("guide"), seq(element("stop"), element("photo", "xs:int", 0, "unbounded"), low=0, high="unbounded"), element("fee", "xs:decimal", 0)))
    desk = Desk(nursery(tour), "tour")
    desk.both("<tour><guide>Mo</guide></tour>", {"guide": "Mo"})
    desk.both("<tour><guide>Mo</guide><stop>pond</stop><stop>shed</stop><photo>8</photo><photo>6</photo></tour>", {"guide": "Mo", "seq_stop": [{"stop": "pond"}, {"stop": "shed", "photo": [8, 6]}]})
    assert "`fee'" in desk.refuses(xml="<tour><guide>Mo</guide><fee>1</fee><fee>2</fee></tour>")


def test_optional_blocks_come_whole_or_not_at_all():
    desk = Desk(nursery(holder("visit", seq(element("day"), seq(element("from"), element("to"), low=0)))), "visit")
    desk.both("<visit><day>Mon</day></visit>", {"day": "Mon"})
    desk.both("<visit><day>Mon</day><from>8</from><to>9</to></visit>", {"day": "Mon", "from": "8", "to": "9"})
    assert "`to' missing" in desk.refuses(xml="<visit><day>Mon</day><from>8</from></visit>")


def test_choices():
    pay = holder("pay", one_of(element("cash", "xs:decimal"), seq(element("card"), element("pin", "xs:short")), element("voucher", low=0)))
    desk = Desk(nursery(pay), "pay")
    desk.both("<pay><card>X9</card><pin>1234</pin></pay>", {"card": "X9", "pin": 1234})
    desk.both("<pay><voucher>V</voucher></pay>", {"voucher": "V"})
    desk.both("<pay/>", {})
    assert "`voucher' not processed" in desk.refuses(xml="<pay><card>X</card><pin>1</pin><voucher>V</voucher></pay>")
    log = Desk(nursery(holder("log", one_of(element("sow"), element("reap", "xs:int"), high=3))), "log")
    log.both("<log><reap>4</reap><sow>peas</sow><reap>2</reap></log>", {"cho_sow": [{"reap": 4}, {"sow": "peas"}, {"reap": 2}]})
    assert "choice" in log.refuses(xml="<log/>")
    assert "`sow' not processed" in log.refuses(xml="<log>" + "<sow>x</sow>" * 4 + "</log>")
    assert "found 5 blocks for `cho_sow', must be between 1 and 3" in log.refuses(data={"cho_sow": [{"sow": "x"}] * 5})
    nest = Desk(nursery(holder("nest", one_of(one_of(element("twig"), element("leaf"), high="unbounded"), element("egg", "xs:int")))), "nest")
    nest.both("<nest><leaf>oak</leaf><twig>ash</twig></nest>", {"cho_twig": [{"leaf": "oak"}, {"twig": "ash"}]})
    nest.both("<nest><egg>3</egg></nest>", {"egg": 3})


def test_all_blocks_take_every_order_and_write_one():
    desk = Desk(nursery(holder("mix", "<xs:all>" + element("peat", "xs:int") + element("sand", "xs:int") + element("bark", "xs:int", 0) + "</xs:all>")), "mix")
    amounts = {"peat": 40, "sand": 35, "bark": 25}
    for names in [p for n in (2, 3) for p in permutations(amounts, n) if {"peat", "sand"} <= set(p)]:
        kept = {k: v for k, v in amounts.items() if k in names}
        desk.both("<mix>" + "".join(f"<{k}>{amounts[k]}</{k}>" for k in names) + "</mix>", kept, "<mix>" + "".join(f"<{k}>{v}</{k}>" for k, v in kept.items()) + "</mix>")
    assert "`sand' missing" in desk.refuses(xml="<mix><bark>1</bark><peat>2</peat></mix>")


def test_groups_references_and_recursion():
    body = f'<xs:group name="size">{seq(element("tall", "xs:int"), element("wide", "xs:int"))}</xs:group>'
    body += holder("pots", seq('<xs:group ref="n:size" minOccurs="0" maxOccurs="unbounded"/>'))
    body += holder("branch", seq('<xs:element ref="n:branch" minOccurs="0"/>', element("leaves", "xs:int")))
    own = nursery(body)
    Desk(own, "pots").both("<pots><tall>3</tall><wide>2</wide><tall>30</tall><wide>20</wide></pots>", {"gr_size": [{"tall": 3, "wide": 2}, {"tall": 30, "wide": 20}]})
    twig = Desk(own, "branch").read("<branch><branch><branch><leaves>1</leaves></branch><leaves>2</leaves></branch><leaves>4</leaves></branch>")
    assert twig["leaves"] == 4 and set(twig) == {"branch", "leaves"}


# --- attributes and derivation -------------------------------------------------------------------------------------


def attribute(name: str, kind: str = "xs:string", **more) -> str:
    return f'<xs:attribute name="{name}" type="{kind}"' + "".join(f' {k}="{v}"' for k, v in more.items()) + "/>"


def test_attributes_of_a_label():
    label = holder("label", "", attribute("sku", use="required") + attribute("old", use="prohibited") + attribute("rev", "xs:int", fixed=3) + attribute("unit", default="pot"))
    desk = Desk(nursery(label), "label")
    assert desk.read('<label sku="A7"/>') == {"sku": "A7", "rev": 3, "unit": "pot"}
    assert desk.read('<label sku="A7" unit="tray"/>', default_values="IGNORE") == {"sku": "A7", "rev": 3, "unit": "tray"}
    assert desk.read('<label sku="A7" unit="pot"/>', default_values="MINIMAL") == {"sku": "A7", "rev": 3}
    assert desk.write({"sku": 'say "hi"\n', "unit": "a<b"}) == '<label sku="say &quot;hi&quot;&#10;" unit="a&lt;b"/>'
    for given in ({"xml": "<label/>"}, {"data": {"unit": "pot"}}):
        assert "attribute `sku' is required at label/@sku" in desk.refuses(**given)
    for given in ({"xml": '<label sku="a" old="b"/>'}, {"data": {"sku": "a", "old": "b"}}):
        assert "attribute `old' is prohibited" in desk.refuses(**given)
    for given in ({"xml": '<label sku="a" rev="4"/>'}, {"data": {"sku": "a", "rev": 4}}):
        assert "attribute `rev' is fixed to `3', not `4'" in desk.refuses(**given)


def test_types_grow_and_shrink():
    plant = f'<xs:complexType name="plant">{seq(element("latin"), element("price", "xs:decimal"))}{attribute("id", "xs:int", use="required")}</xs:complexType>'
    tree = f'<xs:complexType name="tree"><xs:complexContent><xs:extension base="n:plant">{seq(element("girth", "xs:int"))}{attribute("protected", "xs:boolean")}</xs:extension></xs:complexContent></xs:complexType>'
    seed = f'<xs:complexType name="seed"><xs:complexContent><xs:restriction base="n:plant">{seq(element("latin"))}</xs:restriction></xs:complexContent></xs:complexType>'
    weight = f'<xs:complexType name="weight"><xs:simpleContent><xs:extension base="xs:float">{attribute("scale")}</xs:extension></xs:simpleContent></xs:complexType>'
    own = nursery(plant + tree + seed + weight + "".join(element(f"a_{k}", f"n:{k}").replace(' minOccurs="1" maxOccurs="1"', "") for k in ("tree", "seed", "weight")))
    Desk(own, "a_tree").both('<a_tree id="5" protected="true"><latin>Acer</latin><price>12</price><girth>90</girth></a_tree>', {"id": 5, "protected": True, "latin": "Acer", "price": 12, "girth": 90})
    Desk(own, "a_seed").both('<a_seed id="6"><latin>Pisum</latin></a_seed>', {"id": 6, "latin": "Pisum"})
    Desk(own, "a_weight").both('<a_weight scale="kg">2.5</a_weight>', {"_": 2.5, "scale": "kg"})
    assert own.type_extensions(f"{{{NS}}}plant") == [f"{{{NS}}}seed", f"{{{NS}}}tree"] and own.does_extend(f"{{{NS}}}weight", f"{{{XSD}}}float")


def test_substitution():
    kinds = element("tool", "xs:string").replace(' minOccurs="1" maxOccurs="1"', ' abstract="true"')
    kinds += "".join(f'<xs:element name="{n}" type="xs:string" substitutionGroup="n:{of}"/>' for n, of in (("spade", "tool"), ("hoe", "tool"), ("small-hoe", "hoe")))
    own = nursery(kinds + holder("hook", seq('<xs:element ref="n:tool"/>')) + holder("shed", seq('<xs:element ref="n:tool" maxOccurs="unbounded"/>')))
    Desk(own, "hook").both("<hook><hoe>old</hoe></hook>", {"hoe": "old"})
    Desk(own, "shed").both("<shed><small-hoe>a</small-hoe><spade>b</spade></shed>", {"tool": [{"small-hoe": "a"}, {"spade": "b"}]})
    assert "abstract element `tool' used at hook/tool" in Desk(own, "hook").refuses(xml="<hook><tool>x</tool></hook>")
    assert {x.rpartition("}")[2] for x in own.substitution_members(f"{{{NS}}}tool")} == {"spade", "hoe", "small-hoe"}


def test_type_switches():
    body = f'<xs:complexType name="care">{attribute("who")}</xs:complexType><xs:complexType name="watering"><xs:complexContent><xs:extension base="n:care">{seq(element("litres", "xs:int"))}</xs:extension></xs:complexContent></xs:complexType>'
    desk = Desk(nursery(body + holder("plan", seq(element("step", "n:care", 1, "unbounded")))), "plan", xsi_type={f"{{{NS}}}care": "AUTO"}, prefixes={"n": NS})
    xml = f'<plan xmlns:n="{NS}" xmlns:xsi="{XSI}"><step who="Li"/><step xsi:type="n:watering" who="Bo"><litres>9</litres></step></plan>'
    data = {"step": [{"XSI_TYPE": f"{{{NS}}}care", "who": "Li"}, {"XSI_TYPE": f"{{{NS}}}watering", "who": "Bo", "litres": 9}]}
    assert desk.read(xml) == data
    assert desk.read(desk.own.writer(desk.name, **desk.options).write(data)) == data
    assert "does not contain" in desk.refuses(xml=xml.replace("n:watering", "n:pruning"))


# --- wildcards, mixed content, namespaces --------------------------------------------------------------------------


def test_wildcards():
    desk = Desk(nursery(holder("card", seq(element("name"), '<xs:any namespace="##other" minOccurs="0" maxOccurs="unbounded" processContents="lax"/>'), '<xs:anyAttribute namespace="##other"/>')), "card")
    xml = '<card xmlns:f="urn:florist" f:ribbon="red"><name>Ana</name><f:bow>big</f:bow><f:bow>small</f:bow></card>'
    assert desk.read(xml) == {"name": "Ana"}
    taken = desk.read(xml, any_element="TAKE_ALL", any_attribute="TAKE_ALL")
    assert taken["_any_attribute"] == {"{urn:florist}ribbon": "red"} and [x.count("urn:florist") for x in taken["_any"]["{urn:florist}bow"]] == [1, 1]
    again = desk.own.writer(desk.name, **desk.options).write(taken)
    assert desk.read(again, any_element="TAKE_ALL", any_attribute="TAKE_ALL") == taken
    assert desk.read(xml, any_element=lambda name, node, path: ("bows", node.text.upper()))["_any"] == {"bows": ["BIG", "SMALL"]}


def test_mixed_and_untyped_content():
    body = f'<xs:element name="note"><xs:complexType mixed="true">{seq(element("plant"))}{attribute("by")}</xs:complexType></xs:element><xs:element name="free" type="xs:anyType"/>'
    note, free = Desk(nursery(body), "note"), Desk(nursery(body), "free")
    xml = '<note by="Io">cut <plant>ivy</plant> now</note>'
    wanted = {"TEXTUAL": {"_": "cut ivy now", "by": "Io"}, "STRUCTURAL": {"plant": "ivy", "by": "Io"}, "XML_STRING": xml, "ATTRIBUTES": {"_": xml, "by": "Io"}}
    assert {k: note.read(xml, mixed_elements=k) for k in wanted} == wanted
    assert note.write({"_": "cut <plant>ivy</plant> now", "by": "Io"}) == xml
    assert free.read("<free>any</free>") == "any" and free.read("<free><b/></free>") == "<free><b/></free>"
    assert free.read("<free>any</free>", any_type=lambda path, node: len(node.text)) == 3


@pytest.mark.parametrize("form, child", [("qualified", "g:pot"), ("unqualified", "pot")])
def test_forms(form, child):
    own = nursery(holder("shelf", seq(element("pot", "xs:int"))), form)
    xml = f'<g:shelf xmlns:g="{NS}"><{child}>8</{child}></g:shelf>'
    assert own.reader(f"{{{NS}}}shelf").read(xml) == {"pot": 8} and own.writer(f"{{{NS}}}shelf", prefixes={"g": NS}).write({"pot": 8}) == xml
    with pytest.raises(DataError):
        own.reader(f"{{{NS}}}shelf").read(xml.replace(child, "pot" if form == "qualified" else "g:pot"))


def test_several_schemas_and_versions():
    price = f'<schema xmlns="{XSD}" targetNamespace="urn:price"><element name="eur" type="decimal"/></schema>'
    list_ = f'<schema xmlns="{XSD}" xmlns:p="urn:price" targetNamespace="urn:list"><element name="prices"><complexType><sequence><element ref="p:eur" maxOccurs="3"/></sequence></complexType></element></schema>'
    own = XmlSchema([price, list_])
    xml = '<l:prices xmlns:l="urn:list" xmlns:p="urn:price"><p:eur>1.5</p:eur><p:eur>2</p:eur></l:prices>'
    assert [float(x) for x in own.reader("{urn:list}prices").read(xml)["eur"]] == [1.5, 2.0]
    assert own.list_namespaces() == ["urn:list", "urn:price"]
    old = XmlSchema('<schema xmlns="http://www.w3.org/2000/10/XMLSchema" targetNamespace="urn:old"><element name="year" type="int"/></schema>')
    assert old.reader("{urn:old}year", elements_qualified="NONE").read("<year>2000</year>") == 2000
    bare = XmlSchema(f'<schema xmlns="{XSD}"><element name="spot" type="int"/></schema>')
    assert bare.elements() == ["spot"] and bare.reader("spot").read("<spot>1</spot>") == 1


@pytest.mark.parametrize("rule", ["urn:secret", "{urn:secret}code", {"urn:secret": True}, lambda name, ns, local, path: ns == "urn:secret" or None])
def test_blocked_namespaces(rule):
    secret = f'<schema xmlns="{XSD}" targetNamespace="urn:secret"><simpleType name="code"><restriction base="string"/></simpleType></schema>'
    own = XmlSchema([secret, f'<schema xmlns="{XSD}" xmlns:s="urn:secret" targetNamespace="{NS}"><element name="gate" type="s:code"/></schema>'])
    assert own.reader(f"{{{NS}}}gate", elements_qualified="NONE").read("<gate>1</gate>") == "1"
    with pytest.raises(DataError, match="blocked"):
        own.reader(f"{{{NS}}}gate", elements_qualified="NONE", block_namespace=[rule]).read("<gate>1</gate>")


def test_options():
    with pytest.raises(TypeError):
        Options(no_such_option=2)
    own = nursery(holder("tag", seq(element("text"), element("size", "xs:byte"))))
    with pytest.raises(DataError, match="illegal value `x' .*at line 7/size"):
        own.reader(f"{{{NS}}}tag", path="line 7").read(f'<t:tag xmlns:t="{NS}"><text/><size>x</size></t:tag>')
    text = own.writer(f"{{{NS}}}tag", cdata=[f"{{{NS}}}tag/text"], include_namespaces=False, elements_qualified="NONE").write({"text": "a]]>b & <c>", "size": 1})
    assert text == "<tag><text><![CDATA[a]]]]><![CDATA[>b & <c>]]></text><size>1</size></tag>"
    assert own.reader(f"{{{NS}}}tag", elements_qualified="NONE").read(text)["text"] == "a]]>b & <c>"
