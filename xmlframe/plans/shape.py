"""The Spark type of a compiled element."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import types as S

from xmlframe.plans.model import Complex, Element, Group, Options, Particle, Simple, Wildcard

ANY, ANY_ATTRIBUTE = "_any", "_any_attribute"
META = {"INCLUDE_PATH": ("_PATH", S.StringType()), "XML_NODE": ("_XML_NODE", S.StringType()), "NODE_TYPE": ("_NODE_TYPE", S.StringType())}
META |= {"ELEMENT_ORDER": ("_ELEMENT_ORDER", S.ArrayType(S.StringType())), "ATTRIBUTE_ORDER": ("_ATTRIBUTE_ORDER", S.ArrayType(S.StringType()))}


class ShapeError(ValueError):
    pass


_NAMED = {"string": S.StringType(), "boolean": S.BooleanType(), "binary": S.BinaryType(), "float": S.FloatType(), "double": S.DoubleType(), "tinyint": S.ByteType(), "smallint": S.ShortType(), "int": S.IntegerType(), "bigint": S.LongType()}


def spark_type(name: str) -> S.DataType:
    """The type that a built-in names; needs no session."""
    if name.startswith("decimal"):
        return S.DecimalType(*map(int, name[8:-1].split(",")))
    return _NAMED[name]


def simple_type(t: Simple) -> S.DataType:
    if t.variety == "union":
        return S.StringType()
    if t.variety == "list":
        return S.ArrayType(simple_type(t.item))
    return spark_type(t.builtin.spark)


class Shape:
    def __init__(self, options: Options, metas: dict[int, list[str]] | None = None) -> None:
        self.options, self.open = options, []
        self.metas = metas or {}  # id of an element: names of the predefined after hooks

    def root(self, e: Element) -> S.DataType:
        return self.value(e)

    def nil_wrapped(self, e: Element, kind: S.DataType) -> S.DataType:
        """An item of an array, where a nil needs a flag of its own."""
        if not e.nillable or self.options.nil_mode == "null":
            return kind
        if self.options.nil_mode == "string":
            return S.StringType() if not isinstance(kind, S.StructType) else kind
        return S.StructType([S.StructField("_", kind), S.StructField("nil", S.BooleanType())])

    def value(self, e: Element) -> S.DataType:
        kinds = list(e.xsi.values()) or [e.type]
        out = self.type(kinds[0])
        if len(kinds) > 1:
            fields: dict[str, S.DataType] = {"XSI_TYPE": S.StringType()}
            for k in kinds:
                t = self.type(k)
                for f in t.fields if isinstance(t, S.StructType) else [S.StructField("_", t)]:
                    fields.setdefault(f.name, f.dataType)
            out = S.StructType([S.StructField(k, v) for k, v in fields.items()])
        for name in self.metas.get(id(e), ()):
            if isinstance(out, S.StructType):
                out = S.StructType([*out.fields, S.StructField(*META[name])])
        return out

    def type(self, t: Simple | Complex) -> S.DataType:
        if isinstance(t, Simple):
            return simple_type(t)
        if t.any_type:
            return S.StringType()
        if t.mixed and self.options.mixed_elements != "STRUCTURAL" and self.options.mixed_elements not in ("ATTRIBUTES", "TEXTUAL"):
            return S.StringType()
        if any(t is x for x in self.open):
            return S.StringType()  # the record in JSON
        self.open.append(t)
        fields: dict[str, S.DataType] = {}
        if t.simple is not None:
            fields["_"] = simple_type(t.simple)
        elif t.mixed:
            fields["_"] = S.StringType()
        elif t.content is not None:
            self.particle(t.content, fields)
        for a in t.attributes:
            if a.use != "prohibited":
                self._add(fields, a.key, simple_type(a.type), t.name)
        if t.any_attribute and self.options.any_attribute != "SKIP_ALL":
            fields[ANY_ATTRIBUTE] = S.MapType(S.StringType(), S.StringType())
        self.open.pop()
        return S.StructType([S.StructField(k, v) for k, v in fields.items()])

    @staticmethod
    def _add(fields: dict[str, S.DataType], key: str, kind: S.DataType, where: str) -> None:
        if key in fields and fields[key] != kind:
            raise ShapeError(f"`{key}' stands for two things of different type in {where}: rename one with key_rewrite")
        fields[key] = kind

    def particle(self, p: Particle, fields: dict[str, S.DataType]) -> None:
        if p.max == 0:
            return
        term = p.term
        if isinstance(term, Wildcard):
            if self.options.any_element != "SKIP_ALL":
                fields[ANY] = S.MapType(S.StringType(), S.ArrayType(S.StringType()))
        elif isinstance(term, Element):
            self.element(term, p.many, fields)
        elif p.many:
            inner: dict[str, S.DataType] = {}
            for x in term.particles:
                self.particle(x, inner)
            self._add(fields, p.label, S.ArrayType(S.StructType([S.StructField(k, v) for k, v in inner.items()])), p.label)
        else:
            for x in term.particles:
                self.particle(x, fields)

    def element(self, e: Element, many: bool, fields: dict[str, S.DataType]) -> None:
        if e.members:
            kinds = {m.key: self.value(m) for m in e.members}
            if many:
                self._add(fields, e.key, S.ArrayType(S.StructType([S.StructField(k, v) for k, v in kinds.items()])), e.path)
            else:
                for k, v in kinds.items():
                    self._add(fields, k, v, e.path)
            return
        kind = self.value(e)
        if many:
            self._add(fields, e.key, S.ArrayType(self.nil_wrapped(e, kind)), e.path)
            return
        if e.nillable and self.options.nil_mode == "string" and not isinstance(kind, S.StructType):
            kind = S.StringType()
        self._add(fields, e.key, kind, e.path)
        if e.nillable and self.options.nil_mode == "flag":
            self._add(fields, f"{e.key}__nil", S.BooleanType(), e.path)


def needs_order(t: Complex, options: Options, seen: tuple = ()) -> str | None:
    """Why a type can't be read by name alone; None if it can."""
    if t.any_type:
        return "anyType"
    if t.mixed:
        return "mixed content"
    if any(t is x for x in seen):
        return "recursion"
    if t.any_attribute and options.any_attribute != "SKIP_ALL":
        return "attribute wildcard"

    def of_particle(p: Particle, top: bool) -> str | None:
        if isinstance(p.term, Wildcard):
            return "element wildcard"
        if isinstance(p.term, Group):
            if p.many:
                return "repeated block"
            if p.term.kind == "choice" and any(isinstance(x.term, Group) for x in p.term.particles):
                return "blocks in a choice"
            if p.min == 0 and options.check_occurs and len(p.term.particles) > 1:
                return "optional block"
            if p.term.kind == "sequence" and options.order_check and len(p.term.particles) > 1 and (options.order_check == "python" or not _distinct(p)):
                return "order of a sequence"
            return next((w for x in p.term.particles if (w := of_particle(x, False))), None)
        e = p.term
        if e.members or e.xsi or e.blocked or e.abstract:
            return "element switch"
        return of_type(e.type)

    def of_type(kind: Simple | Complex) -> str | None:
        if isinstance(kind, Complex):
            return needs_order(kind, options, (*seen, t))
        return "QName" if uses_qname(kind) or kind.blocked else None

    for a in t.attributes:
        if why := of_type(a.type):
            return why
    return (t.simple and of_type(t.simple)) or (t.content and of_particle(t.content, True)) or None


def ranks(p: Particle) -> list[list[str]]:
    """Local names in the order in which a block wants them; those of a choice or an all block share a place."""
    if isinstance(p.term, Element):
        return [[p.term.local]]
    if isinstance(p.term, Group):
        parts = [r for x in p.term.particles for r in ranks(x)]
        return parts if p.term.kind == "sequence" else [[n for r in parts for n in r]]
    return []


def _distinct(p: Particle) -> bool:
    names = [n for r in ranks(p) for n in r]
    return len(names) == len(set(names))


def _blocks(t: Complex, path: str = "/*") -> Iterator[tuple[str, Particle]]:
    """(XPath of the elements that hold it, content model) of a type and of all it holds."""

    def inner(p: Particle) -> Iterator[tuple[str, Particle]]:
        if isinstance(p.term, Element) and isinstance(p.term.type, Complex):
            yield from _blocks(p.term.type, f"{path}/*[local-name()='{p.term.local}']")
        for x in p.term.particles if isinstance(p.term, Group) else ():
            yield from inner(x)

    if t.content is not None:
        yield path, t.content
        yield from inner(t.content)


def out_of_order(t: Complex) -> list[str]:
    """XPath expressions for elements that stand right before one that has to come first, in a message and what it holds.

    The engine takes expressions of up to a hundred operators only, so there is one for each block, and ranks are looked up in a text.
    """
    out = []
    for path, content in _blocks(t):
        found = ranks(content)
        if len(found) > 1:
            known = "".join(f" {n}={i}" for i, names in enumerate(found) for n in names) + " "
            rank = lambda of, known=known: f"number(substring-before(substring-after('{known}',concat(' ',local-name({of}),'=')),' '))"
            out.append(f"{path}/*[{rank('')}>{rank('following-sibling::*[1]')}]")
    return out


def spaces(t: Complex) -> dict[str, set[str]]:
    """The namespaces that an element of a name may have in a message, by local name."""
    out: dict[str, set[str]] = {}

    def visit(p: Particle) -> None:
        if isinstance(p.term, Element):
            out.setdefault(p.term.local, set()).add(p.term.ns)
        for x in p.term.particles if isinstance(p.term, Group) else ():
            visit(x)

    for _, content in _blocks(t):
        visit(content)
    return out


def uses_qname(t: Simple) -> bool:
    return bool(t.builtin and t.builtin.kind == "qname") or bool(t.item and uses_qname(t.item)) or any(uses_qname(m) for m in t.members)
