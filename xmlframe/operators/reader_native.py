"""Reading by name with Catalyst: ``from_xml`` into texts, then checks, casts and defaults as column expressions.

Every leaf is read as a text and every element as an array, because a bad value would null its neighbours and a repeated
one would replace the first. Violations become an array of (code, path, message).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from xmlframe.functions import facets as FA
from xmlframe.functions import types as T
from xmlframe.operators.values import read_simple
from xmlframe.plans.model import Attribute, Complex, Element, Group, Options, Particle, Simple
from xmlframe.plans.shape import Shape, out_of_order, spaces
from xmlframe.workers import fresh

ERROR = S.StructType([S.StructField("code", S.StringType()), S.StructField("path", S.StringType()), S.StructField("message", S.StringType())])
_VALUE, _ANY = "_VALUE", "xs_any"
_READ = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": _VALUE, "ignoreSurroundingSpaces": "false", "wildcardColName": _ANY, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
#: The name in a start tag, and a declaration of a namespace: prefix, and namespace in either kind of quotes.
_TAG = r"<([^\s<>/!?][^\s<>/]*)"
_ROOT = r"^\s*(?:<\?[^>]*>\s*|<!--(?s:.*?)-->\s*)*<(?:[\w.\-]+:)?([\w.\-]+)"
_DECLARED = r"""\sxmlns:?([^\s=]*)\s*=\s*(?:"([^"]*)"|'([^']*)')"""


class Error(NamedTuple):
    """A possible violation: the condition and what to report, or (without a condition) an array of reports."""

    bad: Column | None
    report: Column


Value = tuple[Column, list[Error]]


def _none() -> Column:
    return F.array().cast(S.ArrayType(ERROR))


def _error(bad: Column, code: str, path: str, message: Column | str) -> Error:
    text = F.lit(message) if isinstance(message, str) else message
    return Error(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), text.alias("message")))


def _only(where: Column, errors: list[Error]) -> list[Error]:
    """The errors, as far as the (never null) condition holds."""
    return [Error(None, F.when(where, e.report).otherwise(_none())) if e.bad is None else Error(where & e.bad, e.report) for e in errors]


def joined(errors: list[Error]) -> Column:
    """All violations of a row. Reports are built for rows with a violation only; other rows see one condition."""
    single = [e for e in errors if e.bad is not None]
    parts = [e.report for e in errors if e.bad is None]
    if single:
        some = F.concat(*(F.when(e.bad, F.array(e.report)).otherwise(_none()) for e in single))
        parts.insert(0, F.when(reduce(lambda a, b: a | b, (e.bad for e in single)), some).otherwise(_none()))
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def simple(t: Simple, text: Column, path: str, options: Options, known: Column | None = None) -> Value:
    """Value and errors of a text; a null text gives a null value and no error. ``known`` is a column that has the value already."""
    if t.variety == "union":
        fits = []
        for m in t.members:
            _, errors = simple(m, text, path, options)
            squeezed = FA.space_col(FA.Facets(space="collapse"), text) if m.builtin and m.builtin.kind != "text" else text
            fits.append(F.when(F.size(joined(errors)) == 0, squeezed))
        value = F.coalesce(*fits) if known is None else known
        return value, [_error(text.isNotNull() & value.isNull(), "union", path, F.concat(F.lit("no match for `"), text, F.lit(f"' in union at {path}#union")))]
    errors: list[Error] = []
    for f in t.steps:
        text = FA.space_col(f, text)
        seen = FA.space_col(FA.Facets(space="collapse"), text) if t.variety == "list" else text
        for bad, said in FA.lexical_cols(f, seen):
            errors.append(_error(bad, "facet", path, F.concat(said, F.lit(f" at {path}#facet"))))
    if t.variety == "list":
        if t.builtin and options.check_values and t.builtin.check:
            errors.append(_error(~text.rlike(t.builtin.check), "value", path, _illegal(text, t, path)))
        trimmed = FA.space_col(FA.Facets(space="collapse"), text)
        items = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))
        value = F.transform(items, lambda x: simple(t.item, x, path, options)[0]) if known is None else known
        errors.append(Error(None, F.coalesce(F.flatten(F.transform(items, lambda x: joined(simple(t.item, x, path, options)[1]))), _none())))
    else:
        value, ok = T.checked_col(t.builtin, text, options.check_values)
        if known is not None:
            value, ok = known, None if ok is None else known.isNotNull() | text.isNull()
        if ok is not None:
            errors.append(_error(~ok, "value", path, _illegal(text, t, path)))
    shown = T.spaced_col(text, t.builtin.space) if t.builtin else text
    for f in t.steps:
        kind = t.builtin.kind if t.builtin and t.variety == "atomic" else "text"
        for bad, said in FA.value_cols(f, kind, shown, value, is_list=t.variety == "list", date_facets=options.date_facets, as_text=bool(t.builtin) and t.builtin.spark == "string"):
            errors.append(_error(bad, "facet", path, F.concat(said, F.lit(f" at {path}#facet"))))
    return value, errors


def _illegal(text: Column, t: Simple, path: str) -> Column:
    return F.concat(F.lit("illegal value `"), text, F.lit(f"' for type {t.name} at {path}"))


def repeated(p: Particle) -> Iterator[Element]:
    """The elements of a content model that come as arrays."""
    if isinstance(p.term, Group):
        for x in p.term.particles:
            yield from repeated(x)
    elif p.many:
        yield p.term


def _tags_in_order(p: Particle) -> str | None:
    """A pattern that only tags in the order of a sequence meet; none where it holds more than elements and further sequences."""
    if isinstance(p.term, Element):
        t = p.term.type
        inner = (_tags_in_order(t.content) if t.content is not None else "") if isinstance(t, Complex) else ""
        name = rf"(?:[^\s<>:/]+:)?\Q{p.term.local}\E"
        return None if inner is None or p.term.members else rf"(?:[^<]*+<{name}(?:\s[^<>]*)?(?<!/)>{inner}[^<]*+</{name}\s*>|[^<]*+<{name}(?:\s[^<>]*)?/>)*+"
    if not isinstance(p.term, Group) or p.term.kind != "sequence" or p.many:
        return None
    parts = [_tags_in_order(x) for x in p.term.particles]
    return None if None in parts else "".join(parts)


class NativeReader:
    """``column(xml)`` gives a struct (data, errors)."""

    def __init__(self, root: Element, options: Options) -> None:
        self.root, self.options = root, options
        self.defaults = options.default_values or "EXTEND"
        self.shape = Shape(options)

    # -- the schema of texts
    def _texts(self, e: Element) -> S.DataType:
        t = e.type
        fields: dict[str, S.DataType] = {}
        if isinstance(t, Complex):
            for a in t.attributes:
                fields["_" + a.local] = S.StringType()
            if t.simple is not None:
                fields[_VALUE] = S.StringType()
            elif t.content is not None:
                self._particle_texts(t.content, fields)
            if e.nillable:
                fields["_nil"] = S.StringType()
            if t.simple is None:
                fields[_ANY] = S.ArrayType(S.StringType())
            return S.StructType([S.StructField(k, v) for k, v in fields.items()])
        if e.nillable:
            return S.StructType([S.StructField(_VALUE, S.StringType()), S.StructField("_nil", S.StringType())])
        return S.StringType()

    def _particle_texts(self, p: Particle, fields: dict[str, S.DataType]) -> None:
        if isinstance(p.term, Group):
            for x in p.term.particles:
                self._particle_texts(x, fields)
        else:
            fields[p.term.local] = S.ArrayType(self._texts(p.term))

    # -- the value
    def texts(self, xml: Column) -> Column:
        """The parsed message, all leaves as texts."""
        texts = self._texts(self.root)
        own = texts.fields if isinstance(texts, S.StructType) else [S.StructField(_VALUE, S.StringType())]
        return F.from_xml(xml, S.StructType([*own, S.StructField("_broken", S.StringType())]), _READ)

    def column(self, xml: Column) -> Column:
        """Struct (data, errors) in one expression. The parse is bound to a lambda, so it happens once; ``result`` on a parsed column is faster."""
        return F.transform(F.array(F.struct(xml.alias("xml"), self.texts(xml).alias("texts"))), lambda r: self.result(r["xml"], r["texts"]))[0]

    def result(self, xml: Column, r: Column) -> Column:
        """Struct (data, errors) from the message and its parsed form."""
        e = self.root
        flat = not isinstance(self._texts(e), S.StructType)
        local = F.regexp_extract(xml, _ROOT, 1)
        there = xml.isNotNull()
        broken = F.coalesce(there & (r.isNull() | r["_broken"].isNotNull()), F.lit(False))
        sought = self._doubtful(xml)
        strange = self._space_of(self._bindings(xml), F.regexp_extract(self._tags(xml), _TAG, 1)) != e.ns
        other = F.coalesce(there & ~broken & ((local != e.local) | sought & strange), F.lit(False))
        value, errors = self._value(e, r[_VALUE] if flat else r, e.path)
        wrong = [
            _error(broken, "xml", e.path, "not well-formed"),
            _error(other, "root", e.path, F.concat(F.lit("data not recognized, found a `"), local, F.lit("'"))),
            *self._foreign(xml, there & ~broken & ~other & sought),
            *_only(there & ~broken & ~other, errors),
            *self._order(xml, there & ~broken & ~other),
        ]
        every = joined(wrong)
        return F.struct(F.when(there & (F.size(every) == 0), value).alias("data"), every.alias("errors"))

    def _doubtful(self, xml: Column) -> Column:
        """Whether prefixes have to be looked up: false where the root declares the only namespace and the tags' prefixes are plain to see."""
        e = self.root
        inside = set().union(*spaces(e.type).values()) if isinstance(e.type, Complex) else set()
        times = lambda what: (F.length(xml) - F.length(F.replace(xml, what, F.lit("")))) / F.length(what)
        if not e.ns:
            return F.coalesce(xml.contains("xmlns"), F.lit(False)) | F.lit(bool(inside - {""}))
        p = F.substring_index(F.substring(xml, 2, 256), ":", 1)
        mine = times(F.concat(F.lit("<"), p, F.lit(":"))) + times(F.concat(F.lit("</"), p, F.lit(":")))
        xsi = xml.contains(f' xmlns:xsi="{T.XSI}"') & ~xml.contains("<xsi:") & (p != "xsi")  # for attributes only
        declared = times(F.lit("xmlns")) - F.when(xsi, 1).otherwise(0)
        sure = xml.startswith(F.concat(F.lit("<"), p, F.lit(f":{e.local}"))) & xml.contains(F.concat(F.lit(" xmlns:"), p, F.lit(f'="{e.ns}"'))) & (declared == 1)
        if inside <= {""}:
            sure = sure & (mine <= 2)
        elif inside == {e.ns}:
            sure = sure & (mine == times(F.lit("<")))
        else:
            return F.lit(True)
        return ~F.coalesce(sure, F.lit(False))

    @staticmethod
    def _tags(xml: Column) -> Column:
        return F.regexp_replace(xml, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "")

    def _bindings(self, xml: Column) -> Column:
        """Distinct (prefix, namespace) of all declarations; the default's prefix is empty."""
        found = F.regexp_extract_all(self._tags(xml), F.lit(_DECLARED), F.lit(0))
        part = lambda x, i: F.regexp_extract(x, _DECLARED, i)
        return F.array_distinct(F.transform(found, lambda x: F.struct(part(x, 1).alias("key"), F.concat(part(x, 2), part(x, 3)).alias("value"))))

    def _space_of(self, bindings: Column, name: Column) -> Column:
        """The namespace of a tag's name; a name of its own for a prefix that nothing declares."""
        prefix = F.when(name.contains(":"), F.substring_index(name, ":", 1)).otherwise("")
        own = F.filter(bindings, lambda b: b["key"] == prefix)
        return F.coalesce(F.get(own, F.lit(0))["value"], F.when(prefix == "", "").otherwise("undeclared"))

    def _foreign(self, xml: Column, sought: Column, bindings: Column | None = None, tags: Column | None = None, strangers: Column | None = None) -> list[Error]:
        """Elements in other namespaces. The parser goes by local names, so declarations and names are looked up in the text itself.

        That tells where each prefix stands for one namespace, and the default is declared at the root, if at all: other messages are refused.
        """
        e = self.root
        bindings = self._bindings(xml) if bindings is None else bindings
        tags = self._tags(xml) if tags is None else tags
        twice = F.size(F.array_distinct(F.transform(bindings, lambda b: b["key"]))) < F.size(bindings)
        late = F.exists(bindings, lambda b: b["key"] == "") & ~F.regexp_extract(tags, r"^\s*<[^>]*>", 0).rlike(r"\sxmlns\s*=")
        unsure = _error(sought & (twice | late), "namespace", e.path, f"namespaces are declared again inside of {e.path}: read it in document order")
        found = self._strangers(tags, bindings) if strangers is None else strangers
        if found is None:
            return [unsure]
        message = F.concat(F.lit("element `"), F.substring_index(F.get(found, F.lit(0)), ":", -1), F.lit(f"' not processed for {e.path}"))
        return [unsure, _error(sought & ~(twice | late) & (F.size(found) > 0), "leftover", e.path, message)]

    def _strangers(self, tags: Column, bindings: Column) -> Column | None:
        """Distinct names of tags that stand in another namespace than the schema's element of that name."""
        e = self.root
        if not isinstance(e.type, Complex) or not (wanted := spaces(e.type)):
            return None
        known = F.create_map(*(x for local, own in wanted.items() for x in (F.lit(local), F.array(*map(F.lit, sorted(own))))))
        names = F.array_distinct(F.regexp_extract_all(tags, F.lit(_TAG), F.lit(1)))
        own = F.transform(names, lambda n: F.struct(n.alias("name"), F.try_element_at(known, F.substring_index(n, ":", -1)).alias("known"), self._space_of(bindings, n).alias("space")))
        return F.transform(F.filter(own, lambda x: x["known"].isNotNull() & ~F.array_contains(x["known"], x["space"])), lambda x: x["name"])

    def staged(self, df: DataFrame, xml: Column, out: str) -> DataFrame:
        """Column ``out`` as ``column`` gives it, by projections: what several conditions ask for is computed once and compiled. Null messages cost next to nothing."""
        e = self.root
        texts, head, sought, tags, bindings, odd, order, value, every = fresh(df, *(f"_s_{x}" for x in ("texts", "head", "sought", "tags", "bindings", "odd", "order", "value", "every")))
        c = F.col
        there, flat = xml.isNotNull(), not isinstance(self._texts(e), S.StructType)
        local = F.regexp_extract(xml, _ROOT, 1)
        broken = F.coalesce(there & (c(texts).isNull() | c(texts)["_broken"].isNotNull()), F.lit(False))
        df = df.withColumn(texts, self.texts(xml)).withColumn(sought, F.when(there, self._doubtful(xml)))
        df = df.withColumn(tags, F.when(c(sought), self._tags(xml)))
        df = df.withColumn(bindings, F.when(c(sought), self._bindings(c(tags))))
        strange = self._space_of(c(bindings), F.regexp_extract(c(tags), _TAG, 1)) != e.ns
        df = df.withColumn(head, F.when(broken, "broken").when(F.coalesce(there & ((local != e.local) | c(sought) & strange), F.lit(False)), "other").when(there, "sound"))
        ok = F.coalesce(c(head) == "sound", F.lit(False))
        looked = self._strangers(c(tags), c(bindings))
        df = df.withColumn(odd, F.when(ok & c(sought), looked if looked is not None else F.array().cast("array<string>")))
        foreign = self._foreign(xml, F.coalesce(ok & c(sought), F.lit(False)), c(bindings), c(tags), None if looked is None else c(odd))
        data, errors = self._value(e, c(texts)[_VALUE] if flat else c(texts), e.path)
        ordered = self._order(xml, ok)
        if ordered:
            df = df.withColumn(order, ordered[0].bad)
            ordered = [Error(c(order), ordered[0].report)]
        found = joined(_only(ok, errors))
        wrong = [
            _error(c(head) == "broken", "xml", e.path, "not well-formed"),
            _error(c(head) == "other", "root", e.path, F.concat(F.lit("data not recognized, found a `"), local, F.lit("'"))),
            *foreign,
            Error(None, F.when(ok, found).otherwise(_none())),
            *ordered,
        ]
        df = df.withColumn(every, F.when(there, joined(wrong)).otherwise(_none())).withColumn(value, F.when(ok, data))
        return df.withColumn(out, F.struct(F.when(there & (F.size(c(every)) == 0), c(value)).alias("data"), c(every).alias("errors"))).drop(texts, head, sought, tags, bindings, odd, order, value, every)

    def _order(self, xml: Column, sound: Column) -> list[Error]:
        """Elements before others that have to come first: arrays by name have lost that, so XPath looks at the message itself."""
        e = self.root
        if not self.options.order_check or not isinstance(e.type, Complex) or not (found := out_of_order(e.type)):
            return []
        look = F.xpath_boolean(xml, F.lit(" or ".join(f"boolean({x})" for x in found)))  # one tree for all
        if tags := _tags_in_order(e.type.content):
            look = F.when(~xml.contains("<!") & xml.rlike(rf"^(?:<\?[^<>]*>)?\s*+<[^<>?/]+>{tags}[^<]*+</[^<>]*>\s*$"), False).otherwise(look)
        bad = F.when(sound, look)
        return [_error(bad, "order", e.path, f"elements of {e.path} aren't in the order of its sequence")]

    def _packed(self, e: Element, c: Column, path: str) -> Column:
        """Struct (value, errors) of one of several elements. What it repeats itself is bound first, so no level is computed twice."""
        inner = list(repeated(e.type.content)) if isinstance(e.type, Complex) and e.type.content is not None else []

        def build(bound: dict[int, Column]) -> Column:
            value, errors = self._value(e, c, path, bound)
            return F.struct(self._item(e, c, value).alias("value"), joined(errors).alias("errors"))

        if not inner:
            return build({})
        each = F.struct(*(self._pairs(x, c, path).alias(f"p{i}") for i, x in enumerate(inner)))
        return F.transform(F.array(each), lambda s: build({id(x): s[f"p{i}"] for i, x in enumerate(inner)}))[0]

    def _pairs(self, e: Element, c: Column, path: str) -> Column:
        """(value, errors) of each of the elements ``e`` in ``c``."""
        return F.transform(c[e.local], lambda x: self._packed(e, x, f"{path}/{e.local}"))

    def _value(self, e: Element, c: Column, path: str, bound: dict[int, Column] | None = None) -> Value:
        """Value of an element that is there; ``c`` is its text, or its struct of texts, ``bound`` has the pairs of what it repeats."""
        t = e.type
        if isinstance(t, Simple):
            text = F.coalesce(c[_VALUE] if e.nillable else c, F.lit(""))  # an element that is there and empty comes as null
            nil = F.coalesce(c["_nil"].isin("true", "1"), F.lit(False)) if e.nillable else None
            return self._simple(e, t, text, nil, path)
        nil = F.coalesce(c["_nil"].isin("true", "1"), F.lit(False)) if e.nillable else None
        fields: dict[str, Column] = {}
        errors: list[Error] = []
        if t.simple is not None:
            value, wrong = simple(t.simple, F.coalesce(c[_VALUE], F.lit("")), path, self.options)
            fields["_"] = value
            errors += wrong
        elif t.content is not None:
            errors += self._particle(t.content, c, path, fields, bound or {})
        if t.simple is None:
            message = F.lit(f"element not processed for {path}")
            errors.append(_error(F.size(F.coalesce(c[_ANY], F.array().cast("array<string>"))) > 0, "leftover", path, message))
        for a in t.attributes:
            errors += self._attribute(a, c["_" + a.local], path, fields)
        value = F.struct(*(v.alias(k) for k, v in fields.items())) if fields else F.struct()
        if nil is not None:
            errors = _only(~nil, errors)
            value = F.when(~nil, value)
        return value, errors

    def _simple(self, e: Element, t: Simple, text: Column, nil: Column | None, path: str, known: Column | None = None) -> Value:
        value, errors = simple(t, text, path, self.options, known)
        if e.default is not None:
            given = self._literal(t, e.default) if self.defaults == "EXTEND" else F.lit(None)
            value = F.when(text == "", given).otherwise(value)
            errors = _only(text != "", errors)
            if self.defaults == "MINIMAL":
                value = F.when(value != self._literal(t, e.default), value)
        if e.fixed is not None:
            message = F.concat(F.lit(f"element `{e.local}' must have fixed value `{e.fixed}', got `"), text, F.lit(f"' at {path}"))
            errors.append(_error(value != self._literal(t, e.fixed), "fixed", path, message))
        if nil is not None:
            errors = _only(~nil, errors)
            value = F.when(nil, F.lit("NIL")).otherwise(value.cast("string")) if self.options.nil_mode == "string" else F.when(~nil, value)
        return value, errors

    def _literal(self, t: Simple, text: str) -> Column:
        return F.lit(read_simple(t, text, "", self.options)).cast(self.shape.type(t))

    def _attribute(self, a: Attribute, text: Column, path: str, fields: dict[str, Column], known: Column | None = None) -> list[Error]:
        where = f"{path}/@{a.local}"
        if a.use == "prohibited":
            return [_error(text.isNotNull(), "attribute", where, f"attribute `{a.local}' is prohibited at {where}")]
        value, errors = simple(a.type, text, where, self.options, known)
        if a.use == "required":
            errors.append(_error(text.isNull(), "attribute", where, f"attribute `{a.local}' is required at {where}"))
        if a.fixed is not None:
            message = F.concat(F.lit(f"value of attribute `{a.local}' is fixed to `{a.fixed}', not `"), text, F.lit(f"' at {where}"))
            errors.append(_error(value != self._literal(a.type, a.fixed), "fixed", where, message))
            value = F.coalesce(value, self._literal(a.type, a.fixed))
        elif a.default is not None:
            if self.defaults == "EXTEND":
                value = F.coalesce(value, self._literal(a.type, a.default))
            elif self.defaults == "MINIMAL":
                value = F.when(value != self._literal(a.type, a.default), value)
        fields[a.key] = value
        return errors

    def _particle(self, p: Particle, c: Column, path: str, fields: dict[str, Column], bound: dict[int, Column], optional: bool = False) -> list[Error]:
        if isinstance(p.term, Group):
            g, errors = p.term, []
            loose = optional or p.min == 0 or g.kind == "choice"
            for x in g.particles:
                errors += self._particle(x, c, path, fields, bound, loose)
            if g.kind == "choice":
                chosen = F.size(F.filter(F.array(*(F.coalesce(F.size(c[x.term.local]) > 0, F.lit(False)) for x in g.particles)), lambda b: b))
                errors.append(_error(chosen > 1, "leftover", path, f"element not processed for {path}"))
                if p.min and not optional and not any(x.min == 0 for x in g.particles):
                    errors.append(_error(chosen == 0, "choice", path, f"no element left to pick choice at {path}"))
            return errors
        e, own = p.term, c[p.term.local]
        where, count = f"{path}/{e.local}", F.coalesce(F.size(c[p.term.local]), F.lit(0))
        count = F.when(own.isNull(), 0).otherwise(count)
        least = 0 if optional or not self.options.check_occurs else p.min
        errors: list[Error] = []
        if p.max == 0:
            return [_error(count > 0, "leftover", where, f"element `{e.local}' not processed for {path}")]
        given = e.default if self.defaults == "EXTEND" else None
        given = e.fixed if e.fixed is not None else given
        if least and given is None and not (e.default is not None and isinstance(e.type, Simple)):
            errors.append(_error(count < least, "missing", path, f"data for element or block starting with `{e.local}' missing at {path}"))
        if p.max is not None and self.options.check_occurs:
            errors.append(_error(count > p.max, "leftover", where, f"element `{e.local}' not processed for {path}"))
        if p.many:
            pairs = bound.get(id(e))
            if pairs is None:
                pairs = self._pairs(e, c, path)
            fields[e.key] = F.when(count > 0, F.transform(pairs, lambda q: q["value"]))
            errors.append(Error(None, F.coalesce(F.flatten(F.transform(pairs, lambda q: q["errors"])), _none())))
            return errors
        first = F.get(own, F.lit(0))
        value, wrong = self._value(e, first, where)
        errors += _only(count > 0, wrong)
        value = F.when(count > 0, value)
        if least and given is not None and isinstance(e.type, Simple):
            value = F.when(count > 0, value).otherwise(self._literal(e.type, given))
        fields[e.key] = value
        if e.nillable and self.options.nil_mode == "flag":
            fields[f"{e.key}__nil"] = F.when(count > 0, F.coalesce(first["_nil"].isin("true", "1"), F.lit(False)))
        return errors

    def _item(self, e: Element, c: Column, value: Column) -> Column:
        if e.nillable and self.options.nil_mode == "flag":
            return F.struct(value.alias("_"), F.coalesce(c["_nil"].isin("true", "1"), F.lit(False)).alias("nil"))
        return value
