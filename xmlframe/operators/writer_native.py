"""Writing with Catalyst: one string expression for a whole message, in schema order, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from xmlframe.functions import facets as FA
from xmlframe.functions import types as T
from xmlframe.operators.reader_native import joined, simple
from xmlframe.operators.writer_python import Prefixes
from xmlframe.plans.model import Complex, Element, Group, Options, Particle, Simple, Wildcard
from xmlframe.sources.xml import escape_attr


class NotNative(ValueError):
    """The element needs the Python writer."""


def escaped(text: Column, attribute: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


class NativeWriter:
    """``column(data)`` gives the text of a message; a violation raises its message.

    Facets, occurrence and the form of texts (dates, names) are checked. Numbers and booleans come from typed columns, so their form is not.
    """

    def __init__(self, root: Element, options: Options) -> None:
        self.root, self.options = root, options
        self.defaults = options.default_values or "IGNORE"
        self.prefixes = Prefixes(options, root.ns)
        if root.members or options.hooks or options.typemap or callable(options.include_namespaces):
            raise NotNative("hooks, codecs and substitution at the root need the Python writer")

    def column(self, data: Column) -> Column:
        body = self._one(self.root, data, self.root.path, root=True)
        return F.when(data.isNotNull(), body)

    def _declared(self) -> str:
        if not self.options.include_namespaces:
            return ""
        spaces = sorted((p, ns) for ns, p in self.prefixes.used.items())
        return "".join(f' xmlns{":" + p if p else ""}="{escape_attr(ns)}"' for p, ns in spaces)

    def _tagged(self, tag: str, attrs: list[Column], inner: Column, root: bool) -> Column:
        head = F.concat(F.lit(f"<{tag}{self._declared() if root else ''}"), *attrs)
        return F.when(inner == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), inner, F.lit(f"</{tag}>")))

    def _one(self, e: Element, value: Column, path: str, root: bool = False) -> Column:
        t = e.type
        if e.members or e.xsi or e.blocked or e.abstract or isinstance(t, Complex) and (t.any_type or t.mixed or t.any_attribute):
            raise NotNative(f"{path} needs the Python writer")
        tag = self.prefixes.tag(e.ns, e.local)
        kind = [F.lit(self._type_of(t))] if self.options.xsi_type_everywhere and t.name and not t.name.startswith("unnamed") else []
        if isinstance(t, Simple):
            text = self._text(t, value, path)
            if path in self.options.cdata:
                return self._tagged(tag, kind, F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")), root)
            return self._tagged(tag, kind, escaped(text), root)
        if t.simple is not None:
            attrs = [self._attribute(a, value, path) for a in t.attributes if a.use != "prohibited"]
            return self._tagged(tag, kind + attrs, escaped(self._text(t.simple, value["_"], path)), root)
        parts = self._particle(t.content, value, path) if t.content is not None else []
        attrs = [self._attribute(a, value, path) for a in t.attributes if a.use != "prohibited"]
        return self._tagged(tag, kind + attrs, F.concat(*parts) if parts else F.lit(""), root)

    def _type_of(self, t: Simple | Complex) -> str:
        ns, _, local = t.name[1:].partition("}") if t.name.startswith("{") else ("", "", t.name)
        return f' {self.prefixes.tag(T.XSI, "type", True)}="{self.prefixes.tag(ns, local)}"'

    def _text(self, t: Simple, value: Column, path: str) -> Column:
        if t.variety == "list":
            text = F.array_join(F.transform(value, lambda x: self._text(t.item, x, path)), " ")
        elif t.variety == "union":
            text = value.cast("string")
        elif t.builtin.kind == "qname" or t.blocked:
            raise NotNative("qualified names need the Python writer")
        else:
            text = T.text_col(t.builtin, value)
        for f in t.steps:
            text = FA.space_col(f, text)
        formed = t.variety == "atomic" and t.builtin.check and t.builtin.kind in ("text", "date", "time", "duration")
        if not (t.steps or t.variety == "union" or formed and self.options.check_values):
            return text
        wrong = joined(simple(t, text, path, self.options)[1])
        return F.when(F.size(wrong) > 0, F.raise_error(F.get(wrong, F.lit(0))["message"]).cast("string")).otherwise(text)

    def _attribute(self, a, data: Column, path: str) -> Column:
        value, where = data[a.key], f"{path}/@{a.local}"
        if a.default is not None and self.defaults == "EXTEND":
            value = F.coalesce(self._text(a.type, value, where), F.lit(a.default))
        else:
            value = self._text(a.type, value, where)
        if a.default is not None and self.defaults == "MINIMAL":
            value = F.when(value != a.default, value)
        tag = self.prefixes.tag(a.ns, a.local, True)
        if a.fixed is not None:
            message = F.concat(F.lit(f"value of attribute `{a.local}' is fixed to `{a.fixed}', not `"), value, F.lit(f"' at {where}"))
            value = F.when(value != a.fixed, F.raise_error(message).cast("string")).otherwise(value)
        text = F.when(value.isNotNull(), F.concat(F.lit(f' {tag}="'), escaped(value, True), F.lit('"')))
        if a.use == "required":
            missing = F.raise_error(f"attribute `{a.local}' is required at {where}").cast("string")
            return F.when(value.isNull(), missing).otherwise(text)
        return F.coalesce(text, F.lit(""))

    def _particle(self, p: Particle, data: Column, path: str) -> list[Column]:
        if p.max == 0:
            return []
        if isinstance(p.term, Wildcard):
            raise NotNative("wildcards need the Python writer")
        if isinstance(p.term, Group):
            if not p.many:
                parts = [x for q in p.term.particles for x in self._particle(q if p.term.kind != "choice" else Particle(q.term, 0, q.max, q.label), data, path)]
                return parts
            rows = data[p.label]
            each = lambda r: F.concat(*(x for q in p.term.particles for x in self._particle(q if p.term.kind != "choice" else Particle(q.term, 0, q.max, q.label), r, path)))
            return [self._counted(p, rows, F.coalesce(F.array_join(F.transform(rows, each), ""), F.lit("")), "blocks", p.label, path)]
        e = p.term
        where = f"{path}/{e.local}"
        value = data[e.key]
        if p.many:
            if e.nillable and self.options.nil_mode == "flag":
                text = F.transform(value, lambda x: F.when(x["nil"], self._nil(e)).otherwise(self._one(e, x["_"], where)))
            else:
                text = F.transform(value, lambda x: self._one(e, x, where))
            return [self._counted(p, value, F.coalesce(F.array_join(text, ""), F.lit("")), "elements", e.key, path)]
        text = self._one(e, value, where)
        if isinstance(e.type, Simple) and e.fixed is not None:
            own = self._text(e.type, value, where)
            message = F.concat(F.lit(f"element `{e.local}' has value fixed to `{e.fixed}', got `"), own, F.lit(f"' at {where}"))
            text = F.when(own != e.fixed, F.raise_error(message).cast("string")).otherwise(text)
        if isinstance(e.type, Simple) and e.default is not None:
            if self.defaults == "EXTEND" and p.min:
                text = F.when(value.isNull(), self._one(e, F.lit(e.default), where)).otherwise(text)
            elif self.defaults == "MINIMAL":
                text = F.when(self._text(e.type, value, where) != e.default, text)
        shown = F.when(value.isNotNull() | F.lit(bool(e.default is not None and self.defaults == "EXTEND" and p.min)), text)
        if e.nillable and self.options.nil_mode == "flag":
            shown = F.when(F.coalesce(data[f"{e.key}__nil"], F.lit(False)), self._nil(e)).otherwise(shown)
        if p.min and e.default is None and e.fixed is None and not e.nillable:
            missing = F.raise_error(f"required value for element `{e.local}' missing at {path}").cast("string")
            return [F.when(value.isNull(), missing).otherwise(shown)]
        return [F.coalesce(shown, F.lit(""))]

    def _counted(self, p: Particle, rows: Column, text: Column, what: str, key: str, path: str) -> Column:
        """``text``, unless there are too few or too many."""
        n = F.when(rows.isNull(), 0).otherwise(F.size(rows))
        if p.max is not None:
            said = f"too many elements for `{key}', max {p.max} found " if what == "elements" else f"found more than {p.max} blocks for `{key}': "
            text = F.when(n > p.max, F.raise_error(F.concat(F.lit(said), n.cast("string"), F.lit(f" at {path}"))).cast("string")).otherwise(text)
        if p.min:
            said = f"required value for element `{key}' missing at {path}" if what == "elements" else f"no match for required block `{key}' at {path}"
            text = F.when(n < p.min, F.raise_error(said).cast("string")).otherwise(text)
        return text

    def _nil(self, e: Element) -> Column:
        return F.lit(f'<{self.prefixes.tag(e.ns, e.local)} {self.prefixes.tag(T.XSI, "nil", True)}="true"/>')
