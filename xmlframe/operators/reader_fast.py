"""Reading plain messages without a parser: the skeleton of tags is matched, then texts are cut out by name.

A message is plain where it holds just the tags that its schema wants, in this order, this often and in the right
namespaces, with attributes in double quotes and in the order of the schema, and neither comments, CDATA, processing instructions,
carriage returns nor references other than the five of the language. Taking the texts out of a message leaves its skeleton, and
one regular expression, made from the schema, tells whether that is plain: then a tag's name alone says where its text is.
Any other message goes to the parser, with the same results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from xmlframe.operators.reader_native import ERROR, Error, NativeReader, Value, _error, _none, joined, repeated, simple
from xmlframe.plans.model import Attribute, Complex, Element, Group, Options, Particle, Simple

_PREFIX = r"([A-Za-z_][\w.\-]*)"
#: Characters that no plain message holds, one by one (ranges are far slower to match), and references of other names than the five.
_ODD = "[" + "".join(f"\\x{c:02X}" for c in range(32) if c not in (9, 10)) + "]"
_REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos);)"


def _odd(whole: Column) -> Column:
    return whole.rlike(_ODD) | whole.contains("]]>") | whole.contains("\ufffe") | whole.contains("\uffff") | (whole.contains("&") & whole.rlike(_REFERENCE))


class NotPlain(ValueError):
    """No message of this schema is read this way."""


def _elements(p: Particle) -> Iterator[Element]:
    if p.max == 0:
        return
    if isinstance(p.term, Group):
        for x in p.term.particles:
            yield from _elements(x)
    elif isinstance(p.term, Element):
        yield p.term
        if isinstance(p.term.type, Complex) and p.term.type.content is not None:
            yield from _elements(p.term.type.content)


def _escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text) if text.isascii() else re.escape(text)


def decoded(text: Column) -> Column:
    """A text with the five references of the language resolved."""
    out = text
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return F.when(text.contains("&"), out).otherwise(text)


class FastReader(NativeReader):
    """``whole(xml)``, ``plain(whole, skeleton)`` and ``values(whole)`` are columns to be made one after the other."""

    def __init__(self, root: Element, options: Options) -> None:
        super().__init__(root, options)
        t = root.type
        inner = list(_elements(t.content)) if isinstance(t, Complex) and t.content is not None else []
        names = [root.local, *(e.local for e in inner)]
        if len(set(names)) < len(names):
            raise NotPlain("a name stands for several elements")
        self.inside = {e.ns for e in inner}
        if not self.inside <= {root.ns} | ({""} if root.ns else set()) or any(a.ns for e in (root, *inner) if isinstance(e.type, Complex) for a in e.type.attributes):
            raise NotPlain("further namespaces")
        #: What has a column already: texts and values of what is there at most once, by element or attribute.
        self.texts_of: dict[int, Column] = {}
        self.values_of: dict[int, Column] = {}
        self.counted: list[tuple[str, int]] = []  # elements of all blocks: which, and how often at least

    # -- what is plain
    def _attributes(self, e: Element) -> str:
        if not isinstance(e.type, Complex):
            return ""
        return "".join(rf'(?: {_escaped(a.local)}="[^"<&\t\n]*+")?+' for a in e.type.attributes)

    def _tag(self, e: Element, prefix: str) -> str:
        name = (prefix if e.ns else "") + _escaped(e.local)
        inner = ""
        if isinstance(e.type, Complex) and e.type.content is not None:
            inner = self._block(e.type.content, prefix)
        return f"<{name}{self._attributes(e)}>{inner}</{name}>"

    def _tallied(self, p: Particle) -> bool:
        """Whether a plain message may hold too few or too many of an element, which are counted then."""
        return p.many and isinstance(p.term, Element) and self.options.check_occurs and self.options.order_check != "python" and (p.min, p.max) != (0, None) and p.term.fixed is None and p.term.default is None

    def _block(self, p: Particle, prefix: str) -> str:
        if p.max == 0:
            return ""
        if isinstance(p.term, Element):
            own = self._tag(p.term, prefix)
        elif p.term.kind == "sequence":
            own = "".join(self._block(x, prefix) for x in p.term.particles)
        elif p.term.kind == "choice":
            own = "|".join(f"(?:{self._block(x, prefix)})" for x in p.term.particles)
        else:
            if p.min == 0 or any(x.many or x.max == 0 or not isinstance(x.term, Element) or isinstance(x.term.type, Complex) for x in p.term.particles):
                raise NotPlain("an all block of more than simple elements")
            self.counted += [((prefix if x.term.ns else "") + x.term.local, x.min) for x in p.term.particles]
            return f"(?:{'|'.join(self._tag(x.term, prefix) for x in p.term.particles)})*+"
        if (p.min, p.max) == (1, 1):
            return f"(?:{own})"
        if self._tallied(p):
            return f"(?:{own})*+"
        return f"(?:{own}){{{p.min},{'' if p.max is None else p.max}}}+"

    def whole(self, xml: Column) -> Column:
        """The message without a declaration before it, blanks around it and tags that close themselves."""
        bare = F.when(xml.startswith("<") & ~xml.startswith("<?") & xml.endswith(">"), xml)
        bare = F.coalesce(bare, F.regexp_replace(F.regexp_replace(xml, r"^\s*(?:<\?xml [^>]*\?>\s*)?", ""), r"\s+$", ""))
        return F.when(bare.contains("/>"), F.regexp_replace(bare, r"<([^<>\s/]+)((?:\s[^<>]*[^<>\s/])?)\s*/>", "<$1$2></$1>")).otherwise(bare)

    def skeleton(self, whole: Column) -> Column:
        return F.regexp_replace(whole, r">[^<]+<", "><")

    def plain(self, whole: Column, skeleton: Column) -> Column:
        """Whether the message is plain; never null."""
        e = self.root
        if self._fixed(e):
            return F.coalesce(self._same(whole, skeleton) & ~_odd(whole), F.lit(False))
        forms = []
        t = e.type
        block = lambda prefix: self._block(t.content, prefix) if isinstance(t, Complex) and t.content is not None else ""
        name = _escaped(e.local)
        if e.ns:
            ns = _escaped(e.ns)
            forms.append(rf'<{_PREFIX}:{name} xmlns:\1="{ns}"{self._attributes(e)}>{block(chr(92) + "1:")}</\1:{name}>')
            if self.inside <= {e.ns}:
                forms.append(f'<{name} xmlns="{ns}"{self._attributes(e)}>{block("")}</{name}>')
        else:
            forms.append(f"<{name}{self._attributes(e)}>{block('')}</{name}>")
        ok = skeleton.rlike("^(?:" + "|".join(forms) + ")$") & ~_odd(whole)
        for counted, least in dict(self.counted).items():
            tag = F.lit(f"<{counted}>")
            if "\\" in counted:
                tag = F.concat(F.lit("<"), self._prefix(whole), F.lit(counted[3:] + ">"))
            n = F.length(skeleton) - F.length(F.replace(skeleton, tag, F.lit("")))
            ok = ok & (n <= F.length(tag)) & (n >= least)
        return F.coalesce(ok, F.lit(False))

    def _fixed(self, e: Element) -> bool:
        """Whether a plain message has always the same tags: all once, without attributes."""

        def once(p: Particle) -> bool:
            if (p.min, p.max) != (1, 1) or isinstance(p.term, Group) and p.term.kind != "sequence":
                return False
            return self._fixed(p.term) if isinstance(p.term, Element) else all(once(x) for x in p.term.particles)

        t = e.type
        return not self._attributes(e) and (isinstance(t, Simple) or t.simple is not None or t.content is None or once(t.content))

    def _same(self, whole: Column, skeleton: Column) -> Column:
        """Whether the skeleton is the only one, with whatever prefix."""
        e = self.root
        plain = lambda x: x.replace("\\", "")  # noqa: E731  names as they are, not as patterns
        block = lambda prefix: re.sub(r"\(\?:|\)", "", plain(self._block(e.type.content, prefix))) if isinstance(e.type, Complex) and e.type.content is not None else ""
        if not e.ns:
            return skeleton == F.lit(f"<{e.local}>{block('')}</{e.local}>")
        p = F.substring_index(F.substring(whole, 2, 256), ":", 1)
        parts = f'<\0:{e.local} xmlns:\0="{e.ns}">{block(chr(0) + ":")}</\0:{e.local}>'.split("\0")
        prefixed = F.concat(*(c for i, x in enumerate(parts) for c in ([p] if i else []) + [F.lit(x)]))
        ok = (skeleton == prefixed) & p.rlike(f"^{_PREFIX}$")
        if self.inside <= {e.ns}:
            ok = ok | (skeleton == F.lit(f'<{e.local} xmlns="{e.ns}">{block("")}</{e.local}>'))
        return ok

    def _prefix(self, whole: Column) -> Column:
        return F.concat(F.regexp_extract(whole, f"^<{_PREFIX}:", 1), F.lit(":"))

    def bare(self, whole: Column) -> Column:
        """A plain message whose inner tags have no prefix."""
        if not self.root.ns or not self.inside & {self.root.ns}:
            return whole
        p = F.regexp_extract(whole, f"^<{_PREFIX}:", 1)
        cut = F.replace(F.replace(whole, F.concat(F.lit("<"), p, F.lit(":")), F.lit("<")), F.concat(F.lit("</"), p, F.lit(":")), F.lit("</"))
        return F.when(p != "", cut).otherwise(whole)

    # -- values; a scope is the text in which an element's tags stand
    def _inner(self, e: Element, scope: Column) -> Column:
        """The text of an element that is there once, with what it holds."""
        if self._attributes(e) or e is self.root:
            return F.regexp_extract(scope, rf"<(?:[^\s<>:]+:)?{_escaped(e.local)}(?:\s[^<>]*)?>([^<]*)</", 1)
        return F.substring_index(F.substring_index(scope, f"</{e.local}>", 1), f"<{e.local}>", -1)

    def _there(self, e: Element, scope: Column) -> Column:
        return scope.contains(f"</{e.local}>")

    def _attribute_text(self, e: Element, a: Attribute, scope: Column) -> Column:
        head = F.regexp_extract(scope, rf"<(?:[^\s<>:]+:)?{_escaped(e.local)}(\s[^<>]*)?>", 1)
        return F.when(head.contains(f' {a.local}="'), F.regexp_extract(head, rf'\s{_escaped(a.local)}="([^"]*)"', 1))

    def _text_of(self, e: Element, scope: Column) -> Column:
        return self.texts_of[id(e)] if id(e) in self.texts_of else decoded(self._inner(e, scope))

    def _cut_value(self, e: Element, scope: Column, path: str, bound: dict[int, Column]) -> Value:
        t = e.type
        if isinstance(t, Simple):
            return self._simple(e, t, self._text_of(e, scope), None, path, self.values_of.get(id(e)))
        fields: dict[str, Column] = {}
        errors: list[Error] = []
        if t.simple is not None:
            value, wrong = simple(t.simple, self._text_of(e, scope), path, self.options, self.values_of.get(id(e)))
            fields["_"] = value
            errors += wrong
        elif t.content is not None:
            errors += self._cut_block(t.content, scope, path, fields, bound, False)
        for a in t.attributes:
            text = self.texts_of[id(a)] if id(a) in self.texts_of else decoded(self._attribute_text(e, a, scope))
            errors += self._attribute(a, text, path, fields, self.values_of.get(id(a)))
        return F.struct(*(v.alias(k) for k, v in fields.items())) if fields else F.struct(), errors

    def leaves(self, whole: Column) -> list[tuple[int, Simple, Column, str]]:
        """(element or attribute, its type, its text as it stands, path) of what a message holds at most once."""
        out: list[tuple[int, Simple, Column, str]] = []

        def visit(e: Element, path: str, optional: bool) -> None:
            t = e.type
            kind = t if isinstance(t, Simple) else t.simple
            if kind is not None:
                inner = self._inner(e, whole)
                out.append((id(e), kind, F.when(self._there(e, whole), inner) if optional else inner, path))
            if isinstance(t, Complex):
                out.extend((id(a), a.type, self._attribute_text(e, a, whole), f"{path}/@{a.local}") for a in t.attributes if a.use != "prohibited")
                if t.content is not None:
                    block(t.content, path, optional)

        def block(p: Particle, path: str, optional: bool) -> None:
            optional = optional or p.min == 0
            if p.max == 0 or isinstance(p.term, Element) and p.many:
                return
            if isinstance(p.term, Element):
                visit(p.term, f"{path}/{p.term.local}", optional)
            for x in p.term.particles if isinstance(p.term, Group) else ():
                block(x, path, optional or p.term.kind == "choice")

        visit(self.root, self.root.path, False)
        return out

    def _cut_pairs(self, e: Element, scope: Column, path: str) -> Column:
        name = _escaped(e.local)
        if isinstance(e.type, Simple):
            items = F.regexp_extract_all(scope, F.lit(f"<{name}>([^<]*)</{name}>"), F.lit(1))
            return F.transform(items, lambda x: self._cut_simple(e, x, path))
        items = F.regexp_extract_all(scope, F.lit(rf"(<{name}(?:\s[^<>]*)?>(?s:.*?)</{name}>)"), F.lit(1))
        return F.transform(items, lambda x: self._cut_packed(e, x, path))

    def _pair(self, e: Element, value: Column, errors: list[Error]) -> Column:
        if e.nillable and self.options.nil_mode == "flag":
            value = F.struct(value.alias("_"), F.lit(False).alias("nil"))
        return F.struct(value.alias("value"), joined(errors).alias("errors"))

    def _cut_simple(self, e: Element, text: Column, path: str) -> Column:
        return self._pair(e, *self._simple(e, e.type, decoded(text), None, path))

    def _cut_packed(self, e: Element, scope: Column, path: str) -> Column:
        inner = list(repeated(e.type.content)) if e.type.content is not None else []
        if not inner:
            return self._pair(e, *self._cut_value(e, scope, path, {}))
        each = F.struct(*(self._cut_pairs(x, scope, f"{path}/{x.local}").alias(f"p{i}") for i, x in enumerate(inner)))
        return F.transform(F.array(each), lambda s: self._pair(e, *self._cut_value(e, scope, path, {id(x): s[f"p{i}"] for i, x in enumerate(inner)})))[0]

    def _cut_block(self, p: Particle, scope: Column, path: str, fields: dict[str, Column], bound: dict[int, Column], optional: bool) -> list[Error]:
        errors: list[Error] = []
        if isinstance(p.term, Group):
            loose = optional or p.min == 0 or p.term.kind == "choice"
            for x in p.term.particles:
                errors += self._cut_block(x, scope, path, fields, bound, loose)
            return errors
        e = p.term
        if p.max == 0:
            return []
        where = f"{path}/{e.local}"
        if p.many:
            pairs = bound.get(id(e))
            if pairs is None:
                pairs = self._cut_pairs(e, scope, where)
            fields[e.key] = F.when(F.size(pairs) > 0, F.transform(pairs, lambda q: q["value"]))
            if self._tallied(p):
                if not optional and p.min:
                    errors.append(_error(F.size(pairs) < p.min, "missing", path, f"data for element or block starting with `{e.local}' missing at {path}"))
                if p.max is not None:
                    errors.append(_error(F.size(pairs) > p.max, "leftover", where, f"element `{e.local}' not processed for {path}"))
            return [*errors, Error(None, F.coalesce(F.flatten(F.transform(pairs, lambda q: q["errors"])), _none()))]
        value, wrong = self._cut_value(e, scope, where, bound)
        if optional or p.min == 0:
            there = self._there(e, scope)
            wrong = [Error(there & x.bad, x.report) if x.bad is not None else Error(None, F.when(there, x.report).otherwise(_none())) for x in wrong]
            value = F.when(there, value)
        fields[e.key] = value
        if e.nillable and self.options.nil_mode == "flag":
            shown = F.lit(False)
            fields[f"{e.key}__nil"] = F.when(self._there(e, scope), shown) if optional or p.min == 0 else shown
        elif e.nillable and self.options.nil_mode == "string" and isinstance(e.type, Simple):
            fields[e.key] = fields[e.key].cast("string")
        return errors + wrong

    def repeats(self, whole: Column) -> dict[int, Column]:
        """The pairs of what the message repeats outside of what is repeated, by element."""
        t = self.root.type
        out: dict[int, Column] = {}

        def visit(p: Particle, path: str) -> None:
            if p.max == 0:
                return
            if isinstance(p.term, Group):
                for x in p.term.particles:
                    visit(x, path)
            elif p.many:
                out[id(p.term)] = self._cut_pairs(p.term, whole, f"{path}/{p.term.local}")
            elif isinstance(p.term.type, Complex) and p.term.type.content is not None:
                visit(p.term.type.content, f"{path}/{p.term.local}")

        if isinstance(t, Complex) and t.content is not None:
            visit(t.content, self.root.path)
        return out

    def values(self, whole: Column, bound: dict[int, Column]) -> tuple[Column, Column]:
        """(data, errors) of a plain message."""
        value, errors = self._cut_value(self.root, whole, self.root.path, bound)
        return value, joined(errors).cast(f"array<{ERROR.simpleString()}>")
