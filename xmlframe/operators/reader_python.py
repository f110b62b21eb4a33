"""Reading in document order: one message at a time, for what needs order, names or Python code."""

from __future__ import annotations

import json
import re

from xmlframe.functions import types as T
from xmlframe.functions.names import pack_type
from xmlframe.operators.values import DataError, read_simple
from xmlframe.plans.model import Attribute, Complex, Element, Group, Hook, Options, Particle, Simple, Wildcard
from xmlframe.plans.shape import ANY, ANY_ATTRIBUTE
from xmlframe.sources.xml import Node, load, serialize

NIL = "NIL"
_ABSENT = object()


class Cursor:
    """Walks the child elements of one node."""

    def __init__(self, node: Node, path: str) -> None:
        self.node, self.path, self.items, self.at = node, path, node.elements, 0

    @property
    def current(self) -> Node | None:
        return self.items[self.at] if self.at < len(self.items) else None

    first = property(lambda self: self.items[0] if self.items else None)
    last = property(lambda self: self.items[-1] if self.items else None)

    def descend(self, path: str | None = None) -> Cursor:
        return Cursor(self.current, path or f"{self.path}/{self.current.local}")

    def next(self) -> Node | None:
        self.at = min(self.at + 1, len(self.items))
        return self.current

    def previous(self) -> Node | None:
        self.at = max(self.at - 1, 0)
        return self.current

    def __len__(self) -> int:
        return len(self.items)


def is_nil(node: Node) -> bool:
    return node.get("nil", T.XSI) in ("true", "1")


class Reader:
    """``read(source)`` gives the data of one message; violations raise ``DataError``."""

    def __init__(self, root: Element | Attribute, options: Options, extends=None) -> None:
        self.element, self.options = root, options
        self.defaults = options.default_values or "EXTEND"
        self.hooks = [h for h in options.hooks if h.action in (None, "READER")]
        self.extends = extends or {}  # type name: names of its bases, for hooks that select by base
        self._depth: list[Complex] = []

    def read(self, source):
        node = load(source)
        e = self.element
        if isinstance(e, Attribute):
            return self._attribute(e, node, e.local)
        if not self._is(e, node) and not any(self._is(m, node) for m in e.members):
            raise DataError("root", f"/{node.local}", f"data not recognized, found a `{node.name}' at {node.path}")
        if e.members:
            m = next((m for m in e.members if self._is(m, node)), None)
            if m is None:
                raise DataError("abstract", e.path, f"abstract element `{e.local}' used at {e.path}")
            e = m
        return self._element(e, node, e.path)

    # -- elements
    @staticmethod
    def _is(e: Element, node: Node) -> bool:
        return node.local == e.local and node.ns == e.ns

    def _meets(self, e: Element, node: Node) -> Element | None:
        if e.members:
            return next((m for m in e.members if self._is(m, node)), e if self._is(e, node) else None)
        return e if self._is(e, node) else None

    def _element(self, e: Element, node: Node, path: str):
        if e.abstract and self.options.abstract_types == "ERROR":
            raise DataError("abstract", path, f"abstract element `{e.local}' used at {path}")
        if e.blocked:
            raise DataError("blocked", path, f"use of ref {pack_type(e.ns, e.local)} blocked at {path}", misfit=True)
        if self.options.permit_href and node.get("href") is not None:
            return serialize(node)
        hooks = [h for h in self.hooks if hook_meets(h, e, path, self.extends)]
        for h in hooks:
            for f in h.before:
                if f == "PRINT_PATH":
                    print(path)
                else:
                    node = f(node, path, e.type.name)
                    if node is None:
                        return _ABSENT
        replaced = next((h.replace for h in hooks if h.replace is not None), None)
        if replaced == "SKIP":
            return "SKIPPED"
        if replaced == "XML_NODE":
            value = serialize(node)
        elif replaced is not None:
            value = replaced(node, path, e, lambda n=node: self._value(e, n, path))
        else:
            value = self._value(e, node, path)
        for h in hooks:
            for f in h.after:
                value = self._after(f, node, value, path, e)
        codec = self.options.typemap.get(e.type.name)
        if codec is not None and value is not _ABSENT:
            value = codec.from_xml(value, path) if hasattr(codec, "from_xml") else codec("READER", value, path)
        return value

    def _after(self, f, node: Node, value, path: str, e: Element):
        if f == "PRINT_PATH":
            print(path)
            return value
        if callable(f):
            return f(node, value, path, e.type.name)
        data = value if isinstance(value, dict) else {"_": value}
        got = {
            "INCLUDE_PATH": lambda: {"_PATH": path},
            "XML_NODE": lambda: {"_XML_NODE": serialize(node)},
            "ELEMENT_ORDER": lambda: {"_ELEMENT_ORDER": [c.local for c in node.elements]},
            "ATTRIBUTE_ORDER": lambda: {"_ATTRIBUTE_ORDER": [local for _, local in node.attrs]},
            "NODE_TYPE": lambda: {"_NODE_TYPE": node.name},
        }
        if f not in got:
            raise DataError("hook", path, f"labeled after hook `{f}' undefined for READER")
        return data | got[f]()

    def _value(self, e: Element, node: Node, path: str):
        kind = e.type
        extra = {}
        if e.xsi:
            asked = node.get("type", T.XSI)
            name = node.qname(asked) if asked else next(iter(e.xsi))
            if name not in e.xsi:
                raise DataError("xsi", path, f"specified xsi:type list for `{e.type.name}' does not contain `{name}'")
            kind, extra = e.xsi[name], {"XSI_TYPE": name}
        if isinstance(kind, Complex) and kind.abstract and not extra and self.options.abstract_types == "ERROR" and e.xsi:
            raise DataError("abstract", path, f"abstract type `{kind.name}' used at {path}")
        if e.nillable and is_nil(node):
            return NIL if isinstance(kind, Simple) else {"_": NIL, **self._attributes(kind, node, path)}
        if isinstance(kind, Simple):
            value = self._simple(e, kind, node, path)
            return {"_": value, **extra} if extra else value
        value = self._complex(kind, node, path)
        return {**extra, **value} if extra else value

    def _simple(self, e: Element, kind: Simple, node: Node, path: str):
        text = node.text
        if text == "" and e.default is not None and self.defaults != "IGNORE":
            return None if self.defaults == "MINIMAL" else read_simple(kind, e.default, path, self.options, node)
        if text == "" and e.default is not None:
            return None if kind.builtin and kind.builtin.kind != "text" else ""
        if node.elements:
            raise DataError("leftover", path, f"element `{node.elements[0].local}' not processed for {path} at {node.elements[0].path}", misfit=True)
        value = read_simple(kind, text, path, self.options, node)
        if e.fixed is not None and value != read_simple(kind, e.fixed, path, self.options, node):
            raise DataError("fixed", path, f"element `{e.local}' must have fixed value `{e.fixed}', got `{text}' at {path}")
        if e.default is not None and self.defaults == "MINIMAL" and value == read_simple(kind, e.default, path, self.options, node):
            return None
        return value

    def _missing(self, e: Element, path: str):
        """The value of a required element that isn't there, if the schema gives one."""
        if isinstance(e.type, Simple):
            if e.fixed is not None:
                return read_simple(e.type, e.fixed, path, self.options)
            if e.default is not None and self.defaults == "EXTEND":
                return read_simple(e.type, e.default, path, self.options)
            if e.default is not None:
                return None
        return _ABSENT

    # -- complex content
    def _complex(self, t: Complex, node: Node, path: str):
        if t.any_type:
            if self.options.any_type is not None:
                return self.options.any_type(path, node)
            return serialize(node) if node.elements else node.text
        if any(t is x for x in self._depth):
            self._depth.append(t)
            try:
                return json.dumps(self._content(t, node, path), default=str)
            finally:
                self._depth.pop()
        self._depth.append(t)
        try:
            return self._content(t, node, path)
        finally:
            self._depth.pop()

    def _content(self, t: Complex, node: Node, path: str):
        if t.mixed:
            mode = self.options.mixed_elements
            if callable(mode):
                return mode(path, node)
            if mode in ("XML_STRING", "XML_NODE"):
                return serialize(node)
            inner = node.text if mode == "TEXTUAL" else serialize(node)
            return {"_": inner, **self._attributes(t, node, path)}
        if t.simple is not None:
            return {"_": read_simple(t.simple, node.text, path, self.options, node), **self._attributes(t, node, path)}
        out: dict = {}
        cursor = Cursor(node, path)
        if t.content is not None:
            self._particle(t.content, cursor, out)
        if (rest := cursor.current) is not None:
            raise DataError("leftover", path, f"element `{rest.local}' not processed for {path} at {rest.path}", misfit=True)
        return out | self._attributes(t, node, path)

    def _particle(self, p: Particle, cursor: Cursor, out: dict) -> bool:
        """Match one particle at the cursor and add its data; whether anything was found."""
        if p.max == 0:
            return False
        if isinstance(p.term, Element):
            return self._elements(p, p.term, cursor, out)
        if isinstance(p.term, Wildcard):
            return self._any(p, p.term, cursor, out)
        if not p.many:
            if p.min:
                return self._group(p.term, cursor, out)
            return self._trial(p.term, cursor, out)
        rows: list[dict] = []
        while p.max is None or len(rows) < p.max:
            own: dict = {}
            if len(rows) < p.min:
                before = cursor.at
                self._group(p.term, cursor, own)
                if cursor.at == before and not own:
                    break
            elif cursor.current is None or not self._trial(p.term, cursor, own):
                break
            rows.append(own)
        if rows:
            out[p.label] = rows
        return bool(rows)

    def _trial(self, g: Group, cursor: Cursor, out: dict) -> bool:
        """An occurrence that may be left out: a misfit is forgiven if it consumed nothing."""
        if cursor.current is None:
            return False
        before, own = cursor.at, {}
        try:
            self._group(g, cursor, own)
        except DataError as e:
            if e.misfit and cursor.at == before:
                return False
            raise
        if cursor.at == before:
            return False
        out.update(own)
        return True

    def _group(self, g: Group, cursor: Cursor, out: dict) -> bool:
        if g.kind == "sequence":
            found = False
            for p in g.particles:
                found = self._particle(p, cursor, out) or found
            return found
        return self._choice(g, cursor, out) if g.kind == "choice" else self._all(g, cursor, out)

    def _choice(self, g: Group, cursor: Cursor, out: dict) -> bool:
        now = cursor.current
        if now is not None:
            for p in g.particles:
                if isinstance(p.term, Element) and p.max != 0 and self._meets(p.term, now):
                    return self._particle(p, cursor, out)
            for p in g.particles:
                if isinstance(p.term, (Group, Wildcard)):
                    before, own = cursor.at, {}
                    try:
                        found = self._particle(p, cursor, own)
                    except DataError as e:
                        if not e.misfit:
                            raise
                        cursor.at = before
                        continue
                    if found:
                        out.update(own)
                        return True
        if any(self._emptiable(p) for p in g.particles):
            return False
        only = g.particles[0].term if len(g.particles) == 1 and isinstance(g.particles[0].term, Element) else None
        if now is None:
            text = f"element `{only.local}' expected for choice at {cursor.path}" if only else f"no element left to pick choice at {cursor.path}"
        else:
            text = f"single choice option `{only.local}' at `{now.local}' at {cursor.path}" if only else f"no applicable choice for `{now.local}' at {cursor.path}"
        raise DataError("choice", cursor.path, text, misfit=True)

    def _emptiable(self, p: Particle) -> bool:
        if p.min == 0:
            return True
        if isinstance(p.term, Group):
            each = [self._emptiable(x) for x in p.term.particles]
            return any(each) if p.term.kind == "choice" and each else all(each)
        return isinstance(p.term, Element) and self._missing(p.term, "") is not _ABSENT

    def _all(self, g: Group, cursor: Cursor, out: dict) -> bool:
        left, found = list(g.particles), False
        while (now := cursor.current) is not None:
            hit = next((p for p in left if isinstance(p.term, Element) and self._meets(p.term, now)), None)
            if hit is not None:
                self._particle(hit, cursor, out)
            else:
                for p in left:
                    if isinstance(p.term, (Group, Wildcard)):
                        before, own = cursor.at, {}
                        try:
                            ok = self._particle(p, cursor, own)
                        except DataError as e:
                            if not e.misfit:
                                raise
                            cursor.at, ok = before, False
                        if ok:
                            out.update(own)
                            hit = p
                            break
                if hit is None:
                    break
            left.remove(hit)
            found = True
        nowhere = Cursor(Node("", ""), cursor.path)
        for p in left:
            self._particle(p, nowhere, out)
        return found

    def _elements(self, p: Particle, e: Element, cursor: Cursor, out: dict) -> bool:
        items = []
        path = cursor.path
        while (now := cursor.current) is not None and (p.max is None or len(items) < p.max):
            own = self._meets(e, now)
            if own is None:
                break
            value = self._element(own, now, f"{path}/{own.local}")
            cursor.next()
            if value is _ABSENT:
                continue
            items.append({own.key: value} if e.members and p.many else self._nilled(own, value, p.many))
            if not p.many:
                self._put(out, own, value)
                return True
        if len(items) < p.min:
            value = self._missing(e, f"{path}/{e.local}")
            if value is _ABSENT:
                raise DataError("missing", path, f"data for element or block starting with `{e.local}' missing at {path}", misfit=True)
            if not p.many:
                if value is not None:
                    out[e.key] = value
                return False
            items += [value] * (p.min - len(items))
        if items:
            out[e.key] = items
        return bool(items)

    def _nilled(self, e: Element, value, many: bool):
        nil = value is NIL or isinstance(value, dict) and value.get("_") is NIL
        if not many or not e.nillable or self.options.nil_mode == "string":
            return value
        if self.options.nil_mode == "null":
            return None if nil else value
        return {"_": None if nil else value, "nil": nil}

    def _put(self, out: dict, e: Element, value) -> None:
        nil = value is NIL or isinstance(value, dict) and value.get("_") is NIL
        if e.nillable and self.options.nil_mode == "flag":
            out[f"{e.key}__nil"] = nil
        if nil and self.options.nil_mode != "string":
            value = None if not isinstance(value, dict) or self.options.nil_mode == "null" else {k: v for k, v in value.items() if k != "_"} or None
        out[e.key] = value

    def _any(self, p: Particle, w: Wildcard, cursor: Cursor, out: dict) -> bool:
        n, how = 0, self.options.any_element
        while (now := cursor.current) is not None and (p.max is None or n < p.max) and w.admits(now.ns):
            if how == "TAKE_ALL":
                out.setdefault(ANY, {}).setdefault(now.name, []).append(serialize(now))
            elif callable(how):
                got = how(now.name, now, cursor.path)
                if got is not None:
                    out.setdefault(ANY, {}).setdefault(got[0], []).append(got[1])
            elif how != "SKIP_ALL":
                raise DataError("any", cursor.path, f"any_element handler `{how}' not understood")
            cursor.next()
            n += 1
        if n < p.min:
            raise DataError("any", cursor.path, f"too few any elements, requires {p.min} and got {n}", misfit=n == 0)
        return n > 0

    # -- attributes
    def _attributes(self, t: Complex, node: Node, path: str) -> dict:
        out = {}
        for a in t.attributes:
            if (value := self._attribute(a, node, path)) is not _ABSENT:
                out[a.key] = value
        how = self.options.any_attribute
        if t.any_attribute and how != "SKIP_ALL":
            found = {}
            for (ns, local), text in node.attrs.items():
                if ns != T.XSI and t.any_attribute.admits(ns):
                    got = (pack_type(ns, local), text) if how == "TAKE_ALL" else how(pack_type(ns, local), text, path)
                    if got is not None:
                        found[got[0]] = got[1]
            if found:
                out[ANY_ATTRIBUTE] = found
        return out

    def _attribute(self, a: Attribute, node: Node, path: str):
        text, where = node.attrs.get((a.ns, a.local)), f"{path}/@{a.local}"
        if text is None:
            if a.use == "required":
                raise DataError("attribute", where, f"attribute `{a.local}' is required at {where}")
            given = a.fixed if a.fixed is not None else a.default if self.defaults == "EXTEND" else None
            return _ABSENT if given is None or a.use == "prohibited" else read_simple(a.type, given, where, self.options, node)
        if a.use == "prohibited":
            raise DataError("attribute", where, f"attribute `{a.local}' is prohibited at {where}")
        value = read_simple(a.type, text, where, self.options, node)
        if a.fixed is not None and value != read_simple(a.type, a.fixed, where, self.options, node):
            raise DataError("fixed", where, f"value of attribute `{a.local}' is fixed to `{a.fixed}', not `{text}' at {where}")
        if a.default is not None and self.defaults == "MINIMAL" and value == read_simple(a.type, a.default, where, self.options, node):
            return _ABSENT
        return value


def hook_meets(h: Hook, e: Element, path: str, extends: dict[str, list[str]]) -> bool:
    """Whether any selector of a hook meets an element; a hook without selectors meets all."""

    def any_of(wanted, *values: str) -> bool:
        each = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        return any(w.search(v) if isinstance(w, re.Pattern) else w == v for w in each for v in values if v)

    name = e.type.name
    tests = [
        (h.path, lambda: any_of(h.path, path, path.rpartition("}")[2])),
        (h.type, lambda: any_of(h.type, name, name.rpartition("}")[2])),
        (h.id, lambda: any_of(h.id, e.id or "")),
        (h.extends, lambda: h.extends in (name, *extends.get(name, ()))),
    ]
    used = [t for wanted, t in tests if wanted is not None]
    return not used or any(t() for t in used)
