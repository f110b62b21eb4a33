"""Writing one record at a time, for what needs names of the data, Python code or ready XML."""

from __future__ import annotations

import re

from xmlframe.functions import types as T
from xmlframe.functions.names import pack_type, unpack_type
from xmlframe.operators.reader_python import NIL, hook_meets
from xmlframe.operators.values import DataError, read_simple, write_simple
from xmlframe.plans.model import Attribute, Complex, Element, Group, Options, Particle, Simple, Wildcard
from xmlframe.plans.shape import ANY, ANY_ATTRIBUTE
from xmlframe.sources.xml import Node, cdata, escape, escape_attr, parse, serialize


class Prefixes:
    """Prefixes of namespaces: the wanted one, else an own one of x0, x1 and so on; remembers which are used."""

    def __init__(self, options: Options, default_ns: str | None = None) -> None:
        self.known = {ns: p for p, ns in options.prefixes.items()}
        self.known.setdefault(T.XSI, "xsi")
        if options.use_default_namespace and default_ns and default_ns not in self.known:
            self.known[default_ns] = ""
        self.used: dict[str, str] = {}

    def of(self, ns: str, attribute: bool = False) -> str:
        if ns not in self.known or attribute and self.known[ns] == "":
            taken = set(self.known.values())
            self.known[ns] = next(p for i in range(len(taken) + 1) if (p := f"x{i}") not in taken)
        self.used[ns] = self.known[ns]
        return self.known[ns]

    def tag(self, ns: str, local: str, attribute: bool = False) -> str:
        p = self.of(ns, attribute) if ns else ""
        return f"{p}:{local}" if p else local


class Unused(DataError):
    pass


class Writer:
    """``write(data)`` gives the text of one message; violations raise ``DataError``."""

    def __init__(self, root: Element | Attribute, options: Options, extends=None) -> None:
        self.element, self.options, self.extends = root, options, extends or {}
        self.defaults = options.default_values or "IGNORE"
        self.hooks = [h for h in options.hooks if h.action in (None, "WRITER")]

    def write(self, data) -> str:
        e = self.element
        self.prefixes = Prefixes(self.options, e.ns)
        if isinstance(e, Attribute):
            return self._attribute(e, {e.key: data}, e.local, set())
        if e.members:
            m = next((m for m in e.members if isinstance(data, dict) and m.key in data and len(data) == 1), None)
            if m is None:
                raise DataError("abstract", e.path, f"abstract element `{e.local}' used at {e.path}")
            e, data = m, data[m.key]
        text = self._one(e, data, e.path)
        asked = self.options.include_namespaces
        spaces = [] if asked is False else [(ns, p) for ns, p in self.prefixes.used.items() if asked is True or asked(ns, p)]
        declared = "".join(f' xmlns{":" + p if p else ""}="{escape_attr(ns)}"' for ns, p in sorted(spaces, key=lambda x: x[1]))
        end = re.match(r"<[^\s/>]+", text).end()
        return text[:end] + declared + text[end:]

    # -- elements
    def _one(self, e: Element, value, path: str) -> str:
        """An element with a value that is there."""
        if isinstance(value, Node):
            return serialize(value)
        if e.blocked:
            raise DataError("blocked", path, f"use of ref {pack_type(e.ns, e.local)} blocked at {path}", misfit=True)
        if e.abstract and self.options.abstract_types == "ERROR":
            raise DataError("abstract", path, f"attempt to instantiate abstract element `{e.local}' at {path}")
        hooks = [h for h in self.hooks if hook_meets(h, e, path, self.extends)]
        codec = self.options.typemap.get(e.type.name)
        if codec is not None:
            value = codec.to_xml(value, path) if hasattr(codec, "to_xml") else codec("WRITER", value, path)
        for h in hooks:
            for f in h.before:
                if f == "PRINT_PATH":
                    print(path)
                elif (value := f(value, path, e.type.name)) is None:
                    return ""
        replaced = next((h.replace for h in hooks if h.replace is not None), None)
        if replaced == "SKIP":
            return ""
        text = replaced(value, path, e, lambda: self._plain(e, value, path)) if replaced else self._plain(e, value, path)
        for h in hooks:
            for f in h.after:
                if f == "PRINT_PATH":
                    print(path)
                else:
                    text = f(text, path, value, e.type.name)
        return text or ""

    def _plain(self, e: Element, value, path: str) -> str:
        kind, extra = e.type, ""
        if e.xsi and isinstance(value, dict) and value.get("XSI_TYPE"):
            name = value["XSI_TYPE"]
            if name not in e.xsi:
                raise DataError("xsi", path, f"specified xsi:type list for `{e.type.name}' does not contain `{name}'")
            kind, value = e.xsi[name], {k: v for k, v in value.items() if k != "XSI_TYPE"}
            extra = self._type_attribute(name)
        elif self.options.xsi_type_everywhere and not kind.name.startswith("unnamed") and kind.name:
            extra = self._type_attribute(kind.name)
        tag = self.prefixes.tag(e.ns, e.local)
        nil = value is NIL or isinstance(value, dict) and value.get("_") is NIL or value == "NIL" or isinstance(value, dict) and value.get("_") == "NIL"
        if nil and e.nillable:
            attrs = self._attributes(kind, value, path, {"_"}) if isinstance(value, dict) and isinstance(kind, Complex) else ""
            return f'<{tag}{extra}{attrs} {self.prefixes.tag(T.XSI, "nil", True)}="true"/>'
        if isinstance(kind, Simple):
            if isinstance(value, dict):
                if set(value) - {"_"}:
                    raise DataError("value", path, f"simple value expected at {path}")
                value = value.get("_")
            text = write_simple(kind, value, path, self.options, self.prefixes.of)
            if e.fixed is not None and read_simple(kind, text, path, self.options) != read_simple(kind, e.fixed, path, self.options):
                raise DataError("fixed", path, f"element `{e.local}' has value fixed to `{e.fixed}', got `{text}' at {path}")
            return _element(tag, extra, cdata(text) if path in self.options.cdata else escape(text))
        return self._complex(kind, tag, extra, value, path)

    def _type_attribute(self, name: str) -> str:
        ns, local = unpack_type(name)
        return f' {self.prefixes.tag(T.XSI, "type", True)}="{self.prefixes.tag(ns, local)}"'

    def _complex(self, t: Complex, tag: str, extra: str, value, path: str) -> str:
        if t.any_type:
            return _element(tag, extra, str(value) if str(value).startswith("<") else escape(str(value)))
        if t.mixed and not isinstance(value, dict):
            value = {"_": value}
        if t.simple is not None:
            data = value if isinstance(value, dict) else {"_": value}
            inner, used = escape(write_simple(t.simple, data.get("_"), path, self.options, self.prefixes.of)), {"_"}
        elif t.mixed:
            data, used = value, {"_"}
            body = data.get("_")
            body = serialize(body) if isinstance(body, Node) else str(body or "")
            inner = body
            if body.startswith("<") and parse(body).local == tag.rpartition(":")[2]:
                inner = re.sub(r"^<[^>]*?(/?)>", "", body, count=1).removesuffix(f"</{tag}>") if "</" in body else ""
        else:
            if not isinstance(value, dict):
                raise DataError("value", path, f"complex `{tag}' requires a record of input data, not `{type(value).__name__}' at {path}")
            data, used, parts = value, set(), []
            if t.content is not None:
                self._particle(t.content, data, parts, path, used)
            inner = "".join(parts)
        attrs = self._attributes(t, data, path, used)
        if t.any_attribute is not None and data.get(ANY_ATTRIBUTE):
            used.add(ANY_ATTRIBUTE)
            declared = {(a.ns, a.local) for a in t.attributes}
            for name, x in sorted(dict(data[ANY_ATTRIBUTE]).items()):
                ns, local = unpack_type(name)
                if t.any_attribute.admits(ns) and (ns, local) not in declared:  # a wildcard also yields declared ones when read
                    attrs += f' {self.prefixes.tag(ns, local, True)}="{escape_attr(str(x))}"'
        rest = sorted(k for k, v in data.items() if k not in used and v is not None and not (k.endswith("__nil") and not v))
        asked = self.options.ignore_unused_tags
        rest = [k for k in rest if not (asked is True or isinstance(asked, str) and re.search(asked, k))]
        if rest:
            raise Unused("unused", path, _unused(rest, path))
        return _element(tag, extra + attrs, inner)

    # -- particles
    def _particle(self, p: Particle, data: dict, parts: list[str], path: str, used: set[str]) -> bool:
        """Write what the data has for one particle; whether that was anything."""
        if p.max == 0:
            return False
        if isinstance(p.term, Element):
            return self._elements(p, p.term, data, parts, path, used)
        if isinstance(p.term, Wildcard):
            return self._any(p, p.term, data, parts, used)
        if not p.many:
            before, mark, seen = list(parts), len(parts), set(used)
            try:
                return self._group(p.term, data, parts, path, used)
            except DataError as e:
                if p.min == 0 and e.misfit and parts == before:
                    del parts[mark:]
                    used.intersection_update(seen)
                    return False
                raise
        rows = data.get(p.label)
        used.add(p.label)
        rows = [rows] if isinstance(rows, dict) else list(rows or ())
        if not rows and p.min and p.max is None:
            raise DataError("missing", path, f"no match for required block `{p.label}' at {path}", misfit=True)
        if p.max == p.min and len(rows) < p.min:
            raise DataError("missing", path, f"too few blocks for `{p.label}' specified, got {len(rows)} need {p.min} at {path}", misfit=True)
        if len(rows) < p.min or p.max is not None and len(rows) > p.max:
            raise DataError("occurs", path, f"found {len(rows)} blocks for `{p.label}', must be between {p.min} and {'unbounded' if p.max is None else p.max} inclusive at {path}", misfit=True)
        for row in rows:
            own: set[str] = set()
            self._group(p.term, row, parts, path, own)
            if rest := sorted(k for k, v in row.items() if k not in own and v is not None and not k.endswith("__nil")):
                raise Unused("unused", path, _unused(rest, path))
        return bool(rows)

    def _group(self, g: Group, data: dict, parts: list[str], path: str, used: set[str]) -> bool:
        if g.kind != "choice":
            found = False
            for p in g.particles:
                found = self._particle(p, data, parts, path, used) or found
            return found
        for p in g.particles:
            if isinstance(p.term, Element) and self._has(p.term, data):
                return self._particle(p, data, parts, path, used)
        for p in g.particles:
            if isinstance(p.term, Element):
                continue
            mark, seen = len(parts), set(used)
            try:
                if self._particle(p, data, parts, path, used):
                    return True
            except DataError as e:
                if not e.misfit:
                    raise
            del parts[mark:]
            used.intersection_update(seen)
        if any(p.min == 0 or isinstance(p.term, Group) and p.term.kind == "choice" for p in g.particles):
            return False
        raise DataError("choice", path, f"no match for required block in choice at {path}", misfit=True)

    @staticmethod
    def _has(e: Element, data: dict) -> bool:
        keys = [m.key for m in e.members] if e.members and e.key not in data else [e.key]
        return any(data.get(k) is not None or data.get(f"{k}__nil") for k in keys)

    def _elements(self, p: Particle, e: Element, data: dict, parts: list[str], path: str, used: set[str]) -> bool:
        if e.members and not p.many:
            for m in e.members:
                used.add(m.key)
                if data.get(m.key) is not None:
                    parts.append(self._one(m, data[m.key], f"{path}/{m.local}"))
                    return True
            if p.min:
                raise DataError("missing", path, f"required value for element `{e.local}' missing at {path}", misfit=True)
            return False
        used |= {e.key, f"{e.key}__nil"}
        where = f"{path}/{e.local}"
        value = NIL if data.get(f"{e.key}__nil") else data.get(e.key)
        if p.many:
            items = list(value) if isinstance(value, (list, tuple)) else [] if value is None else [value]
            if p.max is not None and len(items) > p.max:
                raise DataError("occurs", where, f"too many elements for `{e.key}', max {p.max} found {len(items)} at {path}")
        else:
            if isinstance(value, (list, tuple)) and not (isinstance(e.type, Simple) and e.type.variety != "atomic"):
                raise DataError("occurs", where, f"only one value for `{e.key}' allowed, got {len(value)} at {path}")
            items = [] if value is None else [value]
        for x in items:
            if e.members:
                m = next((m for m in e.members if isinstance(x, dict) and x.get(m.key) is not None), None)
                if m is None:
                    raise DataError("substitution", where, f"no data for substitution group {e.local} at {path}")
                parts.append(self._one(m, x[m.key], f"{path}/{m.local}"))
                continue
            if isinstance(x, dict) and set(x) == {"_", "nil"}:
                x = NIL if x["nil"] else x["_"]
            if self.defaults == "MINIMAL" and e.default is not None and isinstance(e.type, Simple) and not isinstance(x, dict) and write_simple(e.type, x, where, self.options) == e.default:
                continue
            parts.append(self._one(e, x, where))
        n = len(items)
        if n < p.min and e.default is not None and self.defaults == "EXTEND":
            parts += [self._one(e, e.default, where)] * (p.min - n)
        elif n < p.min and e.default is None and e.fixed is None:
            raise DataError("missing", where, f"required value for element `{e.local}' missing at {path}", misfit=n == 0)
        return n > 0

    def _any(self, p: Particle, w: Wildcard, data: dict, parts: list[str], used: set[str]) -> bool:
        found = dict(data.get(ANY) or {})
        used.add(ANY)
        n = 0
        for name in sorted(found):
            if w.admits(unpack_type(name)[0]):
                for x in found[name] if isinstance(found[name], (list, tuple)) else [found[name]]:
                    parts.append(serialize(x) if isinstance(x, Node) else str(x))
                    n += 1
        if n < p.min:
            raise DataError("any", "", f"too few any elements, requires {p.min} and got {n}", misfit=n == 0)
        if p.max is not None and n > p.max:
            raise DataError("any", "", f"too many any elements, max {p.max} and got {n}")
        return n > 0

    # -- attributes
    def _attributes(self, t: Complex, data: dict, path: str, used: set[str]) -> str:
        return "".join(self._attribute(a, data, path, used) for a in t.attributes)

    def _attribute(self, a: Attribute, data: dict, path: str, used: set[str]) -> str:
        used.add(a.key)
        value, where = data.get(a.key), f"{path}/@{a.local}"
        if a.use == "prohibited":
            if value is not None:
                raise DataError("attribute", where, f"attribute `{a.local}' is prohibited at {where}")
            return ""
        if value is None and a.default is not None and self.defaults == "EXTEND":
            value = a.default
        if value is None:
            if a.use == "required":
                raise DataError("attribute", where, f"attribute `{a.local}' is required at {where}")
            return ""
        text = write_simple(a.type, value, where, self.options, self.prefixes.of)
        if a.default is not None and self.defaults == "MINIMAL" and text == a.default:
            return ""
        if a.fixed is not None and text != a.fixed:
            raise DataError("fixed", where, f"value of attribute `{a.local}' is fixed to `{a.fixed}', not `{text}' at {where}")
        return f' {self.prefixes.tag(a.ns, a.local, True)}="{escape_attr(text)}"'


def _unused(rest: list[str], path: str) -> str:
    return f"unused tags {' '.join(rest)} at {path}" if len(rest) > 1 else f"tag `{rest[0]}' not used at {path}"


def _element(tag: str, attrs: str, inner: str) -> str:
    return f"<{tag}{attrs}>{inner}</{tag}>" if inner else f"<{tag}{attrs}/>"


