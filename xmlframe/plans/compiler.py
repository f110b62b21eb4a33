"""From schema definitions to the compiled form of one element or type."""

from __future__ import annotations

import re
from dataclasses import replace

from xmlframe.functions import types as T
from xmlframe.functions.facets import BOUNDS, IGNORED, LENGTHS, Facets
from xmlframe.functions.names import pack_type, unpack_type
from xmlframe.plans.catalog import Catalog, Definition, Fragment, SchemaError
from xmlframe.plans.model import Attribute, Complex, Element, Group, Options, Particle, Simple, Wildcard
from xmlframe.sources.xml import Node

LABELS = {"sequence": "seq_", "choice": "cho_", "all": "all_", "group": "gr_"}
#: Parts of a definition that say nothing about the shape of data.
_SILENT = frozenset("annotation notation key keyref unique selector field assert report openContent".split())


def _true(text: str | None) -> bool:
    return text in ("true", "1")


class Compiler:
    def __init__(self, catalog: Catalog, options: Options) -> None:
        self.catalog, self.options = catalog, options
        self._complex: dict[str, Complex] = {}
        self._elements: dict[str, Element] = {}
        self._prefix = {uri: p for p, uri in options.prefixes.items()}

    # -- entry points
    def element(self, name: str) -> Element:
        """The compiled global element of a packed name or ``ns#id``; a built-in type is wrapped in an element of its own."""
        d = self.catalog.find_id(name) if "#" in name and not name.startswith("{") else None
        d = d or self.catalog.find("element", name)
        if d is not None:
            return self._global_element(d, top=True)
        ns, local = unpack_type(name)
        if ns in T.XSD_NAMESPACES and local in T.BUILTINS:
            return Element(local, "", local, self._named_type(name), path=name)
        raise SchemaError(f"cannot find element or attribute `{name}'")

    def attribute(self, name: str) -> Attribute:
        d = self.catalog.find("attribute", name)
        if d is None:
            raise SchemaError(f"cannot find element or attribute `{name}'")
        return self._attribute(d.node, d.fragment, top=True)

    def typed_element(self, element: str, type_name: str) -> Element:
        """An element made up around a named type."""
        ns, local = unpack_type(element)
        return Element(local, ns, local, self._named_type(type_name), path=element)

    # -- names
    def key(self, ns: str, local: str) -> str:
        """The data key of a name, after the rewrite rules in their order; prefixing comes first."""
        out = local
        rules = self.options.key_rewrite
        prefixing = [r for r in rules if isinstance(r, str) and r.startswith("PREFIXED")]
        if prefixing:
            only = {x.strip() for r in prefixing if "(" in r for x in r[9:-1].split(",")}
            p = self._prefix.get(ns)
            if p and (not only or p in only):
                out = f"{p}_{out}"
        for r in rules:
            if isinstance(r, dict):
                out = r.get(pack_type(ns, local), r.get(out, out))
            elif callable(r):
                out = r(ns, out)
            elif r == "UNDERSCORES":
                out = out.replace("-", "_")
            elif r == "SIMPLIFIED":
                out = re.sub(r"\W", "", out.replace("-", "_")).lower()
            elif not r.startswith("PREFIXED"):
                raise SchemaError(f"key rewrite `{r}' not understood")
        return out

    def _qualified(self, fragment: Fragment, form: str | None, what: str, top: bool) -> bool:
        asked = getattr(self.options, f"{what}_qualified")
        if asked in (True, "ALL"):
            return True
        if asked in (False, "NONE"):
            return False
        if asked == "TOP":
            return top
        return form == "qualified" if form else getattr(fragment, f"{what}_qualified")

    def blocked(self, name: str, path: str) -> bool:
        ns, local = unpack_type(name)
        for rule in self.options.block_namespace:
            if callable(rule):
                got = rule(name, ns, local, path)
            elif isinstance(rule, dict):
                got = rule.get(name, rule.get(ns))
            else:
                got = True if rule in (ns, name) else None
            if got is not None:
                return bool(got)
        return False

    # -- elements
    def _global_element(self, d: Definition, top: bool = False) -> Element:
        key = f"{d.full}|{top}"
        if key in self._elements:
            return self._elements[key]
        asked = self.options.elements_qualified
        own = Element(self.key(d.ns, d.name), "" if asked == "NONE" or asked is False and not top else d.ns, d.name, Complex(""), path=d.full)
        self._elements[key] = own
        if self.blocked(d.full, d.full):
            own.blocked = True
        self._fill(own, d.node, d.fragment, d.full)
        members = self.catalog.substitution_members(d.full)
        if members:
            own.members = [m for x in members if (m := self._global_element(self.catalog.find("element", x)))]
            if not own.abstract:
                own.members.insert(0, replace(own, members=[]))
        return own

    def _fill(self, own: Element, node: Node, fragment: Fragment, path: str) -> None:
        own.nillable, own.abstract = _true(node.get("nillable")), _true(node.get("abstract"))
        own.default, own.fixed, own.id = node.get("default"), node.get("fixed"), node.get("id")
        inline = [c for c in node.elements if c.local in ("simpleType", "complexType")]
        if name := node.get("type"):
            full = node.qname(name)
            own.type = self._named_type(full)
            own.xsi = self._xsi(full)
            own.blocked = own.blocked or isinstance(own.type, Simple) and own.type.blocked
        elif inline:
            own.type = self._inline(inline[0], fragment, path)
        elif head := node.get("substitutionGroup"):
            d = self.catalog.find("element", node.qname(head))
            if d is None:
                raise SchemaError(f"cannot find substitution head `{head}' at {path}")
            probe = Element("", "", "", Complex(""))
            self._fill(probe, d.node, d.fragment, path)
            own.type = probe.type
        else:
            own.type = self._named_type(pack_type(fragment.xsd, "anyType"))

    def _xsi(self, name: str) -> dict:
        asked = self.options.xsi_type.get(name)
        if asked is None:
            return {}
        others = self.catalog.type_extensions(name) if asked == "AUTO" else [asked] if isinstance(asked, str) else list(asked)
        return {x: self._named_type(x) for x in [name, *others]}

    # -- types
    def _named_type(self, name: str) -> Simple | Complex:
        ns, local = unpack_type(name)
        if ns in T.XSD_NAMESPACES and local in T.BUILTINS and self.catalog.find_type(name) is None:
            return self._builtin(name, local)
        d = self.catalog.find_type(name)
        if d is None:
            raise SchemaError(f"cannot find type {name}")
        if self.blocked(name, name):
            return Simple(name, blocked=True, builtin=T.BUILTINS["string"]) if d.kind == "simpleType" else Complex(name)
        if d.kind == "simpleType":
            return self._simple(d.node, d.fragment, name)
        return self._complex_type(d.node, d.fragment, name, named=True)

    def _builtin(self, name: str, local: str) -> Simple | Complex:
        if local == "anyType":
            return Complex(name, any_type=True)
        b = T.resolve(local, sloppy_integers=self.options.sloppy_integers, sloppy_floats=self.options.sloppy_floats, big_numbers=self.options.big_numbers)
        if b.is_list:
            return Simple(name, "list", b, item=self._builtin(pack_type(unpack_type(name)[0], b.items), b.items))
        return Simple(name, builtin=b)

    def _inline(self, node: Node, fragment: Fragment, path: str) -> Simple | Complex:
        return self._simple(node, fragment, "") if node.local == "simpleType" else self._complex_type(node, fragment, f"unnamed {path}")

    def _simple_named(self, name: str, where: str) -> Simple:
        t = self._named_type(name)
        if isinstance(t, Complex):
            if t.simple is not None:
                return t.simple
            if t.any_type:
                return Simple(name, builtin=T.BUILTINS["string"])
            raise SchemaError(f"`{name}' isn't a simple type at {where}")
        return t

    def _simple(self, node: Node, fragment: Fragment, name: str) -> Simple:
        body = next((c for c in node.elements if c.local in ("restriction", "list", "union")), None)
        if body is None:
            raise SchemaError(f"simpleType contains only annotations at {name}")
        inline = [c for c in body.elements if c.local == "simpleType"]
        if body.local == "list":
            item = self._simple_named(body.qname(body.get("itemType")), name) if body.get("itemType") else self._simple(inline[0], fragment, "")
            return Simple(name, "list", item=item)
        if body.local == "union":
            named = [self._simple_named(body.qname(x), name) for x in (body.get("memberTypes") or "").split()]
            return Simple(name, "union", members=[*named, *(self._simple(x, fragment, "") for x in inline)])
        base = self._simple_named(body.qname(body.get("base")), name) if body.get("base") else self._simple(inline[0], fragment, "")
        return self._restricted(base, body, name)

    def _restricted(self, base: Simple, body: Node, name: str) -> Simple:
        facets = self._facets(body, base)
        return Simple(name or base.name, base.variety, base.builtin, [*base.steps, *([facets] if facets else [])], base.item, base.members, base.blocked)

    def _facets(self, body: Node, base: Simple) -> Facets:
        if self.options.ignore_facets:
            return Facets()
        got: dict = {"bounds": [], "lengths": [], "patterns": [], "enumeration": []}
        for c in body.elements:
            name, value = c.local, c.get("value", default="")
            if name in BOUNDS:
                got["bounds"].append((name, value))
            elif name in LENGTHS:
                got["lengths"].append((name, int(value)))
            elif name == "pattern":
                got["patterns"].append(value)
            elif name == "enumeration":
                got["enumeration"].append(c.qname(value) if base.builtin and base.builtin.kind == "qname" else value)
            elif name in ("whiteSpace", "totalDigits", "fractionDigits", "explicitTimezone", "explicitTimeZone"):
                slot = {"whiteSpace": "space", "totalDigits": "total", "fractionDigits": "fraction"}.get(name, "zone")
                if slot in got:
                    raise SchemaError(f"facet `{name}' is given twice")
                got[slot] = int(value) if slot in ("total", "fraction") else value
            elif name not in (*IGNORED, *_SILENT, "simpleType", "attribute", "attributeGroup", "anyAttribute"):
                raise SchemaError(f"facet `{name}' not implemented")
        return Facets(**{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()})

    # -- complex types
    def _complex_type(self, node: Node, fragment: Fragment, name: str, named: bool = False) -> Complex:
        if named and name in self._complex:
            return self._complex[name]
        own = Complex(name, mixed=_true(node.get("mixed")), abstract=_true(node.get("abstract")))
        if named:
            self._complex[name] = own
        parts = [c for c in node.elements if c.local not in _SILENT]
        if parts and parts[0].local == "simpleContent":
            self._simple_content(own, parts[0], fragment)
        elif parts and parts[0].local == "complexContent":
            own.mixed = own.mixed or _true(parts[0].get("mixed"))
            self._complex_content(own, parts[0], fragment)
        else:
            self._body(own, node, fragment)
        if own.mixed and self.options.mixed_elements == "STRUCTURAL":
            own.mixed = False
        return own

    def _body(self, own: Complex, node: Node, fragment: Fragment) -> None:
        for c in node.elements:
            if c.local in ("sequence", "choice", "all", "group"):
                own.content = self._block(c, fragment, own.name)
        self._attributes(own, node, fragment)

    def _attributes(self, own: Complex, node: Node, fragment: Fragment) -> None:
        found: list[Attribute] = []
        for c in node.elements:
            if c.local == "attribute":
                found.append(self._attribute(c, fragment))
            elif c.local == "attributeGroup":
                d = self.catalog.find("attributeGroup", c.qname(c.get("ref")))
                if d is None:
                    raise SchemaError(f"cannot find attributeGroup {c.get('ref')} at {own.name}")
                probe = Complex("")
                self._attributes(probe, d.node, d.fragment)
                found += probe.attributes
                own.any_attribute = probe.any_attribute or own.any_attribute
            elif c.local == "anyAttribute":
                own.any_attribute = self._wildcard(c, fragment)
        new = {(a.ns, a.local) for a in found}
        own.attributes = [*(a for a in own.attributes if (a.ns, a.local) not in new), *found]

    def _attribute(self, node: Node, fragment: Fragment, top: bool = False) -> Attribute:
        if ref := node.get("ref"):
            full = node.qname(ref)
            ns, local = unpack_type(full)
            d = self.catalog.find("attribute", full)
            if d is not None:
                own = self._attribute(d.node, d.fragment, top=True)
            elif ns == "http://www.w3.org/XML/1998/namespace":
                own = Attribute(self.key(ns, local), ns, local, Simple(local, builtin=T.BUILTINS["string"]))
            else:
                raise SchemaError(f"cannot find attribute {full}")
            return replace(own, use=node.get("use", default="optional"), default=node.get("default") or own.default, fixed=node.get("fixed") or own.fixed)
        local = node.get("name")
        ns = fragment.ns if top or self._qualified(fragment, node.get("form"), "attributes", top) else ""
        inline = next((c for c in node.elements if c.local == "simpleType"), None)
        if node.get("type"):
            kind = self._simple_named(node.qname(node.get("type")), f"@{local}")
        else:
            kind = self._simple(inline, fragment, "") if inline is not None else Simple("anySimpleType", builtin=T.BUILTINS["string"])
        return Attribute(self.key(fragment.ns, local), ns, local, kind, node.get("use", default="optional"), node.get("default"), node.get("fixed"))

    def _simple_content(self, own: Complex, node: Node, fragment: Fragment) -> None:
        body = next(c for c in node.elements if c.local in ("extension", "restriction"))
        base = self._named_type(body.qname(body.get("base"))) if body.get("base") else None
        inline = next((c for c in body.elements if c.local == "simpleType"), None)
        if isinstance(base, Complex):
            own.attributes, own.any_attribute = list(base.attributes), base.any_attribute
            base = base.simple
        if body.local == "restriction" and inline is not None:
            base = self._simple(inline, fragment, "")
        if base is None:
            raise SchemaError(f"simpleContent needs a simple base at {own.name}")
        own.simple = self._restricted(base, body, "") if body.local == "restriction" else base
        self._attributes(own, body, fragment)

    def _complex_content(self, own: Complex, node: Node, fragment: Fragment) -> None:
        body = next(c for c in node.elements if c.local in ("extension", "restriction"))
        name = body.qname(body.get("base"))
        base = Complex("") if name.endswith("anyType") or self.blocked(name, own.name) else self._named_type(name)
        if isinstance(base, Simple):
            raise SchemaError(f"base type {name} not found in complexContent at {own.name}")
        own.attributes, own.any_attribute = list(base.attributes), base.any_attribute
        own.mixed = own.mixed or base.mixed
        self._body(own, body, fragment)
        if body.local == "extension" and base.content is not None:
            parts = [base.content, *([own.content] if own.content is not None else [])]
            own.content = Particle(Group("sequence", parts)) if len(parts) > 1 else parts[0]

    # -- particles
    def _occurs(self, node: Node) -> tuple[int, int | None]:
        low, high = int(node.get("minOccurs", default="1")), node.get("maxOccurs", default="1")
        top = None if high == "unbounded" else int(high)
        if not self.options.check_occurs:
            return 0, None if top is None or top > 1 else top
        return low, top

    def _block(self, node: Node, fragment: Fragment, where: str) -> Particle:
        low, high = self._occurs(node)
        if node.local == "group":
            d = self.catalog.find("group", node.qname(node.get("ref")))
            if d is None:
                raise SchemaError(f"cannot find group {node.get('ref')} at {where}")
            inner = next((c for c in d.node.elements if c.local in ("sequence", "choice", "all")), None)
            if inner is None:
                return Particle(Group("sequence"), low, high, "gr_" + d.name)
            own = self._block(inner, d.fragment, where)
            own.min, own.max, own.label = low, high, LABELS["group"] + self.key(d.ns, d.name)
            return own
        group = Group(node.local)
        for c in node.elements:
            if c.local == "element":
                group.particles.append(self._element_particle(c, fragment, where))
            elif c.local in ("sequence", "choice", "all", "group"):
                group.particles.append(self._block(c, fragment, where))
            elif c.local == "any":
                group.particles.append(Particle(self._wildcard(c, fragment), *self._occurs(c)))
            elif c.local not in _SILENT:
                raise SchemaError(f"unknown particle type `{c.local}' at {where}")
        return Particle(group, low, high, LABELS[node.local] + first_key(group))

    def _element_particle(self, node: Node, fragment: Fragment, where: str) -> Particle:
        low, high = self._occurs(node)
        if ref := node.get("ref"):
            d = self.catalog.find("element", node.qname(ref))
            if d is None:
                raise SchemaError(f"cannot find element {node.qname(ref)} at {where}")
            own = self._global_element(d)
        else:
            local = node.get("name")
            ns = fragment.ns if self._qualified(fragment, node.get("form"), "elements", False) else ""
            path = f"{where.removeprefix('unnamed ')}/{local}"
            own = Element(self.key(fragment.ns, local), ns, local, Complex(""), path=path)
            self._fill(own, node, fragment, path)
        if own.nillable and self.options.interpret_nillable_as_optional:
            low = 0
        return Particle(own, low, high)

    def _wildcard(self, node: Node, fragment: Fragment) -> Wildcard:
        words = (node.get("namespace", default="##any") or "##any").split()
        process = node.get("processContents", default="strict")
        if "##any" in words:
            return Wildcard(None, (), process)
        if "##other" in words:
            return Wildcard(None, (fragment.ns,), process)
        return Wildcard(tuple({"##targetNamespace": fragment.ns, "##local": ""}.get(w, w) for w in words), (), process)


def first_key(group: Group) -> str:
    """The key of the first element declared in a block."""
    for p in group.particles:
        if isinstance(p.term, Element):
            return p.term.key
        if isinstance(p.term, Group) and (key := first_key(p.term)):
            return key
    return ""
