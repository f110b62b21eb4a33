"""Examples of an element, made from its compiled form."""

from __future__ import annotations

from xmlframe.functions.names import unpack_type
from xmlframe.operators.reader_python import hook_meets
from xmlframe.operators.writer_python import Prefixes
from xmlframe.plans.model import Complex, Element, Group, Options, Particle, Simple, Wildcard
from xmlframe.sources.xml import escape, escape_attr

# One example of each kind of built-in.
EXAMPLES = {"boolean": "true", "date": "2006-10-06", "dateTime": "2006-10-06T00:23:02Z", "time": "11:21:04", "gDay": "---12+01:00", "gMonth": "--09+02:00", "gMonthDay": "--12-27+01:00", "gYear": "2005", "gYearMonth": "2006-11", "duration": "P9M2DT3H5M", "dayTimeDuration": "P2DT3H5M10S", "yearMonthDuration": "P40Y5M", "base64Binary": "VGVzdA==", "hexBinary": "F00F", "anyURI": "http://example.com", "QName": "myns:local", "language": "nl-NL", "NCName": "label", "ID": "label", "IDREF": "id-ref", "NMTOKEN": "I-am-a-token", "float": "3.1415", "double": "3.1415", "decimal": "3.1415"}


class Template:
    """Hooks with the action TEMPLATE, or none, may change it: ``replace`` is SKIP (left out), COLLAPSE (an element without what it
    holds) or a function of (path, element, tree of the element) that gives another tree or None; ``before`` functions of (path,
    element) leave it out by a false value; ``after`` functions of (path, tree) give the tree to use. At types of a typemap
    stands who converts them.
    """

    def __init__(self, root: Element, options: Options, comments: str, indent: str, extends: dict[str, list[str]] | None = None) -> None:
        self.root, self.options, self.comments, self.indent, self.extends = root, options, comments, indent, extends or {}
        self.hooks = [h for h in options.hooks if h.action in (None, "TEMPLATE")]

    def render(self, output: str):
        tree = self._element(self.root, 1, 1, (), self.root.path)
        if tree is None:
            raise ValueError(f"a hook leaves out the whole of {self.root.path}")
        if output == "TREE":
            return tree
        if output == "DATA":
            return "\n".join(self._data(tree, "")) + "\n"
        if output == "XML":
            self.prefixes = Prefixes(self.options, self.root.ns)
            lines = self._xml(tree, "")
            spaces = "".join(f' xmlns{":" + p if p else ""}="{escape_attr(ns)}"' for ns, p in sorted(self.prefixes.used.items(), key=lambda x: x[1]))
            at = next(i for i, x in enumerate(lines) if not x.lstrip().startswith("<!--"))
            head = lines[at]
            cut = min(i for i in (head.find(" "), head.find(">"), head.find("/>")) if i > 0) if head.startswith("<") else 0
            lines[at] = head[:cut] + spaces + head[cut:]
            return "\n".join(lines) + "\n"
        raise ValueError(f"template output is DATA, XML or TREE, not `{output}'")

    # -- the tree
    def _simple(self, t: Simple) -> dict:
        facets = [f for f in t.steps if f]
        enumerated = next((f.enumeration for f in reversed(facets) if f.enumeration), ())
        if t.variety == "list":
            example = " ".join([self._simple(t.item)["example"]] * 2)
        elif t.variety == "union":
            example = self._simple(t.members[0])["example"] if t.members else ""
        else:
            example = EXAMPLES.get(t.builtin.name, "42" if t.builtin.kind == "integer" else "example")
        notes = [f"{n} {v}" for f in facets for n, v in (*f.bounds, *f.lengths)] + [f"pattern {p}" for f in facets for p in f.patterns]
        notes += [f"{n} {v}" for f in facets for n, v in (("totalDigits", f.total), ("fractionDigits", f.fraction), ("whiteSpace", f.space)) if v is not None]
        if enumerated:
            notes.append("enum: " + " ".join(enumerated))
        kind = f"list of {t.item.name}" if t.variety == "list" else "union of " + ", ".join(m.name for m in t.members) if t.variety == "union" else t.name
        return {"type": kind, "example": enumerated[0] if enumerated else example, "facets": notes}

    def _occurs(self, low: int, high: int | None) -> str:
        if (low, high) == (1, 1):
            return ""
        if (low, high) == (0, 1):
            return "is optional"
        return f"occurs {low} <= # <= {'unbounded' if high is None else high} times" if low != high else f"occurs {low} times"

    def _element(self, e: Element, low: int, high: int | None, seen: tuple, path: str) -> dict | None:
        """The tree of an element as hooks and codecs leave it, or None."""
        hooks = [h for h in self.hooks if hook_meets(h, e, path, self.extends)]
        replaced = next((h.replace for h in hooks if h.replace is not None and (callable(h.replace) or h.replace in ("SKIP", "COLLAPSE"))), None)
        if replaced == "SKIP" or any(not f(path, e) for h in hooks if h.action == "TEMPLATE" for f in h.before):
            return None
        codec = self.options.typemap.get(e.type.name)
        if codec is not None:
            own = {"kind": "element", "key": e.key, "ns": e.ns, "local": e.local, "occurs": self._occurs(low, high), "many": high is None or high > 1, "notes": []}
            said = "converted by to_xml() and from_xml() of" if hasattr(codec, "to_xml") else "converted by calling"
            out = own | {"type": e.type.name, "notes": [f"{said} {getattr(codec, '__name__', type(codec).__name__)}"], "example": "Anything"}
        else:
            out = self._plain(e, low, high, seen, path)
        if replaced == "COLLAPSE":
            out = {k: v for k, v in out.items() if k not in ("children", "attributes", "value", "members")} | {"notes": [*out["notes"], "content collapsed"], "example": ""}
        elif callable(replaced) and any(h.action == "TEMPLATE" for h in hooks):
            out = replaced(path, e, out)
        for h in hooks:
            for f in h.after if h.action == "TEMPLATE" and out is not None else ():
                out = f(path, out)
        return out

    def _plain(self, e: Element, low: int, high: int | None, seen: tuple, path: str) -> dict:
        out = {"kind": "element", "key": e.key, "ns": e.ns, "local": e.local, "occurs": self._occurs(low, high), "many": high is None or high > 1, "notes": []}
        if e.members:
            out |= {"struct": f"substitutes {e.local}", "members": [m.key for m in e.members], "children": [x for m in e.members[:1] if (x := self._element(m, 1, 1, seen, path))]}
            return out
        for word, value in (("fixed to", e.fixed), ("defaults to", e.default)):
            if value is not None:
                out["notes"].append(f"{word} '{value}'")
        out["notes"] += ["is nillable"] * e.nillable + ["ABSTRACT"] * e.abstract
        if e.xsi:
            out["notes"].append("xsi:type alternatives: " + ", ".join(e.xsi))
        t = e.type
        if isinstance(t, Simple):
            own = self._simple(t)
            return out | own | {"example": e.fixed or e.default or own["example"]}
        out["type"] = t.name
        if t.any_type:
            return out | {"example": "Anything"}
        if any(t is s for s in seen):
            return out | {"notes": [*out["notes"], "is recursive"], "children": [], "attributes": []}
        out["attributes"] = [self._attribute(a) for a in t.attributes if a.use != "prohibited"]
        if self.options.permit_href:
            out["notes"].append("may be an element with href")
        if t.any_attribute:
            out["notes"].append(f"any attribute in {_spaces(t.any_attribute)}")
        if t.mixed:
            out["notes"].append("mixed content cannot be processed automatically")
        if t.simple is not None:
            return out | {"value": self._simple(t.simple)}
        out["children"] = self._particle(t.content, (*seen, t), path) if t.content is not None else []
        return out

    def _attribute(self, a) -> dict:
        notes = [f"attribute is {a.use}"] * (a.use == "required") + [f"attribute is fixed to '{a.fixed}'"] * (a.fixed is not None) + [f"attribute defaults to '{a.default}'"] * (a.default is not None)
        own = self._simple(a.type)
        return own | {"key": a.key, "ns": a.ns, "local": a.local, "notes": notes, "example": a.fixed or a.default or own["example"]}

    def _particle(self, p: Particle, seen: tuple, path: str) -> list[dict]:
        if p.max == 0:
            return []
        if isinstance(p.term, Element):
            return [x for x in [self._element(p.term, p.min, p.max, seen, f"{path}/{p.term.local}")] if x]
        if isinstance(p.term, Wildcard):
            return [{"kind": "any", "occurs": self._occurs(p.min, p.max), "namespaces": _spaces(p.term)}]
        inner = [x for q in p.term.particles for x in self._particle(q, seen, path)]
        names = ", ".join(_label(q) for q in p.term.particles)
        struct = {"kind": "block", "struct": f"{p.term.kind} of {names}", "occurs": self._occurs(p.min, p.max), "key": p.label, "many": p.many, "children": inner}
        return [struct] if p.many else [{**struct, "children": []}, *inner]

    # -- as data
    def _notes(self, x: dict) -> list[str]:
        if self.comments == "NONE":
            return []
        want = {"type", "struct", "occur", "facets"} if self.comments == "ALL" else set(self.comments.split(","))
        out = [x.get("struct", "")] * ("struct" in x and "struct" in want)
        out += [f"is a {x.get('type')}"] * bool(x.get("type") and "type" in want)
        out += x.get("notes", [])
        out += [x["occurs"]] * bool(x.get("occurs") and "occur" in want)
        return out + (x.get("facets", []) if "facets" in want else [])

    def _data(self, x: dict, pad: str) -> list[str]:
        out = [f"{pad}# {n}" for n in self._notes(x)]
        if x["kind"] == "any":
            return [f"{pad}# any element in {x['namespaces']}, {x['occurs'] or 'once'}"]
        if x["kind"] == "block" and not x["many"]:
            return out
        inner = pad + self.indent
        if x["kind"] == "block" or "children" in x or "value" in x:
            body = [f"{inner}{a['key']!r}: {a['example']!r},  # {', '.join([a['type'], *a['notes']])}" for a in x.get("attributes", [])]
            if "value" in x:
                body.append(f"{inner}'_': {x['value']['example']!r},  # string content of the container")
            for c in x.get("children", []):
                body += self._data(c, inner)
            many = x.get("many")
            return [*out, f"{pad}{x['key']!r}: {'[' * bool(many)}{{", *body, f"{pad}}}{'],' if many else ','}"]
        value = repr(x.get("example", ""))
        return [*out, f"{pad}{x['key']!r}: {f'[{value}, ]' if x.get('many') else value},"]

    # -- as XML
    def _xml(self, x: dict, pad: str) -> list[str]:
        out = [f"{pad}<!-- {n.replace('--', '- -')} -->" for n in self._notes(x)]
        if x["kind"] == "any":
            return [f"{pad}<!-- any element in {x['namespaces']}, {x['occurs'] or 'once'} -->"]
        if x["kind"] == "block":
            return out + [line for c in x["children"] for line in self._xml(c, pad)]
        if "members" in x:
            return out + [line for c in x["children"] for line in self._xml(c, pad)]
        tag = self.prefixes.tag(x["ns"], x["local"])
        attrs = "".join(f' {self.prefixes.tag(a["ns"], a["local"], True)}="{escape_attr(a["example"])}"' for a in x.get("attributes", []))
        if x.get("children"):
            return [*out, f"{pad}<{tag}{attrs}>", *(line for c in x["children"] for line in self._xml(c, pad + self.indent)), f"{pad}</{tag}>"]
        value = x["value"]["example"] if "value" in x else x.get("example", "")
        return [*out, f"{pad}<{tag}{attrs}>{escape(value)}</{tag}>" if value else f"{pad}<{tag}{attrs}/>"]


def _spaces(w: Wildcard) -> str:
    """The namespaces of a wildcard in words."""
    yes = "any namespace" if w.yes is None else ", ".join(n or "no namespace" for n in w.yes)
    return yes + (" but " + ", ".join(n or "no namespace" for n in w.no) if w.no else "")


def _label(p: Particle) -> str:
    if isinstance(p.term, Element):
        return p.term.local
    return "any" if isinstance(p.term, Wildcard) else p.label or p.term.kind if isinstance(p.term, Group) else ""


def names_of(tree: dict) -> list[str]:
    """The local names of a template's elements, in order."""
    own = [tree["local"]] if tree.get("local") else []
    return own + [n for c in tree.get("children", []) for n in names_of(c)]


__all__ = ["Complex", "Template", "names_of", "unpack_type"]
