"""The catalog: schema fragments indexed by namespace, kind and name; later definitions override earlier ones."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from xmlframe.functions import types as T
from xmlframe.functions.names import pack_id, pack_type, unpack_type
from xmlframe.sources.xml import Node, load

#: Kinds of global definitions and the elements that hold them.
KINDS = ("element", "attribute", "simpleType", "complexType", "attributeGroup", "group")
_PASSED = frozenset({"annotation", "notation", "redefine", "override", "defaultOpenContent"})


class SchemaError(ValueError):
    pass


@dataclass
class Definition:
    kind: str
    ns: str
    name: str
    node: Node
    fragment: Fragment
    abstract: bool = False
    final: bool = False

    @property
    def full(self) -> str:
        return pack_type(self.ns, self.name)


@dataclass
class Fragment:
    """One ``schema`` element."""

    node: Node
    ns: str
    xsd: str
    source: str = ""
    filename: str | None = None
    elements_qualified: bool = False
    attributes_qualified: bool = False
    definitions: dict[str, dict[str, Definition]] = field(default_factory=lambda: {k: {} for k in KINDS})
    ids: dict[str, Definition] = field(default_factory=dict)
    substitutes: dict[str, list[str]] = field(default_factory=dict)
    imports: dict[str, list[str]] = field(default_factory=dict)
    includes: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, node: Node, **options) -> Fragment:
        if node.ns not in T.XSD_NAMESPACES:
            raise SchemaError(f"schema namespace `{node.ns}' not (yet) supported")
        form = lambda name, default: options[name] if options.get(name) is not None else node.get(default) == "qualified"
        own = cls(node, options.get("target_namespace") or node.get("targetNamespace", default=""), node.ns, options.get("source", ""), options.get("filename"))
        own.elements_qualified = form("elements_qualified", "elementFormDefault")
        own.attributes_qualified = form("attributes_qualified", "attributeFormDefault")
        for c in node.elements:
            if c.ns != node.ns or c.local in _PASSED:
                continue
            if c.local == "import":
                own.imports.setdefault(c.get("namespace", default=""), []).extend(x for x in [c.get("schemaLocation")] if x)
            elif c.local == "include":
                own.includes.append(c.get("schemaLocation", default=""))
            elif c.local in KINDS and (name := c.get("name")):
                d = Definition(c.local, own.ns, name, c, own, c.get("abstract") in ("true", "1"), c.get("final") is not None)
                own.definitions[c.local][d.full] = d
                if c.get("id"):
                    own.ids[pack_id(own.ns, c.get("id"))] = d
                if head := c.get("substitutionGroup"):
                    own.substitutes.setdefault(c.qname(head), []).append(d.full)
        return own


class Catalog:
    """All loaded definitions. ``sources`` are files, texts, nodes, registered namespaces, or lists of them."""

    def __init__(self, sources=(), **options) -> None:
        self.fragments: list[Fragment] = []  # newest last
        self.fallbacks: list[Catalog] = []
        self._seen: dict[str, list[Fragment]] = {}
        self.import_definitions(sources, **options)

    # -- loading
    def import_definitions(self, sources, **options) -> list[Fragment]:
        if sources is None or sources == ():
            return []
        if isinstance(sources, (list, tuple)):
            return [f for s in sources for f in self.import_definitions(s, **options)]
        key = self._cache_key(sources) + repr(sorted((k, v) for k, v in options.items()))
        if key in self._seen:
            return self._seen[key]
        out = self.add_schemas(load(sources), **options)
        self._seen[key] = out
        return out

    @staticmethod
    def _cache_key(source) -> str:
        if isinstance(source, str) and os.path.isfile(source):
            s = os.stat(source)
            return f"{os.path.abspath(source)}-{s.st_mtime_ns}-{s.st_size}"
        if isinstance(source, (str, bytes)):
            return hashlib.sha256(source.encode() if isinstance(source, str) else source).hexdigest()
        return f"object-{id(source)}"

    def add_schemas(self, root: Node, **options) -> list[Fragment]:
        """Register every ``schema`` element of a tree, at any depth."""
        found: list[Node] = []
        root.walk(lambda n: not (n.local == "schema" and (found.append(n) or True)))
        if not found:
            raise SchemaError("no schema element in the source")
        new = [Fragment.read(n, **options) for n in found]
        self.fragments += new
        return new

    def use_schema(self, other: Catalog) -> None:
        """Look up in ``other`` what isn't found here."""
        self.fallbacks.append(other)

    # -- lookups
    def find(self, kind: str, name: str) -> Definition | None:
        for f in reversed(self.fragments):
            if d := f.definitions[kind].get(name):
                return d
        return next((d for c in self.fallbacks if (d := c.find(kind, name))), None)

    def find_id(self, name: str) -> Definition | None:
        for f in reversed(self.fragments):
            if d := f.ids.get(name):
                return d
        return next((d for c in self.fallbacks if (d := c.find_id(name))), None)

    def find_type(self, name: str) -> Definition | None:
        return self.find("simpleType", name) or self.find("complexType", name)

    def _names(self, *kinds: str) -> list[str]:
        return sorted({n for f in self.fragments for k in kinds for n in f.definitions[k]})

    def types(self) -> list[str]:
        return self._names("simpleType", "complexType")

    def elements(self) -> list[str]:
        return self._names("element")

    def attributes(self) -> list[str]:
        return self._names("attribute")

    def list_namespaces(self) -> list[str]:
        return sorted({f.ns for f in self.fragments})

    def import_index(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for f in self.fragments:
            for ns, where in f.imports.items():
                out.setdefault(ns, []).extend(x for x in where if x not in out.get(ns, ()))
        return out

    def substitution_members(self, head: str) -> list[str]:
        """Elements that may stand for ``head``, also over several levels, in order of declaration."""
        out: list[str] = []
        for c in (self, *self.fallbacks):
            for f in c.fragments:
                for m in f.substitutes.get(head, ()):
                    if m not in out:
                        out += [m, *(x for x in self.substitution_members(m) if x not in out)]
        return out

    def base_of(self, name: str) -> str | None:
        ns, local = unpack_type(name)
        if ns in T.XSD_NAMESPACES and local in T.BUILTINS:
            base = T.BUILTINS[local].base
            return base and pack_type(ns, base)
        d = self.find_type(name)
        if d is None:
            return None
        for n in d.node.elements:
            for r in [n, *n.elements] if n.local in ("simpleContent", "complexContent") else [n]:
                if r.local in ("restriction", "extension") and r.get("base"):
                    return r.qname(r.get("base"))
        return None

    def does_extend(self, name: str, base: str) -> bool:
        """Whether a type is ``base`` or derives from it by restriction or extension."""
        at: str | None = name
        while at is not None:
            if at == base:
                return True
            at = self.base_of(at)
        return False

    def type_extensions(self, base: str) -> list[str]:
        return [t for t in self.types() if t != base and self.does_extend(t, base)]

    # -- listings
    def index(self, kinds: Iterable[str] = KINDS, namespaces: Iterable[str] | None = None, list_abstract: bool = True) -> list[tuple[str, str, str, bool, bool]]:
        """(namespace, kind, name, abstract, final) of the definitions that are in force."""
        spaces = None if namespaces is None else set(namespaces)
        rows = {(d.ns, d.kind, d.name): d for f in self.fragments for k in kinds for d in f.definitions[k].values()}
        return [(*key, d.abstract, d.final) for key, d in sorted(rows.items()) if (spaces is None or d.ns in spaces) and (list_abstract or not d.abstract)]

    def index_df(self, spark: SparkSession, **options) -> DataFrame:
        return spark.createDataFrame(self.index(**options), "namespace string, kind string, name string, abstract boolean, final boolean")

    def types_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x,) for x in self.types()], "type string")

    def elements_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(x,) for x in self.elements()], "element string")

    def imports_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(ns, x) for ns, where in self.import_index().items() for x in where or [None]], "namespace string, location string")
