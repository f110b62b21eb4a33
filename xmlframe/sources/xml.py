"""XML text to node trees, safely: no external entity, no entity declaration, no network. Scans that give message columns."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.functions.names import pack_type

XML_NS = "http://www.w3.org/XML/1998/namespace"


class XmlError(ValueError):
    pass


@dataclass(eq=False)
class Node:
    ns: str
    local: str
    attrs: dict[tuple[str, str], str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    scope: dict[str, str] = field(default_factory=dict)  # prefix: namespace
    parent: Node | None = None

    @property
    def name(self) -> str:
        return pack_type(self.ns, self.local)

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    @property
    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text for c in self.children)

    @property
    def path(self) -> str:
        """Location in the message, with a position where siblings share the name."""
        if self.parent is None:
            return f"/{self.local}"
        same = [c for c in self.parent.elements if c.local == self.local]
        return f"{self.parent.path}/{self.local}" + (f"[{same.index(self) + 1}]" if len(same) > 1 else "")

    def get(self, local: str, ns: str = "", default: str | None = None) -> str | None:
        return self.attrs.get((ns, local), default)

    def qname(self, text: str, what: str = "") -> str:
        """A prefixed name of this node's scope as a packed one."""
        prefix, colon, local = text.strip().rpartition(":")
        if colon and prefix not in self.scope:
            raise XmlError(f"unknown prefix `{prefix}' in `{text}'{what}")
        return pack_type(self.scope.get(prefix, ""), local)

    def walk(self, visit: Callable[[Node], bool]) -> None:
        """Pre-order; a node's children are skipped where ``visit`` gives a false value."""
        if visit(self):
            for c in self.elements:
                c.walk(visit)


def parse(text: str | bytes) -> Node:
    """The root element of a message."""
    if isinstance(text, str):
        text = text.lstrip("﻿").encode()
    parser = expat.ParserCreate("utf-8" if not text.lstrip().startswith(b"<?xml") else None)
    parser.buffer_text = True
    parser.ordered_attributes = True
    stack: list[Node] = []
    roots: list[Node] = []

    def start(name: str, flat: list[str]) -> None:
        scope = stack[-1].scope if stack else {"xml": XML_NS}
        pairs = list(zip(flat[::2], flat[1::2]))
        own = {k[6:] if k != "xmlns" else "": v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        if own:
            scope = scope | own

        def split(qname: str, is_attr: bool) -> tuple[str, str]:
            prefix, _, local = qname.rpartition(":")
            if not prefix:
                return ("" if is_attr else scope.get("", ""), local)
            if prefix not in scope:
                raise XmlError(f"unknown prefix in `{qname}'")
            return scope[prefix], local

        node = Node(*split(name, False), scope=scope, parent=stack[-1] if stack else None)
        node.attrs = {split(k, True): v for k, v in pairs if k != "xmlns" and not k.startswith("xmlns:")}
        (stack[-1].children if stack else roots).append(node)
        stack.append(node)

    def refuse(*_) -> None:
        raise XmlError("entity declarations are refused")

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda _: stack.pop()
    parser.CharacterDataHandler = lambda data: stack[-1].children.append(data) if stack else None
    parser.EntityDeclHandler = refuse
    parser.ExternalEntityRefHandler = refuse
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise XmlError(f"not well-formed: {e}") from None
    return roots[0]


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def cdata(text: str) -> str:
    return "<![CDATA[" + text.replace("]]>", "]]]]><![CDATA[>") + "]]>"


def escape_attr(text: str) -> str:
    return escape(text).replace('"', "&quot;").replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")


def serialize(node: Node, known: dict[str, str] | None = None) -> str:
    """A node as text; namespaces are declared where they come into use."""
    known = dict(known or {})
    prefixes = {uri: p for p, uri in node.scope.items()}
    declared: list[tuple[str, str]] = []

    def tag(ns: str, local: str, is_attr: bool) -> str:
        if not ns:
            if not is_attr and known.get(""):
                declared.append(("", ""))
                known[""] = ""
            return local
        if ns == XML_NS:
            return f"xml:{local}"
        p = next((p for p, uri in known.items() if uri == ns and (p or not is_attr)), None)
        if p is None:
            p = prefixes.get(ns, "")
            if not p and is_attr:
                p = f"n{len(known)}"
            known[p] = ns
            declared.append((p, ns))
        return f"{p}:{local}" if p else local

    name = tag(node.ns, node.local, False)
    attrs = "".join(f' {tag(ns, local, True)}="{escape_attr(v)}"' for (ns, local), v in node.attrs.items())
    spaces = "".join(f' xmlns{":" + p if p else ""}="{escape_attr(uri)}"' for p, uri in declared)
    inner = "".join(escape(c) if isinstance(c, str) else serialize(c, known) for c in node.children)
    return f"<{name}{spaces}{attrs}>{inner}</{name}>" if node.children else f"<{name}{spaces}{attrs}/>"


#: Packaged schemas can be registered by namespace.
KNOWN_NAMESPACES: dict[str, str] = {}
SCHEMA_DIRS: list[str] = []


def add_schema_dirs(*dirs: str | list[str]) -> list[str]:
    """Append folders (also as one text, separated by the path separator) to the search path of schemas."""
    for d in dirs:
        SCHEMA_DIRS.extend(d if isinstance(d, list) else [x for x in str(d).split(os.pathsep) if x])
    return SCHEMA_DIRS


def known_namespace(ns: str, file: str | None = None) -> str | None:
    if file is not None:
        KNOWN_NAMESPACES[ns] = file
    return KNOWN_NAMESPACES.get(ns)


def find_schema_file(name: str) -> str | None:
    if os.path.isabs(name):
        return name if os.path.isfile(name) else None
    return next((str(p) for d in SCHEMA_DIRS if (p := Path(d, name)).is_file()), None)


def load(source) -> Node:
    """A node from a node, XML text or bytes, an open file, a registered namespace, or a file by name."""
    if isinstance(source, Node):
        return source
    if hasattr(source, "read"):
        return parse(source.read())
    if isinstance(source, (bytes, bytearray)):
        return parse(bytes(source))
    if isinstance(source, str):
        if source.lstrip("﻿ \t\r\n").startswith("<"):
            return parse(source)
        if source in KNOWN_NAMESPACES:
            source = KNOWN_NAMESPACES[source]
        if file := find_schema_file(source) or (source if os.path.isfile(source) else None):
            return parse(Path(file).read_bytes())
        raise XmlError(f"cannot find schema or message `{source}'")
    raise XmlError(f"don't know how to interpret XML data of {type(source).__name__}")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """One message for each whole file: (path, xml)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def scan_records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One message for each ``row_tag`` element of large files, cut by the XML source: column ``xml`` as a variant."""
    return spark.read.format("xml").option("rowTag", row_tag).option("singleVariantColumn", "xml").load(path)


def messages(root: Node, name: str) -> Iterator[Node]:
    """All elements of a packed name in a tree, outermost first."""
    found: list[Node] = []
    root.walk(lambda n: not (n.name == name and (found.append(n) or True)))
    return iter(found)
