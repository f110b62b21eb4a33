"""Simple values in Python: text to value and value to text, with checks and facets."""

from __future__ import annotations

from dataclasses import dataclass

from xmlframe.functions import types as T
from xmlframe.functions.facets import lexical_error, value_error
from xmlframe.functions.names import unpack_type
from xmlframe.plans.model import Options, Simple
from xmlframe.sources.xml import Node


@dataclass
class DataError(ValueError):
    """A violation in a message. ``misfit``: an enclosing optional block may forgive it if nothing was consumed."""

    code: str
    path: str
    text: str
    misfit: bool = False

    def __str__(self) -> str:
        return self.text


def read_simple(t: Simple, text: str, path: str, options: Options, scope: Node | None = None):
    if not t.steps and t.variety == "atomic" and not t.blocked and (known := T.plain_value(t.builtin, text)) is not None:
        return known
    if t.blocked:
        raise DataError("blocked", path, f"use of simpleType {t.name} blocked at {path}")
    if t.variety == "union":
        for m in t.members:
            try:
                read_simple(m, text, path, options, scope)
            except (DataError, ValueError, ArithmeticError):
                continue
            return T.squeezed(text) if m.builtin and m.builtin.kind != "text" else text
        raise DataError("union", path, f"no match for `{text}' in union at {path}#union")
    for f in t.steps:
        text, wrong = lexical_error(f, _named(t, text, scope) if f.enumeration and t.builtin and t.builtin.kind == "qname" else T.squeezed(text) if t.variety == "list" and f.enumeration else text)
        if wrong:
            raise DataError("facet", path, f"{wrong} at {path}#facet")
    if t.variety == "list":
        if t.builtin and options.check_values and not T.valid(t.builtin, text):
            raise DataError("value", path, f"illegal value `{text}' for type {t.name} at {path}")
        value = [read_simple(t.item, x, path, options, scope) for x in text.split()]
    else:
        b = t.builtin
        if b.kind == "qname":
            return _named(t, text, scope)
        if options.check_values and not T.valid(b, text):
            raise DataError("value", path, f"illegal value `{text}' for type {t.name} at {path}")
        try:
            value = T.value(b, text)
        except (ValueError, ArithmeticError):
            raise DataError("value", path, f"illegal value `{text}' for type {t.name} at {path}") from None
    for f in t.steps:
        if wrong := value_error(f, t.builtin.kind if t.builtin and t.variety == "atomic" else "text", T.spaced(text, t.builtin.space if t.builtin else "preserve"), value, date_facets=options.date_facets):
            raise DataError("facet", path, f"{wrong} at {path}#facet")
    return value


def _named(t: Simple, text: str, scope: Node | None) -> str:
    return text.strip() if text.strip().startswith("{") or scope is None else scope.qname(text)


def write_simple(t: Simple, value, path: str, options: Options, prefix=None) -> str:
    """The checked text of a value; ``prefix`` gives the prefix of a namespace for qualified names."""
    if type(value) is int and not t.steps and t.variety == "atomic" and not t.blocked and T.holds(t.builtin, value):
        return str(value)
    if t.variety == "union":
        for m in t.members:
            try:
                return write_simple(m, value, path, options, prefix)
            except (DataError, ValueError, ArithmeticError):
                continue
        raise DataError("union", path, f"no match for `{value}' in union at {path}#union")
    if t.variety == "list":
        items = value if isinstance(value, (list, tuple)) else str(value).split()
        text = " ".join(write_simple(t.item, x, path, options, prefix) for x in items)
    elif t.builtin.kind == "qname":
        ns, local = unpack_type(str(value))
        text = f"{p}:{local}" if ns and (p := prefix(ns)) else local
    else:
        text = T.text_of(t.builtin, value)
    read_simple(Simple(t.name, t.variety, t.builtin, t.steps, t.item, t.members, t.blocked) if t.builtin is None or t.builtin.kind != "qname" else Simple(t.name, builtin=t.builtin), text, path, options)
    for f in t.steps:
        if t.variety == "atomic" and t.builtin.kind != "qname":
            text, _ = lexical_error(f, text)
    return text
