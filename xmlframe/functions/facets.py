"""Facets on simple types, as Python functions and as Catalyst predicates.

Lexical facets (white space, pattern, enumeration, digits) look at the text, value facets (bounds, lengths) at the value.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from xmlframe.functions import types as T
from xmlframe.functions.durations import duration2secs, duration2secs_col

BOUNDS = {"minInclusive": ">=", "minExclusive": ">", "maxInclusive": "<=", "maxExclusive": "<"}
LENGTHS = {"length": "==", "minLength": ">=", "maxLength": "<="}
LEXICAL = ("whiteSpace", "pattern", "enumeration", "totalDigits", "fractionDigits", "explicitTimeZone")
IGNORED = ("maxScale", "minScale")
_COMPARE: dict[str, Callable] = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


@dataclass(frozen=True)
class Facets:
    """What one restriction adds. Several patterns or enumeration values are alternatives."""

    bounds: tuple[tuple[str, str], ...] = ()
    lengths: tuple[tuple[str, int], ...] = ()
    patterns: tuple[str, ...] = ()
    enumeration: tuple[str, ...] = field(default=())
    space: str | None = None
    total: int | None = None
    fraction: int | None = None
    zone: str | None = None

    def __bool__(self) -> bool:
        return self != Facets()


def xsd_regex(pattern: str) -> str:
    """A schema pattern as an anchored regular expression that Python and Java share."""
    name_start, name_char = r"A-Za-z_:À-�", r"A-Za-z0-9_:.\-·À-�"
    out, inside, i = [], False, 0
    while i < len(pattern):
        c, n = pattern[i], pattern[i + 1 : i + 2]
        if c == "\\" and n in "icIC" and n:
            body = name_start if n in "iI" else name_char
            out.append(body if inside else f"[{'^' if n.isupper() else ''}{body}]")
            i += 2
        elif c == "\\" and n in "pP" and n:
            end = pattern.find("}", i)
            out.append(_category(pattern[i + 3 : end], n == "P", inside))
            i = end + 1
        elif c == "\\" and n == "d":
            out.append("0-9" if inside else "[0-9]")
            i += 2
        elif c == "\\" and n:
            out.append(c + n)
            i += 2
        elif inside and c == "-" and n == "[":  # class subtraction: a look-ahead before the class
            end = pattern.find("]", i)
            start = max(k for k, x in enumerate(out) if x == "[")
            out.insert(start, f"(?:(?!{xsd_regex(pattern[i + 1 : end + 1])[4:-2]})")
            out.append("])")
            i, inside = end + 2, False
        else:
            inside = c == "[" or inside and c != "]"
            out.append("\\" + c if c in "^$" and not (c == "^" and inside and out and out[-1] == "[") else c)
            i += 1
    return f"^(?:{''.join(out)})$"


def _category(name: str, negated: bool, inside: bool) -> str:
    # Ranges that stand for the categories used most.
    ranges = {"L": r"A-Za-zªµºÀ-ÖØ-öø-ʯͰ-ￜ", "Lu": r"A-ZÀ-ÖØ-Þ", "Ll": r"a-zß-öø-ÿ", "N": "0-9", "Nd": "0-9", "P": r"!-#%-*,-/:;?@\[-\]_{}", "Z": r"  ", "Zs": r"  ", "S": r"$+<->^`|~", "IsBasicLatin": r"\u0000-\u007F", "IsLatin-1Supplement": r"\u0080-ÿ"}
    if name not in ranges:
        raise ValueError(f"character category `{name}' isn't supported")
    if inside and not negated:
        return ranges[name]
    return f"[{'^' if negated else ''}{ranges[name]}]"


def digits(text: str) -> str:
    """The digits that count for totalDigits: no sign, leading zeros, exponent or zeros behind the point."""
    t = re.sub(r"[eE].*$", "", text.strip()).lstrip("+-")
    whole, _, part = t.partition(".")
    return whole.lstrip("0") + part


def number(text: str) -> Decimal | float:
    t = text.strip()
    return float(t.replace("INF", "inf")) if t.lstrip("+-") in ("INF", "NaN") else Decimal(t)


def lexical_error(f: Facets, text: str) -> tuple[str, str | None]:
    """(text after white space and digit facets, message or None)."""
    if f.space == "collapse":
        text = T.squeezed(text)
    elif f.space == "replace":
        text = T.spaced(text, "replace")
    if f.patterns and not any(re.search(xsd_regex(p), text) for p in f.patterns):
        return text, f"string `{text}' does not match pattern " + " or ".join(f"`{p}'" for p in f.patterns)
    if f.enumeration and text not in f.enumeration:
        return text, f"invalid enumerate `{text}'"
    if f.total is not None:
        if f.fraction is not None and len(text.partition(".")[2]) > f.fraction:
            return text, f"fractional part for {text} too long, got {len(text.partition('.')[2])} digits max {f.fraction}"
        if len(digits(text)) > f.total:
            return text, f"decimal too long, got {len(digits(text))} digits max {f.total}"
    elif f.fraction is not None and "." in text:
        whole, _, part = text.partition(".")
        text = whole + ("." + part[: f.fraction] if f.fraction else "")
    if f.zone in ("required", "prohibited"):
        has = bool(re.search(r"(?:Z|[+-][0-9]{2}:[0-9]{2})\s*$", text))
        if has != (f.zone == "required"):
            return text, f"timezone {'forbidden' if has else 'required'} on {text}"
    return text, None


# The texts of violations; v stands for the value, b for the bound.
_BOUND_TEXT = {"minInclusive": "too small inclusive {v}, min {b}", "minExclusive": "too small exclusive {v}, larger {b}", "maxInclusive": "too large inclusive {v}, max {b}", "maxExclusive": "too large exclusive {v}, smaller {b}"}
_LENGTH_TEXT = {"length": "does not have required length {n}", "minLength": "does not have minimum length {n}", "maxLength": "longer than maximum length {n}"}


def bound_text(name: str, kind: str) -> str:
    low = name.startswith("min")
    if kind == "duration":
        return f"too {'small' if low else 'large'} {name} duration {{v}}, {'min' if low else 'max'} {{b}}"
    return _BOUND_TEXT["minInclusive" if low else "maxInclusive"] if kind == "date" else _BOUND_TEXT[name]


def value_error(f: Facets, kind: str, text: str, value, *, date_facets: str = "lexical") -> str | None:
    for name, bound in f.bounds:
        if kind == "duration":
            ok = _COMPARE[BOUNDS[name]](duration2secs(text), duration2secs(bound))
        elif kind == "date":
            strict = BOUNDS[name] if date_facets == "strict" else BOUNDS[name].rstrip("=")
            ok = _COMPARE[strict](text, bound)
        elif kind in ("integer", "decimal", "float"):
            ok = _COMPARE[BOUNDS[name]](number(text), number(bound))
        else:
            ok = _COMPARE[BOUNDS[name]](text, bound)
        if not ok:
            return bound_text(name, kind).format(v=text, b=bound)
    size = len(value) if isinstance(value, (bytes, list)) else len(text)
    for name, n in f.lengths:
        if not _COMPARE[LENGTHS[name]](size, n):
            what, many = _LENGTH_TEXT[name].format(n=n), isinstance(value, list)
            return f"{'list' if many else 'string'} `{text}' {what}" + f" but {size}" * (name == "length" and not many)
    return None


def space_col(f: Facets, text: Column) -> Column:
    if f.space == "collapse":
        return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    text = T.spaced_col(text, "replace") if f.space == "replace" else text
    if f.fraction is not None and f.total is None:
        cut = rf"^([^.]*\.[0-9]{{{f.fraction}}})[0-9]*$" if f.fraction else r"^([^.]*)\..*$"
        text = F.regexp_replace(text, cut, "$1")
    return text


def digits_col(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"[eE].*$", ""), r"^[+-]?0*", "")
    return F.length(F.replace(t, F.lit("."), F.lit("")))


Violation = tuple[Column, Column]  # where it holds, and its text


def _say(template: str, text: Column) -> Column:
    """A text with the value in place of {v}."""
    before, _, after = template.partition("{v}")
    return F.concat(F.lit(before), text, F.lit(after))


def lexical_cols(f: Facets, text: Column) -> list[Violation]:
    """Where a text violates a facet, and what to say."""
    bad: list[Violation] = []
    if f.patterns:
        said = "string `{v}' does not match pattern " + " or ".join(f"`{p}'" for p in f.patterns)
        bad.append((~text.rlike("|".join(xsd_regex(p) for p in f.patterns)), _say(said, text)))
    if f.enumeration:
        bad.append((~text.isin(*f.enumeration), _say("invalid enumerate `{v}'", text)))
    if f.total is not None:
        if f.fraction is not None:
            n = F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))
            bad.append((n > f.fraction, F.concat(_say("fractional part for {v} too long, got ", text), n.cast("string"), F.lit(f" digits max {f.fraction}"))))
        n = digits_col(text)
        long = n > f.total if not bad or f.fraction is None else ~bad[-1][0] & (n > f.total)
        bad.append((long, F.concat(F.lit("decimal too long, got "), n.cast("string"), F.lit(f" digits max {f.total}"))))
    if f.zone in ("required", "prohibited"):
        has = text.rlike(r"(?:Z|[+-][0-9]{2}:[0-9]{2})\s*$")
        bad.append((~has, _say("timezone required on {v}", text)) if f.zone == "required" else (has, _say("timezone forbidden on {v}", text)))
    return bad


def _fits(bound: str, kind: str) -> bool:
    whole, _, part = bound.strip().lstrip("+-").partition(".")
    return len(whole.lstrip("0")) <= (38 if kind == "integer" else 20) and len(part.rstrip("0")) <= 18


def value_cols(f: Facets, kind: str, text: Column, value: Column, *, is_list: bool = False, date_facets: str = "lexical", as_text: bool = False) -> list[Violation]:
    bad: list[Violation] = []
    for name, bound in f.bounds:
        sign = BOUNDS[name]
        if kind == "duration":
            ok = _COMPARE[sign](duration2secs_col(text), F.lit(duration2secs(bound)))
        elif kind == "date":
            ok = _COMPARE[sign if date_facets == "strict" else sign.rstrip("=")](text, F.lit(bound))
        elif kind in ("integer", "decimal") and (as_text or not _fits(bound, kind)):
            ok = _COMPARE[sign](T.compare_col(text, bound), F.lit(0))
        elif kind in ("integer", "decimal"):
            ok = _COMPARE[sign](value, F.lit(Decimal(bound)))
        elif kind == "float":
            ok = _COMPARE[sign](value, F.lit(float(bound.replace("INF", "inf"))))
        else:
            ok = _COMPARE[sign](text, F.lit(bound))
        bad.append((~ok, _say(bound_text(name, kind).replace("{b}", bound), text)))
    size = F.size(value) if is_list else F.octet_length(value) if kind in ("base64", "hex") else F.length(text)
    for name, n in f.lengths:
        said = _say(("list" if is_list else "string") + " `{v}' " + _LENGTH_TEXT[name].format(n=n), text)
        if name == "length" and not is_list:
            said = F.concat(said, F.lit(" but "), size.cast("string"))
        bad.append((~_COMPARE[LENGTHS[name]](size, F.lit(n)), said))
    return bad
