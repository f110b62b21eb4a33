"""Built-in simple types: lexical check, value, format and Spark type, each once for Python and for Catalyst.

A check is one regular expression that Python and Java read alike. Numbers are checked on the text before the cast, so a
pattern or an enumeration still sees what was written.
"""

from __future__ import annotations

import base64
import math
import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of the schema language, by version.
XSD2001 = "http://www.w3.org/2001/XMLSchema"
XSD2000 = "http://www.w3.org/2000/10/XMLSchema"
XSD1999 = "http://www.w3.org/1999/XMLSchema"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
XSD_NAMESPACES = (XSD1999, XSD2000, XSD2001)

_ZONE = r"(?:Z|[+-][0-9]{2}:[0-9]{2})?"
_DATE = r"-?[0-9]{4,}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_TIME = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
_FLOAT = r"^\s*(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)\s*$"
_NCNAME = r"^\s*[\p{L}_][\p{L}\p{N}_.\-]*\s*$"
_DURATION = r"-?P(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?"


@dataclass(frozen=True)
class Builtin:
    name: str
    base: str | None
    spark: str = "string"
    check: str | None = None  # regular expression on the text
    space: str = "preserve"  # preserve, replace, collapse, remove
    kind: str = "text"  # text, integer, decimal, float, boolean, base64, hex, date, duration, qname
    low: int | None = None
    high: int | None = None
    items: str | None = None  # item type of a built-in list

    @property
    def is_list(self) -> bool:
        return self.items is not None


def _all() -> dict[str, Builtin]:
    integer = r"^\s*[-+]?[0-9][0-9\s]*$"
    rows = [
        Builtin("anyType", None),
        Builtin("anySimpleType", "anyType"),
        Builtin("anyAtomicType", "anySimpleType"),
        Builtin("error", "anyType"),
        Builtin("boolean", "anyAtomicType", "boolean", r"^\s*(?:[tT][rR][uU][eE]|[fF][aA][lL][sS][eE]|0|1)\s*$", kind="boolean"),
        Builtin("pattern", "string"),
        Builtin("integer", "decimal", "decimal(38,0)", integer, "remove", "integer"),
        Builtin("nonPositiveInteger", "integer", "decimal(38,0)", r"^\s*(?:-[0-9][0-9\s]*|\+?0[0\s]*)$", "remove", "integer", high=0),
        Builtin("negativeInteger", "nonPositiveInteger", "decimal(38,0)", r"^\s*-[0-9\s]*[1-9][0-9\s]*$", "remove", "integer", high=-1),
        Builtin("nonNegativeInteger", "integer", "decimal(38,0)", r"^\s*(?:\+?[0-9][0-9\s]*|-0[0\s]*)$", "remove", "integer", low=0),
        Builtin("positiveInteger", "nonNegativeInteger", "decimal(38,0)", r"^\s*\+?[0-9\s]*[1-9][0-9\s]*$", "remove", "integer", low=1),
        Builtin("long", "integer", "bigint", integer, "remove", "integer", -(2**63), 2**63 - 1),
        Builtin("int", "long", "int", integer, "remove", "integer", -(2**31), 2**31 - 1),
        Builtin("short", "int", "smallint", integer, "remove", "integer", -(2**15), 2**15 - 1),
        Builtin("byte", "short", "tinyint", integer, "remove", "integer", -128, 127),
        Builtin("unsignedLong", "nonNegativeInteger", "decimal(20,0)", integer, "remove", "integer", 0, 2**64 - 1),
        Builtin("unsignedInt", "unsignedLong", "bigint", integer, "remove", "integer", 0, 2**32 - 1),
        Builtin("unsignedShort", "unsignedInt", "int", integer, "remove", "integer", 0, 65535),
        Builtin("unsignedByte", "unsignedShort", "smallint", integer, "remove", "integer", 0, 255),
        Builtin("decimal", "anyAtomicType", "decimal(38,18)", r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$", "remove", "decimal"),
        *(Builtin(n, "anyAtomicType", s, _FLOAT, "remove", "float") for n, s in (("float", "float"), ("double", "double"), ("precisionDecimal", "double"))),
        Builtin("base64Binary", "anyAtomicType", "binary", r"^\s*(?:(?:[A-Za-z0-9+/]\s*){4})*(?:(?:[A-Za-z0-9+/]\s*){2}=\s*=\s*|(?:[A-Za-z0-9+/]\s*){3}=\s*)?$", "remove", "base64"),
        Builtin("hexBinary", "anyAtomicType", "binary", r"^\s*(?:[0-9a-fA-F]\s*[0-9a-fA-F]\s*)*$", "remove", "hex"),
        Builtin("date", "anyAtomicType", "string", rf"^\s*{_DATE}{_ZONE}\s*$", "collapse", "date"),
        Builtin("time", "anyAtomicType", "string", rf"^\s*{_TIME}{_ZONE}\s*$", "collapse", "time"),
        Builtin("dateTime", "anyAtomicType", "string", rf"^\s*{_DATE}T{_TIME}{_ZONE}\s*$", "collapse", "date"),
        Builtin("dateTimeStamp", "dateTime", "string", rf"^\s*{_DATE}T{_TIME}(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})\s*$", "collapse", "date"),
        Builtin("gDay", "anyAtomicType", "string", rf"^\s*---(?:0[1-9]|[12][0-9]|3[01]){_ZONE}\s*$", "collapse"),
        Builtin("gMonth", "anyAtomicType", "string", rf"^\s*--(?:0[1-9]|1[0-2]){_ZONE}\s*$", "collapse"),
        Builtin("gMonthDay", "anyAtomicType", "string", rf"^\s*--(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]){_ZONE}\s*$", "collapse"),
        Builtin("gYear", "anyAtomicType", "string", rf"^\s*-?[0-9]{{4,}}{_ZONE}\s*$", "collapse"),
        Builtin("gYearMonth", "anyAtomicType", "string", rf"^\s*-?[0-9]{{4,}}-(?:0[1-9]|1[0-2]){_ZONE}\s*$", "collapse"),
        Builtin("duration", "anyAtomicType", "string", rf"^\s*{_DURATION}\s*$", "collapse", "duration"),
        Builtin("dayTimeDuration", "duration", "string", r"^\s*-?P(?:[0-9]+D)?(?:T(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?\s*$", "collapse", "duration"),
        Builtin("yearMonthDuration", "duration", "string", r"^\s*-?P(?:[0-9]+Y)?(?:[0-9]+M)?\s*$", "collapse", "duration"),
        Builtin("string", "anyAtomicType"),
        Builtin("normalizedString", "string", space="replace"),
        Builtin("token", "normalizedString", space="collapse"),
        Builtin("language", "token", check=r"^\s*[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*\s*$", space="collapse"),
        Builtin("Name", "token", space="collapse"),
        Builtin("NCName", "Name", check=_NCNAME, space="collapse"),
        *(Builtin(n, "NCName", check=_NCNAME, space="collapse") for n in ("ID", "IDREF", "ENTITY")),
        *(Builtin(n, "anySimpleType", "array<string>", r"^[^:]*$", "collapse", items=i) for n, i in (("IDREFS", "IDREF"), ("ENTITIES", "ENTITY"))),
        Builtin("NMTOKEN", "token", space="remove"),
        Builtin("NMTOKENS", "anySimpleType", "array<string>", r"\S", "collapse", items="NMTOKEN"),
        *(Builtin(n, "anyAtomicType", space="collapse") for n in ("anyURI", "uriReference")),
        Builtin("QName", "anyAtomicType", space="collapse", kind="qname"),
        Builtin("NOTATION", "anyAtomicType"),
        Builtin("binary", "anyAtomicType"),
        Builtin("timeDuration", "duration", "string", rf"^\s*{_DURATION}\s*$", "collapse", "duration"),
        Builtin("CDATA", "string", space="replace"),
    ]
    return {b.name: b for b in rows}


BUILTINS = _all()
#: Names that only one version of the language has.
ONLY_OLD = frozenset({"uriReference", "binary", "timeDuration", "CDATA"})
NOT_PUBLIC = frozenset({"anyAtomicType", "dateTimeStamp"})
SLOPPY_INTEGERS = frozenset({"integer", "long", "nonPositiveInteger", "negativeInteger", "nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt"})
SLOPPY_FLOATS = frozenset({"decimal", "float", "double", "precisionDecimal"})


def resolve(name: str, *, sloppy_integers: bool = False, sloppy_floats: bool = False, big_numbers: str = "error") -> Builtin:
    """The built-in of a name: on native numbers where the options ask for them, or numbers without bounds as texts."""
    b = BUILTINS[name]
    if big_numbers == "string" and b.kind in ("integer", "decimal") and (b.low is None or b.high is None) and not (sloppy_integers and name in SLOPPY_INTEGERS) and not (sloppy_floats and name in SLOPPY_FLOATS):
        return Builtin(b.name, b.base, "string", b.check, b.space, b.kind, b.low, b.high)
    if sloppy_integers and name in SLOPPY_INTEGERS:
        return Builtin(b.name, b.base, "bigint", b.check, b.space, b.kind, b.low, b.high)
    if sloppy_floats and name in SLOPPY_FLOATS:
        return Builtin(b.name, b.base, "double", _FLOAT, "remove", "float")
    return b


def lineage(name: str) -> list[str]:
    """A built-in's name and those of the types that it derives from."""
    out = []
    at: str | None = name
    while at is not None:
        out.append(at)
        at = BUILTINS[at].base
    return out


@cache
def pattern(check: str) -> re.Pattern:
    return re.compile(check.replace(r"[\p{L}_]", r"[^\W\d]").replace(r"[\p{L}\p{N}_.\-]", r"[\w.\-]"), re.ASCII if r"\p" not in check else 0)


def spaced(text: str, mode: str) -> str:
    if mode == "replace":
        return text.translate({9: " ", 10: " ", 13: " "})
    if mode == "collapse":
        return re.sub(r"[\t\r\n]+", " ", text).strip(" ")
    return re.sub(r"[ \t\r\n]+", "", text) if mode == "remove" else text


def squeezed(text: str) -> str:
    """White space as the collapse facet has it: runs of any blanks become one."""
    return re.sub(r"[ \t\r\n]+", " ", text).strip(" ")


def valid(b: Builtin, text: str) -> bool:
    if b.check and not pattern(b.check).search(text):
        return False
    if b.kind == "integer" and (b.low is not None or b.high is not None):
        x = int(spaced(text, "remove"))
        return (b.low is None or x >= b.low) and (b.high is None or x <= b.high)
    return True


def holds(b: Builtin, x: int) -> bool:
    """Whether a type of integers on native numbers has this one."""
    if b.kind != "integer" or b.spark not in _RANGES:
        return False
    low, high = _RANGES[b.spark]
    return low <= x <= high and (b.low is None or x >= b.low) and (b.high is None or x <= b.high)


def plain_value(b: Builtin, text: str):
    """The value of a number of digits alone, with a point in floats; none for other texts, which take the whole check."""
    if b.kind == "integer":
        if text.isascii() and text.isdigit() and len(text) < 20 and holds(b, x := int(text)):
            return x
    elif b.kind == "float" and text.isascii() and text.replace(".", "", 1).isdigit():
        return float(text)
    return None


def value(b: Builtin, text: str):
    """The value of a checked text; ValueError where the Spark type can't hold it."""
    t = spaced(text, b.space)
    if b.kind == "boolean":
        return t.strip().lower() in ("true", "1")
    if b.kind == "integer":
        if b.spark == "string":
            return t
        x = int(t)
        low, high = _RANGES.get(b.spark, (1 - 10**38, 10**38 - 1))
        if not low <= x <= high:
            raise ValueError(f"{t} doesn't fit {b.spark}")
        return Decimal(x) if b.spark.startswith("decimal") else x
    if b.kind == "decimal":
        if b.spark == "string":
            return t
        whole, _, part = t.lstrip("+-").partition(".")
        if len(whole.lstrip("0")) > 20 or len(part.rstrip("0")) > 18:
            raise ValueError(f"{t} doesn't fit {b.spark}")
        return Decimal(t)
    if b.kind == "float":
        return float({"INF": "inf", "+INF": "inf", "-INF": "-inf"}.get(t, t))
    if b.kind == "base64":
        return base64.b64decode(t)
    if b.kind == "hex":
        return bytes.fromhex(t)
    return t


_RANGES = {"bigint": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "smallint": (-(2**15), 2**15 - 1), "tinyint": (-128, 127)}
#: Types that the writer gives a number of seconds since 1970.
STAMPS = ("dateTime", "dateTimeStamp")
#: Seconds of 400 years, after which the calendar repeats itself: years beyond 9999 are counted from there.
_CYCLE = 146_097 * 86_400


def stamp(seconds: str) -> str:
    """The UTC time of a number of seconds since 1970, with the fraction as it was written."""
    whole, dot, part = seconds.partition(".")
    cycles, rest = divmod(int(whole or 0), _CYCLE)
    at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=rest)
    return f"{at.year + 400 * cycles:04}{at:-%m-%dT%H:%M:%S}" + (f".{part}" if part else "") + "Z"


def text_of(b: Builtin, x) -> str:
    """The lexical form that the writer gives a value; texts pass through and are checked like any other."""
    if b.name in STAMPS and not isinstance(x, bool) and re.fullmatch(r"[0-9]+(?:\.[0-9]*)?", t := format(x, "f") if isinstance(x, Decimal) else str(x)):
        return stamp(t.rstrip("0").rstrip(".") if "." in t else t)
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (bytes, bytearray, memoryview)):
        return bytes(x).hex().upper() if b.kind == "hex" else base64.b64encode(bytes(x)).decode()
    if isinstance(x, float):
        if math.isnan(x):
            return "NaN"
        if math.isinf(x):
            return "INF" if x > 0 else "-INF"
        return repr(x)
    if isinstance(x, Decimal):
        t = format(x, "f")
        return t.rstrip("0").rstrip(".") if "." in t else t
    return str(x)


# --- Catalyst ---------------------------------------------------------------------------------------------------


def spaced_col(text: Column, mode: str) -> Column:
    if mode == "replace":
        return F.translate(text, "\t\r\n", "   ")
    if mode == "collapse":
        return F.trim(F.regexp_replace(text, r"[\t\r\n]+", " "))
    return F.regexp_replace(text, r"[ \t\r\n]+", "") if mode == "remove" else text


def valid_col(b: Builtin, text: Column) -> Column | None:
    """Whether a text is in the lexical space; None where every text is."""
    ok = text.rlike(b.check) if b.check else None
    if b.kind == "integer" and (b.low is not None or b.high is not None):
        x = spaced_col(text, "remove").try_cast("decimal(38,0)")
        inside = [*([x >= F.lit(Decimal(b.low))] if b.low is not None else []), *([x <= F.lit(Decimal(b.high))] if b.high is not None else [])]
        for c in inside:
            ok = ok & F.coalesce(c, F.lit(b.spark == "string") | text.isNull())
    return ok


def checked_col(b: Builtin, text: Column, check: bool) -> tuple[Column, Column | None]:
    """(value, whether it holds): plain numbers are known by a short pattern and cast, others take the whole check.

    A null text has a null value and holds. A text that the Spark type can't hold doesn't, whether or not forms are checked.
    """
    if b.kind not in ("integer", "decimal", "float") or b.spark == "string":
        ok = valid_col(b, text) if check else None
        if ok is None:
            return value_col(b, text), None
        return F.when(ok, value_col(b, text)), ok
    # Forms that casts read as the language means them.
    plain = {"integer": r"^[+-]?[0-9]+$", "decimal": r"^[+-]?[0-9]{1,20}(?:\.[0-9]{0,18})?$", "float": r"^[+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?$"}[b.kind]
    value = F.when(text.rlike(plain), text.try_cast(b.spark))
    inside = [*([value >= F.lit(Decimal(b.low))] if b.low is not None and not _held(b, b.low) else []), *([value <= F.lit(Decimal(b.high))] if b.high is not None and not _held(b, b.high) else [])]
    for c in inside:
        value = F.when(c, value)
    other = value_col(b, text)
    if b.kind == "decimal":
        t = spaced_col(text, b.space)
        other = F.when(~t.rlike(r"^[+-]?0*[0-9]{21}") & ~t.rlike(r"\.[0-9]{18}[0-9]*[1-9]"), other)
    if check:
        other = F.when(valid_col(b, text), other)
    value = F.coalesce(value, other)
    return value, value.isNotNull() | text.isNull()


def _held(b: Builtin, bound: int) -> bool:
    """Whether a bound is that of the Spark type itself."""
    return bound in _RANGES.get(b.spark, ())


def value_col(b: Builtin, text: Column) -> Column:
    t = spaced_col(text, b.space)
    if b.spark == "string" and b.kind in ("integer", "decimal"):
        return t
    if b.kind == "boolean":
        return F.lower(F.trim(F.translate(t, "\t\n\x0b\f\r", "     "))).isin("true", "1")
    if b.kind in ("integer", "decimal"):
        return t.try_cast(b.spark)
    if b.kind == "float":
        return F.regexp_replace(t, "INF", "Infinity").try_cast(b.spark)
    if b.kind == "base64":
        return F.try_to_binary(t, F.lit("base64"))
    if b.kind == "hex":
        return F.unhex(t)
    return t


def text_col(b: Builtin, x: Column) -> Column:
    if b.kind == "boolean":
        return F.when(x.cast("boolean"), "true").when(~x.cast("boolean"), "false")
    if b.kind == "float":
        return F.regexp_replace(x.cast("string"), "Infinity", "INF")
    if b.kind == "decimal":
        t = x.cast("string")
        return F.when(t.contains(".") & ~t.contains("E"), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    if b.kind == "base64":
        return F.regexp_replace(F.base64(x.cast("binary")), r"[\r\n]", "")
    if b.kind == "hex":
        return F.hex(x.cast("binary"))
    if b.name in STAMPS:
        t = x.cast("string")
        whole, part = F.regexp_extract(t, r"^([0-9]+)", 1), F.regexp_extract(t, r"\.([0-9]*?)0*$", 1)
        seconds = whole.try_cast("bigint")
        rest = seconds % _CYCLE
        cycles = F.round((seconds - rest) / _CYCLE)
        at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(((rest - rest % 86400) / 86400).cast("int"), F.lit(0), F.lit(0), (rest % 86400).cast("decimal(18,6)"))
        year = F.year(at) + 400 * cycles.cast("bigint")
        made = F.concat(year.cast("string"), F.date_format(at, "-MM-dd'T'HH:mm:ss"), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))
        return F.when(t.rlike(r"^[0-9]+(?:\.[0-9]*)?$") & seconds.isNotNull(), made).otherwise(t)  # more digits than that are refused as no date
    return x.cast("string")


def _parts(text: Column) -> tuple[Column, Column, Column]:
    """(negative, whole digits without leading zeros, fraction digits without closing zeros) of a number's text."""
    whole = F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1)
    part = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)$", 1), "0+$", "")
    return text.startswith("-") & ((whole != "") | (part != "")), whole, part


def compare_col(text: Column, bound: str) -> Column:
    """-1, 0 or 1 as a number's text is less than, equal to or greater than the bound, for numbers of any length."""
    negative, whole, part = _parts(text)
    b = Decimal(bound)
    low = b.is_signed() and b != 0
    b_whole, _, b_part = format(b.copy_abs(), "f").partition(".")
    b_whole, b_part = b_whole.lstrip("0"), b_part.rstrip("0")
    size = F.length(whole)
    more = (size > len(b_whole)) | (size == len(b_whole)) & ((whole > b_whole) | (whole == b_whole) & (part > b_part))
    same = (whole == b_whole) & (part == b_part)
    apart = F.when(same, 0).when(more, -1 if low else 1).otherwise(1 if low else -1)
    return F.when(negative, apart if low else F.lit(-1)).otherwise(F.lit(1) if low else apart)
