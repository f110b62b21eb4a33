"""Packed names: ``{namespace}local`` for elements and types, ``namespace#id`` for ids. Python and Column forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_type(ns: str | None, local: str) -> str:
    return f"{{{ns}}}{local}" if ns else local


def unpack_type(name: str) -> tuple[str, str]:
    if name.startswith("{"):
        ns, _, local = name[1:].partition("}")
        return ns, local
    return "", name


def pack_id(ns: str, own: str) -> str:
    return f"{ns}#{own}"


def unpack_id(name: str) -> tuple[str, str]:
    ns, _, own = name.partition("#")
    return ns, own


def odd_elements(items: Sequence) -> list:
    return list(items[1::2])


def even_elements(items: Sequence) -> list:
    return list(items[::2])


def pack_type_col(ns: Column, local: Column) -> Column:
    return F.when(F.coalesce(ns, F.lit("")) == "", local).otherwise(F.concat(F.lit("{"), ns, F.lit("}"), local))


def unpack_type_cols(name: Column) -> tuple[Column, Column]:
    plain = ~name.startswith("{")
    return (
        F.when(plain, F.lit("")).otherwise(F.regexp_extract(name, r"^\{([^}]*)\}", 1)),
        F.when(plain, name).otherwise(F.regexp_extract(name, r"^\{[^}]*\}(.*)$", 1)),
    )


def pack_id_col(ns: Column, own: Column) -> Column:
    return F.concat(ns, F.lit("#"), own)


def unpack_id_cols(name: Column) -> tuple[Column, Column]:
    at = F.instr(name, "#")
    return F.when(at > 0, F.substring_index(name, "#", 1)).otherwise(name), F.when(at > 0, name.substr(at + 1, F.length(name))).otherwise(F.lit(""))


def odd_elements_col(items: Column) -> Column:
    return F.filter(items, lambda _, i: i % 2 == 1)


def even_elements_col(items: Column) -> Column:
    return F.filter(items, lambda _, i: i % 2 == 0)
