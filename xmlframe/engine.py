"""The user's side: a schema catalog that compiles readers, writers and templates.

    schema = XmlSchema("orders.xsd")
    reader = schema.reader("{urn:shop}order")
    rows = reader.frame(messages, "xml")            # typed columns; the first violation raises
    out = rows.select(schema.writer("{urn:shop}order").column(F.struct("*")).alias("xml"))

Both compile to Catalyst expressions where names alone decide, and to Arrow-batched Python where the order of elements,
wildcards, type switches, recursion or Python code matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields as fields_of
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from xmlframe.operators.reader_fast import FastReader, NotPlain, decoded
from xmlframe.operators.reader_native import ERROR, NativeReader, simple
from xmlframe.operators.reader_python import Reader
from xmlframe.operators.template import Template
from xmlframe.operators.values import DataError
from xmlframe.operators.writer_native import NativeWriter, NotNative
from xmlframe.operators.writer_python import Writer
from xmlframe.plans.catalog import Catalog
from xmlframe.plans.compiler import Compiler
from xmlframe.plans.model import Complex, Element, Hook, Options, Simple
from xmlframe.plans.shape import META, Shape, needs_order, uses_qname
from xmlframe.sources.xml import XmlError
from xmlframe.workers import fresh, ship

_KNOWN = {f.name for f in fields_of(Options)}
#: Back-ends by name; ``register`` adds further ones.
BACKENDS: dict[str, Callable] = {}


def register(name: str, backend: Callable) -> None:
    """Plug in a back-end: called with (compiled element, options) by ``XmlSchema.compile``."""
    BACKENDS[name] = backend


def _plain(kind: S.DataType) -> Callable:
    """What brings Python data into the form that Arrow takes for a Spark type; the type is looked at once, not for each value."""
    if isinstance(kind, S.StructType):
        fields = [(f.name, _plain(f.dataType)) for f in kind.fields]

        def struct(value):
            if value is None:
                return None
            data = value if isinstance(value, dict) else {"_": value}
            return {name: own(data.get(name)) for name, own in fields}

        return struct
    if isinstance(kind, S.ArrayType):
        item = _plain(kind.elementType)
        return lambda value: None if value is None else [item(x) for x in (value if isinstance(value, (list, tuple)) else [value])]
    if isinstance(kind, S.MapType):
        item = _plain(kind.valueType)
        return lambda value: None if value is None else [(k, item(v)) for k, v in dict(value).items()]
    if isinstance(kind, S.StringType):
        return lambda value: value if value is None or isinstance(value, str) else str(value)
    return lambda value: value


class CompiledReader:
    """Reads messages of one element. ``native`` tells whether it is a Catalyst expression, ``why`` why it is not."""

    def __init__(self, root: Element, options: Options, extends: dict[str, list[str]], shape: S.DataType | None = None) -> None:
        self.element, self.options, self.extends = root, options, extends
        self.python = Reader(root, options, extends)
        self.why = self._why(options)
        #: Plain messages are in order: only the others need a walk in document order.
        self.mostly_native = self.why is not None and options.order_check == "python" and self._why(replace(options, order_check=True)) is None
        metas = self._metas() if isinstance(root, Element) else {}
        self.shape = shape or (Shape(options, metas).root(root) if isinstance(root, Element) else Shape(options).type(root.type))

    native = property(lambda self: self.why is None)

    def _why(self, o: Options) -> str | None:
        e = self.element
        if not isinstance(e, Element):
            return "attribute"
        if o.hooks or o.typemap or o.permit_href or o.any_type:
            return "Python code"
        if e.members or e.xsi or e.blocked or e.abstract or e.nillable:
            return "element switch"
        if isinstance(e.type, Complex):
            return needs_order(e.type, o)
        return "QName" if uses_qname(e.type) else None

    def _metas(self) -> dict[int, list[str]]:
        """Fields that the predefined hooks add, by element; they are matched on the compiled tree."""
        from xmlframe.operators.reader_python import hook_meets

        wanted = [h for h in self.options.hooks if h.action in (None, "READER") and any(isinstance(f, str) and f in META for f in h.after)]
        out: dict[int, list[str]] = {}

        def visit(e: Element, path: str, seen: tuple) -> None:
            for h in wanted:
                if hook_meets(h, e, path, self.extends):
                    out.setdefault(id(e), []).extend(f for f in h.after if f in META and f not in out.get(id(e), ()))
            if isinstance(e.type, Complex) and not any(e.type is s for s in seen) and e.type.content is not None:
                walk(e.type.content, path, (*seen, e.type))

        def walk(p, path: str, seen: tuple) -> None:
            if isinstance(p.term, Element):
                for e in p.term.members or [p.term]:
                    visit(e, f"{path}/{e.local}", seen)
            elif hasattr(p.term, "particles"):
                for x in p.term.particles:
                    walk(x, path, seen)

        visit(self.element, self.element.path, ())
        return out

    def read(self, source):
        """The data of one message on the driver."""
        return self.python.read(source)

    def column(self, xml: Column) -> Column:
        """A struct (data, errors) for a message column; a null message has neither."""
        if self.native:
            return NativeReader(self.element, self.options).column(xml)
        kind = S.StructType([S.StructField("data", self.shape), S.StructField("errors", S.ArrayType(ERROR))])
        read, shape, arrow = self.python.read, self.shape, to_arrow_type(kind)

        def taken(item: dict) -> dict:
            """An item that Arrow takes: a value that the Spark type can't hold becomes a violation."""
            try:
                pa.array([item], arrow)
            except (pa.ArrowException, ArithmeticError, OverflowError, TypeError, ValueError) as e:
                return {"data": None, "errors": [{"code": "value", "path": root, "message": f"illegal value at {root}: {e}"}]}
            return item

        root = self.element.path if isinstance(self.element, Element) else self.element.local

        @F.arrow_udf(kind)
        def run(messages: pa.Array) -> pa.Array:
            out, plain = [], _plain(shape)
            for m in messages:
                data, errors = None, []
                if m.is_valid:
                    try:
                        data = plain(read(m.as_py()))
                    except DataError as e:
                        errors.append({"code": e.code, "path": e.path, "message": str(e)})
                    except XmlError as e:
                        errors.append({"code": "xml", "path": "", "message": str(e)})
                out.append({"data": data, "errors": errors})
            try:
                return pa.array(out, arrow)
            except (pa.ArrowException, ArithmeticError, OverflowError, TypeError, ValueError):
                return pa.array([taken(x) for x in out], arrow)

        return run(xml)

    def frame(self, df: DataFrame, xml: str = "xml", mode: str = "FAILFAST", keep: tuple[str, ...] = ()) -> DataFrame:
        """The messages of ``df`` as typed columns (a scalar message as column ``value``), after the columns to ``keep``.

        FAILFAST raises the first violation, PERMISSIVE gives null data and adds ``errors``, DROPMALFORMED leaves violators out.
        """
        ship(df.sparkSession)
        read, data_col = fresh(df, "_read", "_data")
        own = self._native_frame(df, xml, read) if self.native or self.mostly_native else df.withColumn(read, self.column(F.col(xml)))
        # Filters on what is read stop at a generator of one row, else Catalyst would read messages a second time below them; others pass.
        own = own.select(*keep, F.explode(F.array(read)).alias(read))
        if mode == "DROPMALFORMED":
            own = own.where(F.size(F.col(read)["errors"]) == 0)
        data = F.col(read)["data"]
        if mode == "FAILFAST":
            failed = F.raise_error(F.get(F.col(read)["errors"], F.lit(0))["message"]).cast(self.shape)
            own = own.withColumn(data_col, F.when(F.size(F.col(read)["errors"]) > 0, failed).otherwise(data))
            data = F.col(data_col)
        if isinstance(self.shape, S.StructType):
            cols = [data[f.name].alias(f.name) for f in self.shape.fields]
        else:
            cols = [data.alias("value")]
        errors = [F.col(read)["errors"].alias("errors")] if mode == "PERMISSIVE" else []
        return own.select(*keep, *cols, *errors)

    def json(self, df: DataFrame, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
        """Each message as one line of JSON, in column ``json`` behind the columns to ``keep``: ready for ``write.text``."""
        out = self.frame(df, xml, keep=keep)
        data = F.struct(*(c for c in out.columns if c not in keep)) if isinstance(self.shape, S.StructType) else F.struct("value")
        return out.select(*keep, F.to_json(data).alias("json"))

    def _native_frame(self, df: DataFrame, xml: str, out: str) -> DataFrame:
        """Column ``out``, a struct (data, errors). Steps are projections of their own, so each is computed once and compiled."""
        native = NativeReader(self.element, self.options)
        whole, skeleton, plain, pairs, odd, value, wrong, slow = fresh(df, "_whole", "_skeleton", "_plain", "_pairs", "_odd", "_value", "_wrong", "_slow")
        message = F.col(xml)
        try:
            fast = FastReader(self.element, self.options)
            is_plain = fast.plain(F.col(whole), F.col(skeleton))
        except NotPlain:
            if self.mostly_native:
                return df.withColumn(out, self.column(message))
            return native.staged(df, message, out)
        own = df.withColumn(whole, fast.whole(message)).withColumn(skeleton, fast.skeleton(F.col(whole))).withColumn(plain, is_plain)
        own = own.withColumn(whole, F.when(F.col(plain), fast.bare(F.col(whole))))
        found = fast.repeats(F.col(whole))
        if found:
            own = own.withColumn(pairs, F.when(F.col(plain), F.struct(*(c.alias(f"p{i}") for i, c in enumerate(found.values())))))
        bound = {k: F.col(pairs)[f"p{i}"] for i, k in enumerate(found)}
        leaves = fast.leaves(F.col(whole))
        names = fresh(own, *(f"_t{i}" for i in range(len(leaves))))
        own = own.withColumns({n: F.when(F.col(plain), text) for n, (_, _, text, _) in zip(names, leaves)})
        own = own.withColumns({n: decoded(F.col(n)) for n in names})
        values = fresh(own, *(f"_v{i}" for i in range(len(leaves))))
        own = own.withColumns({v: simple(t, F.col(n), path, self.options)[0] for n, v, (_, t, _, path) in zip(names, values, leaves)})
        fast.texts_of = {k: F.col(n) for n, (k, *_) in zip(names, leaves)}
        fast.values_of = {k: F.col(v) for v, (k, *_) in zip(values, leaves)}
        data, errors = fast.values(F.col(whole), bound)
        own = own.withColumn(value, data).withColumn(wrong, F.when(F.col(plain), errors))
        rest = F.when(~F.col(plain), message)
        if self.mostly_native:
            own = own.withColumn(slow, self.column(rest))
        else:
            own = native.staged(own.withColumn(odd, rest), F.col(odd), slow)
        read = F.struct(F.when(F.size(wrong) == 0, F.col(value)).cast(self.shape).alias("data"), F.col(wrong).alias("errors"))
        return own.withColumn(out, F.when(F.col(plain), read).otherwise(F.col(slow)))


class CompiledWriter:
    """Writes messages of one element, by Catalyst where it can."""

    def __init__(self, root: Element, options: Options, extends: dict[str, list[str]]) -> None:
        self.element, self.options = root, options
        self.python = Writer(root, options, extends)
        self.why: str | None = None
        if not isinstance(root, Element):
            self.why = "attribute"

    def write(self, data) -> str:
        return self.python.write(data)

    def column(self, data: Column, python: bool = False) -> Column:
        """The text of a message for a struct (or scalar) column. With ``python`` values are checked against all facets."""
        if not python and self.why is None:
            try:
                return NativeWriter(self.element, self.options).column(data)
            except NotNative as e:
                self.why = str(e)
        write = self.python.write

        @F.arrow_udf("string")
        def run(rows: pa.Array) -> pa.Array:
            return pa.array([None if x is None else write(_sparse(x)) for x in rows.to_pylist()], pa.string())

        return run(data)


def _sparse(value):
    """Row data without the nulls that stand for absent keys."""
    if isinstance(value, dict):
        return {k: _sparse(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_sparse(v) for v in value]
    return value


class XmlSchema(Catalog):
    """A catalog that compiles."""

    def __init__(self, sources=(), *, hooks: list[Hook] | None = None, typemap: dict | None = None, key_rewrite: list | None = None, block_namespace: list | None = None, ignore_unused_tags: bool | str = False, **options) -> None:
        super().__init__(sources, **options)
        self.hooks, self.typemaps = list(hooks or []), dict(typemap or {})
        self.key_rewrites, self.blocks, self.ignore_unused_tags = list(key_rewrite or []), list(block_namespace or []), ignore_unused_tags

    def add_hook(self, *hooks: Hook) -> None:
        self.hooks += hooks

    def add_typemap(self, **typemap) -> None:
        self.typemaps |= typemap

    def add_key_rewrite(self, *rules) -> list:
        self.key_rewrites = [*rules, *self.key_rewrites]
        return self.key_rewrites

    def block(self, *rules) -> None:
        self.blocks += rules

    def _options(self, given: dict) -> Options:
        if unknown := set(given) - _KNOWN:
            raise TypeError(f"unknown compile option {', '.join(sorted(unknown))}")
        given = {"ignore_unused_tags": self.ignore_unused_tags} | given
        given["hooks"] = [*self.hooks, *given.get("hooks", ())]
        given["typemap"] = self.typemaps | given.get("typemap", {})
        given["key_rewrite"] = [*given.get("key_rewrite", ()), *self.key_rewrites]
        given["block_namespace"] = [*self.blocks, *given.get("block_namespace", ())]
        for name in given["typemap"]:
            if self.find_type(name) is None:
                raise ValueError(f"typemap for unknown type {name}")
        return Options(**given)

    def _extends(self, options: Options) -> dict[str, list[str]]:
        wanted = {h.extends for h in options.hooks if h.extends}
        return {t: [b for b in wanted if self.does_extend(t, b)] for t in self.types()} if wanted else {}

    def _root(self, name: str, options: Options):
        compiler = Compiler(self, options)
        if self.find("element", name) is None and self.find("attribute", name) is not None:
            return compiler.attribute(name)
        out = compiler.element(name)
        if options.path is not None:
            out.path = options.path
        return out

    def reader(self, name: str, **options) -> CompiledReader:
        o = self._options(options)
        return CompiledReader(self._root(name, o), o, self._extends(o))

    def writer(self, name: str, **options) -> CompiledWriter:
        o = self._options(options)
        return CompiledWriter(self._root(name, o), o, self._extends(o))

    def type_reader(self, element: str, type_name: str, **options) -> CompiledReader:
        o = self._options(options)
        return CompiledReader(Compiler(self, o).typed_element(element, type_name), o, self._extends(o))

    def type_writer(self, element: str, type_name: str, **options) -> CompiledWriter:
        o = self._options(options)
        return CompiledWriter(Compiler(self, o).typed_element(element, type_name), o, self._extends(o))

    def template(self, output: str, name: str, *, comments: str = "ALL", indent: str = "  ", **options):
        """An example of the element: ``DATA`` (a commented Python literal), ``XML`` or ``TREE`` (nested dictionaries)."""
        o = self._options(options)
        return Template(self._root(name, o), o, comments, indent, self._extends(o)).render(output)

    def compile(self, action: str, name: str, **options):
        """READER, WRITER or a registered back-end."""
        if action in ("READER", "WRITER"):
            return (self.reader if action == "READER" else self.writer)(name, **options)
        if action not in BACKENDS:
            raise ValueError(f"back-end `{action}' not defined")
        o = self._options(options)
        return BACKENDS[action](self._root(name, o), o)

    def struct(self, name: str, **options) -> S.DataType:
        """The Spark type of an element."""
        return self.reader(name, **options).shape


__all__ = ["CompiledReader", "CompiledWriter", "Hook", "Simple", "XmlSchema", "register"]
