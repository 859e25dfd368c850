"""A document node as columns: one interface over VARIANT and over typed columns.

An absent node is SQL NULL. A VARIANT node tells JSON null from absent; a typed cell that is NULL counts as absent
(`null_as="missing"`) or as null (`null_as="null"`).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once; leaves whole-stage code, so only for values used often."""
    return F.transform(F.array(value), body)[0]


def js_number(x: Column) -> Column:
    """A double as ECMAScript prints it: 1, 0.5, 1e+21, 1.5e-7."""
    size = F.abs(x)
    whole = F.when(size < 1e15, x.cast("bigint").cast("string")).otherwise(F.expr("cast(null as string)"))
    whole = F.coalesce(whole, F.format_string("%.0f", x))
    trim = lambda s: F.regexp_replace(s, r"\.?0+$", "")
    text = x.cast("string")
    plain = F.when(size < 1, trim(text.try_cast("decimal(38,30)").cast("string"))).otherwise(trim(text.try_cast("decimal(38,20)").cast("string")))
    short = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E(?=[0-9])", "e+")
    short = F.regexp_replace(short, "E-", "e-")
    return (
        F.when(F.isnan(x), "NaN")
        .when(size == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity"))
        .when((x % 1 == 0) & (size < 1e21), whole)
        .when((size >= 1e21) | (size < 1e-6), short)
        .otherwise(plain)
    )


class Value:
    """A node; subclasses say how its type and children are read."""

    #: Column that is true where the node is absent.
    absent: Column

    def bad_type(self, name: str) -> Column:
        """True where the node is not of the named type (also where it is absent)."""
        return ~F.coalesce(self.is_type(name), F.lit(False))

    def is_type(self, name: str) -> Column:
        raise NotImplementedError

    def canonical(self) -> Column:
        """The text by which enum and uniqueItems compare: strings as they are, numbers as printed, else JSON."""
        s, b = self.text(), self.is_type("boolean")
        number = js_number(self.number())
        return F.when(self.absent, "undefined").when(self.is_type("string"), s).when(self.is_type("number"), number).when(b, self.json()).otherwise(self.json())

    def tagged(self) -> Column:
        """Like canonical, but values of different types never compare equal."""
        kind = F.when(self.is_type("string"), "s").when(self.is_type("number"), "n").otherwise("j")
        return F.concat(kind, self.canonical())


class VariantValue(Value):
    def __init__(self, base: Column, path: str = "$"):
        self.base, self.path = base, path
        self.column = base if path == "$" else F.try_variant_get(base, path, "variant")
        self.absent = self.column.isNull()

    def _get(self, kind: str) -> Column:
        return F.try_variant_get(self.base, self.path, kind)

    @property
    def _kind(self) -> Column:
        return F.schema_of_variant(self.column)

    def is_type(self, name: str) -> Column:
        kind = self._kind
        if name == "string":
            return kind == "STRING"
        if name == "number":
            return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if name == "integer":
            return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (self.number() % 1 == 0)
        if name == "boolean":
            return kind == "BOOLEAN"
        if name == "null":
            return F.is_variant_null(self.column)
        if name == "array":
            return self.items().isNotNull()
        if name == "object":
            return self.members().isNotNull()
        return F.lit(True)

    def number(self) -> Column:
        return self._get("double")

    def text(self) -> Column:
        return self._get("string")

    def items(self) -> Column:
        return self._get("array<variant>")

    def members(self) -> Column:
        return self._get("map<string,variant>")

    def n_items(self) -> Column:
        return F.size(self.items())

    def n_members(self) -> Column:
        return F.cardinality(self.members())

    def has(self, key: str) -> Column:
        return F.map_contains_key(self.members(), key) if not _plain(key) else self.child(key).column.isNotNull()

    def child(self, key: str) -> Value:
        if not _plain(key):
            return VariantValue(F.try_element_at(self.members(), F.lit(key)))
        return VariantValue(self.base, f'{self.path}["{key}"]')

    def item(self, k: int) -> Value:
        return VariantValue(self.base, f"{self.path}[{k}]")

    def each_item(self, first: int, fn: Callable[[Value, Column], Column], how: str) -> Column:
        """exists or transform over the elements from `first` on; fn gets the element and its index as text."""
        own = self.items()
        part = F.slice(own, first + 1, F.greatest(F.size(own) - first, F.lit(0))) if first else own
        if how == "exists":
            return F.coalesce(F.exists(part, lambda x: fn(VariantValue(x), F.lit(""))), F.lit(False))
        return F.transform(part, lambda x, i: fn(VariantValue(x), (i + first).cast("string")))

    def each_member(self, fn: Callable[[Value, Column], Column], how: str) -> Column:
        own = F.map_entries(self.members())
        if how == "exists":
            return F.coalesce(F.exists(own, lambda e: fn(VariantValue(e["value"]), e["key"])), F.lit(False))
        return F.transform(own, lambda e: fn(VariantValue(e["value"]), e["key"]))

    def json(self) -> Column:
        return F.to_json(self.column)


def _plain(key: str) -> bool:
    return bool(key) and not any(c in key for c in "\"'\\[]\n")


class TypedValue(Value):
    """A cell of a typed column: its type rules fold to constants and its comparisons stay plain ones."""

    def __init__(self, column: Column | None, kind: T.DataType | None, null_as: str = "missing"):
        self.column, self.kind, self.null_as = column, kind, null_as
        self.absent = F.lit(True) if column is None else column.isNull() if null_as == "missing" else F.lit(False)

    def _family(self) -> str | None:
        k = self.kind
        if k is None:
            return None
        if isinstance(k, T.BooleanType):
            return "boolean"
        if isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer"
        if isinstance(k, T.NumericType):
            return "number"
        if isinstance(k, T.ArrayType):
            return "array"
        if isinstance(k, (T.StructType, T.MapType)):
            return "object"
        return "string"

    def is_type(self, name: str) -> Column:
        own = self._family()
        if own is None:
            return F.lit(False)
        there = self.column.isNotNull()
        if name == "null":
            return ~there if self.null_as == "null" else F.lit(False)
        if name == own or (name == "number" and own == "integer"):
            return there
        if name == "integer" and own == "number":
            return there & (self.number() % 1 == 0)
        return F.lit(False)

    def number(self) -> Column:
        return self.column.cast("double") if self._family() in ("integer", "number") else F.lit(None).cast("double")

    def text(self) -> Column:
        return self.column.cast("string") if self._family() == "string" else F.lit(None).cast("string")

    def n_items(self) -> Column:
        return F.size(self.column) if self._family() == "array" else F.lit(None).cast("int")

    def n_members(self) -> Column:
        if isinstance(self.kind, T.MapType):
            return F.cardinality(self.column)
        if isinstance(self.kind, T.StructType):
            n = sum((F.when(self.column[f.name].isNotNull() | F.lit(self.null_as == "null"), 1).otherwise(0) for f in self.kind.fields), F.lit(0))
            return F.when(self.column.isNotNull(), n)
        return F.lit(None).cast("int")

    def has(self, key: str) -> Column:
        own = self.child(key)
        if own.column is None:
            return F.lit(False)
        return self.column.isNotNull() & ~own.absent

    def child(self, key: str) -> Value:
        if isinstance(self.kind, T.StructType) and key in self.kind.names:
            return TypedValue(self.column[key], self.kind[key].dataType, self.null_as)
        if isinstance(self.kind, T.MapType):
            return TypedValue(F.try_element_at(self.column, F.lit(key)), self.kind.valueType, self.null_as)
        return TypedValue(None, None, self.null_as)

    def item(self, k: int) -> Value:
        if isinstance(self.kind, T.ArrayType):
            return TypedValue(F.get(self.column, F.lit(k)), self.kind.elementType, self.null_as)
        return TypedValue(None, None, self.null_as)

    def each_item(self, first: int, fn, how: str) -> Column | None:
        if not isinstance(self.kind, T.ArrayType):
            return None
        part = F.slice(self.column, first + 1, F.greatest(F.size(self.column) - first, F.lit(0))) if first else self.column
        make = lambda x: TypedValue(x, self.kind.elementType, "null")  # noqa: E731  an element is there even if NULL
        if how == "exists":
            return F.coalesce(F.exists(part, lambda x: fn(make(x), F.lit(""))), F.lit(False))
        return F.transform(part, lambda x, i: fn(make(x), (i + first).cast("string")))

    def each_member(self, fn, how: str) -> Column | None:
        if isinstance(self.kind, T.StructType):
            some = [(f, TypedValue(self.column[f.name], f.dataType, self.null_as)) for f in self.kind.fields]
            if how == "exists":
                return any_of([~v.absent & self.column.isNotNull() & fn(v, F.lit(f.name)) for f, v in some])
            return F.array(*[F.when(~v.absent & self.column.isNotNull(), fn(v, F.lit(f.name))) for f, v in some])
        if isinstance(self.kind, T.MapType):
            own = F.map_entries(self.column)
            make = lambda e: TypedValue(e["value"], self.kind.valueType, self.null_as)
            if how == "exists":
                return F.coalesce(F.exists(own, lambda e: fn(make(e), e["key"])), F.lit(False))
            return F.transform(own, lambda e: fn(make(e), e["key"]))
        return None

    def json(self) -> Column:
        if self.column is None:
            return F.lit(None).cast("string")
        boxed = F.to_json(F.array(self.column))
        return F.when(self.column.isNotNull(), F.substring(boxed, F.lit(2), F.length(boxed) - 2)).when(F.lit(self.null_as == "null"), "null")


def value_of(df: DataFrame, column: str | None, null_as: str = "missing") -> Value:
    """The documents of a column (VARIANT, or typed), or with None each row's typed columns as one document."""
    if column is None:
        return RowValue(df.schema, null_as)
    kind = df.schema[column].dataType
    if isinstance(kind, T.VariantType):
        return VariantValue(F.col(f"`{column}`"))
    return TypedValue(F.col(f"`{column}`"), kind, null_as)


class RowValue(TypedValue):
    """A whole row as an object; children are the row's columns themselves, so that filters can reach the scan."""

    def __init__(self, schema: T.StructType, null_as: str):
        super().__init__(F.lit(True), schema, null_as)

    def child(self, key: str) -> Value:
        return TypedValue(F.col(f"`{key}`"), self.kind[key].dataType, self.null_as) if key in self.kind.names else TypedValue(None, None, self.null_as)

    def n_members(self) -> Column:
        return sum((F.when(self.has(f.name), 1).otherwise(0) for f in self.kind.fields), F.lit(0))

    def each_member(self, fn, how: str) -> Column:
        some = [(f.name, self.child(f.name)) for f in self.kind.fields]
        if how == "exists":
            return any_of([~v.absent & fn(v, F.lit(n)) for n, v in some])
        return F.array(*[F.when(~v.absent, fn(v, F.lit(n))) for n, v in some])

    def json(self) -> Column:
        return F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in self.kind.fields]))


def js_key(value) -> str:
    """A literal of the schema as canonical() prints it; containers as sorted compact JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return js_number_text(float(value))
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def js_number_text(x: float) -> str:
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" in text:
        mantissa, power = text.split("e")
        if abs(x) >= 1e21 or abs(x) < 1e-6:
            return f"{mantissa.removesuffix('.0')}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"
        return f"{x:.30f}".rstrip("0") if abs(x) >= 1 else f"{x:.{-int(power) + len(mantissa.replace('-', '').replace('.', '')) - 1}f}"
    return text
