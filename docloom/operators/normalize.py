"""The normaliser: defaults, type coercion and dropping of unlisted properties, as one VARIANT expression.

Nothing is mutated: each node is coerced first, then its children are rebuilt from the coerced value, inside out.
Combinators are not followed. A tuple may be extended by a default; a value in place of an object with declared
properties stays as it is. Junk numbers become null, as JSON has no NaN. Documents that go deeper than `max_depth` levels
of a recursive reference are normalised by the walk over single values, in Arrow batches; no other row goes there.

A `Rewriter` does the same with a user's handlers: it is the walk whose handlers replace and remove values.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.regexes import to_java
from docloom.functions.values import VariantValue, any_of, js_number, let
from docloom.operators.validate import deep_content, recurses
from docloom.operators.walk import Output
from docloom.plans.nodes import Options, Place, TooDeep, children, follow, too_deep
from docloom.plans.selectors import is_selector, parse

_INTEGER = r"^\s*([+-]?[0-9]+)"
_FLOAT = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_MEMBERS = "map<string,variant>"


def constant(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def to_text(v: VariantValue) -> Column:
    """A present value as ECMAScript's toString gives it; arrays of containers as their JSON."""
    scalar = lambda x: F.when(x.is_type("string"), x.text()).when(x.is_type("number"), js_number(x.number())).when(x.is_type("null"), "").otherwise(x.json())
    items = F.array_join(F.transform(v.items(), lambda x: F.coalesce(scalar(VariantValue(x)), F.lit(""))), ",")
    return F.when(v.is_type("array"), items).when(v.is_type("object"), "[object Object]").otherwise(scalar(v))


def number_variant(x: Column) -> Column:
    """A double as VARIANT, integral ones without a fraction; null where there is none."""
    whole = (x % 1 == 0) & (F.abs(x) < 9.0e18)
    return F.when(x.isNull(), constant(None)).when(whole, x.cast("bigint").cast("variant")).otherwise(x.cast("variant"))


def coerce(kind, v: VariantValue) -> Column:
    column = v.column
    if kind == "null":
        return constant(None)
    if kind == "string":
        return F.when(v.is_type("string"), column).otherwise(to_text(v).cast("variant"))
    if kind == "integer":
        return F.when(v.is_type("integer") & (F.abs(v.number()) < 1e21), number_variant(v.number())).otherwise(number_variant(F.nullif(F.regexp_extract(to_text(v), _INTEGER, 1), F.lit("")).try_cast("double")))
    if kind == "number":
        return F.when(v.is_type("number"), column).otherwise(number_variant(F.nullif(F.regexp_extract(to_text(v), _FLOAT, 1), F.lit("")).try_cast("double")))
    if kind == "boolean":
        text = F.lower(to_text(v))
        truth = F.when(text.isin("true", "on"), True).when(text.isin("false", "off"), False)
        truthy = F.when(v.is_type("string"), v.text() != "").when(v.is_type("number"), v.number() != 0).otherwise(True)
        return F.when(v.is_type("boolean"), column).otherwise(F.coalesce(truth, truthy).cast("variant"))
    if kind == "array":
        return F.when(v.is_type("array"), column).otherwise(F.array(column).cast("variant"))
    return column


@dataclass
class Normalizer:
    schema: dict
    options: Options = field(default_factory=Options)

    def column(self, v: Column) -> Column:
        """The normalised VARIANT of a VARIANT column; absent stays absent unless there is a default."""
        made = self._node(self.schema, v, Place.start(self.schema))
        if not recurses(self.schema, self.options):
            return made
        from docloom.operators.runtime import deep_normalizer

        deep = F.coalesce(deep_content(self.schema, self.options, VariantValue(v)), F.lit(False))
        return F.when(deep, F.parse_json(deep_normalizer(self.schema, self.options)(F.when(deep, F.to_json(v))))).otherwise(made)

    def normalize(self, df: DataFrame, column: str, into: str | None = None) -> DataFrame:
        return df.withColumn(into or column, self.column(F.col(f"`{column}`")))

    def _too_deep(self, v: Column) -> Column:
        return v  # such a document takes another way

    def _node(self, schema: dict, v: Column, place: Place, attr: str | None = None) -> Column:
        try:
            schema, place = follow(schema, place, self.options)
        except TooDeep:
            return self._too_deep(v)
        if place.again:
            inner = Place(place.document, place.entered, place.is_root)
            return F.when(v.isNull(), v).otherwise(self._node(schema, v, inner, attr))
        v = self._before(schema, v, place, attr)
        kids = children(schema, self.options)
        below = place.below()
        if kids.items is not None:
            v = let(v, lambda x: self._list(x, kids.items, below))
        elif kids.tuple_items:
            v = let(v, lambda x: self._tuple(x, kids, below))
        if kids.properties or kids.patterns or kids.more_properties is not None:
            v = let(v, lambda x: self._object(x, kids, below))
        return self._after(schema, v, place, attr)

    def _before(self, schema: dict, v: Column, place: Place, attr: str | None) -> Column:
        """The node's own value, before its children."""
        missing = lambda x: x.isNull() | F.is_variant_null(x)
        if "default" in schema:
            v = F.when(missing(v), constant(schema["default"])).otherwise(v)
        if "properties" in schema and not place.is_root:
            v = F.when(missing(v), constant({})).otherwise(v)
        kind = schema.get("type")
        if isinstance(kind, str) and kind != "object":
            v = let(v, lambda x: F.when(missing(x), x).otherwise(coerce(kind, VariantValue(x))))
        return v

    def _after(self, schema: dict, v: Column, place: Place, attr: str | None) -> Column:
        return v

    def _drops(self, stub: dict) -> bool:
        """Whether members that fall under a stub for what the schema does not list go unseen."""
        return "additionalProperty" in stub

    def _list(self, v: Column, item: dict, place: Place) -> Column:
        own = VariantValue(v).items()
        return F.when(own.isNull(), v).otherwise(F.transform(own, lambda x: F.coalesce(self._node(item, x, place, "item"), constant(None))).cast("variant"))

    def _tuple(self, v: Column, kids, place: Place) -> Column:
        own = VariantValue(v).items()
        named = [self._node(s, F.get(own, F.lit(k)), place) for k, s in enumerate(kids.tuple_items)]
        size = F.greatest(F.size(own), *[F.when(x.isNotNull(), k + 1).otherwise(0) for k, x in enumerate(named)])
        more = kids.more_items if kids.more_items and "additionalItem" not in kids.more_items else None

        def at(i: Column) -> Column:
            rest = F.get(own, i)
            out = self._node(more, rest, place) if more else rest
            for k, x in enumerate(named):
                out = F.when(i == k, x).otherwise(out)
            return F.coalesce(out, constant(None))

        filled = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).otherwise(own)
        return F.when(own.isNull(), v).otherwise(filled.cast("variant"))

    def _object(self, v: Column, kids, place: Place) -> Column:
        own = VariantValue(v).members()
        hits: Callable[[Column], list] = lambda key: [(key.rlike(to_java(p)), s) for p, s in kids.patterns]

        def matched(key: Column, x: Column) -> Column:
            for hit, s in hits(key):
                now = x
                x = F.when(hit, self._node(s, now, place)).otherwise(now)
            return x

        names = [k for k, _ in kids.properties]
        parts = []
        if names:
            entries = [F.struct(F.lit(k).alias("key"), matched(F.lit(k), self._node(s, F.try_element_at(own, F.lit(k)), place)).alias("value")) for k, s in kids.properties]
            there = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
            parts.append(F.map_from_entries(there))
        undeclared = (lambda key: ~key.isin(names)) if names else lambda key: F.lit(True)
        more = kids.more_properties
        if more is None:  # additional members are not walked at all
            parts.append(F.map_filter(own, lambda key, x: undeclared(key)))
        else:
            keep_all = not self._drops(more)
            kept = F.map_filter(own, lambda key, x: undeclared(key) & (F.lit(keep_all) | any_of([h for h, _ in hits(key)])))

            def rebuilt(key: Column, x: Column) -> Column:
                out = matched(key, x)
                if keep_all:
                    out = F.when(any_of([h for h, _ in hits(key)]), out).otherwise(self._node(more, x, place))
                return out

            parts.append(F.map_filter(F.transform_values(kept, rebuilt), lambda key, x: x.isNotNull()))
        whole = F.map_concat(*parts) if len(parts) > 1 else parts[0]
        return F.when(own.isNull(), v).otherwise(F.to_variant_object(whole.cast(_MEMBERS)))


@dataclass(frozen=True)
class Replace:
    """A handler's answer: the node's new VARIANT (absent: as if removed); later handlers and the children see it."""

    value: Column


@dataclass(frozen=True)
class Remove:
    """A handler's answer: the node goes where the condition holds; an array keeps a null in its place."""

    when: Column | None = None


@dataclass
class Rewriter(Normalizer):
    """selectors: selector text -> handler(schema, VariantValue, place), which returns Replace, Remove, STOP or None.

    Handlers run on the driver and return columns. A node's go in order by phase: item, start, none, its children, end, item-end. The
    root cannot be replaced or removed. What a schema does not list is visited under its stub, as in the walk. Content below
    `max_depth` levels of a recursive reference fails the query; `RuntimeWalk` reaches any depth.
    """

    selectors: dict[str, Callable] = field(default_factory=dict)

    def __post_init__(self):
        self._selectors = [(parse(k), h) for k, h in self.selectors.items() if is_selector(k)]

    def column(self, v: Column) -> Column:
        return self._node(self.schema, v, Place.start(self.schema))

    def _too_deep(self, v: Column) -> Column:
        return F.when(v.isNull(), v).otherwise(F.raise_error(F.lit(too_deep(self.options))).cast("variant"))

    def _drops(self, stub: dict) -> bool:
        return False

    def _phase(self, schema: dict, v: Column, place: Place, phase: str | None) -> Column:
        def step(now: Column, left: list) -> Column:
            if not left:
                return now
            got = left[0](schema, VariantValue(now), place)
            if isinstance(got, Output) and got.stop:
                return now
            if got is not None and place.is_root:
                raise ValueError("the root of a document cannot be replaced or removed")
            if isinstance(got, Replace):
                return let(got.value, lambda x: step(x, left[1:])) if left[1:] else got.value
            if isinstance(got, Remove):
                gone = F.lit(True) if got.when is None else F.coalesce(got.when, F.lit(False))
                return let(F.when(~gone, now), lambda x: step(x, left[1:])) if left[1:] else F.when(~gone, now)
            return step(now, left[1:])

        own = [h for selector, h in self._selectors if selector.matches(schema, phase)]
        return let(v, lambda x: step(x, own)) if own else v

    def _before(self, schema: dict, v: Column, place: Place, attr: str | None) -> Column:
        for phase in [*([attr] if attr else []), "start", None]:
            v = self._phase(schema, v, place, phase)
        return v

    def _after(self, schema: dict, v: Column, place: Place, attr: str | None) -> Column:
        for phase in ["end", *([f"{attr}-end"] if attr else [])]:
            v = self._phase(schema, v, place, phase)
        return v
