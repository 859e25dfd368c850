"""The iterator: walk documents along their schema and emit what selectors match, in order.

A walk is compiled to one array column of visits per document; exploding it gives a visit table, folding it a text.
Handlers run on the driver while compiling and return columns, so no Python runs on the data.

Content below `max_depth` levels of a recursive reference is a visit of phase `depth_exceeded` without a selector; a fold,
which has no place for it, fails. `RuntimeWalk`, whose handlers are plain functions, reaches any depth.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.regexes import to_java
from docloom.functions.values import Value, any_of, value_of
from docloom.plans.nodes import Options, Place, TooDeep, children, follow, too_deep
from docloom.plans.selectors import Selector, is_selector, parse

VISIT = "struct<selector:string,phase:string,path:array<string>,property:string,value:string,schema:string,output:string>"
VISIT_FIELDS = ("selector", "phase", "path", "property", "value", "schema", "output")
NONE = f"cast(array() as array<{VISIT}>)"


@dataclass(frozen=True)
class Output:
    """What a handler returns: a text column (or None), and whether later selectors of this phase at this node run."""

    text: Column | None = None
    stop: bool = False


STOP = Output(stop=True)


@dataclass
class Cursor:
    """A handler's view of where the walk is; path elements are columns, at schema-only walks literals."""

    path: list[Column]
    property: Column | None
    parent: Value | None
    branches: dict[str, list[Walk]]


Handler = Callable[[dict, "Value | None", Cursor], "Output | Column | str | None"]


class _Rows:
    """Visits as an array of structs."""

    none = staticmethod(lambda: F.expr(NONE))
    join = staticmethod(lambda parts: F.concat(*parts))
    flat = staticmethod(lambda made: F.flatten(made))

    @staticmethod
    def one(selector: Selector, phase: str | None, schema: dict, v: Value | None, cursor: Cursor, text: Column | None) -> Column:
        shown = {k: x for k, x in schema.items() if not callable(x)}
        path = F.array(*cursor.path) if cursor.path else F.expr("cast(array() as array<string>)")
        null = F.lit(None).cast("string")
        fields = {"selector": F.lit(selector.text), "phase": F.lit(phase or ""), "path": path, "property": null if cursor.property is None else cursor.property}
        fields |= {"value": null if v is None else v.json(), "schema": F.lit(json.dumps(shown, sort_keys=True, default=str)), "output": null if text is None else text.cast("string")}
        return F.array(F.struct(*[c.alias(k) for k, c in fields.items()]).cast(VISIT))

    @staticmethod
    def deep(v: Value, path: list[Column], prop: Column | None, options: Options) -> Column:
        null = F.lit(None).cast("string")
        fields = {"selector": F.lit(""), "phase": F.lit("depth_exceeded"), "path": F.array(*path), "property": null if prop is None else prop, "value": v.json(), "schema": null, "output": null}
        return F.array(F.struct(*[c.alias(k) for k, c in fields.items()]).cast(VISIT))


class _Text:
    """Only the outputs, as one text."""

    none = staticmethod(lambda: F.lit(""))
    join = staticmethod(lambda parts: F.concat(*parts))
    flat = staticmethod(lambda made: F.array_join(made, ""))

    @staticmethod
    def one(selector: Selector, phase: str | None, schema: dict, v: Value | None, cursor: Cursor, text: Column | None) -> Column | None:
        return None if text is None else F.coalesce(text.cast("string"), F.lit(""))

    @staticmethod
    def deep(v: Value, path: list[Column], prop: Column | None, options: Options) -> Column:
        return F.raise_error(F.lit(too_deep(options))).cast("string")


@dataclass
class Walk:
    """selectors: selector text -> handler, tried in order; other keys are ignored. begin and end wrap the fold."""

    schema: dict
    selectors: dict[str, Handler]
    options: Options = field(default_factory=Options)
    begin: str = ""
    end: Callable[[Column], Column] | None = None
    #: Where the documents stand in a larger one; all visit paths start with it.
    path: tuple[str, ...] = ()

    def __post_init__(self):
        self._selectors: list[tuple[Selector, Handler]] = [(parse(k), h) for k, h in self.selectors.items() if is_selector(k)]

    # -- compiling

    def _phase(self, schema: dict, v: Value | None, cursor: Cursor, phase: str | None, form: type) -> list[Column]:
        out = []
        for selector, handler in self._selectors:
            if not selector.matches(schema, phase):
                continue
            got = handler(schema, v, cursor)
            got = got if isinstance(got, Output) else Output(F.lit(got) if isinstance(got, str) else got)
            made = form.one(selector, phase, schema, v, cursor, got.text)
            if made is not None:
                out.append(made)
            if got.stop:
                break
        return out

    def _node(self, schema: dict, v: Value | None, place: Place, path: list[Column], prop: Column | None, parent: Value | None, attr: str | None, schema_only: bool, form: type) -> Column:
        try:
            schema, place = follow(schema, place, self.options)
        except TooDeep:  # without a document, recursion has no other end
            return form.none() if v is None else F.when(v.absent, form.none()).otherwise(form.deep(v, path, prop, self.options))
        branches = {k: [Walk(s, self.selectors, self.options) for s in (schema[k] if isinstance(schema[k], list) else [schema[k]])] for k in ("oneOf", "anyOf", "allOf", "not") if schema.get(k)}
        cursor = Cursor(path, prop, parent, branches)
        one = lambda phase: self._phase(schema, v, cursor, phase, form)
        parts = (one(attr) if attr else []) + one("start") + one(None)
        parts += self._children(schema, v, place.below(), path, schema_only, form)
        parts += one("end") + (one(f"{attr}-end") if attr else [])
        made = form.join(parts) if parts else form.none()
        return F.when(v.absent, form.none()).otherwise(made) if place.again and v is not None else made

    def _children(self, schema: dict, v: Value | None, place: Place, path: list[Column], schema_only: bool, form: type) -> list[Column]:
        kids = children(schema, self.options)
        go = lambda s, x, key, attr=None: self._node(s, x, place, [*path, key], key, v, attr, schema_only, form)
        flat = lambda made: [] if made is None else [F.coalesce(form.flat(F.filter(made, lambda e: e.isNotNull())), form.none())]
        out: list[Column] = []
        if kids.items is not None:
            if schema_only:
                out += [] if self.options.ignore_schema_only else [go(kids.items, None, F.lit("[]"), "item")]
            else:
                out += flat(v.each_item(0, lambda x, i: go(kids.items, x, i, "item"), "transform"))
        for k, sub in enumerate(kids.tuple_items):
            out.append(go(sub, None if schema_only else v.item(k), F.lit(str(k))))
        if kids.more_items is not None and not schema_only:
            out += flat(v.each_item(len(kids.tuple_items), lambda x, i: go(kids.more_items, x, i), "transform"))
        for k, sub in kids.properties:
            out.append(go(sub, None if schema_only else v.child(k), F.lit(k)))
        if kids.more_properties is not None and not schema_only:
            known = [k for k, _ in kids.properties]

            def member(x: Value, key: Column) -> Column:
                hits = [(key.rlike(to_java(p)), s) for p, s in kids.patterns]
                parts = [F.when(hit, go(s, x, key)).otherwise(form.none()) for hit, s in hits]
                spared = any_of([key.isin(known)] * bool(known) + [hit for hit, _ in hits])
                return form.join([*parts, F.when(spared, form.none()).otherwise(go(kids.more_properties, x, key))])

            out += flat(v.each_member(member, "transform"))
        return out

    # -- on data

    def visits_of(self, v: Value) -> Column:
        """All visits of a document, in order."""
        return self._node(self.schema, v, Place.start(self.schema), [F.lit(p) for p in self.path], None, None, None, False, _Rows)

    def visits(self, df: DataFrame, column: str | None, keys: list[str]) -> DataFrame:
        """The visit table: `keys`, seq, and the visit's fields, a row each."""
        made = df.select(*keys, F.posexplode(self.visits_of(value_of(df, column))).alias("seq", "visit"))
        return made.select(*keys, "seq", "visit.*")

    def fold_of(self, v: Value) -> Column:
        text = self._node(self.schema, v, Place.start(self.schema), [F.lit(p) for p in self.path], None, None, None, False, _Text)
        text = F.concat(F.lit(self.begin), text) if self.begin else text
        return self.end(text) if self.end else text

    def fold(self, df: DataFrame, column: str | None = None) -> Column:
        """The outputs of a document's visits joined, `begin` first, `end` applied."""
        return self.fold_of(value_of(df, column))

    def schema_visits(self, spark: SparkSession) -> DataFrame:
        """The walk without a document: list items once, at path `[]`."""
        made = self._node(self.schema, None, Place.start(self.schema), [F.lit(p) for p in self.path], None, None, None, True, _Rows)
        return spark.range(1).select(F.posexplode(made).alias("seq", "visit")).select("seq", "visit.*")
