"""The validator: a JSON Schema (draft 4 and extensions) lowered to columns.

Each schema node becomes a Piece: the condition under which the node has an error, and the array of its errors in
order. Asking only for validity uses the conditions alone, a plain boolean expression that stays in generated code
and, on typed columns, reaches the scan as a filter. No rule shuffles or calls Python, unless a user's function does.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.formats import DEFAULT_FORMATS
from docloom.functions.messages import Messages
from docloom.functions.regexes import to_java
from docloom.functions.values import TypedValue, Value, VariantValue, all_of, any_of, js_key, let, value_of
from docloom.plans.nodes import Options, Place, TooDeep, children, follow
from docloom.plans.selectors import Selector, is_selector, parse

ERROR = "struct<code:string,message:string,value:string,arg:string,path:array<string>>"
NO_ERRORS = f"cast(array() as array<{ERROR}>)"


@dataclass
class Piece:
    bad: Column
    errors: Column

    @staticmethod
    def join(pieces: list[Piece]) -> Piece:
        if not pieces:
            return Piece(F.lit(False), F.expr(NO_ERRORS))
        return pieces[0] if len(pieces) == 1 else Piece(any_of([p.bad for p in pieces]), F.concat(*[p.errors for p in pieces]))

    def unless(self, condition: Column) -> Piece:
        return Piece(~condition & self.bad, F.when(condition, F.expr(NO_ERRORS)).otherwise(self.errors))


@dataclass
class Stop:
    """Returned by a rule: where the condition holds, the node's later rules do not run (its children still do)."""

    when: Column


@dataclass
class Context:
    """What a rule sees besides its schema and value."""

    validator: Validator
    place: Place
    path: list[Column]
    parent: Value | None
    property: Column | None
    own_messages: dict | None

    def path_column(self, more: list[Column] | None = None) -> Column:
        parts = self.path + (more or [])
        return F.array(*parts) if parts else F.expr("cast(array() as array<string>)")

    def error(self, code: str, value: Value, arg=None, path: Column | None = None, shown: Column | None = None, arg_column: Column | None = None) -> Column:
        """An error struct; `arg` is a literal, `arg_column` a JSON text."""
        text = self.validator.messages.text(code, self.own_messages, arg if arg is not None else None if arg_column is None else "the item")
        literal = F.lit(None).cast("string") if arg is None else F.lit(json.dumps(arg, separators=(",", ":"), ensure_ascii=False))
        shown = F.coalesce(shown if shown is not None else value.json(), F.lit(None).cast("string"))
        return F.struct(F.lit(code).alias("code"), F.lit(text).alias("message"), shown.alias("value"), (literal if arg_column is None else arg_column).alias("arg"), (self.path_column() if path is None else path).alias("path"))

    def when(self, bad: Column, code: str, value: Value, arg=None, path: Column | None = None) -> Piece:
        """One error where `bad` is true; an unknown condition is no error."""
        bad = F.coalesce(bad, F.lit(False))
        return Piece(bad, F.when(bad, F.array(self.error(code, value, arg, path)).cast(f"array<{ERROR}>")).otherwise(F.expr(NO_ERRORS)))


Rule = Callable[["Validator", dict, Value, Context], "Piece | Stop | None"]


def _literal(x: float | int) -> Column:
    return F.lit(float(x))


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def _optional(validator: Validator, schema: dict, v: Value, ctx: Context):
    return None if ctx.place.is_root else Stop(v.absent)


def _required(validator: Validator, schema: dict, v: Value, ctx: Context):
    return [ctx.when(v.absent, "required", v), Stop(v.absent)]


def _type(name: str) -> Rule:
    return lambda validator, schema, v, ctx: ctx.when(v.bad_type(name), name, v)


def _union(validator: Validator, schema: dict, v: Value, ctx: Context):
    names = schema["type"]
    if not isinstance(names, list):
        return None
    for n in names:
        if n not in TYPES:
            raise ValueError(f"unknown type in a union: {n!r}")
    bad = all_of([v.bad_type(n) for n in names])
    return Piece(bad, F.when(bad, F.array(*[ctx.error(n, v) for n in names]).cast(f"array<{ERROR}>")).otherwise(F.expr(NO_ERRORS)))


def _dependencies(validator: Validator, schema: dict, v: Value, ctx: Context):
    out = []
    for key, dep in schema["dependencies"].items():
        branch = validator.branch({"required": dep} if isinstance(dep, list) else dep, v, ctx, path=[])
        there = F.coalesce(v.has(key), F.lit(False))
        bad = there & branch.bad
        out.append(Piece(bad, F.when(bad, F.concat(F.array(ctx.error("dependency", v, dep)).cast(f"array<{ERROR}>"), branch.errors)).otherwise(F.expr(NO_ERRORS))))
    return out


def _all_of(validator: Validator, schema: dict, v: Value, ctx: Context):
    out = []
    for sub in schema["allOf"]:
        b = validator.branch(sub, v, ctx)
        out.append(Piece(b.bad, F.when(b.bad, F.concat(F.array(ctx.error("allOf", v)).cast(f"array<{ERROR}>"), b.errors)).otherwise(F.expr(NO_ERRORS))))
    return out


def _any_of(validator: Validator, schema: dict, v: Value, ctx: Context):
    if not schema["anyOf"]:
        raise ValueError("anyOf must list a schema")
    branches = [validator.branch(s, v, ctx) for s in schema["anyOf"]]
    bad = all_of([b.bad for b in branches])
    return Piece(bad, F.when(bad, F.concat(F.array(ctx.error("anyOf", v)).cast(f"array<{ERROR}>"), *[b.errors for b in branches])).otherwise(F.expr(NO_ERRORS)))


def _one_of(validator: Validator, schema: dict, v: Value, ctx: Context):
    branches = [validator.branch(s, v, ctx) for s in schema["oneOf"]]
    good = sum((F.when(b.bad, 0).otherwise(1) for b in branches), F.lit(0))
    none = F.concat(F.array(ctx.error("oneOf.zero", v)).cast(f"array<{ERROR}>"), *[b.errors for b in branches])
    return Piece(good != 1, F.when(good == 0, none).when(good > 1, F.array(ctx.error("oneOf", v)).cast(f"array<{ERROR}>")).otherwise(F.expr(NO_ERRORS)))


def _not(validator: Validator, schema: dict, v: Value, ctx: Context):
    return ctx.when(~validator.branch(schema["not"], v, ctx).bad, "not", v)


def _key(validator: Validator, v: Value) -> Column:
    return v.tagged() if validator.options.strict_draft4 else v.canonical()


def _literal_key(validator: Validator, x) -> Column:
    if isinstance(x, (dict, list)):
        text = F.to_json(F.parse_json(F.lit(json.dumps(x))))
        return F.concat(F.lit("j"), text) if validator.options.strict_draft4 else text
    kind = "s" if isinstance(x, str) else "n" if isinstance(x, (int, float)) and not isinstance(x, bool) else "j"
    return F.lit((kind if validator.options.strict_draft4 else "") + js_key(x))


def _enum(validator: Validator, schema: dict, v: Value, ctx: Context):
    values = schema["enum"]
    if values and all(isinstance(x, str) for x in values) and isinstance(v, TypedValue) and v._family() == "string":
        ok = v.text().isin(values)  # a plain comparison, which a scan can use
    else:
        ok = _key(validator, v).isin(*[_literal_key(validator, x) for x in values]) if values else F.lit(False)
    return ctx.when(~F.coalesce(ok, F.lit(False)), "enum", v, values)


def _length(keyword: str, over: bool) -> Rule:
    def rule(validator: Validator, schema: dict, v: Value, ctx: Context):
        n = validator.str_length(v.text())
        bad = n > schema[keyword] if over else n < schema[keyword]
        return ctx.when(v.is_type("string") & bad, keyword, v, schema[keyword])

    return rule


def _pattern(validator: Validator, schema: dict, v: Value, ctx: Context):
    return ctx.when(v.is_type("string") & ~v.text().rlike(to_java(schema["pattern"])), "pattern", v, schema["pattern"])


def _format(validator: Validator, schema: dict, v: Value, ctx: Context):
    own = validator.formats.get(schema["format"])
    if own is None:
        raise ValueError(f"unknown format {schema['format']!r}: register it in formats")
    return ctx.when(v.is_type("string") & ~v.text().rlike(to_java(own["regexp"])), f"format.{schema['format']}", v, own.get("message"))


def _n_items(keyword: str, over: bool) -> Rule:
    return lambda validator, schema, v, ctx: ctx.when(v.n_items() > schema[keyword] if over else v.n_items() < schema[keyword], keyword, v)


def _unique(validator: Validator, schema: dict, v: Value, ctx: Context):
    if validator.options.strict_draft4 and schema["uniqueItems"] is False:
        return None
    keys = v.each_item(0, lambda x, i: _key(validator, x), "transform")
    if keys is None:
        return None
    shown = v.each_item(0, lambda x, i: x.json(), "transform")
    bad = F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
    # each item's key is made once, not again for every item that it is compared with
    at = let(keys, lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_position(own, F.get(own, i)) < i + 1))
    errors = let(shown, lambda own: F.transform(at, lambda i: ctx.error("uniqueItems", v, arg_column=F.get(own, i))))
    return Piece(bad, F.when(bad, errors.cast(f"array<{ERROR}>")).otherwise(F.expr(NO_ERRORS)))


def _required_list(validator: Validator, schema: dict, v: Value, ctx: Context):
    if not isinstance(schema.get("required"), list):
        return None
    is_object = v.is_type("object")
    return [ctx.when(is_object & ~v.has(k), "required", v, path=ctx.path_column([F.lit(k)])) for k in schema["required"]]


def _n_members(keyword: str, over: bool) -> Rule:
    def rule(validator: Validator, schema: dict, v: Value, ctx: Context):
        n = F.coalesce(v.n_members(), v.n_items())
        return ctx.when(n > schema[keyword] if over else n < schema[keyword], keyword, v, schema[keyword])

    return rule


def _multiple(validator: Validator, schema: dict, v: Value, ctx: Context):
    m = schema["multipleOf"]
    bad = F.lit(True) if m == 0 else (v.number() / _literal(m)) % 1 != 0
    return ctx.when(v.is_type("number") & bad, "multipleOf", v, m)


def _comparable(v: Value) -> Column:
    """The number that a comparison with a number uses; NULL where it would be none."""
    text = F.trim(v.text())
    number = F.when(v.is_type("number"), v.number()).when(v.is_type("string"), F.when(text == "", 0.0).otherwise(text.try_cast("double")))
    return number.when(v.is_type("boolean"), F.when(v.json() == "true", 1.0).otherwise(0.0)).when(v.is_type("null"), 0.0)


def _bound(keyword: str, upper: bool) -> Rule:
    def rule(validator: Validator, schema: dict, v: Value, ctx: Context):
        strict = bool(schema.get("exclusive" + keyword.capitalize()))
        n, x = _comparable(v) if validator.options.js_coercion else v.number(), _literal(schema[keyword])
        bad = (n >= x if strict else n > x) if upper else (n <= x if strict else n < x)
        return ctx.when(bad if validator.options.js_coercion else v.is_type("number") & bad, keyword + (".exclusive" if strict else ""), v, schema[keyword])

    return rule


def _conform(validator: Validator, schema: dict, v: Value, ctx: Context):
    own = schema["conform"]
    if callable(own):
        return ctx.when(~F.coalesce(own(v, ctx), F.lit(False)), "custom", v)
    out = []
    for name, args in own.items():
        if name not in validator.custom:
            raise ValueError(f"no custom function {name!r} is registered")
        if args is not True and not isinstance(args, list):
            raise ValueError(f"arguments of the custom function {name!r} must be a list or true")
        ok = validator.custom[name](v, *([] if args is True else args), ctx)
        out.append(ctx.when(~F.coalesce(ok, F.lit(False)), f"custom.{name}", v, validator.messages.catalogue.get("custom")))
    return out


TYPES = ("string", "number", "integer", "null", "boolean", "array", "object")

#: Rules in the order in which a node's errors come, which is observable and therefore fixed.
BASE_RULES: dict[str, Rule] = {
    "[^required]": _optional,
    "[required=false]": _optional,
    "[required=true]": _required,
    **{f"[type={t}]": _type(t) for t in TYPES},
    "[type]": _union,
    "[dependencies]": _dependencies,
    "[allOf]": _all_of,
    "[anyOf]": _any_of,
    "[oneOf]": _one_of,
    "[not]": _not,
    "[enum]": _enum,
    "[maxLength]": _length("maxLength", True),
    "[minLength]": _length("minLength", False),
    "[pattern]": _pattern,
    "[format]": _format,
    "[additionalItem=false]": lambda validator, schema, v, ctx: ctx.when(F.lit(True), "additionalItems", v),
    "[minItems]": _n_items("minItems", False),
    "[maxItems]": _n_items("maxItems", True),
    "[uniqueItems]": _unique,
    "[required][^properties]": _required_list,
    "[properties]": _required_list,
    "[maxProperties]": _n_members("maxProperties", True),
    "[minProperties]": _n_members("minProperties", False),
    "[additionalProperty=false]": lambda validator, schema, v, ctx: ctx.when(F.lit(True), "additionalProperties", v),
    "[multipleOf]": _multiple,
    "[minimum]": _bound("minimum", False),
    "[maximum]": _bound("maximum", True),
    "[conform]": _conform,
}


@dataclass
class Validator:
    """A schema with its options. Rules of subclasses made by `extend` come before the base rules.

    str_length: "utf16" (default), "codepoint", or a function of a string column. custom: name -> function of
    (value, *args, ctx) that gives a boolean column. formats: name -> {regexp, message}. messages replaces the whole
    catalogue. gettext translates default and schema messages.
    """

    schema: dict
    options: Options = field(default_factory=Options)
    formats: dict = field(default_factory=dict)
    custom: dict[str, Callable] = field(default_factory=dict)
    messages: Messages | dict | None = None
    gettext: Callable[[str], str] | None = None
    str_length: str | Callable[[Column], Column] = "utf16"
    rules: dict[str, Rule] = field(default_factory=dict)
    #: Where the documents stand in a larger one; all error paths start with it.
    path: tuple[str, ...] = ()

    def __post_init__(self):
        self.formats = DEFAULT_FORMATS | self.formats
        if not isinstance(self.messages, Messages):
            self.messages = Messages(self.messages, self.gettext)
        if not callable(self.str_length):
            self.str_length = {"utf16": utf16_length, "codepoint": F.length}[self.str_length]
        ordered = self.own_rules() | self.rules
        ordered |= {k: r for k, r in BASE_RULES.items() if k not in ordered}
        self._rules: list[tuple[Selector, Rule]] = [(parse(k), r) for k, r in ordered.items() if is_selector(k)]

    def own_rules(self) -> dict[str, Rule]:
        return {}

    @classmethod
    def extend(cls, rules: dict[str, Rule]) -> type[Validator]:
        """A validator class with rules that replace or precede the base ones."""
        base = cls

        class Extended(base):
            def own_rules(self) -> dict[str, Rule]:
                return rules | {k: r for k, r in base.own_rules(self).items() if k not in rules}

        return Extended

    @classmethod
    def factory(cls, **options) -> Callable[[dict], Validator]:
        return lambda schema: cls(schema, **options)

    # -- lowering

    def piece(self, v: Value, path: list[Column] | None = None, want_errors: bool = True) -> Piece:
        self._want_errors, self._met_depth = want_errors, False
        self._messages_now: dict | None = None
        return self._node(self.schema, v, Place.start(self.schema), path or [], None, None)

    def branch(self, schema: dict, v: Value, ctx: Context, path: list[Column] | None = None) -> Piece:
        """A schema of its own at the same value: a combinator's branch or a dependency."""
        outer, self._messages_now = self._messages_now, None
        place = Place(ctx.place.document, ctx.place.entered, True)
        out = self._node(schema, v, place, ctx.path if path is None else path, None, None)
        self._messages_now = outer
        return out

    def _node(self, schema: dict, v: Value, place: Place, path: list[Column], parent: Value | None, prop: Column | None) -> Piece:
        try:
            schema, place = follow(schema, place, self.options)
        except TooDeep:
            self._met_depth = True
            there = ~v.absent
            error = F.struct(F.lit("depth_exceeded").alias("code"), F.lit("is nested too deeply to be checked").alias("message"), v.json().alias("value"), F.lit(None).cast("string").alias("arg"), (F.array(*path) if path else F.expr("cast(array() as array<string>)")).alias("path"))
            return Piece(there, F.when(there, F.array(error).cast(f"array<{ERROR}>")).otherwise(F.expr(NO_ERRORS)))
        if schema.get("messages"):
            self._messages_now = schema["messages"]
        ctx = Context(self, place, path, parent, prop, self._messages_now)
        todo: list[Piece | Stop] = []
        for selector, rule in self._rules:
            if selector.matches(schema, None):
                got = rule(self, schema, v, ctx)
                todo += got if isinstance(got, list) else [got] if got is not None else []
        pieces: list[Piece] = []
        for step in reversed(todo):  # from the last rule back: a stop spares all that follow it
            pieces = [Piece.join(pieces).unless(step.when)] if isinstance(step, Stop) else [step, *pieces]
        pieces += self._children(schema, v, place.below(), path)
        if schema.get("messages"):
            self._messages_now = None
        return Piece.join(pieces).unless(v.absent) if place.again else Piece.join(pieces)

    def _children(self, schema: dict, v: Value, place: Place, path: list[Column]) -> list[Piece]:
        kids = children(schema, self.options)
        go = lambda s, x, key: self._node(s, x, place, [*path, key], v, key)
        out: list[Piece] = []
        if kids.items is not None:
            out += self._each(v.each_item, (0,), lambda x, i: go(kids.items, x, i))
        for k, sub in enumerate(kids.tuple_items):
            out.append(go(sub, v.item(k), F.lit(str(k))))
        if kids.more_items is not None and kids.more_items != {"additionalItem": "allowed"}:
            out += self._each(v.each_item, (len(kids.tuple_items),), lambda x, i: go(kids.more_items, x, i))
        for k, sub in kids.properties:
            out.append(go(sub, v.child(k), F.lit(k)))
        rest = kids.more_properties
        if rest is not None and (kids.patterns or rest != {"additionalProperty": "allowed"}):
            known = [k for k, _ in kids.properties]

            def member(x: Value, key: Column) -> Piece:
                hits = [(key.rlike(to_java(p)), s) for p, s in kids.patterns]
                parts = [go(s, x, key).unless(~hit) for hit, s in hits]
                if rest != {"additionalProperty": "allowed"}:
                    spared = any_of([key.isin(known)] * bool(known) + [hit for hit, _ in hits])
                    parts.append(go(rest, x, key).unless(spared))
                return Piece.join(parts)

            out += self._each(v.each_member, (), member)
        return out

    def _each(self, each, args: tuple, make: Callable[[Value, Column], Piece]) -> list[Piece]:
        """A node's elements or members: the condition by exists where errors are not asked for, else the errors alone, so that an element is lowered once."""
        if not self._want_errors:
            bad = each(*args, lambda x, k: make(x, k).bad, "exists")
            return [] if bad is None else [Piece(bad, F.expr(NO_ERRORS))]
        errors = each(*args, lambda x, k: make(x, k).errors, "transform")
        if errors is None:
            return []
        errors = F.coalesce(F.flatten(F.filter(errors, lambda e: e.isNotNull())), F.expr(NO_ERRORS))
        return [Piece(F.size(errors) > 0, errors)]

    # -- on data

    def start_path(self) -> list[Column]:
        return [F.lit(p) for p in self.path]

    def _is_plain(self) -> bool:
        """Whether no rule, predicate or length of a user's is involved, so that single values can be judged outside the plan."""
        return not (self.own_rules() or self.rules or self.custom or self.str_length not in (utf16_length, F.length) or _mentions(self.schema, "conform"))

    def _deeper(self, v: Value) -> Column | None:
        """Where a document goes deeper than recursion is unrolled; None if the schema or the columns cannot."""
        if not (self._met_depth and isinstance(v, VariantValue) and self._is_plain()):
            return None
        return F.coalesce(deep_content(self.schema, self.options, v), F.lit(False))

    def _exact(self, v: VariantValue, deep: Column) -> Column:
        from docloom.plans.pyeval import deep_validator

        return deep_validator(self)(F.when(deep, F.to_json(v.column)))

    def is_valid(self, df: DataFrame, column: str | None = None, null_as: str = "missing") -> Column:
        """A boolean column: whether the document (a column, or with None the row) has no error."""
        v = value_of(df, column, null_as)
        bad = self.piece(v, want_errors=False).bad
        deep = self._deeper(v)
        return ~bad if deep is None else F.when(deep, F.size(self._exact(v, deep)) == 0).otherwise(~bad)

    def result(self, df: DataFrame, column: str | None = None, null_as: str = "missing") -> Column:
        """struct<valid, errors>. Documents that go deeper than recursion is unrolled are judged by the evaluator of single values, in Arrow batches;
        with rules, predicates or lengths of a user's, which are columns, they have the error depth_exceeded instead."""
        v = value_of(df, column, null_as)
        p = self.piece(v, self.start_path())
        deep = self._deeper(v)
        if deep is None:
            return F.struct((~p.bad).alias("valid"), p.errors.alias("errors"))
        errors = F.when(deep, self._exact(v, deep)).otherwise(p.errors)
        return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"))

    def validate(self, df: DataFrame, column: str | None = None, into: str = "result", null_as: str = "missing") -> DataFrame:
        return df.withColumn(into, self.result(df, column, null_as))


def validate_variant(v: Column, schema: dict, **options) -> Column:
    """struct<valid, errors> of a VARIANT column expression."""
    p = Validator(schema, **options).piece(VariantValue(v))
    return F.struct((~p.bad).alias("valid"), p.errors.alias("errors"))


def _mentions(schema, keyword: str) -> bool:
    if isinstance(schema, dict):
        return keyword in schema or any(_mentions(x, keyword) for x in schema.values())
    return isinstance(schema, list) and any(_mentions(x, keyword) for x in schema)


def _through(keyword: str) -> Rule:
    def rule(validator: Validator, schema: dict, v: Value, ctx: Context):
        subs = schema[keyword] if isinstance(schema[keyword], list) else list(schema[keyword].values()) if keyword == "dependencies" else [schema[keyword]]
        return [Piece(validator.branch(sub, v, ctx).bad, F.expr(NO_ERRORS)) for sub in subs if isinstance(sub, dict)]

    return rule


def deep_content(schema: dict, options: Options, v: VariantValue) -> Column:
    """Whether a document has content below the levels to which recursion is unrolled."""
    probe = Validator(schema, options)
    probe._rules = [(parse(f"[{k}]"), _through(k)) for k in ("dependencies", "allOf", "anyOf", "oneOf", "not")]
    return probe.piece(v, want_errors=False).bad


def recurses(schema: dict, options: Options) -> bool:
    """Whether a schema's references lead back to themselves."""
    probe = Validator(schema, options)
    probe._rules = []
    probe.piece(VariantValue(F.lit(None).cast("variant")), want_errors=False)
    return probe._met_depth
