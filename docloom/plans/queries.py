"""Registered queries: each operator on documents derived from the test tables, with its DuckDB counterpart."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.api import new_iterator, new_normalizer, read_schema
from docloom.operators.normalize import Normalizer, Remove, Replace, Rewriter
from docloom.operators.render import SELECTORS as FORM_SELECTORS
from docloom.operators.render import form
from docloom.operators.runtime import RuntimeWalk
from docloom.operators.validate import Validator
from docloom.operators.walk import STOP, Walk
from docloom.plans import fixtures as X
from docloom.plans.nodes import Options
from docloom.sources.documents import read_json_lines, write_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LIMIT_OPTIONS = Options(max_depth=5)


def verdicts(df: DataFrame, validator: Validator, keys: list[str], column: str | None) -> DataFrame:
    """keys, valid, n_errors, codes."""
    got = df.select(*keys, validator.result(df, column).alias("r"))
    return got.select(*keys, "r.valid", F.size("r.errors").cast("long").alias("n_errors"), F.array_join(F.transform("r.errors", lambda e: e["code"]), ",").alias("codes"))


def _verdict_sql(keys: str, source: str, codes: list[tuple[str, str]]) -> str:
    """codes: (condition, code) pairs in error order; the condition may be an integer count of repeats."""
    n = " + ".join(f"coalesce(({c})::bigint, 0)" for c, _ in codes) or "0::bigint"
    texts = ", ".join(f"repeat('{code},', coalesce(({c})::bigint, 0))" for c, code in codes) or "''"
    return f"select {keys}, ({n}) = 0 as valid, ({n})::bigint as n_errors, rtrim(concat({texts}), ',') as codes from {source}"


def check(name: str, fixture: Callable[[SparkSession, str], DataFrame], keys: str, column: str | None, schema: dict | Callable[[], Validator], source: str, *codes: tuple[str, str], **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        validator = schema() if callable(schema) else Validator(schema, **options)
        return verdicts(fixture(spark, sf_dir), validator, keys.split(", "), column)

    QUERIES[name] = query
    SQL[name] = _verdict_sql(keys, source, list(codes))


def on_poly(name: str, p: dict, *codes: tuple[str, str], root: dict | None = None, **options) -> None:
    check(name, X.poly, "event_id", "doc", (root or {}) | {"properties": {"p": p}}, "(select *, event_id % 8 as k from events)", *codes, **options)


def on_table(name: str, table: str, keys: str, columns: dict[str, dict], *codes: tuple[str, str], root: dict | None = None, **options) -> None:
    """The row itself is the document; only the columns that the schema names are read."""
    names = list(dict.fromkeys([*keys.split(", "), *columns]))
    check(name, lambda spark, d: X.table(spark, d, table).select(*names), keys, None, (root or {}) | {"properties": columns}, table, *codes, **options)


# ---------------------------------------------------------------- types and presence

on_poly("v_type_string", {"type": "string"}, ("k not in (4, 7)", "string"))
on_poly("v_type_number", {"type": "number"}, ("k not in (2, 3, 7)", "number"))
on_poly("v_type_integer", {"type": "integer"}, ("k not in (2, 7)", "integer"))
on_poly("v_type_null", {"type": "null"}, ("k not in (0, 7)", "null"))
on_poly("v_type_boolean", {"type": "boolean"}, ("k not in (1, 7)", "boolean"))
on_poly("v_type_array", {"type": "array"}, ("k not in (5, 7)", "array"))
on_poly("v_type_object", {"type": "object"}, ("k not in (6, 7)", "object"))
on_poly("v_type_union", {"type": ["string", "null"]}, ("k not in (0, 4, 7)", "string"), ("k not in (0, 4, 7)", "null"))
on_poly("v_type_unknown", {"type": "any"})
on_poly("v_optional", {"type": "integer", "required": False, "minimum": 100}, ("k not in (2, 7)", "integer"), ("(k = 2 and event_id < 100) or (k = 3 and event_id + 0.5 < 100)", "minimum"))
on_poly("v_required_bool", {"required": True, "type": "string"}, ("k = 7", "required"), ("k not in (4, 7)", "string"))
on_poly("v_required_array", {}, ("k = 7", "required"), root={"type": "object", "required": ["p"]})
on_poly("v_minimum", {"minimum": 500}, ("(k = 2 and event_id < 500) or (k = 3 and event_id + 0.5 < 500)", "minimum"))

# ---------------------------------------------------------------- numbers, on typed rows

LINE = "l_orderkey, l_linenumber"
on_table("v_maximum", "lineitem", LINE, {"l_quantity": {"type": "number", "maximum": 45}}, ("l_quantity > 45", "maximum"))
on_table("v_excl_min", "lineitem", LINE, {"l_discount": {"minimum": 0, "exclusiveMinimum": True}}, ("l_discount <= 0", "minimum.exclusive"))
on_table("v_excl_max", "lineitem", LINE, {"l_tax": {"maximum": 0.05, "exclusiveMaximum": True}}, ("l_tax >= 0.05::double", "maximum.exclusive"))
on_table("v_multipleOf", "lineitem", LINE, {"l_quantity": {"multipleOf": 7}, "l_discount": {"multipleOf": 0.01}}, ("fmod(l_quantity / 7, 1) <> 0", "multipleOf"), ("fmod(l_discount / 0.01::double, 1) <> 0", "multipleOf"))

# ---------------------------------------------------------------- strings and formats

on_table("v_maxLength", "documents", "doc_id", {"text": {"maxLength": 1000}}, ("length(text) > 1000", "maxLength"))
on_table("v_minLength", "part", "p_partkey", {"p_name": {"type": "string", "minLength": 12}}, ("length(p_name) < 12", "minLength"))
on_table("v_strLength", "documents", "doc_id", {"text": {"minLength": 500}}, ("length(text) < 500", "minLength"), str_length="codepoint")
on_table("v_pattern", "part", "p_partkey", {"p_brand": {"pattern": "^Brand#[1-3]+$"}}, ("not regexp_matches(p_brand, '^Brand#[1-3]+$')", "pattern"))
on_table("v_enum", "customer", "c_custkey", {"c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}}, ("c_mktsegment not in ('BUILDING', 'MACHINERY')", "enum"))
on_poly("v_enum_poly", {"enum": [None, "click", {"a": 1, "b": "x"}, 10]}, ("not (k in (0, 7) or (k = 4 and event_type = 'click') or (k = 6 and event_id % 5 = 1) or (k = 2 and event_id = 10))", "enum"))


def on_string(name: str, schema: dict, made: str, bad: str, code: str, **options) -> None:
    check(name, lambda spark, d: X.strings(spark, d, made), "event_id", "s", schema, "events", (bad, code), **options)


on_string("f_email", {"format": "email"}, "case event_id % 3 when 0 then concat('u', event_id, '@x.com') when 1 then concat('u', event_id) else concat('u@', event_id, '@x') end", "event_id % 3 > 0", "format.email")
on_string("f_date_time", {"format": "date-time"}, "concat('2020-', lpad(event_id % 16, 2, '0'), '-99', if(event_id % 2 = 0, 'T', ' '), '10:00:00', if(event_id % 5 = 0, '', if(event_id % 5 = 1, '.25Z', '+01:00')))", "event_id % 16 > 12 or event_id % 5 = 0", "format.date-time")
on_string("f_ipv4", {"format": "ipv4"}, "concat('10.0', event_id % 7, '.', event_id % 300, '.1')", "event_id % 300 > 255", "format.ipv4")
on_string("f_ipv6", {"format": "ipv6"}, "case event_id % 5 when 0 then ' ::1 ' when 1 then concat('fe80::', event_id % 9, '%eth0') when 2 then '1:2:3:4:5:6:7' when 3 then '::ffff:10.0.0.256' else '1:2:3:4:5:6:7:8' end", "event_id % 5 in (2, 3)", "format.ipv6")
on_string("f_hostname", {"format": "hostname"}, "case event_id % 4 when 0 then concat('h', event_id, '.example.org') when 1 then '-a.b' when 2 then repeat('a', 64) else repeat('a', 63) end", "event_id % 4 in (1, 2)", "format.hostname")
on_string("f_custom", {"format": "seen"}, "event_type", "not regexp_matches(event_type, '(click|view)')", "format.seen", formats={"seen": {"regexp": "(click|view)", "message": "shall be seen"}})
on_table("f_uri", "pages", "page_id", {"url": {"format": "uri", "pattern": "/en/"}}, ("not regexp_matches(url, '/en/')", "pattern"), ("not regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+,.-]*:[^\\s]*$')", "format.uri"))
on_string("v_format", {"type": "string", "format": "uri"}, "if(event_id % 2 = 0, concat('a,b:', event_id), 'no uri')", "event_id % 2 = 1", "format.uri")

# ---------------------------------------------------------------- arrays

ARRAYS = "(select *, list_slice([user_id % 3, event_id % 3, event_id % 2, 7], 1, (event_id % 5)::int) as a from events)"


def on_arrays(name: str, schema: dict, *codes: tuple[str, str], **options) -> None:
    check(name, X.arrays, "event_id", "doc", schema, ARRAYS, *codes, **options)


on_arrays("v_minItems", {"minItems": 2}, ("len(a) < 2", "minItems"))
on_arrays("v_maxItems", {"type": "array", "maxItems": 3}, ("len(a) > 3", "maxItems"))
on_arrays("v_uniqueItems", {"uniqueItems": True}, ("len(a) - len(list_distinct(a))", "uniqueItems"))
on_arrays("v_items", {"items": {"type": "integer", "maximum": 1}}, ("len(list_filter(a, lambda x: x > 1))", "maximum"))
on_arrays("walk_items_tuple", {"items": [{"maximum": 0}, {"minimum": 2}]}, ("len(a) > 0 and a[1] > 0", "maximum"), ("len(a) > 1 and a[2] < 2", "minimum"))
on_arrays("v_additionalItems", {"items": [{}, {}], "additionalItems": False}, ("greatest(len(a) - 2, 0)", "additionalItems"))
on_arrays("walk_add_items", {"items": [{}, {}], "additionalItems": {"maximum": 1}}, ("len(list_filter(list_slice(a, 3, 9), lambda x: x > 1))", "maximum"))


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "embeddings").select("vec_id", "embedding")


check("v_items_typed", _embeddings, "vec_id", "embedding", {"minItems": 64, "items": {"maximum": 3}}, "embeddings", ("len(embedding) < 64", "minItems"), ("len(list_filter(embedding, lambda x: x > 3))", "maximum"))

# ---------------------------------------------------------------- objects

SPARSE = "(select *, o_orderkey % 2 = 0 as a, o_orderkey % 3 = 0 as b, o_orderkey % 5 = 0 as x1, o_orderkey % 10 = 0 as x1n, o_orderkey % 7 = 0 as y, (o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int + (o_orderkey % 5 = 0)::int + (o_orderkey % 7 = 0)::int as n from orders)"


def on_sparse(name: str, schema: dict, *codes: tuple[str, str], **options) -> None:
    check(name, X.sparse, "o_orderkey", "doc", schema, SPARSE, *codes, **options)


on_sparse("v_minProperties", {"minProperties": 2}, ("n < 2", "minProperties"))
on_sparse("v_maxProperties", {"maxProperties": 1}, ("n > 1", "maxProperties"))
on_sparse("v_additionalProperties", {"properties": {"a": {}, "b": {}}, "additionalProperties": False}, ("x1::int + y::int", "additionalProperties"))
on_sparse("v_patternProperties", {"patternProperties": {"^x": {"type": "number"}}}, ("x1 and not x1n", "number"))
on_sparse("walk_pattern", {"properties": {"a": {}}, "patternProperties": {"[0-9]$": {"type": "string"}, "^[ab]": {}}, "additionalProperties": False}, ("x1n", "string"), ("y", "additionalProperties"))
on_sparse("walk_add_props", {"properties": {"a": {}, "b": {}}, "additionalProperties": {"type": "null"}}, ("x1", "null"))
on_sparse("v_dependencies", {"dependencies": {"a": ["b"], "y": {"minProperties": 3}}}, ("a and not b", "dependency"), ("a and not b", "required"), ("y and n < 3", "dependency"), ("y and n < 3", "minProperties"))
on_sparse("v_properties", {"properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}}, ("b", "integer"))
on_sparse("walk_properties", {"properties": {"a": {"required": True}, "zz": {"properties": {"q": {"required": True}}}}}, ("not a", "required"), ("true", "required"))
on_sparse("api_ignore_additional", {"properties": {"a": {}}, "additionalProperties": False}, options=Options(ignore_additional_items=True))
on_sparse("api_strict_draft4", {"additionalProperties": False}, ("n", "additionalProperties"), options=Options(strict_draft4=True))

# ---------------------------------------------------------------- combinators

STATUS, PRICE = {"o_orderstatus": {"enum": ["F"]}}, {"o_totalprice": {"maximum": 100000}}
F_BAD, P_BAD = "o_orderstatus <> 'F'", "o_totalprice > 100000"


def on_orders(name: str, root: dict, *codes: tuple[str, str]) -> None:
    on_table(name, "orders", "o_orderkey", {"o_orderstatus": {}, "o_totalprice": {}}, *codes, root=root)


on_orders("v_allOf", {"allOf": [{"properties": STATUS}, {"properties": PRICE}]}, (F_BAD, "allOf"), (F_BAD, "enum"), (P_BAD, "allOf"), (P_BAD, "maximum"))
on_orders("v_anyOf", {"anyOf": [{"properties": STATUS}, {"properties": PRICE}]}, *[(f"{F_BAD} and {P_BAD}", c) for c in ("anyOf", "enum", "maximum")])
on_orders("v_oneOf", {"oneOf": [{"properties": STATUS}, {"properties": PRICE}]}, *[(f"{F_BAD} and {P_BAD}", c) for c in ("oneOf.zero", "enum", "maximum")], (f"not ({F_BAD}) and not ({P_BAD})", "oneOf"))
on_orders("v_not", {"not": {"properties": STATUS}}, (f"not ({F_BAD})", "not"))
on_poly("walk_aggregate", {"anyOf": [{"type": "string"}, {"type": "array", "items": {"maximum": 6}}]}, *[("k in (0, 1, 2, 3, 6)", c) for c in ("anyOf", "string", "array")], *[("k = 5", c) for c in ("anyOf", "string", "maximum")])

# ---------------------------------------------------------------- references

CHAIN = {"properties": {"v": {"type": "integer"}, "next": {"$ref": "#/definitions/link"}}, "definitions": {"link": {"properties": {"v": {"type": "integer"}, "next": {"$ref": "#/definitions/link"}}}}}
check("walk_recursion", X.nested, "event_id", "doc", CHAIN, "events", ("event_id % 3 = 0", "integer"), options=LIMIT_OPTIONS)
check("v_recursion_deep", lambda spark, d: X.deep(spark, d, deal=True), "event_id", "doc", CHAIN, "events", ("event_id % 3 = 0", "integer"))
on_poly("walk_ref", {"$ref": "#/definitions/a~1b"}, ("k not in (4, 7)", "string"), root={"definitions": {"a/b": {"type": "string"}}})
on_poly("walk_ref_remote", {"$ref": "http://s.example/t#/types/0"}, ("k not in (2, 3, 7)", "number"), options=Options(loader=lambda uri: {"types": [{"type": "number"}]}))

# ---------------------------------------------------------------- error rows and messages


def _errors(df: DataFrame, validator: Validator, keys: list[str], column: str | None) -> DataFrame:
    """One row per error: keys, code, message, value, arg, path (joined by /)."""
    rows = df.select(*keys, F.inline(validator.result(df, column)["errors"]))
    return rows.withColumn("path", F.array_join("path", "/"))


def errors(name: str, fixture, keys: str, column: str | None, schema: dict, sql: str, fields: str, **options) -> None:
    QUERIES[name] = lambda spark, d: _errors(fixture(spark, d), Validator(schema, **options), keys.split(", "), column).select(*f"{keys}, {fields}".split(", "))
    SQL[name] = sql


_A = f"from {ARRAYS} t, unnest(generate_series(1, len(a))) u(i)"
errors("v_path", X.arrays, "event_id", "doc", {"items": {"maximum": 1}}, f"select event_id, 'maximum' as code, a[i]::varchar as value, '1' as arg, (i - 1)::varchar as path {_A} where a[i] > 1", "code, value, arg, path")
errors(
    "v_path_nested", X.poly, "event_id", "doc", {"properties": {"p": {"properties": {"a": {"type": "number", "maximum": 2}}, "additionalProperties": False}}},
    "select event_id, 'maximum' as code, (event_id % 5)::varchar as value, 'p/a' as path from events where event_id % 8 = 6 and event_id % 5 > 2 union all select event_id, 'additionalProperties', '\"x\"', 'p/b' from events where event_id % 8 = 6",
    "code, value, path",
)
_K = "select event_id, '{m}' as message from events where event_id % 8 not in (2, 7)"
for _name, _own, _options, _text in (
    ("m_default", {}, {}, "shall be an integer"),
    ("m_schema", {"messages": {"integer": "whole, please"}}, {}, "whole, please"),
    ("m_options", {}, {"messages": {"integer": "not whole"}}, "not whole"),
    ("m_gettext", {"messages": {"integer": "whole"}}, {"gettext": lambda s: f"~{s}"}, "~whole"),
):
    errors(_name, X.poly, "event_id", "doc", {"properties": {"p": {"type": "integer"} | _own}}, _K.format(m=_text), "message", **_options)
errors("m_fallback", X.poly, "event_id", "doc", {"properties": {"p": {"format": "abc"}}}, "select event_id, 'is no abc' as message from events where event_id % 8 = 4 and event_type not like '%abc%'", "message", formats={"abc": {"regexp": "abc", "message": "is no abc"}})

# ---------------------------------------------------------------- custom predicates


def _typed_rule(validator: Validator, schema: dict, v, ctx):
    return ctx.when(v.number() > schema["atMost"], "maximum", v, schema["atMost"])


on_table("u_conform_fn", "lineitem", LINE, {"l_quantity": {"conform": lambda v, ctx: v.number() > 5}}, ("l_quantity <= 5", "custom"))
on_table("u_conform_named", "lineitem", LINE, {"l_discount": {}, "l_tax": {"conform": {"above": ["l_discount", 0.01]}}}, ("not l_tax >= l_discount - 0.01::double", "custom.above"), custom={"above": lambda v, other, slack, ctx: v.number() >= ctx.parent.child(other).number() - F.lit(slack)})
check("u_extend_selector", lambda spark, d: X.table(spark, d, "lineitem").select(*LINE.split(", "), "l_quantity"), LINE, None, lambda: Validator.extend({"[atMost]": _typed_rule})({"properties": {"l_quantity": {"atMost": 40, "minimum": 3}}}), "lineitem", ("l_quantity > 40", "maximum"), ("l_quantity < 3", "minimum"))
check("api_factory", X.poly, "event_id", "doc", lambda: Validator.factory(str_length="codepoint")({"properties": {"p": {"maxLength": 5}}}), "events", ("event_id % 8 = 4 and length(event_type) > 5", "maxLength"))


def _pandas_check(spark: SparkSession, d: str) -> DataFrame:
    """A predicate as a pandas UDF: text of an even number of characters."""
    @F.pandas_udf("boolean")
    def even(s: pd.Series) -> pd.Series:
        return s.str.len() % 2 == 0

    df = X.table(spark, d, "part").select("p_partkey", "p_name")
    return verdicts(df, Validator({"properties": {"p_name": {"conform": lambda v, ctx: even(v.text())}}}), ["p_partkey"], None)


QUERIES["u_conform_pandas"] = _pandas_check
SQL["u_conform_pandas"] = _verdict_sql("p_partkey", "part", [("length(p_name) % 2 = 1", "custom")])


def _valid_lines(spark: SparkSession, d: str) -> DataFrame:
    """Only valid rows: on typed columns the schema becomes a filter that reaches the scan."""
    df = X.table(spark, d, "lineitem")
    schema = {"properties": {"l_quantity": {"type": "number", "maximum": 45}, "l_returnflag": {"enum": ["A", "N"]}}}
    return df.where(Validator(schema).is_valid(df)).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


QUERIES["api_validator"] = _valid_lines
SQL["api_validator"] = "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where l_quantity <= 45 and l_returnflag in ('A', 'N')"

# ---------------------------------------------------------------- normaliser


def normal(name: str, p: dict, sql: str, root: dict | None = None) -> None:
    """Output as JSON text, of the whole document."""
    schema = {"properties": {"p": p}} if root is None else root
    QUERIES[name] = lambda spark, d: X.poly(spark, d).select("event_id", F.to_json(Normalizer(schema).column(F.col("doc"))).alias("out"))
    SQL[name] = f"select event_id, case when v is null then '{{}}' else concat('{{\"p\":', v, '}}') end as out from (select event_id, {sql} as v from (select *, event_id % 8 as k, '[' || (user_id % 3) || ',' || (event_id % 3) || ',7]' as arr, '{{\"a\":' || (event_id % 5) || ',\"b\":\"x\"}}' as obj from events))"


_SAME = "case k when 0 then 'null' when 1 then 'true' when 2 then event_id::varchar when 3 then event_id || '.5' when 4 then '\"' || event_type || '\"' when 5 then arr when 6 then obj end"
normal("n_passthrough", {}, _SAME)
normal("n_object_noop", {"type": "object"}, _SAME)
normal("n_default", {"default": "none"}, f"case when k in (0, 7) then '\"none\"' else {_SAME} end")
normal("n_object_create", {"properties": {"c": {"default": 3}}}, f"case when k in (0, 7) then '{{\"c\":3}}' when k = 6 then '{{\"c\":3}}' else {_SAME} end")
normal("n_drop_additional", {"properties": {"a": {}}, "additionalProperties": True}, f"case when k in (0, 7) then '{{}}' when k = 6 then '{{\"a\":' || (event_id % 5) || '}}' else {_SAME} end")
normal("n_to_null", {"type": "null"}, "case when k = 7 then null else 'null' end")
normal("n_to_string", {"type": "string"}, "case k when 0 then 'null' when 1 then '\"true\"' when 2 then '\"' || event_id || '\"' when 3 then '\"' || event_id || '.5\"' when 4 then '\"' || event_type || '\"' when 5 then '\"' || (user_id % 3) || ',' || (event_id % 3) || ',7\"' when 6 then '\"[object Object]\"' end")
normal("n_to_integer", {"type": "integer"}, "case k when 2 then event_id::varchar when 3 then event_id::varchar when 5 then (user_id % 3)::varchar when 7 then null else 'null' end")
normal("n_to_number", {"type": "number"}, "case k when 2 then event_id::varchar when 3 then event_id || '.5' when 5 then (user_id % 3)::varchar when 7 then null else 'null' end")
normal("n_to_boolean", {"type": "boolean"}, "case k when 0 then 'null' when 7 then null else 'true' end")
normal("n_to_array", {"type": "array", "items": {"type": "string"}}, "case k when 0 then 'null' when 1 then '[\"true\"]' when 2 then '[\"' || event_id || '\"]' when 3 then '[\"' || event_id || '.5\"]' when 4 then '[\"' || event_type || '\"]' when 5 then '[\"' || (user_id % 3) || '\",\"' || (event_id % 3) || '\",\"7\"]' when 6 then '[\"[object Object]\"]' end")
normal("n_items", {"items": {"type": "boolean"}}, f"case when k = 5 then '[' || (user_id % 3 <> 0) || ',' || (event_id % 3 <> 0) || ',true]' else {_SAME} end")
normal("n_result", {}, "case when k = 7 then '\"root\"' end || '' ", root={"default": "unused", "properties": {"q": {}}})
SQL["n_result"] = "select event_id, '{}' as out from events"
QUERIES["n_recursion_deep"] = lambda spark, d: X.deep(spark, d, deal=True).select("event_id", F.to_json(Normalizer(CHAIN).column(F.col("doc"))).alias("out"))
SQL["n_recursion_deep"] = """select event_id, case when n = 0 then '{"next":{},' else repeat('{"next":', n) || '{' end || '"v":' || case when event_id % 3 = 0 then 'null' else '2' end || '}' || repeat(',"v":1}', n) as out
  from (select event_id, (event_id % 21)::int as n from events)"""


def _normalizer_api(spark: SparkSession, d: str) -> DataFrame:
    made = new_normalizer({"properties": {"p": {"type": "array", "default": []}}}).normalize(X.poly(spark, d), "doc", "out")
    return made.select("event_id", F.to_json("out").alias("out"))


QUERIES["api_normalizer"] = _normalizer_api
SQL["api_normalizer"] = f"""select event_id, '{{"p":' || case when k in (0, 7) then '[]' when k = 5 then v else '[' || v || ']' end || '}}' as out
  from (select event_id, k, {_SAME} as v from (select *, event_id % 8 as k, '[' || (user_id % 3) || ',' || (event_id % 3) || ',7]' as arr, '{{"a":' || (event_id % 5) || ',"b":"x"}}' as obj from events))"""

# ---------------------------------------------------------------- handlers that change the document


def rewritten(name: str, schema: dict, selectors: dict, parts: str) -> None:
    QUERIES[name] = lambda spark, d: X.sparse(spark, d).select("o_orderkey", F.to_json(Rewriter(schema, selectors=selectors).column(F.col("doc"))).alias("out"))
    SQL[name] = f"select o_orderkey, '{{' || array_to_string(list_filter([{parts}], lambda x: x is not null), ',') || '}}' as out from {SPARSE}"


_PART_X, _PART_Y = """case when x1 then '"x1":' || case when x1n then '1' else '"t"' end end""", """case when y then '"y":null' end"""
rewritten(
    "ctx_replace", {"properties": {"a": {"times": 3}, "b": {"fill": "none"}}},
    {
        "[times]": lambda s, v, place: Replace(F.when(v.absent, v.column).otherwise((v.number() * s["times"]).cast("bigint").cast("variant"))),
        "[times]:end": lambda s, v, place: Replace(F.when(v.number() == 3, F.lit(4).cast("variant")).otherwise(v.column)),
        "[fill]": lambda s, v, place: Replace(F.coalesce(v.column, F.lit(s["fill"]).cast("variant"))),
    },
    f"""case when a then '"a":4' end, case when b then '"b":"s"' else '"b":"none"' end, {_PART_X}, {_PART_Y}""",
)
rewritten(
    "ctx_remove", {"properties": {"a": {"secret": True}, "b": {}}, "additionalProperties": False},
    {"[secret]": lambda s, v, place: Remove(), "[additionalProperty]": lambda s, v, place: Remove(F.is_variant_null(v.column)), "[additionalProperty]:end": lambda s, v, place: STOP},
    f"""case when b then '"b":"s"' end, {_PART_X}""",
)
_BY_HAND = {
    "[default]": lambda s, v, place: None if place.is_root else Replace(F.when(v.absent | F.is_variant_null(v.column), F.lit(s["default"]).cast("variant")).otherwise(v.column)),
    "[additionalProperty]": lambda s, v, place: Remove(),
}
QUERIES["n_by_handlers"] = lambda spark, d: X.poly(spark, d).select("event_id", F.to_json(Rewriter({"properties": {"p": {"default": "none"}}}, selectors=_BY_HAND).column(F.col("doc"))).alias("out"))
SQL["n_by_handlers"] = SQL["n_default"]


class _Collected:
    """Selectors with state: which of a node's alternatives its value is."""

    def __init__(self):
        self.out: list[str] = []
        self.selectors = {
            "[either]": {"prepare": self.prepared},
            "[type=integer]": lambda s, v, c: self.out.append("i") if type(v) is int else None,
            "[type=string]": lambda s, v, c: self.out.append("s") if isinstance(v, str) else None,
        }

    @staticmethod
    def prepared(schema, ctx):
        ctx.compile(schema["either"], "either")
        return lambda s, v, c: [walk(v, c.path) for walk in c.either] and None

    def end(self):
        return "".join(self.out)


def _compiled(spark: SparkSession, d: str) -> DataFrame:
    walk = RuntimeWalk({"properties": {"p": {"either": [{"type": "integer"}, {"type": "string"}, {"items": {"type": "integer"}}]}}}, _Collected)
    return X.poly(spark, d, deal=True).select("event_id", walk.results(F.to_json("doc")).alias("out"))


QUERIES["ctx_compile"] = _compiled
SQL["ctx_compile"] = """select event_id, case event_id % 8 when 2 then '"i"' when 4 then '"s"' when 5 then '"iii"' else '""' end as out from events"""


def _forms(spark: SparkSession, d: str) -> DataFrame:
    """Handlers called at each visit, prepared ones of two arguments, and both forms by name."""
    selectors = {"[items]": {"prepare": lambda s, c: None}, ":item": {"inline": lambda s, v, c: v}, "[type]": lambda s, v, c: "r", "[maximum]": lambda s, c: lambda _s, v, _c: s["maximum"] - v}
    walk = RuntimeWalk({"items": {"type": "integer", "maximum": 9}}, selectors)
    rows = X.arrays(spark, d, deal=True).select("event_id", F.posexplode(walk.visits(F.to_json("doc"), ["selector", "output"])).alias("seq", "visit"))
    return rows.select("event_id", F.col("seq").cast("long").alias("seq"), "visit.selector", "visit.output")


QUERIES["handler_forms"] = _forms
SQL["handler_forms"] = f"""select event_id, 0::bigint as seq, '[items]' as selector, null::varchar as output from {ARRAYS}
  union all select event_id, (3 * (i - 1) + j)::bigint, [':item', '[type]', '[maximum]'][j], [a[i]::varchar, 'r', (9 - a[i])::varchar][j] {_A}, unnest([1, 2, 3]) w(j)"""


def _deep_visits(spark: SparkSession, d: str) -> DataFrame:
    walk = RuntimeWalk(CHAIN, {"[type=integer]": lambda s, v, c: len(c.path)})
    rows = X.deep(spark, d, deal=True).select("event_id", F.explode(walk.visits(F.to_json("doc"), ["path", "value", "output"])).alias("visit"))
    return rows.select("event_id", F.array_join("visit.path", "/").alias("path"), "visit.value", "visit.output")


QUERIES["walk_recursion_deep"] = _deep_visits
SQL["walk_recursion_deep"] = """select event_id, repeat('next/', i::int) || 'v' as path, case when i < event_id % 21 then '1' when event_id % 3 = 0 then '"s"' else '2' end as value, (i + 1)::varchar as output
  from events, unnest(generate_series(0, (event_id % 21)::int)) u(i) union all select event_id, 'next/v', null, '2' from events where event_id % 21 = 0"""

# ---------------------------------------------------------------- iterator

WALKED = {"mark": 0, "properties": {"a": {"mark": 1, "type": "integer"}, "b": {"mark": 2, "required": False}}, "patternProperties": {"^x": {"mark": 3}}, "additionalProperties": {"mark": 1}}


def selected(name: str, selector: str, sql: str, more: dict | None = None) -> None:
    """Visits of a selector over the sparse documents: o_orderkey, path, value."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        walk = Walk(WALKED, {selector: lambda s, v, c: None} | (more or {}))
        rows = walk.visits(X.sparse(spark, d), "doc", ["o_orderkey"])
        return rows.where(F.col("selector") == selector).select("o_orderkey", F.array_join("path", "/").alias("path"), F.coalesce(F.when(F.size("path") > 0, F.col("value")), F.lit("")).alias("value"))

    QUERIES[name] = query
    SQL[name] = " union all ".join(f"select o_orderkey, {p} as path, {v} as value from {SPARSE} where {c}" for p, v, c in _visits(sql))


_ROOT, _A1, _B2 = ("''", "''", "true"), ("'a'", "case when a then '1' else '' end", "true"), ("'b'", "case when b then '\"s\"' else '' end", "true")
_X3, _Y1 = ("'x1'", "case when x1n then '1' else '\"t\"' end", "x1"), ("'y'", "'null'", "y")


def _visits(names: str) -> list[tuple[str, str, str]]:
    return [{"root": _ROOT, "a": _A1, "b": _B2, "x": _X3, "y": _Y1}[n] for n in names.split()]


selected("sel_attr", "[mark]", "root a b x y")
selected("sel_not_attr", "[^type]", "root b x y")
selected("sel_eq", "[mark=1]", "a y")
selected("sel_neq", "[^mark=1]", "root b x")
selected("sel_and", "[mark=1][type=integer]", "a")
selected("sel_start", "[mark=3]:start", "x")
selected("sel_end", "[mark=0]:end", "root")
selected("sel_value_parse", "[required=false]", "b")
selected("sel_anylevel", "[mark=2]", "b")
selected("sel_stop", "[^type]", "b x y", more=None)
QUERIES["sel_stop"] = lambda spark, d: _stopped(spark, d)


def _stopped(spark: SparkSession, d: str) -> DataFrame:
    walk = Walk(WALKED, {"[mark=0]": lambda s, v, c: STOP, "[^type]": lambda s, v, c: None})
    rows = walk.visits(X.sparse(spark, d), "doc", ["o_orderkey"]).where("selector = '[^type]'")
    return rows.select("o_orderkey", F.array_join("path", "/").alias("path"), F.coalesce("value", F.lit("")).alias("value"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    walk = Walk({"items": {"type": "integer"}}, {":item": lambda s, v, c: None, ":item-end": lambda s, v, c: None, "[type]": lambda s, v, c: None})
    rows = walk.visits(X.arrays(spark, d), "doc", ["event_id"])
    return rows.select("event_id", F.col("seq").cast("long").alias("seq"), "selector", F.array_join("path", "/").alias("path"), "value")


QUERIES["sel_item"] = _items
SQL["sel_item"] = f"select event_id, (3 * (i - 1) + j - 1)::bigint as seq, [':item', '[type]', ':item-end'][j] as selector, (i - 1)::varchar as path, a[i]::varchar as value {_A}, unnest([1, 2, 3]) w(j)"


def visited(name: str, fixture, key: str, walk: Walk, sql: str, fields: str = "seq, selector, path, value") -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = walk.visits(fixture(spark, d), "doc", [key])
        return rows.withColumns({"seq": F.col("seq").cast("long"), "path": F.array_join("path", "/")}).select(key, *fields.split(", "))

    QUERIES[name], SQL[name] = query, sql


_SEEN = lambda s, v, c: None
visited(
    "walk_phases", X.arrays, "event_id", Walk({"t": 1, "properties": {"q": {"t": 3}}, "items": {"t": 2}}, {"[t]": _SEEN, "[t]:end": _SEEN, "[t]:start": _SEEN}),
    f"""with d as (select event_id, len(a) as n, a from {ARRAYS}) select event_id, 0::bigint as seq, '[t]:start' as selector, '' as path from d union all select event_id, 1, '[t]', '' from d
      union all select event_id, 2 + 3 * (i - 1) + j - 1, ['[t]:start', '[t]', '[t]:end'][j], (i - 1)::varchar from d, unnest(generate_series(1, n)) u(i), unnest([1, 2, 3]) w(j)
      union all select event_id, 2 + 3 * n + j - 1, ['[t]:start', '[t]', '[t]:end'][j], 'q' from d, unnest([1, 2, 3]) w(j) union all select event_id, 5 + 3 * n, '[t]:end', '' from d""",
    "seq, selector, path",
)
visited(
    "sel_order", X.arrays, "event_id", Walk({"items": {"a": 1, "b": 2, "c": 3}}, {"[c]": _SEEN, "[a]": _SEEN, "[b=2]": lambda s, v, c: STOP, "[b]": _SEEN}),
    f"select event_id, (3 * (i - 1) + j - 1)::bigint as seq, ['[c]', '[a]', '[b=2]'][j] as selector {_A}, unnest([1, 2, 3]) w(j)", "seq, selector",
)
visited(
    "walk_path", X.poly, "event_id", Walk({"properties": {"p": {"items": {"w": 1}, "properties": {"a": {"w": 1}}, "patternProperties": {"^b": {"w": 1}}, "additionalProperties": {"w": 1}}}, "additionalProperties": {"w": 1}}, {"[w]": _SEEN}),
    "select event_id, 'p/a' as path from events union all select event_id, 'p/' || i from events, unnest([0, 1, 2]) u(i) where event_id % 8 = 5 union all select event_id, 'p/b' from events where event_id % 8 = 6", "path",
)
visited(
    "sel_grammar", X.sparse, "o_orderkey", Walk({"properties": {"a": {"x-a_b": "v-1", "t": 1}, "b": {"t": "a b", "u": ""}}}, {"[x-a_b=v-1][t=1]": _SEEN, '[t="a b"]:end': _SEEN, "[^t][u]": _SEEN, "other": _SEEN}),
    "select o_orderkey, '[x-a_b=v-1][t=1]' as selector, 'a' as path from orders union all select o_orderkey, '[t=\"a b\"]:end', 'b' from orders", "selector, path",
)
visited("ctx_reset", X.arrays, "event_id", Walk({"items": {}}, {":item": _SEEN}, path=("in", "doc")), f"select event_id, 'in/doc/' || (i - 1) as path {_A}", "path")


class _Marked:
    """Selectors as a class: each walk makes one."""

    def __init__(self):
        self.selectors = {"[mark=3]": lambda s, v, c: "three"}


def _factories(spark: SparkSession, d: str) -> DataFrame:
    """Selectors from a class, and from a function."""
    df = X.sparse(spark, d)
    made = [new_iterator(WALKED, _Marked), new_iterator(WALKED, lambda: {"[mark=2]": lambda s, v, c: "two"})]
    return made[0].visits(df, "doc", ["o_orderkey"]).unionByName(made[1].visits(df, "doc", ["o_orderkey"])).select("o_orderkey", "output")


QUERIES["api_to_factory"] = _factories
SQL["api_to_factory"] = f"select o_orderkey, 'three' as output from {SPARSE} where x1 union all select o_orderkey, 'two' from {SPARSE}"


def _schema_only(spark: SparkSession, d: str) -> DataFrame:
    walk = Walk({"properties": {"p1": {"items": {"t": 1, "properties": {"q": {"t": 2}}}}}}, {"[t]": lambda s, v, c: None})
    return walk.schema_visits(spark).select(F.col("seq").cast("long").alias("seq"), F.array_join("path", "/").alias("path"))


QUERIES["walk_schema_only"] = _schema_only
SQL["walk_schema_only"] = "select 0::bigint as seq, 'p1/[]' as path union all select 1, 'p1/[]/q'"



def _no_schema_only(spark: SparkSession, d: str) -> DataFrame:
    walk = Walk({"properties": {"p1": {"items": {"t": 1}}, "z": {"t": 3}}}, {"[t]": _SEEN}, Options(ignore_schema_only=True))
    return walk.schema_visits(spark).select(F.array_join("path", "/").alias("path"))


QUERIES["api_ignore_schema_only"], SQL["api_ignore_schema_only"] = _no_schema_only, "select 'z' as path"

FORM = {"properties": {"name": {"type": "string", "required": True}, "segment": {"type": "string", "enum": ["BUILDING", "OTHER"]}}}


def _form(spark: SparkSession, d: str) -> DataFrame:
    df = X.table(spark, d, "customer").select("c_custkey", F.to_variant_object(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("doc"))
    return df.select("c_custkey", form(FORM).fold(df, "doc").alias("html"))


QUERIES["r_form"] = _form
SQL["r_form"] = """select c_custkey, '<input type=''string'' value=''' || c_name || ''' name=''name'' required >' || chr(10) || '<select  name=''segment''>' || chr(10)
  || '<option value=''BUILDING'' ' || case when c_mktsegment = 'BUILDING' then 'selected' else '' end || '>BUILDING</option>' || chr(10)
  || '<option value=''OTHER'' >OTHER</option>' || chr(10) || '</select>' || chr(10) as html from customer"""


def _compile_api(spark: SparkSession, d: str) -> DataFrame:
    df = X.table(spark, d, "nation").select("n_nationkey", F.to_variant_object(F.struct("n_name")).alias("doc"))
    walk = new_iterator({"properties": {"n_name": {"type": "string"}}}, dict(FORM_SELECTORS), begin="<form>\n", end=lambda text: F.concat(text, F.lit("</form>")))
    return df.select("n_nationkey", walk.fold(df, "doc").alias("html"))


QUERIES["api_compile"] = _compile_api
SQL["api_compile"] = "select n_nationkey, replace('<form>~<input type=^string^ value=^' || n_name || '^ name=^n_name^>~</form>', '^', chr(39)).replace('~', chr(10)) as html from nation"


def _begin_end(spark: SparkSession, d: str) -> DataFrame:
    """begin and end around a fold: how many integers a document holds."""
    walk = Walk({"items": {}}, {":item": lambda s, v, c: "x"}, begin="##", end=lambda text: F.length(text) - 2)
    df = X.arrays(spark, d)
    return df.select("event_id", F.coalesce(walk.fold(df, "doc"), F.lit(0)).cast("long").alias("n"))


QUERIES["sel_begin_end"] = _begin_end
SQL["sel_begin_end"] = f"select event_id, len(a)::bigint as n from {ARRAYS}"

# ---------------------------------------------------------------- JSON text and streams

EVENT_PROPS = {"type": "object", "properties": {"k": {"type": "integer", "required": True, "maximum": 90}}}


def events_props(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: events' JSON text parsed and validated, with its codes."""
    df = X.table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return verdicts(df, Validator(EVENT_PROPS), ["event_id"], "doc")


QUERIES["src_json"] = events_props
SQL["src_json"] = _verdict_sql("event_id", "(select event_id, (props->>'k')::int as n from events)", [("n > 90", "maximum")])


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='docloom-')).rstrip('/')}/docloom-{uuid.uuid4().hex}"


def _sink(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    at = _folder(spark)
    write_json(X.sparse(spark, d).select(F.to_variant_object(F.struct("o_orderkey", "doc")).alias("doc")), "doc", at)
    return read_json_lines(spark, at).select(F.variant_get("doc", "$.o_orderkey", "bigint").alias("o_orderkey"), F.to_json(F.variant_get("doc", "$.doc", "variant")).alias("out"), "malformed")


QUERIES["sink_json"] = _sink
SQL["sink_json"] = f"""select o_orderkey, '{{' || array_to_string(list_filter([case when a then '"a":1' end, case when b then '"b":"s"' end, {_PART_X}, {_PART_Y}], lambda x: x is not null), ',') || '}}' as out, false as malformed from {SPARSE}"""


def _schema_file(spark: SparkSession, d: str) -> DataFrame:
    """A schema written as a JSON file, read, and used."""
    at = _folder(spark)
    spark.createDataFrame([(json.dumps(EVENT_PROPS, indent=1),)], "value string").coalesce(1).write.text(at)
    df = X.table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return verdicts(df, Validator(read_schema(spark, at)), ["event_id"], "doc")


QUERIES["src_schema_file"], SQL["src_schema_file"] = _schema_file, SQL["src_json"]


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream of the events file, run until all that is there is done."""
    from docloom.streaming import read_folder, validate_stream

    at = _folder(spark)
    source = f"{d}/events.parquet"
    stream = read_folder(spark, f"{d}/events.parque[t]", spark.read.parquet(source).schema).select("event_id", F.try_parse_json("props").alias("doc"))
    validate_stream(stream, Validator(EVENT_PROPS), "doc", f"{at}/out", f"{at}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{at}/out")
    return got.select("event_id", "result.valid", F.size("result.errors").cast("long").alias("n_errors"), F.array_join(F.transform("result.errors", lambda e: e["code"]), ",").alias("codes"))


QUERIES["stream_validate"], SQL["stream_validate"] = _stream, SQL["src_json"]
