"""Validator: golden behaviours, options and extension, each schema's documents in one DataFrame."""

import json

import pytest
from pyspark.sql import functions as F

from docloom import Options, Validator, new_validator
from docloom.plans.pyeval import ABSENT, Evaluator, deep_validator


def results(spark, schema, docs, validator=None, **options):
    rows = [(i, None if d is ABSENT else json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("v"))
    v = validator or Validator(schema, **options)
    got = v.validate(df, "v").select("i", "result", v.is_valid(df, "v").alias("ok")).orderBy("i").collect()
    assert all(r["ok"] == r["result"]["valid"] == (not r["result"]["errors"]) for r in got)
    return [r["result"]["errors"] for r in got]


def codes(spark, schema, docs, **options):
    return [[e["code"] for e in r] for r in results(spark, schema, docs, **options)]


def paths(spark, schema, docs, **options):
    return [[e["path"] for e in r] for r in results(spark, schema, docs, **options)]


CASES = [
    ({"type": "boolean"}, [True, False, 1, "hello", {}], [[], [], ["boolean"], ["boolean"], ["boolean"]]),
    ({"type": "integer"}, [1, 1.0, 1.1, "string", True, "1"], [[], [], ["integer"], ["integer"], ["integer"], ["integer"]]),
    ({"type": "integer", "multipleOf": 11}, [11, 0, 22, 12, 10, 1], [[], [], [], ["multipleOf"], ["multipleOf"], ["multipleOf"]]),
    ({"multipleOf": 0.1}, [0.2, 0.3, 1], [[], ["multipleOf"], []]),
    ({"multipleOf": 0}, [3], [["multipleOf"]]),
    ({"minimum": 3, "maximum": 5}, [2, 3, 5, 6, "2", None, True], [["minimum"], [], [], ["maximum"], [], [], []]),
    ({"minimum": 3, "exclusiveMinimum": True}, [3, 4], [["minimum.exclusive"], []]),
    ({"type": "string", "minLength": 3, "maxLength": 4}, ["12", "123", "12345", 7], [["minLength"], [], ["maxLength"], ["string"]]),
    ({"pattern": "^[ab][12]$"}, ["a1", "c1", "a1\n", 5], [[], ["pattern"], ["pattern"], []]),
    ({"enum": [1, "x", None, {"a": [1]}]}, [1, "1", "x", None, {"a": [1]}, 2], [[], [], [], [], [], ["enum"]]),
    ({"type": ["string", "null"]}, ["a", None, 1], [[], [], ["string", "null"]]),
    ({"type": "any"}, [1, {}], [[], []]),
    ({"uniqueItems": True}, [[1, "1"], [1, 2], [{"a": 1}, {"a": 1}, {"a": 1}], "aa"], [["uniqueItems"], [], ["uniqueItems"] * 2, []]),
    ({"minItems": 1, "maxItems": 2}, [[], [1], [1, 2, 3], {}], [["minItems"], [], ["maxItems"], []]),
    ({"minProperties": 1, "maxProperties": 1}, [{}, {"a": 1}, {"a": 1, "b": 2}, [1, 2], None], [["minProperties"], [], ["maxProperties"], ["maxProperties"], []]),
    ({"not": {"type": "string"}}, ["a", 1], [["not"], []]),
    ({"allOf": [{"minimum": 3}, {"maximum": 1}]}, [2], [["allOf", "minimum", "allOf", "maximum"]]),
    ({"anyOf": [{"minimum": 3}, {"maximum": 1}]}, [2, 0], [["anyOf", "minimum", "maximum"], []]),
    ({"oneOf": [{"minimum": 3}, {"minimum": 5}]}, [1, 4, 6], [["oneOf.zero", "minimum", "minimum"], [], ["oneOf"]]),
    ({"dependencies": {"a": ["b"]}}, [{"a": 1}, {"a": 1, "b": 1}, 5], [["dependency", "required"], [], []]),
    ({"properties": {"foo-bar": {"type": "string"}, "a b": {"required": True}}}, [{"foo-bar": 1}, {"a b": 1}], [["string", "required"], []]),
    ({"required": ["a"]}, [{}, {"a": None}, []], [["required"], [], []]),
]


@pytest.mark.parametrize("schema, docs, expected", CASES, ids=[json.dumps(c[0])[:40] for c in CASES])
def test_codes(spark, schema, docs, expected):
    assert codes(spark, schema, docs) == expected
    assert [[c for c, *_ in Evaluator(schema).errors(d)] for d in docs] == expected


def test_required_and_paths(spark):
    assert paths(spark, {"properties": {"a": {"required": True}}}, [{}, {"a": None}, {"a": 3}]) == [[["a"]], [], []]
    assert paths(spark, {"items": {"required": True, "type": "string"}}, [["1", "2", None]]) == [[["2"]]]
    assert paths(spark, {"items": {"items": {"type": "number"}}}, [[[1, 2], [3, "4"]]]) == [[["1", "1"]]]
    assert paths(spark, {"items": [{"type": "number"}], "additionalItems": False}, [[1, 2, 3]]) == [[["1"], ["2"]]]
    assert paths(spark, {"properties": {"a": {}}, "additionalProperties": False}, [{"a": 10, "b": 20}]) == [[["b"]]]
    schema = {"properties": {"a": {"items": {"oneOf": [{"properties": {"b": {"type": "string"}}}]}}}}
    assert paths(spark, schema, [{"a": [{"b": "x"}, {"b": 5}]}]) == [[["a", "1"], ["a", "1", "b"]]]


def test_quirks(spark):
    # a required child of an absent optional parent is missed too; an array as required lifts the guard
    assert paths(spark, {"properties": {"a": {"properties": {"b": {"required": True}}}}}, [{}]) == [[["a", "b"]]]
    assert codes(spark, {"properties": {"a": {"type": "object", "required": ["b"]}}}, [{}]) == [["object"]]
    assert codes(spark, {"additionalProperties": False}, [{"a": 1}]) == [[]]
    assert codes(spark, {"additionalProperties": False}, [{"a": 1}], options=Options(strict_draft4=True)) == [["additionalProperties"]]
    assert codes(spark, {"uniqueItems": False}, [[1, 1]]) == [["uniqueItems"]]
    assert codes(spark, {"uniqueItems": False}, [[1, 1]], options=Options(strict_draft4=True)) == [[]]
    assert codes(spark, {"enum": [1]}, ["1"], options=Options(strict_draft4=True)) == [["enum"]]
    # sub-errors of a dependency have paths of their own
    assert paths(spark, {"properties": {"q": {"dependencies": {"a": ["b"]}}}}, [{"q": {"a": 1}}]) == [[["q"], ["b"]]]
    # literals with underscores and slashes are kept
    assert codes(spark, {"pattern": "^a_/b$"}, ["a_/b", "ab"]) == [[], ["pattern"]]
    # custom messages reach descendants until a node with messages ends
    deep = {"messages": {"string": "outer"}, "properties": {"a": {"type": "string"}, "b": {"messages": {"number": "x"}}, "c": {"type": "string"}}}
    assert [e["message"] for e in results(spark, deep, [{"a": 1, "b": 1, "c": 1}])[0]] == ["outer", "shall be a string"]


def test_js_coercion_and_start_path(spark):
    bound = {"minimum": 3}
    assert codes(spark, bound, ["2", "4", "x", None, True, "", [1]]) == [[]] * 7
    low = ["minimum"]
    assert codes(spark, bound, ["2", "4", "x", None, True, "", [1]], options=Options(js_coercion=True)) == [low, [], [], low, low, low, []]
    assert paths(spark, {"properties": {"a": {"type": "string"}}}, [{"a": 1}], path=("orders", "7")) == [[["orders", "7", "a"]]]


def test_source_of(spark):
    from docloom import source_of

    df = spark.range(3).selectExpr("id", "cast(id as double) q")
    assert "WholeStageCodegen" in source_of(df.where(Validator({"properties": {"q": {"maximum": 1}}}).is_valid(df))) or "Generated code" in source_of(df)


def test_compile_errors():
    import pyspark.sql.functions as functions

    from docloom.functions.values import VariantValue

    for schema in ({"format": "unknown"}, {"anyOf": []}, {"type": ["strange"]}, {"$ref": "#/nowhere"}, {"conform": {"missing": True}}, {"$ref": "http://x/y#"}):
        with pytest.raises(ValueError):
            Validator(schema).piece(VariantValue(functions.lit(1)))


def test_messages_custom_and_extension(spark):
    def messages(schema, docs, **options):
        return [[e["message"] for e in r] for r in results(spark, schema, docs, **options)]

    assert messages({"maximum": 3}, [4]) == [["shall be <= %d"]]
    assert messages({"minimum": 3, "maximum": 1, "messages": {"minimum": "min!"}}, [2]) == [["min!", "shall be <= %d"]]
    assert messages({"minimum": 3, "messages": {"minimum": "hello"}}, [2], gettext=lambda s: f"~{s}") == [["~hello"]]
    assert messages({"conform": lambda v, ctx: v.number() > 5}, [5, 6]) == [["is not valid"], []]
    larger = {"larger": lambda v, n, ctx: v.number() > n}
    found = results(spark, {"conform": {"larger": [5]}}, [5, 6], custom=larger)
    assert [[e["code"] for e in r] for r in found] == [["custom.larger"], []]
    siblings = {"properties": {"a": {"type": "number"}, "b": {"conform": {"above": True}}}}
    above = {"above": lambda v, ctx: v.number() > ctx.parent.child("a").number()}
    assert codes(spark, siblings, [{"a": 1, "b": 2}, {"a": 2, "b": 1}], custom=above) == [[], ["custom.above"]]
    Own = Validator.extend({"[minLength]": lambda validator, schema, v, ctx: None, "[fail]": lambda validator, schema, v, ctx: ctx.when(F.lit(True), "fail", v, "fail!")})
    errors = results(spark, None, ["a"], validator=new_validator({"type": "string", "minLength": 3, "fail": 1}, Own))
    assert [[(e["code"], e["message"]) for e in r] for r in errors] == [[("fail", "fail!")]]
    with pytest.raises(ValueError):
        results(spark, {"type": "string"}, [1], messages={"number": "n"})


def test_lengths(spark):
    face = "\U0001f600a"
    assert codes(spark, {"maxLength": 2}, [face]) == [["maxLength"]]
    assert codes(spark, {"maxLength": 2}, [face], str_length="codepoint") == [[]]
    assert codes(spark, {"minLength": 4}, ["abcdef"], str_length=lambda s: F.lit(3)) == [["minLength"]]


FORMATS = {
    "email": (["a@b.com"], ["ab.com", "a@b@c"]),
    "date-time": (["2020-00-99t99:99:99+00:00", "2020-12-01T10:00:00.5Z"], ["2020-13-01T10:00:00Z", "2020-12-01T10:00:00"]),
    "ipv4": (["01.2.3.4", "255.255.255.255"], ["256.1.1.1", "1.2.3", "1.2.3.4\n"]),
    "ipv6": ([" ::1 ", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::", "1:2::3:4", "::"], ["1:2:3:4:5:6:7", "12345::", "1::2::3", "::256.1.1.1"]),
    "uri": (["a,b:x", "http://x"], ["1:x", "http://a b"]),
    "hostname": (["a.b", "a" * 63], ["a" * 64, "-a", "a..b"]),
}


@pytest.mark.parametrize("name", FORMATS)
def test_formats(spark, name):
    good, bad = FORMATS[name]
    assert codes(spark, {"format": name}, good + bad + [5]) == [[]] * len(good) + [[f"format.{name}"]] * len(bad) + [[]]


def test_references(spark):
    chain = {"properties": {"v": {"type": "integer"}, "next": {"$ref": "#"}}}
    deep = {"v": "x"}
    for _ in range(4):
        deep = {"v": 1, "next": deep}
    assert paths(spark, chain, [deep]) == [[["next"] * 4 + ["v"]]]
    assert codes(spark, chain, [deep], options=Options(max_depth=2)) == [["integer"]]  # by the evaluator of single values
    own = Options(max_depth=2), {}, {"any": lambda v, ctx: v.absent | ~v.absent}  # a predicate on columns cannot go there
    df = spark.createDataFrame([(json.dumps(deep),)], "j string").select(F.parse_json("j").alias("doc"))
    assert [e["code"] for e in df.select(Validator(chain, *own).result(df, "doc")["errors"]).first()[0]] == ["depth_exceeded"]
    for _ in range(30):
        deep = {"v": 1, "next": deep}
    df = spark.createDataFrame([(json.dumps(deep),), (None,)], "j string")
    got = df.select(deep_validator(chain)("j").alias("e")).collect()
    assert [e["path"] for e in got[0]["e"]] == [["next"] * 34 + ["v"]] and got[1]["e"] == []
    escaped = {"definitions": {"a/b~c": {"type": "string"}, "list": [{}, {"type": "number"}]}, "properties": {"x": {"$ref": "#/definitions/a~1b~0c"}, "y": {"$ref": "#/definitions/list/1"}}}
    assert codes(spark, escaped, [{"x": 1, "y": "n"}]) == [["string", "number"]]
    # inside a combinator a reference is to the whole document
    inner = {"definitions": {"s": {"type": "string"}}, "anyOf": [{"$ref": "#/definitions/s"}]}
    assert codes(spark, inner, ["a", 1]) == [[], ["anyOf", "string"]]


def test_typed_rows_match_variants(spark):
    df = spark.createDataFrame([(1, 2.5, "a", [1, 2, 2], None), (None, 7.0, "zz", [], "q"), (3, 9.0, None, None, "r")], "i int, d double, s string, l array<int>, t string")
    schema = {"properties": {"i": {"type": "integer", "maximum": 2, "required": True}, "d": {"type": "integer"}, "s": {"enum": ["a", "b"], "maxLength": 1}, "l": {"uniqueItems": True, "minItems": 1, "items": {"minimum": 2}}}, "additionalProperties": False}
    v = Validator(schema)
    typed = df.select(v.result(df)["errors"].alias("e"))
    doc = df.select(F.parse_json(F.to_json(F.struct("*"))).alias("v"))
    variant = doc.select(v.result(doc, "v")["errors"].alias("e"))
    show = lambda rows: [[(e["code"], e["path"]) for e in r["e"]] for r in rows.collect()]
    assert show(typed) == show(variant)
    plan = df.where(v.is_valid(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as double) q", "'x' r").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    v = Validator({"properties": {"q": {"type": "number", "maximum": 45}, "r": {"enum": ["x", "y"]}}})
    got = df.where(v.is_valid(df)).select("id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 46 and "PushedFilters" in plan


def test_json_sources(spark):
    from docloom.sources.documents import from_json

    got = from_json(spark.createDataFrame([("{",), ("1",), (None,)], "j string"), "j").select("malformed", F.to_json("doc")).collect()
    assert [tuple(r) for r in got] == [(True, None), (False, "1"), (False, None)]


def test_stream_equals_batch(spark, tmp_path):
    from docloom.streaming import read_folder, validate_stream

    data = spark.range(50).selectExpr("id", "concat('{\"k\":', id, '}') props")
    data.write.parquet(str(tmp_path / "in"))
    v = Validator({"properties": {"k": {"maximum": 20}}})
    batch = v.validate(data.select("id", F.parse_json("props").alias("doc")), "doc").select("id", "result.valid")
    stream = read_folder(spark, str(tmp_path / "in"), data.schema).select("id", F.parse_json("props").alias("doc"))
    validate_stream(stream.select("id", "doc"), v, "doc", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("id", "result.valid").collect())) == sorted(map(tuple, batch.collect()))
