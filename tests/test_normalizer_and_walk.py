"""Normaliser, iterator and form renderer."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators.normalize import Rewriter
from docloom import STOP, Normalizer, Options, Walk, compile_walk, form
from docloom.plans.selectors import parse


def normalized(spark, schema, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    return [json.loads(r["o"]) for r in Normalizer(schema).normalize(df, "v").select("i", F.to_json("v").alias("o")).orderBy("i").collect()]


def test_defaults(spark):
    schema = {"properties": {"intProp": {"type": "integer", "default": 10}, "strProp": {"default": "test"}}}
    assert normalized(spark, schema, [{}, {"intProp": None, "strProp": "x"}]) == [{"intProp": 10, "strProp": "test"}, {"intProp": 10, "strProp": "x"}]
    assert normalized(spark, {"items": {"default": {"obj": True}}}, [[None, "test"]]) == [[{"obj": True}, "test"]]
    assert normalized(spark, {"properties": {"a": {"properties": {"b": {"default": 3}}}}}, [{}]) == [{"a": {"b": 3}}]
    assert normalized(spark, {"properties": {"a": {"default": {}, "properties": {"b": {"default": 3}}}}}, [{}, {"a": None}]) == [{"a": {"b": 3}}] * 2
    assert normalized(spark, {"default": {"x": 1}, "properties": {}}, [None]) == [{"x": 1}]


def test_dropping(spark):
    one = {"properties": {"oneProp": {}}}
    assert normalized(spark, one, [{"oneProp": 10, "secondProp": 5}, 7]) == [{"oneProp": 10}, 7]
    assert normalized(spark, one | {"additionalProperties": True}, [{"oneProp": 1, "b": 5}]) == [{"oneProp": 1}]
    assert normalized(spark, {}, [{"a": 1}]) == [{"a": 1}]
    kept = {"properties": {"a": {}}, "patternProperties": {"^x": {"type": "number"}}, "additionalProperties": {"type": "string"}}
    assert normalized(spark, kept, [{"a": 1, "x1": "7", "y": 2}]) == [{"a": 1, "x1": 7, "y": "2"}]
    assert normalized(spark, {"items": [{"type": "string"}]}, [[1, 2, 3]]) == [["1", 2, 3]]


def test_coercion(spark):
    kinds = {"i": "integer", "n": "number", "s": "string", "b": "boolean", "a": "array", "u": "null", "o": "object"}
    schema = {"properties": {k: {"type": t} for k, t in kinds.items()}}
    docs = [{"i": "10", "n": ["22.2"], "s": 5, "b": "false", "a": 77, "u": 33, "o": -5}, {"i": 1, "n": 2.5, "s": "s", "b": True, "a": [1], "u": None, "o": {}}, dict.fromkeys("insbau")]
    assert normalized(spark, schema, docs) == [{"i": 10, "n": 22.2, "s": "5", "b": False, "a": [77], "u": None, "o": -5}, docs[1], docs[2]]
    odd = [{"i": "10abc", "n": "1e2x", "s": 1e21, "b": "0"}, {"i": "x", "n": "", "s": 0.1, "b": ""}, {"s": 1e-7, "b": "ON"}, {"s": [1, [2], None], "b": 0}, {"s": 123456789.5, "b": []}]
    got = normalized(spark, schema, odd)
    assert got[0] == {"i": 10, "n": 100, "s": "1e+21", "b": True}
    assert got[1] == {"i": None, "n": None, "s": "0.1", "b": False}
    assert got[2] == {"s": "1e-7", "b": True}
    assert got[3]["b"] is False and got[4] == {"s": "123456789.5", "b": True}


def visits(spark, schema, selectors, doc, options=None):
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("v"))
    rows = Walk(schema, dict.fromkeys(selectors, lambda s, v, c: None) if not isinstance(selectors, dict) else selectors, options or Options()).visits(df, "v", []).collect()
    return [(r["selector"], "/".join(r["path"])) for r in rows]


def test_selectors(spark):
    schema = {"a": 1, "properties": {"p": {"a-b": "x-y", "f": False}, "q": {"a": 2}}}
    assert visits(spark, schema, ["[a]", "[a=1]", "[^a]", "[^a=1]", "[a-b=x-y]", "[f]", "[a=2]"], {}) == [("[a]", ""), ("[a=1]", ""), ("[^a]", "p"), ("[^a=1]", "p"), ("[a-b=x-y]", "p"), ("[f]", "p"), ("[a]", "q"), ("[^a=1]", "q"), ("[a=2]", "q")]
    items = {"items": {"t": 1}}
    order = visits(spark, items, [":start", ":end", ":item", ":item-end", "[t]"], [5, 6])
    assert order == [(":start", ""), *[(s, i) for i in "01" for s in (":item", ":start", "[t]", ":end", ":item-end")], (":end", "")]
    assert visits(spark, {"a": 1}, {"[a]": lambda s, v, c: STOP, "[a=1]": lambda s, v, c: None}, 1) == [("[a]", "")]
    assert visits(spark, {"items": [{"t": 1}], "additionalItems": {"t": 2}}, ["[t]", ":item"], [1, 2, 3]) == [("[t]", "0"), ("[t]", "1"), ("[t]", "2")]
    assert visits(spark, {"properties": {}, "additionalProperties": False}, ["[additionalProperty=false]"], {"z": 1}) == []
    assert visits(spark, {"properties": {"a": {}}}, ["[additionalProperty=allowed]"], {"z": 1}) == [("[additionalProperty=allowed]", "z")]
    assert visits(spark, {"properties": {"a": {}}}, ["[additionalProperty]"], {"z": 1}, Options(ignore_additional_items=True)) == []
    with pytest.raises(ValueError):
        parse("[a b]")
    with pytest.raises(TypeError):
        compile_walk({}, 5)
    assert parse("[a=1.5]").tests[0].value == 1.5 and parse('[a="x y"]:end').phase == "end"


def test_schema_only(spark):
    schema = {"properties": {"p1": {"items": {"t": 1}}}}
    made = Walk(schema, {"[t]": lambda s, v, c: None})
    assert [r["path"] for r in made.schema_visits(spark).collect()] == [["p1", "[]"]]
    assert Walk(schema, {"[t]": lambda s, v, c: None}, Options(ignore_schema_only=True)).schema_visits(spark).count() == 0


def test_form(spark):
    schema = {"properties": {"first": {"type": "string", "required": True}, "gender": {"type": "string", "enum": ["male", "female"]}, "books": {"type": "array", "items": {"properties": {"name": {"type": "string"}}}}}}
    df = spark.createDataFrame([('{"first":"frodo","gender":"male","books":[{"name":"Lord"}]}',)], "j string").select(F.parse_json("j").alias("v"))
    html = df.select(form(schema).fold(df, "v")).first()[0]
    assert html == (
        "<input type='string' value='frodo' name='first' required >\n<select  name='gender'>\n<option value='male' selected>male</option>\n<option value='female' >female</option>\n</select>\n"
        "<fieldset>\n<div id='books[0]'>\n<input type='string' value='Lord' name='books[0][name]'>\n<button onclick='document.getElementById(\"books[0]\").remove();'>Delete</button>\n</div>\n</fieldset>\n"
    )


def test_content_below_max_depth_is_not_passed(spark):
    chain = {"properties": {"x": {"type": "integer"}, "next": {"$ref": "#"}}, "additionalProperties": False}

    def nested(n):
        doc = {"x": "1", "junk": 1}
        for _ in range(n):
            doc = {"x": "1", "junk": 1, "next": doc}
        return spark.createDataFrame([(json.dumps(doc),)], "j string").select(F.parse_json("j").alias("v"))

    shallow, options = Options(max_depth=2), Options(max_depth=4)
    out = Normalizer(chain, options).normalize(nested(4), "v").select(F.to_json("v")).first()[0]
    assert "junk" not in out and out.count('"x":1') == 5
    assert Normalizer(chain, shallow).normalize(nested(4), "v").select(F.to_json("v")).first()[0] == out  # by the walk over single values
    with pytest.raises(Exception, match="depth_exceeded"):
        nested(4).select(F.to_json(Rewriter(chain, shallow).column(F.col("v")))).first()
    walk = lambda o: Walk(chain, {"[type=integer]": lambda s, v, c: "i"}, o)
    seen = lambda o, n: [(r["phase"], r["path"]) for r in walk(o).visits(nested(n), "v", []).orderBy("seq").collect()]
    assert len(seen(options, 4)) == 5 and {p for p, _ in seen(options, 4)} == {""}
    assert [x for x in seen(shallow, 4) if x[0]] == [("depth_exceeded", ["next"] * 3)] and not [x for x in seen(shallow, 2) if x[0]]
    assert nested(4).select(walk(options).fold(nested(4), "v")).first()[0] == "i" * 5
    with pytest.raises(Exception, match="depth_exceeded"):
        nested(4).select(walk(shallow).fold(nested(4), "v")).first()
