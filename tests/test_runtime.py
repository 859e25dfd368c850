"""The walk over single values, handlers that change documents, and documents deeper than recursion is unrolled."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom import Validator
from docloom.operators import runtime
from docloom.operators.normalize import Normalizer, Remove, Replace, Rewriter
from docloom.operators.runtime import NORMALIZING, RuntimeWalk, deep_normalizer
from docloom.operators.walk import STOP
from docloom.plans import pyeval, queries
from docloom.plans.nodes import Options
from docloom.plans.pyeval import deep_validator
from docloom.plans.refs import resolve
from docloom.sources.documents import dealt


def test_handlers_see_and_change(spark):
    seen = []
    selectors = {
        ":item": lambda s, v, c: seen.append(("item", tuple(c.path), v)),
        "[type=integer]": lambda s, v, c: c.replace(v + 1) if isinstance(v, int) else None,
        "[type]": lambda s, v, c: (seen.append((c.property, v, c.parent is not None)), c.stop()),
        "[last]": lambda s, v, c: seen.append("never"),
        "[gone]": lambda s, v, c: c.remove(),
        "end": lambda: seen,
    }
    walk = RuntimeWalk({"properties": {"a": {"type": "integer", "last": 1}, "g": {"gone": True}, "l": {"items": {}}}}, selectors)
    doc = {"a": 1, "g": 2, "l": [5], "other": 0}
    assert walk.run(doc) == [("a", 2, True), ("item", ("l", "0"), 5)]
    assert doc == {"a": 2, "l": [5], "other": 0}
    with pytest.raises(ValueError, match="root"):
        RuntimeWalk({"x": 1}, {"[x]": lambda s, v, c: c.replace(3)}).run(1)
    with pytest.raises(TypeError):
        RuntimeWalk({}, "no selectors")
    paths = []
    RuntimeWalk({"properties": {"p1": {"items": {"t": 1}}}}, {"[t]": lambda s, v, c: paths.append(c.path)}, path=("q",)).run()
    assert paths == [["q", "p1", "[]"]]


SCHEMA = {
    "properties": {
        "i": {"type": "integer"}, "n": {"type": "number"}, "s": {"type": "string"}, "b": {"type": "boolean"}, "a": {"type": "array", "items": {"type": "string"}}, "u": {"type": "null"}, "o": {"type": "object"},
        "d": {"default": [1]}, "m": {"properties": {"x": {"default": 3}}}, "t": {"items": [{"type": "integer"}, {"default": "z"}]},
    },
    "patternProperties": {"^k": {"type": "integer"}}, "additionalProperties": False,
}
DOCS = [
    {"i": "10", "n": ["22.2"], "b": "false", "a": 77, "u": 33, "o": -5}, {}, {"i": 1.5, "n": "x", "s": 12, "b": "on", "a": [1, None, "c"], "u": None, "d": None, "m": None, "t": []},
    {"i": None, "s": [1, 2], "b": 0, "k1": "7y", "zz": 1, "m": {"x": None, "y": 2}, "t": ["5", "w", 9]}, {"s": True, "b": "no", "a": {"q": 1}, "n": 1e3, "i": "abc", "m": 5},
]


def test_normaliser_by_both_ways(spark):
    """Columns, and handlers over single values, agree."""
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "k int, j string")
    rows = df.select("k", F.to_json(Normalizer(SCHEMA).column(F.parse_json("j"))).alias("a"), deep_normalizer(SCHEMA)(F.col("j")).alias("b")).collect()
    for r in rows:
        assert json.loads(r["a"]) == json.loads(r["b"]), (DOCS[r["k"]], r)
    assert json.loads(rows[0]["a"])["n"] == 22.2 and json.loads(rows[0]["a"])["a"] == ["77"] and json.loads(rows[0]["a"])["i"] == 10
    assert RuntimeWalk({"properties": {"i": {"type": "integer"}}}, NORMALIZING, root_may_change=True).run({"i": "3", "j": 1}) == {"i": 3}


def test_rewriter(spark):
    df = spark.createDataFrame([(json.dumps({"l": [1, 2, 3], "x": {"y": 1}, "keep": 0}),)], "j string").select(F.parse_json("j").alias("doc"))
    selectors = {
        ":item": lambda s, v, p: Remove(v.number() == 2), "[twice]": lambda s, v, p: Replace((v.number() * 2).cast("int").cast("variant")), "[twice]:end": lambda s, v, p: STOP,
        "[also]": lambda s, v, p: Replace((v.number() + 1).cast("int").cast("variant")),
    }
    made = Rewriter({"properties": {"l": {"items": {}}, "x": {"properties": {"y": {"also": 1, "twice": 1}}}}}, selectors=selectors)
    assert json.loads(df.select(F.to_json(made.column(F.col("doc")))).first()[0]) == {"l": [1, None, 3], "x": {"y": 3}, "keep": 0}
    with pytest.raises(ValueError, match="root"):
        Rewriter({"r": 1}, selectors={"[r]": lambda s, v, p: Remove()}).column(F.col("doc"))


CHAIN = {"$ref": "#/definitions/link", "definitions": {"link": {"properties": {"v": {"type": "integer", "maximum": 5, "messages": {"maximum": "too much"}}, "next": {"$ref": "#/definitions/link"}}, "additionalProperties": False}}}


def test_deeper_than_unrolled(spark):
    def chain(n, last):
        return last if n == 0 else {"v": 1, "next": chain(n - 1, last)}

    docs = [chain(n, {"v": v}) for n in (0, 3, 12, 20) for v in (2, 9, "7")]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "k int, j string").select("k", "j", F.parse_json("j").alias("doc"))
    v = Validator(CHAIN, Options(max_depth=2), gettext=lambda s: f"~{s}", path=("root",))
    rows = df.select("k", v.result(df, "doc").alias("r"), v.is_valid(df, "doc").alias("ok"), deep_validator(v)(F.col("j")).alias("e")).orderBy("k").collect()
    for r, (n, last) in zip(rows, [(n, x) for n in (0, 3, 12, 20) for x in (2, 9, "7")], strict=True):
        assert r["ok"] == r["r"]["valid"] == (last == 2) and r["r"]["errors"] == r["e"]
        expected = [] if last == 2 else [("maximum", "~too much", "9", "5")] if last == 9 else [("integer", "~shall be an integer", '"7"', None)]
        assert [(e["code"], e["message"], e["value"], e["arg"]) for e in r["e"]] == expected
        assert all(e["path"] == ["root", *["next"] * n, "v"] for e in r["e"])
    own = Validator({**CHAIN, "conform": lambda value, ctx: F.lit(True)}, Options(max_depth=2))
    with pytest.raises(ValueError, match="single values"):
        deep_validator(own)
    got = df.where("k = 11").select(Validator(CHAIN, Options(max_depth=2), custom={"x": None}).result(df, "doc")["errors"][0]["code"]).first()[0]
    assert got == "depth_exceeded"
    out = df.where("k = 11").select(F.to_json(Normalizer(CHAIN, Options(max_depth=2)).column(F.col("doc")))).first()[0]
    assert out.count('"v":1') == 20 and '"v":7' in out


def test_normalising_single_values_finds_the_schema_once(monkeypatch):
    """What a schema node and its references say is found once, not at every level of every document; far deeper ones fit the stack."""
    asked = []
    monkeypatch.setattr(runtime, "resolve", lambda *a: asked.append(a) or resolve(*a))
    monkeypatch.setattr(F, "arrow_udf", lambda fn, kind: fn)
    doc = {"v": "7", "junk": 1}
    for _ in range(300):
        doc = {"v": "1", "next": doc}
    out = deep_normalizer(CHAIN)(pa.array([json.dumps(doc), None, '{"v":"3"}']))
    assert [x and x.as_py() and x.as_py().count('"v":') for x in out][::2] == [301, 1] and out[1].as_py() is None and "junk" not in out[0].as_py()
    assert len(asked) <= 2  # one for each node that refers


def test_tuples_do_not_touch_objects(spark):
    """A tuple's default has no place in an object, whichever way it takes."""
    schema = {"items": [{"default": 1}], "properties": {"a": {"default": 2}}}
    row = spark.createDataFrame([("{}",)], "j string").select(F.to_json(Normalizer(schema).column(F.parse_json("j"))).alias("a"), deep_normalizer(schema)(F.col("j")).alias("b")).first()
    assert row["a"] == row["b"] == '{"a":2}'


def chain_of(n):
    doc = {"v": 2}
    for _ in range(n):
        doc = {"v": 1, "next": doc}
    return doc


def test_deep_visits_read_the_schema_once(monkeypatch):
    """References are followed and children listed once for a schema node, not at every level; a document nobody holds is not read again from its root."""
    asked, read = [], []
    monkeypatch.setattr(runtime, "resolve", lambda *a: asked.append(a) or resolve(*a))
    monkeypatch.setattr(F, "arrow_udf", lambda fn, kind: fn)
    walk = RuntimeWalk(CHAIN, {"[type=integer]": lambda s, v, c: len(c.path)})
    visits = walk.visits(pa.array([json.dumps(chain_of(20)), None, json.dumps(chain_of(2))])).to_pylist()
    assert visits[1] is None and [len(visits[0]), len(visits[2])] == [21, 3] and len(asked) <= 2
    assert visits[0][20] == {"selector": "[type=integer]", "phase": "", "path": [*["next"] * 20, "v"], "property": "v", "value": "2", "schema": json.dumps(CHAIN["definitions"]["link"]["properties"]["v"], sort_keys=True), "output": "21"}
    get = runtime._Slot.get
    monkeypatch.setattr(runtime._Slot, "get", lambda slot: read.append(slot.stamp != slot.walk._stamp) or get(slot))
    walk.visits(pa.array([json.dumps(chain_of(20))]))
    assert not any(read)


def test_handlers_may_change_the_document_anywhere():
    """Also objects that they got hold of earlier, above the node they are at."""
    held = []
    selectors = {
        "[hold]": lambda s, v, c: held.append(v), "[swap]": lambda s, v, c: held[0].update(b={"c": 9, "d": 8}), "[seen]": lambda s, v, c: held.append(v),
        "[kept]": lambda s, v, c: held.append(c), "[late]": lambda s, v, c: held[-1].replace({"y": 6}),
    }
    schema = {"hold": 1, "properties": {"b": {"properties": {"c": {"swap": 1}, "d": {"seen": 1}}}}}
    for walk in (lambda w, d: w.run(d), lambda w, d: w._run(d, None, {})):
        held.clear()
        assert walk(RuntimeWalk(schema, selectors), {"b": {"c": 1, "d": 2}}) == {"b": {"c": 9, "d": 8}} and held[1] == 8
        held.clear()
        assert walk(RuntimeWalk({"properties": {"b": {"kept": 1, "properties": {"x": {"late": 1}, "y": {"seen": 1}}}}}, selectors), {"b": {"x": 1, "y": 2}}) == {"b": {"y": 6}} and held[1] == 6


def test_handler_forms_are_told_apart_once(monkeypatch):
    """Signatures are not inspected at visits; all forms are called as before."""
    asked = []
    monkeypatch.setattr(runtime.inspect, "signature", lambda f, real=runtime.inspect.signature: asked.append(f) or real(f))

    class Callable3:
        def __call__(self, s, v, c):
            return v

    def optional(s, v, c, more=1):
        return more

    class Own:
        def two(self, s, c):
            return lambda _s, v: v + s["maximum"]

    selectors = {"[items]": {"prepare": lambda s, c: None}, ":item": {"inline": lambda s, v, c: v}, "[type]": lambda: "r", "[maximum]": Own().two, ":item-end": Callable3(), "[type=integer]": optional}
    got = []
    RuntimeWalk({"items": {"type": "integer", "maximum": 9}}, selectors).run(list(range(50)), lambda selector, phase, schema, ctx, out: got.append((selector.text, out)))
    assert got == [("[items]", None), *[x for i in range(50) for x in ((":item", i), ("[type]", "r"), ("[maximum]", i + 9), ("[type=integer]", 1), (":item-end", i))]]
    assert len(asked) <= 1  # of the callable object


def test_visits_cost_what_is_asked_for(monkeypatch):
    """Forms and texts of a dict's selectors are read once a batch, and only the fields named are made, in any order, as among all."""
    asked = []
    for name in ("_form", "is_selector", "compact"):
        monkeypatch.setattr(runtime, name, lambda x, name=name, real=getattr(runtime, name): asked.append(name) or real(x))
    monkeypatch.setattr(F, "arrow_udf", lambda fn, kind: lambda text: fn)
    selectors = {"[items]": {"prepare": lambda s, c: None}, ":item": {"inline": lambda s, v, c: v}, "[type]": lambda s, v, c: "r", "[maximum]": lambda s, c: lambda _s, v, _c: s["maximum"] - v}
    walk = RuntimeWalk({"items": {"type": "integer", "maximum": 9}}, selectors)
    texts = pa.array([json.dumps(list(range(i % 5))) for i in range(100)] + [None, "[]", "3"])
    whole = walk.visits(None)(texts).to_pylist()
    asked.clear()
    got = walk.visits(None, ["output", "selector"])(texts)
    assert len(asked) <= 8 and "compact" not in asked
    assert got.to_pylist() == [None if v is None else [{k: x[k] for k in ("output", "selector")} for x in v] for v in whole]
    assert walk.visits(None, ["path"])(texts).to_pylist() == [None if v is None else [{"path": x["path"]} for x in v] for v in whole]
    for wrong in ([], ["paths"], ["path", "path"]):
        with pytest.raises(ValueError):
            walk.visits(None, wrong)


def test_selectors_made_for_each_document_are_read_once(monkeypatch):
    """State is each document's own, but selectors' texts, children and branches are worked out once for a batch."""
    asked = []
    monkeypatch.setattr(runtime, "children", lambda *a, real=runtime.children: asked.append("children") or real(*a))
    monkeypatch.setattr(runtime, "parse", lambda text, real=runtime.parse: asked.append("parse") or real(text))
    monkeypatch.setattr(F, "arrow_udf", lambda fn, kind: fn)

    class Collected:
        def __init__(self):
            self.out = []
            self.selectors = {"[either]": {"prepare": self.prepared}, "[type=integer]": lambda s, v, c: self.out.append("i") if type(v) is int else None, "[type=string]": lambda s, v, c: self.out.append("s") if isinstance(v, str) else None}

        @staticmethod
        def prepared(schema, ctx):
            ctx.compile(schema["either"], "either")
            return lambda s, v, c: [walk(v, c.path) for walk in c.either] and None

        def end(self):
            return "".join(self.out)

    walk = RuntimeWalk({"properties": {"p": {"either": [{"type": "integer"}, {"type": "string"}, {"items": {"type": "integer"}}]}}}, Collected)
    texts = ['{"p":1}', '{"p":"x"}', None, '{"p":[1,2,7]}', "{}"] * 20
    assert walk.results(pa.array(texts)).to_pylist() == ['"i"', '"s"', None, '"iii"', '""'] * 20
    assert len(asked) <= 3 + 7  # selectors and schema nodes


def test_the_evaluator_reads_the_schema_once(monkeypatch):
    """References are followed once for a schema node, also over many documents; patterns that no member meets stay unread."""
    asked = []
    monkeypatch.setattr(pyeval, "resolve", lambda *a: asked.append(a) or resolve(*a))
    evaluator = pyeval.Evaluator(CHAIN)
    for n in (20, 3, 0):
        assert evaluator.errors(chain_of(n)) == [] and [e[:2] for e in evaluator.errors(chain_of(n) | {"v": 9})] == [("maximum", ["v"])]
    assert len(asked) <= 2
    unread = {"patternProperties": {"(": {}}, "additionalProperties": {}}
    assert pyeval.Evaluator(unread).errors(5) == [] and RuntimeWalk(unread, {"[x]": lambda s, v, c: 1}).run(5) == 5 and runtime.NormalizingWalk(unread).run(5) == 5


def test_walks_over_single_values_use_all_cores(spark, tmp_path):
    """Also where a table is one file of one row group, which one task reads; a table in several parts a core is not moved."""
    spark.range(4000).selectExpr("id as event_id", "id % 7 as user_id", "'x' as event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("handler_forms", "walk_recursion_deep", "ctx_compile", "n_recursion_deep"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) > spark.sparkContext.defaultParallelism, name
    many = spark.range(0, 4000, 1, 4 * spark.sparkContext.defaultParallelism)
    assert dealt(many, "id") is many and dealt(many.coalesce(2), "id").count() == 4000
