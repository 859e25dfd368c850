"""The pipeline's stages against brute force, each on its own input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import components, rated, sentences, tokens

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("sf")
    data = [(i, t, k) for i, t, k in rated(240, 12)]
    items = [(1, sentences(rng, 25)), (2, sentences(rng, 12))]
    texts = [t for _, t, _ in data]
    near = " ".join(f"n{rng.randrange(300)}" for _ in range(90))
    for _ in range(8):
        own = near.split()
        own[rng.randrange(90)] = "zz"
        texts.append(" ".join(own))
    texts += ["Same Line here\nowned by %d %s" % (i, sentences(rng, 30)) for i in range(12)]
    texts += ["before " + items[0][1], items[1][1] + " after", None, "", near, near]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, "nameless " + sentences(rng, 30), "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(k != 1), int(k == 0)) for i, _, k in data], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), items


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_stages(spark, folder):
    at, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at).cache()
        kept[name] = (docs, out)
        if name != "mix":
            assert out.columns == COLUMNS
        docs = out
    before, after = map(rows_of, kept["quality"])
    assert not after - before
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    sound = [r for r in before if labels.get(r[0]) == (1, 0)]
    bad = [r for r in before if r[0] in labels and labels[r[0]] != (1, 0)]
    assert sum(r in after for r in sound) >= 0.97 * len(sound) and sum(r in after for r in bad) <= 0.05 * len(bad)

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    before, after = map(rows_of, kept["lines"])
    lines = [(r, (r[1] or "").split("\n")) for r, n in before.items() for _ in range(n)]
    often = Counter(k for _, own in lines for k in {key(x) for x in own} if k)
    first = {}
    for at, (r, own) in enumerate(lines):
        for k in {key(x) for x in own}:
            if often[k] >= 10:
                first[k] = min(first.get(k, (2,)), (r[0] is None, r[0] or 0, at))
    expected = Counter()
    for at, (r, own) in enumerate(lines):
        left, seen = [], set()
        for x in own:
            k = key(x)
            if often[k] < 10 or not k or (first[k][2] == at and k not in seen):
                left.append(x)
                seen.add(k)
        text = "\n".join(left)
        if len(left) == len(own):
            expected[(r[0], text, *r[2:])] += 1
        elif tokens(text):
            expected[(r[0], text, r[2], r[3], len(text))] += 1
    assert after == expected

    before, after = map(rows_of, kept["near_duplicates"])
    flat = [(r[0], r[1]) for r, n in before.items() for _ in range(n)]
    found = components(flat, 80, 100, 5)
    groups = {c for c in (eval(k)[2] for k in found if eval(k)[1])}  # noqa: S307
    full = [r for r in after.elements() if tokens(r[1])]
    assert sorted(map(str, (r[0] for r in full))) == sorted(map(str, groups))
    assert sum(1 for r in after.elements() if not tokens(r[1])) == sum(n for r, n in before.items() if not tokens(r[1]))

    before, after = map(rows_of, kept["benchmark"])
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {tuple(word(t)[i : i + 10]) for _, t in items for i in range(len(word(t)) - 9)}
    clean = Counter({r: n for r, n in before.items() if not any(tuple(word(r[1])[i : i + 10]) in windows for i in range(len(word(r[1])) - 9))})
    assert after == clean and sum(before.values()) > sum(clean.values())

    mixed = kept["mix"][1]
    assert mixed.where("copies < 1 or taken > 3 * size").count() == 0
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] * 2 + 100


def test_odd_tables(spark, folder, tmp_path):
    """Empty tables, clashing and further columns, and rows that repeat, at every stage."""
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    more = ["kept", "size", "copies", "n_lines", "spans", "root", "p_tail", "__text", "row", "a.b"]
    wide = docs.limit(40).unionByName(docs.limit(10))
    for c in more:
        wide = wide.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0
        out = stage(spark, wide, at)
        assert out.columns[: len(wide.columns)] == wide.columns and (name == "mix" or out.columns == wide.columns)
        rows = out.collect()
        assert all(r[c] == "x" for r in rows for c in more)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.benchmark(spark, docs, str(tmp_path)).count() == docs.count()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 0 and set(COLUMNS) < set(out.columns)
