"""The corpus operators against brute force on small tables, with nulls, ties, repeats, empties and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, mixing, ordinal_quality, quality_rules, suffix_dedup, suffix_tree_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, `__text` string"
def ids():
    return {"doc_id": F.col("doc_id")}

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def sentences(rng, n, words="the of and to was with ein der und les que pour stone river light".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(n))


def corpus(spark, extra=(), seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, sentences(rng, rng.randint(0, 80)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, "  \n\n \t", "en", "z"), (None, rows[0][1], None, "a"), rows[3], rows[3], (n + 3, "x" * 3000, "en", "b"), (n + 4, rows[5][1], "de", "b")]
    rows += [(n + 10 + k, t, "en", "a") for k, t in enumerate(extra)]
    return spark.createDataFrame([(*r, 1, 0.5, "clash", "clash") for r in rows], SCHEMA).repartition(5)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def tally(rows):
    return Counter(map(repr, rows))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return WORDS.findall((text or "").encode().lower())


# ---------------------------------------------------------------- 1, 2


def rated(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 3
        base = sentences(rng, 40)
        text = base if kind == 2 else base + " " + " ".join(rng.choice(["vile", "nasty", "foul"]) for _ in range(4)) if kind == 0 else " ".join(w + "%%%" for w in base.split())
        out.append((i, text, kind))
    return out


def test_ordinal_quality(spark, empty):
    data = rated(360, 3)
    docs = spark.createDataFrame([(i, t, None, None, 1, 0.5, "c", "c") for i, t, _ in data] + [(None, None, None, None, 1, 0.5, "c", "c"), (900, "", None, None, 1, 0.5, "c", "c")], SCHEMA)
    labels = spark.createDataFrame([(i, int(k != 1), int(k == 0)) for i, _, k in data if i < 240] + [(None, 1, 0), (3, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in ordinal_quality.classify(docs, labels, ids()).collect()}
    assert len(got) == 362
    right = [got[i]["kept"] == (k == 2) for i, _, k in data if i >= 240]
    assert sum(right) / len(right) >= 0.95
    mean = [sum(got[i]["expected_grade"] for i, _, k in data if k == g) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    model = ordinal_quality.train(docs, labels, ordinal_quality.grade_of_labels())
    assert list(model.thresholds) == sorted(model.thresholds)
    none = ordinal_quality.classify(docs, labels.limit(0), ids())
    assert none.where("kept and p_tail is null").count() == 362
    assert ordinal_quality.classify(empty, labels, ids()).count() == 0
    blank = docs.where("doc_id = 900")
    one = spark.createDataFrame([(900, 1, 0)], "doc_id long, quality int, toxic int")
    assert ordinal_quality.classify(blank, one, ids()).where("kept").count() == 1


def test_language_id(spark, empty):
    rng = random.Random(2)
    words = {"xx": ["bako", "tiru", "soma"], "yy": ["ñusha", "qwelg", "zrath"]}
    data = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i in range(80) for k in [rng.choice(["xx", "yy"])]]
    docs = spark.createDataFrame([(i, t, k, "s", 1, 0.5, "c", "c") for i, t, k in data] + [(500, None, "xx", "s", 1, 0.5, "c", "c"), (501, "12 !?", "yy", "s", 1, 0.5, "c", "c"), (None, "bako", None, "s", 1, 0.5, "c", "c")], SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in data)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in data)
    assert (got[500]["lang_pred"], got[500]["score"]) == ("und", 0.0) and got[501]["lang_pred"] == "und" and got[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(empty).count() == 0


def hashed(code, salt, buckets):
    """The bucket of an n-gram's code by plain integers."""
    top = (1 << 64) - 1
    x = (code + salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & top
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & top
    x = ((x ^ (x >> 29)) * 0xA0761D6478BD642F) & top
    return (x ^ (x >> 32)) & (buckets - 1)


def plain_ngrams(text):
    """Buckets of a text's 1- to 3-grams, character by character."""
    low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) for c in text]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            code = 0
            for c in low[i : i + n]:
                code = (code << 21) ^ c
            out[hashed(code, n, language_id.BUCKETS)] += 1
    return out


def test_language_model_by_a_plain_loop(spark):
    """Counts, predictions and scores against a naive Bayes over n-grams taken one by one; ties; many language blocks."""
    rng = random.Random(15)
    alphabet = {"l": "abcdeñ É", "m": "zyxwv ÄÖ", "k": "abcxyz !"}
    rows = [(i, "".join(rng.choice(alphabet[g]) for _ in range(rng.randint(0, 60))), g) for i in range(90) for g in [rng.choice("lmk")]]
    rows += [(100, "same", "a1"), (101, "same", "a2"), (102, "same", "a2"), (102, "same", "a1"), (103, None, "l"), (104, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    counts, texts = defaultdict(Counter), Counter()
    for _, t, g in rows:
        if t is not None and g is not None:
            counts[g].update(plain_ngrams(t))
            texts[g] += 1
    model = language_id.train(docs)
    assert model.langs == sorted(counts) and model.n_texts == sum(texts.values())
    size, add = language_id.BUCKETS, language_id.SMOOTHING
    logp = {g: {"prior": math.log(texts[g] / sum(texts.values())), "total": sum(counts[g].values()) + add * size} for g in counts}
    expected = {}
    for d, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            expected[(d, t)] = ("und", 0.0)
            continue
        own = {g: p["prior"] + sum(n * math.log((counts[g][b] + add) / p["total"]) for b, n in plain_ngrams(t).items()) for g, p in logp.items()}
        best = max(own.values())
        expected[(d, t)] = (min(g for g, x in own.items() if x > best - 1e-9), 1 / sum(math.exp(x - best) for x in own.values()))
    for block_bytes in (1 << 26, 4 * size + 4):  # all languages at once, and one a pass
        got = language_id.predict(docs, model, keep={"doc_id": F.col("doc_id"), "text": F.col("text")}, block_bytes=block_bytes).collect()
        assert len(got) == len(rows)
        for r in got:
            name, share = expected[(r["doc_id"], r["text"])]
            assert r["lang_pred"] == name and math.isclose(r["score"], share, abs_tol=2e-3), (r, name, share)
    assert expected[(100, "same")][0] == "a1"  # a tie


# ---------------------------------------------------------------- 3


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {p + j for at in seen.values() if len(at) > 1 for p in at for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, empty):
    rng = random.Random(4)
    block = sentences(rng, 12)
    docs = corpus(spark, [block + " " + sentences(rng, 9) + " " + block, "a b " * 60, "😀 ñ# " * 30, " ".join("w%d%%%%" % i for i in range(50))])
    got = quality_rules.judge(docs, {"doc_id": F.col("doc_id"), "text": F.col("text")}).collect()
    assert tally((r["doc_id"], r["text"]) for r in got) == tally(rows_of(docs))
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert next(r for r in got if r["doc_id"] == 73)["kept"] is False  # symbols in every word
    rejected = [r for r in got if not r["base_failed"] and not r["kept"]]
    assert len(rejected) < len(got) / 5
    assert quality_rules.judge(empty, ids()).count() == 0
    sketch = quality_rules.sketch(quality_rules.measure(docs, {"s": F.col("source")}), ["s"])
    merged = quality_rules.merge(sketch, [])
    whole = quality_rules.sketch(quality_rules.measure(docs, {}), [])
    assert tally(map(tuple, merged.select("measure", "bucket", "n").collect())) == tally(map(tuple, whole.select("measure", "bucket", "n").collect()))


def test_fences_follow_their_group(spark):
    """Each measure rejects an outlier that passes the base rules, and a group's habits move its own fence only."""
    rng = random.Random(14)
    words = [f"{a}{b}{c}{d}" for a in "bcdfgl" for b in "aeiou" for c in "mnrst" for d in ("", "on", "ings")]
    prose = lambda n=60: [rng.choice(words) for _ in range(n)]
    rows = [("p", " ".join(prose()) + "\n" + " ".join(prose(8))) for _ in range(150)]
    rows += [("q", " ".join(w + "#" * (i % 3 == 0) for i, w in enumerate(prose())) + "\nsame\nsame\n" + "\n".join(prose(4)) * 2) for _ in range(150)]
    again = " ".join(prose(10))
    odd = [" ".join(w + "$" * (i % 8 == 0) for i, w in enumerate(prose())), " ".join(prose(40)) + "\nline\nline\nline\nother", " ".join(prose(60)) + " " + again + " x " + again, " ".join(w * 2 for w in prose()), " ".join(w[:2] for w in prose())]
    rows = [(i, t, "en", s) for i, (s, t) in enumerate(rows)] + [(1000 + k + 100 * (s == "q"), t, "en", s) for k, t in enumerate(odd) for s in "pq"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, ids()).collect()}
    assert not any(got[1000 + k]["base_failed"] or got[1000 + k]["kept"] for k in range(5))
    assert got[1100]["kept"] and got[1101]["kept"] and not got[1103]["kept"]  # in q symbols and repeated lines are usual
    assert sum(got[i]["kept"] for i in range(300)) >= 285
    for m in ("symbol_share_most_fence", "dup_line_share_most_fence", "mean_word_most_fence", "mean_word_least_fence"):
        assert got[0][m] != got[200][m], m


# ---------------------------------------------------------------- 4


def test_decontaminate(spark, empty):
    rng = random.Random(5)
    items = [(1, sentences(rng, 25)), (2, sentences(rng, 14)), (2, "Solo Word"), (3, None), (4, "..."), (None, "nameless item text"), (10, "river")]
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    docs = corpus(spark, [items[0][1], "pre " + items[1][1].upper() + " post", "SOLO-word solo  word", "a nameless: ITEM text", sentences(rng, 30) + items[0][1][10:]])
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    pats = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            pats[tuple(w[k : k + n])].add(i)
    for size in (1 << 20, 40):  # one block, and many
        got = decontaminate.find_benchmark(docs, bench, ids() | {"text": F.col("text")}, block_bytes=size).withColumn("n_hit", decontaminate.n_hit()).collect()
        assert tally((r["doc_id"], r["text"]) for r in got) == tally(rows_of(docs))
        for r in got:
            w, hit, named = words(r["text"]), set(), set()
            for n in {len(p) for p in pats}:
                for k in range(len(w) - n + 1):
                    if own := pats.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        named |= {str(i) for i in own if i is not None}
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(w), len(hit), sorted(named))
    assert decontaminate.find_benchmark(empty, bench, ids()).count() == 0
    assert decontaminate.find_benchmark(docs, bench.limit(0), ids()).where("size(item_ids) > 0").count() == 0


# ---------------------------------------------------------------- 5


def components(rows, num, den, size):
    sets = []
    for _, t in rows:
        w = tokens(t)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter(repr((d, len(sets[i]), least.get(find(i), d))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("num, size", [(90, 3), (80, 5)])
def test_jaccard_join(spark, empty, num, size, monkeypatch):
    rng = random.Random(num)
    vocabulary = [f"w{i}" for i in range(400)]
    extra = []
    for n in (6, 30, 33, 45, 120, 400):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 35))):
                own[rng.randrange(n)] = rng.choice(vocabulary)
            extra.append(" ".join(own))
    docs = corpus(spark, extra)
    expected = components(rows_of(docs), num, 100, size)
    for block, hot in ((200_000, 1024), (150, 3)):
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
        monkeypatch.setattr(jaccard_join, "HOT_ROWS", hot)
        monkeypatch.setattr(jaccard_join, "MOST_COMPARED", hot)
        got = jaccard_join.similar_documents(docs, num, 100, size).select("doc_id", "n_shingles", "component_id").collect()
        assert Counter(repr(tuple(r)) for r in got) == expected
    assert jaccard_join.similar_documents(empty, num, 100, size).count() == 0


def test_signatures_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    for num in (90, 80):
        plan = jaccard_join.Plan(num, 100)
        for _ in range(1500):
            n = int(rng.integers(2, rng.choice([12, 40, 90, 500])))
            pool = rng.permutation(np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64)))
            cut, add = rng.integers(0, n // 4 + 1, 2)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[cut:n], pool[n : n + add])))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(jaccard_join.signatures(a, plan), jaccard_join.signatures(b, plan)))


# ---------------------------------------------------------------- 6


def copies_by_rank(rows, target):
    """Copies of (id, size) rows by a plain loop: expected copies by the root of the size, whole ones first, then by rank."""
    weight = {n: math.ceil(math.sqrt(n)) for _, n in rows}
    full, level = set(), 0.0
    while True:
        free = [(weight[n], n) for _, n in rows if n and n not in full]
        level = (target - sum(3 * n for _, n in rows if n in full)) / max(sum(w * n for w, n in free), 1)
        over = {n for w, n in free if w * level >= 3 - 1e-12}
        if not over:
            break
        heaviest = max(weight[n] for n in over)
        full |= {n for n in over if weight[n] == heaviest}
    ranked, left, out = [], target, Counter()
    for d, n in rows:
        e = 3.0 if n in full else weight[n] * level
        whole = math.floor(e)
        left -= whole * n
        u = (int(hashlib.md5(f"0:{'null' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = e - whole
        ranked.append((u / (1 - u) / (p / (1 - p)) if p > 0 and whole < 3 else math.inf, n, u, d, whole))
    upto = 0
    for q, n, _, d, whole in sorted(ranked, key=lambda r: r[:3]):
        upto += n if q < math.inf else 0
        out[(d, n, whole + (q < math.inf and 2 * upto - n <= 2 * left))] += 1
    return out


def test_mixing(spark, empty):
    rng = random.Random(6)
    data = [(i, " ".join(["w"] * rng.randint(0, 30)), s) for s, n in (("a", 300), ("b", 40), ("c", 80), ("d", 5), (None, 60)) for i in range(n)]
    docs = spark.createDataFrame([(k, t, None, s, 1, 0.5, "c", "c") for k, (_, t, s) in enumerate(data)] + [(7, None, None, "d", 1, 0.5, "c", "c"), (None, "w w", None, "d", 1, 0.5, "c", "c"), (7, "w", None, "d", 1, 0.5, "c", "c")], SCHEMA)
    got = mixing.mix(docs, keep=ids() | {"source": F.col("source")}).collect()
    size = defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] >= 3 * size[s]}
        if not over:
            break
        full |= over
    assert len(got) == len(data) + 3
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(math.isclose(r["target"], target[s], rel_tol=1e-9) and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 30
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in own)
        assert Counter((r["doc_id"], r["size"], r["copies"]) for r in own) == copies_by_rank([(r["doc_id"], r["size"]) for r in own], target[s])
    again = mixing.mix(docs.repartition(9), keep=ids() | {"source": F.col("source")})
    assert tally(map(tuple, got)) == tally(map(tuple, again.collect()))
    heavy = mixing.mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).where("source_size > 0").groupBy(F.col("doc_id") % 2).agg(F.avg("copies")).collect()
    share = {r[0]: r[1] for r in heavy}
    assert share[0] > share[1]
    long = Counter(r["copies"] for r in got if r["source"] == "a" and r["size"] >= 20), Counter(r["copies"] for r in got if r["source"] == "a" and 0 < r["size"] < 5)
    assert sum(k * n for k, n in long[0].items()) / sum(long[0].values()) > sum(k * n for k, n in long[1].items()) / sum(long[1].values())
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("group_bytes", [1 << 20, 200])
def test_suffix_dedup(spark, empty, group_bytes):
    rng = random.Random(7)
    passage = sentences(rng, 60)
    texts = [sentences(rng, 30) + passage[rng.randint(0, 40) : 300] + sentences(rng, 20) for _ in range(12)] + ["ab" * 200, "é" * 150, passage, passage]
    docs = corpus(spark, texts)
    rows = rows_of(docs)
    starts = Counter(t.encode()[i : i + 50] for _, t in rows if t for i in range(len(t.encode()) - 49))
    got = suffix_dedup.remove_repeats(docs, ids() | {"text": F.col("text")}, length=50, group_bytes=group_bytes).withColumn("n", suffix_dedup.n_removed()).collect()
    assert tally((r["doc_id"], r["text"]) for r in got) == tally(rows)
    for r in got:
        body = (r["text"] or "").encode()
        gone = [False] * len(body)
        for i in range(len(body) - 49):
            if starts[body[i : i + 50]] > 1:
                gone[i : i + 50] = [True] * 50
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        assert (r["n_bytes"], r["n"], len(r["spans"]), bytes(r["kept"])) == (len(body), sum(gone), runs, kept)
    assert suffix_dedup.remove_repeats(empty, ids()).count() == 0


def test_suffix_dedup_spans_stay_in_arrays():
    """The spans of a batch take a few times their own bytes, not a Python object each; merged as by hand, a null list and an empty batch included."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(9)
    first = np.sort(rng.integers(0, 1 << 20, 200_000))
    many = pa.ListArray.from_arrays(pa.array(np.arange(0, 200_001, 40), pa.int32()), pa.StructArray.from_arrays([pa.array(first), pa.array(first + 266)], names=["first", "stop"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), many], ["doc", "spans"])
    tracemalloc.start()
    try:
        list(suffix_dedup._tidy([batch]))
        assert tracemalloc.get_traced_memory()[1] < 8 * batch.nbytes
    finally:
        tracemalloc.stop()
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
    few = [[{"first": int(x), "stop": int(x) + int(rng.integers(1, 20))} for x in rng.integers(0, 200, n)] for n in rng.integers(0, 12, 300)]
    column = pa.array([*few[:150], None, *few[150:]], kind)
    for lists in (column, column.slice(7, 200), column.slice(0, 0)):
        (out,) = suffix_dedup._tidy([pa.RecordBatch.from_arrays([pa.array(range(len(lists)), pa.int64()), lists], ["doc", "spans"])])
        for got, spans in zip(out.column(1).to_pylist(), lists.to_pylist(), strict=True):
            inside = {i for s in spans or [] for i in range(s["first"], s["stop"])}
            firsts, stops = (sorted(i for i in inside if i - 1 not in inside), sorted(i + 1 for i in inside if i + 1 not in inside))
            assert got == [{"first": a, "stop": b} for a, b in zip(firsts, stops, strict=True)]


def test_suffix_order():
    import numpy as np

    rng = random.Random(8)
    for _ in range(150):
        s = np.array([rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 70))])
        assert suffix_dedup.suffix_order(s, 1, 10**9).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


# ---------------------------------------------------------------- 8


def test_line_dedup(spark, empty, monkeypatch):
    docs = corpus(spark, ["Shared LINE\nown %d\n  shared line \t" % i for i in range(12)] + ["é\né", "a\x0b\nA"])
    rows = rows_of(docs)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    for low, short in ((10, 1), (2, 1), (2, 0), (3, 4)):
        often = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k.decode()) >= short)
        got = line_dedup.dedup_lines(docs, ids(), min_docs=low, min_chars=short).collect()
        expected = []
        for d, t in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if often[key(x)] < low]
            expected.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
        assert tally(map(tuple, got)) == tally(expected)
    first = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, ids(), min_docs=10, keep="first").collect()}
    assert first[70] == "Shared LINE\nown 0" and first[71] == "own 1"
    plain = tally(map(tuple, line_dedup.dedup_lines(docs, ids(), min_docs=3).collect()))
    monkeypatch.setattr(line_dedup, "BITS_PER_KEY", 1 << 11)  # several passes, each for a share of the keys, and several for the frequent ones
    assert tally(map(tuple, line_dedup.dedup_lines(docs, ids(), min_docs=3, max_bits=1 << 19, block_bytes=2000).collect())) == plain
    same = spark.createDataFrame([(None, "Only\nx%d" % i) for i in range(3)] + [(None, "only")] * 2 + [(7, "a\ntwice"), (7, "a\ntwice"), (7, "twice")], "doc_id long, text string").repartition(3)
    kept = Counter(line for r in line_dedup.dedup_lines(same, ids(), min_docs=2, keep="first").collect() for line in r["text"].lower().split("\n"))
    assert kept["only"] == 1 and kept["a"] == 1 and kept["twice"] == 1
    assert line_dedup.dedup_lines(empty, ids(), 10).count() == 0


def test_filters_merge():
    import numpy as np
    import pyarrow as pa

    parts, hashes = [], np.random.default_rng(1).integers(0, 2**64, 900, dtype=np.uint64)
    for own in (hashes[:500], hashes[400:], hashes[100:120]):
        b = line_dedup.TwoBlooms(line_dedup.BLOCK_BITS * 2)
        b.add(own)
        parts += [pa.RecordBatch.from_pydict({"block": [k], "once": [o], "twice": [t]}) for k, o, t in b.blocks()]
    merged = line_dedup.TwoBlooms(line_dedup.BLOCK_BITS * 2)
    import zlib as z

    for batch in line_dedup._merge(iter(parts)):
        k = batch.column(0)[0].as_py()
        size = line_dedup.BLOCK_BITS // 8
        merged.twice[k * size : (k + 1) * size] = np.frombuffer(z.decompress(batch.column(1)[0].as_py()), np.uint8)
    found = merged.repeated(hashes)
    assert found[400:500].all() and found[100:120].all() and found.sum() < 140


# ---------------------------------------------------------------- 9


def lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(last[j] + 1 if x == y else max(now[-1], last[j + 1]))
        last = now
    return last[-1]


def test_ratings_are_sampled_by_id(spark):
    rng = random.Random(12)
    base = [(i, sentences(rng, 30) + (" good" if i % 2 else " b4d")) for i in range(60)]
    rows = [r for r in base for _ in range(5)] + [(3, "another text")]
    grades = [(i, i % 2, 0) for i, _ in base] + [(k, k % 2, 0) for k in range(60) for _ in range(40 if k < 5 else 0)]
    made = []
    for n in (1, 7):
        docs, labels = spark.createDataFrame(rows[::-1] if n == 1 else rows, "doc_id long, text string").repartition(n), spark.createDataFrame(grades, "doc_id long, quality int, toxic int").repartition(n)
        made.append(ordinal_quality.train(docs, labels, ordinal_quality.grade_of_labels(), max_rated=40))
    assert (made[0].weights == made[1].weights).all() and (made[0].thresholds == made[1].thresholds).all()
    once = ordinal_quality.train(spark.createDataFrame([*base[:3], (3, min(base[3][1], "another text")), *base[4:]], "doc_id long, text string"), spark.createDataFrame(grades[:60], "doc_id long, quality int, toxic int"), ordinal_quality.grade_of_labels(), max_rated=40)
    assert (made[0].weights == once.weights).all()


def test_license_scan(spark, empty):
    mit, apache = license_scan.TEMPLATES["MIT-text"], license_scan.TEMPLATES["Apache-2.0-header"]
    rng = random.Random(9)
    cut = mit.split()
    del cut[20:26]
    docs = corpus(spark, [sentences(rng, 90) + "\n" + " ".join(cut) + "\n" + sentences(rng, 90), apache + "\n" + apache, "Released under the MIT License.", mit.replace("software", "program").upper()])
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs, ids()).collect()}
    assert len(got) == len({d for d, _ in rows_of(docs)})
    assert got[70]["license"] == "MIT-text" and math.isclose(got[70]["coverage"], 1 - 6 / len(license_scan.split_words(mit)), abs_tol=0.02)
    assert {m["license"] for m in got[71]["matches"]} == {"Apache-2.0", "Apache-2.0-header"} and got[71]["license"] == "Apache-2.0-header"
    assert got[72]["license"] == "MIT" and got[72]["coverage"] == 1.0 and got[73]["license"] == "MIT-text"
    assert all(r["license"] is None and r["coverage"] == 0 for d, r in got.items() if d is None or d < 70)
    assert license_scan.scan_licenses(empty, ids()).count() == 0


def test_license_names_and_versions(spark):
    """Texts that share most words with another license are not taken for it."""
    T = license_scan.TEMPLATES
    gpl = T["GPL-3.0-header"]
    cases = [
        ("Released under the BSD License", None), ("Released under the Foo License", None), ("Licensed under the MIT License", "MIT"), ("Licensed under CC BY 4.0", "CC-BY-4.0-notice"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
        (gpl, "GPL-3.0-header"), (gpl.replace("version 3", "version 2"), "GPL-2.0-header"), (gpl.replace("GNU General", "GNU Affero General"), "AGPL-3.0-header"), (gpl.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1-header"),
        (T["BSD-2-Clause"], "BSD-2-Clause"), (T["BSD-3-Clause"], "BSD-3-Clause"), (T["MPL-2.0"], "MPL-2.0"), (T["ISC"], "ISC"), (T["Unlicense"], "Unlicense"), ("CC0 1.0 Universal", "CC0-1.0"),
        ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "GPL-2.0-text"),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs, ids()).collect()}
    assert [(t, got[i]["license"]) for i, (t, _) in enumerate(cases)] == cases
    assert "BSD-2-Clause" not in {m["license"] for m in got[13]["matches"]}
    assert {n for n, t in T.items() for x in license_scan.REQUIRED.get(n, ()) if " ".join(map(bytes.decode, license_scan.split_words(x))) not in " ".join(map(bytes.decode, license_scan.split_words(t)))} == set()


def test_license_wherever_it_stands(spark):
    """Insertions and place do not change what is found; whole texts are told from their parts."""
    T = license_scan.TEMPLATES
    rng = random.Random(16)
    mpl = T["MPL-2.0"].split()
    spread = " ".join(w + (" rem dnl" if i % 2 else " br") for i, w in enumerate(mpl))
    rows = [(i, sentences(rng, i) + " " + spread + " " + sentences(rng, 40)) for i in range(0, 60, 4)]
    rows += [(100 + k, sentences(rng, 10) + "\n" + T[n] + "\n" + sentences(rng, 10)) for k, n in enumerate(("MIT-full", "BSD-2-Clause-full", "BSD-3-Clause-full", "ISC-full", "Unlicense-full", "Zlib", "BSL-1.0"))]
    rows += [(200, (sentences(rng, 200_000) + T["Zlib"] + sentences(rng, 100)))]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ids()).collect()}
    required = [x for x in license_scan.REQUIRED["MPL-2.0"]]
    assert required and {(got[i]["license"], got[i]["coverage"]) for i in range(0, 60, 4)} == {(None, 0.0)}  # the name does not stand there as it is
    loose = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), ids(), {"MPL-2.0": T["MPL-2.0"]})
    assert {(r["license"], r["coverage"]) for r in loose.collect() if r["doc_id"] < 60} == {("MPL-2.0", 1.0)}
    assert [got[100 + k]["license"] for k in range(7)] == ["MIT-full", "BSD-2-Clause-full", "BSD-3-Clause-full", "ISC-full", "Unlicense-full", "Zlib", "BSL-1.0"]
    assert {m["license"] for m in got[100]["matches"]} == {"MIT-full"} and got[200]["license"] == "Zlib"
    best = license_scan.align(license_scan.split_words(rows[3][1]), license_scan.split_words(T["MPL-2.0"]))
    assert len(best) == lcs(license_scan.split_words(rows[3][1]), license_scan.split_words(T["MPL-2.0"]))


def test_patience_alignment():
    rng = random.Random(10)
    for _ in range(200):
        template = [bytes([rng.randrange(97, 110)]) for _ in range(rng.randint(1, 30))]
        text = [w for w in template if rng.random() < 0.8]
        for _ in range(rng.randint(0, 5)):
            text.insert(rng.randint(0, len(text)), bytes([rng.randrange(97, 123)]))
        pairs = license_scan.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= lcs(text, template)
        if len(set(template)) == len(template) and len(set(text)) == len(text):
            assert len(pairs) == lcs(text, template)


# ---------------------------------------------------------------- 10


def test_suffix_tree(spark, empty):
    docs = corpus(spark, ["alpha beta gamma delta"] * 40, n=120)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))) % 10 == 0
    train = docs.where(~held)
    c = Counter(w for _, t in rows_of(train) for w in [*tokens(t), None])
    n, v = sum(c.values()), len(c)
    model = suffix_tree_lm.train(train, p_min=0.002, gamma=0.01, g_least=5.0)
    for size in (1 << 20, 100):  # one vocabulary block, and many
        got = suffix_tree_lm.score(docs, model, ids() | {"text": F.col("text"), "held_out": held}, block_bytes=size).collect()
        assert tally((r["doc_id"], r["text"]) for r in got) == tally(rows_of(docs))
        for r in got:
            own = [*tokens(r["text"]), None]
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert any(len(x.states) for x in model.tree.levels)
    assert suffix_tree_lm.score(empty, model, ids()).count() == 0
    assert suffix_tree_lm.score(docs, suffix_tree_lm.train(empty), ids()).where("n_known > 0").count() == 0


def test_tree_probabilities_sum_to_one(spark):
    import numpy as np

    docs = spark.createDataFrame([("a b a c a b a d " * 30,), ("b a c b a c " * 20,)], "text string")
    model = suffix_tree_lm.train(docs, p_min=0.01, gamma=0.01, g_least=1.0, kl_least=0.001)
    word, n = suffix_tree_lm.gather(model.vocabulary)
    assert sum(len(x.states) for x in model.tree.levels) > 2
    a = word[np.argsort(-n)][:3]
    for before in ([a[0]], [a[1], a[0]], [a[0], a[1], a[0]]):
        ask = np.append(word, np.uint64(12345))
        total = 0.0
        for w, count in zip(ask, np.append(n, 0), strict=True):
            t = np.array([*before, w], np.uint64)
            total += model.tree.probability(t, np.arange(len(t)), np.append(np.zeros(len(before)), count))[-1]
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_tree_grows_with_the_input(spark):
    """Contexts are admitted by count, however many other tokens there are; candidate blocks do not change the tree."""
    rng = random.Random(11)
    pairs = [(f"a{k}", f"b{k}", f"c{k}") for k in range(40)]
    few = [" ".join(pairs[k % 40]) for k in range(900)]
    noise = [" ".join(f"n{rng.randrange(30000)}" for _ in range(2000)) for _ in range(120)]
    sizes = []
    for texts in (few, few + noise):
        docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
        model = suffix_tree_lm.train(docs)
        sizes.append([len(x.states) for x in model.tree.levels])
        whole = {(r["depth"], r["h"], r["w"]): r["change"] for r in model.rows.collect()}
    assert sizes[0][0] >= 80 and all(b >= a for a, b in zip(*sizes, strict=True))
    blocks = {(r["depth"], r["h"], r["w"]): r["change"] for r in suffix_tree_lm.train(docs, block_bytes=64_000).rows.collect()}
    assert blocks.keys() == whole.keys() and all(math.isclose(blocks[k], whole[k], rel_tol=1e-9, abs_tol=1e-12) for k in whole)
    some = spark.createDataFrame(list(enumerate(texts[:200] + texts[-2:])), "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in suffix_tree_lm.score(some, model, ids(), tree_bytes=size).collect()} for size in (1 << 20, 2000))
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)


def test_counts_are_passed_on_without_a_copy_of_all():
    """A counting task holds its pairs; passing them on takes little more, and Spark gets some MB at once."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(7)
    counter = suffix_tree_lm.Counter(64)
    pairs = [(rng.integers(0, 1000, 1 << 17).astype(np.uint32), rng.integers(0, 1 << 40, 1 << 17).astype(np.uint64)) for _ in range(8)]
    assert not [x for p in pairs + pairs[:2] for x in counter.add(*p)]
    total = sizes = 0
    tracemalloc.start()
    for batch in counter.rest():
        assert batch.nbytes < 6 << 20
        sizes += 1
        for a, b, n in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n")), strict=True):
            a, b, n = suffix_tree_lm.unpacked_steps(a, np.uint32), np.frombuffer(b, np.uint64), suffix_tree_lm.unpacked(n, np.uint32)
            total += int(np.sum(n * suffix_tree_lm.entry(a.astype(np.uint64), b)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes > 2 and peak < 24 << 20, peak
    want = sum(int(np.sum(suffix_tree_lm.entry(a.astype(np.uint64), b))) for a, b in pairs + pairs[:2])
    assert total % 2**64 == want % 2**64


def test_scores_match_a_plain_walk_of_the_tree(spark):
    """Each token is scored by the longest kept suffix before it, its probability built up from the unigram's, whether rows are broadcast or dealt."""
    import numpy as np

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a b c", "a c", "b b a", "d"]) for _ in range(40)) for _ in range(30)] + [None, "", "zz unseen d a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = suffix_tree_lm.train(docs.where("doc_id < 30"), gamma=0.01, g_least=1.0, kl_least=0.001)
    rows = {(r["depth"], r["h"], r["w"]): r["change"] for r in model.rows.collect()}
    count = {r["k"]: r["n"] for r in model.vocabulary.collect()}
    signed = lambda x: int(np.uint64(x).view(np.int64))

    def plain(text):
        chunk = next(iter(suffix_tree_lm.chunks(pa.array([text or ""]))))
        t, _, _ = suffix_tree_lm.tokens(chunk)
        total = 0.0
        for i, w in enumerate(t):
            total += math.log10((count.get(signed(w), 0) + 0.1) / (model.n + 0.1 * (model.v + 1)))
            for depth in range(1, min(i, 3) + 1):
                h = np.zeros(1, np.uint64)
                for d in range(1, depth + 1):
                    h = suffix_tree_lm.extend(h, t[i - depth + d - 1 : i - depth + d], d)
                key = depth, signed(h[0])
                if (*key, None) not in rows:
                    break
                total += rows.get((*key, signed(w)), rows[*key, None])
        return total

    for size in (1 << 20, 64, 0):
        got = {r["doc_id"]: r["score"] for r in suffix_tree_lm.score(docs, model, ids(), block_bytes=size, tree_bytes=size).collect()}
        assert len(got) == len(texts) and all(math.isclose(got[i], plain(t), rel_tol=1e-9) for i, t in enumerate(texts))
