"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts of up to `max_depth` words. A context is a candidate if it occurs at least `min_count`
times before a word of the training part, whatever the input's size (so its parents are candidates too); a caller may
ask for a share `p_min` of all training tokens instead. Its next-word counts are summed over the whole training part;
words below the share `gamma` after it are left to the parent. A candidate stays if its next-word distribution diverges
from its parent's: twice the count times the divergence (the G statistic) beyond `g_least` and the divergence beyond
`kl_least`; parents of kept states stay too. A state's probabilities are discounted counts plus its parent's
distribution, weighted by what the discount left; the root is the unigram model with add-0.1 smoothing, in which all
unseen words share one place. So each state's probabilities sum to 1. A token is scored by the longest kept suffix of
the words before it.

Words and contexts are counted by 64-bit hash. Vocabulary, candidates and tree grow with the corpus, so they are tables
and never gathered whole. A counting pass gives each task's distinct (context, word) pairs, as arrays, to hash buckets, in
which they are merged; candidates are looked up in hash blocks of bounded size, with a pass over the texts per block.
A tree row holds by how much (log10) a state, or one of its words, changes its parent's probability: a token's score
is its unigram score plus one row per depth. Scoring is one pass: the most frequent words and states, as many as a fixed
size holds, are broadcast, with a Bloom filter of the others. What may be one of those goes, as arrays of hashes and row
numbers, to the hash buckets among which the rest of the model is dealt; what they add to a document's sums goes, as
arrays again, to where the document is dealt. Ascending numbers are passed on as differences, which compress.

Defined results: a null text is empty, and so has the end token only; with nothing to learn from, every token is
unseen. Repeated rows count and are scored each; ids may be null (such rows are in fold 0, which is held out). Texts of
any length are scored whole. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Lookup, Scratch, Words, as_i64, blocks_for, chunks, mix, releasing, segment_sum

ALPHA = 0.1
MIN_COUNT = 10
GAMMA = 0.02
MAX_DEPTH = 3
DISCOUNT = 0.5
G_LEAST = 30.0
KL_LEAST = 0.02
#: Bytes of the words and of the tree rows that are broadcast, 16 a row; rarer ones are joined.
BLOCK_BYTES = 8 << 20
TREE_BYTES = 16 << 20
#: Bytes of a block of candidates, 16 bytes each, that a counting pass looks up.
CANDIDATE_BYTES = 32 << 20
#: Texts are worked on in runs of about this many bytes; the arrays of a larger one leave the processor's cache.
RUN_BYTES = 1 << 18
#: Distinct keys that a counting task holds before it passes them on.
HELD_KEYS = 1 << 21
#: Rare words and states that a scoring task holds before it asks for them.
HELD_ASKED = 1 << 19
#: Bytes of packed arrays that a task hands to Spark at once, or one array if it is larger.
BATCH_BYTES = 4 << 20
#: Hash buckets of the counts for each part of the texts.
BUCKETS_PER_PART = 4
#: The filter of rare words or states: bits a key, up to a most, and those of a block, in which all of a key's are.
BITS_PER_KEY, MOST_BITS, FILTER_BLOCK, PROBES = 10, 1 << 28, 1 << 19, 4
END = np.uint64(0xE5D0F7E57)


def tokens(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text; where each text's begin; and each token's place in its text."""
    words = Words(chunk)
    at = words.first + np.arange(len(chunk) + 1)
    out = np.empty(at[-1], np.uint64)
    ends = np.zeros(at[-1], bool)
    ends[at[1:] - 1] = True
    out[ends] = END
    out[~ends] = words.hashes()
    return out, at, np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


def extend(context: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Hash of a context of `depth` words: one of a word less, and the word after it."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word, 20 + depth)


def contexts(t: np.ndarray, place: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth the hash of the words before each token, and whether there are that many."""
    h = np.zeros(len(t), np.uint64)
    for d in range(1, depth + 1):
        longer = np.zeros(len(t), np.uint64)
        longer[1:] = extend(h[:-1], t[:-1], d)
        h = longer
        yield h, place >= d


# ---------------------------------------------------------------- packed arrays


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, all least bytes first: the leading ones, mostly zeros, then compress to nothing."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpacked(blob, dtype: type) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def packed_steps(x: np.ndarray) -> bytes:
    """Ascending unsigned numbers as their differences, packed."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_steps(blob, dtype: type) -> np.ndarray:
    return np.cumsum(unpacked(blob, dtype), dtype=dtype)


# ---------------------------------------------------------------- counting


def merged(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a and b with their counts added up."""
    if not len(a):
        return a, b, n
    key = entry(a.astype(np.uint64), b)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    order, n = order, n[order]
    return a[order[new]], b[order[new]], np.add.reduceat(n, new)


class Counter:
    """Counts of (a, b) pairs, merged as they come and passed on in hash buckets when there are many. Buckets are merged one by one: only the pairs themselves are held at once."""

    def __init__(self, n_buckets: int, most: int = HELD_KEYS):
        self.parts, self.size, self.n_buckets, self.most = [], 0, n_buckets, most

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._hold(*merged(a, b, np.ones(len(a), np.uint32)))
        if self.size > 2 * self.most:
            held = list(self._merged())
            if sum(len(a) for _, a, _, _ in held) > self.most:
                yield from self._dealt(held)
            else:
                self._hold(*(np.concatenate(c) for c in list(zip(*held, strict=True))[1:]))

    def _hold(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """Pairs in the order of their keys, whose leading bits choose the bucket."""
        bucket = ((entry(a.astype(np.uint64), b) >> np.uint64(32)) * np.uint64(self.n_buckets)) >> np.uint64(32)
        self.parts.append((a, b, n.astype(np.uint32), np.searchsorted(bucket, np.arange(self.n_buckets + 1, dtype=np.uint64))))
        self.size += len(a)

    def _merged(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """What is held of each bucket; the counter lets go of it."""
        parts, self.parts, self.size = self.parts, [], 0
        for bucket in range(self.n_buckets):
            own = [tuple(x[at[bucket] : at[bucket + 1]] for x in columns) for *columns, at in parts if at[bucket] < at[bucket + 1]]
            if own:
                yield bucket, *merged(*(np.concatenate(c) for c in zip(*own, strict=True)))

    def _dealt(self, held: Iterable[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            bucket, *blobs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], ["bucket", "a", "b", "n"])

        for bucket, a, b, n in held:
            order = np.argsort(a, kind="stable")
            rows.append((bucket, packed_steps(a[order]), b[order].tobytes(), packed(n[order].astype(np.uint32))))
            size += sum(map(len, rows[-1][1:]))
            if size > BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._dealt(self._merged())


def count(texts: DataFrame, keys, rows, schema: str) -> DataFrame:
    """What rows(a, b, n) makes of the counts of all pairs that keys(chunk) gives over the table's only column."""
    n_buckets = BUCKETS_PER_PART * texts.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(n_buckets)
        for batch in batches:
            for chunk in chunks(batch.column(0), RUN_BYTES):
                yield from held.add(*keys(chunk))
        yield from held.rest()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(blobs: list[list[pa.Buffer]]) -> Iterator[pa.RecordBatch]:
            a = np.concatenate([unpacked_steps(x, np.uint32) for x, _, _ in blobs])
            b = np.concatenate([np.frombuffer(x, np.uint64) for _, x, _ in blobs])
            n = np.concatenate([unpacked(x, np.uint32) for _, _, x in blobs])
            got = rows(*merged(a, b, n.astype(np.int64)))
            for i in range(0, got.num_rows, 1 << 17):
                yield got.slice(i, 1 << 17)

        at, blobs = None, []
        for batch in batches:
            buckets, *columns = batch.columns
            for i, bucket in enumerate(buckets.to_pylist()):
                if bucket != at and blobs:
                    yield from done(blobs)
                    blobs = []
                at = bucket
                blobs.append([x[i].as_buffer() for x in columns])  # views: a batch may hold a whole partition
        if blobs:
            yield from done(blobs)

    dealt = texts.mapInArrow(releasing(run), "bucket int, a binary, b binary, n binary").repartition(n_buckets, "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(add, schema)


def gather(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A table of k and n on the driver, sorted by k as unsigned; callers bound its size."""
    t = df.toArrow()
    k = t.column("k").to_numpy().view(np.uint64) if t.num_rows else np.zeros(0, np.uint64)
    order = np.argsort(k)
    return k[order], t.column("n").to_numpy()[order] if t.num_rows else np.zeros(0, np.int64)


def entry(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0xC2B2AE3D27D4EB4F) + word, 31)


@dataclass
class Level:
    """Kept states of one depth and their (context, word) entries: hashes, and log10 of what each makes of the parent's probability."""

    states: Lookup
    left: np.ndarray
    keys: Lookup
    lift: np.ndarray


@dataclass
class Tree:
    """The levels of a tree, or of its most frequent part."""

    levels: list[Level]
    n: int
    v: int

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + ALPHA) / (self.n + ALPHA * (self.v + 1))

    def change(self, t: np.ndarray, place: np.ndarray, rare: Filter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of what the states in the tree make of each token's unigram probability; and the tokens and contexts that may be states that `rare` holds."""
        out = np.zeros(len(t))
        alive = np.ones(len(t), bool)
        more: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for level, (h, there) in zip(self.levels, contexts(t, place, len(self.levels)), strict=True):
            own = np.flatnonzero(there & alive)
            s = level.states.find(h[own])
            alive = np.zeros(len(t), bool)  # parents of states are states
            if rare is not None:
                maybe = own[s < 0]
                maybe = maybe[rare.has(h[maybe])]
                more.append((maybe, h[maybe]))
                alive[maybe] = True
            own, s = own[s >= 0], s[s >= 0]
            e = level.keys.find(entry(h[own], t[own]))
            out[own] += np.where(e >= 0, level.lift[e] if len(level.keys) else 0.0, level.left[s] if len(s) else 0.0)
            alive[own] = True
        return out, *(np.concatenate(x) for x in zip(*more, strict=True))

    def probability(self, t: np.ndarray, place: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.unigram(c) * 10.0 ** self.change(t, place)[0]


def _longer(rows: DataFrame, depth: int) -> DataFrame:
    """Adds h, the context of `depth` words that context g and word w make, and above, the same without its first word (g's is `g_above`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, g_above, w = (batch.column(x).to_numpy().view(np.uint64) for x in ("g", "g_above", "w"))
            above = extend(g_above, w, depth - 1) if depth > 1 else np.zeros(len(w), np.uint64)
            yield pa.RecordBatch.from_arrays([as_i64(extend(g, w, depth)), as_i64(above), batch.column("n")], ["h", "above", "size"])

    return rows.select("g", "g_above", "w", "n").mapInArrow(run, "h long, above long, size long")


def _count_level(texts: DataFrame, scratch: Scratch, candidates: DataFrame, depth: int, least: float, gamma: float, block_bytes: int) -> DataFrame:
    """h, w, n, size: how often a word comes after a candidate; twice or more, and often enough for an entry or a longer candidate."""
    spark = texts.sparkSession
    n_blocks = blocks_for(16 * candidates.count(), block_bytes)
    parts = []
    for block in range(n_blocks):
        h, size = gather(candidates.where(F.pmod("h", F.lit(n_blocks)) == block).select(F.col("h").alias("k"), F.col("size").alias("n")))
        shared = spark.sparkContext.broadcast((Lookup(h), size))

        def keys(chunk, shared=shared):
            t, _, place = tokens(chunk)
            h, there = list(contexts(t, place, depth))[-1]
            own = np.flatnonzero(there)
            at = shared.value[0].find(h[own])
            return at[at >= 0].astype(np.uint32), t[own[at >= 0]]

        def rows(a, w, n, shared=shared):
            size = shared.value[1][a]
            ok = (n >= 2) & ((n >= gamma * size) | (n >= least))
            return pa.RecordBatch.from_arrays([as_i64(shared.value[0].table[a[ok]]), as_i64(w[ok]), pa.array(n[ok]), pa.array(size[ok])], ["h", "w", "n", "size"])

        parts.append(scratch.save(count(texts, keys, rows, "h long, w long, n long, size long"), f"depth{depth}-{block}"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def grow(texts: DataFrame, scratch: Scratch, vocabulary: DataFrame, n: int, v: int, least: float, gamma: float, max_depth: int, g_least: float, kl_least: float, block_bytes: int) -> DataFrame:
    """depth, h, w, change, size: the kept states (w is null), their entries, and how often the state occurs. Built level by level; each level counts the next words of its candidates over all training texts."""
    words = vocabulary.where(F.col("n") >= 2).select(F.col("k").alias("w"), F.col("n").alias("word_n"))
    zero = F.lit(0).cast("long")
    often = (F.col("n") >= least) & (F.col("w") != int(END))
    # up: the contexts above, shortest first; lefts: the mass that each leaves to its parent
    first = _longer(vocabulary.withColumnRenamed("k", "w").where(often).select(zero.alias("g"), zero.alias("g_above"), "w", "n"), 1)
    candidates = first.select("h", "size", F.expr("cast(array() as array<long>)").alias("up"), F.expr("cast(array() as array<double>)").alias("lefts"))
    states: list[DataFrame] = []
    entries: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        candidates = scratch.save(candidates, f"candidates{depth}")
        pairs = _count_level(texts, scratch, candidates, depth, least, gamma, block_bytes)
        rows = pairs.where(F.col("n") >= gamma * F.col("size")).join(words, "w")
        if entries:
            rows = rows.join(candidates.select("h", "up", "lefts"), "h")
        above = (F.col("word_n") + ALPHA) / (n + ALPHA * (v + 1))
        for k, level in enumerate(entries):
            rows = rows.withColumn("__h", F.get("up", F.lit(k))).join(level.select(F.col("h").alias("__h"), "w", F.col("p").alias(f"p{k}")), ["__h", "w"], "left").drop("__h")
            above = F.coalesce(F.col(f"p{k}"), F.get("lefts", F.lit(k)) * above)
        rows = rows.select("h", "w", "n", "size", (F.col("n") / F.col("size")).alias("share"), above.alias("above"))
        rows = scratch.save(rows.where(F.col("share") > 1.05 * F.col("above")), f"rows{depth}")
        sums = rows.groupBy("h").agg(
            F.sum(F.col("n") - DISCOUNT).alias("taken"), F.sum("share").alias("s"), F.sum("above").alias("a"), F.sum(F.col("share") * F.log(F.col("share") / F.col("above"))).alias("d")
        )
        some = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        rest = F.greatest(1 - some("s"), F.lit(0.0))
        kl = some("d") + rest * F.log(F.greatest(rest, F.lit(1e-12)) / F.greatest(1 - some("a"), F.lit(1e-12)))
        marked = (F.col("kl") >= kl_least) & (2 * F.col("size") * F.col("kl") >= g_least)
        level = candidates.join(sums, "h", "left").withColumn("kl", kl)
        states.append(scratch.save(level.select("h", "size", "up", "lefts", ((F.col("size") - some("taken")) / F.col("size")).alias("left"), marked.alias("marked")), f"states{depth}"))
        p = (F.col("n") - DISCOUNT) / F.col("size") + F.col("left") * F.col("above")
        scratch.collect()
        entries.append(scratch.save(rows.join(states[-1].select("h", "left"), "h").select("h", "w", p.alias("p"), F.log10(p / F.col("above")).alias("change")), f"entries{depth}"))
        if depth < max_depth:
            # a word after a context that often is a longer context; the same without its first word is its parent
            level = states[-1].select("h", "up", "lefts", "left")
            known = pairs.where(often).drop("size").withColumnRenamed("h", "g").join(candidates.select(F.col("h").alias("g"), F.coalesce(F.try_element_at("up", F.lit(-1)), zero).alias("g_above")), "g")
            longer = _longer(known, depth + 1).withColumnRenamed("h", "longer").withColumnRenamed("above", "h").join(level, "h")
            candidates = longer.select(F.col("longer").alias("h"), "size", F.array_append("up", F.col("h")).alias("up"), F.array_append("lefts", F.col("left")).alias("lefts"))
    kept: list[DataFrame] = []
    for depth in range(max_depth, 0, -1):
        own = states[depth - 1]
        if kept:
            below = kept[-1].select(F.try_element_at("up", F.lit(-1)).alias("h")).distinct().withColumn("needed", F.lit(True))
            own = own.join(below, "h", "left").where(F.col("marked") | F.col("needed").isNotNull()).drop("needed")
        kept.append(scratch.save(own if kept else own.where("marked"), f"kept{depth}"))
    parts = []
    for depth, (own, level) in enumerate(zip(kept[::-1], entries, strict=True), 1):
        parts.append(own.select(F.lit(depth).alias("depth"), "h", F.lit(None).cast("long").alias("w"), F.log10("left").alias("change"), "size"))
        parts.append(level.join(own.select("h", "size"), "h").select(F.lit(depth).alias("depth"), "h", "w", "change", "size"))
    tree = scratch.save(reduce(DataFrame.unionByName, parts), "tree")
    for depth in range(1, max_depth + 1):
        for name in ("candidates", "rows", "states", "entries", "kept"):
            scratch.drop(f"{name}{depth}")
    scratch.collect()
    return tree


@dataclass
class Model:
    """The tree (depth, h, w, change, size) and the training vocabulary (k: word hash, n: count) as tables; n tokens, v words."""

    rows: DataFrame
    vocabulary: DataFrame
    n: int
    v: int
    max_depth: int

    def part(self, rows: DataFrame) -> Tree:
        """Rows of the tree, on the driver; callers bound them."""
        t = rows.toArrow()
        depth, change = t.column("depth").to_numpy(), t.column("change").to_numpy()
        h, w = (t.column(x).fill_null(0).to_numpy().view(np.uint64) for x in ("h", "w"))
        is_state = t.column("w").is_null().to_numpy()
        levels = []
        for d in range(1, self.max_depth + 1):
            s, e = (depth == d) & is_state, (depth == d) & ~is_state
            states, keys = h[s], entry(h[e], w[e])
            a, b = np.argsort(states), np.argsort(keys)
            levels.append(Level(Lookup(states[a]), change[s][a], Lookup(keys[b]), change[e][b]))
        return Tree(levels, self.n, self.v)

    @property
    def tree(self) -> Tree:
        """The whole tree on the driver, for small ones."""
        return self.part(self.rows)


def train(
    docs: DataFrame, text_col: str = "text", p_min: float | None = None, gamma: float = GAMMA, max_depth: int = MAX_DEPTH, g_least: float = G_LEAST, kl_least: float = KL_LEAST,
    scratch: Scratch | None = None, min_count: int = MIN_COUNT, block_bytes: int = CANDIDATE_BYTES,
) -> Model:
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def words(chunk):
        t = tokens(chunk)[0]
        return np.zeros(len(t), np.uint32), t

    counted = count(texts, words, lambda a, w, n: pa.RecordBatch.from_arrays([as_i64(w), pa.array(n)], ["k", "n"]), "k long, n long")
    vocabulary = scratch.save(counted, "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(2.0, min_count if p_min is None else p_min * n)
    return Model(grow(texts, scratch, vocabulary, n, v, least, gamma, max_depth, g_least, kl_least, block_bytes), vocabulary, n, v, max_depth)


# ---------------------------------------------------------------- scoring


@dataclass
class Filter:
    """A Bloom filter of 64-bit hashes; a key's bits are all in one block, chosen by its leading bits."""

    bits: np.ndarray
    shift: int

    def has(self, h: np.ndarray) -> np.ndarray:
        at = probes(h, self.shift)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def probes(h: np.ndarray, shift: int) -> np.ndarray:
    """Bit positions, a row per probe, where the leading 64 - shift bits choose the block."""
    start = (h >> np.uint64(shift)) * np.uint64(FILTER_BLOCK) if shift < 64 else np.zeros(len(h), np.uint64)
    h = mix(h, 33)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([start + ((h + np.uint64(i) * step) & np.uint64(FILTER_BLOCK - 1)) for i in range(PROBES)]).astype(np.int64)


def filter_of(keys: DataFrame, n_keys: int) -> Filter:
    """Of a table's only column of hashes, built block by block; its size is bounded, beyond which more is let through."""
    size = 1 << max(0, min(MOST_BITS, n_keys * BITS_PER_KEY) // FILTER_BLOCK).bit_length()
    size = min(size, MOST_BITS // FILTER_BLOCK)
    shift = 65 - size.bit_length()
    block = F.shiftrightunsigned("h", shift).cast("int") if shift < 64 else F.lit(0)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for k in np.unique(blocks).tolist():
                bits = have.setdefault(k, np.zeros(FILTER_BLOCK // 8, np.uint8))
                at = (probes(h[blocks == k], shift) & (FILTER_BLOCK - 1)).ravel()
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for k, bits in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    bits = np.zeros(size * FILTER_BLOCK // 8, np.uint8)
    for r in keys.toDF("h").select(block.alias("block"), "h").repartition("block").mapInArrow(fill, "block int, bits binary").collect():
        bits[r["block"] * FILTER_BLOCK // 8 : (r["block"] + 1) * FILTER_BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return Filter(bits, shift)


def split_at(table: DataFrame, size: str, n_rows: int, most: int) -> int:
    """Least power of two so that no more than `most` rows have that size or more; 0 if all do."""
    if n_rows <= most:
        return 0
    power = F.floor(F.log2(F.col(size).cast("double"))).cast("int")
    total, cut = 0, 62
    for r in table.groupBy(power.alias("power")).count().orderBy(F.desc("power")).collect():  # 64 rows at most
        total += r["count"]
        if total > most:
            break
        cut = r["power"]
    return 1 << cut


#: Kinds of rows in the shuffles that score rare words and states: what the model has, what is asked of it, what that adds to sums, the documents.
WORD, STATE, ENTRY, ASKED_WORD, ASKED_STATE, SUMS, DOCUMENT = range(7)
PARCEL = "bucket int, kind int, a binary, b binary, n binary"


def parcels(kind: int, h: np.ndarray, columns: list[np.ndarray], n_buckets: int, row: np.ndarray | None = None) -> pa.RecordBatch:
    """Columns (a and perhaps b) and ascending row numbers (n) dealt to buckets by the hash h, an array for each; the order within is kept."""
    bucket = (mix(h, 34) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket)) if len(bucket) else np.zeros(1, np.int64)

    def cut(x: np.ndarray, pack) -> pa.Array:
        x = x[order]
        return pa.array([pack(x[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())

    rows = len(at) - 1
    none = pa.nulls(rows, pa.binary())
    arrays = [*[cut(x, np.ndarray.tobytes) for x in columns], *[none] * (2 - len(columns)), none if row is None else cut(row.view(np.uint64), packed_steps)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), pa.array(np.full(rows, kind, np.int32)), *arrays], ["bucket", "kind", "a", "b", "n"])


def padded(parcel: pa.RecordBatch, blank: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Parcels with nulls for the documents' columns, some bytes of them at once."""
    out = pa.RecordBatch.from_arrays([*parcel.columns, *(pa.nulls(parcel.num_rows, f.type) for f in blank)], [*parcel.schema.names, *(f.name for f in blank)])
    step = max(1, parcel.num_rows * BATCH_BYTES // max(1, parcel.nbytes))
    for i in range(0, parcel.num_rows, step):
        yield out.slice(i, step)


def _model_parcels(model: Model, word_cut: int, tree_cut: int, n_buckets: int) -> DataFrame:
    """The words and tree rows that are not broadcast, dealt by the hash of the word or state."""

    def deal(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, key = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
                yield parcels(kind, h, [entry(h, key) if kind == ENTRY else h, batch.column(2).to_numpy()], n_buckets)

        return run

    words = model.vocabulary.where(F.col("n") < word_cut).select("k", "k", F.log10((F.col("n") + ALPHA) / ALPHA).alias("x")).toDF("h", "w", "x")
    rows = model.rows.where(F.col("size") < tree_cut)
    states = rows.where("w is null").select("h", F.col("h").alias("w"), F.col("change").alias("x"))
    entries = rows.where("w is not null").select("h", "w", F.col("change").alias("x"))
    dealt = [t.mapInArrow(deal(kind), PARCEL) for kind, t in ((WORD, words), (STATE, states), (ENTRY, entries))]
    return reduce(DataFrame.unionByName, dealt)


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text", block_bytes: int = BLOCK_BYTES, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """`keep`, then n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row.

    `docs` is a table as read or written: a task that is run again must find its rows in the same order.
    """
    spark = docs.sparkSession
    n_rows = model.rows.count()
    word_cut, tree_cut = split_at(model.vocabulary, "n", model.v, block_bytes // 16), split_at(model.rows, "size", n_rows, tree_bytes // 16)
    word, n = gather(model.vocabulary.where(F.col("n") >= word_cut))
    words = Lookup(word), n, filter_of(model.vocabulary.where(F.col("n") < word_cut).select("k"), model.v) if word_cut else None
    rare_states = model.rows.where((F.col("size") < tree_cut) & F.col("w").isNull())
    tree = model.part(model.rows.where(F.col("size") >= tree_cut)), filter_of(rare_states.select("h"), n_rows) if tree_cut else None
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), *[c.alias(f"__k_{k}") for k, c in keep.items()], F.col(text_col).cast("string").alias("__text"))
    n_buckets = BUCKETS_PER_PART * max(1, rows.rdd.getNumPartitions())
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    result = kept + "n_tokens long, n_known long, base_score double, score double"
    got = rows.mapInArrow(releasing(_first_pass(spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(tree), n_buckets)), f"{PARCEL}, {result}")
    carried = rows.columns[1:-1]
    if word_cut or tree_cut:
        got = got.unionByName(_model_parcels(model, word_cut, tree_cut, n_buckets), allowMissingColumns=True)
        got = got.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer(n_buckets), f"{PARCEL}, {result}")
        got = got.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_add_sums, result)
    else:
        got = got.where(F.col("kind") == DOCUMENT)
    out = [F.col(c).alias(k) for c, k in zip(carried, keep, strict=True)]
    return got.select(*out, "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def _first_pass(words, tree, n_buckets: int):
    """Scores texts by what is broadcast; the rare words and states that they may need go out as parcels of hashes and row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word, n, rare), (own, rare_states) = words.value, tree.value
        none = np.zeros(0, np.uint64)
        held: list[tuple[np.ndarray, ...]] = []
        size, blank = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                w, w_row, h, t, row = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                if len(w):
                    yield from padded(parcels(ASKED_WORD, w, [w], n_buckets, w_row), blank)
                if len(h):
                    yield from padded(parcels(ASKED_STATE, h, [h, t], n_buckets, row), blank)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for chunk in chunks(batch.column(batch.num_columns - 1), RUN_BYTES):
                t, at, place = tokens(chunk)
                found = word.find(t)
                c = np.where(found >= 0, n[found] if len(n) else 0, 0)
                base = np.log10(own.unigram(c))
                change, asked, context = own.change(t, place, rare_states)
                unknown = np.flatnonzero(found < 0) if rare is not None else np.zeros(0, np.int64)
                unknown = unknown[rare.has(t[unknown])] if len(unknown) else unknown
                part = batch.slice(chunk.first, len(chunk))
                row = ids[chunk.first : chunk.first + len(chunk)]
                owner = np.repeat(row, np.diff(at))
                order = np.argsort(asked, kind="stable")
                asked, context = asked[order], context[order]
                if len(unknown) or len(asked):
                    held.append((t[unknown], owner[unknown], context if len(asked) else none, t[asked], owner[asked]))
                    size += len(unknown) + len(asked)
                sums = [segment_sum(x, at) for x in (np.ones(len(t), np.int64), (c > 0).astype(np.int64), base, base + change)]
                parcel = [pa.array((mix(row.view(np.uint64), 34) % np.uint64(n_buckets)).astype(np.int32)), pa.array(np.full(len(chunk), DOCUMENT, np.int32)), *[pa.nulls(len(chunk), pa.binary())] * 3]
                out = pa.RecordBatch.from_arrays([*parcel, *part.columns[:-1], *map(pa.array, sums)], ["bucket", "kind", "a", "b", "n", *batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])
                blank = list(out.schema)[5:]
                yield out
                if size > HELD_ASKED:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


class Answers:
    """Sums by row number of what is known of rare words and states, added up as they come."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, row: np.ndarray, known: int | np.ndarray, base: np.ndarray, change: np.ndarray) -> None:
        self.parts.append((row, np.broadcast_to(np.asarray(known, np.int64), len(row)), base, change))
        self.size += len(row)

    def summed(self) -> tuple[np.ndarray, ...]:
        row, *values = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(row, kind="stable")
        row = row[order]
        new = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        self.parts = [(row[new], *(np.add.reduceat(x[order], new) for x in values))]
        self.size = len(new)
        return self.parts[0]


def _answer(n_buckets: int):
    """Rows by bucket and kind: a bucket's part of the model first, then what is asked of it; documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, at, of, part, tables, blank = Answers(), None, None, {}, {}, None
        asked: list[tuple[np.ndarray, ...]] = []  # of one bucket and kind
        n_asked = 0

        def table(kind: int) -> tuple[Lookup, np.ndarray]:
            if kind not in tables:
                got = part.pop(kind, [])
                key = np.concatenate([a for a, _ in got]) if got else np.zeros(0, np.uint64)
                x = np.concatenate([b for _, b in got]) if got else np.zeros(0)
                order = np.argsort(key)
                tables[kind] = Lookup(key[order]), x[order]
            return tables[kind]

        def sent() -> Iterator[pa.RecordBatch]:
            row, known, base, change = answers.summed()
            answers.parts, answers.size = [], 0
            # where the documents are dealt; a sum and the change of it side by side
            out = parcels(SUMS, row.view(np.uint64), [known, np.stack((base, change), 1)], n_buckets, row)
            yield from padded(out, blank)

        def answered() -> Iterator[pa.RecordBatch]:
            nonlocal n_asked
            if not asked:
                return
            h, row = (np.concatenate(x) for x in list(zip(*asked, strict=True))[:2])
            t = np.concatenate([x for _, _, x in asked]) if of == ASKED_STATE else None
            asked.clear()
            n_asked = 0
            keys, x = table(WORD if of == ASKED_WORD else STATE)
            found = keys.find(h)
            hit = found >= 0
            h, row, x = h[hit], row[hit], x[found[hit]]
            if of == ASKED_WORD:
                answers.add(row, 1, x, np.zeros(len(row)))
            else:
                lifts, lift = table(ENTRY)
                e = lifts.find(entry(h, t[hit]))
                answers.add(row, 0, np.zeros(len(row)), np.where(e >= 0, lift[e], x) if len(lift) else x)
            if answers.size > HELD_KEYS:
                answers.summed()
                if answers.size > HELD_KEYS // 2:
                    yield from sent()

        for batch in batches:
            kinds = batch.column(1).to_numpy()
            blank = list(batch.schema)[5:]
            documents = np.flatnonzero(kinds == DOCUMENT)
            if len(documents):
                yield batch.take(pa.array(documents))
            buckets, *blobs = (batch.column(i) for i in (0, 2, 3, 4))
            for i in np.flatnonzero(kinds != DOCUMENT).tolist():
                bucket, kind = buckets[i].as_py(), kinds[i]
                a, b, n = (x[i].as_buffer() for x in blobs)  # views: a batch may hold a whole partition
                if (bucket, kind) != (at, of):
                    yield from answered()
                    of = kind
                if bucket != at:
                    at, part, tables = bucket, {}, {}
                if kind <= ENTRY:
                    part.setdefault(kind, []).append((np.frombuffer(a, np.uint64).copy(), np.frombuffer(b, np.float64).copy()))
                    continue
                asked.append((np.frombuffer(a, np.uint64), unpacked_steps(n, np.uint64).view(np.int64), np.frombuffer(b, np.uint64) if kind == ASKED_STATE else None))
                n_asked += len(asked[-1][0])
                if n_asked > HELD_ASKED:
                    yield from answered()
            yield from answered()  # the batch goes
        if answers.size:
            yield from sent()

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket and kind: what its documents' rare words and states add to their sums, then the documents."""
    at, sums, is_summed = None, Answers(), False
    for batch in batches:
        buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((buckets[1:] != buckets[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
            if buckets[i] != at:
                at, sums, is_summed = buckets[i], Answers(), False
            if kinds[i] == SUMS:
                for a, b, n in zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in (2, 3, 4)), strict=True):
                    values = np.frombuffer(b, np.float64).reshape(-1, 2)
                    sums.add(unpacked_steps(n, np.uint64).view(np.int64), np.frombuffer(a, np.int64), values[:, 0], values[:, 1])
                continue
            own = batch.slice(i, j - i)
            row, known, base, score = (own.column(c).to_numpy() for c in ("__row", "n_known", "base_score", "score"))
            if sums.parts:
                rows, more, lift, change = sums.parts[0] if is_summed else sums.summed()
                is_summed = True
                place = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
                there = rows[place] == row
                known, lift = known + np.where(there, more[place], 0), np.where(there, lift[place], 0.0)
                base, score = base + lift, score + lift + np.where(there, change[place], 0.0)
            yield pa.RecordBatch.from_arrays([*own.columns[5:-3], *map(pa.array, (known, base, score))], own.schema.names[5:])
