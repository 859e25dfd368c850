"""N-gram Jaccard join over count vectors, as a distributed similarity join with connected components.

A document is its set of distinct word shingles, held as 64-bit hashes. Documents with equal sets are one class, so
copies cost one row each and are never paired. Classes are linked when the Jaccard index reaches the threshold.

Two sets that are similar enough differ in few shingles. Tokens are hashed into more groups than that, so some group
holds the same shingles in both: classes that share a group's content (in the same size band) are candidates, found
by one equi-join key per group. Those whose count vectors bound their overlap below what is needed are dropped (by an
R-tree where a key has many), and the others are gathered into clusters. Groups that happen to be empty agree
without meaning; there are groups to spare for them, and classes with more empty ones use these too, so that no pair
is lost. Small sets are dealt by their first shingles in hash order, some of which similar sets share. Within a cluster the count-vector R-tree does the join: group counts are points, a node's corner of
maxima bounds the overlap of all below it by summed coordinate minima, node pairs that cannot reach the needed
overlap are skipped, and surviving pairs are verified on the whole sets. A pair whose classes are already connected
need not be verified. Large clusters are cut into blocks of bounded size, by set size, and block pairs that could hold a
link are joined as tasks of their own. A key that very many classes share makes all of them candidates of one, already
in the tasks that sign, so that it is no task of its own.

Defined results: a document without words or text has an empty set and is linked with nothing (its component is its
own id). Repeated rows are copies of each other. Null ids are allowed; they never name a component unless all its
ids are null. Texts of any length are shingled whole; of equal candidates the order does not matter, as components do not
depend on it. An empty table gives an empty table. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import BROADCAST_BYTES, Scratch, Words, as_i64, chunks, mix
from docloom.llm.components import connected_components

#: Size bands grow by this factor.
BAND = 1.45
#: Sets of fewer shingles are too small for groups: they are dealt by the shingles themselves.
SMALL = 32
DIMENSIONS = 64
LEAF = 32
#: Shingles in a block of a large cluster (or one set, if it has more).
BLOCK_SHINGLES = 200_000
#: Sets of a cluster whose sizes differ by less than this factor are dealt to blocks by hash.
SIZE_STEP = 1.1
#: Rows that a task signs at once, and of one key among them beyond which they are joined there.
SIGNED_ROWS, HOT_ROWS = 1 << 20, 1024
#: Sets of a key that are compared by their count vectors; where there are more, all are taken for candidates of one.
MOST_COMPARED = 4096
#: Groups to spare: so many deviations more than are empty on average.
SPARE_DEVIATIONS = 4.5


def shingles(chunk, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer words is one shingle."""
    words = Words(chunk)
    h = words.hashes()
    whole = np.zeros(len(h), np.uint64)
    for k in range(size):
        whole[: len(h) - k] = mix(whole[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:], 40) if k < len(h) else whole[: len(h) - k]
    out = []
    for i in range(len(chunk)):
        first, n = int(words.first[i]), int(words.count[i])
        if n >= size:
            own = np.sort(whole[first : first + n - size + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) > 1 else own)
        elif n:
            one = np.array([n], np.uint64)
            for k in range(n):
                one = mix(one * np.uint64(0x9E3779B97F4A7C15) + h[first + k], 41)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Plan:
    """What follows from the threshold num/den: size bands, groups per band, overlaps needed."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        edges = [SMALL]
        while edges[-1] < 1 << 40:
            edges.append(int(edges[-1] * BAND))
        self.edges = np.array(edges)
        self._groups: dict[int, tuple[int, int]] = {}

    def differing(self, n: int) -> int:
        """Most shingles in which a set of n and a similar one of as many or more can differ."""
        return n * (self.den - self.num) // self.num

    def groups(self, band: int) -> tuple[int, int]:
        """Groups of a band, and how many of them are to spare for empty ones."""
        if band not in self._groups:
            least, low = self.differing(int(self.edges[band + 1]) - 1) + 1, int(self.edges[band])
            spare = 1
            while spare < least:
                empty = (least + spare) * math.exp(-low / (least + spare))
                if spare >= empty + SPARE_DEVIATIONS * math.sqrt(empty):
                    break
                spare += 1
            self._groups[band] = least + spare, spare
        return self._groups[band]

    def bands(self, n: int) -> list[int]:
        """The band a set of n shingles is in, and those below in which a similar set could be."""
        own = int(np.searchsorted(self.edges, n, "right")) - 1
        return [b for b in range(own, -1, -1) if b == own or self.den * (int(self.edges[b + 1]) - 1) >= self.num * n]

    def has_small(self, n: int) -> bool:
        """Whether a set of n shingles is small or could be similar to a small one."""
        return self.num * n <= self.den * (SMALL - 1)

    def needed(self, total):
        """Least overlap of two sets with `total` shingles together."""
        return -(-total * self.num // (self.num + self.den))


def signatures(own: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys that two similar sets, if not equal, have at least one of in common."""
    n = len(own)
    if not plan.differing(n):
        return np.zeros(0, np.uint64)
    out = []
    if plan.has_small(n):
        # small sets: those shingles of each that come first by hash, as many as cannot all be missing in the other
        out.append(mix(own[: n + (-plan.num * n // plan.den) + 1], 48))
    mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(own, 42), dtype=np.uint64)))
    for band in plan.bands(n):
        p, spare = plan.groups(band)
        cut = np.searchsorted(own, _group_starts(p))
        content = mixed[cut[1:]] - mixed[cut[:-1]]
        full = cut[1:] > cut[:-1]
        if p - full.sum() > spare:
            full[:] = True
        out.append(mix(content + _group_names(band, p), 44)[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spread_hot(keys: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and signatures with even signatures, but for a signature that has very many rows: its first key stays, and
    shares an odd signature of its own with each of the others, which makes them candidates as they are."""
    sigs = sigs & ~np.uint64(1)
    order = np.argsort(sigs, kind="stable")
    keys, sigs = keys[order], sigs[order]
    begin = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
    size = np.diff(np.append(begin, len(sigs)))
    hot = np.repeat(size > HOT_ROWS, size)
    if not hot.any():
        return keys, sigs
    first = np.repeat(keys[begin], size)
    stays = ~hot
    stays[begin] = True
    away = ~stays & (keys != first)
    pair = mix(sigs[away] + mix(keys[away], 49), 49) | np.uint64(1)
    return np.concatenate((keys[stays], first[away], keys[away])), np.concatenate((sigs[stays], pair, pair))


_starts: dict[int, np.ndarray] = {}


def _group_starts(p: int) -> np.ndarray:
    """Bounds of p equal ranges of hashes, the last one closed."""
    if p not in _starts:
        step = (1 << 64) // p
        _starts[p] = np.append(np.arange(p, dtype=np.uint64) * np.uint64(step), np.uint64((1 << 64) - 1))
    return _starts[p]


def _group_names(band: int, p: int) -> np.ndarray:
    return mix(np.arange(p, dtype=np.uint64) + np.uint64(band << 40), 43)


def class_key(own: np.ndarray) -> int:
    return int(mix(mix(own, 45).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)), 46)[0])


# ---------------------------------------------------------------- the R-tree within a block


def dimensions(n: int) -> int:
    """Groups for a set of n shingles: so many that unlike sets of that size differ by more than similar ones may."""
    return max(DIMENSIONS, 1 << max(0, n // 12 - 1).bit_length()) if n else DIMENSIONS


def count_vector(own: np.ndarray, size: int) -> np.ndarray:
    """How many of a set's shingles are in each of `size` hashed groups; neighbours add up to half as many groups."""
    cells = mix(own, 47) >> np.uint64(64 - size.bit_length() + 1)
    return np.bincount(cells.astype(np.int64), minlength=size).astype(np.int32)


def count_vectors(sets: list[np.ndarray]) -> np.ndarray:
    """One point a set, all with the dimensions that the smallest set has."""
    size = min((dimensions(len(s)) for s in sets), default=DIMENSIONS)
    return np.array([count_vector(s, size) for s in sets], np.int32).reshape(len(sets), size)


def pack_vector(v: np.ndarray) -> bytes:
    kind = "<u1" if v.max() < 256 else "<i4"
    return kind.encode() + v.astype(kind).tobytes()


def unpack_vectors(packed: list[bytes]) -> np.ndarray:
    vectors = [np.frombuffer(x, x[:3].decode(), offset=3).astype(np.int32) for x in packed]
    size = min(len(v) for v in vectors)
    return np.array([v.reshape(size, -1).sum(axis=1) for v in vectors], np.int32)


class RTree:
    """Points packed into leaves of near sets; each node keeps its corner of maxima and its smallest set size."""

    def __init__(self, points: np.ndarray):
        self.points, self.n = points, points.sum(axis=1)
        self.root = self._pack(np.arange(len(points)))

    def _pack(self, members: np.ndarray):
        high, least = self.points[members].max(axis=0), int(self.n[members].min())
        if len(members) <= LEAF:
            return high, least, members, None
        own = self.points[members]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        spread = own[:, axis] if np.ptp(self.n[members]) < np.ptp(own[:, axis]) else self.n[members]
        order = np.argsort(spread, kind="stable")
        half = len(members) // 2
        return high, least, members, (self._pack(members[order[:half]]), self._pack(members[order[half:]]))

    def pairs(self, plan: Plan, other: RTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions, in batches, whose bound reaches the overlap they need; with `other`, across the two."""
        stack = [(self.root, (other or self).root)]
        right = other or self
        while stack:
            a, b = stack.pop()
            if np.minimum(a[0], b[0]).sum() < plan.needed(a[1] + b[1]):
                continue
            if a[3] is None and b[3] is None:
                x, y = a[2], b[2]
                bound = np.minimum(self.points[x][:, None, :], right.points[y][None, :, :]).sum(axis=2)
                ok = bound >= plan.needed(self.n[x][:, None] + right.n[y][None, :])
                if other is None and a is b:
                    ok &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
                i, j = np.nonzero(ok)
                if len(i):
                    yield x[i], y[j]
            elif other is None and a is b:
                stack += [(a[3][0], a[3][0]), (a[3][1], a[3][1]), (a[3][0], a[3][1])]
            elif b[3] is None or (a[3] is not None and len(a[2]) >= len(b[2])):
                stack += [(a[3][0], b), (a[3][1], b)]
            else:
                stack += [(a, b[3][0]), (a, b[3][1])]


def links(sets: list[np.ndarray], split: int, plan: Plan) -> list[tuple[int, int]]:
    """Links that connect what all links connect: among all sets, or if split > 0 between the first `split` and the rest.

    A pair is verified on the whole sets unless earlier links already connect it.
    """
    label = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    n = np.array([len(s) for s in sets])
    points = count_vectors(sets)
    if split:
        batches = ((i, j + split) for i, j in RTree(points[:split]).pairs(plan, RTree(points[split:])))
    else:
        batches = RTree(points).pairs(plan)
    for i, j in batches:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        begin = np.append(np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))), len(i))
        for k in range(len(begin) - 1):
            a, others = int(i[begin[k]]), j[begin[k] : begin[k + 1]]
            others = others[label[others] != label[a]]
            while len(others):
                # one candidate of each component first; those of a component that gets linked need no check
                _, pick = np.unique(label[others], return_index=True)
                tried = others[pick]
                both = _overlaps(sets[a], [sets[b] for b in tried])
                hit = tried[plan.den * both >= plan.num * (n[a] + n[tried] - both)]
                for b in hit.tolist():
                    if label[a] != label[b]:
                        out.append((a, b))
                        label[label == label[b]] = label[a]
                others = np.delete(others, pick)
                others = others[label[others] != label[a]]
    return out


def possible_links(points: np.ndarray, plan: Plan) -> list[tuple[int, int]]:
    """Pairs that the bound leaves possible, as few as connect what all of those do."""
    if len(points) == 2:
        return [(0, 1)] if np.minimum(points[0], points[1]).sum() >= plan.needed(int(points.sum())) else []
    label = np.arange(len(points))
    out: list[tuple[int, int]] = []
    for i, j in RTree(points).pairs(plan):
        for a, b in zip(i.tolist(), j.tolist(), strict=True) if len(np.unique(label[np.concatenate((i, j))])) > 1 else ():
            if label[a] != label[b]:
                out.append((a, b))
                label[label == label[b]] = label[a]
    return out


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    at[at == len(one)] = 0
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in others])[:-1])))


# ---------------------------------------------------------------- the distributed join


def similar_documents(docs: DataFrame, num: int = 80, den: int = 100, size: int = 5, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, text_hash, n_shingles, class_key (documents with equal sets), root (class that names the component), component_id (smallest id connected by links)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    plan = Plan(num, den)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    shingle_words = size
    kind = rows.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                sets = shingles(chunk, size)
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.array([class_key(s) for s in sets], np.uint64)
                own = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(n), pa.array(keys.view(np.int64), mask=n == 0), pa.array([pack_vector(count_vector(s, dimensions(len(s)))) for s in sets], pa.binary())], ["id", "text_hash", "n", "key", "vector"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies that a task has signed
        found: list[np.ndarray] = []
        names: list[int] = []

        def flush() -> pa.RecordBatch:
            keys, sigs = spread_hot(np.repeat(np.array(names, np.uint64), [len(x) for x in found]), np.concatenate(found))
            return pa.RecordBatch.from_arrays([as_i64(keys), as_i64(sigs)], ["key", "sig"])

        size = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for own in shingles(chunk, shingle_words):
                    if len(own) and (key := class_key(own)) not in done:
                        done.add(key)
                        found.append(signatures(own, plan))
                        names.append(key)
                        size += len(found[-1])
                if size >= SIGNED_ROWS:
                    yield flush()
                    found.clear()
                    names.clear()
                    size = 0
        if found:
            yield flush()

    described = scratch.save(rows.mapInArrow(describe, f"id {kind}, text_hash long, n long, key long, vector binary"), "described")
    # written nowhere but in its shuffle, as it is the largest table here
    signed = rows.select("text").mapInArrow(sign, "key long, sig long")
    order = Window.partitionBy("sig").orderBy("key")
    near = signed.withColumns({"before": F.lag("key").over(order), "after": F.lead("key").over(order)}).where("before <> key or after <> key").select("sig", "key")
    vectors = described.where("key is not null").groupBy("key").agg(F.first("vector").alias("vector"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: list[int], packed: list[bytes]) -> list[tuple[int, int]]:
            return [(keys[i], keys[j]) for i, j in possible_links(unpack_vectors(packed), plan)] if len(keys) > 1 else []

        def made(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

        at, keys, packed, out, hub = None, [], [], [], None
        for batch in batches:
            for sig, key, vector in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if sig != at:
                    out += done(keys, packed)
                    at, keys, packed, hub = sig, [], [], None
                if hub is not None:
                    if key != hub:
                        out.append((hub, key))
                elif not keys or key != keys[-1]:
                    keys.append(key)
                    packed.append(vector)
                    if sig & 1 or len(keys) > MOST_COMPARED:
                        hub = keys[0]
                        out += [(hub, k) for k in keys[1:]]
                        keys, packed = [], []
            yield made(out)
            out = []
        yield made(done(keys, packed))

    blocks = near.join(vectors, "key").select("sig", "key", "vector").repartition("sig").sortWithinPartitions("sig", "key")
    candidates = blocks.mapInArrow(bound, "a long, b long").distinct()
    clusters = scratch.save(connected_components(candidates, scratch, "candidates"), "clusters")
    linked = _cluster_links(rows, clusters, described, plan, size, scratch)
    final = scratch.save(connected_components(linked, scratch, "links"), "components")
    classes = described.where("key is not null").groupBy("key").agg(F.min("id").alias("least"))
    joined = classes.join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "root", "component_id")
    out = described.select("id", "text_hash", "n", "key").join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("n").alias("n_shingles"), F.col("key").alias("class_key"), "root", F.coalesce("component_id", "id").alias("component_id"))


def _cluster_links(rows: DataFrame, clusters: DataFrame, described: DataFrame, plan: Plan, size: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect the classes of each cluster as all its links do."""
    spark = rows.sparkSession
    sizes = described.where("key is not null").groupBy("key").agg(F.max("n").alias("n"))
    nodes = clusters.withColumnRenamed("node", "key").join(sizes, "key")
    # by size: sets of about one size are dealt by hash to as many blocks as they fill, after those of smaller ones
    nodes = nodes.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)))
    steps = nodes.groupBy("root", "step").agg(F.sum("n").alias("own"))
    before = F.sum("own").over(Window.partitionBy("root").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))  # a row a size
    steps = steps.select("root", "step", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_SHINGLES).alias("from"), F.ceil(F.col("own") / BLOCK_SHINGLES).alias("blocks"))
    block = F.col("from") + F.pmod(F.xxhash64("key"), F.col("blocks"))
    nodes = scratch.save(nodes.join(steps, ["root", "step"]).select("key", "root", "n", block.cast("int").alias("block")), "nodes")
    blocks = nodes.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = blocks.select("root", F.col("block").alias("i"), F.col("high")), blocks.select("root", F.col("block").alias("j"), F.col("low"))
    tasks = x.join(y, "root").where((F.col("i") <= F.col("j")) & (plan.den * F.col("high") >= plan.num * F.col("low"))).select("root", "i", "j")
    ends = tasks.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    placed = nodes.join(ends, ["root", "block"]).select("key", "root", "i", "j", (F.col("block") != F.col("i")).alias("right"))
    wanted = nodes.select("key")
    n_wanted = nodes.count()
    if 8 * n_wanted <= BROADCAST_BYTES:
        keys = np.sort(wanted.toArrow().column("key").to_numpy()) if n_wanted else np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast(keys)
    else:
        shared = None

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                sets = shingles(chunk, size)
                key = np.array([class_key(s) for s in sets], np.uint64).view(np.int64)
                ok = np.array([len(s) > 0 for s in sets])
                if shared is not None:
                    at = np.minimum(np.searchsorted(shared.value, key), max(0, len(shared.value) - 1))
                    ok &= (shared.value[at] == key) if len(shared.value) else False
                own = [i for i in dict(zip(key[ok][::-1].tolist(), np.flatnonzero(ok)[::-1].tolist(), strict=True)).values()]
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array([sets[i].tobytes() for i in own], pa.binary())], ["key", "own"])

    sets = rows.select("text").mapInArrow(sets_of, "key long, own binary")
    if shared is None:
        sets = sets.join(wanted, "key", "left_semi")
    sets = sets.groupBy("key").agg(F.first("own").alias("own"))
    placed = scratch.save(placed, "placed")
    placed = F.broadcast(placed) if 64 * placed.count() <= BROADCAST_BYTES else placed
    dealt = sets.join(placed, "key").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "right", "key")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(run):
            sets = [np.frombuffer(r[1], np.uint64) for r in run]
            split = next((k for k, r in enumerate(run) if r[2]), 0)
            found = links(sets, split, plan) if len(sets) > 1 else []
            a, b = [run[i][0] for i, _ in found], [run[j][0] for _, j in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        at, run = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("root", "i", "j", "key", "own", "right")]
            for root, i, j, key, own, right in zip(*columns, strict=True):
                if (root, i, j) != at:
                    if len(run) > 1:
                        yield done(run)
                    at, run = (root, i, j), []
                run.append((key, own, right))
        if len(run) > 1:
            yield done(run)

    return dealt.select("root", "i", "j", "key", "own", "right").mapInArrow(join, "a long, b long")
