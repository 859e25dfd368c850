"""Suffix-array dedup: remove every byte that a string of `length` bytes occurring elsewhere covers.

Sorting all suffixes of a corpus moves many times its size, so the distributed part first finds what can repeat at
all. Of each window of `length` bytes the k-gram with the least hash is its anchor; equal windows have equal anchors
at equal distances, so windows are dealt by anchor, as runs of windows that share one. An anchor that occurs once
holds no repeat. Runs whose whole bytes occur twice are repeats throughout. Only runs that share an anchor but differ
are compared as strings: one representative of each is fetched, and the suffixes of an anchor's runs are sorted by
the difference-cover algorithm (sort sampled triples, name them, recurse on the names, merge the remaining
suffixes), after which equal windows are neighbours and comparing adjacent prefixes finds them. The recursion stops
where names stand for at least `length` bytes, as further order is not needed. Runs of an anchor too frequent for
one task are cut into windows and dealt by their hash instead, with the same result.

Documents are known by the hash of their text: a text that occurs twice or more is a repeat throughout, and its
copies send their runs once per task.

Defined results: a null text is empty. Matches never cross documents, repeats within one count, and repeated rows are
copies of each other. Null ids are allowed. Texts of any length are worked on whole, in pieces that overlap. An empty
table gives an empty table. Windows are told apart by 64-bit hashes, documents too; the polynomial ones are of at most a
few hundred bytes, for which no texts are known that collide whatever the multiplier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import BROADCAST_BYTES, Scratch, as_i64, chunks, mix, prefix_hash, segment_sum, slice_hash, union_spans

LENGTH = 200
#: Bytes of the k-grams that anchors are chosen from, as a share of the length.
GRAM_SHARE = 0.32
#: Texts longer than this are worked on in overlapping pieces.
PIECE = 1 << 22
#: Suffixes sorted at once; symbols of three such names fit in 63 bits.
BUNDLE = 1 << 19
#: Bytes of an anchor's runs beyond which they are cut into windows; with a bundle, still fewer than 2**21.
GROUP_BYTES = 1 << 20
#: Runs among which a task settles equal ones before it passes them on.
SETTLED_RUNS = 1 << 19

_PLACE = np.uint64((1 << 24) - 1)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, from running minima of blocks of w in both directions."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64((1 << 64) - 1))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs_of(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, hash of the run's bytes, first window, number of windows."""
    sums = prefix_hash(data)
    at = np.arange(len(data) - k + 1)
    gram = slice_hash(sums, at, at + k)
    least = sliding_least((gram & ~_PLACE) | (_PLACE - at.astype(np.uint64)), length - k + 1)
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, len(anchor)))
    content = slice_hash(sums, first, first + count + length - 1)
    return gram[anchor[first]], mix(content + (anchor[first] - first).astype(np.uint64), 50), first, count


def document_runs(text: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    parts = []
    for at in range(0, max(1, len(text) - length + 1), PIECE):
        piece = text[at : at + PIECE + length - 1]
        if len(piece) >= length:
            h, c, first, count = runs_of(piece, length, k)
            parts.append((h, c, first + at, count))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ---------------------------------------------------------------- difference-cover suffix sorting


def suffix_order(s: np.ndarray, reach: int, length: int) -> np.ndarray:
    """Suffixes of s in order of at least their first `length` bytes; each symbol stands for `reach` of them.

    Symbols are positive and, like the length of s, below 2**21.
    """
    n = len(s)
    if n < 3 or reach >= length:
        return np.argsort(s, kind="stable") if n >= 3 else _tiny_order(s)
    shift = np.uint64(21)
    p = np.concatenate((s, np.zeros(3, s.dtype))).astype(np.uint64)
    ones, twos = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    triple = (p[sample] << shift | p[sample + 1]) << shift | p[sample + 2]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        # the names of both residues side by side, apart by a 0 that no name equals
        joined = np.concatenate((name[: len(ones)], [0], name[len(ones) :])) + 1
        order = suffix_order(joined, 3 * reach, length)
        order = order[order != len(ones)]
        order = order - (order > len(ones))
    rank = np.zeros(n + 3, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    sampled = sample[order]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(p[rest] << shift | rank[rest + 1], kind="stable")]
    # a remaining suffix goes after the sampled ones that are less: those of each residue by its own comparison
    by_one, by_two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    key_one = lambda i: p[i] << shift | rank[i + 1]
    key_two = lambda i: (p[i] << shift | p[i + 1]) << shift | rank[i + 2]
    less = np.searchsorted(np.sort(key_one(by_one)), key_one(rest)) + np.searchsorted(np.sort(key_two(by_two)), key_two(rest))
    place = np.arange(len(rest)) + np.maximum.accumulate(less)
    out = np.empty(n, np.int64)
    is_rest = np.zeros(n, bool)
    is_rest[place] = True
    out[place] = rest
    out[~is_rest] = sampled
    return out


def _tiny_order(s: np.ndarray) -> np.ndarray:
    return np.array(sorted(range(len(s)), key=lambda i: s[i:].tolist()), np.int64)


def repeated_windows(contexts: list[bytes], length: int) -> np.ndarray:
    """For each window of each context (all its starts, one context after another) whether another start has the same bytes."""
    size = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    symbols = data.astype(np.int64) + 2
    symbols[begin[1:] - 1] = 1
    starts = np.zeros(len(data), bool)
    for b, n in zip(begin[:-1].tolist(), size.tolist(), strict=True):
        starts[b : b + n - length + 1] = True
    order = suffix_order(symbols, 1, length)
    order = order[starts[order]]
    window = slice_hash(prefix_hash(data), order, order + length)
    same = window[1:] == window[:-1]
    repeated = np.zeros(len(data), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    return repeated[starts]


# ---------------------------------------------------------------- the distributed operator


def _neighbours(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds `before` and `after`: the order's first column in the neighbouring rows of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({"before": F.lag(order[0]).over(w), "after": F.lead(order[0]).over(w)})


def _flat(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs, a null one empty: where each list starts, and the structs' fields, one list after another."""
    at = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))))
    return at, [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]


def _listed(at: np.ndarray, **fields: np.ndarray) -> pa.ListArray:
    """The other way round."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields)))


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Texts of these sizes, which stand in data one after another."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _spans(flags: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """For flags[at[k]:at[k + 1]] the runs of true ones as first and last."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(flags & (edge[:-1] | ~np.concatenate(([False], flags[:-1]))))
    last = np.flatnonzero(flags & (edge[1:] | ~np.concatenate((flags[1:], [False]))))
    base = at[np.searchsorted(at, first, "right") - 1]
    return _listed(np.searchsorted(first, at), first=(first - base).astype(np.int32), last=(last - base).astype(np.int32))


def remove_repeats(docs: DataFrame, keep: dict[str, Column], length: int = LENGTH, text_col: str = "text", scratch: Scratch | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """`keep`, then n_bytes, spans (removed, as [first, stop) byte ranges) and kept (the remaining bytes)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    k = max(4, int(length * GRAM_SHARE))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("doc"), text.cast("binary").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            h, c, first, count, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            # of equal runs that a task meets, one goes on as a run that repeats, and the others are settled
            key = mix(h + mix(c, 52), 52)
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            size = np.diff(np.append(np.flatnonzero(new), len(order)))
            done, whole = np.empty(len(order), bool), np.empty(len(order), bool)
            done[order], whole[order] = ~new, np.repeat(size > 1, size)
            h = np.where(done, mix(doc.view(np.uint64) + mix(first.astype(np.uint64), 53), 53), h)  # dealt evenly
            return pa.RecordBatch.from_arrays([as_i64(h), as_i64(c), pa.array(doc), pa.array(first), pa.array(count.astype(np.int32)), pa.array(whole), pa.array(done)], ["h", "c", "doc", "first", "n", "again", "done"])

        size = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                for i in range(len(chunk)):
                    name = names[chunk.first + i]
                    if name in seen:
                        continue
                    seen.add(name)
                    got = document_runs(chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]], length, k)
                    if len(got[0]):
                        found.append((*got, np.full(len(got[0]), name, np.int64)))
                        size += len(got[0])
                if size >= SETTLED_RUNS:
                    yield flush()
                    found.clear()
                    size = 0
        if found:
            yield flush()

    runs = rows.mapInArrow(emit, "h long, c long, doc long, first long, n int, again boolean, done boolean")
    around = _neighbours(runs, "h", ["c", "doc", "first"])
    equal = lambda x: F.coalesce(F.col(x) == F.col("c"), F.lit(False))
    shared = around.where("before is not null or after is not null or again").select("h", "c", "doc", "first", "n", "done", (F.col("again") | equal("before") | equal("after")).alias("whole"))
    everywhere = scratch.save(shared, "shared")
    shared = everywhere.where("not done")
    mixed = shared.groupBy("h", "c").agg(F.min(F.struct("doc", "first", "n")).alias("one"), F.max("whole").alias("whole"))
    per = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.sum(F.col("one.n") + (length - 1)).alias("bytes"), F.min("whole").alias("all_whole")).where("contexts > 1 and not all_whole")
    picked = scratch.save(mixed.join(per.select("h", (F.col("bytes") > group_bytes).alias("hot")), "h").select("h", "c", "hot", "whole", "one.doc", "one.first", "one.n"), "picked")
    wanted = picked.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "hot", "first", "n")).alias("runs"))
    names = picked.select("doc").distinct()
    few = 16 * names.count() <= BROADCAST_BYTES
    texts = rows.join(F.broadcast(names) if few else names, "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (h, c, hot, first, n) = _flat(batch.column(1))
            for chunk in chunks(batch.column(0)):
                own = at[chunk.first : chunk.first + len(chunk) + 1]
                base = np.repeat(chunk.offsets[:-1], np.diff(own))
                for i in range(own[0], own[-1], 4096):
                    part = slice(i, min(i + 4096, own[-1]))
                    size = n[part].astype(np.int64) + (length - 1)
                    start = base[part.start - own[0] : part.stop - own[0]] + first[part]
                    spot = np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
                    yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(c[part]), pa.array(hot[part]), _binary(size, chunk.data[spot])], ["h", "c", "hot", "bytes"])

    contexts = scratch.save(texts.join(wanted, "doc").select("text", "runs").mapInArrow(cut, "h long, c long, hot boolean, bytes binary"), "contexts")
    spans_type = "array<struct<first:int,last:int>>"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(bundle):
            flags = repeated_windows([b for _, _, b in bundle], length)
            at = np.concatenate(([0], np.cumsum([len(b) - length + 1 for _, _, b in bundle])))
            return pa.RecordBatch.from_arrays(
                [pa.array([h for h, _, _ in bundle], pa.int64()), pa.array([c for _, c, _ in bundle], pa.int64()), _spans(flags, at)], ["h", "c", "spans"]
            )

        bundle, size = [], 0
        for batch in batches:
            for h, c, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if size >= BUNDLE and h != bundle[-1][0]:
                    yield done(bundle)
                    bundle, size = [], 0
                bundle.append((h, c, body))
                size += len(body) + 1
        if bundle:
            yield done(bundle)

    sorted_runs = contexts.where("not hot").select("h", "c", "bytes").repartition("h").sortWithinPartitions("h", "c")
    compared = sorted_runs.mapInArrow(compare, f"h long, c long, spans {spans_type}")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                at = np.arange(len(body) - length + 1)
                data = np.frombuffer(body, np.uint8)
                key = mix(slice_hash(prefix_hash(data), at, at + length), 51)
                yield pa.RecordBatch.from_arrays([as_i64(key), pa.array(np.full(len(at), h)), pa.array(np.full(len(at), c)), pa.array(at.astype(np.int32))], ["w", "h", "c", "i"])

    single = contexts.where("hot").select("h", "c", "bytes").mapInArrow(windows, "w long, h long, c long, i int")
    again = single.groupBy("w").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("w")
    single = single.join(again, "w", "left_semi").select("h", "c", F.array(F.struct(F.col("i").alias("first"), F.col("i").alias("last"))).alias("spans"))
    spots = F.struct((F.col("first") + F.col("s.first")).alias("first"), (F.col("first") + F.col("s.last") + length).alias("stop"))
    partly = shared.where("not whole").join(compared.unionByName(single), ["h", "c"]).select("doc", "first", F.explode("spans").alias("s")).select("doc", spots.alias("span"))
    wholly = everywhere.where("whole").select("doc", F.struct("first", (F.col("first") + F.col("n") + (length - 1)).alias("stop")).alias("span"))
    copies = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("rows"), F.max(F.octet_length("text")).alias("bytes")).where(f"rows > 1 and bytes >= {length}")
    copies = copies.select("doc", F.struct(F.lit(0).cast("long").alias("first"), F.col("bytes").cast("long").alias("stop")).alias("span"))
    gone = partly.unionByName(wholly).unionByName(copies).groupBy("doc").agg(F.collect_list("span").alias("spans"))
    gone = scratch.save(gone.mapInArrow(_tidy, "doc long, spans array<struct<first:long,stop:long>>"), "gone")
    size = gone.agg(F.sum(24 + 16 * F.size("spans"))).first()[0] or 0
    body = docs.select(*[c.alias(name) for name, c in keep.items()], F.xxhash64(text).alias("__doc"), text.cast("binary").alias("__text"))
    side = gone.withColumnRenamed("doc", "__doc").withColumnRenamed("spans", "__spans")
    body = body.join(F.broadcast(side) if 2 * size <= BROADCAST_BYTES else side, "__doc", "left").drop("__doc")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in body.schema.fields[:-2])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (first, stop) = _flat(batch.column("__spans"))
            n_bytes, n_left, left = [], [], []
            for chunk in chunks(batch.column("__text")):
                own = at[chunk.first : chunk.first + len(chunk) + 1]
                part, base = slice(own[0], own[-1]), np.repeat(chunk.offsets[:-1], np.diff(own))
                edge = np.zeros(len(chunk.data) + 1, np.int8)
                edge[first[part] + base] += 1
                edge[stop[part] + base] -= 1
                left.append(chunk.data[np.cumsum(edge[:-1], dtype=np.int8) == 0])
                n_bytes.append(np.diff(chunk.offsets))
                n_left.append(n_bytes[-1] - segment_sum(stop[part] - first[part], own - own[0]))
            if left:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(np.concatenate(n_bytes)), _listed(at, first=first, stop=stop), _binary(np.concatenate(n_left), np.concatenate(left))],
                    [*batch.schema.names[:-2], "n_bytes", "spans", "kept"],
                )

    return body.mapInArrow(strip, schema + "n_bytes long, spans array<struct<first:long,stop:long>>, kept binary")


def _tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans in order, merged where they overlap or touch."""
    for batch in batches:
        at, (first, stop) = _flat(batch.column(1))
        apart = int(stop.max(initial=0)) + 2  # so that spans of different documents do not touch
        base = np.repeat(np.arange(len(at) - 1) * apart, np.diff(at))
        first, stop = first + base, stop + base
        order = np.argsort(first, kind="stable")
        first, stop = union_spans(first[order], stop[order])
        owner = first // apart
        yield pa.RecordBatch.from_arrays([batch.column(0), _listed(np.searchsorted(owner, np.arange(len(at))), first=first - owner * apart, stop=stop - owner * apart)], ["doc", "spans"])


def n_removed() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["first"]))
