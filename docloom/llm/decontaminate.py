"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the benchmark items' windows of consecutive words. For each pattern length a shift table over blocks of
two words says how far a cursor may jump before a window could end there; where the shift is 0, the block's hash
picks the bucket of patterns with that suffix, their first block is compared, and what is left is compared word for
word. All documents of a batch are searched side by side, a long one as several lanes.

Patterns are broadcast in blocks of bounded size: with a larger benchmark the documents pass through one narrow
search per block, which adds to what the earlier ones found and is written before the next one, so nothing is shuffled,
one block is alive at a time and no pattern is dropped.

Defined results: a null or empty text has no words, is never hit and (as an item) makes no pattern; an item of fewer
words than a window is one pattern. Repeated item rows count once by id; an item with a null id still marks words
but is not listed. Repeated documents are searched each, texts of any length whole. Either table may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, Scratch, Words, blocks_for, chunks, in_passes, lut, mix

#: Words: runs of digits, letters and all bytes beyond ASCII.
ALNUM = lut(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
WINDOW = 10
LANE = 128
TABLE_BITS = 18


def _pair(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block of `width` words that ends at each position."""
    return h[at] if width == 1 else mix(h[at - 1] * np.uint64(0x9E3779B97F4A7C15) + h[at], 3)


@dataclass
class PatternSet:
    """Patterns of one length: shift table, and buckets by suffix block."""

    length: int
    width: int
    shift: np.ndarray
    suffix: np.ndarray
    begin: np.ndarray
    prefix: np.ndarray
    texts: list[bytes]
    items: list[tuple[str, ...]]

    @classmethod
    def build(cls, length: int, patterns: dict[bytes, tuple[np.ndarray, set]]) -> PatternSet:
        width = min(2, length)
        texts = list(patterns)
        h = np.array([patterns[t][0] for t in texts], np.uint64)
        shift = np.full(1 << TABLE_BITS, length - width + 1, np.int32)
        mask = np.uint64((1 << TABLE_BITS) - 1)
        for end in range(width - 1, length):
            flat = _pair(h.reshape(-1), np.arange(len(texts)) * length + end, width)
            np.minimum.at(shift, (flat & mask).astype(np.int64), length - 1 - end)
        last = _pair(h.reshape(-1), np.arange(len(texts)) * length + length - 1, width)
        order = np.argsort(last, kind="stable")
        suffix, begin = np.unique(last[order], return_index=True)
        first = _pair(h.reshape(-1), np.arange(len(texts)) * length + width - 1, width)
        return cls(length, width, shift, suffix, np.append(begin, len(order)), first[order], [texts[i] for i in order], [tuple(sorted(patterns[texts[i]][1])) for i in order])

    def search(self, words: Words, h: np.ndarray) -> list[tuple[int, int]]:
        """(first word, pattern) of every occurrence; words of different documents never make one window."""
        low, high = words.first[:-1] + self.length - 1, words.first[1:] - 1
        full = np.flatnonzero(low <= high)
        lanes = (high[full] - low[full]) // LANE + 1
        start = np.repeat(low[full], lanes) + LANE * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        stop = np.minimum(start + LANE - 1, np.repeat(high[full], lanes))
        mask, found, cursor = np.uint64((1 << TABLE_BITS) - 1), [], start
        while len(cursor):
            jump = self.shift[(_pair(h, cursor, self.width) & mask).astype(np.int64)]
            found.append(cursor[jump == 0])
            cursor = cursor + np.maximum(jump, 1)
            on = cursor <= stop
            cursor, stop = cursor[on], stop[on]
        at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        if not len(at) or not len(self.suffix):
            return []
        last = _pair(h, at, self.width)
        bucket = np.minimum(np.searchsorted(self.suffix, last), len(self.suffix) - 1)
        same = self.suffix[bucket] == last
        at, bucket = at[same], bucket[same]
        size = self.begin[bucket + 1] - self.begin[bucket]
        pattern = np.repeat(self.begin[bucket], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        begin = np.repeat(at, size) - self.length + 1
        same = self.prefix[pattern] == _pair(h, begin + self.width - 1, self.width)
        return [(b, p) for b, p in zip(begin[same].tolist(), pattern[same].tolist(), strict=True) if words.text(b, b + self.length) == self.texts[p]]


def patterns(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> list[PatternSet]:
    """Pattern sets, one per length, of (item id, text) rows."""
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set]]] = {}
    for chunk in chunks(pa.array([t for _, t in rows], pa.string())):
        words = Words(chunk, ALNUM)
        h = words.hashes()
        for k in range(len(chunk)):
            first, stop = int(words.first[k]), int(words.first[k + 1])
            n = min(window, stop - first)
            for i in range(first, stop - n + 1) if n else ():
                entry = by_length.setdefault(n, {}).setdefault(words.text(i, i + n), (h[i : i + n], set()))
                if rows[chunk.first + k][0] is not None:
                    entry[1].add(rows[chunk.first + k][0])
    return [PatternSet.build(n, found) for n, found in sorted(by_length.items())]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, keep: dict[str, Column], window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BROADCAST_BYTES // 16, scratch: Scratch | None = None) -> DataFrame:
    """`keep`, then n_words, spans (hit words as [first, stop) ranges) and item_ids (sorted) of every document."""
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    n_blocks = blocks_for(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0, block_bytes)
    state = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("__text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:int,stop:int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("item_ids"))

    def block(b: int) -> list[PatternSet]:
        """Items are dealt to blocks whole; a block comes to the driver, its size is the bound."""
        return patterns([(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == b).collect()], window)

    state = in_passes(state, n_blocks, block, lambda state, sets, _: _search(state, sets), scratch or Scratch(docs.sparkSession), "searched")
    return state.drop("__text")


def _search(state: DataFrame, sets) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words: list[np.ndarray] = [np.zeros(0, np.int64)]
            spans, names = batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist()
            for chunk in chunks(batch.column("__text")):
                words = Words(chunk, ALNUM)
                n_words.append(words.count)
                h = words.hashes()
                for own in sets.value:
                    found = own.search(words, h)
                    if not found:
                        continue
                    text = np.searchsorted(words.first, [b for b, _ in found], "right") - 1
                    for (b, p), k in zip(found, text.tolist(), strict=True):
                        i = chunk.first + k
                        b -= int(words.first[k])
                        spans[i].append({"first": b, "stop": b + own.length})
                        names[i].extend(own.items[p])
            for i, own in enumerate(spans):
                if own:
                    spans[i], names[i] = _merged(own), sorted(set(names[i]))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {
                "n_words": pa.array(np.concatenate(n_words).astype(np.int64)),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))),
                "item_ids": pa.array(names, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return state.mapInArrow(run, schema)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["stop"])):
        if out and s["first"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
        else:
            out.append(dict(s))
    return out


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["stop"] - s["first"]))
