"""Line dedup: two Bloom filters find suspected repeats, only those are shuffled for exact confirmation.

Each task adds the key hashes of its documents' lines (once per document) to a "seen" filter, and to a "seen again"
filter when the first already had them. Filters merge by (s1|s2, r1|r2|(s1&s2)), block by block, so no task and no
driver needs more than the filters' fixed size. Then every document's keys are looked up; those possibly seen in two
documents are counted by their text, exactly. Keys found often enough lose their lines: all of them
(`keep="none"`), or all but the first occurrence (`keep="first"`, first by id, then by place in the text).

Filter size follows the number of lines up to a bound; beyond it the keys are dealt by hash to several passes over the
texts, each with filters for its own share, so that the bits per key and what is suspected stay in proportion. Frequent
keys are broadcast in blocks of bounded size, one narrow pass over the texts for each, written before the next one.

Defined results: a null or empty text is one empty line; every row counts as a document of its own, so repeated rows
count each; keys shorter than `min_chars` code points are never dropped; texts of any length are split whole. Null ids
are allowed. With keep="first" exactly one line of a key stays: ids come in order, null ones last, rows of one id in
the order in which they were first read. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, Scratch, blocks_for, in_passes

BLOCK_BITS = 1 << 19
PROBES = 4
BITS_PER_KEY = 12
#: Bits of a pass's filters, each; more lines take more passes.
MAX_BITS = 1 << 28
#: Bytes of a frequent key and its first row in a Python dict.
ENTRY_BYTES = 200
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()


def _texts(column: pa.Array) -> list[bytes]:
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    """The keys of a text's lines, each once; short ones only where they could be dropped."""
    found = {x.strip() for x in text.lower().split(b"\n")}
    if min_chars == 1:
        found.discard(b"")
    elif min_chars > 1:
        found = {x for x in found if len(x.decode("utf-8", "replace")) >= min_chars}
    return found


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, all within one block per key; a row per probe."""
    n_blocks = np.uint64(max(1, bits // BLOCK_BITS))
    start = (hashes % n_blocks) * np.uint64(BLOCK_BITS)
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    low = hashes >> np.uint64(17)
    return np.stack([start + ((low + np.uint64(i) * step) & np.uint64(BLOCK_BITS - 1)) for i in range(PROBES)]).astype(np.int64)


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


class TwoBlooms:
    """Which hashes were seen, and which possibly twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def _has(self, filt: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((filt[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

    def _set(self, filt: np.ndarray, at: np.ndarray) -> None:
        flat = at.ravel()
        np.bitwise_or.at(filt, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))

    def add(self, hashes: np.ndarray) -> None:
        """Hashes of several documents, each document's own once."""
        values, n = np.unique(hashes, return_counts=True)
        at = _probes(values, self.bits)
        self._set(self.twice, at[:, self._has(self.once, at) | (n > 1)])
        self._set(self.once, at)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(self.twice, _probes(hashes, self.bits))

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = BLOCK_BITS // 8
        for k in range(len(self.once) // size):
            part = slice(k * size, (k + 1) * size)
            if self.once[part].any():
                yield k, zlib.compress(self.once[part].tobytes(), 1), zlib.compress(self.twice[part].tobytes(), 1)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come in any order; a task holds the blocks dealt to it, two bit arrays each."""
    have: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
            if k in have:
                o0, t0 = have[k]
                have[k] = [o0 | o, t0 | t | (o0 & o)]
            else:
                have[k] = [o.copy(), t.copy()]
    for k, (_, t) in have.items():
        if t.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(t.tobytes(), 1)], pa.binary())], ["block", "twice"])


def filter_bits(n_lines: int) -> int:
    want = max(BLOCK_BITS, n_lines * BITS_PER_KEY)
    return -(-want // BLOCK_BITS) * BLOCK_BITS


def _share(hashes: np.ndarray, share: int, n_shares: int) -> np.ndarray:
    """Which of the hashes a pass looks at."""
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n_shares) == share if n_shares > 1 else np.ones(len(hashes), bool)


def repeated_filter(rows: DataFrame, bits: int, min_chars: int, share: int, n_shares: int) -> np.ndarray:
    """The merged "seen again" filter of column `text`; its size is fixed by `bits`."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = TwoBlooms(bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found: list[bytes] = []
                for text in _texts(batch.column(0).slice(at, 256)):
                    found.extend(_keys(text, min_chars))
                hashes = _hashes(found)
                blooms.add(hashes[_share(hashes, share, n_shares)])
        for k, once, twice in blooms.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], ["block", "once", "twice"])

    parts = rows.mapInArrow(build, "block int, once binary, twice binary")
    merged = parts.repartition(max(1, min(64, bits // BLOCK_BITS)), "block").mapInArrow(_merge, "block int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():
        size = BLOCK_BITS // 8
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def frequent_keys(rows: DataFrame, min_docs: int, min_chars: int, max_bits: int = MAX_BITS) -> Iterator[DataFrame]:
    """key (binary), n_docs and first_row of every key found in at least `min_docs` rows of (text, id, row), exactly, in tables to be used one after another."""
    spark = rows.sparkSession
    n_lines = rows.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1)).first()[0] or 0
    n_shares = blocks_for(filter_bits(n_lines), max_bits)
    bits = filter_bits(-(-n_lines // n_shares))
    kind = rows.schema["id"].dataType.simpleString()
    for share in range(n_shares):
        shared = spark.sparkContext.broadcast(repeated_filter(rows.select("text"), bits, min_chars, share, n_shares))

        def suspects(batches: Iterator[pa.RecordBatch], shared=shared, share=share) -> Iterator[pa.RecordBatch]:
            look = TwoBlooms.__new__(TwoBlooms)
            look.bits, look.twice = bits, shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    found: list[bytes] = []
                    owner: list[int] = []
                    for k, text in enumerate(_texts(part.column(0))):
                        own = _keys(text, min_chars)
                        found.extend(own)
                        owner.extend([k] * len(own))
                    if not found:
                        continue
                    hashes = _hashes(found)
                    hit = np.flatnonzero(look.repeated(hashes) & _share(hashes, share, n_shares))
                    mine = pa.array(np.array(owner)[hit])
                    yield pa.RecordBatch.from_arrays([pa.array([found[i] for i in hit], pa.binary()), part.column(1).take(mine), part.column(2).take(mine)], ["key", "id", "row"])

        first = F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"]
        counted = rows.select("text", "id", "row").mapInArrow(suspects, f"key binary, id {kind}, row long").groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), first.alias("first_row"))
        yield counted.where(F.col("n_docs") >= min_docs)
        if n_shares > 1:
            shared.destroy()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def dedup_lines(docs: DataFrame, keep_cols: dict[str, Column], min_docs: int = 2, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, max_bits: int = MAX_BITS, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`keep_cols`, then text without the dropped lines, n_lines before, n_dropped."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    scratch = scratch or Scratch(docs.sparkSession)
    digest = lambda batches: (
        pa.RecordBatch.from_arrays([pa.array([_digest(k) for k in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["digest", "first_row"]) for b in batches
    )
    rows = docs.select(*[c.alias(f"__k_{k}") for k, c in keep_cols.items()], F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if keep == "first":  # written, so that a row keeps its number
        rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    found = [scratch.save(part.select("key", "first_row").mapInArrow(digest, "digest binary, first_row long"), f"frequent{k}") for k, part in enumerate(frequent_keys(rows, min_docs, min_chars, max_bits))]
    found = reduce(DataFrame.unionByName, found)
    n_blocks = blocks_for(ENTRY_BYTES * found.count(), block_bytes)

    def block(k: int) -> dict[bytes, int]:
        part = found.where(F.pmod(F.xxhash64("digest"), F.lit(n_blocks)) == k).toArrow()
        return dict(zip(map(bytes, part.column("digest").to_pylist()), part.column("first_row").to_pylist(), strict=True))

    state = rows.drop("id").withColumns({"n_lines": F.lit(-1).cast("long"), "n_dropped": F.lit(0).cast("long")})
    state = in_passes(state, n_blocks, block, lambda state, frequent, _: _drop(state, frequent, keep), scratch, "dropped")
    return state.select(*[F.col(f"__k_{k}").alias(k) for k in keep_cols], "text", "n_lines", "n_dropped")


def _drop(state: DataFrame, frequent, keep: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop = frequent.value
        for batch in batches:
            texts, rows = _texts(batch.column("text")), batch.column("row").to_pylist()
            n_lines, n_dropped, out = batch.column("n_lines").to_pylist(), batch.column("n_dropped").to_pylist(), []
            for i, text in enumerate(texts):
                lines = text.split(b"\n")
                if n_lines[i] < 0:
                    n_lines[i] = len(lines)
                kept, done = [], set()
                for line in lines:
                    key = line.strip().lower()
                    d = _digest(key)
                    if d in drop:
                        if keep == "first" and drop[d] == rows[i] and d not in done:
                            done.add(d)
                        else:
                            continue
                    kept.append(line)
                n_dropped[i] += len(lines) - len(kept)
                out.append(text if len(kept) == len(lines) else b"\n".join(kept))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"text": pa.array(out, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return state.mapInArrow(run, schema)
