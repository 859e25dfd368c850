"""Shared pieces of the corpus operators: scratch tables, bounded broadcasts, and numpy kernels over Arrow text.

Every operator reads only the columns it names (an id, a text, sometimes a language or source), so further
columns, whatever they are called, cannot clash with what it adds.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space between words: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Texts are worked on in runs of whole documents of about this many bytes.
CHUNK_BYTES = 1 << 20
#: Largest table, in bytes of its compact form, that is broadcast; larger ones take another way.
BROADCAST_BYTES = 64 << 20


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/docloom-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def collect(self) -> None:
        """Let the driver find what it no longer refers to: only then does Spark delete the shuffle files behind written tables."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing will read again, or all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except (AttributeError, ConnectionError, Py4JError):  # the session may have ended: the folder then goes with the shared one
            return


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- hashing kernels

MULTIPLIER = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The multiplier's powers (or its inverse's) from 0 to n - 1, modulo 2**64."""
    kind = "inverse" if inverse else "plain"
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 4096), _INVERSE if inverse else MULTIPLIER, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 4 * CHUNK_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which the hash of any slice follows in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = np.add(data, np.uint64(1), dtype=np.uint64)
    terms *= powers(len(data))
    np.cumsum(terms, out=out[1:])
    return out


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums), True)[start])


# ---------------------------------------------------------------- Arrow text


def as_i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


class Chunk:
    """Whole documents side by side: their bytes, and where each starts and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in runs of about `size` bytes; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, offs, raw = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(max(i + 1, np.searchsorted(offs, offs[i] + size, "right") - 1))
        yield Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def lut(keep: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the byte it counts as (A-Z lower-cased), and whether it is part of a word."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kept = np.zeros(256, bool)
    kept[list(keep)] = True
    return lower, kept[lower]


SPACED = lut(bytes(b for b in range(256) if b != 0x20 and not 9 <= b <= 13))


class Words:
    """Words of a chunk: starts and ends in its bytes, and for each document its first word's number."""

    def __init__(self, chunk: Chunk, table: tuple[np.ndarray, np.ndarray] = SPACED):
        data = chunk.data.tobytes()
        self.norm = np.frombuffer(data.translate(table[0].tobytes()), np.uint8)
        inside = np.concatenate(([False], np.frombuffer(data.translate(table[1].tobytes()), bool), [False]))
        edges = chunk.offsets[:-1]
        edges = edges[edges < len(chunk.data)]
        cut = np.zeros(len(chunk.data) + 2, bool)
        cut[edges + 1] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[1:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[2:])) + 1
        self.first = np.searchsorted(self.start, chunk.offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return slice_hash(prefix_hash(self.norm), self.start, self.end)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, one space between them."""
        return b" ".join(self.norm[self.start[k] : self.end[k]].tobytes() for k in range(i, j))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over values[first[k]:first[k + 1]], each summed on its own, so that neighbours do not matter."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans merged where they overlap or touch."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(start[1:] > reach[:-1]) + 1
    return start[np.concatenate(([0], new))], reach[np.concatenate((new - 1, [len(reach) - 1]))]


# ---------------------------------------------------------------- memory of Python workers


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which freed memory goes back to the system: a worker lives on for later tasks, and what it keeps counts as the executor's."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
        if trim is not None:
            trim(0)

    return released


# ---------------------------------------------------------------- bounded broadcasts


def blocks_for(n_bytes: int, most: int = BROADCAST_BYTES) -> int:
    return max(1, -(-n_bytes // most))


def in_passes(state: DataFrame, n_blocks: int, make: Callable[[int], object], step: Callable, scratch: Scratch, name: str) -> DataFrame:
    """step(state, broadcast of make(block), block) for one block after another.

    Where there are several, each pass is written before the next one begins and its broadcast is destroyed, so that one
    block is alive at a time, and one Python worker a task, however many blocks there are.
    """
    for block in range(n_blocks):
        shared = state.sparkSession.sparkContext.broadcast(make(block))
        state = step(state, shared, block)
        if n_blocks > 1:
            state = scratch.save(state, f"{name}{block}")
            shared.destroy()
            if block:
                scratch.drop(f"{name}{block - 1}")
    return state


class Lookup:
    """A sorted table of hashes, searched from where a key's leading bits begin."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = max(1, (2 * len(table)).bit_length())
        self.shift = np.uint64(64 - bits)
        starts = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.begin = np.append(starts, len(table)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.table)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key in the table, or -1."""
        if not len(self.table):
            return np.full(len(keys), -1, np.int64)
        bucket = (keys >> self.shift).view(np.int64)
        place = self.begin[bucket]
        # an empty bucket's place is another's, whose keys have other leading bits
        hit = self.table.take(place, mode="clip") == keys
        at = np.where(hit, place, -1).astype(np.int64)
        todo = np.flatnonzero(~hit)
        here, stop = place[todo] + 1, self.begin[bucket[todo] + 1]
        while len(todo):
            more = here < stop
            todo, here, stop = todo[more], here[more], stop[more]
            hit = self.table[here] == keys[todo]
            at[todo[hit]] = here[hit]
            todo, here, stop = todo[~hit], here[~hit] + 1, stop[~hit]
        return at
