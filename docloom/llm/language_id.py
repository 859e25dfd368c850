"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram (1 to 3 characters) of every training text: each task sums its own texts into one
dense count matrix per language and emits its non-zero cells, Spark adds the cells. The matrix of log-probabilities
has a fixed number of rows (buckets) and a column per language. It is broadcast; where there are more languages than fit
a block, the texts pass through one scoring per block of languages, which keeps the best one and the sum so far, written
before the next one. Scoring hashes each text's n-grams and sums the rows they pick.

Defined results: a text that is null or holds no letter is `und` with score 0; so is any text if nothing could be
learned. Ties go to the first language by code point. Texts of any length are scored whole. Repeated rows count and are
scored each; null ids, null languages and sources are allowed (a null language is not learned from). An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_BYTES, Scratch, blocks_for, chunks, in_passes, mix, remainder, segment_sum

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNDETERMINED = "und"
#: Languages whose counts a task holds before it passes them on.
MOST_HELD = 256
#: Languages whose rows are gathered at once.
GATHERED = 8

_tables: list[np.ndarray] = []


def _tables_of_characters() -> list[np.ndarray]:
    """By code point: its lower case where that is one character, and whether it is a letter."""
    if not _tables:
        low = np.arange(0x110000, dtype=np.uint32)
        letter = np.zeros(0x110000, bool)
        for i in range(0x110000):
            if 0xD800 <= i < 0xE000:
                continue
            c = chr(i)
            if c.isalpha():
                letter[i] = True
                small = c.lower()
                if len(small) == 1:
                    low[i] = ord(small)
        _tables.extend((low, letter))
    return _tables


def ngrams(chunk, orders=ORDERS, buckets: int = BUCKETS, tables: list[np.ndarray] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all n-grams and where each text's begin; and whether each text has a letter."""
    low, letter = tables or _tables_of_characters()
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begin = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))[chunk.offsets]
    lettered = np.concatenate(([0], np.cumsum(letter[points])))[begin]
    points = low[points].astype(np.uint64)
    out, sums = [], None
    for n in range(1, max(orders) + 1):
        code = points if sums is None else (sums[: len(points) - n + 1] << np.uint64(21)) ^ points[n - 1 :]
        sums = code
        if n not in orders:
            continue
        length = np.maximum(np.diff(begin) - (n - 1), 0)
        at = np.concatenate(([0], np.cumsum(length)))
        # the n-grams that start within the last n - 1 characters of a text reach into the next one
        inside = np.ones(len(code), bool)
        for k in range(1, n):
            last = begin[1:] - k
            last = last[(last >= begin[:-1]) & (last < len(code))]
            inside[last] = False
        got = (mix(code[inside], n) & np.uint64(buckets - 1)).astype(np.int32)
        out.append((got, at))
    return out, np.diff(lettered) > 0


@dataclass
class Model:
    """Languages in order, and the table of their counts (lang, b: buckets, n: counts; the last bucket counts texts)."""

    langs: list[str]
    counts: DataFrame
    buckets: int
    n_texts: int

    def matrix(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Log-probabilities of the languages from `first` to `stop`, a column each; the prior is the last row."""
        langs = self.langs[first:stop]
        counts = np.zeros((self.buckets + 1, len(langs)), np.int64)
        if not langs:
            return counts.astype(np.float32)
        at = {lang: k for k, lang in enumerate(langs)}
        for r in self.counts.where((F.col("lang") >= langs[0]) & (F.col("lang") <= langs[-1])).collect():
            counts[r["b"], at[r["lang"]]] = r["n"]
        grams = counts[:-1] + SMOOTHING
        return np.vstack([np.log(grams / grams.sum(axis=0)), np.log(counts[-1] / self.n_texts)]).astype(np.float32)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = BUCKETS, scratch: Scratch | None = None) -> Model:
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    tables = spark.sparkContext.broadcast(_tables_of_characters())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1)):
                grams, _ = ngrams(chunk, buckets=buckets, tables=tables.value)
                own = langs[chunk.first : chunk.first + len(chunk)]
                for lang in dict.fromkeys(own):
                    mine = np.array([x == lang for x in own])
                    cell = cells.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    cell[buckets] += int(mine.sum())
                    for got, at in grams:
                        cell[:buckets] += np.bincount(got[np.repeat(mine, np.diff(at))], minlength=buckets)
                if len(cells) > MOST_HELD:
                    yield from emitted(cells)
                    cells.clear()
        yield from emitted(cells)

    def emitted(cells: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, cell in cells.items():
            full = np.flatnonzero(cell)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(cell[full])], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row a language, as long as a column of the matrix
    packed = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    counts = (scratch or Scratch(spark)).save(packed, "languages")
    texts = F.element_at(F.map_from_arrays("b", "n"), F.lit(buckets))
    got = sorted((r["lang"], r["texts"]) for r in counts.select("lang", texts.alias("texts")).collect())
    return Model([lang for lang, _ in got], counts, buckets, sum(n for _, n in got))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: dict[str, Column] | None = None, block_bytes: int = BROADCAST_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """The columns of `keep` (name -> Column), lang_pred and score for every row."""
    keep = keep or {}
    rows = docs.select(*[c.alias(f"__k_{k}") for k, c in keep.items()], F.col(text_col).cast("string").alias("text"))
    start = {"name": F.lit(UNDETERMINED), "best": F.lit(0.0), "sum": F.lit(0.0)}
    rows = rows.select("*", *[c.alias(k) for k, c in start.items()])
    n_blocks = blocks_for(4 * (model.buckets + 1) * len(model.langs), block_bytes)
    size = -(-len(model.langs) // n_blocks)
    tables = _tables_of_characters()

    def block(k: int):
        return model.langs[k * size : (k + 1) * size], model.matrix(k * size, (k + 1) * size), tables

    rows = in_passes(rows, n_blocks, block, lambda state, shared, _: _predict(state, shared), scratch or Scratch(docs.sparkSession), "predicted")
    return rows.select(*[F.col(f"__k_{k}").alias(k) for k in keep], F.col("name").alias("lang_pred"), F.when(F.col("sum") > 0, 1 / F.col("sum")).otherwise(F.lit(0.0)).alias("score"))


def _predict(state: DataFrame, shared) -> DataFrame:
    """`best` is the greatest log-probability so far, `sum` that of all relative to it; 0 where there is none."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp, tables = shared.value
        groups = [np.ascontiguousarray(logp[:-1, k : k + GATHERED]) for k in range(0, len(langs), GATHERED)]
        for batch in batches:
            for chunk in chunks(batch.column(batch.schema.get_field_index("text"))):
                part = batch.slice(chunk.first, len(chunk))
                if langs:
                    grams, lettered = ngrams(chunk, buckets=len(logp) - 1, tables=tables)
                    total = np.repeat(logp[-1:].astype(np.float64), len(chunk), axis=0)
                    for got, at in grams:
                        for k, rows in enumerate(groups):
                            total[:, k * GATHERED : (k + 1) * GATHERED] += segment_sum(rows[got].astype(np.float64), at)
                    best, own = total.max(axis=1), total.argmax(axis=1)
                    share = np.exp(total - best[:, None]).sum(axis=1)
                    had, was, names = (part.column(x).to_numpy(zero_copy_only=False) for x in ("best", "sum", "name"))
                    better = (was == 0) | (best > had)  # equally good: the earlier one
                    top = np.where(better, best, had)
                    weight = np.where(was > 0, was * np.exp(np.minimum(had - top, 0)), 0.0) + share * np.exp(best - top)
                    named = [langs[i] if new else old for i, new, old in zip(own.tolist(), better.tolist(), names.tolist(), strict=True)]
                    columns = dict(zip(part.schema.names, part.columns, strict=True))
                    columns |= {"name": pa.array([x if ok else UNDETERMINED for x, ok in zip(named, lettered.tolist(), strict=True)], pa.string()), "best": pa.array(np.where(lettered, top, 0.0)), "sum": pa.array(np.where(lettered, weight, 0.0))}
                    part = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                yield part

    return state.mapInArrow(score, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Learn from the rows outside fold `held`, predict all."""
    scratch = scratch or Scratch(docs.sparkSession)
    fold = remainder(id_col, folds)
    model = train(docs.where(fold != held), lang_col, text_col, scratch=scratch)
    return predict(docs, model, text_col, {id_col: F.col(id_col), "held_out": fold == held}, scratch=scratch)
