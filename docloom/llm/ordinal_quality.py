"""Quality classifier: cumulative-link (ordinal) regression on graded ratings.

One weight vector over hashed text features is shared by all grades, ordered thresholds cut its score:
P(grade >= k) = sigmoid(w.x - theta_k). From that follow the expected grade and the tail probability that
selection uses. Features: words and their first five bytes (present or not), and as shares of the words their
shape (the characters that are no letters, whether in capitals) and immediate repetition. The weights have a fixed
size, so they are broadcast; texts are scored in batches, nothing is shuffled.

The model is fitted on at most `max_rated` rated ids, those with the smallest hash, one row each: the one bounded
sample here. Everything is scored.

Defined results: ratings with a null id or grade are not learned from; of several ratings of an id the most frequent
counts (the lowest of equally frequent ones), of several texts the first in order; a null text is an empty one and gets the score of an empty text; with no ratings at all the scores are null and every
document is kept. Repeated rows are scored each; extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACED, Words, chunks, mix, prefix_hash, segment_sum, slice_hash

BITS = 20
MAX_RATED = 8_000
#: Features keep the weight 0 that fewer rated texts have than this ...
MIN_TEXTS = 4
#: ... or whose share of every grade is within so many standard deviations of that grade's share of all texts.
MIN_DEVIATION = 4.0
#: Passes over the rated rows: this many, or more where there are few rows.
EPOCHS = 8
ROW_VISITS, MOST_EPOCHS = 64_000, 40
RATE = 0.12
SHARE_SCALE = 20.0

_WORDS, _PREFIXES = 1 << (BITS - 1), 1 << (BITS - 2)
_letter = np.zeros(256, bool)
_letter[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_SIGN = np.where(_letter, np.uint64(0), mix(np.arange(256, dtype=np.uint64), 7))


def features(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids and values of all texts one after another, and where each text's begin."""
    words = Words(chunk, SPACED)
    sums = prefix_hash(words.norm)
    word = slice_hash(sums, words.start, words.end)
    prefix = slice_hash(sums, words.start, np.minimum(words.end, words.start + 5))
    signs = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SIGN[chunk.data], dtype=np.uint64)))
    capitals = np.concatenate(([0], np.cumsum((chunk.data >= 65) & (chunk.data <= 90))))
    shape = signs[words.end] - signs[words.start]
    shape = mix(shape + np.where(capitals[words.end] - capitals[words.start] > 1, np.uint64(1), np.uint64(0)), 8)
    text = np.repeat(np.arange(len(chunk), dtype=np.uint64), words.count)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shift = np.uint64(BITS)
    low = lambda h, n: h & np.uint64(n - 1)
    present = np.unique(np.concatenate(((text << shift) | low(word, _WORDS), (text << shift) | (low(prefix, _PREFIXES) + np.uint64(_WORDS)))))
    parts = np.concatenate((shape, mix(np.full(int(again.sum()), 1, np.uint64), 9)))
    owner = np.concatenate((text, text[again]))
    shares, n = np.unique((owner << shift) | (low(parts, _PREFIXES) + np.uint64(_WORDS + _PREFIXES)), return_counts=True)
    n = SHARE_SCALE * n / np.maximum(words.count, 1)[(shares >> shift).astype(np.int64)]
    keys = np.concatenate((present, shares))
    order = np.argsort(keys, kind="stable")
    values = np.concatenate((np.ones(len(present), np.float32), n.astype(np.float32)))[order]
    keys = keys[order]
    begin = np.searchsorted(keys, np.arange(len(chunk) + 1, dtype=np.uint64) << shift)
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), values, begin


@dataclass(frozen=True)
class OrdinalModel:
    """Weights, ascending thresholds, and the grade that each step between thresholds stands for."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[float, ...]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each step k but the lowest, a column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades) if len(self.thresholds) else np.full(len(tails), self.grades[0])


def telling_features(ids: np.ndarray, begin: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Which features the grades differ in; the others would only add noise, most of all in long texts."""
    own = np.repeat(step.astype(np.int8), np.diff(begin))
    n = np.bincount(ids, minlength=1 << BITS)
    out = np.zeros(1 << BITS, bool)
    for k in np.unique(step):
        share = (step == k).mean()
        off = np.abs(np.bincount(ids[own == k], minlength=1 << BITS) - share * n)
        out |= off > MIN_DEVIATION * np.sqrt(share * (1 - share) * n)
    return out & (n >= MIN_TEXTS)


def fit(ids: np.ndarray, values: np.ndarray, begin: np.ndarray, grade: np.ndarray) -> OrdinalModel:
    """Stochastic gradient steps with a rate of its own for every weight; same input, same model."""
    grades = np.unique(grade)
    step = np.searchsorted(grades, grade)
    k = len(grades) - 1
    weights, theta = np.zeros(1 << BITS), np.zeros(0)
    if k < 1:
        return OrdinalModel(weights.astype(np.float32), theta, tuple(grades.tolist()))
    telling = telling_features(ids, begin, step)[ids]
    begin = np.concatenate(([0], np.cumsum(telling)))[begin]
    ids, values = ids[telling], values[telling]
    tail = np.array([(step >= i + 1).mean() for i in range(k)])
    theta = np.log((1 - tail) / tail)
    gap = np.log(np.maximum(np.diff(theta), 1e-3))
    base, squares = theta[0], np.full(1 << BITS, 1e-2)
    rng = np.random.default_rng(0)
    for _ in range(min(MOST_EPOCHS, max(EPOCHS, ROW_VISITS // len(step)))):
        order = rng.permutation(len(step))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            size = begin[rows + 1] - begin[rows]
            own = np.repeat(begin[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            doc = np.repeat(np.arange(len(rows)), size)
            i, v = ids[own], values[own]
            score = np.bincount(doc, weights[i] * v, minlength=len(rows))
            theta = base + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
            cut = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -30, 30)))
            cut = np.hstack((np.ones((len(rows), 1)), cut, np.zeros((len(rows), 1))))
            a, b = cut[np.arange(len(rows)), step[rows]], cut[np.arange(len(rows)), step[rows] + 1]
            share = np.maximum(a - b, 1e-9)
            push = 1 - a - b
            grad = np.bincount(i, push[doc] * v, minlength=1 << BITS) if len(i) > 1 << 19 else None
            touched = np.unique(i)
            g = grad[touched] if grad is not None else np.bincount(np.searchsorted(touched, i), push[doc] * v, minlength=len(touched))
            g -= 1e-4 * weights[touched]
            squares[touched] += g * g
            weights[touched] += RATE * g / np.sqrt(squares[touched])
            down = np.zeros(k + 2)
            np.add.at(down, step[rows], -a * (1 - a) / share)
            np.add.at(down, step[rows] + 1, b * (1 - b) / share)
            down = down[1:-1] / len(rows)
            base += 0.05 * down.sum()
            for j in range(k - 1):
                gap[j] = np.clip(gap[j] + 0.05 * down[j + 1 :].sum() * np.exp(gap[j]), -4, 4)
    theta = base + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
    return OrdinalModel(weights.astype(np.float32), theta, tuple(grades.tolist()))


def train(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", max_rated: int = MAX_RATED) -> OrdinalModel | None:
    rated = (
        ratings.select(F.col(id_col).alias("__id"), grade.cast("double").alias("__grade"))
        .where("__id is not null and __grade is not null")
        .groupBy("__id")
        .agg(F.mode("__grade", True).alias("__grade"))
    )
    # one row an id: its most frequent grade and its first text, so that the sample is the same however rows are dealt
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    sample = rated.orderBy(F.xxhash64("__id"), "__id").limit(max_rated)
    rows = own.join(F.broadcast(sample), "__id").groupBy("__id", "__grade").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                ids, values, begin = features(chunk)
                cut = lambda x: [x[begin[i] : begin[i + 1]].tobytes() for i in range(len(chunk))]  # noqa: B023, E731
                own = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([own.column(0).cast(pa.string()), own.column(2), pa.array(cut(ids), pa.binary()), pa.array(cut(values), pa.binary())], ["id", "grade", "ids", "vals"])

    table = rows.select("__id", "text", "__grade").mapInArrow(extract, "id string, grade double, ids binary, vals binary").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("id", "ascending"), ("grade", "ascending")])
    grade = table.column("grade").to_numpy()
    size, ids = _flat(table.column("ids"), np.int32)
    _, values = _flat(table.column("vals"), np.float32)
    del table
    return fit(ids, values, np.concatenate(([0], np.cumsum(size // 4))), grade)


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Each binary value's length in bytes, and all of them side by side, without copies of single ones."""
    array = column.combine_chunks()
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return np.diff(offsets), raw[offsets[0] : offsets[-1]].view(kind)


def score(docs: DataFrame, model: OrdinalModel | None, keep: dict[str, Column], text_col: str = "text", at_least: float | None = None) -> DataFrame:
    """`keep` and for each row expected_grade and p_tail = P(grade >= at_least), by default of the top grade."""
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.col(text_col).cast("string").alias("__text"))
    if model is None:
        return rows.drop("__text").withColumns({"expected_grade": F.lit(None).cast("double"), "p_tail": F.lit(None).cast("double")})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    want = model.grades[-1] if at_least is None else at_least
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        column = int(np.searchsorted(model.grades, want))
        for batch in batches:
            expected, tail = [np.zeros(0)], [np.zeros(0)]
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                ids, values, begin = features(chunk)
                p = model.tails(segment_sum(model.weights[ids].astype(np.float64) * values, begin))
                expected.append(model.expected(p))
                sure = np.ones(len(chunk)) if column == 0 else np.zeros(len(chunk)) if column > p.shape[1] else p[:, column - 1]
                tail.append(sure)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(expected)), pa.array(np.concatenate(tail))], [*batch.schema.names[:-1], "expected_grade", "p_tail"])

    return rows.mapInArrow(run, schema + "expected_grade double, p_tail double")




def grade_of_labels() -> Column:
    """Toxic 0, low quality 1, sound 2; null where a label is."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


#: A document is kept if the model gives the top grade at least this probability.
KEEP_FROM = 0.5


def classify(docs: DataFrame, ratings: DataFrame, keep: dict[str, Column], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """expected_grade, p_tail and kept for every row, with a model fitted on the ratings of these documents."""
    model = train(docs, ratings, grade_of_labels(), id_col, text_col)
    return score(docs, model, keep, text_col).withColumn("kept", F.coalesce(F.col("p_tail") >= KEEP_FROM, F.lit(True)))
