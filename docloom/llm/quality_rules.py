"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every document gets counts (words, symbols, repeated lines, words in repeated windows). Each language and source has
a quantile sketch per measure: counts by logarithmic bucket, which merge by adding and answer quantiles within a
fixed relative error. From a group's sketches come its fences, so that a source is judged by its own habits: for the
shares (symbols, repeated lines, repeated windows) a high quantile of the group with some slack, for the mean word length
an upper and a lower fence, quartile plus or minus a multiple of the quartiles' distance. A group of few documents uses
its language's sketch, merged from the groups', and failing that the whole corpus's. The fences are joined back, and a
document beyond one is not kept. Counting is one narrow pass, written once; the sketches are small after map-side sums.

Defined results: a null or empty text has no words and fails the base rules. Null languages and sources are groups
of their own. Repeated rows count and are judged each; null ids are allowed; texts of any length are counted whole, and a
value equal to its fence is within it. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import SPACE, Scratch

WINDOW_WORDS = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Ratio of a bucket's bounds: quantiles are within 0.5 % of the true value.
GAMMA = 1.01
MIN_GROUP = 100
#: The fence of a share is this quantile of its group ...
QUANTILE = {"symbol_share": 0.9, "dup_line_share": 0.99, "repeat_share": 0.99}
#: ... times the first plus the second, so that groups which hardly ever have any allow a little.
SLACK, ALLOWED = 1.25, 0.02
#: Mean word length: so many quartile distances beyond the quartiles, the distance at least the second.
DISTANCES, LEAST_DISTANCE = 3.0, 0.05
#: The fences: measure, and whether it is an upper one.
FENCES = (("symbol_share", True), ("dup_line_share", True), ("repeat_share", True), ("mean_word", True), ("mean_word", False))
MAX_BROADCAST_GROUPS = 200_000


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_window_words(words: Column, n: int = WINDOW_WORDS) -> Column:
    """How many words stand in windows of n words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        # sorted by hash, equal windows are neighbours; back in text order, each adds the words the last did not cover
        def by_place(s: Column) -> Column:
            size = F.size(s)
            same = lambda k: ((k > 0) & (F.get(s, k - 1)["h"] == F.get(s, k)["h"])) | ((k < size - 1) & (F.get(s, k + 1)["h"] == F.get(s, k)["h"]))
            marked = F.filter(F.sequence(F.lit(0), size - 1), lambda k: F.coalesce(same(k), F.lit(False)))
            return F.sort_array(F.transform(marked, lambda k: F.get(s, k)["i"]))

        places = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), by_place)
        zero = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(n), p - a["last"])).cast("long").alias("sum"))
        return F.aggregate(places, zero, step)["sum"]

    # slices, not eight single hashes a place: those were a third slower when measured
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) > n, some).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counts = let(
        words_of(F.col("__t")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_window_words(w).alias("n_repeat_words")),
    )
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    got = docs.select(*[c.alias(k) for k, c in keep.items()], text.alias("__t")).select(*keep, counts.alias("__c"), dup.alias("__d"), F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return got.select(*keep, "__c.n_words", "__c.word_chars", "n_symbols", "__d.n_lines", "__d.n_dup_lines", "__c.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_share": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n,
    }


def bucket(x: Column) -> Column:
    """Sketch bucket of a value of at least 0; all below 0.0001 share one."""
    return F.when(x < 1e-4, F.lit(-1_000_000)).otherwise(F.ceil(F.log(x) / F.log(F.lit(GAMMA))).cast("int"))


def bucket_value(b: Column) -> Column:
    """The value a bucket stands for: the middle of its bounds, on a relative scale."""
    return F.when(b == -1_000_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), b.cast("double")) / (GAMMA + 1))


def sketch(measured: DataFrame, group: list[str]) -> DataFrame:
    """group, measure, bucket, n: the quantile sketches of every group."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures().items()]))
    return measured.select(*group, pairs.alias("p")).groupBy(*group, "p.measure", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts of the same bucket add up."""
    return sketches.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))


def _name(measure: str, upper: bool, level: str) -> str:
    return f"{measure}_{'most' if upper else 'least'}_{level}"


def fences(sketches: DataFrame, group: list[str], name: str) -> DataFrame:
    """group, n_docs and a column per fence."""
    w = Window.partitionBy(*group, "measure")
    run = sketches.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bucket"))})
    at = lambda q: bucket_value(F.min(F.when(F.col("upto") >= F.ceil(q * F.col("total")), F.col("bucket"))))
    high = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in QUANTILE.items() for x in kv]), F.col("measure")), F.lit(0.75))
    q = run.withColumn("high", high).groupBy(*group, "measure").agg(F.max("total").alias("n_docs"), at(F.lit(0.25)).alias("low"), at(F.col("high")).alias("high"))
    distance = DISTANCES * F.greatest(F.col("high") - F.col("low"), F.lit(LEAST_DISTANCE))
    most = F.when(F.col("measure") == "mean_word", F.col("high") + distance).otherwise(SLACK * F.col("high") + ALLOWED)
    per = [F.max(F.when(F.col("measure") == m, F.col("most" if upper else "least"))).alias(_name(m, upper, name)) for m, upper in FENCES]
    return q.withColumns({"most": most, "least": F.col("low") - distance}).groupBy(*group).agg(F.max("n_docs").alias(f"n_{name}"), *per)


def judge(docs: DataFrame, keep: dict[str, Column], lang_col: str = "lang", source_col: str = "source", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """`keep`, the counts, base_failed, the fences that held, and kept."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    measured = scratch.save(measure(docs, keep | {"__lang": F.col(lang_col).cast("string"), "__source": F.col(source_col).cast("string")}, text_col), "measured")
    fine = scratch.save(sketch(measured.where(~base_failed()), ["__lang", "__source"]), "sketches")
    own, by_lang = fences(fine, ["__lang", "__source"], "own"), fences(merge(fine, ["__lang"]), ["__lang"], "lang")
    whole = fences(merge(fine, []), [], "all").first()  # one row, or none
    corpus = lambda m, upper: F.lit(whole[_name(m, upper, "all")] if whole else None).cast("double")
    levels = own.join(by_lang.withColumnRenamed("__lang", "__l"), F.col("__lang").eqNullSafe(F.col("__l")))
    pick = lambda m, upper: F.when(F.col("n_own") >= MIN_GROUP, F.col(_name(m, upper, "own"))).when(F.col("n_lang") >= MIN_GROUP, F.col(_name(m, upper, "lang"))).otherwise(corpus(m, upper))
    table = scratch.save(levels.select(F.col("__lang").alias("__l"), F.col("__source").alias("__s"), *[pick(m, upper).alias(_name(m, upper, "fence")) for m, upper in FENCES]), "fences")
    if table.count() <= MAX_BROADCAST_GROUPS:
        table = F.broadcast(table)
    joined = measured.join(table, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left")
    verdict = F.lit(True)
    for m, upper in FENCES:
        v, fence = measures()[m], F.col(_name(m, upper, "fence"))
        verdict = verdict & F.coalesce(v <= fence if upper else v >= fence, F.lit(True))
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & verdict}).drop("__lang", "__source", "__l", "__s")
