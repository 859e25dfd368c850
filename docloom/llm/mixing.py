"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's share of all words follows its weight, up to a multiple of its own size; what is cut off is shared among
the others by weight (solved in closed form over the sorted sources). Within a source a document's expected number of
copies is proportional to its own weight (by default the root of its size, so that long documents repeat more), up to
the most copies allowed; the factor that makes them add up to the target is solved in the same way over the source's
distinct weights. Whole copies are certain, and the fraction p is the inclusion probability for one more. Documents are
ranked by U/(1-U) divided by p/(1-p), U a hash of seed and id, and taken in that order until the source's remaining words
are reached as nearly as a document allows. Only a source's bin that holds the cut is sorted: bins before it are taken
whole, bins after it not. There are as many bins as the root of the number of rows, so neither the bins nor the rows of
one are a bottleneck where a source has most of the rows.

Defined results: a null, empty or wordless text has size 0 and takes nothing; one of any length is counted whole. A null
source is a source of its own, the last one. Weights are rounded to thousandths, so that their sums do not depend on the
order; a null weight is 1, one below 0 is 0. Rows of equal rank are taken by size; repeated rows are ranked each, alike,
and equal rows are interchangeable. Same rows and seed, same result, whatever the partitioning. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import Scratch, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Weights are whole numbers of this share, so that sums are exact.
WEIGHT_UNITS = 1000
MAX_BROADCAST_SOURCES = 200_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, n_docs, source_size, target: one row per source. Single-task windows here see one row per source."""
    by = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    by = by.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1))
    # a source is full where the common level reaches its cap per weight; sorted by that, the full ones come first
    order = Window.orderBy(F.col("source_size") * max_repeat / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * max_repeat
    by = by.withColumns({"total": F.sum("source_size").over(Window.partitionBy()), "full": F.coalesce(F.sum(cap).over(before), F.lit(0)), "rest": F.sum("weight").over(after)})
    by = by.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest")).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(F.col("weight") * F.col("level") < cap, F.struct("place", "level"))).over(Window.partitionBy())
    by = by.withColumn("first", first)
    target = F.when(F.col("place") >= F.col("first.place"), F.col("weight") * F.col("first.level")).otherwise(cap.cast("double"))
    return by.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and the columns' text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def copy_levels(sizes: DataFrame, targets: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """__s, limit, level: a source's documents of weights up to `limit` are expected `level` times their weight, heavier ones `max_repeat` times.

    The windows see one row per distinct weight of a source.
    """
    by = sizes.where("w > 0").groupBy(F.col("source").alias("__o"), "w").agg(F.sum("size").alias("words")).join(targets.select("__s", "target"), F.col("__o").eqNullSafe(F.col("__s")))
    order = Window.partitionBy("__s").orderBy(F.col("w").desc())
    full = F.coalesce(F.sum(max_repeat * F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w").cast("decimal(19,0)") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    by = by.withColumn("level", F.when(rest > 0, (F.col("target") - full) / rest)).where(F.col("w") * F.col("level") < max_repeat)
    first = by.groupBy("__s").agg(F.max(F.struct("w", "level")).alias("first"))
    return first.select("__s", F.col("first.w").alias("limit"), F.col("first.level").alias("level"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight: Column | None = None, keep: dict[str, Column] | None = None, seed: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """`keep` (by default the id), size, source_size, target, copies and taken for every row.

    A document's expected copies are proportional to `weight`, by default the root of its size, rounded up.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    keep = keep if keep is not None else {id_col: F.col(id_col)}
    size = word_count(F.col(text_col).cast("string"))
    own = F.ceil(F.sqrt(F.col("size").cast("double"))) if weight is None else F.greatest(F.coalesce(F.col("__w"), F.lit(1.0)), F.lit(0.0))
    carried = [c.alias(f"__k_{k}") for k, c in keep.items()] + ([] if weight is None else [weight.cast("double").alias("__w")])
    sizes = docs.select(*carried, F.col(source_col).cast("string").alias("source"), size.alias("size"), uniform(seed, F.col(id_col)).alias("u"))
    sizes = scratch.save(sizes.withColumn("w", F.round(own * WEIGHT_UNITS).cast("long")), "sizes")
    targets = scratch.save(source_targets(sizes).withColumnRenamed("source", "__s"), "targets")
    small = targets.count() <= MAX_BROADCAST_SOURCES
    side = lambda t: F.broadcast(t) if small else t
    levels = copy_levels(sizes, side(targets)).withColumnRenamed("__s", "__l")
    targets = scratch.save(targets.join(side(levels), F.col("__s").eqNullSafe(F.col("__l")), "left").drop("__l"), "levels")
    rows = sizes.join(side(targets), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    expected = F.when(F.col("w") == 0, F.lit(0.0)).when(F.col("w") <= F.col("limit"), F.col("w") * F.col("level")).otherwise(F.lit(float(MAX_REPEAT)))
    rows = rows.withColumn("e", expected).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    odds = lambda p: F.when(p > 0, p / (1 - p))
    open_ = (F.col("whole") < MAX_REPEAT) & (F.col("p") > 0)
    rows = rows.withColumn("q", F.when(open_, F.col("u") / (1 - F.col("u")) / odds(F.col("p"))))
    # on a logarithmic scale no bin has more than a quarter of the root of the rows, whatever the odds, and there are few times that many bins
    rows = rows.withColumn("bin", F.floor(F.log("q") * F.sqrt(F.col("n_docs").cast("double"))))
    bins = rows.groupBy(F.col("source").alias("__s"), "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.max("target").alias("target"))
    per, run = Window.partitionBy("__s"), Window.partitionBy("__s").orderBy(F.col("bin").asc_nulls_first())
    bins = bins.withColumn("left", F.col("target") - F.sum("certain").over(per)).withColumn("words", F.when(F.col("bin").isNotNull(), F.col("words")).otherwise(F.lit(0)))
    bins = bins.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    cut = bins.groupBy("__s").agg(
        F.max("left").alias("left"), F.max(F.when(F.col("upto") <= F.col("left"), F.col("bin"))).alias("last_whole"), F.min(F.when((F.col("before") < F.col("left")) & (F.col("upto") > F.col("left")), F.struct("bin", "before"))).alias("at")
    )
    cut = scratch.save(cut.select("__s", "left", "last_whole", F.col("at.bin").alias("cut_bin"), F.col("at.before").alias("before")), "cuts")
    rows = rows.join(side(cut), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    out = lambda df, more: df.withColumn("copies", (F.col("whole") + more).cast("int"))
    at_cut = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    plain = out(rows.where(~at_cut), F.when(F.coalesce(F.col("bin") <= F.col("last_whole"), F.lit(False)), 1).otherwise(0))
    order = Window.partitionBy("source").orderBy("q", "size", "u")
    edge = rows.where(at_cut).withColumn("__upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = out(edge, F.when(2 * F.col("__upto") - F.col("size") <= 2 * F.col("left"), 1).otherwise(0)).drop("__upto")
    both = plain.unionByName(edge)
    return both.select(*[F.col(f"__k_{k}").alias(k) for k in keep], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
