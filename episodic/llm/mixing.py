"""Mixing sources to target weights by weighted fair queueing.

Every source has a weight; its target is its weighted share of all words, held at max_repeats times
what it has, the excess being shared again by weight. Each document, in a shuffled order that depends
on its id alone, gets a virtual finish time: the words its source has handed out up to and with it,
divided by the source's target. Passes over a source follow one another, so a source with a target
beyond its size is repeated. Copies are put in order of finish time over all sources and cut where the
total budget is spent.

Running sums are two-level (sums per bucket of the shuffled order, then inside the bucket), so a source
with a third of all rows is spread over many tasks. Only the sums per source and per bucket, whose
number does not grow with the documents, are ordered in one task.

Null sources form one source, ordered last; null texts have size 0 and are never taken; null ids are
shuffled like others. Ties of id are broken by a hash of id, source and text; rows equal in these are
interchangeable and share what is taken of them. Texts of any length are counted whole. An empty table
gives an empty result; extra columns are passed on by repeated() and not looked at by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, checkpointed, small, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Slices of the shuffled order of one source (three hex digits), and of virtual time.
SLICES = 4096
TICKS = 16384


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def tie(text: Column) -> Column:
    return F.xxhash64("doc_id", "source", text)


def targets(sized: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) of rows (source, size).

    The excess over the held targets goes to the others by weight until none is above: the level at
    which that ends is the largest that some source, in order of limit by weight, allows.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("most", F.col("source_size") * float(max_repeats))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(whole).cast("double"),
        "held": F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "free": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    level = (F.col("total") - F.col("held")) / F.col("free")
    per = per.withColumn("level", F.when(F.col("most") / F.col("weight") >= level, level)).withColumn("level", F.max("level").over(whole))
    return per.select("source", "source_size", F.coalesce(F.least("most", F.col("weight") * F.col("level")), F.col("most")).alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs(doc_id, text, source)."""
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tie(F.col("text")).alias("tie")).withColumn("order", order)
    sized = checkpointed(sized.withColumn("slice", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")))
    goal = checkpointed(targets(sized, weights, max_repeats)).withColumnRenamed("source", "g_source")
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slice").orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    d = sized.withColumn("cum", F.sum("size").over(inside))
    d = d.join(small(slices), d.source.eqNullSafe(F.col("s_source")) & (d.slice == F.col("s_slice")))
    d = d.join(small(goal), d.source.eqNullSafe(F.col("g_source")))
    d = d.withColumn("cum", F.col("cum") + F.col("base")).drop("s_source", "s_slice", "g_source", "base")
    copies = d.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    copies = copies.withColumn("finish", (F.col("cum") + F.col("pass") * F.col("source_size")) / F.col("target"))
    copies = copies.withColumn("tick", F.floor(F.col("finish") * TICKS).cast("long"))
    ticks = copies.groupBy("tick").agg(F.sum("size").alias("in_tick"))
    earlier = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    ticks = ticks.withColumn("so_far", F.coalesce(F.sum("in_tick").over(earlier), F.lit(0)))
    total = F.broadcast(goal.agg(F.sum("source_size").alias("budget")))  # one row
    ticks = ticks.crossJoin(total).select(F.col("tick").alias("t_tick"), "so_far", "budget")
    copies = copies.join(small(ticks), copies.tick == F.col("t_tick"))
    within = Window.partitionBy("tick").orderBy("finish", "order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    taken = copies.withColumn("spent", F.sum("size").over(within) + F.col("so_far")).where("spent <= budget")
    # running sums of rows with words differ inside a source, so they tell its rows apart
    taken = taken.groupBy(F.col("source").alias("t_source"), F.col("cum").alias("t_cum")).agg(F.count(F.lit(1)).alias("copies"))
    d = d.join(taken, d.source.eqNullSafe(F.col("t_source")) & (d.cum == F.col("t_cum")) & (d.size > 0), "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "tie")


def repeated(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Rows of docs, each as often as the mix takes it; of rows equal in id, source and text the first ones get what is left over of equal shares."""
    one, two, all_, many, place, copy = unused(docs.columns, "id_key", "tie_key", "all_copies", "rows_alike", "place", "copy")
    zero = F.lit(0).cast("long")
    shares = mixed(docs, weights, max_repeats).groupBy(F.coalesce(F.col("doc_id").cast("long"), zero).alias(one), F.col("tie").alias(two))
    shares = shares.agg(F.sum("copies").alias(all_), F.count(F.lit(1)).alias(many)).where(F.col(all_) > 0)
    keyed = docs.withColumns({one: F.coalesce(F.col("doc_id").cast("long"), zero), two: tie(F.col("text"))})
    d = keyed.join(shares, [one, two]).withColumn(place, F.row_number().over(Window.partitionBy(one, two).orderBy(one)))
    times = F.floor(F.col(all_) / F.col(many)) + (F.col(place) <= F.col(all_) % F.col(many)).cast("long")
    return d.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
