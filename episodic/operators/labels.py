"""Cleaning of hierarchical label tables given as string cells in row order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sheet() -> Window:
    return Window.partitionBy("sheet").orderBy("row_idx")


def until_sentinel(cells: DataFrame, cell: str, sentinel: str) -> DataFrame:
    """Rows of each sheet before the first with the sentinel in a cell."""
    seen = F.max((F.coalesce(F.trim(cell), F.lit("")) == sentinel).cast("int")).over(sheet().rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("__s", seen).where("__s = 0").drop("__s")


def attach_to_parents(cells: DataFrame, is_parent: Column, parent_id: Column) -> DataFrame:
    """Rows with parent_id: their own if they are parents, else that of the last parent above; rows above the first parent go."""
    flagged = cells.withColumn("is_parent", F.coalesce(is_parent, F.lit(False)))
    above = F.last(F.when(F.col("is_parent"), parent_id), ignorenulls=True).over(sheet().rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("parent_id", above).where("parent_id IS NOT NULL")


def block_class(blocks: dict[str, tuple[str, str]]) -> Column:
    """The first class whose start and end cells are both filled."""
    return F.coalesce(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(k)) for k, (a, b) in blocks.items()))


def reindexed(children: DataFrame) -> DataFrame:
    """Children with moment_idx counted from 1 in order of start and unit_id = parent#idx."""
    w = Window.partitionBy("parent_id").orderBy("start_time", "moment_idx")
    d = children.withColumn("moment_idx", F.row_number().over(w).cast("long"))
    return d.withColumn("unit_id", F.concat_ws("#", F.col("parent_id").cast("string"), F.col("moment_idx").cast("string")))


def tallies(children: DataFrame, classes: list[str]) -> DataFrame:
    return children.groupBy("parent_id").agg(*(F.count_if(F.col("type") == c).alias(f"n_{c}") for c in classes))


def mismatches(declared: DataFrame, actual: DataFrame, classes: list[str]) -> DataFrame:
    """Parents whose declared counts differ from the actual ones; missing counts are 0."""
    a = actual.select("parent_id", *(F.col(f"n_{c}").alias(f"actual_{c}") for c in classes))
    d = declared.join(a, "parent_id", "left").fillna(0, [*(f"n_{c}" for c in classes), *(f"actual_{c}" for c in classes)])
    return d.where(reduce(lambda x, y: x | y, (F.col(f"n_{c}") != F.col(f"actual_{c}") for c in classes)))


def counted_with_total(df: DataFrame, key: str, cls: str) -> DataFrame:
    """Counts per key and class, and per key as class total."""
    g = df.groupingSets([[F.col(key), F.col(cls)], [F.col(key)]], F.col(key), F.col(cls)).agg(F.grouping(cls).alias("__g"), F.count(F.lit(1)).alias("n"))
    return g.select(key, F.when(F.col("__g") == 1, "total").otherwise(F.col(cls)).alias(cls), "n")


def strays(df: DataFrame, column: str) -> DataFrame:
    """df with a time nulled out where it lies outside the row's own start and end, and stray to report it. A row without a start or an end has no strays."""
    stray = F.coalesce(~F.col(column).between(F.col("start_time"), F.col("end_time")), F.lit(False)) & F.col("start_time").isNotNull() & F.col("end_time").isNotNull()
    return df.withColumn("stray", stray).withColumn(column, F.when(~F.col("stray"), F.col(column)))


def without(cells: DataFrame, ignored: DataFrame) -> DataFrame:
    """Cells but for the rows (sheet, row_idx) that are listed as ignored."""
    return cells.join(ignored, ["sheet", "row_idx"], "left_anti")


def children(attached: DataFrame, blocks: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with a filled block, with type; a parent row with one is a child too."""
    return attached.withColumn("type", block_class(blocks)).where("type IS NOT NULL")


def adopted(attached: DataFrame, own: str, slipped: str) -> DataFrame:
    """(parent_id, own): each parent's count, or the first one found on a row below it."""
    first = F.min_by(slipped, F.when(~F.col("is_parent") & F.col(slipped).isNotNull(), F.col("row_idx")))
    return attached.groupBy("parent_id").agg(F.coalesce(F.max(F.when(F.col("is_parent"), F.col(own))), first).alias(own))


def parted(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents (type umbrella) and children (any other or no type) with unit_id = parent#idx."""
    umbrella = F.coalesce("type", F.lit("_")) == "umbrella"
    return flat.where(umbrella), flat.where(~umbrella).withColumn("unit_id", F.concat_ws("#", F.col("parent_id").cast("string"), F.col("moment_idx").cast("string")))


def tally_from_sheet(sheet: DataFrame, classes: list[str]) -> DataFrame:
    """(water_year, cls, n_expert) of a sheet of text cells: a year and a column per class; headers and blanks go."""
    year, *counts = sheet.columns
    d = sheet.where(F.trim(year).rlike("^[0-9]+$")).withColumnsRenamed(dict(zip(counts, classes, strict=True)))
    long = d.select(F.trim(year).try_cast("long").alias("water_year"), *classes).unpivot("water_year", classes, "cls", "n")
    return long.withColumn("n_expert", F.trim("n").try_cast("double").cast("long")).where("n_expert IS NOT NULL").select("water_year", "cls", "n_expert")
