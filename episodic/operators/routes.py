"""Feature and curve tables of a route: detected excursions, labelled parents or labelled children as units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import from_micros, micros, remap, seconds_between
from . import events as E
from .intervals import best_overlap, overlap_pairs

ROUTES = ("auto", "events", "moments")
# The columns of the feature table, in order (area is the sum of the target over time).
NUMERIC = ["dur_min", "n_samples", "peak_do", "mean_do", "area", "peak_frac", "rise_min", "fall_min", "rise_rate", "fall_rate", "sal_in", "wl_in", "temp_in", "sal_step", "wl_step", "temp_step"]
NUMERIC += ["centroid_frac", "max_rise_norm", "plateau_frac", "hyst_wl", "hyst_sal", "precip_24h", "precip_72h", "precip_168h"]


# Subtype codes of the labels and what they say; a code without its own text has that of its first letter.
MEANINGS = {
    "h": "hot moment — tidal DO incursion (water-level rise + salinity step)",
    "b": "unclassified hot moment (held out)",
    "hx": "mixed — a symmetric pulse coincident with a salinity step",
    "e": "oxic event during a flood",
    "o1": "oxic pulse — no change in salinity",
    "o2": "oxic pulse — adiabatic change in salinity",
    "o3": "oxic pulse — prior to flooding",
    "o4": "oxic pulse — during / following flooding",
    "o5": "oxic pulse — coincident with rainfall",
}


def units(route: str, readings: DataFrame, parents: DataFrame, children: DataFrame, peak_min: float, merge_gap: int) -> DataFrame:
    """(series_id, eid, unit_id, event_id, start_time, end_time, subtype, label, label_source, split); excursions without a parent are held out.

    subtype is the parent's where parents have one; moments take it from their parent.
    """
    subtype = F.col("subtype") if "subtype" in parents.columns else F.lit(None).cast("string")
    if route == "moments":
        child = children.select("series_id", (F.col("parent_id") * 100 + F.col("moment_idx")).alias("eid"), F.concat_ws("#", "parent_id", "moment_idx").alias("unit_id"), F.col("parent_id").alias("event_id"), "start_time", "end_time", F.col("type").alias("label"))
        child = child.join(parents.select(F.col("interval_id").alias("event_id"), subtype.alias("subtype")), "event_id", "left")
        child = child.select("series_id", "eid", "unit_id", "event_id", "start_time", "end_time", "subtype", "label")
        return child.withColumns({"label_source": F.lit("expert"), "split": F.lit("train")})
    if route == "events":
        of = parents.select("series_id", F.col("interval_id").alias("eid"), F.col("interval_id").cast("string").alias("unit_id"), F.col("interval_id").alias("event_id"), "start_time", "end_time", subtype.alias("subtype"), "label")
        return of.withColumns({"label_source": F.lit("expert"), "split": F.lit("train")})
    found = E.excursions(readings, peak_min, merge_gap)
    a = found.select("series_id", F.col("eid").alias("a_id"), F.col("start_time").alias("a_start"), F.col("end_time").alias("a_end"))
    label = F.struct("label", subtype.alias("subtype"))  # both come from the parent that overlaps longest
    b = parents.select("series_id", F.col("interval_id").alias("b_id"), F.col("start_time").alias("b_start"), F.col("end_time").alias("b_end"), label.alias("label"))
    best = best_overlap(overlap_pairs(a, b)).select("series_id", F.col("a_id").alias("eid"), F.col("b_id").alias("event_id"), "label.subtype", "label.label")
    d = found.join(best, ["series_id", "eid"], "left")
    orphan = F.col("event_id").isNull()
    d = d.select("series_id", "eid", F.format_string("auto#%d", "eid").alias("unit_id"), "event_id", "start_time", "end_time", "subtype", "label")
    return d.withColumns({"label_source": F.when(orphan, "inferred").otherwise("expert"), "split": F.when(orphan, "holdout").otherwise("train")})


def feature_table(of: DataFrame, readings: DataFrame) -> DataFrame:
    """units with is_backfill (whether their first reading is spliced in) and all NUMERIC features; a unit without readings has none and is left out."""
    members = E.member_rows(of, readings)
    spliced = F.min_by(F.col("is_backfill"), "idx") if "is_backfill" in readings.columns else F.lit(False)
    f = E.driver_steps(E.shape_features(members, {"is_backfill": F.coalesce(spliced, F.lit(False))}), readings).drop("start_time", "end_time")
    f = f.join(E.hystereses(members, {"hyst_wl": "lvl", "hyst_sal": "sal"}), ["series_id", "eid"], "left")
    return of.join(f, ["series_id", "eid"]).select(*of.columns, "is_backfill", *NUMERIC)


def segments(auto: DataFrame) -> DataFrame:
    """(event_id, n_segments): how many excursions inherited from each labelled event; auto are units of that route."""
    return auto.where("event_id IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_segments"))


def padded(intervals: DataFrame, left_h: float, right_frac: float = 0.25, right_cap_h: float = 6.0) -> DataFrame:
    """Intervals widened by hours on the left, and on the right by a share of their length up to a cap."""
    length = seconds_between(F.col("start_time"), F.col("end_time"))
    right = (F.least(right_frac * length, F.lit(right_cap_h * 3600)) * 1_000_000).cast("long")
    return intervals.withColumns({"start_time": from_micros(micros(F.col("start_time")) - int(left_h * 3_600_000_000)), "end_time": from_micros(micros(F.col("end_time")) + right)})


def run(route: str, readings: DataFrame, parents: DataFrame, children: DataFrame, folder: str, peak_min: float = 0.1, merge_gap: int = 12, steps: int = 128) -> None:
    """Write a route's features and curves below a folder, as Parquet."""
    of = units(route, readings, parents, children, peak_min, merge_gap)
    feature_table(of, readings).write.mode("overwrite").parquet(f"{folder}/{route}_features")
    curves = E.curves(readings, of.withColumnRenamed("eid", "interval_id"), ["target", "sal", "lvl", "temp", "precip"], steps)
    curves.withColumnRenamed("interval_id", "eid").join(of.select("series_id", "eid", "unit_id", "event_id", "label", "split"), ["series_id", "eid"]).write.mode("overwrite").parquet(f"{folder}/{route}_curves")


def load(spark: SparkSession, route: str, folder: str) -> DataFrame:
    """A route's features with cls, the class name for display."""
    if route not in ROUTES:
        raise ValueError(f"no route {route}")
    return spark.read.parquet(f"{folder}/{route}_features").withColumn("cls", remap(F.col("label"), {"pulse": "oxic"}))


def summary_card(features: DataFrame) -> DataFrame:
    """(series_id, eid, ord, field, value): one line of text per field of a unit; what is unknown is a dash.

    flooding (boolean) and n_segments (see segments) are read where features has them; an event without excursions has 0.
    """
    has = lambda c, t: F.col(c) if c in features.columns else F.lit(None).cast(t)
    text = lambda c, form, unit="": F.when(F.col(c).isNotNull(), F.concat(F.format_string(form, F.col(c)), F.lit(unit))).otherwise("-")
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    known = F.create_map(*(F.lit(x) for pair in MEANINGS.items() for x in pair))
    code = F.coalesce(has("subtype", "string"), F.lit(""))
    fields = [
        ("unit", F.col("unit_id")), ("class", F.concat(F.coalesce("label", F.lit("-")), F.when(code != "", F.concat(F.lit("  ("), code, F.lit(")"))).otherwise(""))),
        ("code means", F.coalesce(F.try_element_at(known, code), F.try_element_at(known, F.substring(code, 1, 1)), F.lit("-"))),
        ("window", F.concat_ws(" to ", when("start_time"), when("end_time"))), ("duration", F.concat(F.format_string("%.1f", F.col("dur_min") / 60), F.lit(" h"))),
        ("peak", text("peak_do", "%.2f", " mg/L")), ("salinity step", text("sal_step", "%+.2f")), ("water-level step", text("wl_step", "%+.2f")), ("precipitation before (24 h)", text("precip_24h", "%.1f", " mm")),
        ("flooding", F.coalesce(has("flooding", "boolean").cast("string"), F.lit("-"))), ("excursions", F.concat(F.coalesce(has("n_segments", "long"), F.lit(0)).cast("string"), F.lit(" segment(s)"))), ("readings", F.col("n_samples").cast("string")),
    ]
    lines = F.array(*(F.struct(F.lit(i).cast("long").alias("ord"), F.lit(k).alias("field"), v.alias("value")) for i, (k, v) in enumerate(fields)))
    return features.select("series_id", "eid", F.inline(lines))
