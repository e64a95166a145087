"""Column functions: grids, calendars, flags, labels, arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def snap(ts: Column, seconds: int = 300) -> Column:
    """The nearest point of a time grid, halves up."""
    step = seconds * 1_000_000
    return from_micros(F.floor((micros(ts) + F.lit(step // 2)) / F.lit(step)).cast("long") * step)


def hour_of(ts: Column, unit: str = "hour") -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def water_year(ts: Column, first_month: int = 10) -> Column:
    """The year that ends before the next first_month begins."""
    return (F.year(ts) + (F.month(ts) >= first_month).cast("int")).cast("long")


def season(ts: Column) -> Column:
    """0 from December, 1 from March, 2 from June, 3 from September."""
    return F.floor(F.pmod(F.month(ts), F.lit(12)) / 3).cast("long")


def year_fraction(ts: Column) -> Column:
    return F.year(ts) + (F.dayofyear(ts) - 1) / F.lit(365.25)


def calendar(ts: Column) -> dict[str, Column]:
    """Sine and cosine of the hour of day and the day of year."""
    hour, day = 2 * F.pi() * F.hour(ts) / 24, 2 * F.pi() * F.dayofyear(ts) / F.lit(365.25)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "doy_sin": F.sin(day), "doy_cos": F.cos(day)}


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(1e6)


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, rounded down (negatives too)."""
    return F.floor((micros(b) - micros(a)) / F.lit(60e6)).cast("long")


def null_tokens(value: Column, tokens: tuple[str, ...] = ("#REF!", "")) -> Column:
    return F.when(~value.isin(*tokens), value)


def tristate(value: Column) -> Column:
    """Yes is true, blank and null are unknown, anything else is false."""
    return F.when(F.trim(value) != "", F.lower(F.trim(value)) == "yes")


def suffix_class(suffix: Column) -> Column:
    """Label class by the beginning of a subtype; the first rule that fits counts."""
    s = F.lower(F.trim(suffix))
    # Beginnings and their classes, in order.
    rules = (("m", "mixed"), ("hx", "mixed"), ("e", "pulse"), ("o", "pulse"), ("h", "hot"))
    out = reduce(lambda acc, rule: acc.when(s.startswith(rule[0]), rule[1]), rules, F.when(F.lit(False), ""))
    return out.otherwise("ignore")


def remap(value: Column, mapping: dict[str, str], strict: bool = False) -> Column:
    """Values by a mapping; others stay, or raise if strict."""
    out = reduce(lambda acc, kv: acc.when(value == kv[0], kv[1]), mapping.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown value "), value)).cast("string") if strict else value)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; one half where there is no range."""
    return F.when(high > low, (value - low) / (high - low)).when(value.isNotNull(), F.lit(0.5))


def entropy_bits(p: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    """Of an array of doubles."""
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(xs, lambda x: F.exp(x - top) / total)


def mean_std_text(mean: Column, std: Column) -> Column:
    return F.format_string("%.3f ± %.3f", mean, std)


def linspace(low: Column, high: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / F.lit(max(n - 1, 1)).cast("double"))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """The piecewise linear function through sorted points at x; flat beyond both ends, null without points."""
    n = F.size(xs)
    at = F.size(F.filter(xs, lambda v: v <= x))  # points at or before x
    x0, x1, y0, y1 = F.get(xs, at - 1), F.get(xs, at), F.get(ys, at - 1), F.get(ys, at)
    return F.when(n <= 0, None).when(at == 0, F.get(ys, F.lit(0))).when(at >= n, F.get(ys, n - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def heal_time(raw: Column, reference: Column) -> Column:
    """A time-only text (HH:mm) on the reference's date, the next day if before the reference; full date-times as they are."""
    full = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    clock = F.try_to_timestamp(F.concat(F.date_format(reference, "yyyy-MM-dd "), raw), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    rolled = F.when(clock < reference, clock + F.expr("INTERVAL '1' DAY")).otherwise(clock)
    return F.coalesce(full, rolled)
