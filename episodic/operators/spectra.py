"""Spectra of long series without a series in one task: transforms parted by residues, of any length by chirps.

A transform of m = m1 * m2 values (m a power of two) goes in two steps. The values whose places leave one rest by m1 are
transformed together (m2 values), turned by a root of unity, and those of one frequency by m2 are transformed together
(m1 values). Each step is a shuffle into groups of whole residues with about GROUP values. A series of n values, n not a
power of two, is multiplied by a chirp and convolved with the chirp's conjugate at a length of 2 n or more, which gives
the transform of n values itself: no value is padded, cut or windowed, so frequencies are those of the whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import micros

#: Values in a group of residues; one residue of a series of 2^30 values has 2^15.
GROUP = 1 << 17


def _sides(m: int) -> tuple[int, int]:
    """m as a product of two powers of two, about its root."""
    low = (m.bit_length() - 1) // 2
    return 1 << low, m >> low


def two_to(power: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), power.cast("int"))


def fourier(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, k, re, im): the transform of values (keys, m, n, re, im) of m places; a place without a row is 0. m is a power of two and the same within a key."""
    of = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def columns(pdf: pd.DataFrame, m: int, rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        same = {c: np.repeat(pdf[c].iloc[:1].to_numpy(), values.size) for c in keys}
        return pd.DataFrame({**same, "m": m, "r": np.repeat(rows, len(places)), "k": np.tile(places, len(rows)), "re": values.real.ravel(), "im": values.imag.ravel()})

    def grid(pdf: pd.DataFrame, row: pd.Series, place: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows, at = np.unique(row.to_numpy(), return_inverse=True)
        x = np.zeros((len(rows), width), complex)
        x[at, place.to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        return rows, x

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        m1, m2 = _sides(m)
        rest, x = grid(pdf, pdf["n"] % m1, pdf["n"] // m1, m2)
        k2 = np.arange(m2)
        turned = np.fft.fft(x, axis=1) * np.exp(-2j * np.pi * ((rest[:, None] * k2) % m) / m)
        return columns(pdf, m, rest, k2, turned)

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        m = int(pdf["m"].iloc[0])
        m1, m2 = _sides(m)
        k2, x = grid(pdf, pdf["k"], pdf["r"], m1)
        out = columns(pdf, m, k2, np.arange(m1), np.fft.fft(x, axis=1))
        return out.assign(k=out["r"] + m2 * out["k"])

    # as _sides, in columns: the largest power of two up to the root, and how many residues make a group
    low = two_to(F.floor((F.length(F.bin("m")) - 1) / 2))
    deal = lambda residue, width: F.floor(residue / F.greatest(F.lit(1), F.floor(F.lit(GROUP) / width))).cast("long")
    first = df.withColumn("__g", deal(F.col("n") % low, F.col("m") / low)).groupBy(*keys, "__g").applyInPandas(inner, f"{of}, m long, r long, k long, re double, im double")
    second = first.withColumn("__g", deal(F.col("k"), low)).groupBy(*keys, "__g").applyInPandas(outer, f"{of}, m long, r long, k long, re double, im double")
    return second.drop("r")


def _chirp(n: Column, size: Column, sign: int) -> tuple[Column, Column]:
    """exp(sign i pi n^2 / size), its angle taken from n^2 mod 2 size."""
    angle = F.pi() * ((n * n) % (2 * size)) / size
    return F.cos(angle), sign * F.sin(angle)


def power_spectrum(df: DataFrame, place: str, value: str, size: str, keys: list[str]) -> DataFrame:
    """(keys, size, k, power): squared size of the transform at each k from 1 to size / 2 of the values at the places 0 to size - 1.

    Rows with a null value count as 0. All keys of one size share the chirp's own transform.
    """
    n, s = F.col(place).cast("long"), F.col(size).cast("long")
    d = df.select(*keys, n.alias("n"), s.alias("size"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    d = d.withColumn("m", two_to(F.length(F.bin(2 * F.col("size") - 1))))
    c, i = _chirp(F.col("n"), F.col("size"), -1)
    a = fourier(d.select(*keys, "size", "m", "n", (F.col("v") * c).alias("re"), (F.col("v") * i).alias("im")), [*keys, "size"])
    c, i = _chirp(F.col("n"), F.col("size"), 1)
    around = F.explode(F.when(F.col("n") > 0, F.array("n", F.col("m") - F.col("n"))).otherwise(F.array("n")))
    b = fourier(d.select("size", "m", "n").distinct().select("size", "m", around.alias("at"), c.alias("re"), i.alias("im")).withColumnRenamed("at", "n"), ["size"])
    b = b.select("size", "k", F.col("re").alias("bre"), F.col("im").alias("bim"))
    # the inverse transform is the conjugate's transform's conjugate by m, and only sizes are wanted
    product = a.join(b, ["size", "k"]).select(*keys, "size", "m", F.col("k").alias("n"), (F.col("re") * F.col("bre") - F.col("im") * F.col("bim")).alias("re"), (-(F.col("re") * F.col("bim") + F.col("im") * F.col("bre"))).alias("im"))
    out = fourier(product, [*keys, "size"]).where("k BETWEEN 1 AND size DIV 2")
    return out.select(*keys, "size", "k", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("m") / F.col("m")).alias("power"))


def periodogram(df: DataFrame, columns: list[str], per_day: float, bins_per_decade: int = 120, low: float = 1 / 2000, high: float = 48.0) -> DataFrame:
    """(series_id, variable, freq, power): per log bin of frequency (cycles a day) the median frequency and the largest power, by the variable's largest.

    df has a row per step of each series' grid (series_id, ts) without gaps; columns are demeaned, nulls left count as the mean. A
    constant column has no power and null shares; series of one value have no frequencies.
    """
    step = int(86_400_000_000 / per_day)
    of = df.groupBy("series_id").agg(F.min(micros(F.col("ts"))).alias("__first"), F.max(micros(F.col("ts"))).alias("__last"), *(F.avg(c).alias(f"__m_{c}") for c in columns))
    d = df.join(of, "series_id").withColumns({"__n": F.round((micros(F.col("ts")) - F.col("__first")) / step).cast("long"), "__size": F.round((F.col("__last") - F.col("__first")) / step).cast("long") + 1})
    wide = d.select("series_id", "__n", "__size", *((F.col(c) - F.col(f"__m_{c}")).alias(c) for c in columns))
    long = wide.unpivot(["series_id", "__n", "__size"], columns, "variable", "v")
    raw = power_spectrum(long, "__n", "v", "__size", ["series_id", "variable"]).withColumn("freq", F.col("k") * F.lit(float(per_day)) / F.col("size"))
    raw = raw.where(F.col("freq").between(low, high)).withColumn("bin", F.round(F.log10("freq") * bins_per_decade).cast("long"))
    g = raw.groupBy("series_id", "variable", "bin").agg(F.max("power").alias("power"), F.median("freq").alias("freq"))
    top = F.max("power").over(Window.partitionBy("series_id", "variable"))  # a few hundred bins
    return g.select("series_id", "variable", "freq", (F.col("power") / F.nullif(top, F.lit(0.0))).alias("power"))
