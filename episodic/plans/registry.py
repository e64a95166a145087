"""Where queries and their SQL are registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*uses: str, sql: str | None = None) -> Callable:
    """Register a function of the named views or tables under its own name, with the SQL that follows their CTEs."""

    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(*(view(spark, sf_dir, u) for u in uses))
        if sql:
            from .views import VIEWS

            named = [u for u in uses if u in VIEWS]
            body = sql.strip().replace(", 5)", f" + {OFF_TIES}, 5)")
            SQL[fn.__name__] = (ctes(*named) + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)) if named else body
        return fn

    return register


#: Added before rounding on both sides, as sums of cents often end halfway between two rounded values.
OFF_TIES = 1.234e-8


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles rounded, for comparison; negative zero is zero."""
    return df.select(*((F.round(F.col(c) + F.lit(OFF_TIES if digits == 5 else 0.0), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
