"""All registered queries and their SQL."""

from __future__ import annotations

from . import attributions, backtests, forecasts, learners, routes, series, sheets, tables, validation  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
