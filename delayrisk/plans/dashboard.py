"""E5: the dashboard mart over the predictions table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import mart


def dashboard_mart(predictions: DataFrame) -> DataFrame:
    """Every prediction row in the mart's columns plus its display columns.

    The app capped this at 5,000 rows; the cap is kept as ``head_rows`` for
    a fetch, while filters, search, pages and KPIs run on all rows.
    """
    return mart.display_columns(mart.conform(predictions))
