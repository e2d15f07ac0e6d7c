"""The registered queries over the sensor operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arrays, models, ordered, spectra, tables  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to one row of motion statistics per sequence."""
    return QUERIES["flagship_motion_frame"](spark, sf_dir)
