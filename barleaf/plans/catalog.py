"""All registered queries; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barleaf.plans import (  # noqa: F401
    decision_queries,
    event_queries,
    forecast_queries,
    learned_queries,
    nonlinear_queries,
    price_queries,
    rule_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from barleaf.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["evaluate_momentum_rotation"](spark, folder)
