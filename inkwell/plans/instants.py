"""Problem 5: moments of publication, in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.urls import site_of
from inkwell.operators.instants import normalize_instants
from inkwell.plans.registry import query
from inkwell.session import table


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hit_id, publish_us`` of every hit whose ``publish`` names one day or moment."""
    docs = table(spark, sf_dir, "docs")
    return normalize_instants(
        docs,
        "hit_id",
        F.col("publish"),
        site_of(F.col("site"), F.col("url")),
        F.col("fetched_at"),
        table(spark, sf_dir, "sites"),
        docs.count(),
    )
