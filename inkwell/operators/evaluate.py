"""Evaluation of results: label scores, paired runs, totals of a manifest."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_noise(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Count, characters, precision and noise of each group of labels.

    Noise is stale or navigation, counted once. Rates are null for an empty
    group; null labels count as false.
    """
    flag = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("relevant", "stale", "navigation")}
    noisy: Column = flag["stale"] | flag["navigation"] | ~flag["relevant"]
    n, chars = F.count(F.lit(1)), F.sum("visible_chars")

    def share(c: Column) -> Column:
        return F.round(F.sum(c.cast("int")) / F.nullif(F.count(F.lit(1)), F.lit(0)), 9)

    return labels.groupBy(*keys).agg(
        n.alias("n"), chars.alias("chars"), share(flag["relevant"]).alias("precision"), share(noisy).alias("noise_rate"),
        F.round(F.sum(F.when(noisy, F.col("visible_chars")).otherwise(0)) / F.nullif(chars, F.lit(0)), 9).alias("noisy_char_share"),
        F.sum(flag["stale"].cast("int")).alias("stale"), F.sum(flag["navigation"].cast("int")).alias("navigation"),
    )


def invalid_labels(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Labels that cannot be scored, with why: unknown id, repeated id, no characters."""
    seen = labels.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.max("visible_chars").alias("visible_chars"))
    got = seen.join(known.select(F.col("id"), F.lit(True).alias("known")).distinct(), "id", "left")
    why = (
        F.when(F.col("known").isNull(), "unknown id")
        .when(F.col("times") > 1, "repeated id")
        .when(F.coalesce(F.col("visible_chars"), F.lit(0)) <= 0, "no characters")
    )
    return got.select("id", why.alias("why")).where("why is not null")


def ab_pairs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Baseline and candidate side by side: what both have, and win, tie or loss of the candidate."""
    both = a.select(key, F.col(value).alias("baseline")).join(b.select(key, F.col(value).alias("candidate")), key)
    outcome = F.when(F.col("candidate") > F.col("baseline"), "win").when(F.col("candidate") < F.col("baseline"), "loss").otherwise("tie")
    return both.withColumn("outcome", outcome)


def manifest_sums(runs: DataFrame, keys: list[str], size: str, seconds: str) -> DataFrame:
    """``keys, runs, results, seconds``: totals of a manifest's runs; null sizes and times count nothing."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.col(size).cast("bigint")).alias("results"), F.round(F.sum(seconds), 6).alias("seconds")
    )


def replay(responses: DataFrame, run, as_of: datetime.date, versions: dict[str, dict]) -> DataFrame:
    """Recorded responses run through the pipeline once for each version, the day held fixed.

    ``run(responses, as_of=..., **options)`` gives a DataFrame; the results of
    all versions stand below each other, named by ``version``.
    """
    out = None
    for name, options in versions.items():
        part = run(responses, as_of=as_of, **options).withColumn("version", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
