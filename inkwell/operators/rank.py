"""Reciprocal rank fusion with recency, and the total order of results."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.dates import is_fresh_query, is_strong_fresh_query, ranking_date, recency_bonus
from inkwell.functions.urls import canonical_url

#: Constant of the fusion, and weights of the sources; others weigh ``OTHER``.
K = 60.0
WEIGHTS = {"doubao": 1.0, "parallel": 1.0}
OTHER = 0.5


def rrf(sources: Column, weights: dict[str, float] | None = None, k: float = K, other: float = OTHER) -> Column:
    """Sum over the sources of ``weight / (k + rank)``; an empty or null map scores 0."""
    table = F.create_map(*[x for s, w in sorted((weights or WEIGHTS).items()) for x in (F.lit(s), F.lit(float(w)))])
    return F.coalesce(
        F.aggregate(
            F.array_sort(F.map_entries(sources)),
            F.lit(0.0),
            lambda acc, e: acc + F.coalesce(F.try_element_at(table, e["key"]), F.lit(float(other))) / (F.lit(float(k)) + e["value"]),
        ),
        F.lit(0.0),
    )


def rank(merged: DataFrame, questions: DataFrame, as_of: datetime.date, weights: dict[str, float] | None = None, k: float = K) -> DataFrame:
    """``merged`` with ``score`` and ``place``, the place within its query.

    Where the question asks for what is fresh, the score changes by the
    recency of the ranking day. Order: answers of a kind of their own first,
    then score, page, title. A query that is not in ``questions`` is not fresh.
    """
    fresh = questions.select(
        F.col("id").alias("query_id"),
        is_fresh_query(F.col("q"), as_of).alias("fresh"),
        is_strong_fresh_query(F.col("q"), as_of).alias("strong"),
    ).dropDuplicates(["query_id"])
    m = merged.join(fresh, "query_id", "left")
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    day = ranking_date(F.coalesce("title", F.lit("")), F.coalesce(path, F.lit("")), F.col("publish"), as_of)
    bonus = recency_bonus(day, as_of, F.coalesce("strong", F.lit(False)))
    score = rrf(F.col("sources"), weights, k) * F.when(F.coalesce("fresh", F.lit(False)), 1 + bonus).otherwise(F.lit(1.0))
    m = m.withColumn("score", score).withColumn("page", canonical_url(F.col("url")))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("ruyi", F.lit("")) == "", F.desc("score"), "page", "title", "pos")
    return m.withColumn("place", F.row_number().over(order)).drop("fresh", "strong")


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query; the limit is the feature."""
    return ranked.where(F.col("place") <= k)


def validate_scores(df: DataFrame) -> DataFrame:
    """Scores outside 0..1 or not finite, and authorities outside 1..4, become null; nothing is clamped."""
    s = F.col("rank_score")
    return df.withColumn("rank_score", F.when(~F.isnan(s) & (s >= 0) & (s <= 1), s)).withColumn(
        "authority", F.when(F.col("authority").between(1, 4), F.col("authority"))
    )
