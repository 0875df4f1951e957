"""Queries on merging and ranking of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.urls import canonical_url
from inkwell.operators.merge import merge_by_body, merge_by_url, slim
from inkwell.operators.rank import rank, rrf, top_k, validate_scores
from inkwell.plans.registry import query
from inkwell.plans.scalars import AS_OF
from inkwell.plans.sqltext import pages_cte, strip_sql
from inkwell.session import table

_HITS = f"""WITH {pages_cte("SELECT url FROM docs")},
h AS (SELECT d.query_id, d.hit_id, coalesce(d.url, '') AS url, coalesce(d.title, '') AS title, coalesce(d.body, '') AS body, d.source, d.rank,
  coalesce(p.page, '') AS page, CASE d.source WHEN 'doubao' THEN 1 WHEN 'parallel' THEN 2 ELSE 99 END AS lst
  FROM docs d LEFT JOIN pages p ON d.url = p.url WHERE coalesce(d.url, '') <> '' OR coalesce(d.title, '') <> ''),
g AS (SELECT *, CASE WHEN page = '' THEN '?' || hit_id ELSE page END AS k,
  row_number() OVER (PARTITION BY query_id, CASE WHEN page = '' THEN '?' || hit_id ELSE page END ORDER BY length(body) DESC, lst, rank, hit_id) AS best,
  row_number() OVER (PARTITION BY query_id, CASE WHEN page = '' THEN '?' || hit_id ELSE page END ORDER BY lst, rank, hit_id) AS first FROM h)"""

_BY_URL = _HITS + """,
s AS (SELECT query_id, k, source, min(rank) AS r FROM g GROUP BY ALL),
m AS (SELECT query_id, k, string_agg(source || ':' || r, ',' ORDER BY source) AS sources FROM s GROUP BY ALL),
n AS (SELECT query_id, k, count(*) AS n_hits, count(DISTINCT url) AS urls FROM g GROUP BY ALL),
r AS (SELECT g.query_id, g.k, g.url, g.title, g.body, m.sources, n.n_hits, n.urls FROM g JOIN m ON g.query_id IS NOT DISTINCT FROM m.query_id AND g.k = m.k
  JOIN n ON g.query_id IS NOT DISTINCT FROM n.query_id AND g.k = n.k WHERE g.best = 1),
f AS (SELECT query_id, k, lst, rank, hit_id FROM g WHERE first = 1)"""


def _sources_text(sources: str = "sources"):
    entries = F.array_sort(F.map_entries(sources))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


@query(
    "merge_by_url",
    _BY_URL + " SELECT query_id, url, title, md5(body) AS body_md5, sources, CAST(n_hits AS BIGINT) AS n_hits, CAST(urls - 1 AS BIGINT) AS n_also FROM r",
)
def _by_url(spark: SparkSession, d: str) -> DataFrame:
    m = merge_by_url(table(spark, d, "docs"))
    return m.select("query_id", "url", "title", F.md5("body").alias("body_md5"), _sources_text().alias("sources"), "n_hits", F.size("also_urls").cast("bigint").alias("n_also"))


@query("merge_by_url_order")
def _by_url_order(spark: SparkSession, d: str) -> DataFrame:
    m = merge_by_url(table(spark, d, "docs"))
    return m.select("query_id", "url", F.array_join("also_urls", " ").alias("also_urls"), F.to_json("images").alias("images"))


_BY_BODY = _BY_URL + f""",
c AS (SELECT r.*, f.lst, f.rank AS rk, f.hit_id, {strip_sql("title")} AS name FROM r JOIN f ON r.query_id IS NOT DISTINCT FROM f.query_id AND r.k = f.k),
b AS (SELECT *, CASE WHEN length(name) >= 8 AND length(body) >= 120 THEN name || chr(1) || body ELSE '?' || hit_id END AS ck FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id, ck ORDER BY lst, rk, hit_id) AS o, sum(n_hits) OVER (PARTITION BY query_id, ck) AS hits FROM b),
x AS (SELECT w.query_id, w.ck, e.source, min(e.r) AS r FROM w JOIN s e ON w.query_id IS NOT DISTINCT FROM e.query_id AND w.k = e.k GROUP BY ALL),
y AS (SELECT query_id, ck, string_agg(source || ':' || r, ',' ORDER BY source) AS src, sum(1.0 / (60 + r)) AS score FROM x GROUP BY ALL)"""


@query(
    "merge_by_body",
    _BY_BODY + " SELECT w.query_id, w.url, w.title, md5(w.body) AS body_md5, y.src AS sources, CAST(w.hits AS BIGINT) AS n_hits FROM w JOIN y ON w.query_id IS NOT DISTINCT FROM y.query_id AND w.ck = y.ck WHERE w.o = 1",
)
def _by_body(spark: SparkSession, d: str) -> DataFrame:
    m = merge_by_body(merge_by_url(table(spark, d, "docs")))
    return m.select("query_id", "url", "title", F.md5("body").alias("body_md5"), _sources_text().alias("sources"), "n_hits")


@query(
    "rrf_rank",
    _BY_BODY + " SELECT w.query_id, w.url, w.title, w.hit_id AS first_hit, round(y.score, 9) AS score FROM w JOIN y ON w.query_id IS NOT DISTINCT FROM y.query_id AND w.ck = y.ck WHERE w.o = 1",
)
def _rrf(spark: SparkSession, d: str) -> DataFrame:
    m = merge_by_body(merge_by_url(slim(table(spark, d, "docs"))))
    return m.select("query_id", "url", "title", F.col("pos")["hit_id"].alias("first_hit"), F.round(rrf(F.col("sources")), 9).alias("score"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    m = merge_by_body(merge_by_url(validate_scores(slim(table(spark, d, "docs")))))
    return rank(m, table(spark, d, "questions"), AS_OF)


@query("rank_recency")
def _recency(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("query_id", "place", "url", "title", "publish", F.round("score", 9).alias("score"), _sources_text().alias("sources"))


@query(
    "topk_per_group",
    """SELECT source, query_id, hit_id, k FROM (SELECT source, query_id, hit_id,
    CAST(row_number() OVER (PARTITION BY source, query_id ORDER BY rank, hit_id) AS INTEGER) AS k FROM docs) WHERE k <= 3""",
)
def _topk(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source", "query_id").orderBy("rank", "hit_id")
    return table(spark, d, "docs").select("source", "query_id", "hit_id", F.row_number().over(w).alias("k")).where("k <= 3")


@query("topk_results")
def _top(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_ranked(spark, d), 10).select("query_id", "place", "url", F.round("score", 9).alias("score"))


@query(
    "validated_scores",
    """SELECT hit_id, CASE WHEN NOT isnan(rank_score) AND rank_score >= 0 AND rank_score <= 1 THEN rank_score END AS rank_score,
    CASE WHEN authority BETWEEN 1 AND 4 THEN authority END AS authority FROM docs""",
)
def _scores(spark: SparkSession, d: str) -> DataFrame:
    return validate_scores(table(spark, d, "docs")).select("hit_id", "rank_score", "authority")


@query(
    "page_duplicates",
    f"WITH {pages_cte('SELECT url FROM docs')} SELECT p.page, count(*) AS hits, count(DISTINCT d.query_id) AS queries FROM docs d JOIN pages p ON d.url = p.url WHERE p.page <> '' GROUP BY p.page HAVING count(*) > 1",
)
def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").select(canonical_url(F.col("url")).alias("page"), "query_id").where("page <> ''")
    return docs.groupBy("page").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("query_id").alias("queries")).where("hits > 1")
