"""Exact merging of ranked hits: by page, then by content. Variants that differ are never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.urls import canonical_url, site_of, strip

#: Content merges only with a title and a body of this length.
LEAST_TITLE, LEAST_BODY = 8, 120
#: Fields that change together with the representative.
FIELDS = ("url", "title", "body", "site", "publish", "authority", "rank_score", "ruyi", "body_source")
#: Sources in the order in which their lists are appended.
SOURCE_ORDER = ("doubao", "parallel")


def union_sources(*lists: DataFrame) -> DataFrame:
    """Lists one after the other, each row with ``source_pos``, the place of its list."""
    out = None
    for k, df in enumerate(lists):
        part = df.withColumn("source_pos", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _position() -> Column:
    """Place of a hit within its query: list, rank, id."""
    place = F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), F.col("source"))
    return F.struct(F.when(place > 0, place).otherwise(F.lit(99)).alias("list"), "rank", "hit_id")


def _min_ranks(entries: Column) -> Column:
    """``array<struct<source,rank>>`` as a map of least ranks, sorted by source."""
    low = F.aggregate(
        F.array_sort(entries),
        F.expr("cast(array() as array<struct<source:string,rank:int>>)"),
        lambda acc, e: F.when(F.exists(acc, lambda a: a["source"] == e["source"]), acc).otherwise(F.concat(acc, F.array(e))),
    )
    return F.map_from_entries(low)


def slim(docs: DataFrame) -> DataFrame:
    """``docs`` with the size, the hash and the hit of each body in place of its text.

    Merging and ranking need no more of a body; the texts of the results that
    are shown are fetched by ``with_bodies`` afterwards.
    """
    body = F.coalesce("body", F.lit(""))
    return docs.withColumn("body", F.struct(F.char_length(body).alias("size"), F.sha2(body, 256).alias("key"), F.col("hit_id").alias("hit")))


def with_bodies(merged: DataFrame, docs: DataFrame) -> DataFrame:
    """Results of slim hits with the texts of their bodies; a hit that stands in ``docs`` twice gives its row twice."""
    texts = docs.select(F.col("hit_id").alias("_hit"), F.coalesce("body", F.lit("")).alias("_text"))
    got = merged.join(texts, F.col("body.hit") == F.col("_hit"), "left")
    return got.withColumn("body", F.coalesce("_text", F.lit(""))).drop("_hit", "_text")


def _is_slim(df: DataFrame) -> bool:
    return df.schema["body"].dataType.typeName() == "struct"


def merge_by_url(docs: DataFrame) -> DataFrame:
    """One row per query and page; ``docs`` may be ``slim``.

    The longest body represents the page, the first of equals; ``url`` to
    ``body_source`` are its. ``sources`` has each source's least rank,
    ``images`` the distinct images in order, ``also_urls`` the other
    addresses: earlier representatives last first, then as they came. Hits
    without url and title are dropped; hits without a page stay single.
    Null texts count as empty. ``pos`` is the place of the first hit.
    """
    url, title = (F.coalesce(c, F.lit("")) for c in ("url", "title"))
    light = _is_slim(docs)
    body = F.col("body") if light else F.coalesce("body", F.lit(""))
    d = docs.select(
        "query_id", "hit_id", url.alias("url"), title.alias("title"), body.alias("body"),
        site_of(F.col("site"), F.col("url")).alias("site"), "source", "rank", "publish", "authority", "rank_score",
        F.coalesce("images", F.array().cast(docs.schema["images"].dataType)).alias("images"),
        F.get(F.map_values(F.map_filter("extra", lambda k, v: k == "ruyi")), F.lit(0)).alias("ruyi"),
    ).where("url <> '' or title <> ''")
    d = d.withColumn("page", canonical_url(F.col("url"))).withColumn("pos", _position())
    d = d.withColumn("key", F.when(F.col("page") == "", F.concat(F.lit("\x00"), F.col("hit_id").cast("string"))).otherwise(F.col("page")))
    keys = ["query_id", "key"]
    order = Window.partitionBy(*keys).orderBy("pos")
    size = F.col("body.size") if light else F.char_length("body")
    d = d.withColumn("top", F.max(size).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("switch", (F.col("top") < size) & F.col("top").isNotNull())
    d = d.withColumn("new", F.row_number().over(Window.partitionBy(*keys, "url").orderBy("pos")) == 1)
    record = F.struct(
        size.alias("size"), (-F.col("pos")["list"]).alias("a"), (-F.col("rank")).alias("b"), (-F.col("hit_id")).alias("c"),
        F.struct(*[F.col("source").alias("body_source") if c == "body_source" else F.col(c) for c in FIELDS]).alias("fields"),
    )
    marked = F.when(F.col("new") | F.col("switch"), F.struct("pos", "url", "switch"))
    pictured = F.when(F.size("images") > 0, F.struct("pos", "images"))
    grouped = d.groupBy(*keys).agg(
        F.max(record)["fields"].alias("f"),
        F.min("pos").alias("pos"),
        F.count(F.lit(1)).alias("n_hits"),
        F.collect_set(F.struct("source", "rank")).alias("ranks"),
        F.array_sort(F.collect_list(marked)).alias("steps"),
        F.array_sort(F.collect_set(pictured)).alias("pictures"),
    )
    seen = F.aggregate(
        "steps",
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(F.size(acc) == 0, F.array(s["url"]))
        .when(s["switch"], F.array_distinct(F.concat(F.array(s["url"]), acc)))
        .otherwise(F.array_distinct(F.concat(acc, F.array(s["url"])))),
    )
    return grouped.select(
        "query_id", *[F.col("f")[c].alias(c) for c in FIELDS], _min_ranks(F.col("ranks")).alias("sources"),
        F.filter(seen, lambda u: (u != "") & (u != F.col("f")["url"])).alias("also_urls"),
        F.array_distinct(F.flatten(F.transform("pictures", lambda p: p["images"]))).alias("images"), "pos", "n_hits",
    )


def merge_by_body(merged: DataFrame) -> DataFrame:
    """Pages of one query with the same stripped title and the very same body, as the earliest of them.

    Only titles of 8 and bodies of 120 characters or more merge. Runs after
    ``merge_by_url``: its aggregation ends before this one begins, so a later
    representative cannot take away a body that merged here.
    """
    name = strip(F.col("title"))
    light = _is_slim(merged)
    size, text = (F.col("body.size"), F.col("body.key")) if light else (F.char_length("body"), F.col("body"))
    fit = (F.char_length(name) >= LEAST_TITLE) & (size >= LEAST_BODY)
    own = F.sha2(F.to_json(F.struct("query_id", "pos")), 256)
    m = merged.withColumn("key", F.when(fit, F.sha2(F.concat_ws("\x00", name, text), 256)).otherwise(own))
    keep = [*FIELDS, "also_urls", "images"]
    grouped = m.groupBy("query_id", "key").agg(
        F.min_by(F.struct(*keep), "pos").alias("f"),
        F.min("pos").alias("pos"),
        F.sum("n_hits").alias("n_hits"),
        F.flatten(F.collect_list(F.transform(F.map_entries("sources"), lambda e: F.struct(e["key"].alias("source"), e["value"].alias("rank"))))).alias("ranks"),
        F.array_sort(F.collect_list(F.struct("pos", F.concat(F.array("url"), "also_urls").alias("urls"), "images"))).alias("parts"),
    )
    urls = F.array_distinct(F.concat(F.col("f")["also_urls"], F.flatten(F.transform("parts", lambda p: p["urls"]))))
    return grouped.select(
        "query_id", *[F.col("f")[c].alias(c) for c in FIELDS], _min_ranks(F.col("ranks")).alias("sources"),
        F.filter(urls, lambda u: (u != "") & (u != F.col("f")["url"])).alias("also_urls"),
        F.array_distinct(F.flatten(F.transform("parts", lambda p: p["images"]))).alias("images"), "pos", "n_hits",
    )
