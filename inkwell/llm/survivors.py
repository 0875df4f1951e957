"""Problem 4: one surviving record per page, with the best value of each field.

Field-by-field survivorship by aggregation alone: each field takes the maximum
of a composite struct (known or not, trust in its source, time of the record,
smaller id first, value), or, for the ids of the longest body and the latest
day, of (known or not, how good, smaller id first). The records are first aggregated by page and source, so that a page which holds a
large part of all rows is reduced before it meets in one task, and no list of
its records is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.urls import SPACE, canonical_url, strip

_DAY_US = 86_400_000_000


def visible_length(text: Column) -> Column:
    """Characters that are not Unicode white space; null counts 0."""
    return F.coalesce(F.char_length(F.regexp_replace(text, SPACE, "")), F.lit(0))


def valid_day(publish: Column, merged_at: Column) -> Column:
    """The first ten characters of ``publish`` if they are a real day not after the UTC day of ``merged_at``; else null."""
    text = F.substring(publish, 1, 10)
    day = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (text >= "0001"), text.try_cast("date"))
    last = F.floor(F.unix_micros(merged_at) / F.lit(_DAY_US))
    return F.when(F.unix_date(day) <= last, text)


def _best(known: Column, *order: Column, value: Column) -> Column:
    names = [f"o{i}" for i in range(len(order))]
    return F.struct(known.alias("known"), *[o.alias(n) for o, n in zip(order, names, strict=True)], value.alias("value"))


def source_priority(sources: Column, order: tuple[str, ...]) -> Column:
    """The greatest trust in one of a record's sources: the first of ``order`` most, others and none 0."""
    table = F.create_map(*[x for k, s in enumerate(order) for x in (F.lit(s), F.lit(len(order) - k))]) if order else None
    known = F.lit(0) if table is None else F.array_max(F.transform(F.map_keys(sources), lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0))))
    return F.coalesce(known, F.lit(0))


def survivors(merged: DataFrame, with_values: bool = False, order: tuple[str, ...] = ("parallel", "doubao")) -> DataFrame:
    """One row per query and page with two or more records of ``merged``.

    ``group_id`` is the smallest id; ``body_id`` the record with the most
    visible characters; ``publish_id`` the record with the latest valid day, 0
    if none has one; ``sources_key`` every source with its least rank from 1
    up, as ``name:rank`` sorted by name, empty if none. Ties go to the
    smallest id. ``with_values`` adds query and page, and the surviving body,
    publish, title and authority: of the values that are known (a body with a
    visible character, a valid day), that of the record whose best source comes
    first in ``order``, of these the one merged last, then the smallest id.

    Records with a null or blank url belong to no page. A null query is one
    query. A row repeated under one id is one record. Extra columns are
    ignored; an empty table gives no rows.
    """
    m = merged.where(strip(F.col("url")) != "")
    day = valid_day(F.col("publish"), F.col("merged_at"))
    size = visible_length(F.col("body"))
    id_ = F.col("merged_id")
    none = F.lit(None).cast("string")
    trust, at = source_priority(F.col("sources"), order), F.coalesce(F.unix_micros("merged_at"), F.lit(-(1 << 62)))

    def chosen(known: Column, value: str) -> Column:
        """The value that survives in a field."""
        return _best(F.coalesce(known, F.lit(False)), trust, at, -id_, value=F.col(value)).alias("best_" + value)

    values = [
        chosen(size > 0, "body"), chosen(day.isNotNull(), "publish"),
        chosen(strip(F.col("title")) != "", "title"), chosen(F.col("authority").isNotNull(), "authority"),
    ] if with_values else []
    best = ["best_body", "best_publish", "best_title", "best_authority"] if with_values else []
    base = m.select(
        F.coalesce("query_id", F.lit("\x00")).alias("q"),
        canonical_url(F.col("url")).alias("page"),
        id_.alias("id"),
        _best(size > 0, size, -id_, value=none).alias("body"),
        _best(day.isNotNull(), day, -id_, value=none).alias("publish"),
        *values,
        "sources",
    )
    base = base.select("q", "page", "id", "body", "publish", *best, F.explode_outer("sources").alias("source", "rank"))
    fields = [F.max(c).alias(c) for c in ("body", "publish", *best)]
    first = base.groupBy("q", "page", "source").agg(
        *fields,
        F.min(F.when(F.col("rank") >= 1, F.col("rank"))).alias("rank"),
        F.min("id").alias("low"),
        F.max("id").alias("high"),
    )
    known = F.when(
        F.col("source").isNotNull() & F.col("rank").isNotNull(),
        F.concat("source", F.lit(":"), F.col("rank").cast("string")),
    )
    entry = F.when(known.isNotNull(), F.struct(F.col("source"), known.alias("text")))
    groups = (
        first.groupBy("q", "page")
        .agg(
            *fields,
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), ",").alias("sources_key"),
        )
        .where("low < high")
    )
    out = [
        F.col("low").alias("group_id"),
        (-F.col("body")["o1"]).alias("body_id"),
        F.when(F.col("publish")["known"], -F.col("publish")["o1"]).otherwise(F.lit(0)).cast("bigint").alias("publish_id"),
        "sources_key",
    ]
    if with_values:
        out += [F.when(F.col("q") != "\x00", F.col("q")).alias("query_id"), "page"]
        out += [F.when(F.col(c)["known"], F.col(c)["value"]).alias(c.removeprefix("best_")) for c in best]
    return groups.select(*out)
