"""Result cache with time to live, request keys, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_key(*parts: Column) -> Column:
    """32 digits of a request's canonical form; the order of arrays counts, the session does not."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)


#: Parts of a request that do not change its answer.
NO_PART = ("session_id", "transport", "block_hosts")


def fingerprint_of(source: Column, request: Column) -> Column:
    """``cache_key`` of a request in JSON: by its members in order of name, without those that do not change its answer."""
    members = F.map_filter(F.from_json(request, "map<string,string>"), lambda k, v: ~k.isin(*NO_PART))
    return cache_key(source.alias("source"), F.map_from_entries(F.array_sort(F.map_entries(members))).alias("request"))


def fresh_entries(cache: DataFrame, written: str, as_of: Column, ttl_seconds: float) -> DataFrame:
    """Entries younger than the time to live at ``as_of``; a null time is expired."""
    return cache.where(F.unix_micros(as_of) - F.unix_micros(F.col(written)) < F.lit(int(ttl_seconds * 1_000_000)))


def put(cache: DataFrame, new: DataFrame, key: str, written: str) -> DataFrame:
    """The cache with new entries in place of older ones of their key."""
    both = cache.unionByName(new)
    names = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max(F.struct(F.col(written).alias("_w"), F.struct(*names).alias("_r"))).alias("m")).select(key, "m._r.*")


def keep_newest(df: DataFrame, keys: list[str], order: str, tie: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each group; 0 or less keeps all."""
    if keep <= 0:
        return df
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")


def session_of(sent: Column, cached: Column, generated: Column, held: Column) -> Column:
    """The generated session if a request was sent, the held one on a cache hit, else null."""
    return F.when(sent & ~F.coalesce(cached, F.lit(False)), generated).when(cached, held)
