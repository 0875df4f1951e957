"""Joins that the pipelines need beside the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_lookup(asks: DataFrame, entries: DataFrame, key: str, at: str, written: str, ttl_seconds: float, value: str) -> DataFrame:
    """Each ask with the latest entry of its key not older than the time to live at that moment; null if none.

    Asks and entries are read in one order per key, so no pair of rows is made.
    An entry of the very moment counts. ``asks`` keeps its columns; the entry
    gives ``found`` and ``found_at``.
    """
    a = asks.select("*", F.col(at).alias("_t"), F.lit(1).alias("_ask"), F.lit(None).cast(entries.schema[value].dataType).alias("_v"))
    e = entries.select(key, F.col(written).alias("_t"), F.lit(0).alias("_ask"), F.struct(F.col(written).alias("t"), F.col(value).alias("v")).alias("_e"))
    both = a.drop("_v").unionByName(e, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = both.withColumn("_last", F.last("_e", ignorenulls=True).over(w)).where("_ask = 1")
    fresh = F.unix_micros("_t") - F.unix_micros(F.col("_last")["t"]) <= F.lit(int(ttl_seconds * 1_000_000))
    return last.select(
        *[F.col(c) for c in asks.columns],
        F.when(fresh, F.col("_last")["v"]).alias("found"),
        F.when(fresh, F.col("_last")["t"]).alias("found_at"),
    )


def not_skipped(rules: DataFrame, skips: DataFrame, rule: str, skip: str, genre: str) -> DataFrame:
    """Pairs of genre and rule that the genre does not skip, by id or by base id before an underscore.

    Both sides are dimension tables; the ids split at underscores give the
    keys of an equality join.
    """
    parts = F.split(F.col(rule), "_")
    bases = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    keyed = rules.withColumn("_base", F.explode(bases))
    dropped = keyed.join(skips.select(genre, F.col(skip).alias("_base")), [genre, "_base"]).select(genre, rule).distinct()
    return rules.join(dropped, [genre, rule], "left_anti")


def outside_spans(hits: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Hits that lie inside none of their text's spans, decided inside each text's row.

    ``hits`` has ``start, end`` and ``spans`` an array of ``start, end``, one
    row per key.
    """
    got = hits.join(spans.select(key, F.col("spans").alias("_spans")), key, "left")
    inside: Column = F.exists("_spans", lambda s: (s["start"] <= F.col("start")) & (F.col("end") <= s["end"]))
    return got.where(~F.coalesce(inside, F.lit(False))).drop("_spans")


def longest_run(df: DataFrame, keys: list[str], order: str, flag: Column, block: int = 100_000) -> DataFrame:
    """``keys, run_start, run_length`` of the runs of neighbouring rows whose flag holds.

    ``order`` is a number, unique within ``keys``; a null flag does not hold.
    Runs are found in blocks of its values, so that a key with a large part of
    all rows is many tasks; those that reach a block's edge are then joined
    over the blocks, of which there are few.
    """
    cut = df.select(*keys, F.col(order).alias("_o"), F.coalesce(flag, F.lit(False)).alias("_f"), F.floor(F.col(order) / F.lit(block)).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy("_o")
    placed = cut.withColumn("_k", F.row_number().over(w)).withColumn("_g", F.col("_k") - F.sum(F.col("_f").cast("int")).over(w))
    placed = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_b")))
    runs = placed.groupBy(*keys, "_b", "_n", F.when(F.col("_f"), F.col("_g")).alias("_g")).agg(
        F.min("_o").alias("start"), F.count(F.lit(1)).alias("size"), (F.min("_k") == 1).alias("head"), (F.max("_k") == F.col("_n")).alias("tail")
    )
    held = F.col("_g").isNotNull()
    inner = runs.where(held & ~F.col("head") & ~F.col("tail")).select(*keys, F.col("start").alias("run_start"), F.col("size").alias("run_length"))
    # Each block's first and last run; a block without any breaks what goes on over it.
    piece = F.when(held & (F.col("head") | F.col("tail")), F.struct("start", "size", "head", "tail"))
    edges = runs.groupBy(*keys, "_b").agg(F.array_sort(F.array_compact(F.collect_list(piece))).alias("p"), F.max(held & F.col("tail")).alias("open"))
    edges = edges.withColumn("_before", F.lag("open").over(Window.partitionBy(*keys).orderBy("_b")))
    parts = edges.select(*keys, "_before", F.explode("p").alias("p"))
    new = (~(F.col("p")["head"] & F.coalesce("_before", F.lit(False)))).cast("int")
    chained = parts.withColumn("_c", F.sum(new).over(Window.partitionBy(*keys).orderBy(F.col("p")["start"])))
    joined = chained.groupBy(*keys, "_c").agg(F.min(F.col("p")["start"]).alias("run_start"), F.sum(F.col("p")["size"]).alias("run_length")).drop("_c")
    return inner.unionByName(joined)
