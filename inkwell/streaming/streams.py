"""Streams of events: duplicates, windows, sessions, recency, with a watermark for what comes late."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import shared_dir


def deduplicate(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Each key once within the time to live."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Count and sum of each window and key; rows later than ``late`` are dropped."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Visits of each key: events not further apart than the gap."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def decayed(stream: DataFrame, ts: str, late: str, keys: list[str], value: str, as_of: Column, half_life_days: float = 30.0) -> DataFrame:
    """Sum of values that halve with age, by day."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("window.start"))) / F.lit(86_400_000_000)
    daily = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), *keys).agg(F.sum(value).alias("total"))
    return daily.select(F.col("window.start").alias("day"), *keys, (F.col("total") * F.pow(F.lit(2.0), -age / F.lit(half_life_days))).alias("decayed"))


def union_streams(*streams: DataFrame) -> DataFrame:
    """Sources one beside the other; one that is silent does not stop the rest."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path) if os.path.isdir(path) else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder.

    State and output lie in the shared folder, so the run goes on after a loss.
    The last batch closes no window; windows that the watermark has not passed
    are not given.
    """
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"inkwell-stream-{uuid.uuid4().hex}")
    schema = stream.schema
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")
