"""A lookup join that does not suffer from keys which hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more than this many keys can each hold more than 1/HOT_KEYS of the rows,
#: which bounds what is broadcast.
HOT_KEYS = 500


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    count: str,
    total: int,
    spread: str,
    least: int = 20_000,
    twice: bool = False,
) -> DataFrame:
    """``rows`` left-joined to ``lookup``, which has one row per key.

    ``count`` names the column of ``lookup`` with the number of rows that hold
    the key, ``total`` the number of all rows. Keys held by more than
    ``total / HOT_KEYS`` rows are at most ``HOT_KEYS``: these entries are
    broadcast. The others are joined by key, each with a bounded number of
    rows. Rows of hot keys, which need nothing more from that join, pass it
    spread evenly by the column ``spread``; with ``twice`` they do not move at
    all, and ``rows`` is computed once for them and once for the others.

    Null keys match nothing. An empty side gives its columns as null.
    """
    payload = [c for c in lookup.columns if c not in keys and c != count]
    at_most = max(total / HOT_KEYS, least)
    packed = F.struct(*[F.col(c) for c in payload]) if payload else F.struct(F.lit(1).alias("_"))
    hot = lookup.where(F.col(count) > at_most).select(*keys, packed.alias("_hot"))
    cold = lookup.where(F.col(count) <= at_most).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.lit(0).alias("_salt"), packed.alias("_cold")
    )
    if twice:
        near = rows.join(F.broadcast(hot), keys)
        far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
        far = far.join(cold.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "_cold"), keys, "left")
        parts = [(near, "_hot"), (far, "_cold")]
        near, far = (df.select(*rows.columns, *[F.col(c)[x].alias(x) for x in payload]) for df, c in parts)
        return near.unionByName(far)
    step = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(F.col(spread)), F.lit(1 << 20))).otherwise(F.lit(0)).cast("int"),
    )
    on = step["_salt"] == cold["_salt"]
    for i, k in enumerate(keys):
        on = on & (step[k] == cold[f"_k{i}"])
    joined = step.join(cold, on, "left")
    got = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*[rows[c] for c in rows.columns], *[got[c].alias(c) for c in payload])
