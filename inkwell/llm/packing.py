"""Problem 7: texts of varying length in containers of fixed capacity, with next to no room left.

Exact-complement hashing over lengths. How many texts there are of each length
is all that the plan needs, and no more than the capacity many lengths exist,
so the plan is made in one place however many texts there are: the longest
text opens a container, its gap is looked up among the lengths, their sums of
two and of three, and what fits exactly is consumed as often as the supplies
last; what is left over goes where it fits best. The texts are then numbered
within their length and dealt out by the plan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.tokens import with_tokens
from inkwell.session import materialize

#: About so many texts of one length are numbered in one task.
NUMBERED_AT_ONCE = 20_000


class Supplies:
    """How many texts of each length are left, with the sums of two and three looked up exactly."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.size = len(counts)
        self._index: tuple[np.ndarray, np.ndarray] | None = None
        self._age = 0

    def take(self, pattern: Counter, times: int) -> None:
        for length, k in pattern.items():
            self.left[length] -= k * times
        self._age += 1

    def _sums(self, fresh: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Which sums two and three lengths had when last indexed; supplies only shrink, so no sum is missing."""
        if self._index is None or self._age >= 64 or (fresh and self._age):
            there = (self.left > 0).astype(np.float64)
            n = 1 << (3 * self.size).bit_length()
            f = np.fft.rfft(there, n)
            pairs = np.fft.irfft(f * f, n) > 0.5
            triples = np.fft.irfft(np.fft.rfft(pairs.astype(np.float64), n) * f, n) > 0.5
            self._index = pairs[: self.size], triples[: self.size]
            self._age = 0
        return self._index

    def one(self, gap: int, used: Counter) -> list[int] | None:
        return [gap] if 0 < gap < self.size and self.left[gap] > used[gap] else None

    def two(self, gap: int, used: Counter) -> list[int] | None:
        """Two lengths that fill the gap exactly, those with the most supplies."""
        if gap < 2 or not self._sums()[0][gap]:
            return None
        low = np.arange(1, gap // 2 + 1)
        left = self.left.copy()
        for length, k in used.items():
            left[length] -= k
        there = np.minimum(left[low], left[gap - low])
        if gap % 2 == 0:
            there[-1] = left[gap // 2] // 2
        best = int(there.argmax())
        return [int(low[best]), int(gap - low[best])] if there[best] > 0 else None

    def three(self, gap: int, used: Counter, misses: int = 16) -> list[int] | None:
        """Three lengths that fill the gap exactly; all first lengths the index allows are tried.

        After ``misses`` the index is made anew, so that those it still allows
        fail by what the container holds already only.
        """
        if gap < 3:
            return None
        tried: set[int] = set()
        for fresh in (False, True):
            pairs, triples = self._sums(fresh)
            if not triples[gap]:
                return None
            first = np.arange(1, gap - 1)
            likely = first[(self.left[first] > 0) & pairs[gap - first]]
            for length in map(int, likely[np.argsort(-self.left[likely], kind="stable")]):
                if length in tried or self.left[length] <= used[length]:
                    continue
                rest = self.two(gap - length, used + Counter([length]))
                if rest:
                    return [length, *rest]
                tried.add(length)
                if not fresh and len(tried) >= misses:
                    break
            else:
                return None
        return None

    def best_fit(self, gap: int, used: Counter) -> int | None:
        """The longest text left that fits into the gap."""
        fits = np.flatnonzero(self.left[: gap + 1] > 0)
        for length in fits[::-1]:
            if self.left[length] > used[int(length)]:
                return int(length)
        return None


def plan_containers(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """``(lengths of one container, how many such containers)``, every text used once.

    ``counts[k]`` is the number of texts of length k; the capacity is the last
    index.
    """
    capacity = len(counts) - 1
    s = Supplies(counts)
    s.left[0] = 0
    plan: list[tuple[Counter, int]] = []
    top = capacity
    while True:
        while top and s.left[top] <= 0:
            top -= 1
        if not top:
            return plan
        pattern, gap = Counter([top]), capacity - top
        while gap:
            exact = s.one(gap, pattern)
            if not exact and gap <= 3 * top:  # no text is longer than the top: beyond, no three fill the gap
                exact = s.two(gap, pattern) or s.three(gap, pattern)
            if exact:
                pattern.update(exact)
                break
            length = s.best_fit(gap, pattern)
            if length is None:
                break
            # A long gap takes as many of one length as leave room for an exact end.
            some = max(1, min((gap - 2 * top) // length, int(s.left[length]) - pattern[length]) if gap > 3 * top else 1)
            pattern[length] += some
            gap -= some * length
        times = min(int(s.left[length]) // k for length, k in pattern.items())
        s.take(pattern, times)
        plan.append((pattern, times))


def _dealt(plans: dict[str, list[tuple[Counter, int]]]) -> dict[tuple[str, int], tuple[np.ndarray, ...]]:
    """For each profile and length: where each run of numbers begins, its containers' first number and their count."""
    runs: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for profile, plan in plans.items():
        used: Counter = Counter()
        first = 1
        for pattern, times in plan:
            for length, k in pattern.items():
                runs.setdefault((profile, length), []).append((used[length], first, times))
                used[length] += k * times
            first += times
    return {key: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for key, rows in runs.items()}


def pack(documents: DataFrame, budgets: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``profile, container_id, doc_id, piece_no, start_token, n_tokens``.

    Each budget's texts, each in one container of ``capacity_tokens``; a text
    above the capacity is split into pieces that fill a container, and a rest.
    Texts without tokens take no room and stand in container 0. ``budgets``
    must be few rows, which are read to the driver; a capacity that is null or
    below 1 is left out. ``sizes`` gives ``doc_id, n_tokens`` if known.
    Repeated rows are packed each; empty tables give no rows.
    """
    spark = documents.sparkSession
    sizes = materialize(sizes if sizes is not None else with_tokens(documents, ["doc_id"]), "token-sizes")
    goals = {r["profile"]: int(r["capacity_tokens"]) for r in budgets.where("capacity_tokens >= 1").collect()}
    offer = F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity")) for p, c in goals.items()])
    if not goals:
        return spark.createDataFrame([], "profile string, container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint")
    each = sizes.select("doc_id", "n_tokens", F.explode(offer).alias("g")).select("doc_id", "n_tokens", "g.*")
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    pieces = each.select("profile", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity")
    pieces = pieces.select(
        "profile", "doc_id", "piece_no", start.alias("start_token"), F.least("capacity", F.col("n_tokens") - start).alias("length")
    )
    by_length = pieces.groupBy("profile", "length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most capacity rows a profile
    plans = {}
    for profile, capacity in goals.items():
        own = by_length[by_length["profile"] == profile]
        counts = np.zeros(capacity + 1, np.int64)
        counts[own["length"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        plans[profile] = plan_containers(counts)
    dealt = spark.sparkContext.broadcast(_dealt(plans))

    # A number for each piece within its length: counted by blocks, so that a frequent length is no one task.
    total = int(by_length["n"].sum())
    blocks = max(1, total // NUMBERED_AT_ONCE)
    key = ["profile", "length", "block"]
    pieces = pieces.where("length > 0").withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("profile", "length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "piece_no"))
    numbered = pieces.withColumn("place", place).join(offsets, key).withColumn("number", F.col("before") + F.col("place") - 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = dealt.value
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for (profile, length), rows in b.groupby(["profile", "length"]).indices.items():
                begins, first, count = runs[(profile, int(length))]
                number = b["number"].to_numpy(np.int64)[rows]
                run = np.searchsorted(begins, number, side="right") - 1
                out[rows] = first[run] + (number - begins[run]) % count[run]
            yield pd.DataFrame(
                {
                    "profile": b["profile"], "container_id": out, "doc_id": b["doc_id"], "piece_no": b["piece_no"],
                    "start_token": b["start_token"], "n_tokens": b["length"],
                }
            )

    schema = "profile string, container_id bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"
    packed = numbered.select("profile", "doc_id", "piece_no", "start_token", "length", "number").mapInPandas(deal, schema)
    empty = sizes.where("n_tokens = 0").select("doc_id", F.explode(offer).alias("g"))
    empty = empty.select(
        "g.profile", F.lit(0).cast("bigint").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"),
        F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("n_tokens"),
    )
    return packed.unionByName(empty)


def fill_rates(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``profile, capacity_tokens, containers, tokens, fill_rate, least_containers``: how full the containers are."""
    filled = packed.where("container_id > 0").groupBy("profile", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    told = filled.groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    told = told.join(budgets.select("profile", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")), "profile")
    return told.select(
        "profile", "capacity_tokens", "containers", "tokens", "fullest",
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 9).alias("fill_rate"),
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
    )
