"""Problem 8: sources mixed to target shares of all tokens, small sources repeated a capped number of times.

Cube-method balanced sampling. What a source must give, as a multiple of what
it has, is a whole number of copies of all its texts and a fraction: each text
is included once more with that probability. The probabilities move through
the null space of the constraints, which keeps the expected tokens and texts
of the source as they are, until all but two are 0 or 1. Blocks of texts do
this at the same time; what they leave meets again in fewer blocks, until one
block a source is left. There the flight ends with a dozen texts open, and the
landing looks through all ways to decide them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.tokens import with_tokens
from inkwell.session import materialize

#: Texts that one task moves at a time.
BLOCK = 20_000
#: Texts of a source that the landing decides together, in 2 ** LAST ways.
LAST = 12
_EPS = 1e-9


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, keep: int = 2) -> np.ndarray:
    """The flight phase: probabilities with the same sums of texts and tokens, all but ``keep`` at most 0 or 1."""
    p = prob.astype(float).copy()
    t = size.astype(float)
    open_ = [int(k) for k in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))]
    draws = rng.random(len(open_) + 8)
    draw = 0
    at = min(3, len(open_))
    held = open_[:at]
    while len(held) == 3 and 3 + len(open_) - at > keep:
        a, b, c = held
        u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for k, v in zip(held, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        move = up if draws[draw % len(draws)] * (up + down) < down else -down
        draw += 1
        for k, v in zip(held, u, strict=True):
            p[k] += move * v
            if p[k] < _EPS:
                p[k] = 0.0
            elif p[k] > 1 - _EPS:
                p[k] = 1.0
        held = [k for k in held if 0 < p[k] < 1]
        while len(held) < 3 and at < len(open_):
            held.append(open_[at])
            at += 1
    return p


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The landing phase: of all ways to decide the last texts, that which changes the tokens least, then the texts."""
    p = prob.copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1).astype(float)
    tokens = np.abs((ways - p[rest]) @ size[rest].astype(float))
    texts = np.abs((ways - p[rest]).sum(axis=1))
    p[rest] = ways[np.lexsort((texts, np.round(tokens, 6)))[0]]
    return p


_STATE = "doc_id bigint, source string, n_tokens bigint, prob double, row_key bigint"


def _round(state: DataFrame, blocks: DataFrame, seed: int, final: bool) -> DataFrame:
    """One round of flights, in the blocks of each source; ``final`` also lands."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["row_key", "doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, len(block), int(block["n_tokens"].sum())])
        size = block["n_tokens"].to_numpy(float)
        p = fly(block["prob"].to_numpy(float), size, rng, LAST if final else 2)
        return block.drop(columns="block").assign(prob=land(p, size) if final else p)

    dealt = state.join(blocks, "source").withColumn("block", F.pmod(F.xxhash64("row_key"), F.col("blocks"))).drop("blocks")
    return dealt.groupBy("source", "block").applyInPandas(run, _STATE)


def plan_shares(supply: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, tokens, docs, want, copies, fraction``: what each source gives, the mix as large as the caps allow.

    Sources without tokens give nothing, and the other shares keep their
    proportions; targets that are null or not above 0 are left out.
    """
    t = targets.where("target_share > 0").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    both = t.join(supply, "source").where("tokens > 0 and max_repeats >= 1")
    total = both.agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("total"))
    # One row, read once: the size of the whole mix.
    size = total.first()["total"] or 0.0
    times = F.lit(size) * F.col("target_share") / F.col("tokens")
    times = F.least(times, F.col("max_repeats").cast("double"))
    copies = F.floor(times + F.lit(1e-9))
    return both.select(
        "source", "target_share", "max_repeats", "tokens", "docs", (times * F.col("tokens")).alias("want"),
        copies.cast("int").alias("copies"), F.greatest(times - copies, F.lit(0.0)).alias("fraction"),
    )


def mix(documents: DataFrame, targets: DataFrame, sizes: DataFrame | None = None, seed: int = 11) -> DataFrame:
    """``doc_id, source, n_tokens, copies``: how often each text stands in the mix; 0 is left out.

    The mix is as large as the sources and their ``max_repeats`` allow; each
    source's tokens are as near to its share as the last ``LAST`` texts allow. Texts of sources without
    a target or without a source, and texts without tokens, take no part. A
    repeated row takes part each time. Empty tables give no rows. The same
    texts give the same mix.
    """
    sizes = sizes if sizes is not None else with_tokens(documents, ["doc_id", "source"])
    sizes = materialize(sizes.where("n_tokens > 0 and source is not null"), "mix-sizes")
    supply = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = materialize(plan_shares(supply, targets), "mix-plan")
    rows = sizes.join(plan.select("source", "copies", "fraction"), "source")
    state = rows.where("fraction > 1e-9").select(
        "doc_id", "source", "n_tokens", F.col("fraction").alias("prob"), F.xxhash64("doc_id", "n_tokens").alias("row_key")
    )
    largest = plan.where("fraction > 1e-9").agg(F.max("docs").alias("docs")).first()["docs"] or 0
    settled = []
    while largest:
        final = largest <= BLOCK
        blocks = plan.select("source", F.greatest(F.ceil(F.col("docs") / BLOCK), F.lit(1)).alias("blocks"))
        if not final and settled:
            blocks = plan.select("source", F.lit(-(-largest // BLOCK)).alias("blocks"))
        if final:
            blocks = plan.select("source", F.lit(1).alias("blocks"))
        state = materialize(_round(state, blocks, seed + len(settled), final), "mix-round")
        settled.append(state.where("prob = 1"))
        if final:
            break
        state = state.where("prob > 0 and prob < 1")
        largest = state.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    once = rows.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    for part in settled:
        once = once.unionByName(part.select("doc_id", "source", "n_tokens", F.lit(1).alias("copies")))
    return once.groupBy("doc_id", "source", "n_tokens").agg(F.sum("copies").alias("copies"))


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, tokens, texts, most_copies, share``: the shares the mix has."""
    own = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("texts"), F.max("copies").alias("most_copies")
    )
    whole = own.agg(F.sum("tokens").alias("all_tokens"))
    got = targets.select("source", "target_share").join(own, "source", "left").join(F.broadcast(whole))  # one row
    return got.select(
        "source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.col("all_tokens"), 9).alias("share"),
    )
