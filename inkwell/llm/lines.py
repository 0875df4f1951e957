"""Problem 6: lines that one site repeats over its documents, found and removed.

Prefix growth (PrefixSpan) over the sequences of line identifiers of each
site: a sequence is frequent if at least a share of the site's rows and some
number of different pages hold it. Each frequent sequence is extended by the
lines that follow it, until none is frequent; occurrences of frequent sequences, single lines
included, are removed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.urls import SPACE, canonical_url, site_of, strip
from inkwell.operators.skew import lookup_join
from inkwell.session import materialize


def line_key(line: Column) -> Column:
    """What counts of a line: without white space, letter case and the digits 0-9."""
    return F.lower(F.regexp_replace(line, SPACE[:-1] + "0-9]", ""))


def line_id(line: Column) -> Column:
    """128 bits of a line's key, as a string of 16 bytes; null for a line without any letter."""

    def of(key: Column) -> Column:
        return F.when(
            key.rlike(r"\p{L}"), F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(29), key).alias("b"))
        )

    return F.element_at(F.transform(F.array(line_key(line)), of), 1)


def sited(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """``hit_id, site, page, body`` of the rows whose site is in ``sites``; page is null where the url is blank."""
    known = sites.select(F.col("site").alias("_site")).dropDuplicates()
    page = F.when(strip(F.col("url")) != "", F.xxhash64(canonical_url(F.col("url"))))
    rows = docs.select("hit_id", site_of(F.col("site"), F.col("url")).alias("_site"), page.alias("page"), "body")
    return rows.join(known, "_site").withColumnRenamed("_site", "site")


def numbered_lines(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """``hit_id, site, page, ids`` of the rows of known sites: the identifier of each line, null for one without letters.

    Written once; everything after reads no text again. A null body has no ``ids``.
    """
    rows = sited(docs, sites)
    return materialize(rows.select("hit_id", "site", "page", F.transform(F.split("body", "\n"), line_id).alias("ids")), "line-ids")


def _supported(level: DataFrame, keys: list[str], exact: DataFrame, share: float, pages: int) -> DataFrame:
    """Those of ``level`` that enough rows and pages hold.

    ``level`` has ``rows``, ``site_rows`` and ``bits``, 63 bits set by page: as
    many bits, at least as many pages. Only where few bits are set are the
    pages of ``exact`` counted one by one.
    """
    often = level.where(F.col("rows") >= F.col("site_rows") * F.lit(share) - F.lit(1e-9))
    sure = often.where(F.bit_count("bits") >= pages)
    few = often.where(F.bit_count("bits") < pages)
    counted = (
        exact.where(F.col("page").isNotNull())
        .join(few.select(*keys), keys, "left_semi")
        .groupBy(*keys, "page")
        .agg(F.lit(1).alias("one"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .where(F.col("n_pages") >= pages)
    )
    return sure.unionByName(few.join(counted.select(*keys), keys))


def _grown(
    patterns: list[tuple[list[int], int, frozenset]], first: int, least: float, pages: int, longest: int | None
) -> Iterator[tuple[list[int], int]]:
    """The frequent sequences of two items and more that start with ``first``, with their rows.

    ``patterns`` are sequences with their rows and up to ``pages`` of their
    pages. What follows the first occurrence of a prefix decides how it grows.
    """
    open_ = [([first], [(p, p.index(first) + 1, n, held) for p, n, held in patterns])]
    while open_:
        prefix, rest = open_.pop()
        if len(prefix) == longest:
            continue
        rows: dict[int, int] = {}
        for p, at, n, _ in rest:
            for item in set(p[at:]):
                rows[item] = rows.get(item, 0) + n
        for item, n in rows.items():
            if n < least:
                continue
            after = [(p, p.index(item, at) + 1, m, held) for p, at, m, held in rest if item in p[at:]]
            if all(len(x[3]) < pages for x in after) and len(frozenset().union(*(x[3] for x in after))) < pages:
                continue
            yield [*prefix, item], n
            open_.append(([*prefix, item], after))


def prefix_span(
    docs: DataFrame,
    sites: DataFrame,
    share: float = 0.2,
    pages: int = 5,
    least_rows: int = 20,
    longest: int | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """``site, length, items, rows``: the frequent sequences of lines of each site.

    A sequence is frequent if its lines stand in this order, others between
    them or not, in at least ``share`` of all rows of the site and on at least
    ``pages`` different pages with an address. Sites not in ``sites`` or with
    fewer than ``least_rows`` rows have none. ``items`` are line identifiers.
    Sequences grow until none is frequent, or up to ``longest`` lines.
    ``lines`` is ``numbered_lines`` of the same tables, if at hand.

    A null body has no lines but counts as a row of its site. A line of one
    document counts once. Frequent lines are few: at most 1/share times the
    mean number of lines of a site's rows. Rows of sites that hold many meet the
    site's lines where they are, others by key; nothing is broadcast that
    grows with the number of sites. Documents that agree in them are one pattern with
    its rows; of each pattern's pages as many as ``pages`` suffice to tell
    whether some patterns have that many together. Lines that always come
    together have frequent sequences in each choice of them: the result may
    double with every such line, but is written as it grows.
    """
    rows = lines if lines is not None else numbered_lines(docs, sites)
    sizes = rows.groupBy("site").agg(F.count(F.lit(1)).alias("site_rows")).where(F.col("site_rows") >= least_rows)
    sizes = materialize(sizes, "site-rows")
    total = sizes.agg(F.sum("site_rows").alias("n")).first()["n"] or 0
    bit = F.when(F.col("page").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("page", F.lit(63)).cast("int"))).otherwise(
        F.lit(0).cast("bigint")
    )
    sequences = rows.where(F.col("ids").isNotNull()).select(
        "hit_id", "site", "page", bit.alias("bit"), F.filter("ids", lambda x: x.isNotNull()).alias("ids")
    )
    single = sequences.select("site", "page", "bit", F.explode_outer(F.array_distinct("ids")).alias("item")).where(F.col("item").isNotNull())
    level = single.groupBy("site", "item").agg(F.count(F.lit(1)).alias("rows"), F.bit_or("bit").alias("bits")).join(sizes, "site")
    level = _supported(level, ["site", "item"], single, share, pages)
    level = level.select("site", F.lit(1).alias("length"), F.array("item").alias("items"), "rows")
    level = materialize(level, "lines-1")
    if longest is not None and longest < 2:
        return level

    # Documents become patterns: the places of their lines among the frequent ones of the site.
    frequent = level.groupBy("site").agg(F.array_sort(F.collect_set(F.col("items")[0])).alias("known"))
    frequent = frequent.join(sizes, "site")
    met = lookup_join(sequences, frequent, ["site"], "site_rows", total, "hit_id", twice=True).where(F.col("known").isNotNull())
    known = F.filter("ids", lambda x: F.array_contains("known", x))
    pattern = F.transform(known, lambda x: F.array_position("known", x).cast("int"))
    each = met.select("site", "page", pattern.alias("pattern")).where(F.size("pattern") > 1)
    each = materialize(each.groupBy("site", "pattern", "page").agg(F.count(F.lit(1)).alias("rows")), "lines-patterns")
    place = F.row_number().over(Window.partitionBy("site", "pattern").orderBy("page"))
    held = each.where(F.col("page").isNotNull()).select("site", "pattern", "page", place.alias("place")).where(F.col("place") <= pages)
    held = held.groupBy("site", "pattern").agg(F.collect_list("page").alias("held"))
    patterns = each.groupBy("site", "pattern").agg(F.sum("rows").alias("rows")).join(held, ["site", "pattern"], "left")
    # One row per site and first line; a fixed number of partitions, as the work is in Python and not in the bytes.
    firsts = patterns.select("site", F.explode_outer(F.array_distinct("pattern")).alias("first"), F.struct("pattern", "rows", "held").alias("p"))
    firsts = firsts.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "site", "first")
    firsts = firsts.groupBy("site", "first").agg(F.collect_list("p").alias("patterns"))
    firsts = firsts.join(frequent.select("site", (F.col("site_rows") * F.lit(share) - F.lit(1e-9)).alias("least")), "site")

    def run(batches):
        for b in batches:
            for site, first, given, least in zip(b["site"], b["first"], b["patterns"], b["least"], strict=True):
                own = [(p["pattern"].tolist(), p["rows"], frozenset(() if p["held"] is None else p["held"].tolist())) for p in given]
                grown = _grown(own, first, least, pages, longest)
                while part := list(itertools.islice(grown, 10_000)):
                    places, rows = zip(*part, strict=True)
                    yield pd.DataFrame({"site": site, "places": places, "rows": rows})

    longer = firsts.mapInPandas(run, "site string, places array<int>, rows bigint").join(frequent.select("site", "known"), "site")
    longer = longer.select(
        "site", F.size("places").alias("length"), F.transform("places", lambda i: F.element_at("known", i)).alias("items"), "rows"
    )
    return level.unionByName(materialize(longer, "lines-longer"))


def _with_repeated(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Rows with ``ids``, and as ``known`` the lines of the frequent sequences of their site; rows of other sites fall away."""
    rows = rows.where(F.col("ids").isNotNull())
    items = sequences.select("site", F.explode("items").alias("item")).groupBy("site").agg(F.collect_set("item").alias("known"))
    sizes = rows.groupBy("site").agg(F.count(F.lit(1)).alias("site_rows"))
    total = sizes.agg(F.sum("site_rows").alias("n")).first()["n"] or 0
    met = lookup_join(rows, items.join(sizes, "site"), ["site"], "site_rows", total, "hit_id", twice=True)
    return met.where(F.col("known").isNotNull())


def repeated_lines(docs: DataFrame, sites: DataFrame, sequences: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``hit_id, line_no`` of every line that occurs in a frequent sequence of its site."""
    rows = _with_repeated(lines if lines is not None else numbered_lines(docs, sites), sequences)
    hits = F.filter(
        F.transform("ids", lambda x, k: F.when(x.isNotNull() & F.array_contains("known", x), (k + 1).cast("bigint"))), lambda n: n.isNotNull()
    )
    return rows.select("hit_id", F.explode_outer(hits).alias("line_no")).where(F.col("line_no").isNotNull())


def without_repeated(docs: DataFrame, sites: DataFrame, sequences: DataFrame) -> DataFrame:
    """``hit_id, body`` of every row, repeated lines removed; a null body stays null."""
    rows = sited(docs, sites).select("hit_id", "site", "body", F.transform(F.split("body", "\n"), line_id).alias("ids"))

    def stays(pair: Column) -> Column:
        return ~F.coalesce(F.array_contains(F.col("known"), pair["ids"]), F.lit(False))

    pairs = F.arrays_zip(F.split("body", "\n").alias("text"), F.col("ids"))
    kept = F.transform(F.filter(pairs, stays), lambda p: p["text"])
    cut = _with_repeated(rows, sequences).select("hit_id", F.array_join(kept, "\n").alias("_cut"))
    return docs.select("hit_id", "body").join(cut, "hit_id", "left").select("hit_id", F.coalesce("_cut", "body").alias("body"))
