"""Matches with their places, and masks that keep every length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def find_spans(text: Column, pattern: str) -> Column:
    """``array<struct<start,end,matched>>`` of all matches from left to right; 0-based, half open.

    One fold over the pieces between the matches. The pattern must not match
    the empty string. Null text gives null.
    """
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def fold(pair: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,matched:string>>)").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            low = acc["at"] + F.char_length(x["gap"])
            high = low + F.char_length(x["matched"])
            span = F.struct(low.alias("start"), high.alias("end"), x["matched"].alias("matched"))
            return F.struct(high.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.filter(pair, lambda x: x["matched"].isNotNull()), start, step, lambda acc: acc["out"])

    zipped = F.zip_with(gaps, matched, lambda g, m: F.struct(F.coalesce(g, F.lit("")).alias("gap"), m.alias("matched")))
    return fold(zipped)


def mask_spans(text: Column, pattern: str, mark: str = " ", keep: str = r"\r\n") -> Column:
    """The text with every match overwritten by ``mark``, line ends kept; the length stays."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    blank = F.transform(matched, lambda m: F.regexp_replace(m, rf"[^{keep}]", mark))
    return F.array_join(F.zip_with(gaps, blank, lambda g, b: F.concat(F.coalesce(g, F.lit("")), F.coalesce(b, F.lit("")))), "")


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def inside_any(spans: Column, start: Column, end: Column) -> Column:
    """Whether a span lies inside one of ``spans``."""
    return F.exists(spans, lambda s: (s["start"] <= start) & (end <= s["end"]))


def without_overlaps(spans: Column, others: Column) -> Column:
    """Spans that touch none of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


__all__ = ["count_matches", "find_spans", "inside_any", "let", "mask_spans", "without_overlaps"]
