"""Batch rewriting of Markdown texts; applied twice, both change nothing more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FRONT = r"\A\x{FEFF}?---[ \t]*\r?\n(?:(?s:.*?)\n)??---[ \t]*(?:\r?\n|\z)(?:[ \t]*\r?\n)*"
_PROTECTED = r"(?s:\A---.*?---\n)|(?s:```.*?(?:```|\z))|`[^`\n]+`|https?://[^\s)）]+"
_COLOR = r"(?<![（A-Za-z0-9_#])#(?:[0-9A-Fa-f]{8}|[0-9A-Fa-f]{6})(?![A-Za-z0-9)）])"


def strip_front_matter(text: Column) -> Column:
    """Without the front matter at the start and the blank lines behind it."""
    return F.regexp_replace(text, _FRONT, "")


def wrap_colors(text: Column) -> Column:
    """Hexadecimal colours in full-width brackets, outside code, addresses and front matter.

    One match finds what is protected or a colour; only colours are rewritten.
    """
    pattern = f"(?:{_PROTECTED})|(?:{_COLOR})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    new = F.transform(found, lambda m: F.when(m.rlike(r"^#[0-9A-Fa-f]{6,8}\z"), F.concat(F.lit("（"), m, F.lit("）"))).otherwise(m))
    return F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(F.coalesce(g, F.lit("")), F.coalesce(m, F.lit("")))), "")


def changed_only(df: DataFrame, text: str, rewrite) -> DataFrame:
    """Rows whose text a rewriting changes, with the new text; to be written to a new place."""
    new = df.withColumn("_new", rewrite(F.col(text)))
    return new.where(F.col("_new") != F.col(text)).drop(text).withColumnRenamed("_new", text)
