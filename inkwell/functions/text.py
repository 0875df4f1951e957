"""Text expressions: lengths, caps, cuts, line numbers, sentences. Offsets count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.urls import let, strip

# Marks that count as no content.
NO_CONTENT = r"[\s#>*`\-_|\[\]()。，、！？；：\"'“”‘’]"
# Marks that forge a fence, and what stands in for them.
FENCE_MARKS = (("<<<", "‹‹‹"), (">>>", "›››"), ("＜＜＜", "‹‹‹"), ("＞＞＞", "›››"))


def content_len(text: Column) -> Column:
    """Characters without white space, markup and the listed punctuation; null counts 0."""
    return F.coalesce(F.char_length(F.regexp_replace(text, "(?U)" + NO_CONTENT, "")), F.lit(0))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, back to the last sentence end unless that loses over 45 %, then ``…``."""

    def cut(t: Column) -> Column:
        window = F.substring(t, 1, limit)
        kept = F.regexp_extract(window, r"(?s)^(.*[。！？!?；;.])", 1)
        chosen = F.when(F.char_length(kept) < limit * 0.55, window).otherwise(kept)
        return F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(chosen, r"(?U)\s+$", ""), F.lit("…")))

    return let(strip(F.coalesce(text, F.lit(""))), cut)


def defang(text: Column) -> Column:
    """Fence marks made harmless; null gives ``''``."""
    out = F.coalesce(text, F.lit(""))
    for raw, safe in FENCE_MARKS:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def field(text: Column, limit: int) -> Column:
    """A source's value as it may be shown: defanged, stripped, capped with ``…``."""
    return let(
        strip(defang(text.cast("string"))),
        lambda t: F.when(F.char_length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("…"))),
    )


def slugify(text: Column, limit: int = 40) -> Column:
    """Runs of what is no word become ``-``; trimmed, capped, ``query`` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(strip(text), r"(?U)[^\w一-鿿-]+", "-"), r"^-+|-+$", "")
    return let(F.substring(slug, 1, limit), lambda s: F.when(s == "", F.lit("query")).otherwise(F.coalesce(s, F.lit("query"))))


def line_of(text: Column, offset: Column) -> Column:
    """Line of a 0-based offset, from 1."""
    return F.size(F.split(F.substring(text, F.lit(1), offset.cast("int")), "\n", -1))


def column_of(text: Column, offset: Column) -> Column:
    """Column of a 0-based offset, from 1."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.char_length(F.substring_index(before, "\n", -1)) + 1


def snippet(text: Column, start: Column, end: Column, pad: int = 14) -> Column:
    """What stands around a span, on one line, with ``…`` where it is cut."""
    low, high = F.greatest(start - pad, F.lit(0)), F.least(end + pad, F.char_length(text))
    middle = strip(F.replace(F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), F.lit("\n"), F.lit(" ")))
    return F.concat(
        F.when(low > 0, F.lit("…")).otherwise(F.lit("")), middle, F.when(high < F.char_length(text), F.lit("…")).otherwise(F.lit(""))
    )


def sentences(text: Column) -> Column:
    """Stripped sentences that hold a letter or digit, split after end marks and at blank lines."""
    marked = F.regexp_replace(text, r"([。！？!?；;]+|\r?\n[ \t\r]*\n)", "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), strip)
    return F.filter(parts, lambda s: s.rlike(r"[一-鿿A-Za-z0-9]"))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines that have content."""
    return F.filter(F.split(text, r"\n(?U:\s*)\n"), lambda p: content_len(p) > 0)


def mask_secret(text: Column) -> Column:
    """First and last four characters of a secret, all of a short one hidden."""
    return F.when(F.char_length(text) <= 12, F.repeat(F.lit("*"), F.char_length(text))).otherwise(
        F.concat(F.substring(text, 1, 4), F.lit("…"), F.right(text, F.lit(4)))
    )


def fingerprint(text: Column) -> Column:
    """First twelve digits of the SHA-256 of a value."""
    return F.substring(F.sha2(text, 256), 1, 12)


def redact(text: Column, secrets: list[str], mark: str = "[redacted]") -> Column:
    """Known secrets replaced, longest first; those under 8 characters as whole words only."""
    out = text
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        quoted = re.escape(secret)
        out = F.regexp_replace(out, quoted if len(secret) >= 8 else rf"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])", mark)
    return out
