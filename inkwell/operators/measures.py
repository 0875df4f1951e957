"""Measures of texts as Catalyst expressions: densities, sentence lengths, runs of lines, headings, mixed styles.

They take the text to be measured as it is: a view of it (``functions.views``)
or the raw text. Nothing here needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import content_len, paragraphs, sentences
from inkwell.functions.urls import let

# Marks whose density is measured.
BOLD = r"\*\*[^*\n]+\*\*"
EMOJI = r"[\x{1F300}-\x{1F3FA}\x{1F400}-\x{1FAFF}\x{1F000}-\x{1F2FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}]"
# Units that are written with or without a space.
UNITS = "KB|MB|GB|TB|Hz|MHz|GHz|Gbps|Mbps|kg|km|ms"
#: Han characters, for patterns of both engines.
HAN = (
    r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EE5F}\x{2F800}-\x{2FA1F}\x{30000}-\x{3347F}"
)
#: A sentence of so many content characters at most is short; a last one below this part of the mean is a punch line.
SHORT, PUNCH = 8, 0.6


def per_thousand(count: Column, text: Column) -> Column:
    """A count for each thousand content characters; an empty text counts as one character."""
    return F.round(count / (F.greatest(content_len(text), F.lit(1)) / F.lit(1000.0)), 9)


def dashes(text: Column) -> Column:
    """Long dashes, and pairs of hyphens that no third one touches."""
    hyphens = F.filter(F.regexp_extract_all(text, F.lit("-+"), F.lit(0)), lambda x: x == "--")
    return F.regexp_count(text, F.lit("——")) + F.size(hyphens)


def densities(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, dashes, bold, emoji`` a thousand content characters; a null text gives no row."""
    t = F.col("_t")
    counts = {"dashes": dashes(t), "bold": F.regexp_count(t, F.lit(BOLD)), "emoji": F.regexp_count(t, F.lit(EMOJI))}
    return documents.select(key, text.alias("_t")).where(t.isNotNull()).select(key, *[per_thousand(c, t).alias(k) for k, c in counts.items()])


def _sizes(text: Column) -> Column:
    """Content lengths of the sentences that have content."""
    return F.filter(F.transform(sentences(text), content_len), lambda n: n > 0)


def _mean(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes)


def sentence_cv(documents: DataFrame, key: str, text: Column, least: int = 8) -> DataFrame:
    """``key, sentences, cv``: how much sentence lengths vary, for texts of ``least`` sentences and more."""
    got = documents.select(key, _sizes(text).alias("s")).where(F.size("s") >= least).select(key, "s", _mean(F.col("s")).alias("m"))
    squares = F.aggregate("s", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m")))
    return got.select(key, F.size("s").cast("bigint").alias("sentences"), F.round(F.sqrt(squares / F.size("s")) / F.col("m"), 9).alias("cv"))


def _paragraph_sizes(text: Column) -> Column:
    return F.transform(paragraphs(text), _sizes)


def punchline_rate(documents: DataFrame, key: str, text: Column, least: int = 4) -> DataFrame:
    """``key, paragraphs, rate``: how many paragraphs of two sentences and more end in one far below their mean."""
    fit = F.filter(_paragraph_sizes(text), lambda p: F.size(p) >= 2)
    got = documents.select(key, fit.alias("p")).where(F.size("p") >= least)
    short = F.filter("p", lambda p: F.element_at(p, -1) < _mean(p) * PUNCH)
    return got.select(key, F.size("p").cast("bigint").alias("paragraphs"), F.round(F.size(short) / F.size("p"), 9).alias("rate"))


def staccato_run(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, run``: the most short sentences in a row within one paragraph; 0 where there are none."""
    marks = F.transform(_paragraph_sizes(F.col("_t")), lambda p: F.array_join(F.transform(p, lambda n: F.when(n <= SHORT, "1").otherwise("0")), ""))
    runs = F.flatten(F.transform(marks, lambda m: F.transform(F.regexp_extract_all(m, F.lit("1+"), F.lit(0)), lambda r: F.length(r))))
    return documents.select(key, text.alias("_t")).where("_t is not null").select(key, F.coalesce(F.array_max(runs), F.lit(0)).cast("bigint").alias("run"))


def text_sizes(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, chars, sentences, paragraphs`` of each text that is not null."""
    t = F.col("_t")
    return documents.select(key, text.alias("_t")).where(t.isNotNull()).select(
        key, content_len(t).cast("bigint").alias("chars"), F.size(sentences(t)).cast("bigint").alias("sentences"), F.size(paragraphs(t)).cast("bigint").alias("paragraphs")
    )


def _lines(documents: DataFrame, key: str, text: Column) -> DataFrame:
    rows = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def line_runs(documents: DataFrame, key: str, text: Column, pattern: str, least: int = 3) -> DataFrame:
    """``key, first_line, n_lines`` of the runs of ``least`` lines and more that all match.

    Decided within each row: numbers of matching lines, each less its place among them, are alike along a run.
    """
    numbers = F.filter(F.transform(F.split(text, "\n"), lambda x, k: F.when(x.rlike(pattern), k + 1)), lambda n: n.isNotNull())
    placed = documents.select(key, F.posexplode(numbers).alias("k", "n"))
    runs = placed.groupBy(key, (F.col("n") - F.col("k")).alias("g")).agg(F.min("n").cast("bigint").alias("first_line"), F.count(F.lit(1)).alias("n_lines"))
    return runs.where(F.col("n_lines") >= least).drop("g")


def said_again(documents: DataFrame, key: str, text: Column, within: int = 3) -> DataFrame:
    """``key, line_no, line``: lines that say the heading above again, where no other text stands between them."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = _lines(documents, key, text).where(F.btrim("line", F.lit(" \t\r")) != "")
    heading = F.regexp_extract("line", r"^[ \t]{0,3}#{1,6}[ \t]+(.+?)[ \t\r]*$", 1)
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}_]", "")
    rows = rows.select(key, "line_no", "line", bare(heading).alias("title"), bare(F.col("line")).alias("said"))
    rows = rows.withColumn("above", F.lag("title").over(w)).withColumn("above_no", F.lag("line_no").over(w))
    near = (F.col("line_no") - F.col("above_no") <= within) & (F.char_length("above") >= 2) & (F.col("title") == "")
    return rows.where(near & (F.col("said") == F.col("above"))).select(key, F.col("line_no").cast("bigint").alias("line_no"), "line")


def dense_hits(documents: DataFrame, key: str, text: Column, pattern: str, window: int = 800) -> DataFrame:
    """``key, hits, dense``: matches, and those of them in some ``window`` content characters with three or more.

    Places are counted in content characters: sums of what stands between the matches.
    """
    split = documents.select(key, F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")).where(F.size("m") > 0)
    parts = F.arrays_zip(F.transform("g", content_len).alias("gap"), F.transform("m", content_len).alias("own"))
    rows = split.select(key, F.posexplode(F.slice(parts, F.lit(1), F.size("m"))).alias("k", "x")).select(key, "k", "x.*")
    w = Window.partitionBy(key).orderBy("k")
    rows = rows.withColumn("stop", F.sum(F.col("gap") + F.col("own")).over(w)).withColumn("start", F.col("stop") - F.col("own"))
    for name, first in (("a", 0), ("b", -1), ("c", -2)):
        begin = F.col("start") if first == 0 else F.lag("start", -first).over(w)
        end = F.lead("stop", 2 + first).over(w) if first > -2 else F.col("stop")
        rows = rows.withColumn(name, F.coalesce(end - begin <= window, F.lit(False)))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.count(F.when(F.expr("a or b or c"), 1)).alias("dense"))


def quote_styles(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, corner, curly`` of the texts with both: corner quotes, and curly ones beside Chinese text."""
    near = "[" + HAN + "，。；：！？、]"
    t = F.col("_t")
    curly = F.regexp_count(t, F.lit(rf"(?<={near})[ \t]*[“”‘’]|[“”‘’][ \t]*(?={near})"))
    rows = documents.select(key, text.alias("_t")).select(key, F.regexp_count(t, F.lit("[「」『』]")).cast("bigint").alias("corner"), curly.cast("bigint").alias("curly"))
    return rows.where("corner > 0 and curly > 0")


def mixed_units(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, units``: units that a text writes both with and without a space."""
    spaced = F.regexp_extract_all(text, F.lit(rf"[0-9][ \t]+({UNITS})\b"), F.lit(1))
    glued = F.regexp_extract_all(text, F.lit(rf"[0-9]({UNITS})\b"), F.lit(1))
    return documents.select(key, F.array_join(F.array_sort(F.array_intersect(spaced, glued)), ",").alias("units")).where("units <> ''")


def pattern_counts(documents: DataFrame, key: str, text: Column, patterns: dict[str, str]) -> DataFrame:
    """``key, rule, n`` of each pattern that a text matches; all are counted in one pass over the rows."""
    counts = F.array(*[F.struct(F.lit(rule).alias("rule"), F.regexp_count(F.col("_t"), F.lit(p)).cast("bigint").alias("n")) for rule, p in patterns.items()])
    rows = documents.select(key, text.alias("_t")).where("_t is not null").select(key, F.explode_outer(F.filter(counts, lambda c: c["n"] > 0)).alias("c"))
    return rows.where("c is not null").select(key, "c.rule", "c.n")


def either(words: tuple[str, ...]) -> str:
    """A pattern of plain words, longest first; words with an ellipsis stand for patterns and are left out."""
    return "|".join(sorted((w for w in words if "…" not in w), key=lambda x: (-len(x), x)))


def word_counts(documents: DataFrame, key: str, text: Column, lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """``key, rule, n``: how often words of each list stand in a text, longest first, none inside another of its list."""
    return pattern_counts(documents, key, text, {rule: either(own) for rule, own in lists.items() if either(own)})


def first_shares(df: DataFrame, keys: list[str], order: list[str], budget: int, decay: float = 0.72, most: int = 2000) -> DataFrame:
    """``df`` with ``share``: what each row of a group gets of a budget by its place, before caps free anything."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_w", F.pow(F.lit(decay), F.row_number().over(w) - 1))
    whole = F.sum("_w").over(Window.partitionBy(*keys))
    share = F.least(F.floor(F.lit(float(budget)) * F.col("_w") / whole + F.lit(1e-9)), F.lit(most))
    return placed.withColumn("share", let(share, lambda s: s.cast("bigint"))).drop("_w")
