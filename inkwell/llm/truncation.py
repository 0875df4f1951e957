"""Problem 3: texts that stop before their end, by what the corpus says about their last words.

Word trigrams are counted inside texts and at the ends of lines, in SQL over
all different bodies: a hit delivered again says nothing new. A body is cut if the last trigram of its last line is frequent
inside and next to never final; a last word that is no word is taken as the
torn rest of one, and the trigram before it decides.

A word of a script without spaces counts as two characters at the end of such
a trigram, hence five characters reach over three words.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.skew import lookup_join
from inkwell.session import materialize

# What a cut leaves at the end of a line: marks put there, and torn markup or characters.
_MARK = r"(?:\s*\[(?:\.{3}|…)\]|\s*\(more\)|(?<!\.)\.{3,}|(?<!…)…+)$"
#: A line that ends inside an entity, a tag, a link or a character, and what of it is torn.
_TORN = r"(?:&[A-Za-z#0-9]*|<[A-Za-z/!][^<>]*|\[[^\[\]]{0,12}|\]\([^)]*|\x{FFFD})$"
_TORN_LINK = r"\[[^\[\]]*$"
_TORN_TAIL = r"!*(?:&[A-Za-z#0-9]*|<[A-Za-z/!][^<>]*|\[[^\[\]]*(?:\]\([^)]*)?|\]\([^)]*|(?<!\x{FFFD})\x{FFFD}+)$"
_TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[\p{L}\p{M}\x27]+|9(?:\.9)?|[^\s\p{L}\p{M}]"
#: Where a text falls into sentences and lines.
_BREAKS = r"(?<=[。！？；\n])|(?<=[.!?;])[ \t]+"
_SPACED = r"[\p{L}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]$"

#: White space to cut from both ends of a line, and what may follow the mark that closes a sentence.
_BLANKS = " \n\t\r\f\x0b\xa0\u2002\u2003\u2009\u3000"
_AFTER_STOP, _AFTER_WIDE = "”’\"')*_" + _BLANKS, "”’\"'）)」』】*_~" + _BLANKS

#: SQL over a view of bodies (``sentences``): one row per distinct sentence, with its number. The outer
#: explode keeps the optimizer from splitting each body once more to see whether it has parts.
SENTENCES = """
SELECT sentence, final, count(*) AS n FROM (
  SELECT CASE WHEN final THEN {ending} ELSE raw END AS sentence, final
  FROM (SELECT raw, endswith(raw, '\\n') AS final FROM (SELECT explode_outer(sentences) AS raw FROM {view})))
GROUP BY sentence, final
"""
#: A line's last sentence without a mark of omission; most end in none and are not searched.
_MARKED = "(right(btrim(raw, '{blanks}'), 1) IN ('…', ']', ')') OR endswith(btrim(raw, '{blanks}'), '...'))"
_ENDING = (
    "CASE WHEN " + _MARKED + " THEN btrim(regexp_replace(btrim(raw, '{blanks}'), r'{mark}', ''), '{blanks}') ELSE btrim(raw, '{blanks}') END"
)

#: Tokens of ``text`` after marks of the start.
_TOKENS = "concat(array('^', '^', '^', '^'), regexp_extract_all({text}, r'{token}', 0))"


def _grams(at: str) -> dict[str, str]:
    """The grams of ``tokens`` that end at place ``at``; characters from U+2E80 on are words of two."""
    back = [f"tokens[{at} - {k}]" for k in range(5)]
    wide = f"{back[0]} >= '⺀'"

    def gram(kind: int, characters: int, words: int) -> str:
        of = [", ".join(reversed(back[:n])) for n in (characters, words)]
        return f"CASE WHEN {wide} THEN xxhash64({kind}, {of[0]}) ELSE xxhash64({kind}, {of[1]}) END"

    return {"long": gram(3, 5, 3), "short": gram(2, 3, 2), "word": f"CASE WHEN NOT {wide} THEN xxhash64(1, {back[0]}) END"}


#: How often each gram stands inside lines and at their ends, over all different bodies.
COUNTS = """
SELECT gram, sum(CASE WHEN at_end THEN 0 ELSE n END) AS inside, sum(CASE WHEN at_end THEN n ELSE 0 END) AS ends
FROM (
  SELECT n, at_end, explode_outer(array(long, short, word)) AS gram
  FROM (SELECT n, final AND i = size(tokens) - 1 AS at_end, {long} AS long, {short} AS short, {word} AS word
    FROM (SELECT n, final, tokens, explode_outer(sequence(4, size(tokens) - 1)) AS i
      FROM (SELECT n, final, {tokens} AS tokens FROM {view}) WHERE size(tokens) > 4))
)
WHERE gram IS NOT NULL GROUP BY gram
"""

#: The grams that decide about each last line.
ENDS = """
SELECT hit_id, marked, spaced, size(tokens) = 5 AND after AS bare, stack(5, 'long', {long}, 'short', {short}, 'word', {word},
  'before_long', CASE WHEN size(tokens) > 5 THEN {before_long} END, 'before_short', CASE WHEN size(tokens) > 5 THEN {before_short} END) AS (role, gram)
FROM (SELECT hit_id, marked, spaced, after, {tokens} AS tokens FROM {view}) WHERE size(tokens) > 4
"""


def _over(df: DataFrame, sql: str, text: str = "", at: str = "i") -> DataFrame:
    """The result of ``sql`` over ``df``, under a name of its own that is gone afterwards."""
    spark, view = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    before = {f"before_{k}": v for k, v in _grams("size(tokens) - 2").items()}
    tokens = _TOKENS.format(text=text, token=_TOKEN)
    ending = _ENDING.format(blanks=_BLANKS, mark=_MARK)
    df.createOrReplaceTempView(view)
    try:
        return spark.sql(sql.format(view=view, ending=ending, tokens=tokens, **_grams(at), **before))
    finally:
        spark.catalog.dropTempView(view)


def truncated(docs: DataFrame, total: int, least: int = 3, rarely: float = 0.01) -> DataFrame:
    """``hit_id`` of each row whose body was cut inside a sentence or word.

    The last line that is not blank decides. A line that closes with a full
    stop, question or exclamation mark is whole. Otherwise its last gram must
    stand at least ``least`` times inside lines and at most ``rarely`` as often
    at other lines' ends; where the long gram is too rare to tell, the short
    one decides; where the last word is hardly known inside, the gram before
    it, which such a word hardly ever follows. A mark of omission or a torn
    tag, entity, link or character at the end, however long it is, is a sign
    of its own: such a line is cut unless lines mostly end in the gram before it.

    Null, empty and blank bodies are not cut. All lines of all bodies are
    counted, equal sentences once with their number. Bodies that differ in
    white space and letter case only are copies and count once, so that none
    testifies for its own cut. ``total`` is the number of rows; grams that end
    more than a 500th of them are looked up without moving their rows to one
    task. Extra columns are ignored; an empty table gives no rows; a repeated
    row gives one row.
    """

    def pieces(text: Column) -> Column:
        """Sentences and line ends in small letters, link targets dropped, digits alike; one pass splits them."""
        plain = F.when(text.contains("]("), F.regexp_replace(text, r"\]\([^)\n]*\)", "]")).otherwise(text)
        return F.split(F.regexp_replace(F.lower(plain), "[0-9]+", "9"), _BREAKS)

    # Most bodies end in no white space and need no trimming, which walks the whole text.
    blank = F.lit(False)
    for c in _BLANKS:
        blank |= F.endswith("body", F.lit(c))
    raw = docs.where(F.col("body").isNotNull())
    raw = raw.select("hit_id", F.when(blank, F.rtrim("body", F.lit(_BLANKS))).otherwise(F.col("body")).alias("body"))
    copies = F.xxhash64(F.lower(F.translate("body", _BLANKS, "")))
    bodies = raw.groupBy(copies.alias("copies")).agg(F.min("body").alias("body"))
    # The last sentence of a line keeps the line end.
    sentences = _over(bodies.select(pieces(F.concat("body", F.lit("\n"))).alias("sentences")), SENTENCES)
    counts = _over(sentences, COUNTS, "sentence")

    last = raw.select("hit_id", F.substring_index("body", "\n", -1).alias("raw")).where("raw <> ''")

    marked = F.expr(_MARKED.format(blanks=_BLANKS)) & F.col("raw").rlike(_MARK)
    last = last.select("hit_id", "raw", marked.alias("with_mark"))
    bare = F.when(F.col("with_mark"), F.regexp_replace("raw", _MARK, "")).otherwise(F.col("raw"))
    last = last.select("hit_id", "raw", "with_mark", bare.alias("bare"))
    # After a digit a full stop closes only with something behind it.
    stop = F.right(F.rtrim("bare", F.lit(_AFTER_STOP)), F.lit(2))
    closed = F.right(F.rtrim("bare", F.lit(_AFTER_WIDE)), F.lit(1)).isin(*"。！？!?．")
    closed |= stop.endswith(".") & (~stop.rlike("^[0-9]") | ~F.col("bare").endswith("."))
    last = last.select("hit_id", "raw", "with_mark", closed.alias("closed"))
    # A text in brackets that never closes may still end with a full stop; a tag or target does not.
    torn = F.col("raw").rlike(_TORN) | (~F.col("closed") & F.col("raw").rlike(_TORN_LINK))
    last = last.select("hit_id", "raw", "with_mark", "closed", torn.alias("torn")).where("torn or not closed")
    # What is torn says nothing itself; the words before it do, where there are some.
    kept = F.when(F.col("torn"), F.regexp_replace("raw", _TORN_TAIL, "")).otherwise(F.col("raw"))
    last = last.select("hit_id", F.expr("with_mark or torn").alias("marked"), "raw", kept.alias("kept"))
    ends = last.select("hit_id", "marked", F.when(F.btrim("kept", F.lit(_BLANKS)) != "", F.col("kept")).otherwise(F.col("raw")).alias("kept"))
    ends = ends.select("hit_id", "marked", pieces(F.col("kept")).alias("parts"))
    # Only the last sentence of a last line tells about its end.
    parts = F.filter("parts", lambda s: F.btrim(s, F.lit(_BLANKS)) != "")
    ends = ends.select("hit_id", "marked", parts.alias("parts"))
    ends = ends.select("hit_id", "marked", (F.size("parts") > 1).alias("after"), F.try_element_at("parts", F.lit(-1)).alias("raw"))
    ends = ends.where("raw is not null").select("hit_id", "marked", "after", F.expr(_ENDING.format(blanks=_BLANKS, mark=_MARK)).alias("line"))
    ends = ends.withColumn("spaced", F.col("line").rlike(_SPACED))
    asked = materialize(_over(ends, ENDS, "line", "size(tokens) - 1").where("gram is not null"), "cut-ends")
    wanted = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n_asked")).join(counts, "gram")
    met = lookup_join(asked, wanted, ["gram"], "n_asked", total, "hit_id")
    told = met.groupBy("hit_id").agg(
        F.max("bare").alias("bare"),
        F.max("marked").alias("marked"),
        F.max("spaced").alias("spaced"),
        *[
            F.max(F.when(F.col("role") == role, F.coalesce(F.col(what), F.lit(0)))).alias(f"{role}_{what}")
            for role in ("long", "short", "word", "before_long", "before_short")
            for what in ("inside", "ends")
        ]
    )

    def known(role: str, own: int):
        return F.col(f"{role}_inside") + F.col(f"{role}_ends") - own >= least

    def goes_on(role: str, own: int):
        inside, ends_ = F.col(f"{role}_inside"), F.col(f"{role}_ends") - own
        chance = F.when(inside >= 10 * least, 1).otherwise(0)
        return (inside >= least) & (ends_ <= inside * rarely + chance)

    def final(role: str):
        return F.col(f"{role}_ends") - 1 > F.col(f"{role}_inside")

    def unheard(before: str, whole: str):
        """After ``before``, which goes on, hardly any text has the last word."""
        seen = F.col(f"{whole}_inside") + F.col(f"{whole}_ends") - 1
        return goes_on(before, 0) & (seen <= F.col(f"{before}_inside") * rarely)

    torn_word = F.col("spaced") & (F.col("word_inside") < F.greatest(F.lit(least), F.col("word_ends")))
    before = F.when(known("before_long", 0), unheard("before_long", "long")).otherwise(unheard("before_short", "short"))
    cut = F.when(torn_word, before | F.col("bare")).when(known("long", 1), goes_on("long", 1)).otherwise(goes_on("short", 1))
    ends_so = F.when(known("long", 1), final("long")).otherwise(final("short"))
    cut = F.when(F.col("marked"), F.coalesce(cut, F.lit(False)) | ~F.coalesce(ends_so, F.lit(False))).otherwise(cut)
    return told.where(cut).select("hit_id")


def truncation_rates(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """``source, site, rows, cut_rows, cut_rate`` of every source and site; null is a value of its own.

    Rows without a body count as rows.
    """
    marked = docs.select("hit_id", "source", "site").join(
        cut.select("hit_id", F.lit(1).alias("one")).dropDuplicates(["hit_id"]), "hit_id", "left"
    )
    return marked.groupBy("source", "site").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("one").alias("cut_rows"),
        F.round(F.count("one") / F.count(F.lit(1)), 9).alias("cut_rate"),
    )
