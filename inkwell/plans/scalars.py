"""Queries on URL, date and text expressions, over whole tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import dates as D
from inkwell.functions import spans as S
from inkwell.functions import text as T
from inkwell.functions.urls import canonical_url, site_of
from inkwell.plans.registry import query
from inkwell.plans.sqltext import pages_cte, site_sql, strip_sql
from inkwell.session import table

#: The day all registered queries are asked on.
AS_OF = datetime.date(2026, 9, 30)

_DAY = "CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {x} >= '0001' THEN try_cast({x} AS DATE) END"


def _day_sql(x: str) -> str:
    return _DAY.format(x=x)


@query("canonical_url", f"WITH {pages_cte('SELECT url FROM docs')} SELECT d.hit_id, coalesce(p.page, '') AS page FROM docs d LEFT JOIN pages p ON d.url = p.url")
def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("hit_id", canonical_url(F.col("url")).alias("page"))


@query("site_of", f"SELECT hit_id, {site_sql('site', 'url')} AS site FROM docs")
def _site(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("hit_id", site_of(F.col("site"), F.col("url")).alias("site"))


@query(
    "slugify",
    rf"""SELECT id, CASE WHEN coalesce(s, '') = '' THEN 'query' ELSE s END AS slug FROM (SELECT id,
    substr(regexp_replace(regexp_replace({strip_sql('q')}, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS s FROM questions)""",
)
def _slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("id", T.slugify(F.col("q")).alias("slug"))


@query(
    "valid_dates",
    f"SELECT hit_id, coalesce({_day_sql('substr(publish, 1, 10)')} IS NOT NULL, false) AS valid FROM docs",
)
def _valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("hit_id", D.valid_date(F.substring("publish", 1, 10)).alias("valid"))


_AGE = f"date_diff('day', {_day_sql('substr(' + strip_sql('publish') + ', 1, 10)')}, DATE '{AS_OF}')"


@query(
    "recency_weak",
    f"SELECT hit_id, round(CASE WHEN age IS NULL OR age < -1 THEN 0.0 ELSE 0.03 * pow(2.0, -greatest(age, 0) / 30.0) END, 9) AS bonus "
    f"FROM (SELECT hit_id, {_AGE} AS age FROM docs)",
)
def _weak(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("hit_id", F.round(D.recency_bonus(F.col("publish"), AS_OF), 9).alias("bonus"))


@query(
    "recency_strong",
    f"SELECT hit_id, CAST(CASE WHEN age IS NULL OR age < -1 THEN 0.0 WHEN age <= 2 THEN 0.03 WHEN age <= 14 THEN 0.01 "
    f"WHEN age <= 90 THEN -0.10 ELSE -0.20 END AS DOUBLE) AS bonus FROM (SELECT hit_id, {_AGE} AS age FROM docs)",
)
def _strong(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("hit_id", D.recency_bonus(F.col("publish"), AS_OF, True).alias("bonus"))


@query("query_freshness")
def _fresh(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("q")
    return table(spark, d, "questions").select(
        "id", D.is_fresh_query(q, AS_OF).alias("fresh"), D.is_strong_fresh_query(q, AS_OF).alias("strong"),
        D.query_has_past_date(F.coalesce(q, F.lit("")), AS_OF).alias("past"),
    )


_SPAN = "substr(publish, 1, 10) || '..' || strftime(CAST(fetched_at AS TIMESTAMP), '%Y-%m-%d')"


@query(
    "time_ranges",
    f"""SELECT hit_id, coalesce(a <= b, false) AS valid, coalesce(b >= DATE '{AS_OF}', false) AS fresh,
    coalesce(a <= DATE '{AS_OF}' AND b >= DATE '{AS_OF}' AND date_diff('day', a, b) <= 1, false) AS strong FROM (
    SELECT hit_id, {_day_sql("substr(publish, 1, 10)")} AS a, CAST(CAST(fetched_at AS TIMESTAMP) AS DATE) AS b FROM docs)""",
)
def _ranges(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros("fetched_at") / 86_400_000_000).cast("int"))
    known = D.to_day(F.substring("publish", 1, 10)).isNotNull()
    span = F.concat(F.substring("publish", 1, 10), F.lit(".."), day.cast("string"))
    return docs.select(
        "hit_id",
        F.coalesce(D.valid_time_range(span), F.lit(False)).alias("valid"),
        # An unreadable start still lets the end tell whether today is reached.
        F.coalesce(F.when(known, D.time_range_is_fresh(span, AS_OF)).otherwise(day >= F.lit(AS_OF)), F.lit(False)).alias("fresh"),
        F.coalesce(D.time_range_is_strong(span, AS_OF), F.lit(False)).alias("strong"),
    )


@query(
    "content_len",
    r"""SELECT doc_id, CAST(length(regexp_replace(text, '[\s\p{Z}\x{0085}\x{000B}#>*`\-_|\[\]()。，、！？；："''“”‘’]', '', 'g')) AS BIGINT) AS chars FROM documents""",
)
def _content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_len(F.col("text")).cast("bigint").alias("chars"))


_CUT = r"""SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(CASE WHEN length(kept) < 110 THEN w ELSE kept END, '[\s\p{Z}]+$', '') || '…' END AS cut
FROM (SELECT doc_id, t, substr(t, 1, 200) AS w, regexp_extract(substr(t, 1, 200), '(?s)^(.*[。！？!?；;.])', 1) AS kept FROM (SELECT doc_id, %s AS t FROM documents))"""


@query("truncate_sentence", _CUT % strip_sql("coalesce(text, '')"))
def _truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("cut"))


@query(
    "capped_fields",
    f"SELECT hit_id, CASE WHEN length(t) <= 20 THEN t ELSE substr(t, 1, 20) || '…' END AS title FROM (SELECT hit_id, {strip_sql('''replace(replace(coalesce(title, ''), '<<<', '‹‹‹'), '>>>', '›››')''')} AS t FROM docs)",
)
def _fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("hit_id", T.field(F.col("title"), 20).alias("title"))


@query(
    "number_spans",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%')) AS BIGINT) AS matches FROM documents
    WHERE len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%')) > 0""",
)
def _counts(spark: SparkSession, d: str) -> DataFrame:
    n = S.count_matches(F.col("text"), r"[0-9]+(?:\.[0-9]+)?%")
    return table(spark, d, "documents").select("doc_id", n.cast("bigint").alias("matches")).where("matches > 0")


@query(
    "span_offsets",
    r"""WITH s AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%') AS m, string_split_regex(text, '[0-9]+(?:\.[0-9]+)?%') AS g FROM documents),
    e AS (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM s WHERE len(m) > 0)
    SELECT doc_id, CAST(i AS BIGINT) AS ordinal, m[i] AS matched,
      CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start_pos FROM e""",
)
def _spans(spark: SparkSession, d: str) -> DataFrame:
    spans = S.find_spans(F.col("text"), r"[0-9]+(?:\.[0-9]+)?%")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(spans).alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("ordinal"), F.col("s")["matched"].alias("matched"), F.col("s")["start"].cast("bigint").alias("start_pos"))


@query(
    "masked_lengths",
    r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(len(regexp_extract_all(text, '`[^`\n]+`')) AS BIGINT) AS spans, true AS same_lines FROM documents""",
)
def _masked(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    masked = S.mask_spans(t, r"`[^`\n]+`")
    return table(spark, d, "documents").select(
        "doc_id", F.char_length(masked).cast("bigint").alias("n"), S.count_matches(t, r"`[^`\n]+`").cast("bigint").alias("spans"),
        (F.size(F.split(masked, "\n", -1)) == F.size(F.split(t, "\n", -1))).alias("same_lines"),
    )


@query("secret_fingerprints", "SELECT call_id, substr(sha256(session_id), 1, 12) AS print FROM source_calls WHERE session_id IS NOT NULL")
def _prints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_calls").where("session_id is not null").select("call_id", T.fingerprint(F.col("session_id")).alias("print"))


@query(
    "strip_front_matter",
    r"""SELECT doc_id, regexp_replace(text, '^\x{FEFF}?---[ \t]*\r?\n(?:(?s:.*?)\n)??---[ \t]*(?:\r?\n|$)(?:[ \t]*\r?\n)*', '') AS body FROM documents""",
)
def _front(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.rewrite import strip_front_matter

    return table(spark, d, "documents").select("doc_id", strip_front_matter(F.col("text")).alias("body"))


@query("wrap_colors")
def _colors(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.rewrite import wrap_colors

    return table(spark, d, "documents").select("doc_id", wrap_colors(F.col("text")).alias("text"))


_BODY = r"regexp_replace(text, '^\x{FEFF}?---[ \t]*\r?\n(?:(?s:.*?)\n)??---[ \t]*(?:\r?\n|$)(?:[ \t]*\r?\n)*', '')"


@query("changed_texts", f"SELECT doc_id, {_BODY} AS text FROM documents WHERE {_BODY} <> text")
def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Texts that lose a front matter, rewritten; all others are left alone."""
    from inkwell.operators.rewrite import changed_only, strip_front_matter

    return changed_only(table(spark, d, "documents").select("doc_id", "text"), "text", strip_front_matter)


@query(
    "redacted_requests",
    r"""SELECT call_id, regexp_replace(replace(request, '"count":', '[redacted]'), '(^|[^A-Za-z0-9_])query($|[^A-Za-z0-9_])', '\1[redacted]\2', 'g') AS request FROM source_calls""",
)
def _redacted(spark: SparkSession, d: str) -> DataFrame:
    """Known values out of logged requests: a long one wherever it stands, a short one as a whole word."""
    return table(spark, d, "source_calls").select("call_id", T.redact(F.col("request"), ['"count":', "query"]).alias("request"))
