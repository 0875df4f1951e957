"""Queries of the measures, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import measures as M
from inkwell.operators.typography import RULES
from inkwell.plans.registry import query
from inkwell.plans.sqltext import strip_sql
from inkwell.session import table

_NO_CONTENT = r"""[\s\p{Z}\x{0085}\x{000B}\x{001C}-\x{001F}#>*`\-_|\[\]()。，、！？；："''“”‘’]"""


def _len(x: str) -> str:
    return f"length(regexp_replace({x}, '{_NO_CONTENT}', '', 'g'))"


def _sentences(x: str) -> str:
    parts = rf"string_split(regexp_replace({x}, '([。！？!?；;]+|\r?\n[ \t\r]*\n)', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: {strip_sql('s')}), lambda s: regexp_matches(s, '[一-鿿A-Za-z0-9]'))"


def _sizes(x: str) -> str:
    return f"list_filter(list_transform({_sentences(x)}, lambda s: {_len('s')}), lambda n: n > 0)"


_PARAGRAPHS = rf"list_filter(string_split_regex(text, '\n[\s\p{{Z}}\x{{0085}}\x{{000B}}]*\n'), lambda p: {_len('p')} > 0)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _t():
    return F.col("text")


def _per(n: str) -> str:
    return f"round(({n}) / (greatest({_len('text')}, 1) / 1000.0), 9)"


@query(
    "density_per_1k",
    f"""SELECT doc_id, {_per("len(regexp_extract_all(text, '——')) + len(list_filter(regexp_extract_all(text, '-+'), lambda x: x = '--'))")} AS dashes,
    {_per(f"len(regexp_extract_all(text, '{M.BOLD}'))")} AS bold, {_per(f"len(regexp_extract_all(text, '{M.EMOJI}'))")} AS emoji FROM documents WHERE text IS NOT NULL""",
)
def _density(spark: SparkSession, d: str) -> DataFrame:
    return M.densities(_docs(spark, d), "doc_id", _t())


@query(
    "sentence_cv",
    f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, round(list_stddev_pop(s) / list_avg(s), 9) AS cv FROM (SELECT doc_id, {_sizes("text")} AS s FROM documents) WHERE len(s) >= 8""",
)
def _cv(spark: SparkSession, d: str) -> DataFrame:
    return M.sentence_cv(_docs(spark, d), "doc_id", _t())


_P = f"(SELECT doc_id, list_transform({_PARAGRAPHS}, lambda p: {_sizes('p')}) AS p FROM documents WHERE text IS NOT NULL)"


@query(
    "punchline_rate",
    f"""SELECT doc_id, CAST(len(f) AS BIGINT) AS paragraphs, round(len(list_filter(f, lambda x: x[-1] < list_avg(x) * 0.6)) / len(f), 9) AS rate
    FROM (SELECT doc_id, list_filter(p, lambda x: len(x) >= 2) AS f FROM {_P}) WHERE len(f) >= 4""",
)
def _punch(spark: SparkSession, d: str) -> DataFrame:
    return M.punchline_rate(_docs(spark, d), "doc_id", _t())


@query(
    "staccato_run",
    f"""SELECT doc_id, CAST(coalesce(list_max(flatten(list_transform(p, lambda x: list_transform(regexp_extract_all(array_to_string(list_transform(x, lambda n: CASE WHEN n <= 8 THEN '1' ELSE '0' END), ''), '1+'),
    lambda r: length(r))))), 0) AS BIGINT) AS run FROM {_P}""",
)
def _staccato(spark: SparkSession, d: str) -> DataFrame:
    return M.staccato_run(_docs(spark, d), "doc_id", _t())


@query(
    "text_sizes",
    f"""SELECT doc_id, CAST({_len("text")} AS BIGINT) AS chars, CAST(len({_sentences("text")}) AS BIGINT) AS sentences, CAST(len({_PARAGRAPHS}) AS BIGINT) AS paragraphs
    FROM documents WHERE text IS NOT NULL""",
)
def _text_sizes(spark: SparkSession, d: str) -> DataFrame:
    return M.text_sizes(_docs(spark, d), "doc_id", _t())


_ITEM = r"^[ \t]*(?:[-*+•]|[0-9]+[.)、])[ \t]+"
_SQL_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(
    "line_runs",
    f"""SELECT doc_id, CAST(min(line_no) AS BIGINT) AS first_line, count(*) AS n_lines FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g
    FROM (SELECT DISTINCT doc_id, line_no FROM ({_SQL_LINES}) WHERE regexp_matches(line, '{_ITEM}'))) GROUP BY doc_id, g HAVING count(*) >= 3""",
)
def _runs(spark: SparkSession, d: str) -> DataFrame:
    return M.line_runs(_docs(spark, d), "doc_id", _t(), _ITEM)


@query(
    "empty_headers",
    rf"""WITH l AS (SELECT doc_id, line_no, line, regexp_replace(regexp_extract(line, '^[ \t]{{0,3}}#{{1,6}}[ \t]+(.+?)[ \t\r]*$', 1), '[^\p{{L}}\p{{N}}_]', '', 'g') AS title,
    regexp_replace(line, '[^\p{{L}}\p{{N}}_]', '', 'g') AS said FROM ({_SQL_LINES}) WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
    a AS (SELECT *, lag(title) OVER w AS above, lag(line_no) OVER w AS above_no FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
    SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM a WHERE line_no - above_no <= 3 AND length(above) >= 2 AND title = '' AND said = above""",
)
def _again(spark: SparkSession, d: str) -> DataFrame:
    return M.said_again(_docs(spark, d), "doc_id", _t())


_HIT = r"[0-9]+(?:\.[0-9]+)?%?"


@query(
    "dense_window",
    f"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '{_HIT}') AS m, string_split_regex(text, '{_HIT}') AS g FROM documents),
    e AS (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, m, g FROM s WHERE len(m) > 0),
    c AS (SELECT doc_id, k, {_len("g[k]")} AS gap, {_len("m[k]")} AS own FROM e),
    p AS (SELECT doc_id, k, own, sum(gap + own) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM c),
    q AS (SELECT doc_id, stop - own AS start, stop, k FROM p),
    w AS (SELECT doc_id, coalesce(lead(stop, 2) OVER v - start <= 800, false) AS a, coalesce(lead(stop, 1) OVER v - lag(start, 1) OVER v <= 800, false) AS b,
      coalesce(stop - lag(start, 2) OVER v <= 800, false) AS c FROM q WINDOW v AS (PARTITION BY doc_id ORDER BY k))
    SELECT doc_id, count(*) AS hits, count(*) FILTER (WHERE a OR b OR c) AS dense FROM w GROUP BY doc_id""",
)
def _dense(spark: SparkSession, d: str) -> DataFrame:
    return M.dense_hits(_docs(spark, d), "doc_id", _t(), _HIT)


_NEAR = M.HAN + "，。；：！？、"


@query(
    "quote_style_mix",
    rf"""SELECT * FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[「」『』]')) AS BIGINT) AS corner,
    CAST(len(regexp_extract_all(regexp_replace(text, '([{_NEAR}])', '\1\1', 'g'), '[{_NEAR}][ \t]*[“”‘’]|[“”‘’][ \t]*[{_NEAR}]')) AS BIGINT) AS curly FROM documents) WHERE corner > 0 AND curly > 0""",
)
def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return M.quote_styles(_docs(spark, d), "doc_id", _t())


@query(
    "unit_space_mix",
    rf"""SELECT * FROM (SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(text, '[0-9][ \t]+({M.UNITS})\b', 1)), list_distinct(regexp_extract_all(text, '[0-9]({M.UNITS})\b', 1)))), ',') AS units
    FROM documents) WHERE units <> ''""",
)
def _units(spark: SparkSession, d: str) -> DataFrame:
    return M.mixed_units(_docs(spark, d), "doc_id", _t())


#: Typography rules whose patterns look at nothing beside what they match.
_PLAIN = {rule: p for rule, _, p in RULES if "(?<" not in p and "(?=" not in p and "(?!" not in p and "\\1" not in p}
_PLAIN = {rule: p.replace(r"[\d", "[0-9").replace(r"\d", "[0-9]") for rule, p in _PLAIN.items()}
_PLAIN["ascii-comma"] = f"[{M.HAN}][,;!?]"


@query(
    "typography_counts",
    " UNION ALL ".join(
        f"SELECT doc_id, '{rule}' AS rule, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{p}')" for rule, p in _PLAIN.items()
    ),
)
def _plain(spark: SparkSession, d: str) -> DataFrame:
    return M.pattern_counts(_docs(spark, d), "doc_id", _t(), _PLAIN)


@query(
    "allocate_budget",
    """WITH p AS (SELECT query_id, source, hit_id, pow(0.72, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, hit_id) - 1) AS w FROM docs)
    SELECT query_id, source, hit_id, CAST(least(floor(8000.0 * w / sum(w) OVER (PARTITION BY query_id, source) + 1e-9), 2000) AS BIGINT) AS share FROM p""",
)
def _allocate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").select("query_id", "source", "hit_id", "rank")
    return M.first_shares(docs, ["query_id", "source"], ["rank", "hit_id"], 8000).drop("rank")
