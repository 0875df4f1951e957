"""Queries of the problems tagged llm, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.urls import site_of
from inkwell.llm.boilerplate import main_body
from inkwell.llm.copies import collapse, find_copies
from inkwell.llm.lines import numbered_lines, prefix_span, repeated_lines, without_repeated
from inkwell.llm.mixing import mix, reached_shares
from inkwell.llm.packing import fill_rates, pack
from inkwell.llm.pii import find_pii, redact_pii
from inkwell.llm.survivors import survivors
from inkwell.llm.truncation import truncated, truncation_rates
from inkwell.plans.registry import Query
from inkwell.plans.sqltext import pages_cte, site_sql, strip_sql
from inkwell.session import materialize, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


_PAGES = pages_cte("SELECT url FROM docs UNION SELECT url FROM merged UNION SELECT u FROM (SELECT unnest(also_urls) AS u FROM merged)")

SQL["p1_found"] = f"""WITH {_PAGES},
d AS (SELECT 'docs' AS rec, hit_id AS id, query_id AS q, page AS k, '' AS t, '' AS s FROM docs JOIN pages USING (url) WHERE {strip_sql("url")} <> ''),
a AS (SELECT DISTINCT m.merged_id, p.page FROM (SELECT merged_id, unnest(also_urls) AS u FROM merged) m JOIN pages p ON m.u = p.url WHERE {strip_sql("m.u")} <> ''),
s AS (SELECT merged_id, string_agg(page, chr(1) ORDER BY page) AS s FROM a GROUP BY merged_id),
m AS (SELECT 'merged' AS rec, m.merged_id AS id, query_id AS q, coalesce(page, '') AS k,
  regexp_replace(lower(coalesce(title, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t, coalesce(s.s, '') AS s
  FROM merged m LEFT JOIN pages USING (url) LEFT JOIN s ON m.merged_id = s.merged_id),
g AS (SELECT *, min(id) OVER (PARTITION BY rec, q, k, t, s) AS keep FROM (SELECT * FROM d UNION ALL SELECT * FROM m))
SELECT rec, keep AS keep_id, id AS copy_id FROM g WHERE keep < id"""

_DAY = "substr(publish, 1, 10)"
SQL["p4_found"] = f"""WITH {pages_cte("SELECT url FROM merged")},
m AS (SELECT merged_id, query_id, page, sources, length(coalesce(regexp_replace(body, '[\\s\\p{{Z}}\\x{{0085}}\\x{{000B}}\\x{{001C}}-\\x{{001F}}]', '', 'g'), '')) AS size,
  CASE WHEN regexp_full_match({_DAY}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {_DAY} >= '0001'
    AND try_cast({_DAY} AS DATE) <= CAST(CAST(merged_at AS TIMESTAMP) AS DATE) THEN {_DAY} END AS day
  FROM merged JOIN pages USING (url) WHERE {strip_sql("url")} <> ''),
e AS (SELECT query_id, page, k AS source, min(v) AS r FROM (SELECT query_id, page, unnest(map_keys(sources)) AS k, unnest(map_values(sources)) AS v FROM m) WHERE v >= 1 GROUP BY ALL),
s AS (SELECT query_id, page, string_agg(source || ':' || r, ',' ORDER BY source) AS k FROM e GROUP BY ALL),
g AS (SELECT query_id, page, min(merged_id) AS group_id, arg_max(merged_id, (size, -merged_id)) AS body_id,
  coalesce(arg_max(merged_id, (day, -merged_id)) FILTER (WHERE day IS NOT NULL), 0) AS publish_id FROM m GROUP BY ALL HAVING count(DISTINCT merged_id) > 1)
SELECT g.group_id, g.body_id, g.publish_id, coalesce(s.k, '') AS sources_key FROM g LEFT JOIN s ON g.query_id IS NOT DISTINCT FROM s.query_id AND g.page = s.page"""

SQL["p6_found"] = f"""WITH {pages_cte("SELECT url FROM docs")},
d AS (SELECT hit_id, {site_sql("site", "d.url")} AS s, CASE WHEN {strip_sql("d.url")} <> '' THEN page END AS page, body FROM docs d LEFT JOIN pages p ON d.url = p.url),
n AS (SELECT s, count(*) AS n FROM d WHERE s IN (SELECT site FROM sites) GROUP BY s HAVING count(*) >= 20),
l AS (SELECT hit_id, s, page, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM (SELECT d.*, string_split(body, chr(10)) AS parts FROM d JOIN n USING (s) WHERE body IS NOT NULL)),
k AS (SELECT hit_id, s, page, line_no, lower(regexp_replace(line, '[\\s\\p{{Z}}\\x{{0085}}\\x{{000B}}\\x{{001C}}-\\x{{001F}}0-9]', '', 'g')) AS key FROM l),
f AS (SELECT s, key FROM k JOIN n USING (s) WHERE regexp_matches(key, '\\p{{L}}') GROUP BY s, key, n HAVING count(DISTINCT hit_id) * 5 >= n AND count(DISTINCT page) >= 5)
SELECT hit_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN f USING (s, key)"""


SQL["p1_collapsed"] = SQL["p1_found"].replace("SELECT rec, keep AS keep_id, id AS copy_id FROM g WHERE keep < id", """,
alone AS (SELECT 'docs' AS rec, hit_id AS id FROM docs WHERE hit_id NOT IN (SELECT id FROM g WHERE rec = 'docs'))
SELECT rec, id, count(*) AS n_copies FROM (SELECT rec, keep AS id FROM g UNION ALL SELECT rec, id FROM alone) GROUP BY ALL""")

SQL["p6_cleaned"] = SQL["p6_found"].replace("SELECT hit_id, CAST(line_no AS BIGINT) AS line_no FROM k JOIN f USING (s, key)", """,
r AS (SELECT hit_id, line_no FROM k JOIN f USING (s, key)),
w AS (SELECT hit_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM (SELECT hit_id, string_split(body, chr(10)) AS parts FROM docs WHERE body IS NOT NULL)),
c AS (SELECT hit_id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.hit_id = w.hit_id AND r.line_no = w.line_no) GROUP BY hit_id)
SELECT d.hit_id, CASE WHEN d.body IS NOT NULL THEN coalesce(c.body, '') END AS body FROM docs d LEFT JOIN c ON d.hit_id = c.hit_id""")

_TRUST = "greatest(CASE WHEN list_contains(map_keys(sources), 'parallel') THEN 2 ELSE 0 END, CASE WHEN list_contains(map_keys(sources), 'doubao') THEN 1 ELSE 0 END)"
SQL["p4_survivors"] = SQL["p4_found"].replace("SELECT merged_id, query_id, page, sources,", f"SELECT merged_id, query_id, page, sources, body, publish, title, authority, coalesce({_TRUST}, 0) AS trust, epoch_us(merged_at) AS moment,").replace(
    "FROM m GROUP BY ALL HAVING", ", " + ", ".join(
        f"arg_max(struct_pack(v := {c}), (trust, moment, -merged_id)) FILTER (WHERE {known}) AS best_{c}"
        for c, known in (("body", "size > 0"), ("publish", "day IS NOT NULL"), ("title", strip_sql("title") + " <> ''"), ("authority", "authority IS NOT NULL"))
    ) + " FROM m GROUP BY query_id, page HAVING"
).replace("coalesce(s.k, '') AS sources_key FROM g", "coalesce(s.k, '') AS sources_key, g.query_id, g.page, best_body.v AS body, best_publish.v AS publish, best_title.v AS title, best_authority.v AS authority FROM g")


@_query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec, keep_id, copy_id`` of every hit and merged record written again."""
    docs, merged = table(spark, sf_dir, "docs"), table(spark, sf_dir, "merged")
    return find_copies(docs, merged, docs.count() + merged.count())


@_query
def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec, id, n_copies``: every hit and merged record once."""
    docs, merged = table(spark, sf_dir, "docs"), table(spark, sf_dir, "merged")
    return collapse(docs, merged, materialize(p1_found(spark, sf_dir), "copies"))


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``group_id, body_id, publish_id, sources_key`` of every page with several records."""
    return survivors(table(spark, sf_dir, "merged"))


@_query
def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every page with several records, with its values."""
    return survivors(table(spark, sf_dir, "merged"), with_values=True)


@_query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hit_id, line_no`` of every line that its site repeats."""
    docs, sites = table(spark, sf_dir, "docs"), table(spark, sf_dir, "sites")
    lines = numbered_lines(docs, sites)
    return repeated_lines(docs, sites, prefix_span(docs, sites, lines=lines), lines)


@_query
def p6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frequent sequences of lines of each site: length, identifiers, rows that hold them."""
    return prefix_span(table(spark, sf_dir, "docs"), table(spark, sf_dir, "sites")).withColumn(
        "items", F.transform("items", lambda x: F.concat(F.lower(F.hex(x["a"])), F.lower(F.hex(x["b"]))))
    )


@_query
def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hit_id, body`` of every hit, without the lines its site repeats."""
    docs, sites = table(spark, sf_dir, "docs"), table(spark, sf_dir, "sites")
    return without_repeated(docs, sites, prefix_span(docs, sites))


@_query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hit_id`` of every hit whose body was cut off."""
    docs = table(spark, sf_dir, "docs")
    return truncated(docs, docs.count())


@_query
def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source and site cuts."""
    docs = table(spark, sf_dir, "docs")
    sites = docs.select("hit_id", "source", site_of(F.col("site"), F.col("url")).alias("site"))
    return truncation_rates(sites, truncated(docs, docs.count()))


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hit_id, line_no`` of every line around the article."""
    docs = table(spark, sf_dir, "docs")
    return main_body(docs, docs.count())


@_query
def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hit_id, body`` of every hit, the article's lines only."""
    docs = table(spark, sf_dir, "docs")
    return main_body(docs, docs.count(), emit="bodies")


@_query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents in containers of each budget's capacity."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "budgets"))


@_query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    budgets = table(spark, sf_dir, "budgets")
    return fill_rates(pack(table(spark, sf_dir, "documents"), budgets), budgets)


@_query
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text of documents stands in the mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@_query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens each source reaches in the mix."""
    targets = table(spark, sf_dir, "mix_targets")
    return reached_shares(mix(table(spark, sf_dir, "documents"), targets), targets)


@_query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pii_type, start_pos, end_pos`` of each mention in the texts."""
    return find_pii(table(spark, sf_dir, "documents"))


@_query
def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with typed placeholders."""
    return redact_pii(table(spark, sf_dir, "documents"))
