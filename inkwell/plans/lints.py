"""Queries of the lints, the passages and the rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.views import clean_text
from inkwell.operators.lint import exit_state, lint_hits, lint_metrics, lint_stats, lint_totals, top_rules
from inkwell.operators.passages import passage_units, selected_passages
from inkwell.operators.render import fetched, render, resolve_budget
from inkwell.operators.typography import at_level, findings
from inkwell.functions import config as C
from inkwell.operators import measures as M
from inkwell.operators.evaluate import manifest_sums
from inkwell.operators.joins import not_skipped
from inkwell.operators.rules import GENRES, MANUAL, genre_skips, rule_ids, words
from inkwell.operators.store import fingerprint_of
from inkwell.plans.merging import _ranked
from inkwell.plans.registry import query
from inkwell.session import materialize, table
from inkwell.sources import adapters as A


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("lint_hits")
def _hits(spark: SparkSession, d: str) -> DataFrame:
    return lint_hits(_docs(spark, d))


@query("lint_metrics")
def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return lint_metrics(_docs(spark, d))


@query("lint_stats")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return lint_stats(_docs(spark, d))


@query("severity_totals")
def _totals(spark: SparkSession, d: str) -> DataFrame:
    return exit_state(lint_totals(_docs(spark, d)), "high")


@query("rule_counts")
def _counts(spark: SparkSession, d: str) -> DataFrame:
    return lint_hits(_docs(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("texts"))


@query("typography_findings")
def _typography(spark: SparkSession, d: str) -> DataFrame:
    return findings(_docs(spark, d))


@query("typography_errors")
def _errors(spark: SparkSession, d: str) -> DataFrame:
    return at_level(findings(_docs(spark, d)), "error").groupBy("doc_id").agg(F.count(F.lit(1)).alias("errors"))


@query("clean_text")
def _clean(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b.assign(body=[clean_text(t) for t in b["body"]])

    return table(spark, d, "docs").select("hit_id", "body").mapInPandas(run, "hit_id bigint, body string")


@query("passage_units")
def _units(spark: SparkSession, d: str) -> DataFrame:
    return passage_units(table(spark, d, "docs"))


@query("select_passages")
def _select(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "questions").select(F.col("id").alias("query_id"), F.col("q").alias("query")).dropDuplicates(["query_id"])
    return selected_passages(table(spark, d, "docs").select("hit_id", "query_id", "body").join(questions, "query_id", "left"), 400)


@query("render_budgeted")
def _render(spark: SparkSession, d: str) -> DataFrame:
    ranked = materialize(_ranked(spark, d).drop("images"), "ranked")
    return render(ranked, table(spark, d, "questions"), 8000, table(spark, d, "source_calls"), docs=table(spark, d, "docs"))


@query("render_images")
def _images(spark: SparkSession, d: str) -> DataFrame:
    ranked = materialize(_ranked(spark, d), "ranked")
    return render(ranked, table(spark, d, "questions"), 8000, images=True)


@query("render_fetched")
def _fetched(spark: SparkSession, d: str) -> DataFrame:
    return fetched(A.extract_pages(_recorded(spark, d, "parallel"), 12000), 12000)


@query(
    "resolve_budget",
    """SELECT doc_id, CAST(CASE profile WHEN 'compact' THEN 8000 WHEN 'full' THEN 30000 ELSE 15000 END AS INTEGER) AS budget FROM documents""",
)
def _budget(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return _docs(spark, d).select("doc_id", resolve_budget(F.lit(None).cast("int"), F.col("profile"), none).alias("budget"))


@query(
    "keywords",
    """SELECT id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE [substr(trim(coalesce(objective, '')), 1, 120)] END, '|') AS words FROM (
    SELECT id, objective, list_filter(list_transform(pq, lambda x: trim(x)), lambda x: x <> '')[1:5] AS k FROM questions)""",
)
def _keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("id", F.array_join(A.keywords(F.col("pq"), F.col("objective")), "|").alias("words"))


def _recorded(spark: SparkSession, d: str, source: str) -> DataFrame:
    """Responses of a source as it would have sent them, from the hits it delivered."""
    docs = table(spark, d, "docs").where(F.col("source") == source)
    if source == "doubao":
        item = F.struct(
            F.col("rank").alias("_rank"), "hit_id", F.col("url").alias("Url"), F.col("title").alias("Title"), F.col("site").alias("SiteName"),
            F.col("body").alias("Summary"), F.col("publish").alias("PublishTime"), F.col("authority").cast("string").alias("AuthInfoLevel"),
            F.col("rank_score").cast("string").alias("RankScore"),
        )
        body = F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("WebResults")).alias("Result"))
    else:
        item = F.struct(
            F.col("rank").alias("_rank"), "hit_id", "url", "title", F.col("publish").alias("publish_date"),
            F.filter(F.split("body", "\n"), lambda x: x != "").alias("excerpts"),
        )
        body = F.struct(F.array_sort(F.collect_list(item)).alias("results"))
    return docs.groupBy("query_id").agg(F.to_json(body).alias("raw"))


_PLACE = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, hit_id) AS INTEGER)"
_EXCERPTS = "coalesce(array_to_string(list_filter(string_split(body, chr(10)), lambda x: x <> ''), chr(10)), '')"


@query(
    "map_first_source",
    f"""SELECT query_id, {_PLACE} AS rank, coalesce(url, '') AS url, coalesce(title, '') AS title, md5(coalesce(body, '')) AS body_md5, publish,
    CASE WHEN authority BETWEEN 1 AND 4 THEN authority END AS authority FROM docs WHERE source = 'doubao'""",
)
def _first(spark: SparkSession, d: str) -> DataFrame:
    return A.map_first(_recorded(spark, d, "doubao")).select("query_id", "rank", "url", "title", F.md5("body").alias("body_md5"), "publish", "authority")


@query(
    "map_second_source",
    f"""SELECT query_id, {_PLACE} AS rank, coalesce(url, '') AS url, coalesce(title, '') AS title, md5({_EXCERPTS}) AS body_md5, publish FROM docs WHERE source = 'parallel'""",
)
def _second(spark: SparkSession, d: str) -> DataFrame:
    return A.map_second(_recorded(spark, d, "parallel")).select("query_id", "rank", "url", "title", F.md5("body").alias("body_md5"), "publish")


@query(
    "extract_pages",
    f"""WITH p AS (SELECT query_id, {_PLACE} AS place, url, title, publish, {_EXCERPTS} AS body FROM docs WHERE source = 'parallel'),
    n AS (SELECT query_id, least(count(*), 20) AS n FROM p GROUP BY query_id)
    SELECT p.query_id, place, url, title, publish, substr(body, 1, greatest(CAST(floor(12000 / n) AS INTEGER), 500)) AS content
    FROM p JOIN n ON p.query_id IS NOT DISTINCT FROM n.query_id WHERE place <= 20""",
)
def _pages(spark: SparkSession, d: str) -> DataFrame:
    return A.extract_pages(_recorded(spark, d, "parallel"), 12000)


@query(
    "call_warnings",
    "SELECT call_id, w AS warning FROM (SELECT call_id, unnest(warnings) AS w FROM source_calls)",
)
def _warnings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_calls").select("call_id", F.explode("warnings").alias("warning"))


@query(
    "call_errors",
    "SELECT call_id AS query_id, CASE WHEN error IS NOT NULL THEN regexp_replace(error, '^([^ ]+) ?(.*)$', '\\1: \\2') END AS error FROM source_calls",
)
def _call_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors as the first source would report them, read back from its response."""
    parts = F.split("error", " ", 2)
    told = F.struct(F.get(parts, F.lit(0)).alias("Code"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("Message"))
    meta = F.struct(F.when(F.col("error").isNotNull(), told).alias("Error"))
    raw = F.to_json(F.struct(meta.alias("ResponseMetadata"), F.struct(F.lit("0").alias("ErrorCode")).alias("Result")))
    calls = table(spark, d, "source_calls").select(F.col("call_id").alias("query_id"), raw.alias("raw"))
    return A.source_errors(calls)


@query(
    "response_warnings",
    "SELECT query_id, unnest(warnings) AS warning FROM source_calls WHERE source = 'parallel' UNION ALL SELECT query_id, 'failed ' || error FROM source_calls WHERE source = 'parallel' AND error IS NOT NULL",
)
def _response_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings and failed addresses of the second source, read back from its responses."""
    failed = F.when(F.col("error").isNotNull(), F.array(F.struct(F.col("error").alias("url"), F.lit("failed").alias("error_type"))))
    calls = table(spark, d, "source_calls").where("source = 'parallel'")
    return A.source_warnings(calls.select("query_id", F.to_json(F.struct("warnings", failed.alias("errors"))).alias("raw")))


@query(
    "first_requests",
    """SELECT id, substr(trim(q), 1, 100) AS query, CAST(greatest(least(len(checks) * 20, 50), 1) AS INTEGER) AS count,
    CASE WHEN len(pq) > 0 THEN array_to_string(pq[1:20], '|') END AS sites FROM questions WHERE q IS NOT NULL""",
)
def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the first source, read back from their JSON."""
    none = F.array().cast("array<string>")
    raw = A.build_request(F.col("q"), (F.size("checks") * 20).cast("int"), F.coalesce("pq", none), none)
    got = F.from_json(raw, "struct<query:string,count:int,sites:string>")
    return table(spark, d, "questions").where("q is not null").select("id", got.alias("r")).select("id", "r.query", "r.count", "r.sites")


@query(
    "second_requests",
    """SELECT id, trim(coalesce(nullif(trim(objective), ''), q)) AS objective, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE [substr(trim(coalesce(objective, '')), 1, 120)] END, '|') AS queries,
    CASE WHEN len(checks) > 0 THEN NULL ELSE 'x.test' END AS exclude_domains, 20 AS max_results FROM (SELECT *, list_filter(list_transform(pq, lambda x: trim(x)), lambda x: x <> '')[1:5] AS k FROM questions) WHERE q IS NOT NULL""",
)
def _second_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the second source, read back from their JSON; domains to include make those to exclude idle."""
    q = table(spark, d, "questions").where("q is not null")
    raw = A.build_second(A.text_or("objective", "q"), A.keywords(F.col("pq"), F.col("objective")), F.col("checks"), F.array(F.lit("x.test")), F.lit(40))
    got = F.from_json(raw, "struct<objective:string,search_queries:array<string>,max_results:int,source_policy:struct<include_domains:array<string>,exclude_domains:array<string>>>")
    return q.select("id", got.alias("r")).select(
        "id", "r.objective", F.array_join("r.search_queries", "|").alias("queries"), F.array_join("r.source_policy.exclude_domains", "|").alias("exclude_domains"), "r.max_results"
    )


@query(
    "argument_errors",
    """SELECT call_id, CASE WHEN coalesce(trim(query_id), '') = '' THEN 'empty query' WHEN n_docs < 1 THEN 'count below 1' WHEN source = 'parallel' AND call_id % 7 = 0 THEN 'no images from this source'
    WHEN call_id % 5 = 0 THEN 'no such time range' END AS error FROM source_calls""",
)
def _arguments(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("call_id") % 7 == 0, "image").otherwise("web")
    span = F.when(F.col("call_id") % 5 == 0, "2026-02-30..2026-03-01").otherwise("OneWeek")
    none = F.lit(None)
    error = A.argument_error(F.col("query_id"), F.col("n_docs"), none.cast("int"), F.col("source"), kind, span, none.cast("string"))
    return table(spark, d, "source_calls").select("call_id", error.alias("error"))


@query(
    "query_overrides",
    """SELECT id, substr(CASE WHEN coalesce(trim(objective), '') <> '' THEN trim(objective) ELSE trim(coalesce(q, '')) END, 1, 100) AS query FROM questions""",
)
def _overrides(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("id", F.substring(F.coalesce(A.text_or("objective", "q"), F.lit("")), 1, A.QUERY_CHARS).alias("query"))


@query(
    "cache_fingerprints",
    r"""SELECT call_id, substr(sha256('{"source":"' || source || '","request":{' || array_to_string(list_transform(list_sort(list_filter(json_keys(request), lambda k: k NOT IN ('session_id', 'transport', 'block_hosts'))),
    lambda k: '"' || k || '":"' || replace(replace(json_extract_string(request, '$.' || k), '', '\'), '"', '"') || '"'), ',') || '}}'), 1, 32) AS key FROM source_calls WHERE request IS NOT NULL""",
)
def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "source_calls").where("request is not null")
    return calls.select("call_id", fingerprint_of(F.col("source"), F.col("request")).alias("key"))


@query(
    "lexicon_hits",
    " UNION ALL ".join(
        f"SELECT doc_id, '{rule}' AS rule, CAST(len(regexp_extract_all(text, '{M.either(own)}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{M.either(own)}')"
        for rule, own in words().items()
    ),
)
def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return M.word_counts(_docs(spark, d), "doc_id", F.col("text"), words())


@query(
    "top_rules",
    "SELECT doc_id, rule, n, place FROM (SELECT doc_id, rule, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rule) AS INTEGER) AS place FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{rule}' AS rule, CAST(len(regexp_extract_all(text, '{M.either(own)}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '{M.either(own)}')"
        for rule, own in words().items()
    )
    + ")) WHERE place <= 6",
)
def _top_rules(spark: SparkSession, d: str) -> DataFrame:
    return top_rules(M.word_counts(_docs(spark, d), "doc_id", F.col("text"), words()), "doc_id")


@query(
    "manual_rules",
    f"""WITH r(rule) AS (VALUES {", ".join(f"('{r}')" for r in MANUAL)}), s(genre, skip) AS (VALUES {", ".join(f"('{g}', '{x}')" for g, v in GENRES.items() for x in v["skip"])}),
    g(genre) AS (VALUES {", ".join(f"('{g}')" for g in GENRES)}) SELECT genre, rule FROM g, r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.genre = g.genre AND (r.rule = s.skip OR starts_with(r.rule, s.skip || '_')))""",
)
def _manual(spark: SparkSession, d: str) -> DataFrame:
    """Rules left to people, under each genre that does not skip them."""
    every = not_skipped(rule_ids(spark), genre_skips(spark), "rule", "skip", "genre")
    return every.where(F.col("rule").isin(*MANUAL)).select("genre", "rule")


@query(
    "card_kinds",
    """SELECT query_id, string_agg(k, ' / ' ORDER BY r, k) AS kinds FROM (SELECT query_id, k, min(rank) AS r FROM (SELECT query_id, rank, extra['ruyi'] AS k FROM docs) WHERE coalesce(k, '') <> '' GROUP BY query_id, k) GROUP BY query_id""",
)
def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of structured answers of each query, in the order in which they come."""
    kind = F.try_element_at("extra", F.lit("ruyi"))
    each = table(spark, d, "docs").select("query_id", "rank", kind.alias("k")).where("k <> ''").groupBy("query_id", "k").agg(F.min("rank").alias("r"))
    kinds = F.array_sort(F.collect_list(F.struct("r", "k")))
    return each.groupBy("query_id").agg(F.array_join(F.transform(kinds, lambda x: x["k"]), " / ").alias("kinds"))


@query(
    "manifest_sums",
    "SELECT source, cached, count(*) AS runs, CAST(sum(n_docs) AS BIGINT) AS results, round(sum(elapsed), 6) AS seconds FROM source_calls GROUP BY ALL",
)
def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest_sums(table(spark, d, "source_calls"), ["source", "cached"], "n_docs", "elapsed")


@query(
    "config_counts",
    """SELECT call_id, CASE WHEN regexp_full_match(c, '-?[0-9]+') AND try_cast(c AS BIGINT) BETWEEN 1 AND 30 THEN CAST(c AS BIGINT) ELSE 10 END AS count FROM (SELECT call_id, json_extract_string(request, '$.count') AS c FROM source_calls)""",
)
def _counts_of(spark: SparkSession, d: str) -> DataFrame:
    """A number of the configuration within its bounds, else its default."""
    return table(spark, d, "source_calls").select("call_id", C.whole_number(F.get_json_object("request", "$.count"), 1, 30, 10).alias("count"))
