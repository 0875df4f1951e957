"""Queries on joins, sets, windows, the cache and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.operators.evaluate import ab_pairs, invalid_labels, score_noise
from inkwell.operators.joins import asof_lookup, longest_run, not_skipped, outside_spans
from inkwell.operators.rules import builtin_rules, genre_skips, rule_ids
from inkwell.operators.store import cache_key, fresh_entries, keep_newest, put, session_of
from inkwell.plans.registry import query
from inkwell.session import table


@query(
    "dim_lookup_join",
    """SELECT n_name, r_name, count(*) AS customers, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS building,
    round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def _dim(spark: SparkSession, d: str) -> DataFrame:
    # No hint: the optimizer broadcasts a dimension if its size is below the threshold.
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("n_name", "r_name").agg(
        F.count(F.lit(1)).alias("customers"), F.sum((F.col("c_mktsegment") == "BUILDING").cast("bigint")).alias("building"),
        F.round(F.sum("c_acctbal"), 2).alias("balance"),
    )


@query(
    "source_quality",
    """SELECT s.source, count(*) AS calls, CAST(sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(n_docs) AS BIGINT) AS docs,
    round(avg(elapsed), 6) AS elapsed, CAST(max(n) AS BIGINT) AS delivered FROM source_calls s
    LEFT JOIN (SELECT source, count(*) AS n FROM docs GROUP BY source) x ON s.source = x.source GROUP BY s.source""",
)
def _quality(spark: SparkSession, d: str) -> DataFrame:
    delivered = table(spark, d, "docs").groupBy("source").agg(F.count(F.lit(1)).alias("delivered"))
    calls = table(spark, d, "source_calls").groupBy("source").agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"), F.sum(F.col("n_docs").cast("bigint")).alias("docs"),
        F.round(F.avg("elapsed"), 6).alias("elapsed"),
    )
    return calls.join(delivered, "source", "left")


@query(
    "source_cube",
    """SELECT source, authority, count(*) AS hits, count(DISTINCT query_id) AS queries, CAST(grouping_id(source, authority) AS BIGINT) AS level FROM docs GROUP BY CUBE (source, authority)""",
)
def _cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").cube("source", "authority").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("query_id").alias("queries"), F.grouping_id("source", "authority").alias("level")
    )


@query(
    "matched_semi",
    "SELECT hit_id, query_id FROM docs d WHERE EXISTS (SELECT 1 FROM noise_labels l WHERE l.id = CAST(d.hit_id AS VARCHAR) AND l.relevant)",
)
def _semi(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "noise_labels").where("relevant").select(F.col("id").try_cast("bigint").alias("hit_id"))
    return table(spark, d, "docs").select("hit_id", "query_id").join(labels, "hit_id", "left_semi")


@query("unanswered_anti", "SELECT id, category FROM questions q WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.query_id = q.id)")
def _anti(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").select(F.col("query_id").alias("id"))
    return table(spark, d, "questions").select("id", "category").join(docs, "id", "left_anti")


@query(
    "short_circuit",
    """SELECT c.query_id, c.call_id FROM source_calls c WHERE c.source = 'parallel' AND NOT EXISTS
    (SELECT 1 FROM source_calls o WHERE o.query_id = c.query_id AND o.source = 'doubao' AND o.n_docs >= 10 AND o.error IS NULL)""",
)
def _short(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "source_calls")
    enough = calls.where("source = 'doubao' and n_docs >= 10 and error is null").select("query_id")
    return calls.where("source = 'parallel'").select("query_id", "call_id").join(enough, "query_id", "left_anti")


def _values(rows: list[tuple[str, ...]]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


_RULES = builtin_rules()
_EVERY = [(g, r) for g in _RULES["genres"] for part in ("lexicon", "regex_rules", "metrics", "manual_rules") for r in _RULES[part]]
_SKIPS = [(g, s) for g, v in _RULES["genres"].items() for s in v["skip"]]


@query(
    "genre_skip_anti",
    f"""WITH r(genre, rule) AS ({_values(_EVERY)}), s(genre, skip) AS ({_values(_SKIPS)})
    SELECT genre, rule FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.genre = r.genre AND (r.rule = s.skip OR starts_with(r.rule, s.skip || '_')))""",
)
def _skip(spark: SparkSession, d: str) -> DataFrame:
    return not_skipped(rule_ids(spark), genre_skips(spark), "rule", "skip", "genre")


def _offsets(pattern: str) -> str:
    """SQL of ``doc_id, a, b``: the places of a pattern in the texts."""
    return f"""SELECT doc_id, a, a + length(m[i]) AS b FROM (SELECT doc_id, m, i, list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents)))"""


@query(
    "interval_containment_anti",
    f"""WITH h AS ({_offsets("[0-9]{2}")}), s AS ({_offsets("[0-9]{4}-[0-9]{2}-[0-9]{2}")})
    SELECT doc_id, count(*) AS outside FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = h.doc_id AND s.a <= h.a AND h.b <= s.b) GROUP BY doc_id""",
)
def _interval(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.functions.spans import find_spans

    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = docs.select("doc_id", F.explode(find_spans(F.col("text"), "[0-9]{2}")).alias("s")).select("doc_id", "s.start", "s.end")
    spans = docs.select("doc_id", find_spans(F.col("text"), "[0-9]{4}-[0-9]{2}-[0-9]{2}").alias("spans"))
    return outside_spans(hits, spans, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("outside"))


@query(
    "asof_cache_lookup",
    """SELECT d.hit_id, CASE WHEN epoch_us(d.fetched_at) - epoch_us(c.called_at) <= 1800000000 THEN c.call_id END AS found
    FROM docs d ASOF LEFT JOIN (SELECT query_id, source, called_at, max(call_id) AS call_id FROM source_calls GROUP BY ALL) c
    ON d.query_id || '/' || d.source = c.query_id || '/' || c.source AND d.fetched_at >= c.called_at""",
)
def _asof(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", "query_id", "source")
    asks = table(spark, d, "docs").select("hit_id", "fetched_at", key.alias("key"))
    calls = table(spark, d, "source_calls").select(key.alias("key"), "called_at", "call_id")
    calls = calls.groupBy("key", "called_at").agg(F.max("call_id").alias("call_id"))
    return asof_lookup(asks, calls, "key", "fetched_at", "called_at", 1800, "call_id").select("hit_id", "found")


@query("union_sources", "SELECT query_id, url, title FROM docs WHERE source = 'doubao' UNION ALL SELECT query_id, url, title FROM docs WHERE source = 'parallel'")
def _union(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.merge import union_sources

    docs = table(spark, d, "docs").select("query_id", "url", "title", "source")
    return union_sources(docs.where("source = 'doubao'"), docs.where("source = 'parallel'")).select("query_id", "url", "title")


@query("set_intersect", "SELECT query_id FROM docs INTERSECT SELECT query_id FROM merged")
def _intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("query_id").intersect(table(spark, d, "merged").select("query_id"))


@query("set_except", "SELECT id FROM questions EXCEPT SELECT query_id FROM merged")
def _except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("id").subtract(table(spark, d, "merged").select(F.col("query_id").alias("id")))


@query(
    "ordered_distinct",
    """WITH p AS (SELECT id, list_concat(pq, checks) AS l FROM questions), o AS (SELECT id, l, list_filter(range(1, len(l) + 1), lambda k: list_position(l, l[k]) = k) AS first FROM p)
    SELECT id, array_to_string(list_transform(first, lambda k: l[k]), ',') AS parts, CAST(len(first) AS BIGINT) AS n FROM o""",
)
def _distinct(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array_distinct(F.concat("pq", "checks"))
    return table(spark, d, "questions").select("id", F.array_join(parts, ",").alias("parts"), F.size(parts).cast("bigint").alias("n"))


@query(
    "cache_ttl",
    """SELECT call_id FROM source_calls WHERE epoch_us(TIMESTAMPTZ '2026-09-01 00:00:00+00') - epoch_us(called_at) < 1296000000000
    AND called_at <= TIMESTAMPTZ '2026-09-01 00:00:00+00'""",
)
def _ttl(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-09-01T00:00:00Z").cast("timestamp")
    calls = table(spark, d, "source_calls").where(F.col("called_at") <= now)
    return fresh_entries(calls, "called_at", now, 15 * 86400).select("call_id")


@query(
    "cache_keys",
    r"""SELECT substr(sha256('{"source":"' || source || '","request":"' || replace(replace(request, '\', '\\'), '"', '\"') || '"}'), 1, 32) AS key,
    count(*) AS calls, max(epoch_us(called_at)) AS written_us FROM source_calls GROUP BY ALL""",
)
def _keys(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "source_calls")
    return calls.groupBy(cache_key(F.col("source"), F.col("request")).alias("key")).agg(F.count(F.lit(1)).alias("calls"), F.max(F.unix_micros("called_at")).alias("written_us"))


@query(
    "retention_keep_n",
    """SELECT source, call_id FROM (SELECT source, call_id, row_number() OVER (PARTITION BY source ORDER BY called_at DESC, call_id DESC) AS k FROM source_calls) WHERE k <= 50""",
)
def _keep(spark: SparkSession, d: str) -> DataFrame:
    return keep_newest(table(spark, d, "source_calls"), ["source"], "called_at", "call_id", 50).select("source", "call_id")


_NOISY = "coalesce(stale, false) OR coalesce(navigation, false) OR NOT coalesce(relevant, false)"


@query(
    "score_noise",
    f"""SELECT d.source, count(*) AS n, CAST(sum(visible_chars) AS BIGINT) AS chars, round(avg(CASE WHEN coalesce(relevant, false) THEN 1.0 ELSE 0.0 END), 9) AS precision,
    round(avg(CASE WHEN {_NOISY} THEN 1.0 ELSE 0.0 END), 9) AS noise_rate,
    round(sum(CASE WHEN {_NOISY} THEN visible_chars ELSE 0 END) / nullif(sum(visible_chars), 0), 9) AS noisy_char_share,
    CAST(sum(CASE WHEN stale THEN 1 ELSE 0 END) AS BIGINT) AS stale, CAST(sum(CASE WHEN navigation THEN 1 ELSE 0 END) AS BIGINT) AS navigation
    FROM noise_labels l JOIN docs d ON l.id = CAST(d.hit_id AS VARCHAR) GROUP BY d.source""",
)
def _noise(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").select(F.col("hit_id").cast("string").alias("id"), "source")
    return score_noise(table(spark, d, "noise_labels").join(docs, "id"), ["source"])


@query(
    "invalid_labels",
    "SELECT id, CASE WHEN n > 1 THEN 'repeated id' ELSE 'no characters' END AS why FROM (SELECT id, count(*) AS n, max(visible_chars) AS c FROM noise_labels GROUP BY id) WHERE n > 1 OR c <= 0",
)
def _invalid(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "docs").select(F.col("hit_id").cast("string").alias("id"))
    return invalid_labels(table(spark, d, "noise_labels"), known)


@query(
    "ab_pairs",
    """SELECT b.query_id, b.n AS baseline, c.n AS candidate, CASE WHEN c.n > b.n THEN 'win' WHEN c.n < b.n THEN 'loss' ELSE 'tie' END AS outcome
    FROM (SELECT query_id, count(*) AS n FROM docs WHERE source = 'doubao' GROUP BY query_id) b
    JOIN (SELECT query_id, count(*) AS n FROM docs WHERE source = 'parallel' GROUP BY query_id) c USING (query_id)""",
)
def _ab(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "docs").groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return ab_pairs(n.where("source = 'doubao'"), n.where("source = 'parallel'"), "query_id", "n")


@query(
    "prefix_admission",
    """WITH c AS (SELECT query_id, source, hit_id, row_number() OVER w AS pos, sum(length(coalesce(title, '')) + 20) OVER w AS used
    FROM docs WINDOW w AS (PARTITION BY query_id, source ORDER BY rank, hit_id)),
    f AS (SELECT query_id, source, min(pos) AS stop FROM c WHERE used > 150 GROUP BY ALL)
    SELECT c.query_id, c.source, c.hit_id FROM c LEFT JOIN f ON c.query_id IS NOT DISTINCT FROM f.query_id AND c.source = f.source WHERE c.pos = 1 OR f.stop IS NULL OR c.pos < f.stop""",
)
def _admission(spark: SparkSession, d: str) -> DataFrame:
    from inkwell.operators.render import admit_prefix

    docs = table(spark, d, "docs").withColumn("cost", F.char_length(F.coalesce("title", F.lit(""))) + 20)
    return admit_prefix(docs, ["query_id", "source"], ["rank", "hit_id"], "cost", F.lit(150)).select("query_id", "source", "hit_id")


@query(
    "rank_gaps",
    """SELECT query_id, source, min(rank) AS run_start, CAST(count(*) AS BIGINT) AS run_length FROM (
    SELECT query_id, source, rank, rank - row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS g FROM (SELECT DISTINCT query_id, source, rank FROM docs)) GROUP BY query_id, source, g""",
)
def _gaps(spark: SparkSession, d: str) -> DataFrame:
    ranks = table(spark, d, "docs").select("query_id", "source", "rank").distinct()
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    runs = ranks.withColumn("g", F.col("rank") - F.row_number().over(w))
    return runs.groupBy("query_id", "source", "g").agg(F.min("rank").alias("run_start"), F.count(F.lit(1)).alias("run_length")).drop("g")


@query(
    "late_runs",
    """WITH e AS (SELECT source, call_id, error IS NOT NULL AS f FROM source_calls), r AS (SELECT source, call_id, f,
    row_number() OVER (PARTITION BY source ORDER BY call_id) - sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY call_id) AS g FROM e)
    SELECT source, min(call_id) AS run_start, count(*) AS run_length FROM r WHERE f GROUP BY source, g""",
)
def _late(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "source_calls").groupBy("source", "call_id").agg(F.max(F.col("error").isNotNull()).alias("failed"))
    return longest_run(calls, ["source"], "call_id", F.col("failed"))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
)
def _pricing(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")
    )


@query(
    "orders_by_nation",
    """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "cache_put",
    """SELECT query_id, source, max(epoch_us(called_at)) AS called_us, arg_max(call_id, (called_at, call_id)) AS call_id FROM source_calls GROUP BY query_id, source""",
)
def _put(spark: SparkSession, d: str) -> DataFrame:
    """A cache of the first half of all calls, with the other half put in."""
    calls = table(spark, d, "source_calls").select("query_id", "source", "called_at", "call_id")
    calls = calls.withColumn("key", F.struct("query_id", "source"))
    even = F.col("call_id") % 2 == 0
    return put(calls.where(even), calls.where(~even), "key", "called_at").select("query_id", "source", F.unix_micros("called_at").alias("called_us"), "call_id")


@query(
    "call_sessions",
    "SELECT call_id, CASE WHEN error IS NULL AND NOT coalesce(cached, false) THEN 'new-' || call_id WHEN cached THEN session_id END AS session FROM source_calls",
)
def _sessions(spark: SparkSession, d: str) -> DataFrame:
    made = F.concat(F.lit("new-"), F.col("call_id").cast("string"))
    return table(spark, d, "source_calls").select("call_id", session_of(F.col("error").isNull(), F.col("cached"), made, F.col("session_id")).alias("session"))
