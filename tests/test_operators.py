"""Joins, store, evaluation, sources, streams and the entry file."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from inkwell.functions import spans as S
from inkwell.functions import text as T
from inkwell.operators.evaluate import ab_pairs, invalid_labels, score_noise
from inkwell.operators.joins import asof_lookup, longest_run, not_skipped, outside_spans
from inkwell.operators.render import admit_prefix, resolve_budget
from inkwell.operators.skew import lookup_join
from inkwell.operators.store import cache_key, fresh_entries, keep_newest, put, session_of
from inkwell.sources import adapters as A


def test_spans(spark):
    df = spark.createDataFrame([("a1b22\U0001f600c333",), ("",), (None,)], "t string")
    got = df.select(S.find_spans(F.col("t"), "[0-9]+").alias("s"), S.mask_spans(F.col("t"), "[0-9]+").alias("m")).collect()
    assert [(x.start, x.end, x.matched) for x in got[0].s] == [(1, 2, "1"), (3, 5, "22"), (7, 10, "333")]
    assert (got[0].m, got[1].s, got[1].m, got[2].s) == ("a b  \U0001f600c   ", [], "", None)


def test_texts(spark):
    df = spark.createDataFrame([("第一句。第二句很长很长很长",), ("  短 ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.truncate(F.col("t"), 8)).collect()] == ["第一句。第二句很…", "短", ""]
    assert [r[0] for r in df.select(T.content_len(F.col("t"))).collect()] == [12, 1, 0]
    assert df.select(T.sentences(F.col("t"))).collect()[0][0] == ["第一句。", "第二句很长很长很长"]
    assert df.select(T.line_of(F.lit("a\nb"), F.lit(2)), T.column_of(F.lit("a\nb"), F.lit(2)), T.slugify(F.lit("  你好, World! "))).first()[:] == (2, 1, "你好-World")
    assert df.select(T.redact(F.lit("key abcdefgh1 k1 xk1"), ["abcdefgh1", "k1"]), T.defang(F.lit("<<<x＞＞＞"))).first()[:] == ("key [redacted] [redacted] xk1", "‹‹‹x›››")


def at(minute):
    return datetime(2026, 1, 1, 0, minute)


def test_asof(spark):
    asks = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(50)), (3, "b", at(1)), (4, None, at(1)), (5, "a", at(5))], "id int, key string, at timestamp")
    entries = spark.createDataFrame([("a", at(5), "x"), ("a", at(10), "y"), ("c", at(0), "z")], "key string, w timestamp, v string")
    got = asof_lookup(asks, entries, "key", "at", "w", 1800, "v").collect()
    assert sorted((r.id, r.found) for r in got) == [(1, "y"), (2, None), (3, None), (4, None), (5, "x")]


def test_small_joins(spark):
    rules = spark.createDataFrame([("g", "S7_a"), ("g", "S7"), ("g", "S70"), ("h", "S7_a")], "genre string, rule string")
    skips = spark.createDataFrame([("g", "S7")], "genre string, skip string")
    assert sorted(tuple(r) for r in not_skipped(rules, skips, "rule", "skip", "genre").collect()) == [("g", "S70"), ("h", "S7_a")]
    hits = spark.createDataFrame([(1, 0, 2), (1, 5, 9), (2, 0, 1)], "doc int, start int, end int")
    spans = spark.createDataFrame([(1, [(0, 4)])], "doc int, spans array<struct<start:int,end:int>>")
    assert sorted(tuple(r) for r in outside_spans(hits, spans, "doc").collect()) == [(1, 5, 9), (2, 0, 1)]
    runs = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True)], "k int, o int, f boolean")
    assert sorted(tuple(r) for r in longest_run(runs, ["k"], "o", F.col("f")).collect()) == [(1, 1, 2), (1, 4, 1)]


def test_lookup_join_hot_and_cold(spark):
    rows = spark.createDataFrame([(k, "hot" if k < 90 else f"k{k}") for k in range(100)] + [(100, None)], "id int, key string")
    lookup = spark.createDataFrame([("hot", 90, 1), ("k95", 1, 2), ("gone", 1, 3)], "key string, n int, v int")
    for least, twice in ((1, False), (1000, False), (1, True), (1000, True)):
        got = lookup_join(rows, lookup, ["key"], "n", 100, "id", least=least, twice=twice)
        assert got.columns == ["id", "key", "v"]
        assert sorted((r.v or 0) for r in got.collect()) == [0] * 10 + [1] * 90 + [2]


def test_store(spark):
    cache = spark.createDataFrame([("a", 1, at(0)), ("b", 2, at(20)), ("c", 3, None)], "key string, v int, w timestamp")
    assert [r.key for r in fresh_entries(cache, "w", F.lit("2026-01-01 00:30:00").cast("timestamp"), 1800).collect()] == ["b"]
    new = spark.createDataFrame([("a", 9, at(40))], "key string, v int, w timestamp")
    assert {r.key: r.v for r in put(cache, new, "key", "w").collect()} == {"a": 9, "b": 2, "c": 3}
    assert keep_newest(cache, ["key"], "w", "v", 0).count() == 3
    assert [r.key for r in keep_newest(cache.withColumn("g", F.lit(1)), ["g"], "w", "v", 1).collect()] == ["b"]
    k = cache.select(cache_key(F.array(F.lit("x"), F.lit("y"))), cache_key(F.array(F.lit("y"), F.lit("x")))).first()
    assert len(k[0]) == 32 and k[0] != k[1]
    flags = [F.lit(True), F.lit(False)]
    assert cache.select(*[session_of(s, c, F.lit("new"), F.lit("old")) for s in flags for c in flags]).first()[:] == ("old", "new", "old", None)


def test_admission_and_budget(spark):
    df = spark.createDataFrame([("a", 1, 99), ("a", 2, 1), ("b", 1, 2), ("b", 2, 9), ("b", 3, 1)], "g string, o int, cost int")
    assert sorted((r.g, r.o) for r in admit_prefix(df, ["g"], ["o"], "cost", F.lit(10)).collect()) == [("a", 1), ("b", 1)]
    none = F.lit(None).cast("string")
    assert df.select(resolve_budget(F.lit(5), F.lit("full"), none), resolve_budget(F.lit(0), F.lit("full"), none), resolve_budget(F.lit(None).cast("int"), F.lit("x"), F.lit("compact"))).first()[:] == (5, 30000, 8000)


def test_evaluation(spark):
    labels = spark.createDataFrame([("1", 10, True, False, True), ("2", 30, False, None, False), ("2", 30, True, False, False), ("9", 0, True, True, True)], "id string, visible_chars int, relevant boolean, stale boolean, navigation boolean")
    r = score_noise(labels.where("id <> '9'").withColumn("n", F.lit(1)), []).first()
    assert (r.n, r.chars, round(r.precision, 4), round(r.noise_rate, 4), round(r.noisy_char_share, 4)) == (3, 70, 0.6667, 0.6667, 0.5714)
    known = spark.createDataFrame([("1",), ("2",)], "id string")
    assert sorted(tuple(x) for x in invalid_labels(labels, known).collect()) == [("2", "repeated id"), ("9", "unknown id")]
    a, b = (spark.createDataFrame(x, "q string, v int") for x in ([("x", 1), ("y", 2), ("z", 3)], [("x", 2), ("y", 2), ("w", 1)]))
    assert sorted((r.q, r.outcome) for r in ab_pairs(a, b, "q", "v").collect()) == [("x", "win"), ("y", "tie")]


def test_adapters(spark):
    first = '{"Result":{"WebResults":[{"Url":"u","Title":null,"Summary":"","Content":"c","RankScore":"2","AuthInfoLevel":"5"},{"Url":"v","Summary":"s","RankScore":"0.5","AuthInfoLevel":"3"}]}}'
    bad = '{"ResponseMetadata":{"Error":{"Code":"10500","Message":"busy"}}}'
    second = '{"results":[{"url":"u","title":"t","excerpts":["a","b"]}],"warnings":["w"],"errors":[{"url":"x","error_type":"timeout"}]}'
    df = spark.createDataFrame([("q1", first), ("q2", bad), ("q3", "no json"), ("q4", None)], "query_id string, raw string")
    assert [(r.url, r.title, r.body, r["rank"], r.authority, r.rank_score) for r in A.map_first(df).collect()] == [("u", "", "c", 1, None, None), ("v", "", "s", 2, 3, 0.5)]
    assert [r.error for r in A.source_errors(df).orderBy("query_id").collect()] == [None, "10500: busy", "empty result", "empty result"]
    two = spark.createDataFrame([("q", second)], "query_id string, raw string")
    assert A.map_second(two).first().body == "a\nb"
    assert sorted(r.warning for r in A.source_warnings(two).collect()) == ["timeout x", "w"]
    assert A.extract_pages(two, 100).first().content == "a\nb"
    got = two.select(A.build_request(F.lit(" q "), F.lit(99), F.array(F.lit("s")), F.array(F.lit("b"))), A.keywords(F.array(F.lit(" "), F.lit("k")), F.lit("o"))).first()
    assert got[0] == '{"query":"q","count":50,"sites":"s"}' and got[1] == ["k"]


def test_text_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("x\r\ny")
    (tmp_path / "b.txt").write_text("no")
    assert [r.text for r in A.read_texts(spark, str(tmp_path)).collect()] == ["x\r\ny"]


def test_entry_and_some_queries(spark, tiny):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    for name in ("p5_found", "merge_by_url", "asof_cache_lookup", "typography_findings", "stream_tumbling", "render_budgeted"):
        assert queries[name](spark, tiny).count() > 0


def test_hits_outside_dates_where_digits_touch_a_date(spark, tmp_path):
    from __spark_entry__ import queries

    texts = ["12345-01-02 99", "2024-01-023 and 77", "2024-01-02", "on 2024-01-02 at 10", "1234567-01-02", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in enumerate(texts):
        dates = [m.span() for m in re.finditer("[0-9]{4}-[0-9]{2}-[0-9]{2}", text or "")]
        hits = [m.span() for m in re.finditer("[0-9]{2}", text or "")]
        if n := sum(not any(a <= s and e <= b for a, b in dates) for s, e in hits):
            want[k] = n
    got = queries()["interval_containment_anti"](spark, str(tmp_path))
    assert {r.doc_id: r.outside for r in got.collect()} == want and {0, 1, 4} & set(want)
