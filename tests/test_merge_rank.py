"""Merging and ranking on small tables: order, ties, nulls."""

import datetime

from pyspark.sql import functions as F

from inkwell.functions import dates as D
from inkwell.operators.merge import merge_by_body, merge_by_url, slim, with_bodies
from inkwell.operators.rank import rank, rrf, validate_scores

IMAGE = "array<struct<url:string,width:string,height:string,alt:string,shape:string,blur:string,watermark:string,style:string>>"
SCHEMA = (
    "hit_id bigint, query_id string, url string, title string, body string, site string, source string, rank int, publish string, authority int, "
    f"rank_score double, images {IMAGE}, extra map<string,string>, n_hits int, key string"
)


def hit(i, url, body, title="a title that is long", source="doubao", rank_=1, q="Q1", images=None):
    return (i, q, url, title, body, None, source, rank_, None, None, None, images, {"ruyi": None}, 7, "clash")


def merged(spark, rows):
    return merge_by_url(spark.createDataFrame(rows, SCHEMA))


def test_page_merge_follows_the_order_of_arrival(spark):
    rows = [
        hit(1, "http://a.test/p", "b", rank_=1), hit(2, "http://www.a.test/p/", "bbb", rank_=2), hit(3, "http://m.a.test/p", "bbbbb", rank_=3),
        hit(4, "https://a.test/p?utm_x=1", "bb", source="parallel", rank_=1), hit(5, "http://a.test/p", "bbbbb", source="parallel", rank_=9),
    ]
    r = merged(spark, rows).collect()
    assert len(r) == 1
    assert (r[0].url, r[0].sources, r[0].n_hits) == ("http://m.a.test/p", {"doubao": 1, "parallel": 1}, 5)
    # Two changes of the representative: the last one before comes first.
    assert r[0].also_urls == ["http://www.a.test/p/", "http://a.test/p", "https://a.test/p?utm_x=1"]


def test_hits_without_page_stay_single_and_empty_ones_go(spark):
    rows = [hit(1, "", "x"), hit(2, None, "x"), hit(3, "", "x", title=None), hit(4, None, None, title=""), hit(5, "http://a.test", None, title=None)]
    got = merged(spark, rows).collect()
    assert sorted((r.url, r.title, r.body) for r in got) == [("", "a title that is long", "x"), ("", "a title that is long", "x"), ("http://a.test", "", "")]
    assert merged(spark, []).count() == 0


def test_content_merge_is_exact(spark):
    long = "x" * 120
    rows = [
        hit(1, "http://a.test/1", long), hit(2, "http://b.test/2", long, title=" a title that is long "), hit(3, "http://c.test/3", long + "!"),
        hit(4, "http://d.test/4", "x" * 119), hit(5, "http://e.test/5", "x" * 119), hit(6, "http://a.test/1", long, q=None), hit(7, "http://f.test", long, title="short"),
    ]
    got = merge_by_body(merged(spark, rows)).collect()
    assert sorted((r.query_id or "", r.url, len(r.also_urls), r.n_hits) for r in got) == [
        ("", "http://a.test/1", 0, 1), ("Q1", "http://a.test/1", 1, 2), ("Q1", "http://c.test/3", 0, 1), ("Q1", "http://d.test/4", 0, 1),
        ("Q1", "http://e.test/5", 0, 1), ("Q1", "http://f.test", 0, 1),
    ]


def test_slim_merging_gives_the_same(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/docs.parquet")
    columns = ("query_id", "url", "title", "body", "sources", "also_urls", "n_hits")

    def rows(df):
        return sorted(str((r.query_id, r.url, r.title, r.body, sorted(r.sources.items()), r.also_urls, r.n_hits)) for r in df.select(*columns).collect())

    whole = rows(merge_by_body(merge_by_url(docs)))
    assert rows(with_bodies(merge_by_body(merge_by_url(slim(docs))), docs)) == whole and whole
    assert with_bodies(merge_by_body(merge_by_url(slim(docs.limit(0)))), docs).count() == 0


def test_scores(spark):
    df = spark.createDataFrame([({"doubao": 1, "parallel": 2},), ({"local": 1},), ({},), (None,)], "sources map<string,int>")
    got = [r.s for r in df.select(rrf(F.col("sources")).alias("s")).collect()]
    assert [round(x, 12) for x in got] == [round(x, 12) for x in (1 / 61 + 1 / 62, 0.5 / 61, 0.0, 0.0)]
    bad = spark.createDataFrame([(1.5, 0), (float("nan"), 5), (-1.0, 1), (0.5, 4), (None, None)], "rank_score double, authority int")
    assert [(r[0], r[1]) for r in validate_scores(bad).collect()] == [(None, None), (None, None), (None, 1), (0.5, 4), (None, None)]


def test_rank_is_total_and_fresh_only_when_asked(spark):
    m = merge_by_body(merged(spark, [hit(1, "http://a.test", "x", rank_=2), hit(2, "http://b.test", "x", rank_=2, q="Q2"), hit(3, "http://c.test", "x", rank_=2, q="Q2")]))
    q = spark.createDataFrame([("Q2", "现在 天气")], "id string, q string")
    got = rank(m, q, datetime.date(2026, 1, 1)).collect()
    assert sorted((r.query_id, r.place, r.url) for r in got) == [("Q1", 1, "http://a.test"), ("Q2", 1, "http://b.test"), ("Q2", 2, "http://c.test")]


def test_freshness(spark):
    as_of = datetime.date(2026, 9, 1)
    words = {
        "今天油价": (True, True), "出现在哪个版本": (False, False), "日本月刊": (False, False), "snowflake docs": (False, False), "价格now走势": (True, True),
        "上海天气": (True, True), "上海历史天气": (False, False), "2020年上海天气": (False, False), "最新论文": (True, False), "now_playing": (False, False),
        "股价 跌破 1999": (True, True), "weather in 2019": (False, False), "2026年12月1日天气": (True, True), "8月1日天气": (False, False), "": (False, False),
    }
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "q string")
    got = df.select("q", D.is_fresh_query(F.col("q"), as_of).alias("f"), D.is_strong_fresh_query(F.col("q"), as_of).alias("s")).collect()
    assert {r.q: (r.f, r.s) for r in got} == words | {None: (False, False)}


def test_ranking_date(spark):
    as_of = datetime.date(2026, 9, 1)
    rows = [
        ("上海天气 2026-08-30", "/x", "2026-01-01", "2026-08-30"), ("news", "/2025/03/04/a.html", "2026-01-01", "2025-03-04"),
        ("news", "/20250304.html", "2026-01-01", "2025-03-04"), ("news", "/20150304.html", "2026-01-01", "2026-01-01"),
        ("天气 回顾 2026-08-30", "/x", None, None), ("天气 2026-08-30 2026-08-29", "/x", "p", "p"), ("", "", None, None),
    ]
    df = spark.createDataFrame(rows, "t string, p string, d string, want string")
    got = df.select(D.ranking_date(F.col("t"), F.col("p"), F.col("d"), as_of).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
