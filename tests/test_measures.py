"""Measures, configuration values, runs and source mappings against plain Python."""

import itertools
import json
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from inkwell.functions import config
from inkwell.functions.views import content_len, paragraphs, split_sentences
from inkwell.operators import measures as M
from inkwell.operators.joins import longest_run
from inkwell.operators.store import fingerprint_of
from inkwell.session import materialize, release, shared_dir
from inkwell.sources import adapters as A

TEXTS = {
    1: None, 2: "", 3: " \n\n ", 4: "短。短句。好。行。\n\n这是一个很长很长的句子用于测试。短。\n\n再来一段，也很长很长。完。\n\n又一段又一段又一段。好。\n\n最后一段话在这里。是。",
    5: "- a\n- b\n- c\nx\n- d\n- e", 6: "# 标题\n\n标题\ntext\n## B c\nB c", 7: "5 GB and 6GB, 7 kg", 8: "他说“好”。「不」", 9: "x -- y --- z ——**bold** 😀", 10: "a 1 " + "字" * 900 + " 2 3 4", 11: "字,1:2 ％" + "0" * 20000,
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, t, k) for k, t in TEXTS.items()] + [(5, TEXTS[5], 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n int")


def sizes(text):
    return [n for _, s in split_sentences(text) if (n := content_len(s))]


def test_sizes_and_sentences(texts):
    got = {r.doc_id: r for r in M.text_sizes(texts, "doc_id", F.col("text")).collect()}
    assert set(got) == set(TEXTS) - {1}
    for k, r in got.items():
        t = TEXTS[k]
        assert (r.chars, r.sentences, r.paragraphs) == (content_len(t), len(split_sentences(t)), len(paragraphs(t))), k
    cv = {r.doc_id: r.cv for r in M.sentence_cv(texts, "doc_id", F.col("text")).collect()}
    want = {k: statistics.pstdev(sizes(t)) / statistics.fmean(sizes(t)) for k, t in TEXTS.items() if t and len(sizes(t)) >= 8}
    assert set(cv) == set(want) and all(math.isclose(cv[k], want[k], abs_tol=1e-8) for k in want)


def test_paragraphs_of_short_sentences(texts):
    rates = {r.doc_id: (r.paragraphs, r.rate) for r in M.punchline_rate(texts, "doc_id", F.col("text")).collect()}
    fit = [s for p in paragraphs(TEXTS[4]) if len(s := sizes(p)) > 1]
    assert rates == {4: (len(fit), round(sum(s[-1] < 0.6 * statistics.fmean(s) for s in fit) / len(fit), 9))}
    runs = {r.doc_id: r.run for r in M.staccato_run(texts, "doc_id", F.col("text")).collect()}
    for k, t in TEXTS.items():
        if t is not None:
            longest = max((len(list(g)) for p in paragraphs(t) for short, g in itertools.groupby(sizes(p), lambda n: n <= 8) if short), default=0)
            assert runs[k] == longest, k


def test_lines_and_headings(texts):
    runs = sorted((r.doc_id, r.first_line, r.n_lines) for r in M.line_runs(texts.where("n > 0"), "doc_id", F.col("text"), "^- ").collect())
    assert runs == [(5, 1, 3)]
    assert sorted((r.doc_id, r.line_no) for r in M.said_again(texts, "doc_id", F.col("text")).collect()) == [(6, 3), (6, 6)]


def test_mixed_styles_and_densities(texts):
    assert [(r.doc_id, r.units) for r in M.mixed_units(texts, "doc_id", F.col("text")).collect()] == [(7, "GB")]
    assert [tuple(r) for r in M.quote_styles(texts, "doc_id", F.col("text")).collect()] == [(8, 2, 2)]
    per = {r.doc_id: r for r in M.densities(texts, "doc_id", F.col("text")).collect()}
    chars = content_len(TEXTS[9]) / 1000
    assert (per[9].dashes, per[9].bold, per[9].emoji) == (round(2 / chars, 9), round(1 / chars, 9), round(1 / chars, 9)) and per[2].dashes == 0
    counts = {(r.doc_id, r.rule): r.n for r in M.pattern_counts(texts, "doc_id", F.col("text"), {"zero": "0", "comma": ","}).collect()}
    assert counts[(11, "zero")] == 20000 and counts[(11, "comma")] == 1 and (9, "comma") not in counts


def test_dense_hits(texts):
    got = {r.doc_id: (r.hits, r.dense) for r in M.dense_hits(texts, "doc_id", F.col("text"), "[0-9]").collect()}
    assert got[10] == (4, 3) and got[7] == (3, 3)


def test_first_shares(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 1), (None, 1)], "g string, k int")
    got = {(r.g, r.k): r.share for r in M.first_shares(df, ["g"], ["k"], 1000).collect()}
    whole = sum(0.72**k for k in range(5))
    assert [got[("a", k)] for k in range(5)] == [int(1000 * 0.72**k / whole) for k in range(5)] and got[("b", 1)] == got[(None, 1)] == 1000


def test_measures_of_an_empty_table(spark, texts):
    none = texts.limit(0)
    t = F.col("text")
    for df in (M.densities(none, "doc_id", t), M.sentence_cv(none, "doc_id", t), M.said_again(none, "doc_id", t), M.dense_hits(none, "doc_id", t, "a"), M.line_runs(none, "doc_id", t, "a")):
        assert df.count() == 0


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_runs_over_blocks(spark, block):
    rng = random.Random(block)
    rows = [(g, k, rng.random() < 0.7 if rng.random() < 0.9 else None) for g in ("a", "b", None) for k in rng.sample(range(60), 45)]
    want = []
    for g in ("a", "b", None):
        own = sorted((k, f) for x, k, f in rows if x == g)
        for flag, run in itertools.groupby(own, lambda x: bool(x[1])):
            run = list(run)
            if flag:
                want.append((g, run[0][0], len(run)))
    df = spark.createDataFrame(rows, "g string, k int, f boolean")
    got = [tuple(r) for r in longest_run(df, ["g"], "k", F.col("f"), block).collect() if r.g is not None]
    assert sorted(got) == sorted(w for w in want if w[0] is not None)


def test_configuration_values(spark):
    told = ["5", "true", "1.0", "-3", "99", None, "x", "1e2", "0.25"]
    df = spark.createDataFrame([(t,) for t in told], "t string")
    t = F.col("t")
    rows = df.select(config.whole_number(t, 1, 50, 10), config.number(t, 0, 100, 0.5), config.flag(t, False), config.one_of(t, ("x", "y"), "y")).collect()
    assert [r[0] for r in rows] == [5, 10, 10, 10, 10, 10, 10, 10, 10]
    assert [r[1] for r in rows] == [5.0, 0.5, 1.0, 0.5, 99.0, 0.5, 0.5, 100.0, 0.25]
    assert [r[2] for r in rows].count(True) == 1 and [r[3] for r in rows].count("x") == 1
    base = {"a": {"n": 1, "on": True, "x": 0.5}, "s": "t"}
    got, wrong = config.merged(base, {"a": {"n": True, "on": False, "x": float("nan"), "new": 1}, "s": 3})
    assert got == {"a": {"n": 1, "on": False, "x": 0.5, "new": 1}, "s": "t"} and len(wrong) == 3
    assert config.merged(base, [1])[0] == base


def test_pictures_and_cards(spark):
    raw = {
        "Result": {
            "WebResults": [{"Url": "u", "Title": "t", "InlineImages": [{"ImageUrl": "i", "Width": 3}]}, {"Url": "v"}],
            "ImageResults": [{"Url": "p", "Title": "T", "Image": {"Url": "q", "Width": "9", "Watermark": 1, "Features": {"Description": "d", "StyleType": "s"}}}, {"Title": "only"}],
            "CardResults": [{"CardType": "Weather", "x": "1"}, {"y": "2"}],
        }
    }
    df = spark.createDataFrame([("Q", json.dumps(raw)), ("R", "no json"), ("S", None)], "query_id string, raw string")
    web = A.map_first(df).orderBy("rank").collect()
    assert [i.url for i in web[0].images] == ["i"] and web[0].images[0].width == "3" and web[1].images == []
    got = A.map_images(df).orderBy("rank").collect()
    assert got[0].body == "d" and got[0].images[0].watermark == "watermark" and got[0].images[0].style == "s" and got[1].images[0].alt == "only"
    assert [(r.place, r.kind) for r in A.map_cards(df).orderBy("place").collect()] == [(1, "Weather"), (2, None)]


def test_requests(spark):
    df = spark.createDataFrame([("q" * 150, 90, ["a"], ["b"]), (" x ", None, [], ["b"]), (None, 0, None, None)], "q string, n int, yes array<string>, no array<string>")
    got = [json.loads(r[0]) for r in df.select(A.build_request(F.col("q"), F.col("n"), F.col("yes"), F.col("no"), F.lit("image"), F.lit("OneDay"), F.lit(9))).collect()]
    assert [g["count"] for g in got] == [5, 5, 1] and len(got[0]["query"]) == 100 and "block_hosts" not in got[0] and got[1]["block_hosts"] == "b"
    assert all(g["time_range"] == "OneDay" and "auth_level" not in g for g in got)
    line = df.select(A.second_command(F.col("q"), F.array(F.lit("--k")), F.col("yes"), F.col("no"), F.col("n"))).collect()
    assert line[1][0] == ["search", "--json", "--max-results", "10", "--query", "--k", "--exclude-domain", "b", "--", "x"]
    assert df.select(A.dropped_urls(F.array_repeat(F.lit("u"), 23))).first()[0].endswith("3 left out") and df.select(A.dropped_urls(F.array(F.lit("u")))).first()[0] is None
    errors = df.select(A.argument_error(F.col("q"), F.col("n"), F.lit(1), F.lit("parallel"), F.lit("web"), F.lit(""), F.lit("2026-02-30"))).collect()
    assert [r[0] for r in errors] == ["no such date", "no such date", "empty query"]


def test_fingerprints_ignore_session_and_order(spark):
    rows = [('{"q":"a","count":5,"session_id":"1"}',), ('{"count":5,"q":"a","transport":"x"}',), ('{"q":["b","a"]}',), ('{"q":["a","b"]}',)]
    keys = [r[0] for r in spark.createDataFrame(rows, "r string").select(fingerprint_of(F.lit("s"), F.col("r"))).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and all(re.fullmatch("[0-9a-f]{32}", k) for k in keys)


def test_written_parts_are_released(spark):
    import os

    part = materialize(spark.range(3), "test")
    path = part.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and shared_dir(spark)
    assert release(spark) >= 1 and not os.path.exists(path) and release(spark) == 0
