"""The operators on training text: against brute force, invariants, edge cases."""

import collections
import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import boilerplate, copies, mixing, packing, pii, pii_train
from inkwell.llm.lines import prefix_span, repeated_lines, without_repeated
from inkwell.llm.survivors import survivors
from inkwell.llm.truncation import truncated, truncation_rates

DOCS = "hit_id bigint, query_id string, url string, title string, body string, site string, n int, key string, page string, host string"
MERGED = (
    "merged_id bigint, query_id string, url string, title string, body string, also_urls array<string>, publish string, authority int, "
    "sources map<string,int>, merged_at timestamp, q string, page string, n int"
)


def doc(i, body=None, url="http://a.test/1", q="Q", title="t", site="s"):
    return (i, q, url, title, body, site, 1, "x", "x", "x")


def rec(i, url="http://a.test/1", title="T", also=(), q="Q", body=None, publish=None, sources=None, at=datetime(2026, 1, 2)):
    return (i, q, url, title, body, list(also) if also is not None else None, publish, None, sources, at, "x", "x", 1)


# Problem 1


def test_rolling_hashes_skip_and_fold():
    fold = copies.letters_and_digits()
    h = copies.rolling_hashes(["A b-C", "abc", "acb", "", "—", "abc"], fold)
    assert (h[:, 0] == h[:, 1]).all() and (h[:, 1] == h[:, 5]).all() and (h[:, 3] == h[:, 4]).all()
    assert (h[:, 1] != h[:, 2]).all()


def test_two_pointers_agree_with_compacted_texts():
    rng = random.Random(1)
    words = ["".join(rng.choice("aAbB1 -，中") for _ in range(rng.randrange(9))) for _ in range(400)] + ["x" * 5000, "X-" * 5000]
    left, right = words[::2], words[1::2]
    plain = [[c.lower() for c in a if c.isalnum()] == [c.lower() for c in b if c.isalnum()] for a, b in zip(left, right, strict=True)]
    assert copies.same_folded(left, right, copies.letters_and_digits()).tolist() == plain


def test_pages_agree_with_their_keys():
    rng = random.Random(5)
    hosts, paths, pairs = ["a.test", "A.test", "www.a.test", "m.b.test:80", "b.test"], ["", "/", "/x", "/x/", "/x/index.html", "/X"], ["a=1", "b=2", "utm_x=3", "a=%31", "b=2&b=2", ""]
    urls = [None, "", " ", *(f"{rng.choice(('http:', 'https:', ''))}//{rng.choice(hosts)}{rng.choice(paths)}?{'&'.join(rng.sample(pairs, 3))}{rng.choice(('', '#top', '#a=b'))}" for _ in range(300))]
    left, right = [rng.choice(urls) for _ in range(3000)], [rng.choice(urls) for _ in range(3000)]
    assert copies._same_pages(left, right).tolist() == [copies._page_key(u) == copies._page_key(v) for u, v in zip(left, right, strict=True)]
    sets = [None, [], *([rng.choice(urls[:12]) for _ in range(rng.randrange(4))] for _ in range(200))]
    a, b = [rng.choice(sets) for _ in range(2000)], [rng.choice(sets) for _ in range(2000)]
    assert copies._same_sets(a, b).tolist() == [copies._pages_of(x) == copies._pages_of(y) for x, y in zip(a, b, strict=True)]


def test_pieces_and_expressions_give_one_page(spark):
    """The second reader of addresses must not drift from the expressions: all notations of one page, and no others."""
    from inkwell.functions.urls import canonical_url

    rng = random.Random(6)
    urls = ["http://a.test", "HTTPS://WWW.A.test:443/", "//a.test/index.php", "a.test/x?b=1&a=2#!k", "http://[::1]:8/x", "http://a.test:99999/", "mailto:x", "http://u:p@a.test/%7Ex?q=%20+"]
    urls += ["".join(rng.choice(("http", "://", "www.", "a.t", "/", "?", "#", "=", "&", "%41", ":80", "m.", " ", "中", "index.html")) for _ in range(9)) for _ in range(2000)]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u")).alias("k")).collect()
    by_expression, by_pieces = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        by_expression[r.k].add(r.u)
        by_pieces[copies._page_key(r.u)].add(r.u)
    assert sorted(map(sorted, by_expression.values())) == sorted(map(sorted, by_pieces.values()))


def found(spark, docs, merged):
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(merged, MERGED)
    return sorted((r.rec, r.keep_id, r.copy_id) for r in copies.find_copies(d, m, 10).collect())


def test_copies(spark):
    docs = [
        doc(5), doc(2, url="HTTPS://www.a.test/1/?utm_x=1#top"), doc(9, q="P"), doc(3, url=None), doc(4, url=" "), doc(2), doc(7, q=None), doc(8, q=None),
        doc(11, url="http://a.test/1?b=1&a=2"), doc(12, url="http://a.test/1?a=2&b=1"),
    ]
    merged = [
        rec(1, title="A，B", also=["http://x.test/1", "http://y.test/2/"]), rec(2, title="ab ", also=["http://www.y.test/2", "http://x.test/1", "http://x.test/1/", None, ""]),
        rec(3, title="ab", also=["http://x.test"]), rec(4, title=None, also=None), rec(5, title="", also=[]),
    ]
    want = [("docs", 2, 5), ("docs", 7, 8), ("docs", 11, 12), ("merged", 1, 2), ("merged", 4, 5)]
    assert found(spark, docs, merged) == want
    assert found(spark, [], []) == []
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(merged, MERGED)
    kept = copies.collapse(d, m, copies.find_copies(d, m, 10)).collect()
    assert sum(r.n_copies for r in kept) == len(docs) + len(merged)


def test_a_collision_is_grouped_again(spark, monkeypatch):
    rows = [("docs", k, "Q", f"http://{'ab'[k % 2]}.test/", None, None) for k in range(4)]
    import pandas as pd

    b = pd.DataFrame(rows, columns=["rec", "id", "query_id", "url", "title", "also_urls"])
    for c in ("query_id", "url", "title", "also_urls"):
        b["r_" + c] = b[c].iloc[0] if c != "also_urls" else None
    b["keep_id"] = 0
    (out,) = copies._verify_batches(iter([b]))
    assert [x is None for x in out["exact"]] == [True, False, True, False] and out["exact"][1] == out["exact"][3]


# Problem 2


def page(k, host):
    prose = f"第{k}篇讲{chr(0x4E00 + k * 7)}{chr(0x4E10 + k * 3)}的维护费用，很多人把它和成本混为一谈。其实两者的计算方法不同，综合来看{chr(0x4E20 + k * 5)}更好。"
    return "\n".join(["首页 | 登录 | 注册", f"# 标题{chr(0x4E00 + k)}", prose, "我们使用 Cookie 改善体验。", prose[::-1][1:] + "。", "### 热门文章", f"- 别的标题{k}", f"- 又一个{k * 3}", "", "版权所有 " + host, "（完）"])


def test_main_body(spark):
    rows = [doc(k, page(k, f"h{k % 3}"), url=f"http://h{k % 3}.test/{k}", site=f"h{k % 3}") for k in range(60)]
    rows += [doc(100, None), doc(101, ""), doc(102, " \n\n"), doc(103, "x" * 200_000), doc(59, page(59, "h2"), url="http://h2.test/59", site="h2")]
    df = spark.createDataFrame(rows, DOCS)
    got = collections.defaultdict(set)
    for r in boilerplate.main_body(df, len(rows)).collect():
        got[r.hit_id].add(r.line_no)
    assert all(got[k] == {1, 4, 6, 7, 8, 10} for k in range(60)), [(k, got[k]) for k in range(60) if got[k] != {1, 4, 6, 7, 8, 10}][:3]
    assert not got[101] and not got[102]
    bodies = {r.hit_id: r.body for r in boilerplate.main_body(df, len(rows), emit="bodies").collect()}
    assert 100 not in bodies and "Cookie" not in bodies[3] and "# 标题" in bodies[3]
    assert boilerplate.main_body(df.limit(0), 0).count() == 0


def test_line_tags():
    tags = [x.tag for x in boilerplate.lines_of("# h\n**b**\n- i\n- [x](u)\n1 t\n[x](u)\n[x](u) [y](v)\n> q\n[1] http://x\n| a |\n```\nc\n```\np\n~~~\nopen")]
    assert tags == ["h", "b", "li", "la", "ni", "a", "m", "q", "r", "t", "c", "c", "c", "p", "c", "c"]


def test_many_other_windows_change_nothing(spark):
    """Pages are judged alike however many windows the rest of the corpus has."""
    rng = random.Random(8)
    rows = [doc(k, page(k, f"h{k % 3}"), url=f"http://h{k % 3}.test/{k}", site=f"h{k % 3}") for k in range(60)]
    far = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40)) for _ in range(4000)]
    rows += [doc(1000 + k, "。".join(far[k * 10 : k * 10 + 10]) + "。", url=f"http://o.test/{k}", site=f"o{k % 9}") for k in range(400)]
    got = collections.defaultdict(set)
    for r in boilerplate.main_body(spark.createDataFrame(rows, DOCS), len(rows)).collect():
        got[r.hit_id].add(r.line_no)
    assert all(got[k] == {1, 4, 6, 7, 8, 10} for k in range(60)) and not any(got[1000 + k] for k in range(400))


def test_containers_and_windows():
    lines = boilerplate.lines_of("p one\np two\n- a\n- b\n\n- c\n1 d\n# h")
    assert boilerplate.containers_of(lines) == [[0], [1], [2, 3], [4], [5], [6]]
    paths = [x.path for x in boilerplate.lines_of("# Most read 5\n**most  read 17**\nmost read 5\nMost read 5.")]
    assert paths[0] == paths[1] and len(set(paths)) == 3
    keys, owner = boilerplate.windows_of(["the cat sat on the mat today", "The  cat\tsat on the mat", "", "今天天气很好"])
    first = set(keys[owner == 0].tolist())
    assert set(keys[owner == 1].tolist()) <= first and len(first) == 4 and (owner == 3).sum() == 2


# Problem 3


def test_truncation(spark):
    whole = ["今天的天气很好，我们去公园散步。", "The report was long, and many readers waited for it."]
    rows = [doc(k, "\n".join([whole[k % 2] * 1 + " " + whole[k % 2], "版权所有，转载请注明出处"])) for k in range(40)]
    cut = {
        100: "今天的天气很好，我们去公", 101: "The report was long, and many rea", 102: "今天的天气很好，我们…", 103: "The report was long, and [...]", 104: "今天的天气很好<a hre", 105: "今天的天气�",
    }
    fine = {200: whole[0], 201: "版权所有，转载请注明出处", 202: None, 203: "", 204: " \n ", 205: whole[1] + "\n\n"}
    df = spark.createDataFrame(rows + [doc(k, b) for k, b in (cut | fine).items()], DOCS)
    got = truncated(df, 60)
    assert {r.hit_id for r in got.collect()} == set(cut)
    rates = truncation_rates(df.withColumn("source", F.lit("d")), got).collect()
    assert [(r.rows, r.cut_rows) for r in rates] == [(52, 6)]
    assert truncated(df.limit(0), 0).count() == 0


@pytest.mark.parametrize("copies_", [1, 2, 30])
def test_copies_do_not_testify_for_their_own_cut(spark, copies_):
    rows = [doc(k, f"Report {chr(97 + k)} says the river was high, and many readers waited for it.\nShare this page") for k in range(12)]
    cut = [doc(100 + k, ("The river was high, and many", "THE RIVER  was high, and many")[k % 2]) for k in range(copies_)]
    got = truncated(spark.createDataFrame(rows + cut, DOCS), 50)
    assert sorted(r.hit_id for r in got.collect()) == [100 + k for k in range(copies_)]


def test_long_torn_markup_is_a_cut(spark):
    cut = ["Text <img alt=\"a\" src=\"data:image/png;base64," + "aB3/" * 90, "See [the notes](https://t.test/c?u=" + "x1" * 150, "See [a text that is rather long and", "![logo](https://t.test/" + "y" * 30]
    fine = ["See [the notes](https://t.test/" + "x" * 300 + ")", "Text <b>here</b> " + "word " * 60 + "ends.", "A [note that never closes, but ends."]
    df = spark.createDataFrame([doc(k, b) for k, b in enumerate(cut + fine)], DOCS)
    assert {r.hit_id for r in truncated(df, 9).collect()} == set(range(len(cut)))


# Problem 4


def test_survivors(spark):
    rows = [
        rec(3, body="a  b", publish="2026-01-01", sources={"x": 2, "y": 0}), rec(1, url="http://www.a.test/1/", body="　ab\n", publish="2026-01-01T09:00", sources={"x": 5}),
        rec(2, body=None, publish="2026-01-03", sources={"z": 1}), rec(4, url=None), rec(5, url=""), rec(6, url="http://b.test"), rec(6, url="http://b.test"),
        rec(7, url="http://c.test", publish="2026-02-30"), rec(8, url="http://c.test", publish=None, at=None), rec(9, url="http://d.test/9", q=None), rec(10, url="http://d.test/9/", q=None),
    ]
    df = spark.createDataFrame(rows, MERGED)
    got = sorted((r.group_id, r.body_id, r.publish_id, r.sources_key) for r in survivors(df).collect())
    assert got == [(1, 1, 1, "x:2,z:1"), (7, 7, 0, ""), (9, 9, 0, "")]
    best = {r.group_id: r for r in survivors(df, with_values=True).collect()}
    assert (best[1].body, best[1].publish, best[9].query_id) == ("　ab\n", "2026-01-01T09:00", None)
    later = [rec(11, body="old", sources={"y": 1}), rec(12, body="trusted", sources={"x": 9}), rec(13, body=" ", sources={"x": 1}), rec(14, body="new", sources={"y": 1}, at=datetime(2026, 2, 1))]
    own = spark.createDataFrame(later, MERGED)
    assert [survivors(own, with_values=True, order=o).first().body for o in (("x",), ("y", "x"), ())] == ["trusted", "new", "new"]
    assert survivors(df.limit(0)).count() == 0


# Problem 6


def test_repeated_lines(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        lines = [f"唯一{chr(0x4E00 + k)}{chr(0x5000 + k)}", "" if k % 2 else "---"]
        lines += ["免责声明 %d" % k] if k % 3 == 0 else []
        lines += ["Share This", "分享 到"] if k % 4 == 0 else []
        rng.shuffle(lines)
        rows.append(doc(k, "\n".join(lines), url=f"http://s.test/{k}" if k % 5 else "http://s.test/same", site="s" if k < 50 else "t"))
    rows += [doc(100, None, site="s"), doc(101, "免责声明", site="u"), doc(102, "免责声明", url=None, site="s")]
    df = spark.createDataFrame(rows, DOCS)
    sites = spark.createDataFrame([("s", 1), ("t", 1), ("s", 1)], "site string, n int")
    own = [r for r in rows if r[5] == "s"]
    norm = lambda x: "".join(c for c in "".join(x.split()).lower() if c not in "0123456789")
    held = collections.defaultdict(lambda: [0, set()])
    for r in own:
        for key in {norm(x) for x in (r[4] or "").split("\n")}:
            held[key][0] += 1
            if r[2]:
                held[key][1].add(r[2])
    known = {k for k, (n, pages) in held.items() if n * 5 >= len(own) and len(pages) >= 5 and any(c.isalpha() for c in k)}
    want = {(r[0], n) for r in own for n, x in enumerate((r[4] or "").split("\n"), 1) if norm(x) in known}
    seq = prefix_span(df, sites)
    assert {(r.hit_id, r.line_no) for r in repeated_lines(df, sites, seq).collect()} == want and want
    assert {r.length for r in seq.collect()} >= {1}
    clean = {r.hit_id: r.body for r in without_repeated(df, sites, seq).collect()}
    assert "免责" not in clean[0] and clean[100] is None and clean[101] == "免责声明" and len(clean) == len(rows)
    assert prefix_span(df.limit(0), sites).count() == 0


def test_sequences_of_any_length(spark):
    rng = random.Random(6)
    names = [f"line {chr(97 + k)}" for k in range(6)]
    rows = []
    for k in range(40):
        lines = [x for x in names if rng.random() < 0.8] + [f"own {chr(0x4E00 + k)}"]
        lines += [rng.choice(names)] if k % 2 else []
        rows.append(doc(k, "\n".join(lines), url=f"http://s.test/{rng.randrange(7) if k % 5 else k % 3}"))
    holds = collections.defaultdict(list)
    for r in rows:
        lines = [x for x in r[4].split("\n") if x in names]
        for seq in {c for n in range(1, len(lines) + 1) for c in itertools.combinations(lines, n)}:
            holds[seq].append(r[2])
    want = collections.Counter((len(seq), len(urls)) for seq, urls in holds.items() if len(urls) >= 8 and len(set(urls)) >= 5)
    assert max(n for n, _ in want) > 4
    got = prefix_span(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("s",)], "site string")).collect()
    assert collections.Counter((r.length, r.rows) for r in got) == want
    assert len({tuple(r["items"]) for r in got}) == len(got) and all(r.length == len(r["items"]) for r in got)


# Problem 7


def test_tokens_are_those_of_the_vocabulary():
    """The same vocabulary read by another library."""
    import os

    from tokenizers import Tokenizer

    from inkwell.llm import tokens

    other = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["", "a" * 50_000, "中文" * 9000, "x<|endoftext|>y", " \n\t " * 400, "It's 3.14 e\u0301 \u200b 😀"]
    texts += ["".join(chr(rng.choice((32, 10, 39, rng.randrange(33, 127), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0xA0, 0x2FF)))) for _ in range(80)) for _ in range(300)]
    assert tokens.count_tokens(texts, os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)) == [len(e.ids) for e in other.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_text_once_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([16, 97, 512, 2048]))
    counts = np.zeros(capacity + 1, np.int64)
    sizes = np.minimum(capacity, 1 + rng.gamma(1.5, capacity / 6, 4000).astype(int))
    np.add.at(counts, sizes, 1)
    plan = packing.plan_containers(counts)
    used = np.zeros_like(counts)
    for pattern, times in plan:
        assert sum(length * k for length, k in pattern.items()) <= capacity and times > 0
        for length, k in pattern.items():
            used[length] += k * times
    assert (used == counts).all()
    containers = sum(times for _, times in plan)
    assert containers <= np.ceil(sizes.sum() / capacity) * 1.01 + 2


def test_three_are_found_beyond_the_first_tries():
    """Many first lengths whose pair the index holds but the supplies no longer do."""
    counts = np.zeros(201, np.int64)
    counts[[7, 60, 133]] = 1
    supplies = packing.Supplies(counts)
    supplies.left[10:50] = 40
    supplies.left[150:190] = 1
    supplies._sums()
    supplies.take(collections.Counter({k: 1 for k in range(150, 190)}), 1)
    supplies.left[10:50] = 3
    supplies.left[10:50:2] = 0
    got = supplies.three(200, collections.Counter())
    assert got is None or sum(got) == 200
    there = [k for k in range(201) for _ in range(int(supplies.left[k]))]
    exact = any(sum(c) == 200 for c in itertools.combinations(sorted(there)[-60:], 3))
    assert (got is not None) >= exact


def test_packed_rows(spark):
    budgets = spark.createDataFrame([("p", 10), ("r", 4), ("none", None), ("zero", 0)], "profile string, capacity_tokens int")
    sizes = [(k, n) for k, n in enumerate([0, 1, 3, 4, 7, 10, 11, 25, 3, 3])] + [(3, 4), (7, 25)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    got = packing.pack(df, budgets, df).collect()
    for profile, capacity in (("p", 10), ("r", 4)):
        own = [r for r in got if r.profile == profile]
        fill = collections.Counter()
        for r in own:
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= capacity
        assert sum(fill.values()) == sum(n for _, n in sizes)
        parts = collections.Counter((r.doc_id, r.piece_no) for r in own)
        assert all(parts[(k, 0)] == sum(x == k for x, _ in sizes) for k, _ in sizes)
        assert all(r.n_tokens == n for k, n in sizes for r in own if r.doc_id == k and n <= capacity)
    assert {r.profile for r in got} == {"p", "r"}
    assert packing.pack(df.limit(0), budgets, df.limit(0)).count() == 0


# Problem 8


def test_flight_keeps_the_sums():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 500, 800).astype(float)
    p = packing.np.full(800, 0.37)
    out = mixing.fly(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    wide = mixing.fly(p, size, rng, 12)
    assert 2 < ((wide > 0) & (wide < 1)).sum() <= 12 and abs((mixing.land(wide, size) * size).sum() - (p * size).sum()) < 5
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    landed = mixing.land(out, size)
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= 500
    assert (mixing.fly(np.full(9, 0.5), np.full(9, 7.0), rng) != 0.5).sum() >= 7


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    rng = random.Random(5)
    rows = [(k, s, rng.randrange(1, 300)) for k, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 40 + ["other"] * 10)] + [(9999, None, 5), (9998, "mid", 0), (5, "big", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1, "x"), ("mid", 0.3, 2, "x"), ("small", 0.2, 3, "x"), ("absent", 0.1, 2, "x"), ("bad", None, 1, "x")], "source string, target_share double, max_repeats int, tokens string")
    got = mixing.mix(df, targets, df)
    shares = {r.source: (r.tokens, r.most_copies) for r in mixing.reached_shares(got, targets).collect()}
    total = sum(t for t, _ in shares.values())
    for source, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)):
        assert abs(shares[source][0] / total - share) < 0.01 and shares[source][1] <= most
    assert shares["absent"] == (0, 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.mix(df, targets, df).collect()))
    assert mixing.mix(df.limit(0), targets, df.limit(0)).count() == 0


# Problem 9


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pii_train.start_weights(rng).items()}
    ids, classes = rng.integers(0, 90, (3, 7)), rng.integers(0, 5, (3, 7))
    mask = np.ones((3, 7), bool)
    mask[1, 5:] = mask[2, 2:] = False
    tags = rng.integers(0, 3, (3, 7))
    _, grad = pii_train.loss_and_grad(w, ids, classes, mask, tags)
    for name in ("emb", "wxf", "wcb", "uf", "ub", "bb", "wo", "trans", "start"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        step = 1e-2
        losses = []
        for d in (step, -step):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += d
            losses.append(pii_train.loss_and_grad(moved, ids, classes, mask, tags)[0] / 1)
        assert abs((losses[0] - losses[1]) / (2 * step) - grad[name][at]) < 2e-2 * max(1, abs(grad[name][at])), name


def test_tagger_on_held_out_sentences():
    """Values made up with another seed, in sentences that say what they hold."""
    rng = random.Random(99)
    maker = pii_train.Maker(rng, {k: ["x"] for k in pii.TYPES})
    right = wrong = missed = 0
    for _ in range(150):
        wide = rng.random() < 0.5
        name, mail, phone, number, place = maker.name(wide), maker.email(), maker.phone(), maker.id_number(), maker.address(wide)
        parts = rng.choice(
            (
                ["如需进一步了解，可联系", ("name", name), "，邮箱 ", ("email", mail), "，电话 ", ("phone", phone), "。"],
                ["客服记录显示，用户", ("name", name), "（证件号", ("id_number", number), "）已申请退款。"],
                ["Our office at ", ("address", place), " opens at nine. The ticket lists ", ("name", maker.name(False)), " with ID ", ("id_number", number), " as the account holder."],
                ["订单号 202610235642112209 已于昨日发货。证券代码 085732 今日停牌。区间为 1540-1545 元。"],
            )
        )
        text, want = "", set()
        for p in parts:
            if isinstance(p, tuple):
                want.add((len(text), len(text) + len(p[1]), p[0]))
                text += p[1]
            else:
                text += p
        got = set(pii.find_spans([text])[0])
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.85, (right, wrong, missed)


def _marked(parts):
    text, spans = "", set()
    for p in parts:
        if isinstance(p, tuple):
            spans.add((len(text), len(text) + len(p[1]), p[0]))
        text += p[1] if isinstance(p, tuple) else p
    return text, spans


def test_tagger_outside_its_sentences():
    """Sentences of other shapes than those it was trained on."""
    cases = [
        ["我叫", ("name", "张伟"), "，今年三十岁。"], ["Dear Mr. ", ("name", "John Smith"), ", thank you for writing."],
        [("name", "Anna Keller"), ", ", ("address", "Hauptstraße 5, 10115 Berlin")], ["他叫", ("name", "王建国"), "，手机", ("phone", "13812345678"), "。"],
        ["负责人", ("name", "刘晓燕"), "已离职，新的邮箱为", ("email", "hr2024@firma.example"), "。"], ["她住在", ("address", "海淀区中关村大街27号"), "，身份证", ("id_number", "110108199003074512"), "。"],
        ["Please ask for ", ("name", "Peter van Dyke"), " at the front desk or dial ", ("phone", "(415) 555-0132"), "."], ["Best wishes, ", ("name", "Laura Bennett"), "\n", ("email", "laura.bennett@post.test")],
        ["记者", ("name", "陈思远"), "从北京报道。"], ["Reach ", ("name", "Tom Harding"), " on ", ("phone", "+44 20 7946 0958"), "; he is out on Monday."], ["本文由", ("name", "周敏"), "翻译。"],
        ["The tenant, ", ("name", "Carlos de Silva"), ", gave SSN ", ("id_number", "512-44-9087"), "."], ["快递放在", ("address", "朝阳区望京西路48号2栋1单元301室"), "门口，", ("phone", "010-62345678"), "。"],
        ["会议在3月12日举行，费用 1200 元，编号 20240312001。"], ["The Grand Hotel opened in 1987 with 240 rooms."],
    ]
    right = wrong = missed = 0
    for parts in cases:
        text, want = _marked(parts)
        got = set(pii.find_spans([text])[0])
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.7 and right / (right + missed) > 0.7, (right, wrong, missed)


def test_decoding_is_the_best_path():
    """Against all paths of short windows, padded ones among them."""
    rng = np.random.default_rng(2)
    tagger = pii._tagger()
    ids, classes = rng.integers(0, 200, (4, 4)).astype(np.int32), rng.integers(0, 12, (4, 4)).astype(np.int16)
    mask = np.ones((4, 4), bool)
    mask[1, 2:] = mask[3, 3:] = False
    tags, _ = tagger.decode(ids, classes, mask)
    e = tagger.emissions(ids, classes, mask)
    for r in range(4):
        n = int(mask[r].sum())
        def score(path, r=r):
            return tagger.w["start"][path[0]] + sum(e[t, r, k] for t, k in enumerate(path)) + sum(tagger.w["trans"][a, b] for a, b in itertools.pairwise(path))
        assert score(tags[r, :n]) >= max(map(score, itertools.product(range(pii.TAGS), repeat=n))) - 1e-3 and not tags[r, n:].any()


def test_redaction(spark):
    mail = "有事打14274680382，没人接就写信到 yuanzhou+hemu@corp.example。"
    far = "很多人把它和成本混为一谈。" * 400
    rows = [(1, None, "x"), (2, "", "x"), (3, mail, "x"), (3, mail, "x"), (4, far + mail + far, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pii_type string")
    got = pii.find_pii(df).collect()
    assert sorted((r.doc_id, r.pii_type, r.end_pos - r.start_pos) for r in got) == sorted((k, t, n) for k in (3, 3, 4) for t, n in (("email", 26), ("phone", 11)))
    assert all({3: mail, 4: rows[4][1]}[r.doc_id][r.start_pos : r.end_pos] in ("14274680382", "yuanzhou+hemu@corp.example") for r in got)
    texts = {r.doc_id: r.text for r in pii.redact_pii(df).collect()}
    assert texts[3] == "有事打[PHONE]，没人接就写信到 [EMAIL]。" and set(texts) == {3, 4}
    assert pii.find_pii(df.limit(0)).count() == 0


def test_queries_are_registered(spark, tiny):
    from inkwell.llm import QUERIES, SQL

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 9)} <= set(QUERIES) and set(SQL) <= set(QUERIES)
    for name in ("p7_fill", "p8_shares"):
        assert QUERIES[name](spark, tiny).count() > 0
