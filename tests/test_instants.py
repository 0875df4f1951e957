"""Notations of moments, one by one and through the dictionary."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from inkwell.operators.instants import normalize_instants, parse


def us(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("raw", "tz", "order", "want"),
    [
        ("2026-08-22T07:53:35Z", "", "", us(2026, 8, 22, 7, 53, 35)),
        ("2020-08-20 09:04", "Asia/Shanghai", "ymd", us(2020, 8, 20, 1, 4)),
        ("发布于 2026.07.31", "Asia/Tokyo", "", us(2026, 7, 30, 15)),
        ("1597311319", "", "", 1597311319 * 1_000_000),
        ("1787293100191", "", "", 1787293100191000),
        ("2023-06-20 11:57:59 CST", "Asia/Shanghai", "", us(2023, 6, 20, 3, 57, 59)),
        ("2023-06-20 11:57:59 CST", "America/Chicago", "", us(2023, 6, 20, 17, 57, 59)),
        ("Thu, 11 Dec 2025 02:09:25 GMT", "", "", us(2025, 12, 11, 2, 9, 25)),
        ("16/04/2026", "Europe/London", "dmy", us(2026, 4, 15, 23)),
        ("16/04/2026", "America/New_York", "mdy", None),
        ("20260805123853", "Asia/Shanghai", "", us(2026, 8, 5, 4, 38, 53)),
        ("2026年7月31日 下午12:05", "Asia/Shanghai", "", us(2026, 7, 31, 4, 5)),
        ("2020年6月5日 上午12:22", "Asia/Shanghai", "", us(2020, 6, 4, 16, 22)),
        ("2022-11-06 01:52:39 EST", "America/New_York", "mdy", us(2022, 11, 6, 6, 52, 39)),
        ("2022-11-06 01:52:39", "America/New_York", "mdy", None),  # shown twice
        ("2022-03-13 02:30:00", "America/New_York", "mdy", None),  # never shown
        ("2022-03-13", "", "", None),  # no zone known
        ("2026", "Asia/Shanghai", "", None),
        ("2025-09", "Asia/Shanghai", "", None),
        ("2026-02-30", "Asia/Shanghai", "", None),
        ("2026-13-45", "Asia/Shanghai", "", None),
        ("0000-00-00", "Asia/Shanghai", "", None),
        ("2026-01-01 24:10", "Asia/Shanghai", "", None),
        (None, "Asia/Shanghai", "", None),
        ("待定", "Asia/Shanghai", "", None),
        ("2026-01-01" * 500, "Asia/Shanghai", "", None),
    ],
)
def test_notation(raw, tz, order, want):
    got = parse(raw, tz, order)
    assert (got and got[1]) == want


def test_counted_back():
    assert parse("37分钟前", "", "") == ("ago", 37 * 60_000_000, 0)
    assert parse("3 days ago", "", "") == ("ago", 3 * 86_400_000_000, 0)
    assert parse("昨天 22:27", "Asia/Shanghai", "") == ("day", (22 * 60 + 27) * 60_000_000, 1)
    assert parse("昨天 22:27", "", "") is None


def run(spark, rows, path):
    df = spark.createDataFrame(rows, "hit_id bigint, publish string, site string, fetched_at timestamp, raw string, _n int")
    sites = spark.createDataFrame([("ny", "America/New_York", "mdy"), ("cn", "Asia/Shanghai", "ymd")], "site string, tz_name string, date_order string")
    out = normalize_instants(df, "hit_id", F.col("publish"), F.col("site"), F.col("fetched_at"), sites, 10, path)
    return sorted((r.hit_id, r.publish_us) for r in out.collect())


def test_rows_and_dictionary(spark, tmp_path):
    at = datetime(2026, 3, 9, 3, 0)  # in New York the evening of the 8th, when the clocks went forward at 02:00
    rows = [
        (1, "2 hours ago", "?", at, "x", 1), (2, "yesterday at 09:00", "ny", at, "x", 1), (3, "today", "ny", at, "x", 1), (4, None, "ny", at, "x", 1),
        (5, " ", "ny", at, "x", 1), (6, "今天 02:30", "ny", at, "x", 1), (7, "2026-03-01", None, at, "x", 1), (8, "2026-03-01", "cn", None, "x", 1),
        (8, "2026-03-01", "cn", None, "x", 1), (9, "1 hour ago", "cn", None, None, None),
    ]
    want = [
        (1, us(2026, 3, 9, 1)), (2, us(2026, 3, 7, 14)), (3, us(2026, 3, 8, 5)), (8, us(2026, 2, 28, 16)), (8, us(2026, 2, 28, 16)),
    ]
    path = str(tmp_path / "words")
    assert run(spark, rows, path) == want
    first = spark.read.parquet(path).count()
    assert run(spark, rows, path) == want
    assert spark.read.parquet(path).count() == first  # nothing is parsed again
    assert run(spark, [], str(tmp_path / "none")) == []
