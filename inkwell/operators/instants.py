"""Timestamps in many notations and time zones, as one instant in UTC.

The distinct values (raw string, zone of the clock, order of numeric dates)
form a dictionary. Each is parsed once, by all known notations, and kept in a
table that grows by what it has not seen. The instants are joined back to the
rows; values that count back are resolved there, from the row's own moment.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.urls import strip
from inkwell.operators.skew import lookup_join
from inkwell.session import materialize, shared_dir

#: Part of the dictionary's path: entries of another version are not read.
VERSION = 1
DAY_US = 86_400_000_000

# Names of months and half days, words that count back.
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_LONG_MONTHS = "january february march april may june july august september october november december".split()
_MONTH_NAMES = _MONTHS | {m: i + 1 for i, m in enumerate(_LONG_MONTHS)} | {"sept": 9}
_AFTERNOON = {"pm", "下午", "晚上", "傍晚", "中午"}
_UNITS_US = {
    "秒": 1_000_000,
    "秒钟": 1_000_000,
    "second": 1_000_000,
    "sec": 1_000_000,
    "分": 60_000_000,
    "分钟": 60_000_000,
    "minute": 60_000_000,
    "min": 60_000_000,
    "小时": 3_600_000_000,
    "个小时": 3_600_000_000,
    "hour": 3_600_000_000,
    "hr": 3_600_000_000,
    "天": DAY_US,
    "日": DAY_US,
    "day": DAY_US,
    "周": 7 * DAY_US,
    "星期": 7 * DAY_US,
    "week": 7 * DAY_US,
}
_DAYS_BACK = {"今天": 0, "今日": 0, "today": 0, "昨天": 1, "昨日": 1, "yesterday": 1, "前天": 2, "前日": 2}

_MONTH = "(?P<mon>" + "|".join(sorted(_MONTH_NAMES, key=len, reverse=True)) + r")\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_CLOCK = r"(?P<h>\d{1,2})[::](?P<mi>\d{2})(?:[::](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_CN_CLOCK = r"(?P<h>\d{1,2})[时点](?:(?P<mi>\d{1,2})分)?(?:(?P<s>\d{1,2})秒)?"
_HALF = r"(?P<half>上午|下午|凌晨|早上|晚上|傍晚|中午|am|pm|a\.m\.|p\.m\.)"
_ZONE = r"(?:\s*(?P<zone>z|(?:utc|gmt)?[+\-−]\d{1,2}(?::?\d{2})?|[a-z]{2,5}))?"
_TIME = rf"(?:{_HALF}?\s*(?:{_CLOCK}|{_CN_CLOCK})(?:\s*(?P<half2>am|pm|a\.m\.|p\.m\.))?)"


def _unique(pattern: str) -> str:
    """Group names may stand once only; the second clock gets its own."""
    seen: dict[str, int] = {}

    def name(m: re.Match) -> str:
        seen[m[1]] = seen.get(m[1], 0) + 1
        return f"(?P<{m[1]}{'' if seen[m[1]] == 1 else '_' + str(seen[m[1]])}>"

    return re.sub(r"\(\?P<(\w+)>", name, pattern)


_DATES = (
    r"(?P<y>\d{4})(?P<sep>[-/.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    r"(?P<y>\d{4})年(?P<mo>\d{1,2})月(?P<d>\d{1,2})[日号]",
    rf"{_WEEKDAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH},?\s+(?P<y>\d{{4}})",
    rf"{_WEEKDAY}{_MONTH}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})",
    r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})",
)
_NOTATIONS = [
    re.compile(_unique(rf"{d}(?:(?:\s*t\s*|,?\s+at\s+|,?\s*){_TIME}{_ZONE})?") + r"\Z", re.I) for d in _DATES
] + [
    re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})\Z"),
    re.compile(
        _unique(
            r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[t ]?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?"
            + _ZONE
        )
        + r"\Z",
        re.I,
    ),
]
_EPOCH = re.compile(r"(\d{10})(?:\.\d+)?\Z|(\d{13})\Z|(\d{16})\Z")
_AGO = re.compile(
    r"(?P<n>\d{1,9})\s*(?P<u>" + "|".join(sorted(_UNITS_US, key=len, reverse=True)) + r")s?\s*(?:之?前|以前|ago)\Z", re.I
)
_NOW = re.compile(r"(?:刚刚|刚才|just now|now)\Z", re.I)
_BACK = re.compile(rf"(?P<w>{'|'.join(_DAYS_BACK)})(?:(?:\s+at\s+|,?\s*){_unique(_TIME)})?\Z", re.I)
_LABEL = re.compile(
    r"(?:发布于|发布时间|发表于|更新于|更新时间|发布|时间|日期|published(?:\s+on|\s+at)?|posted(?:\s+on|\s+at)?|updated(?:\s+on|\s+at)?|date)\s*[::]?\s*",
    re.I,
)
_ASCII = str.maketrans("0123456789:/．-−,　", "0123456789:/.--, ")


def _clock(g: dict[str, str | None]) -> tuple[int, int, int, int] | None:
    """Hour, minute, second, microsecond; zeros where missing; None if there is no such time."""
    h = g.get("h") or g.get("h_2")
    mi = g.get("mi") or g.get("mi_2")
    s = g.get("s") or g.get("s_2")
    if h is None:
        return 0, 0, 0, 0
    hour, minute, second = int(h), int(mi or 0), int(s or 0)
    half = (g.get("half") or g.get("half2") or "").lower().replace(".", "")
    if half in ("am", "pm") and not 1 <= hour <= 12:
        return None
    if half:
        if half in _AFTERNOON:
            hour = hour + 12 if hour < 12 and not (half == "中午" and hour == 11) else hour
        elif hour == 12:
            hour = 0
    if hour > 23 or minute > 59 or second > 59:
        return None
    return hour, minute, second, int((g.get("f") or "0").ljust(6, "0")[:6])


@lru_cache(maxsize=256)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


_US = timedelta(microseconds=1)
_EPOCH_START = datetime(1970, 1, 1)


def _local_us(wall: datetime, zone: ZoneInfo) -> int | None:
    """The one instant at which the zone's clock showed ``wall``; None if twice or never."""
    found = set()
    for fold in (0, 1):
        try:
            at = wall.replace(tzinfo=zone, fold=fold).astimezone(UTC)
        except OverflowError:
            return None
        if at.astimezone(zone).replace(tzinfo=None) == wall:
            found.add(at)
    return (found.pop().replace(tzinfo=None) - _EPOCH_START) // _US if len(found) == 1 else None


def _lettered_us(wall: datetime, letters: str, zone: ZoneInfo) -> int | None:
    """``wall`` in the part of the zone's year that bears these letters."""
    offsets = set()
    for probe in (wall, *(datetime(wall.year, m, 15, 12) for m in range(1, 13))):
        for fold in (0, 1):
            at = probe.replace(tzinfo=zone, fold=fold)
            if (at.tzname() or "").upper() == letters:
                offsets.add(at.utcoffset())
    return (wall - offsets.pop() - _EPOCH_START) // _US if len(offsets) == 1 else None


def _placed(wall: datetime, mark: str | None, zone: ZoneInfo | None) -> int | None:
    mark = (mark or "").upper().replace("−", "-")
    if not mark:
        return _local_us(wall, zone) if zone else None
    if mark in ("Z", "UTC", "GMT"):
        return (wall - _EPOCH_START) // _US
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", mark)
    if m:
        if int(m[2]) > 15 or int(m[3] or 0) > 59:
            return None
        shift = timedelta(hours=int(m[2]), minutes=int(m[3] or 0))
        return (wall - (shift if m[1] == "+" else -shift) - _EPOCH_START) // _US
    return _lettered_us(wall, mark, zone) if zone else None


def parse(raw: str | None, tz_name: str | None, date_order: str | None) -> tuple[str, int, int] | None:
    """``(kind, value, days)`` of one notation, or None if it names no day or moment.

    Kind ``at``: value is the instant in microseconds. Kind ``ago``: value is
    how long before the row's own moment. Kind ``day``: value is a time of day
    on the zone's clock, ``days`` before the day of the row's own moment.
    Missing smaller units are zero; values coarser than a day, impossible
    dates and times, and times the clock showed twice or never give None.
    """
    text = (raw or "").translate(_ASCII).strip()
    text = _LABEL.sub("", text, count=1) if _LABEL.match(text) else text
    text = re.sub(r"\s+", " ", text).strip()
    zone = _zone(tz_name) if tz_name else None
    if m := _EPOCH.fullmatch(text):
        if m[1]:
            return "at", int(m[1]) * 1_000_000, 0
        return ("at", int(m[2]) * 1000, 0) if m[2] else ("at", int(m[3]), 0)
    if m := _AGO.fullmatch(text):
        return "ago", int(m["n"]) * _UNITS_US[m["u"].lower()], 0
    if _NOW.fullmatch(text):
        return "ago", 0, 0
    if m := _BACK.fullmatch(text):
        at = _clock(m.groupdict())
        if at is None or zone is None:
            return None
        h, mi, s, us = at
        return "day", ((h * 60 + mi) * 60 + s) * 1_000_000 + us, _DAYS_BACK[m["w"].lower()]
    for notation in _NOTATIONS:
        m = notation.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        if g.get("a"):
            order = (date_order or "").lower()
            if order == "dmy":
                day, month = int(g["a"]), int(g["b"])
            elif order == "mdy":
                month, day = int(g["a"]), int(g["b"])
            else:
                return None
        else:
            day = int(g["d"])
            month = int(g["mo"]) if g.get("mo") else _MONTH_NAMES[g["mon"].lower()]
        at = _clock(g)
        if at is None:
            return None
        try:
            wall = datetime(int(g["y"]), month, day, *at)
        except ValueError:
            return None
        us = _placed(wall, g.get("zone"), zone)
        return None if us is None else ("at", us, 0)
    return None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [parse(*x) for x in zip(b["raw"], b["tz"], b["date_order"], strict=True)]
        out = b[["raw", "tz", "date_order"]].copy()
        out["kind"] = [g[0] if g else "none" for g in got]
        out["value"] = [g[1] if g else 0 for g in got]
        out["days"] = [g[2] if g else 0 for g in got]
        yield out


_ENTRY = "raw string, tz string, date_order string, kind string, value bigint, days int"
_KEY = ["raw", "tz", "date_order"]


def refresh_dictionary(keys: DataFrame, path: str) -> DataFrame:
    """The dictionary at ``path``, after parsing those of ``keys`` it lacked.

    ``keys`` has distinct ``raw``, ``tz`` and ``date_order`` without nulls.
    What is parsed is appended; a run that breaks off leaves no part behind
    that is read later. Two runs at once may append the same keys: they are
    read once, as equal keys have equal entries. Empty keys leave the
    dictionary as it is.
    """
    spark = keys.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def kept() -> DataFrame:
        return spark.read.schema(_ENTRY).option("recursiveFileLookup", True).parquet(path)

    fresh = keys.join(kept().select(*_KEY), _KEY, "left_anti") if there else keys
    # Each run has a folder of its own, so that no two commit in one.
    fresh.mapInPandas(_parsed, _ENTRY).write.parquet(f"{path}/run={uuid.uuid4().hex}")
    return kept().dropDuplicates(_KEY)


def _day_us(moment: Column, tz: Column, value: Column, days: Column) -> Column:
    """A time of day on the zone's clock, days before the day of ``moment``; null if shown twice or never."""
    shown = F.unix_micros(F.from_utc_timestamp(moment, tz))
    wall = F.floor(shown / F.lit(DAY_US)).cast("bigint") * DAY_US - days * F.lit(DAY_US) + value
    at = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), tz))

    def shows(us: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), tz)) == wall

    half_hour = 1_800_000_000
    again = F.lit(False)
    for k in (1, 2, 4):
        again = again | shows(at + F.lit(k * half_hour)) | shows(at - F.lit(k * half_hour))
    return F.when(shows(at) & ~again, at)


def normalize_instants(
    rows: DataFrame,
    id_col: str,
    raw: Column,
    site: Column,
    moment: Column,
    sites: DataFrame,
    total: int,
    dictionary: str | None = None,
) -> DataFrame:
    """``(id, publish_us)`` of each row whose ``raw`` names one day or moment.

    ``sites`` gives each site's ``tz_name`` and ``date_order``; for other sites
    only values that carry a zone, count seconds since 1970 or count back by a
    span are known. ``moment`` is when the row was fetched. ``total`` is about
    how many rows there are. Null and blank values, unknown notations,
    impossible dates and an empty table give no row; repeated rows give one
    each. ``dictionary`` is the folder of the kept dictionary, by default one
    in the shared folder, which all applications with that folder extend.
    """
    spark = rows.sparkSession
    if dictionary is None:
        dictionary = os.path.join(shared_dir(spark), f"inkwell-instants-v{VERSION}")
    clock = sites.select(F.col("site").alias("_site"), "tz_name", "date_order").dropDuplicates(["_site"])
    base = rows.select(F.col(id_col).alias("_id"), strip(raw).alias("raw"), site.alias("_site"), moment.alias("_moment"))
    base = base.where(F.col("raw").rlike("[0-9]") | F.col("raw").rlike("^(?i:刚刚|刚才|just now|now|今天|今日|today|昨天|昨日|yesterday|前天|前日)"))
    base = base.join(clock, "_site", "left").select(
        "_id",
        "raw",
        "_moment",
        F.coalesce("tz_name", F.lit("")).alias("tz"),
        F.coalesce("date_order", F.lit("")).alias("date_order"),
    )
    keys = materialize(base.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_n")), "instant-keys")
    entries = refresh_dictionary(keys.select(*_KEY), dictionary)
    known = keys.join(entries.where("kind <> 'none'"), _KEY)
    got = lookup_join(base, known, _KEY, "_n", total, "_id").where(F.col("kind").isNotNull())
    us = (
        F.when(F.col("kind") == "at", F.col("value"))
        .when(F.col("kind") == "ago", F.unix_micros("_moment") - F.col("value"))
        .otherwise(_day_us(F.col("_moment"), F.col("tz"), F.col("value"), F.col("days")))
    )
    return got.select(F.col("_id").alias(id_col), us.alias("publish_us")).where(F.col("publish_us").isNotNull())
