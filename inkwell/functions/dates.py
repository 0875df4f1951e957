"""Date and freshness expressions. ``as_of`` is always given; nothing reads the clock."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.urls import let, strip

# Words that ask for what is fresh, and characters before them that make another word.
FRESH_STRONG = ("今天", "今日", "现在", "实时", "刚刚", "当前")
FRESH_WEAK = ("最新", "近期", "本周", "本月")
_BOOK = "日成资版基根剧课文样副脚原标范台蓝读抄摹这那该某几一两三四五六七八九十半整"
BLOCKED_BEFORE = {
    "本周": _BOOK,
    "本月": _BOOK,
    "现在": "出表体展浮涌显呈实兑",
    "当前": "应理相适恰正妥停担充",
    "实时": "真确属事着落务写",
    "今日": "如当至",
    "今天": "如当至",
    "近期": "附邻靠接临远最贴",
}
FRESH_EN = "latest|today|current|recent|now|breaking"
FRESH_STRONG_EN = "today|now|breaking"
LIVE_TOPICS = "天气|股价|汇率|比分"
LIVE_TOPICS_EN = "weather|stock price|exchange rate|live score"
BACKGROUND = "历史|往年|去年|昨天|昨日|原理|算法|模型|预测方法|接口|数据集|气候|研究|论文|文档|教程|是什么"
BACKGROUND_EN = (
    "history|historical|yesterday|last year|theory|algorithm|model|models|api|dataset|datasets|"
    "forecasting|research|paper|papers|documentation|tutorial"
)
EVENT_TITLES = "回顾|复盘|纪念|周年|历史|retrospect|recap|anniversary"
PRICE_UNITS = r"(?:元|块|美元|港元|点|%|(?:USD|RMB|CNY|HKD|pts)(?![A-Za-z]))"
PRICE_LEADS = r"(?:跌破|突破|站上|收于|报|涨至|跌至|[$¥￥]|(?<![A-Za-z])(?:below|above|under|over|at))"


def _bounded(words: str) -> str:
    return rf"(?i)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def _chinese(words: tuple[str, ...]) -> str:
    """One alternation: each word, unless one of its blockers stands before it."""
    return "|".join(rf"(?<![{BLOCKED_BEFORE[w]}]){w}" if w in BLOCKED_BEFORE else w for w in words)


def to_day(text: Column) -> Column:
    """A real day written yyyy-mm-dd and nothing else; else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (text >= "0001"), text.try_cast("date"))


def valid_date(text: Column) -> Column:
    return F.coalesce(to_day(text).isNotNull(), F.lit(False))


def _range(text: Column) -> tuple[Column, Column]:
    t = strip(text)
    shape = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})\.\.([0-9]{4}-[0-9]{2}-[0-9]{2})\z"
    return to_day(F.regexp_extract(t, shape, 1)), to_day(F.regexp_extract(t, shape, 2))


def valid_time_range(text: Column) -> Column:
    """One of the four spans by name, or ``A..B`` of real days, A not after B."""
    start, end = _range(text)
    return F.coalesce(text.isin("OneDay", "OneWeek", "OneMonth", "OneYear") | (start <= end), F.lit(False))


def time_range_is_fresh(text: Column, as_of: datetime.date) -> Column:
    """A day, week or month by name, or a span that reaches today."""
    _, end = _range(text)
    return F.coalesce(text.isin("OneDay", "OneWeek", "OneMonth"), F.lit(False)) | F.coalesce(end >= F.lit(as_of), F.lit(False))


def time_range_is_strong(text: Column, as_of: datetime.date) -> Column:
    """One day by name, or a span of a day at most that covers today."""
    start, end = _range(text)
    span = (start <= F.lit(as_of)) & (end >= F.lit(as_of)) & (F.datediff(end, start) <= 1)
    return F.coalesce(text == "OneDay", F.lit(False)) | F.coalesce(span, F.lit(False))


def query_has_past_date(text: Column, as_of: datetime.date) -> Column:
    """Whether a query names a day or year before today.

    A day without a year is one of this year. A bare year counts unless a unit
    or a verb of prices stands beside it or the topic is a share price; with
    年 behind or in/during/for before it counts anyway.
    """

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")

    day = F.regexp_extract_all(text, F.lit(r"(?<![0-9])[0-9]{4}(?:[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?|[0-9]{4})(?![0-9])"), F.lit(0))
    shape = r"^([0-9]{4})[-/年]?([0-9]{1,2}?)[-/月]?([0-9]{1,2})日?\z"
    compact = r"^([0-9]{4})([0-9]{2})([0-9]{2})\z"

    def past(x: Column) -> Column:
        pattern = F.when(x.rlike(compact), F.regexp_replace(x, compact, "$1-$2-$3")).otherwise(F.regexp_replace(x, shape, "$1-$2-$3"))
        return let(
            F.split(pattern, "-"), lambda p: F.coalesce(made(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.lit(2))) < F.lit(as_of), F.lit(False))
        )

    short = F.regexp_extract_all(text, F.lit(r"(?<![0-9])(?<![0-9]{4}年)[0-9]{1,2}月[0-9]{1,2}日"), F.lit(0))

    def past_short(x: Column) -> Column:
        m, d = F.regexp_extract(x, r"^([0-9]+)月", 1), F.regexp_extract(x, r"月([0-9]+)日", 1)
        return F.coalesce(made(F.lit(f"{as_of.year:04}"), m, d) < F.lit(as_of), F.lit(False))

    year = r"(?<![A-Za-z0-9_])(?:19|20)[0-9]{2}(?![A-Za-z0-9_])"
    older = lambda x: F.substring(F.regexp_extract(x, r"((?:19|20)[0-9]{2})", 1), 1, 4).cast("int") < as_of.year
    sure = F.regexp_extract_all(text, F.lit(year + r"\s*年|(?i:\b(?:in|during|for)\s+(?:the\s+year\s+)?)" + year), F.lit(0))
    bare = F.regexp_extract_all(text, F.lit(rf"(?<!(?:{PRICE_LEADS})\s{{0,8}})" + year + rf"(?!\s*{PRICE_UNITS})"), F.lit(0))
    share_price = text.contains("股价") | text.rlike(_bounded("stock price"))
    return (
        F.exists(day, past) | F.exists(short, past_short) | F.exists(sure, older) | (~share_price & F.exists(bare, older))
    )


def implicit_fresh(text: Column, as_of: datetime.date) -> Column:
    """A live topic without background words and without a past date."""
    topic = text.rlike(LIVE_TOPICS) | text.rlike(_bounded(LIVE_TOPICS_EN))
    return topic & ~(text.rlike(BACKGROUND) | text.rlike(_bounded(BACKGROUND_EN)) | query_has_past_date(text, as_of))


def is_fresh_query(text: Column, as_of: datetime.date, allow_implicit: bool = True) -> Column:
    t = F.coalesce(text, F.lit(""))
    named = t.rlike(_chinese(FRESH_STRONG + FRESH_WEAK)) | t.rlike(_bounded(FRESH_EN))
    return named | implicit_fresh(t, as_of) if allow_implicit else named


def is_strong_fresh_query(text: Column, as_of: datetime.date, allow_implicit: bool = True) -> Column:
    t = F.coalesce(text, F.lit(""))
    named = t.rlike(_chinese(FRESH_STRONG)) | t.rlike(_bounded(FRESH_STRONG_EN))
    return named | implicit_fresh(t, as_of) if allow_implicit else named


def recency_bonus(publish: Column, as_of: datetime.date, strong: Column | bool = False) -> Column:
    """Weight of a publishing day: strong in four steps, weak by half every 30 days; 0 if unknown or over a day ahead."""
    day = to_day(F.substring(strip(publish), 1, 10))
    age = F.datediff(F.lit(as_of), day)
    steps = F.when(age <= 2, 0.03).when(age <= 14, 0.01).when(age <= 90, -0.10).otherwise(-0.20)
    weak = F.lit(0.03) * F.pow(F.lit(2.0), -F.greatest(age, F.lit(0)) / F.lit(30.0))
    flag = strong if isinstance(strong, Column) else F.lit(strong)
    return F.when(age.isNull() | (age < -1), F.lit(0.0)).when(flag, steps).otherwise(weak)


def ranking_date(title: Column, path: Column, publish: Column, as_of: datetime.date) -> Column:
    """The day to rank by: the only valid one in a live title, else in the path, else ``publish``.

    A title that looks back on an event gives none. Eight digits in a path are
    a day only from five years before to one after the publishing year.
    """

    def days(found: Column, shape: str) -> Column:
        each = F.transform(found, lambda x: F.regexp_replace(x, shape, "$1-$2-$3"))
        made = F.transform(
            each,
            lambda x: let(
                F.split(x, "-"),
                lambda p: F.concat_ws("-", F.get(p, F.lit(0)), F.lpad(F.get(p, F.lit(1)), 2, "0"), F.lpad(F.get(p, F.lit(2)), 2, "0")).try_cast("date"),
            ),
        )
        return F.array_distinct(F.filter(made, lambda d: d.isNotNull()))

    live = (title.rlike(LIVE_TOPICS) | title.rlike(_bounded(LIVE_TOPICS_EN))) & ~title.rlike(f"(?i){EVENT_TITLES}")
    told = F.when(live, title).otherwise(F.lit(""))
    long_ = F.regexp_extract_all(told, F.lit(r"(?<![0-9])[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?(?![0-9])"), F.lit(0))
    short = F.regexp_extract_all(told, F.lit(r"(?<![0-9])[0-9]{8}(?![0-9])"), F.lit(0))
    in_title = F.array_union(
        days(long_, r"^([0-9]{4})[-/年]([0-9]{1,2})[-/月]([0-9]{1,2})日?$"), days(short, r"^([0-9]{4})([0-9]{2})([0-9]{2})$")
    )
    parts = F.regexp_extract_all(path, F.lit(r"(?:^|/|_)[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(?![0-9])"), F.lit(0))
    packed = F.regexp_extract_all(path, F.lit(r"(?i)(?:^|/|_)[0-9]{8}(?=\.html?(?:$|/)|_)"), F.lit(0))
    year = F.coalesce(F.year(to_day(F.substring(publish, 1, 10))), F.lit(as_of.year))
    near = F.filter(
        days(packed, r"^[/_]?([0-9]{4})([0-9]{2})([0-9]{2})$"), lambda d: (F.year(d) >= year - 5) & (F.year(d) <= year + 1)
    )
    in_path = F.array_union(days(parts, r"^[/_]?([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"), near)
    return (
        F.when(F.size(in_title) == 1, F.get(in_title, F.lit(0)).cast("string"))
        .when(F.size(in_path) == 1, F.get(in_path, F.lit(0)).cast("string"))
        .otherwise(publish)
    )
