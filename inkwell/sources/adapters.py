"""Recorded source responses as rows: JSON of each source to hits, pages, errors and warnings.

A table with ``query_id`` and ``raw``, the response as text, is read; the
network is not part of the engine. Missing values have defaults, values out of
their domain become null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.dates import valid_date, valid_time_range

_WEB = (
    "array<struct<Url:string,Title:string,SiteName:string,Summary:string,Content:string,Snippet:string,PublishTime:string,"
    "AuthInfoLevel:string,RankScore:string,RuyiInfo:struct<Type:string>,InlineImages:array<struct<ImageUrl:string,Width:string,Height:string,Alt:string>>>>"
)
_PICTURES = (
    "array<struct<Url:string,Title:string,SiteName:string,PublishTime:string,RankScore:string,Image:struct<Url:string,Width:string,Height:string,"
    "Shape:string,BlurDes:string,Watermark:string,Category:string,Features:struct<Description:string,StyleType:string,EntityType:string>>>>"
)
_RESULT = f"struct<ErrorCode:string,WebResults:{_WEB},ImageResults:{_PICTURES},CardResults:array<map<string,string>>>"
FIRST = f"struct<ResponseMetadata:struct<Error:struct<Code:string,Message:string>>,Result:{_RESULT}>"
IMAGE = ("url", "width", "height", "alt", "shape", "blur", "watermark", "style")
SECOND = (
    "struct<results:array<struct<url:string,title:string,publish_date:string,excerpts:array<string>,full_content:string>>,session_id:string,"
    "warnings:array<string>,errors:array<struct<url:string,error_type:string>>>"
)
#: Most results, sites, blocked hosts, addresses and query characters of a request.
MOST_RESULTS, MOST_IMAGES, MOST_SECOND, MOST_SITES, MOST_BLOCKED, MOST_URLS, QUERY_CHARS, KEYWORDS = 50, 5, 20, 20, 5, 20, 100, 5


def _filled(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _score(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x <= 1), x)


def _authority(text: Column) -> Column:
    return F.when(text.rlike(r"^[1-4]\z"), text.cast("int"))


def map_first(responses: DataFrame) -> DataFrame:
    """Hits of the first source: rank is the place in the array, the body the summary, else content, else snippet."""
    got = responses.select("query_id", F.from_json("raw", FIRST).alias("r"))
    rows = got.select("query_id", F.posexplode("r.Result.WebResults").alias("k", "w"))
    w = F.col("w")
    return rows.select(
        "query_id", F.coalesce(w["Url"], F.lit("")).alias("url"), F.coalesce(w["Title"], F.lit("")).alias("title"),
        _filled(w["Summary"], w["Content"], w["Snippet"]).alias("body"), F.coalesce(w["SiteName"], F.lit("")).alias("site"),
        F.lit("doubao").alias("source"), (F.col("k") + 1).alias("rank"), w["PublishTime"].alias("publish"),
        _authority(w["AuthInfoLevel"]).alias("authority"), _score(w["RankScore"]).alias("rank_score"), w["RuyiInfo"]["Type"].alias("ruyi"),
        F.transform(
            F.coalesce(w["InlineImages"], F.array().cast("array<struct<ImageUrl:string,Width:string,Height:string,Alt:string>>")),
            lambda i: _image(i["ImageUrl"], i["Width"], i["Height"], i["Alt"]),
        ).alias("images"),
    )


def _image(*values: Column) -> Column:
    """An image of the hits' form; members not given are null."""
    given = [*values, *[F.lit(None)] * (len(IMAGE) - len(values))]
    return F.struct(*[v.cast("string").alias(k) for k, v in zip(IMAGE, given, strict=True)])


def map_images(responses: DataFrame) -> DataFrame:
    """Image hits of the first source: one image each, its description the body."""
    rows = responses.select("query_id", F.posexplode(F.from_json("raw", FIRST)["Result"]["ImageResults"]).alias("k", "w"))
    w, image = F.col("w"), F.col("w")["Image"]
    told = image["Features"]["Description"]
    shown = _image(
        image["Url"], image["Width"], image["Height"], F.coalesce(F.nullif(told, F.lit("")), w["Title"]), image["Shape"], image["BlurDes"],
        F.when(image["Watermark"] == "1", "watermark"), image["Features"]["StyleType"],
    )
    return rows.select(
        "query_id", F.coalesce(w["Url"], F.lit("")).alias("url"), F.coalesce(w["Title"], F.lit("")).alias("title"), F.coalesce(told, F.lit("")).alias("body"),
        F.coalesce(w["SiteName"], F.lit("")).alias("site"), F.lit("doubao").alias("source"), (F.col("k") + 1).alias("rank"), w["PublishTime"].alias("publish"),
        _score(w["RankScore"]).alias("rank_score"), F.array(shown).alias("images"), image["Category"].alias("category"),
    )


def map_cards(responses: DataFrame) -> DataFrame:
    """``query_id, place, kind, card``: the structured answers of the first source, whole."""
    rows = responses.select("query_id", F.posexplode(F.from_json("raw", FIRST)["Result"]["CardResults"]).alias("k", "card"))
    return rows.select("query_id", (F.col("k") + 1).alias("place"), F.try_element_at("card", F.lit("CardType")).alias("kind"), "card")


def map_second(responses: DataFrame) -> DataFrame:
    """Hits of the second source: the body is its excerpts, a line each."""
    rows = responses.select("query_id", F.posexplode(F.from_json("raw", SECOND)["results"]).alias("k", "w"))
    w = F.col("w")
    return rows.select(
        "query_id", F.coalesce(w["url"], F.lit("")).alias("url"), F.coalesce(w["title"], F.lit("")).alias("title"),
        F.coalesce(F.array_join(w["excerpts"], "\n"), F.lit("")).alias("body"), F.lit("").alias("site"), F.lit("parallel").alias("source"),
        (F.col("k") + 1).alias("rank"), w["publish_date"].alias("publish"), F.lit(None).cast("int").alias("authority"),
        F.lit(None).cast("double").alias("rank_score"), F.lit(None).cast("string").alias("ruyi"),
    )


def extract_pages(responses: DataFrame, max_chars: int) -> DataFrame:
    """Fetched pages: the full content, else the excerpts; each result has an even part of the budget, 500 at least."""
    got = responses.select("query_id", F.slice(F.from_json("raw", SECOND)["results"], 1, MOST_URLS).alias("r"))
    share = F.greatest(F.floor(F.lit(max_chars) / F.greatest(F.size("r"), F.lit(1))), F.lit(500)).cast("int")
    rows = got.select("query_id", share.alias("share"), F.posexplode("r").alias("k", "w"))
    w = F.col("w")
    body = _filled(w["full_content"], F.array_join(w["excerpts"], "\n"))
    return rows.select(
        "query_id", (F.col("k") + 1).alias("place"), w["url"].alias("url"), w["title"].alias("title"), w["publish_date"].alias("publish"),
        F.substring(body, F.lit(1), F.col("share")).alias("content"),
    )


def source_errors(responses: DataFrame) -> DataFrame:
    """``query_id, error``: the error of each response, by where it stands; null if there is none."""
    r = F.from_json("raw", FIRST)
    meta, code = r["ResponseMetadata"]["Error"], r["Result"]["ErrorCode"]
    error = (
        F.when(meta.isNotNull(), F.concat_ws(": ", meta["Code"], meta["Message"]))
        .when(code.isNotNull() & ~code.isin("", "0"), F.concat(F.lit("ErrorCode "), code))
        .when(r["Result"].isNull(), F.lit("empty result"))
    )
    return responses.select("query_id", error.alias("error"))


def source_warnings(responses: DataFrame) -> DataFrame:
    """``query_id, warning``: warnings and failed addresses, a row each."""
    r = F.from_json("raw", SECOND)
    failed = F.transform(F.coalesce(r["errors"], F.expr("cast(array() as array<struct<url:string,error_type:string>>)")), lambda e: F.concat_ws(" ", e["error_type"], e["url"]))
    every = F.concat(F.coalesce(r["warnings"], F.array().cast("array<string>")), failed)
    return responses.select("query_id", F.explode(every).alias("warning"))


def keywords(queries: Column, objective: Column) -> Column:
    """The first five queries that are not blank, else the objective's start."""
    kept = F.slice(F.filter(F.transform(F.coalesce(queries, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, KEYWORDS)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.substring(F.trim(F.coalesce(objective, F.lit(""))), 1, 120)))


def build_request(
    query: Column, count: Column, sites: Column, blocked: Column, kind: Column | None = None, time_range: Column | None = None, least_authority: Column | None = None
) -> Column:
    """A request of the first source: the query capped, the count within bounds (5 for images), only filters that are set."""
    kind = F.lit("web") if kind is None else kind
    most = F.when(kind == "image", MOST_IMAGES).otherwise(MOST_RESULTS)
    return F.to_json(
        F.struct(
            F.substring(F.trim(query), 1, QUERY_CHARS).alias("query"),
            F.when(kind == "image", F.lit("image")).alias("type"),
            F.greatest(F.least(F.coalesce(count, F.lit(10)), most), F.lit(1)).alias("count"),
            F.when(F.size(sites) > 0, F.array_join(F.slice(sites, 1, MOST_SITES), "|")).alias("sites"),
            F.when((F.size(blocked) > 0) & ~(F.coalesce(F.size(sites), F.lit(0)) > 0), F.array_join(F.slice(blocked, 1, MOST_BLOCKED), "|")).alias("block_hosts"),
            (F.lit(None).cast("string") if time_range is None else F.when(valid_time_range(time_range), time_range)).alias("time_range"),
            (F.lit(None).cast("int") if least_authority is None else F.when(least_authority.between(1, 4), least_authority)).alias("auth_level"),
        )
    )


def _policy(include: Column, exclude: Column) -> Column:
    """Domains of a request: those to include make those to exclude idle."""
    some, others = F.coalesce(F.size(include), F.lit(0)) > 0, F.coalesce(F.size(exclude), F.lit(0)) > 0
    return F.struct(F.when(some, include).alias("include_domains"), F.when(~some & others, exclude).alias("exclude_domains"))


def build_second(objective: Column, queries: Column, include: Column, exclude: Column, count: Column) -> Column:
    """A request of the second source as JSON."""
    most = F.greatest(F.least(F.coalesce(count, F.lit(10)), F.lit(MOST_SECOND)), F.lit(1))
    return F.to_json(F.struct(F.trim(objective).alias("objective"), queries.alias("search_queries"), most.alias("max_results"), _policy(include, exclude).alias("source_policy")))


def second_command(objective: Column, queries: Column, include: Column, exclude: Column, count: Column) -> Column:
    """The same request as the arguments of a command; what follows ``--`` is no option, whatever it begins with."""
    policy = _policy(include, exclude)

    def each(option: str, values: Column) -> Column:
        return F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.array(F.lit(option), v)))

    most = F.greatest(F.least(F.coalesce(count, F.lit(10)), F.lit(MOST_SECOND)), F.lit(1)).cast("string")
    return F.concat(
        F.array(F.lit("search"), F.lit("--json"), F.lit("--max-results"), most), each("--query", queries), each("--include-domain", policy["include_domains"]),
        each("--exclude-domain", policy["exclude_domains"]), F.array(F.lit("--"), F.trim(objective)),
    )


def text_or(first: str, other: str) -> Column:
    """A text, or another where it is null or blank; both stripped."""
    return F.coalesce(F.nullif(F.trim(F.col(first)), F.lit("")), F.trim(F.col(other)))


def argument_error(query: Column, count: Column, budget: Column, source: Column, kind: Column, time_range: Column, after: Column) -> Column:
    """The first thing wrong with the arguments of a search, before any source is asked; null if nothing is."""
    return (
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", "empty query")
        .when(count < 1, "count below 1")
        .when(budget < 1, "budget below 1")
        .when((source == "parallel") & (kind == "image"), "no images from this source")
        .when((F.coalesce(time_range, F.lit("")) != "") & ~valid_time_range(time_range), "no such time range")
        .when((F.coalesce(after, F.lit("")) != "") & ~valid_date(after), "no such date")
    )


def dropped_urls(urls: Column) -> Column:
    """A warning where a request names more addresses than one fetch takes."""
    over = F.size(urls) - MOST_URLS
    return F.when(over > 0, F.concat(F.lit("only the first "), F.lit(str(MOST_URLS)), F.lit(" addresses are fetched, "), over.cast("string"), F.lit(" left out")))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """``path, text``: every file below a folder, one row each."""
    df = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_dump(df: DataFrame, path: str) -> None:
    """The full result as JSON lines, at once visible or not at all."""
    df.write.mode("overwrite").json(path)
