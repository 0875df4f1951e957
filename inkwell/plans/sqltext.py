"""Pieces of the SQL that the queries are checked against."""

from __future__ import annotations

from inkwell.functions.urls import HOST_PREFIXES, TRACKING_KEYS

_SPACE = r"[\s\p{Z}\x{0085}\x{001C}-\x{001F}]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def pages_cte(source: str) -> str:
    """CTEs up to ``pages(url, page)``, for the distinct addresses of ``SELECT url FROM source``."""
    cut = "host"
    for p in reversed(HOST_PREFIXES):
        cut = f"CASE WHEN starts_with(host, '{p}') AND length(host) > {len(p) + 3} THEN substr(host, {len(p) + 1}) ELSE {cut} END"
    # Nested from the last prefix outwards, so the first that fits decides.
    keys = ", ".join(f"'{k}'" for k in TRACKING_KEYS)
    return rf"""
u0 AS (SELECT DISTINCT url FROM ({source}) WHERE url IS NOT NULL),
u1 AS (SELECT url, regexp_replace({strip_sql("url")}, '[\t\r\n]', '', 'g') AS t FROM u0),
u2 AS (SELECT url, lower(regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
  regexp_replace(t, '^[A-Za-z][A-Za-z0-9+.\-]*:', '') AS rest FROM u1),
u3 AS (SELECT url, scheme, regexp_replace(regexp_extract(rest, '^//([^/?#]*)', 1), '^.*@', '') AS authority,
  regexp_extract(rest, '^(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query,
  regexp_extract(rest, '^[^#]*#(.*)$', 1) AS fragment FROM u2),
u4 AS (SELECT *, lower(regexp_extract(authority, '^([^:]*)', 1)) AS host,
  regexp_replace(regexp_extract(authority, '^[^:]*:(.*)$', 1), '^0+([0-9])', '\1') AS port,
  regexp_replace(path, '/(index\.html|index\.htm|index\.php)$', '/') AS p1,
  regexp_replace(fragment, ':~:.*$', '') AS f1 FROM u3),
u5 AS (SELECT url, {cut} ||
  CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END AS place,
  CASE WHEN length(p1) > 1 THEN regexp_replace(p1, '/+$', '') ELSE p1 END AS path,
  list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''),
    lambda x: [url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))]),
    lambda kv: NOT (starts_with(lower(kv[1]), 'utm_') OR lower(kv[1]) IN ({keys})))) AS pairs,
  CASE WHEN f1 LIKE '/%' OR f1 LIKE '!%' OR f1 LIKE '%=%' THEN '#' || f1 ELSE '' END AS anchor FROM u4),
pages AS (SELECT url, CASE WHEN place <> '' OR path LIKE '//%' THEN '//' ELSE '' END || place ||
  CASE WHEN place <> '' AND path <> '' AND NOT starts_with(path, '/') THEN '/' ELSE '' END || path ||
  CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_transform(pairs,
    lambda kv: replace(replace(url_encode(kv[1]), '%20', '+'), '*', '%2A') || '=' || replace(replace(url_encode(kv[2]), '%20', '+'), '*', '%2A')), '&') ELSE '' END
  || anchor AS page FROM u5)"""


def host_sql(url: str) -> str:
    """Lower-case host without port."""
    t = rf"regexp_replace({strip_sql(url)}, '[\t\r\n]', '', 'g')"
    a = rf"regexp_replace(regexp_extract({t}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^.*@', '')"
    return rf"coalesce(lower(regexp_extract({a}, '^([^:]*)', 1)), '')"


def site_sql(site: str, url: str) -> str:
    return rf"CASE WHEN {site} IS NULL OR {strip_sql(site)} = '' THEN regexp_replace({host_sql(url)}, '^www\.', '') ELSE {site} END"
