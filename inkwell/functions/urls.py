"""URL expressions: the page key of an address and the site of a hit.

All are Catalyst expressions, so a filter or a group on a page needs no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track, by prefix and by name.
TRACKING_PREFIXES = ("utm_",)
TRACKING_KEYS = (
    "spm",
    "gclid",
    "yclid",
    "msclkid",
    "vd_source",
    "share_source",
    "share_medium",
    "share_token",
    "shareid",
)
# Host prefixes of which one is dropped, in this order.
HOST_PREFIXES = ("www.", "m.", "mobile.", "wap.", "amp.")
# File names that stand for their folder.
INDEX_FILES = ("index.html", "index.htm", "index.php")

# Unicode white space as Java names it, plus the four separators 1C..1F.
SPACE = r"[\p{IsWhite_Space}\x1C-\x1F]"
_EDGE = rf"^{SPACE}+|{SPACE}+$"
# What a URL parser drops wherever it stands.
_DROPPED = r"[\t\r\n]"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_LEAD = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"
_AUTHORITY = _LEAD + r"//([^/?#]*)"
_PATH = _LEAD + r"(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim knows the space only)."""
    return F.regexp_replace(text, _EDGE, "")


def _any_prefix(value: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | value.startswith(prefix)
    return found


def _decoded(text: Column) -> Column:
    """A form-encoded piece as text; a percent sign without two digits stays as it is."""
    sane = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(sane), text)


def _encoded(text: Column) -> Column:
    """Form encoding that keeps ``~`` and encodes ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it.

    Without it the nested expressions below would be evaluated again at every
    mention, inside every branch.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(url: Column) -> Column:
    """Scheme, authority, path, query and fragment of an address, as a struct."""

    def cut(text: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(text, _SCHEME, 1)).alias("scheme"),
            F.regexp_extract(text, _AUTHORITY, 1).alias("authority"),
            F.regexp_extract(text, _PATH, 1).alias("path"),
            F.regexp_extract(text, _QUERY, 1).alias("query"),
            F.regexp_extract(text, r"(?s)^[^#]*#(.*)$", 1).alias("fragment"),
        )

    return let(F.regexp_replace(strip(url), _DROPPED, ""), cut)


def _host_port(authority: Column) -> Column:
    """Lower-case host and port text of an authority, as a struct; user data dropped."""

    def cut(inner: Column) -> Column:
        bracketed = inner.startswith("[")
        host = F.when(bracketed, F.regexp_extract(inner, r"^\[([^\]]*)\]", 1)).otherwise(
            F.regexp_extract(inner, r"^([^:]*)", 1)
        )
        port = F.when(bracketed, F.regexp_extract(inner, r"^\[[^\]]*\](?::(.*))?$", 1)).otherwise(
            F.regexp_extract(inner, r"^[^:]*:(.*)$", 1)
        )
        return F.struct(F.lower(host).alias("host"), port.alias("port"))

    return let(F.regexp_replace(authority, r"^.*@", ""), cut)


def _place(p: Column) -> Column:
    """Host and port as they count for the page; null where they cannot be parsed."""

    def short(host: Column) -> Column:
        branch = None
        for prefix in HOST_PREFIXES:
            test = host.startswith(prefix) & (F.length(host) > len(prefix) + 3)
            value = F.substring(host, len(prefix) + 1, 1 << 30)
            branch = F.when(test, value) if branch is None else branch.when(test, value)
        return branch.otherwise(host)

    def joined(hp: Column) -> Column:
        port = hp["port"]
        unreadable = (port != "") & (
            ~port.rlike(r"^[0-9]{1,9}$") | (F.try_to_number(port, F.lit("999999999")) > 65535)
        )
        number = F.regexp_replace(port, r"^0+(?=[0-9])", "")
        default = ((p["scheme"] == "http") & (number == "80")) | ((p["scheme"] == "https") & (number == "443"))
        host = let(
            short(hp["host"]), lambda h: F.when(h.contains(":"), F.concat(F.lit("["), h, F.lit("]"))).otherwise(h)
        )
        return F.when(unreadable, F.lit(None).cast("string")).otherwise(
            F.concat(host, F.when((number == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number)))
        )

    torn = p["authority"].contains("[") != p["authority"].contains("]")
    return F.when(torn, F.lit(None).cast("string")).otherwise(let(_host_port(p["authority"]), joined))


def _query(query: Column) -> Column:
    def pair(piece: Column) -> Column:
        key = F.regexp_extract(piece, r"(?s)^([^=]*)", 1)
        value = F.regexp_extract(piece, r"(?s)^[^=]*=(.*)$", 1)
        return F.struct(_decoded(key).alias("k"), _decoded(value).alias("v"))

    def counts(kv: Column) -> Column:
        return let(F.lower(kv["k"]), lambda key: ~(key.isin(*TRACKING_KEYS) | _any_prefix(key, TRACKING_PREFIXES)))

    pairs = F.filter(F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), pair), counts)
    line = F.array_join(
        F.transform(F.array_sort(pairs), lambda kv: F.concat(_encoded(kv["k"]), F.lit("="), _encoded(kv["v"]))), "&"
    )
    return F.when(query == "", F.lit("")).otherwise(let(line, lambda x: F.when(x == "", x).otherwise(F.concat(F.lit("?"), x))))


def _page_path(path: Column) -> Column:
    index = "/(?:" + "|".join(re.escape(x) for x in INDEX_FILES) + ")$"
    return let(
        F.regexp_replace(path, index, "/"),
        lambda x: F.when(F.length(x) > 1, F.regexp_replace(x, r"/+$", "")).otherwise(x),
    )


def _anchor(fragment: Column) -> Column:
    return F.when(fragment == "", fragment).otherwise(
        let(
            F.regexp_extract(fragment, r"(?s)^(.*?)(?::~:.*)?$", 1),
            lambda x: F.when(x.rlike(r"^[/!]") | x.contains("="), F.concat(F.lit("#"), x)).otherwise(F.lit("")),
        )
    )


def canonical_url(url: Column) -> Column:
    """The key under which all notations of one page fall together.

    The scheme, one known host prefix, the default port, tracking parameters,
    an index file, a final slash and a section anchor do not count; parameters
    are sorted and encoded anew. Null and blank give ``''``. An address that
    cannot be parsed (port no number or above 65535, unclosed bracket) gives
    itself, stripped.
    """

    def whole(x: Column) -> Column:
        where, path = x["where"], x["path"]
        slash = F.when((where != "") & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
        head = F.when((where != "") | path.startswith("//"), F.lit("//")).otherwise(F.lit(""))
        return F.concat(head, where, slash, path, x["query"], x["anchor"])

    def built(p: Column) -> Column:
        return F.struct(
            _place(p).alias("where"),
            _page_path(p["path"]).alias("path"),
            _query(p["query"]).alias("query"),
            _anchor(p["fragment"]).alias("anchor"),
        )

    key = let(let(_pieces(url), built), whole)
    return F.when(url.isNull(), F.lit("")).otherwise(F.coalesce(key, strip(url)))


def host_of(url: Column) -> Column:
    """The lower-case host without port; ``''`` where there is none."""
    text = F.regexp_replace(strip(url), _DROPPED, "")
    return F.coalesce(_host_port(F.regexp_extract(text, _AUTHORITY, 1))["host"], F.lit(""))


def site_of(site: Column, url: Column) -> Column:
    """``site``, or where it is null or blank the host without one leading ``www.``."""
    blank = site.isNull() | (strip(site) == "")
    return F.when(blank, F.regexp_replace(host_of(url), r"^www\.", "")).otherwise(site)
