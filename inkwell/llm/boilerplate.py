"""Problem 2: the article of a page without the page around it.

Consensus host paths. A body is cut into containers: a paragraph or a heading
is one of its own, items, links and quotes in a row are one together. The path
of a line is its container's tag with the line's generalised class, its text
without digits, targets and white space. A container's score is the share of
its windows of about three words that stand mostly in dense running text over
the whole corpus. Each host's pages vote on its paths with the scores of the
containers they stand in; paths on many hosts are voted on by all. Pages are
then extracted again, by the winning paths where there are some and by their
own containers' scores where there are none.

Bodies are read once, into lines that hold all that is needed later; windows
are counted by their whole 64-bit keys and joined, so nothing that grows with
the corpus is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.urls import canonical_url, site_of, strip
from inkwell.operators.skew import lookup_join
from inkwell.session import materialize

#: So many windows of one batch are counted before they are handed on.
WINDOWS_AT_ONCE = 4_000_000
#: A window belongs to running text if at least this share of its occurrences does.
DENSE_SHARE = 0.3

_TARGET = re.compile(r"\]\([^)\s]*\)")
_ADDRESS = re.compile(r"https?://\S+")
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"\s{0,3}#{1,6}\s+(.*?)\s*#*$")
_BOLD = re.compile(r"\s*(\*\*|__)(?=\S)(.+?)(?<=\S)\1\s*$")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)、])\s+(.*)$")
_NUMBERED = re.compile(r"\s*\d{1,3}\s+(\D.*)$")
_LINK_ONLY = re.compile(r"\s*\[[^\]]*\]\([^)]*\)\s*$")
_SEVERAL_LINKS = re.compile(r"\s*(?:\[[^\]]*\]\([^)]*\)[\s|·•,/-]*){2,}$")
_REFERENCE = re.compile(r"\s*\[\^?\d{1,3}\]:?\s*\S")
_SENTENCE = re.compile(r".+?(?:[。！？!?；;]+[”’\"'）)」』】]*|\.(?=\s|$)[”’\"')]*|$)", re.S)
_END = re.compile(r"(?:[。！？!?]|…|(?<!\d)\.|\d\.(?=$))[”’\"'）)」』】*_]*$")
_CUT = re.compile(r"(?:\[(?:\.{3}|…)\]|\.{3}|…|�)$")
# Words that close a text.
_CLOSING = re.compile(
    r"\W*(?:全文完|本文完|正文完|完|完结|end|the end|fin|end of (?:report|article|story|text|post|document))\W*$", re.I
)
_TRAIL = re.compile(r"[|·>»/]|^\d")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Fold of each code point: small letters, digits alike, white space alike; 0 to skip it."""
    out = np.arange(0x110000, dtype=np.uint64)
    for c in range(0x3001):
        ch = chr(c)
        low = ch.lower()
        out[c] = ord("9") if ch.isdigit() else ord(" ") if ch.isspace() else ord(low) if len(low) == 1 else c
    out[[0x0, 0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]] = 0
    return out


#: Characters of a window: about three words, with and without spaces between words.
_SPACED, _WIDE_SIZE, _WIDE_FROM = 14, 5, 0x2E80
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the windows of about three words of texts, and which text each is from.

    Rolling hashes over folded characters; runs of digits and of white space
    count as one. A window begins at each word, and at each character of a
    script without spaces.
    """
    texts = [_ADDRESS.sub("", _TARGET.sub("]", x)) if "](" in x or "://" in x else x for x in texts]
    sizes = np.array([len(x) for x in texts], np.int64)
    codes = _fold()[np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = codes != 0
    run = (codes[1:] == codes[:-1]) & ((codes[1:] == ord("9")) | (codes[1:] == ord(" "))) & (owner[1:] == owner[:-1])
    kept[1:] &= ~run
    codes, owner = codes[kept], owner[kept]
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(texts))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        down = np.cumprod(np.full(n, _INVERSE, np.uint64))
        up = np.cumprod(np.full(n, _BASE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * down)])
        wide = codes >= _WIDE_FROM
        size = np.where(wide, _WIDE_SIZE, _SPACED)
        begins = np.ones(n, bool)
        begins[1:] = wide[1:] | (codes[:-1] == ord(" ")) | wide[:-1] | (owner[1:] != owner[:-1])
        at = np.flatnonzero(begins & (left >= size) & (codes != ord(" ")))
        keys = (sums[at + size[at]] - sums[at]) * up[at]
        keys ^= keys >> np.uint64(29)
        return (keys * np.uint64(0xC4CEB9FE1A85EC53)).view(np.int64), owner[at]


#: Tags as a path has them: sites write one heading or list in several ways.
_KINDS = {"b": "h", "la": "li", "ni": "li", "a": "li", "q": "p"}


class Line:
    """One line that is not blank: its number, tag, text without marks, and what is known of it."""

    __slots__ = ("no", "tag", "text", "ended", "dense", "blank_before")

    def __init__(self, no: int, tag: str, text: str, blank_before: bool):
        self.no, self.tag, self.text, self.blank_before = no, tag, text, blank_before
        self.ended = bool(_END.search(text[-12:]))
        self.dense = False

    @property
    def path(self) -> int:
        """64 bits of the tag and the generalised class."""
        key = self.text.lower()
        if "](" in key or "://" in key:
            key = _ADDRESS.sub("", _TARGET.sub("]", key))
        key = _DIGITS.sub("9", "".join(key.split()))
        return xxhash.xxh64_intdigest(f"{_KINDS.get(self.tag, self.tag)}{'.' if self.ended else ' '}{key}") - (1 << 63)


def _weight(text: str) -> float:
    """Length in which a character of a script without spaces counts as two letters."""
    return (len(text.encode("utf-8", "ignore")) + len(text)) / 2


def _is_dense(text: str) -> bool:
    """Running text: two sentences or more, each ended, long enough together."""
    if _weight(text) < 80 or not _END.search(text[-12:]):
        return False
    parts = [p for p in _SENTENCE.findall(text) if len(p.strip()) > 1]
    return len(parts) >= 2 and min(map(_weight, parts)) >= 16


_MARKS = frozenset("#*_-+•[>`~|0123456789")
_AROUND = "​‌‍﻿­ \t\r　 "


def _tagged(raw: str, text: str) -> tuple[str, str]:
    """Tag of a line outside code, and its text without marks."""
    if text[0] not in _MARKS:
        return "p", text
    if text[0] == "|":
        return "t", text
    if text[0] == ">":
        return ("q", text.lstrip("> ")) if len(text) > 1 else ("p", text)
    if text[0] == "[":
        if "](" in text:
            return ("m" if _SEVERAL_LINKS.match(raw) else "a" if _LINK_ONLY.match(raw) else "p"), text
        return ("r" if _REFERENCE.match(raw) else "p"), text
    if m := _HEADING.match(raw):
        return "h", m[1]
    if m := _BOLD.match(raw):
        return "b", m[2]
    if m := _ITEM.match(raw):
        return ("la" if _LINK_ONLY.match(m[1]) else "li"), m[1]
    return ("ni" if _NUMBERED.match(raw) else "p"), text


def lines_of(body: str) -> list[Line]:
    """The lines of a body that are not blank, with their tags.

    Tags: h heading, b bold line, li list item, la list item that is one link,
    ni item numbered without a mark, a line that is one link, m line of several
    links, q quote, r reference, t table row, c code, p other.
    """
    out: list[Line] = []
    fence, blank = "", True
    for no, raw in enumerate(body.split("\n"), 1):
        text = raw.strip(_AROUND)
        if not text:
            blank = True
            continue
        mark = _FENCE.match(raw) if text[0] in "`~" else None
        if fence or mark:
            out.append(Line(no, "c", raw, blank))
            if not fence:
                fence = mark[1]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = ""
            blank = False
            continue
        tag, text = _tagged(raw, text)
        line = Line(no, tag, text, blank)
        line.dense = tag in "pq" and _is_dense(text)
        out.append(line)
        blank = False
    return out


_FOLD = re.compile(r"[\W_]+")


def _folded(text: str | None) -> str:
    return _FOLD.sub("", (text or "").lower())


#: Tags whose lines stand together in one container; each other line is one of its own.
_LISTS = frozenset(("li", "la", "ni", "a", "m", "q"))
#: Tags of what belongs to the article wherever it stands: tables, code, references.
_ARTICLE = frozenset(("t", "c", "r"))
# What a line is, in bits.
_ENDED, _DENSE, _BLANK, _TITLED, _CLOSES, _TRAILS, _TORN, _HEADS, _FIRST, _LAST = (1 << k for k in range(10))
_TAGS = ("h", "b", "li", "la", "ni", "a", "m", "q", "r", "t", "c", "p")
_TAG_NUMBER = {tag: k for k, tag in enumerate(_TAGS)}


def _heads_a_list(lines: list[Line], k: int) -> bool:
    """Whether two marked items follow a line at once."""
    after = lines[k + 1 : k + 3]
    return len(after) == 2 and all(x.tag in ("li", "ni", "a") and not x.ended and not x.blank_before for x in after)


def _bits(lines: list[Line], k: int, name: str) -> int:
    line = lines[k]
    said = (line.ended and _ENDED) | (line.dense and _DENSE) | (line.blank_before and _BLANK)
    said |= (bool(name) and _folded(line.text) == name and _TITLED) | (bool(_CLOSING.match(line.text)) and _CLOSES)
    said |= (bool(_TRAIL.search(line.text)) and _TRAILS) | (bool(_CUT.search(line.text)) and _TORN)
    return int(said | (_heads_a_list(lines, k) and _HEADS) | (k == len(lines) - 1 and _LAST))


def containers_of(lines: list[Line]) -> list[list[int]]:
    """The places of the lines of each container: list-like lines of one tag in a row, others alone."""
    out: list[list[int]] = []
    for k, line in enumerate(lines):
        before = lines[k - 1] if k else None
        if before and line.tag in _LISTS and line.tag == before.tag and not line.blank_before and line.dense == before.dense:
            out[-1].append(k)
        else:
            out.append([k])
    return out


_SHAPE = pa.schema(
    [("hit_id", pa.int64()), ("host", pa.string()), ("page", pa.int64()), ("named", pa.bool_()), ("body", pa.string())]
    + [(k, pa.list_(pa.int32())) for k in ("numbers", "tags", "bits")]
    + [(k, pa.list_(pa.int64())) for k in ("paths", "containers", "windows", "dense", "alone", "asked", "asked_windows", "times", "sizes")]
)
_READ = "hit_id bigint, host string, page bigint, named boolean, body string, " + ", ".join(
    f"{f.name} array<{'int' if f.type.value_type == pa.int32() else 'bigint'}>" for f in list(_SHAPE)[5:]
)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys once, with the sums of what belongs to them."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    columns = [np.concatenate([p[k] for p in parts]) for k in range(1, len(parts[0]))]
    return keys, *[np.bincount(at, weights=c, minlength=len(keys)).astype(np.int64) for c in columns]


class _Reading:
    """What one task has read and not handed on yet: windows with their counts, and containers that ask for theirs."""

    def __init__(self):
        self.counts: list[tuple[np.ndarray, ...]] = []
        self.asked: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def add(self, containers: list[tuple[int, list[Line], bool]]) -> None:
        """Counts the windows of containers; those that are not dense but hold ended lines, or a page's last, ask for theirs."""
        owners = [(k, x.dense, x.ended or last) for k, (_, lines, last) in enumerate(containers) for x in lines]
        keys, line = windows_of([x.text for _, lines, _ in containers for x in lines])
        if not len(keys):
            return
        container, dense, ended = (np.array(x) for x in zip(*owners, strict=True))
        running = dense[line].astype(np.int64)
        self.counts.append(_summed([(keys, running, 1 - running)]))
        if len(self.counts) > 1 and sum(len(c[0]) for c in self.counts) > WINDOWS_AT_ONCE // 4:
            self.counts = [_summed(self.counts)]
        of = container[line]
        sizes = np.bincount(of, minlength=len(containers))
        asks = ended[line] & ~dense[line]
        begins = np.searchsorted(of[asks], np.arange(len(containers) + 1))
        keys = keys[asks]
        for k in np.flatnonzero(np.diff(begins)):
            name = containers[k][0]
            if name not in self.asked:
                self.asked[name] = *np.unique(keys[begins[k] : begins[k + 1]], return_counts=True), int(sizes[k])

    def full(self) -> bool:
        return sum(len(c[0]) for c in self.counts) > WINDOWS_AT_ONCE

    def hand_on(self) -> dict[str, pa.Array]:
        """The columns of one row with all that was counted; nothing if nothing was."""
        if not self.counts:
            return {}
        windows, dense, alone = _summed(self.counts)
        names = list(self.asked)
        own = [self.asked[n] for n in names] or [(windows[:0], windows[:0], 0)]
        lengths = [len(w) for w, _, _ in own]
        row = {
            "windows": windows, "dense": dense, "alone": alone,
            "asked": np.repeat(np.array(names or [0], np.int64), lengths),
            "asked_windows": np.concatenate([w for w, _, _ in own]),
            "times": np.concatenate([t for _, t, _ in own]).astype(np.int64),
            "sizes": np.repeat(np.array([n for _, _, n in own], np.int64), lengths),
        }
        self.__init__()
        return {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, pa.int64())) for k, v in row.items()}


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of the read form; columns that are not given are null."""
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)).cast(f.type) for f in _SHAPE], schema=_SHAPE)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of pages, and beside them the counts of all windows: bodies are read this once only."""
    reading = _Reading()
    for whole in batches:
        for begin in range(0, whole.num_rows, 1000):
            part = whole.slice(begin, 1000)
            offsets, named, told = [0], [], []
            flat: dict[str, list[int]] = {k: [] for k in ("numbers", "tags", "bits", "paths", "containers")}
            for title, body in zip(part["title"].to_pylist(), part["body"].to_pylist(), strict=True):
                lines = lines_of(body)
                name = _folded(title)
                paths = [0 if x.tag in _ARTICLE or x.dense else x.path for x in lines]
                said = [_bits(lines, k, name) for k in range(len(lines))]
                for k in {path: k for k, path in reversed(list(enumerate(paths)))}.values():
                    said[k] |= _FIRST
                own = [0] * len(lines)
                for places in containers_of(lines):
                    first = places[0]
                    if lines[first].tag in _ARTICLE:
                        continue
                    named_so = paths[first]
                    if len(places) > 1 and not lines[first].dense:
                        named_so = xxhash.xxh64_intdigest(np.array([paths[k] for k in places], np.int64).tobytes()) - (1 << 63)
                    for k in places:
                        own[k] = named_so
                    told.append((named_so, [lines[k] for k in places], places[-1] == len(lines) - 1))
                named.append(bool(name))
                offsets.append(offsets[-1] + len(lines))
                flat["numbers"] += [x.no for x in lines]
                flat["tags"] += [_TAG_NUMBER[x.tag] for x in lines]
                flat["bits"] += said
                flat["paths"] += paths
                flat["containers"] += own
            reading.add(told)
            columns = {k: part[k] for k in ("hit_id", "host", "page", "body")} | {"named": pa.array(named, pa.bool_())}
            at = pa.array(offsets, pa.int32())
            columns |= {k: pa.ListArray.from_arrays(at, pa.array(v, pa.int64())) for k, v in flat.items()}
            yield _batch(columns)
            if reading.full():
                yield _batch(reading.hand_on())
    if rest := reading.hand_on():
        yield _batch(rest)


def _articles(row, own: dict[int, bool], heads: frozenset[int], scores: dict[int, float]) -> list[bool]:
    """Which lines are of the article. ``own``: the winning paths, True for content; ``heads``: those that head lists."""
    tags, bits, paths, containers = (x.tolist() for x in (row.tags, row.bits, row.paths, row.containers))
    out: list[bool] = []
    beside = False  # inside a list beside the article
    for k, (number, said, path) in enumerate(zip(tags, bits, paths, strict=True)):
        tag, last = _TAGS[number], k == len(tags) - 1
        titled, ended, dense = said & _TITLED, said & _ENDED, said & _DENSE
        fixed = tag in _ARTICLE or dense
        verdict = None if fixed else own.get(path)
        item = tag in ("li", "la", "ni", "a") or (tag == "p" and not ended)
        if beside and (said & _BLANK or not item or (titled and tag in ("p", "ni"))):
            beside = False
        score = scores.get(containers[k], 0.0)
        if fixed or said & _CLOSES:
            article = True
        elif beside:
            article = False
        elif titled and tag in ("p", "h", "b", "ni"):
            article = True
        elif tag in ("h", "b"):
            article = verdict is None
        elif not (row.named or any(out) or last) and verdict is None and tag == "p" and bits[k + 1] & _DENSE and not said & _TRAILS:
            article = True  # a page without a title has it above its text
        elif tag in ("a", "m", "la", "ni"):
            article = False
        elif tag == "li":
            article = verdict is not False
        elif last and verdict is None and said & _TORN:
            article = True
        elif ended:
            article = verdict if verdict is not None else score >= 0.5
        else:
            article = verdict is None and last and score >= 0.6
        if verdict is False and not article and (tag in ("h", "b") or (tag == "p" and path in heads)):
            beside = True
        out.append(article)
    return out


def _extract(broadcast, emit: str) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everywhere = broadcast.value
        common = dict.fromkeys(everywhere[0].tolist(), False) | dict.fromkeys(everywhere[1].tolist(), True)
        heads = frozenset(everywhere[2].tolist())
        own: dict[int, bool] = {}
        host = None
        for b in batches:
            ids, numbers, bodies = [], [], []
            for row in b.itertuples(index=False):
                if row.host != host or not own:
                    host = row.host
                    rich, poor = (() if x is None else x for x in (row.rich, row.poor))
                    own = common | dict.fromkeys(rich, True) | dict.fromkeys(poor, False)
                scores = {} if row.scored is None else dict(zip(row.scored.tolist(), row.scores.tolist(), strict=True))
                around = row.numbers[~np.array(_articles(row, own, heads, scores), bool)] if len(row.numbers) else []
                if emit == "lines":
                    ids += [row.hit_id] * len(around)
                    numbers.extend(around)
                else:
                    drop = set(around)
                    ids.append(row.hit_id)
                    bodies.append("\n".join(x for no, x in enumerate(row.body.split("\n"), 1) if no not in drop).strip("\n"))
            if emit == "lines":
                yield pd.DataFrame({"hit_id": np.array(ids, np.int64), "line_no": np.array(numbers, np.int64)})
            else:
                yield pd.DataFrame({"hit_id": np.array(ids, np.int64), "body": np.array(bodies, object)})

    return run


def container_scores(read: DataFrame) -> DataFrame:
    """``container, score``: the share of a container's windows in lines that end which stand mostly in running text.

    Containers without any such window are left out.
    """
    # Outer explodes: an inner one would read each row once more to see whether it has parts.
    told = read.where(F.col("windows").isNotNull())
    counted = told.select(F.explode_outer(F.arrays_zip("windows", "dense", "alone")).alias("w")).select("w.*")
    counted = counted.groupBy("windows").agg(F.sum("dense").alias("dense"), F.sum("alone").alias("alone"))
    running = counted.where(F.col("dense") > DENSE_SHARE * (F.col("dense") + F.col("alone"))).select("windows")
    asked = told.select(F.explode_outer(F.arrays_zip("asked", "asked_windows", "times", "sizes")).alias("a")).select("a.*").where("asked is not null")
    asked = asked.groupBy("asked", F.col("asked_windows").alias("windows")).agg(F.max("times").alias("times"), F.max("sizes").alias("sizes"))
    score = F.least(F.sum("times") / F.max("sizes"), F.lit(1.0))
    return asked.join(running, "windows").groupBy(F.col("asked").alias("container")).agg(score.alias("score"))


def main_body(
    docs: DataFrame,
    total: int,
    emit: str = "lines",
    host_share: float = 0.02,
    common_share: float = 0.001,
    least_pages: int = 3,
) -> DataFrame:
    """The lines around the article, or the bodies without them.

    ``emit="lines"`` gives ``hit_id, line_no`` of each line that is not blank
    and not of the article; ``emit="bodies"`` gives ``hit_id, body`` with the
    article's lines and the blank lines between them. A path wins on a host
    that shows it on ``host_share`` of its rows, anywhere on ``common_share``
    of all rows and four times ``least_pages`` at least, and on at least
    ``least_pages`` different pages; it wins as content if the containers it
    stands in score 0.5 or more on average. At most ``1 / common_share`` times
    the mean number of lines of a page can win everywhere, which bounds what is
    broadcast. ``total`` is the number of rows.

    A null, empty or blank body gives no lines, and a null body is left out
    of the bodies. A page of a host that is met nowhere else is judged by the
    paths of all hosts and its own scores. Repeated rows give their lines each.
    """
    spark = docs.sparkSession
    body = F.col("body")
    pages = docs.where(body.isNotNull()).select(
        "hit_id", F.coalesce(site_of(F.col("site"), F.col("url")), F.lit("")).alias("host"),
        F.when(strip(F.col("url")) != "", F.xxhash64(canonical_url(F.col("url")))).alias("page"), "title", "body",
    )
    read = pages.mapInArrow(_read, _READ)
    read = materialize(read if emit == "bodies" else read.withColumn("body", F.lit(None).cast("string")), "pages")
    scores = materialize(container_scores(read), "container-scores")
    read = read.where(F.col("numbers").isNotNull())

    lines = F.filter(F.arrays_zip("paths", "containers", "bits"), lambda x: x["paths"] != 0)
    each = read.select("hit_id", "host", "page", F.explode_outer(lines).alias("x")).where(F.col("x").isNotNull()).select(
        "hit_id", "host", "page", F.col("x.paths").alias("path"), F.col("x.containers").alias("container"), F.col("x.bits").alias("said")
    )
    ended = F.col("said").bitwiseAND(_ENDED) != 0
    # A path votes once a page, with the container it stands in first; what does not end is no running text.
    first = each.where(F.col("said").bitwiseAND(_FIRST) != 0).withColumn("container", F.when(ended, F.col("container")))
    bit = F.when(F.col("page").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("page", F.lit(63)).cast("int")))
    heads = (F.col("said").bitwiseAND(_HEADS) != 0).cast("int")
    votes = first.groupBy("host", "path", "container").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(heads).alias("heads"), F.bit_or(F.coalesce(bit, F.lit(0).cast("bigint"))).alias("bits")
    )
    votes = votes.join(scores, "container", "left")
    tally = [F.sum("rows").alias("rows"), F.sum("heads").alias("heads"), F.bit_or("bits").alias("bits"), F.sum("score").alias("score")]
    votes = votes.withColumn("score", F.col("rows") * F.coalesce("score", F.lit(0.0))).groupBy("host", "path").agg(*tally)
    votes = materialize(votes, "paths")
    sizes = read.groupBy("host").agg(F.count(F.lit(1)).alias("host_rows"))
    content = F.col("score") >= 0.5 * F.col("rows")
    everywhere = (
        votes.groupBy("path")
        .agg(*tally, F.count(F.lit(1)).alias("hosts"))
        .where((F.col("rows") >= max(common_share * total, 4 * least_pages)) & (F.col("hosts") > 1))
    )
    everywhere = _on_pages(everywhere, first, ["path"], least_pages, bounded=True)
    everywhere = everywhere.select("path", content.alias("content"), (F.col("heads") >= 0.25 * F.col("rows")).alias("heads")).toPandas()
    often = votes.join(sizes, "host").where((F.col("rows") >= host_share * F.col("host_rows")) & (F.col("rows") >= least_pages))
    wins = (
        _on_pages(often, first, ["host", "path"], least_pages)
        .groupBy("host")
        .agg(
            F.max("host_rows").alias("host_rows"),
            F.collect_list(F.when(~content, F.col("path"))).alias("poor"),
            F.collect_list(F.when(content, F.col("path"))).alias("rich"),
        )
    )
    common = (
        everywhere.loc[~everywhere["content"].astype(bool), "path"].to_numpy(np.int64),
        everywhere.loc[everywhere["content"].astype(bool), "path"].to_numpy(np.int64),
        everywhere.loc[everywhere["heads"].astype(bool), "path"].to_numpy(np.int64),
    )
    # Each page meets the scores of its own containers; those whose line wins everywhere need none.
    known = spark.createDataFrame(pd.DataFrame({"path": np.concatenate(common[:2])}), "path bigint")
    open_ = each.join(F.broadcast(known), "path", "left_anti").where(F.col("said").bitwiseAND(_ENDED | _LAST) != 0)
    sought = open_.select("hit_id", "container").distinct()
    held = sought.groupBy("container").agg(F.count(F.lit(1)).alias("n")).join(scores, "container")
    told = lookup_join(sought, held, ["container"], "n", total, "hit_id").where(F.col("score").isNotNull())
    told = told.groupBy("hit_id").agg(F.collect_list("container").alias("scored"), F.collect_list("score").alias("scores"))
    rows = read.select("hit_id", "host", "named", "numbers", "tags", "bits", "paths", "containers", *(["body"] if emit == "bodies" else []))
    rows = lookup_join(rows.join(told, "hit_id", "left"), wins, ["host"], "host_rows", total, "hit_id", least=1000)
    schema = "hit_id bigint, line_no bigint" if emit == "lines" else "hit_id bigint, body string"
    return rows.mapInPandas(_extract(spark.sparkContext.broadcast(common), emit), schema)


def _on_pages(often: DataFrame, first: DataFrame, keys: list[str], pages: int, bounded: bool = False) -> DataFrame:
    """Those of ``often`` that enough different pages show; counted one by one only where 63 bits cannot tell.

    Pages are told apart before they meet by key, so that a path on a large
    part of all pages is no one task. ``bounded`` says that ``often`` may be
    broadcast, which spares all other rows the way.
    """
    sure, few = often.where(F.bit_count("bits") >= pages), often.where(F.bit_count("bits") < pages)
    rows = first.where(F.col("page").isNotNull()).select(*keys, "page")
    if bounded:
        rows = rows.join(F.broadcast(few.select(*keys)), keys, "left_semi")
    counted = rows.groupBy(*keys, "page").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pages"))
    return sure.unionByName(few.join(counted.where(F.col("n_pages") >= pages).select(*keys), keys))
