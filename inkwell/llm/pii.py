"""Problem 9: personal information inside free text, found and replaced by typed placeholders.

A character-level bidirectional LSTM with CRF transitions, in numpy, trained
by ``inkwell.llm.pii_train`` from labelled spans. A text is read in
overlapping windows; each is decoded on its own, and the spans of all windows
of a text are reconciled. An exact check then moves a span's ends to those of
the value it lies on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")
#: Tag 0 is outside; 1 + 2k begins type k, 2 + 2k goes on with it.
TAGS = 1 + 2 * len(TYPES)
VOCABULARY = 4096
WINDOW, STRIDE = 384, 320
WEIGHTS = Path(__file__).with_name("pii_weights.npz")

# Frequent family names, one character each, and of two.
FAMILY = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏"
    "钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
)
FAMILY_TWO = ("欧阳", "诸葛", "司马", "上官", "夏侯", "东方", "皇甫", "尉迟", "公孙", "慕容", "令狐", "司徒")
_CLASSES = 14


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: script, case, digit, kind of mark."""
    out = np.zeros(0x110000, np.int16)
    out[0x3400:0x9FFF] = 1
    out[0xF900:0xFAFF] = 1
    for c in range(0x250):
        ch = chr(c)
        out[c] = 2 if ch.islower() else 3 if ch.isupper() else 4 if ch.isdigit() else 6 if ch.isspace() else 0
    out[0xFF10:0xFF1A] = 5
    out[[10, 13]] = 7
    out[[ord("@"), ord("＠")]] = 8
    out[[ord(c) for c in "-－–—_+"]] = 9
    out[ord(".")] = 10
    out[[ord(c) for c in FAMILY]] = 11
    out[[ord(c) for c in "，。；：！？、（）“”《》「」【】…"]] = 12
    out[ord("·")] = 13
    return out


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character number and class of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    ids = np.where(codes < 128, codes, 128 + mixed % np.uint64(VOCABULARY - 128)).astype(np.int32)
    return ids, _classes()[codes]


def _tanh(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``1 - 2 / (exp(2 x) + 1)``: numpy has a vector form of the exponential, not of the hyperbolic tangent."""
    np.add(x, x, out=out)
    np.clip(out, -40.0, 40.0, out=out)
    np.exp(out, out=out)
    out += 1.0
    np.divide(-2.0, out, out=out)
    out += 1.0
    return out


class Tagger:
    """Weights of the network, and its forward pass."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        size = self.hidden = weights["uf"].shape[0]
        # A sigmoid is half a tanh of half: with the gates' weights halved here, one tanh serves all four gates.
        half = np.ones(4 * size, weights["uf"].dtype)
        half[: 3 * size] = 0.5
        # What a character adds to the gates, summed once: no product of the input is left to do.
        self.by_id = {d: weights["emb"] @ weights["wx" + d] * half for d in "fb"}
        self.by_class = {d: (weights["wc" + d] + weights["b" + d]) * half for d in "fb"}
        self.u = {d: weights["u" + d] * half for d in "fb"}

    @classmethod
    def load(cls, path: str | Path = WEIGHTS) -> Tagger:
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in z.files})

    def _run(self, kinds: np.ndarray, at: np.ndarray, mask: np.ndarray, direction: str) -> np.ndarray:
        """States after each character; ``at`` gives, step by step, the place of each text's character among ``kinds``."""
        steps, n = at.shape
        size = self.hidden
        added, u = self.by_id[direction][kinds // _CLASSES] + self.by_class[direction][kinds % _CLASSES], self.u[direction]
        h, c = np.zeros((n, size), u.dtype), np.zeros((n, size), u.dtype)
        z, product = np.empty((n, 4 * size), u.dtype), np.empty((n, 4 * size), u.dtype)
        out = np.empty((steps, n, size), u.dtype)
        order = range(steps) if direction == "f" else range(steps - 1, -1, -1)
        for t in order:
            np.take(added, at[t], axis=0, out=z, mode="clip")
            np.matmul(h, u, out=product)
            z += product
            _tanh(z, z)
            gates = z[:, : 3 * size]
            gates *= 0.5
            gates += 0.5
            c *= gates[:, size : 2 * size]
            c += gates[:, :size] * z[:, 3 * size :]
            h = _tanh(c, out[t])
            h *= gates[:, 2 * size :]
            if direction == "b":  # past the end of a short text nothing is carried in
                keep = mask[:, t, None]
                c *= keep
                h *= keep
        return out

    def emissions(self, ids: np.ndarray, classes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Scores of the tags: shape (steps, texts, tags)."""
        kinds, at = np.unique(ids.astype(np.int64) * _CLASSES + classes, return_inverse=True)
        at = np.ascontiguousarray(at.reshape(ids.shape).T)
        out = self.w["bo"]
        for direction, weights in zip("fb", np.split(self.w["wo"], 2), strict=True):
            out = out + self._run(kinds, at, mask, direction).reshape(-1, self.hidden) @ weights
        return out.reshape(*at.shape, -1)

    def decode(self, ids: np.ndarray, classes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window and by how much each beats being outside.

        Only the scores are kept on the way; where the best path came from is
        asked along that path alone.
        """
        e = self.emissions(ids, classes, mask)
        steps, n, _ = e.shape
        trans = self.w["trans"]
        scores = np.empty_like(e)
        scores[0] = e[0] + self.w["start"]
        paths = np.empty((TAGS, n, TAGS), e.dtype)  # by the tag before
        for t in range(1, steps):
            np.add(scores[t - 1].T[:, :, None], trans[:, None, :], out=paths)
            paths.max(axis=0, out=scores[t])
            scores[t] += e[t]
            over = np.flatnonzero(~mask[:, t])
            scores[t, over] = scores[t - 1, over]
        tags = np.zeros((n, steps), np.int8)
        last = scores[-1].argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            tags[:, t] = np.where(mask[:, t], last, 0)
            if t:
                before = (scores[t - 1] + trans.T[last]).argmax(axis=1)
                last = np.where(mask[:, t], before, last)
        margin = np.take_along_axis(e.transpose(1, 0, 2), tags[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0].T
        return tags, margin


@lru_cache(maxsize=1)
def _tagger() -> Tagger:
    return Tagger.load()


def _spans_of(tags: np.ndarray, margin: np.ndarray) -> list[tuple[int, int, int, float]]:
    """``(start, end, type, margin)`` of the runs of one window's tags."""
    out = []
    at = np.flatnonzero(tags)
    k = 0
    while k < len(at):
        start = end = at[k]
        kind = (tags[start] - 1) // 2
        while k + 1 < len(at) and at[k + 1] == end + 1 and tags[at[k + 1]] == 2 + 2 * kind:
            k += 1
            end = at[k]
        out.append((int(start), int(end) + 1, int(kind), float(margin[start : end + 1].mean())))
        k += 1
    return out


def _windows(text: str) -> list[tuple[int, int]]:
    if len(text) <= WINDOW:
        return [(0, len(text))]
    starts = list(range(0, len(text) - WINDOW + STRIDE, STRIDE))
    return [(s, min(s + WINDOW, len(text))) for s in starts]


def _reconcile(spans: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """One set of spans that do not overlap, of all windows' spans of one text.

    A span at a cut edge of its window yields to any other; of the rest those
    found by more windows come first, then those with the greater margin.
    """
    votes: dict[tuple[int, int, int], list] = {}
    for start, end, kind, margin, cut in spans:
        v = votes.setdefault((start, end, kind), [0, 0.0, True])
        v[0] += 1
        v[1] = max(v[1], margin)
        v[2] &= cut
    order = sorted(votes, key=lambda s: (votes[s][2], -votes[s][0], -votes[s][1], s))
    taken: list[tuple[int, int, int]] = []
    for s in order:
        if all(s[1] <= t[0] or s[0] >= t[1] for t in taken):
            taken.append(s)
    return sorted(taken)


_D = "0-9０-９"
_EMAIL = re.compile(
    r"[A-Za-z0-9][A-Za-z0-9._+\-]*(?:\s?[@＠]\s?|\s(?:AT|at)\s|\s?[\[(](?:AT|at)[\])]\s?)"
    r"[A-Za-z0-9\-]+(?:(?:\.|\s(?:dot|DOT)\s|\s?[\[(](?:dot|DOT)[\])]\s?)[A-Za-z0-9\-]+)+"
)
_PHONE = re.compile(
    rf"[+＋(（]{{0,2}}[{_D}][{_D}()（）.\-－–— ]{{5,26}}[{_D}](?:\s?(?:ext\.?|extension|x|转|分机)\s?[{_D}]{{1,6}})?"
)
_ID = re.compile(
    r"(?<![0-9A-Za-z])(?:\d{6}[ \-－]?\d{8}[ \-－]?\d{3}[0-9Xx]|\d{3}([ \-－]?)\d{2}\1\d{4}"
    r"|[A-Z]{2}(?:[ \-]?\d{2}){3}[ \-]?[A-Z])(?![0-9A-Za-z])"
)
_USER = re.compile(r"(?:[A-Za-z0-9][A-Za-z0-9._+\-]*)?\Z")
_ONE_NAME = re.compile(r"[^，。、；：,;:!?！？\n]*")
_EDGE = " \t\r\n,，。;；:：、()（）[]【】\"“”'"
_EXACT = {"email": _EMAIL, "phone": _PHONE, "id_number": _ID}


def _is_value(text: str, kind: str) -> bool:
    """Whether all of a text is one value of the kind."""
    if not _EXACT[kind].fullmatch(text):
        return False
    if kind == "email":
        return text[-1].isalpha()
    if kind == "phone" and re.fullmatch(r"\d{4}([-./])\d{1,2}\1\d{1,2}", text):
        return False  # a date
    return kind != "phone" or 7 <= sum(c.isdigit() for c in text) <= 21


def _settled(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """A span with its ends moved to those of the value it lies on; None if it lies on none."""
    while start < end and text[start] in _EDGE and not (kind == "phone" and text[start] in "(（"):
        start += 1
    while end > start and text[end - 1] in _EDGE:
        end -= 1
    if kind == "email":  # an address begins where its letters begin
        start -= len(_USER.search(text, max(0, start - 64), start)[0])
    if kind in _EXACT:
        if _is_value(text[start:end], kind):
            return start, end, kind
        if kind == "id_number" and _is_value(text[start:end], "phone") and not text[start].isalpha():
            return start, end, "phone"
        best = None
        for m in _EXACT[kind].finditer(text, max(0, start - 12), min(len(text), end + 24)):
            shared = min(m.end(), end) - max(m.start(), start)
            if 2 * shared > min(m.end() - m.start(), end - start) and (best is None or shared > best[0]):
                best = (shared, *m.span())
        if best is None:
            return None
        _, a, b = best
        if kind == "email" and b > end and re.match(r"\.[A-Z][a-z]", text[end : end + 3]) and not text[start:end].isupper():
            b = end  # the next sentence follows without a space
        if kind == "phone" and text[a] in "(（" and text[a:b].count(text[a]) > sum(c in ")）" for c in text[a:b]):
            a += 1
        return (a, b, kind) if _is_value(text[a:b], kind) else None
    if kind == "name":
        end = start + len(_ONE_NAME.match(text, start, end)[0].rstrip())
        if end < len(text) and text[end] == "." and re.search(r"(?:^|\s)[A-Z]$", text[start:end]):
            end += 1
        if end - start < 2 or any(c.isdigit() for c in text[start:end]) or "@" in text[start:end]:
            return None
        if text[start:end].isascii() and " " not in text[start:end].strip():
            return None  # no full name
        # A name of letters with case has no torn word at its ends.
        if text[start].islower() and start and text[start - 1].isalpha() and text[start - 1].isascii():
            return None
        while end < len(text) and text[end].isascii() and text[end].isalpha() and text[end - 1].isascii():
            end += 1
    else:
        if end < len(text) and text[end] == "." and re.search(r"\b(?:St|Ave|Rd|Blvd|Dr|Ln)$", text[start:end]):
            end += 1
        if end - start < 5 or not any(c.isdigit() for c in text[start:end]):
            return None
    return start, end, kind


def find_spans(texts: list[str], chunk: int = 256) -> list[list[tuple[int, int, str]]]:
    """``(start, end, type)`` of each mention in each text; offsets count code points."""
    tagger = _tagger()
    found: list[list[tuple[int, int, int, float, bool]]] = [[] for _ in texts]
    codes = [encode(t) for t in texts]
    spans = sorted(((e - s, k, s, e) for k, t in enumerate(texts) if t for s, e in _windows(t)), reverse=True)
    for at in range(0, len(spans), chunk):
        part = spans[at : at + chunk]
        steps = part[0][0]
        ids = np.zeros((len(part), steps), np.int32)
        classes = np.zeros((len(part), steps), np.int16)
        mask = np.zeros((len(part), steps), bool)
        for r, (size, k, s, e) in enumerate(part):
            ids[r, :size], classes[r, :size], mask[r, :size] = codes[k][0][s:e], codes[k][1][s:e], True
        tags, margin = tagger.decode(ids, classes, mask)
        hit = np.flatnonzero(tags.any(axis=1))
        for r in hit:
            size, k, s, e = part[r]
            for a, b, kind, m in _spans_of(tags[r], margin[r]):
                cut = (a == 0 and s > 0) or (b == size and e < len(texts[k]))
                found[k].append((s + a, s + b, kind, m, cut))
    out = []
    for text, own in zip(texts, found, strict=True):
        settled = []
        for a, b, kind in _reconcile(own):
            ends = _settled(text, a, b, TYPES[kind])
            if ends and (not settled or ends[0] >= settled[-1][1]):
                settled.append(ends)
        out.append(settled)
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with ``[EMAIL]``, ``[PHONE]``, ... in place of the spans."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _find_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].tolist()
        for k in range(0, len(texts), 500):
            found = find_spans(texts[k : k + 500])
            rows = [(i, kind, s, e) for i, own in zip(b["doc_id"][k : k + 500], found, strict=True) for s, e, kind in own]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "start_pos", "end_pos"])


def _redact_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].tolist()
        for k in range(0, len(texts), 500):
            part = texts[k : k + 500]
            found = find_spans(part)
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"][k : k + 500],
                    "text": [redact(t, s) for t, s in zip(part, found, strict=True)],
                    "mentions": [len(s) for s in found],
                }
            )


def _spread(documents: DataFrame) -> DataFrame:
    """Texts over enough tasks; a text's length decides its cost, so rows are dealt out by size of text."""
    spark = documents.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return documents.select("doc_id", "text").where(F.length("text") > 0).repartition(tasks, F.xxhash64("doc_id"))


def find_pii(documents: DataFrame) -> DataFrame:
    """``doc_id, pii_type, start_pos, end_pos`` of each mention in ``text``.

    Types: email, phone, id_number, address, name. Offsets are 0-based, half
    open, in code points. Null and empty texts have none; a repeated row gives
    its mentions each time; extra columns are ignored.
    """
    return _spread(documents).mapInPandas(_find_batches, "doc_id bigint, pii_type string, start_pos bigint, end_pos bigint")


def redact_pii(documents: DataFrame) -> DataFrame:
    """``doc_id, text, mentions``: each text with placeholders for its mentions.

    Null and empty texts are left out, as they hold none.
    """
    return _spread(documents).mapInPandas(_redact_batches, "doc_id bigint, text string, mentions int")
