"""Trains the tagger of problem 9 from labelled spans, in numpy.

    python -m inkwell.llm.pii_train DOCUMENTS.parquet [...]

The labels come from sentences that say what they hold: a bounded sample of
texts (``SAMPLE``) is read whole, labelling rules mark the values in such
sentences, and each value is replaced again and again by others of its type,
found or made up, so that the network learns forms and surroundings and no
values. Beside them stand made-up sentences of many other shapes
(``PHRASES``), so that it does not learn the corpus' few sentences only.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np
import pandas as pd

from inkwell.llm.pii import FAMILY, FAMILY_TWO, TAGS, TYPES, VOCABULARY, WEIGHTS, Tagger, _CLASSES, encode

#: No more than so many texts are read for labels, and so many made-up passages stand beside them in each epoch.
SAMPLE, MADE_UP = 4000, 2400
EMBEDDING, HIDDEN, LENGTH = 20, 32, 160

_HAN = "一-鿿"
_NAME = (
    rf"(?P<name>[A-Z][\w'’\-]*\.?(?:\s+(?:[A-Z]\.|d[eiu]|van|von|la|[A-Z][\w'’\-]+)){{1,3}}"
    rf"|[{_HAN}]{{1,8}}(?:·[{_HAN}]{{1,8}})+|[{_HAN}]{{2,4}}?)"
)
_PHONE = r"(?P<phone>[+(（]*[0-9０-９][0-9０-９()（）+.\-－ ]{5,26}[0-9０-９](?:\s?(?:ext\.?|x|转|分机)\s?\d{1,6})?)"
_ID = (
    r"(?P<id_number>\d{6}[ \-－]?\d{8}[ \-－]?\d{3}[0-9Xx]|\d{3}[ \-－]?\d{2}[ \-－]?\d{4}"
    r"|[A-Z]{2}(?:[ \-]?\d{2}){3}[ \-]?[A-Z])(?![0-9A-Za-z])"
)
_EMAIL = (
    r"(?P<email>[A-Za-z0-9][\w.+\-]*(?:\s?[@＠]\s?|\s(?:AT|at)\s|\s?[\[(](?:at|AT)[\])]\s?)"
    r"[A-Za-z0-9\-]+(?:(?:\.|\s(?:dot|DOT)\s|\s?[\[(](?:dot|DOT)[\])]\s?)[A-Za-z0-9\-]+)+)"
)
_ADDRESS = r"(?P<address>\S.{4,90}?)"
# Sentences that say what they hold; {n} name, {p} phone, {i} number of identity, {e} email, {a} address.
_RULES = [
    "联系{n}，邮箱 ?{e}，电话 ?{p}[。；]",
    "我的新号码是 ?{p}；",
    "微信同号：{p}，",
    "有事打 ?{p}，没人接就写信到 ?{e}",
    "稿件请发至 ?{e}，",
    "据 ?{n} ?介绍，",
    "用户 ?{n}（证件号 ?{i}）",
    r"(?:^|(?<=[。！？\n”\s✨🔥📌🌿.])){n} ?在评论区留言",
    "感谢 ?{n} ?和 ?{n2} ?对初稿",
    "办公地点在 ?{a}，工作日",
    "身份证号：{i}，",
    "登记表写着：{n} {p} {i}(?=\\s|$|。)",
    "签收人 {n}，证件 {i}，住 ?{a}。",
    "投诉信寄往 ?{a} ?即可",
    "由 ?{n} ?主讲，场地为 ?{a}。",
    "我的同事 ?{n}，{e}",
    "收货地址：{a}，收件人 ?{n}，手机 ?{p}。",
    "作者：{n}(?=\\s*$|\\n)",
    r"My colleague {n} \({e}\)",
    "contact {n} at {e} or call {p}\\.(?!\\d)",
    "Text me on {p} if",
    "reach the desk: {p} / {e}",
    "Visit us at {a} or ring {p}\\.(?!\\d)",
    "The office at {a} opens",
    r"Complaints go to {a}\.(?=\s|$|[A-Z])(?!\s*(?:,|Apt|Suite|#))",
    "SSN on file: {i}(?=\\s*$|\\n|\\.)",
    "National insurance number {i} was",
    "The ticket lists {n} with ID {i} as",
    "Send drafts to {e} before",
    "In an interview, {n} disagreed",
    "Thanks to {n} and {n2} for comments",
    "Ship to {n}, {a}; phone {p}\\.(?!\\d)",
    "(?m:^)By {n}(?=\\s*$|\\n)",
    "{n} told us that",
]


#: Made-up sentences, Chinese and English; {n} name, {p} phone, {i} number of identity, {e} email, {a} address.
PHRASES = (
    "我叫{n}，在这里住了五年。", "我是{n}。", "你好，我是{n}，请问有人吗？", "这位是{n}女士。", "请找{n}先生签字。", "{n}老师下周请假。", "昨天{n}没有来。",
    "主编{n}和记者{n}一起去了现场。", "{n}、{n}与{n}三人获奖。", "经理：{n}", "姓名：{n}\n电话：{p}\n邮箱：{e}\n住址：{a}", "联系人：{n}（{p}）", "有问题请打{p}找{n}。",
    "电话{p}一直没人接。", "拨打 {p} 即可预约。", "传真：{p}；邮编：{d6}", "邮件发到{e}就行。", "我的邮箱是 {e}。", "抄送 {e} 和 {e}", "家住{a}。", "地址是{a}，离地铁不远。",
    "请寄到{a}，{n}收。", "他搬到了{a}，电话没换：{p}。", "身份证 {i}", "证件号码为{i}，有效期十年。", "{n}的身份证号是{i}。", "订单 {d10} 已发货，快递员电话 {p}。", "会议号 {d9}，密码 {d6}。",
    "共 {d4} 人报名，{d4} 人到场。", "2024-03-{d2} 之前交 {d4} 元。", "版本 {d1}.{d2}.{d3} 修好了。", "据统计，{d4}年有{d6}户。", "王者荣耀和李子柒的视频很火。", "张江高科技园区在浦东。",
    "由{n}整理，{n}审定。", "{n}译，{n}改。", "{n}已到岗。", "{n}离开了公司。", "组长{n}已调走。", "负责人是{n}。", "李经理不在。", "赵总和孙主任都来了，钱老师没来。", "摄影：{n}  文：{n}",
    "编号 {d11}，请核对。", "流水号：{d12}", "条码 {d13} 扫不出来。", "{n}去了北京。", "他叫{n}，她叫{n}。", "感谢{n}的帮助。", "{n}说：“可以。”", "“不行，”{n}回答。", "房东{n}（电话{p}）住在{a}。",
    "My name is {n} and I live here.", "Ask {n} about it.", "Meet {n} on Monday.", "Find {n} on {p}.", "Tell {n} to call {p}.", "Thank {n} for it.", "The driver, {n}, gave ID {i}.", "Her son {n} wrote to {e}.",
    "The Old Mill opened in {d4}.", "The Silver Hotel has {d3} rooms.", "Reading Week starts on Monday.", "See the Terms of Service and the Privacy Policy.", "A letter from {n} arrived.", "{n} says no.", "Ticket {d11} is closed.", "I am {n}.", "Dear Mr. {n},", "Dear Ms. {n}, thank you.", "Dr. {n} will see you now.", "Prof. {n} and Mrs. {n} spoke first.", "Hi {n},", "Regards,\n{n}",
    "Signed: {n}\n{a}", "Yesterday {n} met {n} in town.", "{n} (manager) called back.", "Name: {n}\nPhone: {p}\nEmail: {e}\nAddress: {a}", "{n}, {a}", "{n}, {a}, {p}", "Mail it to {n}, {a}.",
    "Call {p} today.", "Phone {p} or write to {e}.", "Tel: {p}", "Fax {p}, attention {n}", "My cell is {p}, my desk {p}.", "Write to {e}!", "Email: {e}", "You can reach me at {e} after six.",
    "We moved to {a}.", "Our shop is at {a}, next to the bank.", "Pick it up from {a} on Friday.", "SSN {i}", "His ID number is {i}.", "Passport holder {n}, number {i}.", "NI number: {i}",
    "Invoice {d10} of 2024-05-{d2} is open.", "Version {d1}.{d2}.{d3} fixes it.", "It costs {d4} dollars for {d2} people.", "Room {d3} on floor {d2} seats {d2}.", "The New Model beats the Old Guard.",
    "Green River Bank grew by {d2}% in {d4}.", "Part no. {d4}-{d4} ships in {d2} days.", "Follow @{w} on the net.", "In March {d4} the North Sea was calm.",
)


def made_up(maker: Maker, count: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Passages of one to four of ``PHRASES`` with values made up, and where these are."""
    rng = maker.rng
    out = []
    for _ in range(count):
        text, spans = "", []
        chosen = [rng.choice(PHRASES) for _ in range(rng.randint(1, 4))]
        for phrase in chosen:
            wide = bool(re.search(f"[{_HAN}]", phrase))
            text += rng.choice(("", "", " ", "\n")) if text and wide else rng.choice((" ", "\n")) if text else ""
            for piece in re.split(r"(\{\w+\})", phrase):
                slot = piece[1:-1] if piece.startswith("{") else ""
                if slot in _KINDS:
                    kind = _KINDS[slot]
                    value = getattr(maker, kind)(wide) if kind in ("name", "address") else getattr(maker, kind)()
                    spans.append((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += maker.digits(int(slot[1:])) if slot.startswith("d") else maker.word().lower() if slot == "w" else piece
        out.append((text, spans))
    return out


_KINDS = {"n": "name", "p": "phone", "i": "id_number", "e": "email", "a": "address"}


def _compiled() -> list[re.Pattern]:
    slots = {"n": _NAME, "n2": _NAME.replace("(?P<name>", "(?P<name_2>"), "p": _PHONE, "i": _ID, "e": _EMAIL, "a": _ADDRESS}
    return [re.compile(re.sub(r"\{(n2|[npiea])\}", lambda m: slots[m[1]], r), re.M) for r in _RULES]


def labelled(text: str, rules: list[re.Pattern]) -> list[tuple[int, int, str]]:
    """Spans that the labelling rules mark, none overlapping."""
    spans: list[tuple[int, int, str]] = []
    for rule in rules:
        for m in rule.finditer(text):
            for slot in m.groupdict():
                a, b = m.span(slot)
                if a >= 0 and all(b <= s or a >= e for s, e, _ in spans):
                    spans.append((a, b, slot.removesuffix("_2")))
    return sorted(spans)


class Maker:
    """Makes up values, or takes those found in other sentences."""

    GIVEN = "一乐予云亦仪伊佳依俊修元兰冉冬凡凯初利劲卓南博卫厚可吉同君启咏嘉园圆坤培城域墨声夏天奇好妍子宁安宜宸家宽宾富尔展岚岩峰川州布希帆年庆康廷建弘强彤彦影征心志忆怀思怡恒恩悦惠慧成扬承拓振捷文斌新方旭明星春昌晓晨景晴智曦曼月朋朗本杰松林果枫柏柔栋桂梓梦森楠欣正武水永汉江汐沛泽波洁洋洛津浩海涛涵清源溪滨潇澄灵炎炜煜熙燕爱牧珂珊珍珠琦琪琳瑞瑶璇瑾甜生田申登白皓盈益真睿知石砚硕磊祥禹秀科秋程穆立竹笑策筠素紫红绍维绮缘美翔翰耀聪胜致舒良艺艾芊芝芬芮花芳苑若英茂茹荣莉菁菲萌萍萱蓉蓝蔓蕾薇虹蝶行裕西言誉诗诚语谦豪贝贤轩辉辰达远迪逸道遥邦郁采金钰铭锦锐长闻阳陶雁雅雨雪霄霖露青静韵顺颖风飞馨香骏鸣鹏鹤麒黎默龙"
    SOUNDS = "阿埃奥巴贝本比布查达丹德迪杜厄法菲弗戈格古哈赫霍基吉加杰卡凯科克库拉莱兰勒雷里利林罗洛马迈曼梅蒙米莫穆娜纳内尼诺帕佩皮普奇乔切萨塞桑沙圣施斯苏索塔坦特提托瓦威维温沃西希夏雅亚耶伊因尤约泽扎詹珍朱"
    STARTS = "Al An Ar Ash Bar Ben Ber Bra Bri Cal Car Cas Cor Dal Dan Dor Dun Ed El Em Fen Fer Gil Gor Gra Hal Har Hol Il Is Jas Jor Ka Ken Kir La Lar Len Lu Ma Mar Mel Mor Na Nel No Ol Os Ot Pel Pet Quin Ra Rav Rin Ro Sa Sel Sor Ta Tam Ter Thor Ul Un Val Vel Wal Wes Wil Wy Yar Ys Zan".split()
    ENDS = "a ah an ana ard as beck bell berg bert by dale den dra el ella en er ett ey field ford gard gate ham hart ian iel ill in ine is ison ker land leigh ley lin low man mere mond more ne nor o old on or ore quist ra ric rick ris ron sen shaw son spur stead sted stone ton us ven vin ward well wick wise worth yn".split()
    STREETS = ("路", "街", "巷", "弄", "大道", "中路", "北街", "东路")
    ROADS = ("St.", "Street", "Ave", "Avenue", "Road", "Lane", "Close", "Court", "Blvd", "Drive", "Way", "Terrace")

    def __init__(self, rng: random.Random, found: dict[str, list[str]]):
        self.rng, self.found = rng, found

    def word(self) -> str:
        return self.rng.choice(self.STARTS) + self.rng.choice(self.ENDS)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def han(self, n: int) -> str:
        return "".join(self.rng.choice(self.GIVEN) if self.rng.random() < 0.6 else chr(self.rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))

    def name(self, wide: bool) -> str:
        r = self.rng
        if wide and r.random() < 0.8:
            if r.random() < 0.2:
                sounds = lambda: "".join(r.choice(self.SOUNDS) for _ in range(r.randint(2, 5)))
                return "·".join(sounds() for _ in range(r.randint(2, 3)))
            return (r.choice(FAMILY_TWO) if r.random() < 0.1 else r.choice(FAMILY)) + self.han(r.choice((1, 2, 2)))
        first = self.word() + ("-" + self.word() if r.random() < 0.12 else "")
        if r.random() < 0.08:
            first = first[0] + "."
        middle = r.choice(("", "", "", "", r.choice("ABCDEFGHKLMNPRSTW") + ". ", r.choice(("de ", "van ", "von ", "di "))))
        last = ("O'" if r.random() < 0.07 else "") + self.word() + ("-" + self.word() if r.random() < 0.05 else "")
        return f"{first} {middle}{last}"

    def phone(self) -> str:
        r, d = self.rng, self.digits
        s = r.choice(("", "-", " "))
        mobile = "1" + r.choice("3456789") + d(1) + s + d(4) + s + d(4)
        return r.choice(
            (
                mobile,
                mobile,
                r.choice(("+86 ", "+86-", "86-", "0086 ", "(+86)", "+86")) + mobile,
                "0" + d(r.choice((2, 3))) + r.choice(("-", "－", " ")) + d(r.choice((7, 8))),
                "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in mobile),
                f"({d(3)}) {d(3)}-{d(4)}",
                f"{d(3)}{(x := r.choice('-. '))}{d(3)}{x}{d(4)}",
                f"+1{(x := r.choice('- '))}{d(3)}{x}{d(3)}{x}{d(4)}",
                "1" + d(10),
                f"+44 20 {d(4)} {d(4)}",
                f"0{d(2)} {d(4)} {d(4)}",
                f"0{d(4)} {d(6)}",
                f"+49 {d(2)} {d(5)} {d(3)}",
            )
        ) + (r.choice((" ext. ", " ext ", " x", "转")) + d(r.choice((2, 3, 4))) if r.random() < 0.12 else "")

    def id_number(self) -> str:
        r, d = self.rng, self.digits
        s = r.choice(("", "", "-", " "))
        birth = f"{r.choice(('19', '20'))}{d(2)}{r.randint(1, 12):02}{r.randint(1, 28):02}"
        letter = lambda: r.choice("ABCEGHJKLMNOPRSTWXYZ")
        gap = r.choice(("", " "))
        return r.choice(
            (
                d(6) + s + birth + s + d(3) + r.choice("0123456789Xx"),
                d(6) + s + birth + s + d(3) + r.choice("0123456789Xx"),
                f"{d(3)}{(x := r.choice('- '))}{d(2)}{x}{d(4)}",
                gap.join((letter() + letter(), d(2), d(2), d(2), r.choice("ABCD"))),
            )
        )

    def email(self) -> str:
        r = self.rng
        word = lambda: self.word().lower()
        user = word() + r.choice(("", "", r.choice("._+-") + r.choice((word(), self.digits(4), "news", "hr" + self.digits(2)))))
        user = r.choice((user, user, user + self.digits(r.choice((2, 4))), user.upper(), user.capitalize()))
        at = r.choice(("@", "@", "@", "@", "＠", " @ ", " AT "))
        host = r.choice((word(), "mail", "post", "corp", "inbox", word() + "-" + self.digits(1))) + r.choice((".example", ".test", ".invalid", ".com", ".org", ".net", ".cn"))
        host = ("mail." if r.random() < 0.1 else "") + host
        if r.random() < 0.15:
            at, dot = r.choice(((" AT ", "."), (" at ", " dot "), (" [at] ", " dot "), (" (at) ", " dot "), ("[at]", "[dot]"), (" AT ", " [dot] ")))
            host = host.replace(".", dot)
        return user + at + (host.upper() if user.isupper() else host)

    def address(self, wide: bool) -> str:
        r, d = self.rng, self.rng.randint
        if wide and r.random() < 0.85:
            city = self.han(2) + r.choice(("市", "区", "县", "镇"))
            city += self.han(2) + r.choice(("区", "镇")) if r.random() < 0.4 else ""
            street = self.han(2) + r.choice(self.STREETS)
            tail = r.choice((f"{d(1, 700)}号", f"{d(1, 99)}-{d(1, 140)}号", f"{d(1, 700)}弄{d(1, 60)}号", f"{d(1, 400)}号{d(1, 30)}栋{d(1, 7)}单元{d(100, 3000)}室", f"{d(1, 90)}号院{d(1, 20)}号楼{d(100, 2000)}"))
            return city + street + tail
        if r.random() < 0.12:
            return f"{self.word()}{r.choice(('straße', 'weg', 'gasse', 'platz', 'allee'))} {d(1, 190)}, {self.digits(5)} {r.choice(('', 'Bad ', 'Alt'))}{self.word()}"
        lead = r.choice(("", "", f"Flat {d(1, 60)}, "))
        tail = r.choice(("", f", Apt {d(1, 40)}{r.choice('ABCD')}", f", Suite {d(100, 990)}", f" #{d(1, 60)}"))
        town = r.choice(("", f", {self.word()}", f", {self.word()} {r.choice(('Bay', 'Quay', 'Hill'))}"))
        town += f", {r.choice('QXZ')}{r.choice('ABXY')} {self.digits(5)}" if town and r.random() < 0.5 else ""
        return f"{lead}{d(1, 9999)} {self.word()}{self.word().lower()[:4]} {r.choice(self.ROADS)}{tail}{town}"

    def value(self, kind: str, old: str) -> str:
        if self.rng.random() < 0.45:
            return old if self.rng.random() < 0.4 else self.rng.choice(self.found[kind])
        wide = bool(re.search(f"[{_HAN}]", old))
        return getattr(self, kind)(wide) if kind in ("name", "address") else getattr(self, kind)()


def renewed(text: str, spans: list[tuple[int, int, str]], maker: Maker) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with other values in its spans, and where they are."""
    out, new, at, size = [], [], 0, 0
    for a, b, kind in spans:
        value = maker.value(kind, text[a:b])
        out += [text[at:a], value]
        size += a - at
        new.append((size, size + len(value), kind))
        size += len(value)
        at = b
    return "".join([*out, text[at:]]), new


def _tags(size: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for a, b, kind in spans:
        k = TYPES.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    g = 4 * HIDDEN
    w = {"emb": rng.normal(0, 0.1, (VOCABULARY, EMBEDDING))}
    for d in "fb":
        w["wx" + d] = rng.normal(0, 0.3, (EMBEDDING, g))
        w["wc" + d] = rng.normal(0, 0.3, (_CLASSES, g))
        w["u" + d] = rng.normal(0, 0.15, (HIDDEN, g))
        w["b" + d] = np.zeros(g)
        w["b" + d][HIDDEN : 2 * HIDDEN] = 1.0
    w |= {"wo": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bo": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
    for j in range(TAGS):  # going on is only possible after the same type
        if j and j % 2 == 0:
            w["start"][j] = -8.0
            for i in range(TAGS):
                if i not in (j, j - 1):
                    w["trans"][i, j] = -8.0
    return {k: v.astype(np.float32) for k, v in w.items()}


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _pass(w: dict, ids: np.ndarray, classes: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
    n, steps = ids.shape
    x = w["emb"][ids]
    zx = x @ w["wx" + d] + w["wc" + d][classes] + w["b" + d]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((steps, n, HIDDEN), np.float32), [None] * steps
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = zx[:, t] + h @ w["u" + d]
        s = 0.5 * (np.tanh(0.5 * z[:, : 3 * HIDDEN]) + 1)
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c_before = h, c
        c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
        tc = np.tanh(c)
        h = s[:, 2 * HIDDEN :] * tc
        if d == "b":
            keep = mask[:, t, None]
            c, h = c * keep, h * keep
        kept[t] = (s, g, tc, before, c_before)
        out[t] = h
    return out, kept


def _unpass(w: dict, grad: dict, ids: np.ndarray, classes: np.ndarray, mask: np.ndarray, d: str, kept: list, dout: np.ndarray) -> None:
    n, steps = ids.shape
    u = w["u" + d]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dz_all = np.empty((n, steps, 4 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
        s, g, tc, before, c_before = kept[t]
        dh = dh + dout[t]
        if d == "b":
            keep = mask[:, t, None]
            dh, dc = dh * keep, dc * keep
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        dct = dc + dh * o * (1 - tc * tc)
        dz = dz_all[:, t]
        dz[:, :HIDDEN] = dct * g * i * (1 - i)
        dz[:, HIDDEN : 2 * HIDDEN] = dct * c_before * f * (1 - f)
        dz[:, 2 * HIDDEN : 3 * HIDDEN] = dh * tc * o * (1 - o)
        dz[:, 3 * HIDDEN :] = dct * i * (1 - g * g)
        grad["u" + d] += before.T @ dz
        dh, dc = dz @ u.T, dct * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grad["b" + d] += flat.sum(0)
    grad["wx" + d] += w["emb"][ids].reshape(-1, EMBEDDING).T @ flat
    one = np.zeros((len(flat), _CLASSES), np.float32)
    one[np.arange(len(flat)), classes.ravel()] = 1
    grad["wc" + d] += one.T @ flat
    np.add.at(grad["emb"], ids.ravel(), flat @ w["wx" + d].T)


def loss_and_grad(w: dict, ids: np.ndarray, classes: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags under the CRF, and its gradient."""
    n, steps = ids.shape
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    hf, kf = _pass(w, ids, classes, mask, "f")
    hb, kb = _pass(w, ids, classes, mask, "b")
    both = np.concatenate([hf, hb], axis=2)
    e = both @ w["wo"] + w["bo"]
    trans, rows = w["trans"], np.arange(n)
    alpha = np.empty((steps, n, TAGS), np.float32)
    alpha[0] = e[0] + w["start"]
    gold = alpha[0][rows, tags[:, 0]].astype(np.float64)
    for t in range(1, steps):
        step = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        m = mask[:, t]
        alpha[t] = np.where(m[:, None], step, alpha[t - 1])
        gold += np.where(m, trans[tags[:, t - 1], tags[:, t]] + e[t][rows, tags[:, t]], 0)
    total = _lse(alpha[-1], 1)
    beta = np.zeros((n, TAGS), np.float32)
    de = np.zeros_like(e)
    for t in range(steps - 1, -1, -1):
        m = mask[:, t, None]
        p = np.exp(alpha[t] + beta - total[:, None]) * m
        p[rows, tags[:, t]] -= mask[:, t]
        de[t] = p
        if t:
            inner = (e[t] + beta)[:, None, :] + trans[None]
            pair = np.exp(alpha[t - 1][:, :, None] + inner - total[:, None, None]) * m[:, :, None]
            grad["trans"] += pair.sum(0)
            np.subtract.at(grad["trans"], (tags[:, t - 1][mask[:, t]], tags[:, t][mask[:, t]]), 1)
            beta = np.where(m, _lse(inner, 2), beta)
    grad["start"] += de[0].sum(0)
    grad["bo"] += de.sum((0, 1))
    grad["wo"] += both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
    dboth = de @ w["wo"].T
    _unpass(w, grad, ids, classes, mask, "f", kf, dboth[:, :, :HIDDEN])
    _unpass(w, grad, ids, classes, mask, "b", kb, dboth[:, :, HIDDEN:])
    return float((total - gold).mean()), {k: v / n for k, v in grad.items()}


def _cut(text: str, spans: list[tuple[int, int, str]], rng: random.Random, plain: float) -> list[tuple[str, np.ndarray]]:
    """Windows of a text: all with values, a part of the others."""
    tags, out, at = _tags(len(text), spans), [], -rng.randrange(0, LENGTH // 2)
    while at < len(text):
        a, b = max(0, at), min(len(text), at + LENGTH)
        if b - a > 8 and (tags[a:b].any() or rng.random() < plain):
            part = tags[a:b].copy()
            if part[0] and part[0] % 2 == 0:  # a value whose start is cut off
                part[0] -= 1
            out.append((text[a:b], part))
        at += LENGTH
    return out


def train(texts: list[str], epochs: int = 14, batch: int = 96, seed: int = 7, say=print) -> dict[str, np.ndarray]:
    """Weights after ``epochs`` over at most ``SAMPLE`` of the texts."""
    rng, rules = random.Random(seed), _compiled()
    texts = [t for t in dict.fromkeys(texts) if t]
    rng.shuffle(texts)
    marked = [(t, labelled(t, rules)) for t in texts[:SAMPLE]]
    found: dict[str, list[str]] = {k: [] for k in TYPES}
    for text, spans in marked:
        for a, b, kind in spans:
            found[kind].append(text[a:b])
    say({k: len(v) for k, v in found.items()})
    maker = Maker(rng, found)
    w = start_weights(np.random.default_rng(seed))
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        data = [x for text, spans in marked for x in _cut(*renewed(text, spans, maker), rng, 0.12)]
        data += [x for text, spans in made_up(maker, MADE_UP) for x in _cut(text, spans, rng, 1.0)]
        rng.shuffle(data)
        losses = []
        rate = 0.008 * (0.5 * (1 + np.cos(np.pi * epoch / epochs))) + 0.0004
        for k in range(0, len(data), batch):
            part = sorted(data[k : k + batch], key=lambda x: -len(x[0]))
            steps = len(part[0][0])
            ids, classes = np.zeros((len(part), steps), np.int32), np.zeros((len(part), steps), np.int16)
            mask, tags = np.zeros((len(part), steps), bool), np.zeros((len(part), steps), np.int64)
            for r, (text, own) in enumerate(part):
                n = len(text)
                ids[r, :n], classes[r, :n] = encode(text)
                mask[r, :n], tags[r, :n] = True, own
            loss, grad = loss_and_grad(w, ids, classes, mask, tags)
            losses.append(loss)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 5.0 / (norm + 1e-9))
            for name, g in grad.items():
                g = g * scale
                m1[name] += 0.1 * (g - m1[name])
                m2[name] += 0.002 * (g * g - m2[name])
                w[name] -= (rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch + 1}: {len(data)} windows, loss {np.mean(losses):.3f}")
    return w


def main(paths: list[str]) -> None:
    texts = [t for p in paths for t in pd.read_parquet(p, columns=["text"])["text"]]
    weights = train(texts)
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) if k == "emb" else v for k, v in weights.items()})
    Tagger.load()


if __name__ == "__main__":
    main(sys.argv[1:])
