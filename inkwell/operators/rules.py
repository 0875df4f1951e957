"""Rules of the expression lint, as data: word lists, patterns, metrics, genres.

The words of the built-in rules stand in ``words.txt``. ``load_rules`` reads a
file of rules of one's own, for a corpus that has others.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Rules = dict[str, Any]

WORDS = Path(__file__).with_name("words.txt")


@lru_cache(maxsize=1)
def words() -> dict[str, tuple[str, ...]]:
    """The words of each rule."""
    rows = (line.split(": ", 1) for line in WORDS.read_text(encoding="utf-8").splitlines() if line and line[0] != "#")
    return {rule: tuple(told.split()) for rule, told in rows}


# Severities and patterns of the word rules.
LEXICON: Rules = {
    "W1": {"severity": "high"},
    "C4": {"severity": "low"},
    "C5": {"severity": "low"},
    "C7": {"severity": "low"},
    "C8": {"severity": "low"},
    "P3": {"severity": "low"},
    "F5": {"severity": "low"},
    "W2": {
        "severity": "mid",
        "regex": [
            {"pattern": r"对[^，。！？\r\n对]{1,14}?进行(了)?[一二三四五六七八九十]?[次遍种个]?"},
            {"pattern": r"(?:具备|具有|拥有)[^，。！？\r\n]{1,10}的能力"},
            {"pattern": r"起到了[^，。！？\r\n]{1,12}?的作用"},
        ],
    },
    "W3": {
        "severity": "mid",
        "min_allowed_count": 1,
        "density_per_sentence": {"default": 0.25, "video": 0.15, "academic": 0.35, "persona": 0.5},
        "regex": [{"pattern": r"(?:^|[。！？；\n])[ \t]*(第一|第二|第三|最后)(?=[，、：:])", "match_group": 1}],
    },
    "W5": {
        "severity": "mid",
        "regex": [
            {"pattern": r"(可能|或许|大概|似乎|也许)[^，。！？\r\n]{0,6}(可能|或许|大概|似乎|也许)"},
            {"pattern": r"可以认为[^，。！？\r\n]{0,12}(可能|或许|大致)"},
        ],
    },
    "C9": {"severity": "low", "regex": [{"pattern": r"(?:堪称|简直是|行业|颜值|性能|体验)(?:的)?天花板"}]},
    "P2": {
        "severity": "mid",
        "regex": [{"pattern": r"(?:^|[。！？\n])[ \t]*(好了)(?=[，,！!])", "match_group": 1}],
    },
    "F4": {
        "severity": "high",
        "regex": [
            {"pattern": r"(?:需要我|要不要我)(?:帮你|为你|展开|继续)"},
            {"pattern": r"以下是(?:为你|为您|您)"},
            {"pattern": r"总结一下|如下所示|以上就是", "severity": "low"},
        ],
    },
    "F6": {
        "severity": "high",
        "regex": [{"pattern": r"好问题|完全正确", "severity": "low"}],
    },
}
PATTERNS: Rules = {
    "P2_prompt_colon": {
        "severity": "low",
        "scope": "prose",
        "patterns": [r"(?<![^。！？!?；;\r\n])(?:一句话总结|简单来说|核心是|结论是|重点是|关键是)[ \t]*[：:]"],
    },
    "S3": {
        "severity": "high",
        "density_per_800": 3,
        "patterns": [
            r"不(是|只是|仅仅是|仅是)[^。！？\r\n]{1,30}(，|；)?(而)?是",
            r"不仅[^。！？\r\n]{1,30}(而且|还|更)",
            r"与其说[^。！？\r\n]{1,30}不如说",
            r"表面上[^。！？\r\n]{1,30}(实际上|本质上|真正)",
        ],
    },
    "S4": {
        "severity": "mid",
        "patterns": [
            r"作为[^，。！？\r\n]{2,16}(，|的)",
            r"堪称[^，。！？\r\n]{2,14}",
            r"成为[^，。！？\r\n]{2,14}的(存在|标杆|典范|代名词)",
            r"扮演(着)?[^，。！？\r\n]{2,12}的角色",
        ],
    },
    "S5": {
        "severity": "low",
        "patterns": [
            r"，(彰显|体现|反映|凸显|展现|印证|折射|昭示|诠释|见证)(了|出|着)[^。！？\r\n]{2,40}[。！？]",
            r"，为[^。！？\r\n]{2,20}(?:奠定了?(?:坚实)?基础|注入了?(?:新)?活力|铺平了?道路)[。！？]",
            r"，成为[^。！？\r\n]{2,20}的(缩影|写照|注脚|典型|标志)[。！？]",
            r"，(标志|意味)着[^。！？\r\n]{2,30}[。！？]",
        ],
    },
    "S6": {
        "severity": "mid",
        "patterns": [r"从[^，。！？0-9\r\n]{2,12}到[^，。！？0-9\r\n]{2,12}(，|、)从[^，。！？0-9\r\n]{2,12}到[^，。！？0-9\r\n]{2,12}"],
    },
    "S8": {
        "severity": "low",
        "patterns": [
            r"[^，。！？\r\n]{2,10}是[^，。！？\r\n]{2,10}的(语言|货币|镜子|底色|尺度|注脚|一部分|另一面)",
            r"[^，。！？\r\n]{2,10}不是[^，。！？\r\n]{2,10}，(而)?是[^，。！？\r\n]{0,10}(镜子|底色|尺度|注脚|学费|货币)[。！？]",
            r"(时间|市场|人性|认知|复利)是最好的[^，。！？\r\n]{2,10}",
            r"[^，。！？\r\n]{2,12}的(底层逻辑|第一性原理|本质)[是在]",
        ],
    },
    "P1": {
        "severity": "low",
        "scope": "head",
        "head_chars": 150,
        "patterns": [
            r"你是不是(也)?(经常|总是|常常|遇到过)",
            r"有没有(发现|想过|遇到过)",
            r"(为什么|凭什么)[^。！？\r\n]{2,20}(却|但)[^。！？\r\n]{2,20}[？?]",
            r"(读完|看完)(这篇|本文|这条)[^。！？\r\n]{0,20}(你将|你会|就能|你就)",
            r"(其实|真相是|问题(就)?出在)[^。！？\r\n]{2,20}",
            r"(今天|本文|这篇)(就)?(来|和你|跟大家)(聊|说|讲|分享)",
        ],
    },
    "P5": {
        "severity": "mid",
        "scope": "tail",
        "tail_chars": 400,
        "patterns": [r"([三四五六]|[3-6])(条|个|点|大)(原则|逻辑|建议|启示|要点|心法|铁律|法则)", r"记住(这)?[三四五六3-6](点|条|个)"],
    },
    "P6": {
        "severity": "mid",
        "min_consecutive": 3,
        "line_patterns": [r"^\s*[-*+]\s*\*\*[^*\r\n]{1,14}\*\*\s*[：:]", r"^\s*[-*+]\s*\*\*[^*\r\n]{1,14}[：:]\*\*"],
    },
    "R2": {
        "severity": "low",
        "patterns": [
            r"(?:那一?(?:瞬间|刻|秒)|心头一紧|愣了|停顿了)[^。！？\r\n]{0,12}\d+(?:\.\d+)?\s*秒|\d+(?:\.\d+)?\s*秒[^。！？\r\n]{0,8}(?:心头一紧|愣住|心跳加速)"
        ],
    },
    "R4": {"severity": "low", "patterns": [r"我(有)?(一)?个(朋友|同事|读者|学员|客户)", r"(认识|遇到过)(一)?个(人|朋友|老板)"]},
    "R5": {"severity": "low", "patterns": [r"身体(会|早就|自然会)?(给出|知道|告诉)", r"你(会|能)感觉到", r"(那种感觉|直觉)(是)?骗不了(人|你)"]},
    "P4": {
        "severity": "low",
        "scope": "tail",
        "tail_chars": 200,
        "patterns": [r"希望对你有帮助|一切都会好起来|与君共勉|一起加油|一起变好|愿每一个|点亮在看|未来可期|行则将至|愿我们|你值得|愿你|共勉"],
    },
}
METRICS: Rules = {
    "S2_sentence_cv": {"severity": "low", "min_sentences": 8},
    "S7_punchline_rate": {"severity": "low", "warn_above": 0.6, "min_paragraphs": 4},
    "S7_staccato_run": {"severity": "mid", "max_len": 8, "min_run": 3},
    "F1_dash_per_1k": {"severity": "mid", "warn_above": 2.0, "min_allowed_count": 1},
    "F2_bold_per_1k": {"severity": "mid", "warn_above": 6.0, "min_allowed_count": 1, "genre_override": {"xhs-short": 12.0, "xhs-long": 12.0}},
    "F3_emoji_per_1k": {"severity": "mid", "warn_above": 2.0},
    "W1_per_1k": {"severity": "high", "warn_above": 2.0, "min_allowed_count": 2},
}
GENRES: Rules = {
    "default": {"strict": [], "skip": []},
    "wechat": {"strict": ["P5"], "skip": []},
    "xhs-short": {"strict": [], "skip": ["S2_sentence_cv", "F3_emoji_per_1k", "S7_punchline_rate"]},
    "xhs-long": {"strict": [], "skip": ["F3_emoji_per_1k", "P6"]},
    "weibo": {"strict": [], "skip": ["S2_sentence_cv", "S7", "P6"]},
    "zhihu": {"strict": [], "skip": []},
    "video": {"strict": ["W3"], "skip": ["S7_punchline_rate", "S7_staccato_run", "P2"]},
    "persona": {"strict": [], "skip": ["S2_sentence_cv", "F3_emoji_per_1k", "S7_punchline_rate", "S7_staccato_run"]},
    "copy": {"strict": [], "skip": ["S7_punchline_rate", "R1", "S7_staccato_run"]},
    "quant": {"strict": [], "skip": []},
    "academic": {
        "strict": ["F1_dash_per_1k"],
        "skip": ["C4", "S7_punchline_rate", "S7_staccato_run", "R1", "R2", "R4", "R5", "P5", "C1", "C2", "R3"],
    },
}
MANUAL = ("S1", "W4", "C1", "C2", "C3", "C6", "R1", "R3")
SEVERITIES = ("high", "mid", "low")


def builtin_rules() -> Rules:
    lexicon = {rule: {"words": told, **LEXICON.get(rule, {})} for rule, told in words().items()}
    return {"lexicon": lexicon, "regex_rules": PATTERNS, "metrics": METRICS, "genres": GENRES, "manual_rules": dict.fromkeys(MANUAL, "")}


def load_rules(path: str) -> Rules:
    """Rules of a JSON file; its patterns may be objects with ``pattern``, as the word lists' are."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    for rule in got.get("regex_rules", {}).values():
        rule["checks"] = {p["pattern"]: p["check"] for p in rule.get("patterns", ()) if isinstance(p, dict) and p.get("check")}
        for name in ("patterns", "line_patterns"):
            if name in rule:
                rule[name] = [p["pattern"] if isinstance(p, dict) else p for p in rule[name]]
    return {k: got.get(k, {}) for k in ("lexicon", "regex_rules", "metrics", "genres", "manual_rules")}


def active_rules(rules: Rules, genre: str) -> set[str]:
    """Rules of a genre: all but those it skips, by id or by base id before an underscore."""
    skip = rules["genres"].get(genre, {}).get("skip", [])
    every = {r for part in ("lexicon", "regex_rules", "metrics", "manual_rules") for r in rules[part]}
    return {r for r in every if not any(r == s or r.startswith(s + "_") for s in skip)}


def rule_ids(spark: SparkSession, rules: Rules | None = None) -> DataFrame:
    """``genre, rule``: every rule under every genre."""
    rules = rules or builtin_rules()
    every = [r for part in ("lexicon", "regex_rules", "metrics", "manual_rules") for r in rules[part]]
    return spark.createDataFrame([(g, r) for g in rules["genres"] for r in every], "genre string, rule string")


def genre_skips(spark: SparkSession, rules: Rules | None = None) -> DataFrame:
    rules = rules or builtin_rules()
    rows = [(g, s) for g, v in rules["genres"].items() for s in v.get("skip", [])]
    return spark.createDataFrame(rows, "genre string, skip string")
