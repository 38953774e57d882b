"""Time ranges and comparisons in English and Chinese phrases: a small grammar of numbers, units, anchors and relative words.

A phrase is read as a list of words of known classes; what lies between is passed
over. The rules are tried in order on the list, so that `近三个月` and `last 3
months` are one rule. Numbers are digits, English words up to twelve, or Chinese
numerals.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from quarry.plans.model import TimeRange

#: The words of each class.
NUMBERS = {w: n for n, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"day": 1, "week": 7, "month": 30, "quarter": 90, "half": 180, "year": 365}
CLASSES = (
    ("yoy", r"同比|去年同期|较去年|year[- ]over[- ]year|\byoy\b|(?:same period|versus|vs\.?|against|than|compared (?:with|to)) (?:of )?last year"),
    ("mom", r"环比|较上月|和上月比|与上月相比|month[- ]over[- ]month|\bmom\b|(?:versus|vs\.?|against|than|compared (?:with|to)) (?:the )?(?:last|previous) month"),
    ("trend", r"逐月|持续|趋势|下降|month by month|\btrend\b|declin\w+"),
    ("to_date", r"今年以来|年初至今|年初到现在|year[- ]to[- ]date|\bytd\b|so far this year"),
    ("first_half", r"上半年|first half"),
    ("this_year", r"今年|本年|this year|current year"),
    ("last_year", r"去年|上年|last year|previous year"),
    ("complete", r"完整|整|complete|full|whole"),
    ("previous", r"上个|上一个|上(?=月)|\bprevious\b|\bprior\b"),
    ("this", r"本(?=月)|这个|当(?=月)|\bthis\b|\bcurrent\b"),
    ("recent", r"最近|过去|近|\blast\b|\bpast\b|\brecent\b"),
    ("iso", r"\b[0-9]{4}-(?:0[1-9]|1[0-2])\b(?!-)"),
    ("year_month", r"[0-9]{4}\s*年\s*[0-9]{1,2}\s*月份?"),
    ("named", r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"),
    ("half", r"半年|half[- ]year|half a year"),
    ("number", r"[0-9]+|[零〇一二两三四五六七八九十]+|\b(?:" + "|".join(NUMBERS) + r")\b"),
    ("counter", r"个"),
    ("quarter", r"季度|季|\bquarters?\b"),
    ("month", r"月份?|\bmonths?\b"),
    ("week", r"周|星期|礼拜|\bweeks?\b"),
    ("day", r"天|日|\bdays?\b"),
    ("year", r"年|\byears?\b"),
)
_WORDS = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in CLASSES))
MONTHS = "january february march april may june july august september october november december".split()


def words(text: str) -> list[tuple[str, str]]:
    """The known words of a text: (class, word); counters between a number and its unit say nothing."""
    return [(m.lastgroup, m[0]) for m in _WORDS.finditer(text.lower()) if m.lastgroup != "counter"]


def number(word: str) -> int:
    """Digits, an English word, or a Chinese numeral below a hundred."""
    if word.isdigit():
        return int(word)
    if word in NUMBERS:
        return NUMBERS[word]
    if "十" in word:
        tens, _, ones = word.partition("十")
        return (DIGITS[tens] if tens else 1) * 10 + (DIGITS[ones] if ones else 0)
    n = 0
    for c in word:
        n = n * 10 + DIGITS[c]
    return n


def _month(n: int, as_of: date) -> TimeRange | None:
    return TimeRange("month", value=f"{as_of.year}-{n:02}") if 1 <= n <= 12 else None


def _recent(count: int, unit: str) -> TimeRange | None:
    return TimeRange("days", count=count * UNITS[unit]) if count > 0 else None


#: Rules: classes that follow each other, and the range that they and their words stand for. The first that fits anywhere wins.
RULES: tuple[tuple[tuple[str, ...], Callable[[list[str], date], TimeRange | None]], ...] = (
    (("previous", "month"), lambda w, d: TimeRange("previous_month")),
    (("recent", "complete", "number", "month"), lambda w, d: TimeRange("complete_months", count=number(w[2]))),
    (("recent", "number", "complete", "month"), lambda w, d: TimeRange("complete_months", count=number(w[1]))),
    (("recent", "number", "month"), lambda w, d: _recent(number(w[1]), "month")),
    (("recent", "month"), lambda w, d: TimeRange("previous_month") if w[0] == "last" else _recent(1, "month")),
    (("this", "month"), lambda w, d: TimeRange("current_month")),
    (("iso",), lambda w, d: TimeRange("month", value=w[0])),
    (("year_month",), lambda w, d: (lambda y, m: TimeRange("month", value=f"{y}-{int(m):02}") if 1 <= int(m) <= 12 else None)(*re.findall(r"[0-9]+", w[0]))),
    (("number", "month"), lambda w, d: _month(number(w[0]), d)),
    (("named",), lambda w, d: _month(MONTHS.index(w[0]) + 1, d)),
    (("to_date",), lambda w, d: TimeRange("year_to_date")),
    (("first_half",), lambda w, d: TimeRange("first_half")),
    (("this_year",), lambda w, d: TimeRange("current_year")),
    (("yoy",), lambda w, d: TimeRange("current_year")),
    *((("recent", "number", unit), lambda w, d, unit=unit: _recent(number(w[1]), unit)) for unit in ("quarter", "week", "day", "year")),
    *((("recent", unit), lambda w, d, unit=unit: _recent(1, unit)) for unit in ("quarter", "half", "week", "year")),
    (("trend",), lambda w, d: _recent(1, "half")),
)


def time_range(text: str, as_of: date) -> TimeRange | None:
    """The range that a phrase names, or None."""
    known = words(text)
    kinds = [k for k, _ in known]
    for needed, meaning in RULES:
        for i in range(len(kinds) - len(needed) + 1):
            if tuple(kinds[i : i + len(needed)]) == needed and (found := meaning([w for _, w in known[i : i + len(needed)]], as_of)):
                return found
    return None


def comparison(text: str) -> str | None:
    """`year` or `month` where a phrase compares with the same time a year, or a month, before."""
    kinds = {k for k, _ in words(text)}
    if "yoy" in kinds or kinds >= {"this_year", "last_year"}:
        return "year"
    return "month" if "mom" in kinds else None


def grain(time: TimeRange | None, compared: str | None) -> str | None:
    """How fine the result's periods are, as far as the phrase says."""
    if compared == "month" or (time and time.kind in ("current_month", "previous_month", "month")):
        return "month"
    return "year" if time and time.kind == "current_year" else None
