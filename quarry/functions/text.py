"""Text functions as Column expressions; what Spark has no function for is an Arrow-batched pandas function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import constants as k


def alias(c: Column) -> Column:
    """Trimmed, lower-cased, without white space and separators."""
    return F.regexp_replace(F.lower(F.trim(c)), k.ALIAS_DROPPED, "")


def field_key(c: Column) -> Column:
    """A field's name without blanks and colons at its ends, and with an underscore for white space inside; null is empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", "_"), "[：:]+$", "")


def document_field(c: Column) -> Column:
    """The document's field that a name stands for, by its spelling, then in small letters; other names as `field_key` has them."""
    known = F.create_map(*[F.lit(x) for kv in k.DOCUMENT_FIELDS.items() for x in kv])
    key = field_key(c)
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.lower(key)), key)


def unit_text(c: Column) -> Column:
    """A unit's name in one spelling: superscripts, micro, degree and full-width signs, per-hour forms, without words like `about`."""
    c = F.regexp_replace(F.lower(F.translate(c, k.UNIT_FROM, k.UNIT_TO)), r"\s+", "")
    c = F.regexp_replace(c, k.ABOUT, "")
    c = F.regexp_replace(F.regexp_replace(c, "/?每小时|/小时", "/h"), r"(per|/)h(ou)?r?$", "/h")
    c = F.regexp_replace(c, "/+", "/")
    return F.when(c == "米", "m").when(c == "℃c", "℃").otherwise(c)


#: A number, what can't be in a unit, and a unit: 2 and 3 may stand in it, but not first.
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
_STOP = r"0-9,;+<()\[【\s~～至到\-"
_UNIT = rf"(?:[^{_STOP}](?:[^{_STOP}]|[23])*)?"
_MEASURE = rf"^\s*({_NUMBER})\s*({_UNIT})(?:\s*[-~～至到]\s*({_NUMBER})\s*({_UNIT}))?\s*(.*)$"


def measure(c: Column, aliases: Column) -> Column:
    """A number or range with its unit, told by known names of units, and what follows it.

    aliases: map<string, struct<canonical, display>> by names as `unit_text` spells them; a few hundred entries of a
    dictionary at most. A struct(kind, value, low, high, unit_raw, unit, text, rest, field, field_value, warnings): kind
    is range, number or none (no number first, a second decimal point, or a sentence in place of a unit); a unit that
    begins with the longest known name is cut there unless a Latin letter follows; `field` and `field_value` part a name
    and a number in what is left.
    """
    given = lambda x: F.nullif(x, F.lit(""))
    split = r"^([^0-9.,;:：+()<>【】\[\]\s]+)\s*([+-]?[0-9.].*)$"

    def parts(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _MEASURE, i)
        unit = F.when((part(3) != "") & (part(4) != ""), part(4)).otherwise(part(2))
        return F.struct(t.alias("t"), t.rlike(_MEASURE).alias("ok"), part(1).alias("first"), part(3).alias("second"), unit.alias("unit"), part(5).alias("rest"))

    def cut(p: Column) -> Column:
        """The unit cut after the longest known name that it begins with, and the rest with what was cut off."""
        unit = p["unit"]
        known = F.filter(F.sequence(F.lit(1), F.greatest(F.length(unit), F.lit(1))), lambda n: F.map_contains_key(aliases, unit_text(F.substring(unit, F.lit(1), n))))
        most = F.coalesce(F.array_max(known), F.lit(0))
        return let(most, lambda m: F.when((m > 0) & (m < F.length(unit)) & ~F.substring(unit, m + 1, F.length(unit)).rlike(r"^\s*[A-Za-z]"), m).otherwise(F.length(unit)))

    def told(p: Column, n: Column) -> Column:
        raw = F.trim(F.regexp_replace(F.left(p["unit"], n), k.ABOUT, ""))
        rest = F.concat(F.substring(p["unit"], n + 1, F.length(p["unit"])), p["rest"])
        rest = F.regexp_replace(F.regexp_replace(rest, r"^[,;、。+<(\s]+", ""), r"[)>】\],、。;\s]+$", "")
        return F.struct(raw.alias("raw"), rest.alias("rest"), F.try_element_at(aliases, unit_text(raw)).alias("entry"))

    def result(p: Column, u: Column) -> Column:
        raw, rest, is_range = u["raw"], u["rest"], p["second"] != ""
        sentence = raw.contains("的") | (F.length(F.regexp_replace(raw, r"[^\x{4E00}-\x{9FFF}]", "")) > 4)
        bad = ~p["ok"] | sentence | raw.startswith(".") | rest.rlike(r"^\.[0-9]")
        a, b = p["first"].try_cast("double"), p["second"].try_cast("double")
        warnings = F.array_compact(F.array(F.when((raw != "") & u["entry"].isNull(), "unit_alias_no_match"), F.when(raw == "", "unit_missing"), F.when(rest != "", "number_unit_trailing_text")))
        return let(bad, lambda bad: F.struct(
            F.when(bad, "none").when(is_range, "range").otherwise("number").alias("kind"),
            F.when(~bad & ~is_range, a).alias("value"), F.when(~bad & is_range, F.least(a, b)).alias("low"), F.when(~bad & is_range, F.greatest(a, b)).alias("high"),
            F.when(~bad, given(raw)).alias("unit_raw"), F.when(~bad, u["entry"]["canonical"]).alias("unit"),
            F.when(bad, F.trim(c)).otherwise(F.concat_ws(" ", F.concat_ws("-", p["first"], given(p["second"])), given(F.coalesce(u["entry"]["display"], u["entry"]["canonical"], raw)))).alias("text"),
            F.when(~bad, given(rest)).alias("rest"), F.when(~bad, given(F.regexp_extract(rest, split, 1))).alias("field"), F.when(~bad, given(F.regexp_extract(rest, split, 2))).alias("field_value"),
            F.when(bad, F.array(F.lit("number_unit_parse_failed"))).otherwise(warnings).alias("warnings"),
        ))

    t = F.translate(F.trim(c), "，（）－—–", ",()---")
    return F.when(c.isNotNull(), let(parts(t), lambda p: let(cut(p), lambda n: let(told(p, n), lambda u: result(p, u)))))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def number_unit(c: Column) -> Column:
    """struct(kind, value, low, high, unit, rest): a number or a range with a unit, else kind `none`."""
    t = F.regexp_replace(F.translate(F.trim(c), k.WIDE_FROM, k.WIDE_TO), ",(?=[0-9]{3})", "")
    num = r"([+-]?[0-9]+(?:\.[0-9]+)?)"
    rng, one = rf"^{num}\s*(?:-|~|to)\s*{num}\s*([A-Za-z%/]*)\s*(.*)$", rf"^{num}\s*([A-Za-z%/]*)\s*(.*)$"
    bad = t.rlike(r"^[+-]?[0-9]*\.[0-9]*\.")
    is_range, is_one = ~bad & t.rlike(rng), ~bad & t.rlike(one)
    part = lambda p, i: F.regexp_extract(t, p, i)
    a, b = part(rng, 1).try_cast("double"), part(rng, 2).try_cast("double")
    return F.struct(
        F.when(is_range, "range").when(is_one, "number").otherwise("none").alias("kind"),
        F.when(~is_range & is_one, part(one, 1).try_cast("double")).alias("value"),
        F.when(is_range, F.least(a, b)).alias("low"), F.when(is_range, F.greatest(a, b)).alias("high"),
        F.when(is_range, F.lower(part(rng, 3))).when(is_one, F.lower(part(one, 2))).alias("unit"),
        F.when(is_range, part(rng, 4)).when(is_one, part(one, 3)).alias("rest"),
    )


def boolean(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(*k.YES), True).when(t.isin(*k.NO), False)


def multi_value(c: Column) -> Column:
    """Distinct trimmed parts of a list; a rate such as `m/h` is one value."""
    parts = F.array_distinct(F.filter(F.transform(F.split(c, k.LIST_SEPARATORS), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.trim(c).rlike(k.RATE), F.array(F.trim(c))).otherwise(parts)


def selections(c: Column) -> Column:
    """Options marked as selected, or all parts if none is marked."""
    marked = F.regexp_extract_all(c, F.lit(r"\[SEL\]\s*([^,;\[\]]+)"), F.lit(1))
    return F.when(F.size(marked) > 0, F.transform(marked, lambda x: F.trim(x))).otherwise(multi_value(c))


def indexed_name(c: Column) -> Column:
    """struct(base, n): a name's trailing number parted from it."""
    return F.struct(F.regexp_extract(c, r"^(.*?)[ _#-]*([0-9]*)$", 1).alias("base"), F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("int").alias("n"))


def qualifier(c: Column) -> Column:
    """struct(bare, qualifier, confidence): a leading place or ordinal word parted from a value."""
    word = F.regexp_extract(F.lower(F.trim(c)), rf"^({'|'.join(k.QUALIFIERS)})\s+", 1)
    bare = F.regexp_replace(F.lower(F.trim(c)), rf"^({'|'.join(k.QUALIFIERS)})\s+", "")
    return F.struct(bare.alias("bare"), F.nullif(word, F.lit("")).alias("qualifier"), F.when(word == "", None).when(F.length(bare) >= 3, 0.82).otherwise(0.68).alias("confidence"))


def tokens(c: Column) -> Column:
    """Distinct words of two characters or more, and the number of any word like `120mm`."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))
    numbers = F.regexp_extract_all(F.lower(c), F.lit(r"\b([0-9]+)mm\b"), F.lit(1))
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) >= 2), numbers))


def question_tokens(c: Column) -> Column:
    """Words with the number at their end, numbers, runs of Chinese characters and each two of these that are neighbours; distinct."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Za-z]+[0-9]*|[0-9]+|[\x{4E00}-\x{9FA5}]{2,})"), F.lit(1))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(found, lambda w: F.when(w.rlike(r"^[\x{4E00}-\x{9FA5}]"), F.concat(F.array(w), pairs(w))).otherwise(F.array(w)))))


#: Characters of a Chinese run of which every part is a token of an index; longer parts are found whole runs only.
LONGEST_PART = 8


def index_tokens(c: Column) -> Column:
    """What an index holds of a text: lower-case words of letters and digits, their leading letters-with-digits and numbers, and each part of 2 to 8 characters of Chinese runs, and the runs; tokens may repeat."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), F.lit(1))
    # A word is its own only part, unless a letter follows a digit.
    parts = F.when(low.rlike("[0-9][a-z]"), F.regexp_extract_all(low, F.lit(r"([a-z]+[0-9]*|[0-9]+)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    chinese = F.regexp_extract_all(low, F.lit(r"([\x{4E00}-\x{9FA5}]{2,})"), F.lit(1))
    cut = lambda w, n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array())
    pieces = F.flatten(F.transform(chinese, lambda w: F.concat(F.array(w), *[cut(w, n) for n in range(2, LONGEST_PART + 1)])))
    return F.concat(words, parts, pieces)


def bigrams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 2, F.array()).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts; else by containment, else the Dice share of distinct bigrams."""
    x, y = bigrams(a), bigrams(b)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    contained = a.contains(b) | b.contains(a)
    dice = 2 * F.size(F.array_intersect(x, y)) / F.nullif(F.size(x) + F.size(y), F.lit(0))
    return F.when(a == b, 1.0).when((short > 0) & contained, 0.65 + 0.3 * short / long).otherwise(F.coalesce(dice, F.lit(0.0)))


def fingerprint(c: Column) -> Column:
    """A query's shape: literals, dates and numbers as placeholders, white space single, lower-cased."""
    c = F.regexp_replace(c, r"'[0-9]{4}-[0-9]{2}-[0-9]{2}[^']*'", "<date>")
    c = F.regexp_replace(c, r"'[^']*'", "<text>")
    c = F.regexp_replace(F.lower(c), r"\btop [0-9]+\b", "top <n>")
    c = F.regexp_replace(c, r"\b[0-9]+(\.[0-9]+)?\b", "<number>")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def redacted(c: Column) -> Column:
    """Mail addresses, telephone and long identity numbers, and named secrets replaced."""
    c = F.regexp_replace(c, k.EMAIL, "[email]")
    c = F.regexp_replace(c, k.SECRET, "$1=[secret]")
    c = F.regexp_replace(c, k.IDENTITY, "[id]")
    return F.regexp_replace(c, k.PHONE, "[phone]")


def summary(c: Column, most: int = 240) -> Column:
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.left(one, F.lit(most - 1)), F.lit("…")))


def width(c: Column) -> Column:
    """The first three- to five-digit length in millimetres in a text."""
    return F.nullif(F.regexp_extract(F.lower(c), r"([0-9]{3,5})\s*mm", 1), F.lit("")).try_cast("double")


def model_name(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.translate(c, k.WIDE_FROM, k.WIDE_TO)), r"[\s_/.\-]+", "")


def mixed_date(c: Column) -> Column:
    """A date from year, month and day with any of the usual separators, or null."""
    return F.try_to_date(F.regexp_replace(F.regexp_extract(c, r"^\s*([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2})", 1), r"[/.]", "-"), "yyyy-M-d")


def clean_number(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def quantity(c: Column) -> Column:
    """A count in digits or in Chinese numerals up to the thousands, with or without a counter; null for what is neither."""
    t = F.regexp_replace(F.translate(c, k.WIDE_FROM, k.WIDE_TO), r"\s+", "")
    digits = F.regexp_extract(t, rf"(?i)^([0-9]+)(?:{k.COUNTERS})?$", 1)
    numeral = F.regexp_extract(t, rf"(?i)^([{''.join(k.CHINESE_DIGITS)}{''.join(k.CHINESE_STEPS)}]+)(?:{k.COUNTERS})?$", 1)
    map_of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    worth, steps = map_of(k.CHINESE_DIGITS), map_of(k.CHINESE_STEPS)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def read(s: Column, x: Column) -> Column:
        step = F.try_element_at(steps, x)
        more = F.when(s["last"] == 0, 1).otherwise(s["last"]) * step
        return F.when(step.isNotNull(), F.struct((s["total"] + more).alias("total"), F.lit(0).alias("last"))).otherwise(F.struct(s["total"].alias("total"), F.try_element_at(worth, x).alias("last")))

    sum_ = F.aggregate(F.filter(F.split(numeral, ""), lambda x: x != ""), start, read, lambda s: s["total"] + s["last"])
    return F.when(digits != "", digits.try_cast("int")).when(numeral != "", sum_)


def without_literals(c: Column) -> Column:
    """SQL text with comments and literals blanked, of the same length: runs without a quote, dash or slash are kept as they are, each literal or comment is as many spaces."""
    blank = r"--[^\n]*|/\*(?s:.*?)\*/|'(?:[^']|'')*'"
    pieces = F.regexp_extract_all(c, F.lit(rf"({blank}|[^'/\-]+|(?s:.))"), F.lit(1))
    hidden = lambda p: (F.length(p) > 1) & p.rlike(r"^(?:--|/\*|')")
    return F.when(c.isNotNull(), F.array_join(F.transform(pieces, lambda p: F.when(hidden(p), F.repeat(F.lit(" "), F.length(p))).otherwise(p)), ""))
