"""Deterministic scores as Column arithmetic. All are clamped and rounded half up, as floor(x * k + 0.5) / k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int) -> Column:
    k = 10**places
    return F.floor(c * k + 0.5) / k


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def weight(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def total(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def token_ratio(wanted: Column, have: Column) -> Column:
    """The share of wanted tokens that are there, 0 for none wanted."""
    return F.coalesce(F.size(F.array_intersect(wanted, have)) / F.nullif(F.size(wanted), F.lit(0)), F.lit(0.0))


def words_ratio(text: Column, wanted: tuple[str, ...]) -> Column:
    """The share of a few wanted words (a-z and digits) that a long text has; the text is searched, not split."""
    low = F.lower(text)
    return total(*[weight(low.rlike(rf"(^|[^a-z0-9]){w}($|[^a-z0-9])"), 1.0) for w in wanted]) / len(wanted)


def closeness(a: Column, b: Column) -> Column:
    """1 for equal widths, falling to 0 at the larger of 100 and a tenth of the wanted one."""
    return 1 - F.least(F.abs(a - b) / F.greatest(F.lit(100.0), 0.1 * F.abs(b)), F.lit(1.0))


def item_score(phrase: Column, ratio: Column, same_type: Column, material: Column, application: Column, near: Column, ready: tuple[Column, Column, Column]) -> Column:
    """How well an archived item answers a search, to three places."""
    parts = [weight(phrase, 0.12), 0.18 * ratio, weight(same_type, 0.20), weight(material, 0.18), weight(application, 0.14), 0.20 * near]
    parts += [weight(c, w) for c, w in zip(ready, (0.03, 0.03, 0.02), strict=True)]
    return rounded(clamped(total(*parts)), 3)


def reference_score(intent: Column, module: Column, ratio: Column, metrics: Column, schema: Column, finance: Column, family: Column, verified: Column) -> Column:
    """How well a reference query fits a question, to four places. metrics and schema are counts of hits."""
    parts = [weight(intent, 0.25), weight(module, 0.18), 0.35 * ratio, F.least(F.lit(0.16), 0.08 * metrics), F.least(F.lit(0.12), 0.03 * schema), weight(finance, 0.20), weight(family, 0.04), weight(verified, 0.03)]
    return rounded(clamped(total(*parts)), 4)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null for vectors of other lengths, or without length."""
    x, y = (c.cast("array<double>") for c in (a, b))
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, p: s + p * p))
    return F.when(F.size(a) == F.size(b), dot / F.nullif(norm(x) * norm(y), zero))


def mapped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), (cosine(a, b) + 1) / 2)


def hybrid(lexical: Column, vector: Column) -> Column:
    return rounded(F.when(vector.isNull(), lexical).otherwise(0.75 * lexical + 0.25 * vector), 4)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").otherwise("D")


def policy_score(base: Column, high: Column, middle: Column, low: Column, audit: Column, occurrences: Column, rejected: Column, capped: Column) -> Column:
    """Confidence less what risks and audits take from it. high, middle, low: counts of issues; audit: penalty asked for."""
    score = base - 0.35 * high - 0.20 * middle - 0.08 * low - F.least(audit, F.lit(0.4)) + weight(occurrences >= 10, 0.04) - weight(rejected, 0.4)
    return rounded(F.when(capped, F.least(clamped(score), F.lit(0.69))).otherwise(clamped(score)), 4)


def governance_priority(risk: Column, occurrences: Column, confidence: Column) -> Column:
    return risk * 1_000_000 + occurrences * 1_000 + F.floor(confidence * 999 + 0.5)


def contains_any(text: Column, keywords: list[str]) -> Column:
    """Whether a text holds any of the keywords, in any case; null texts hold none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keywords], F.lit(False))


def table_relevance(name: Column, label: Column, description: Column, keywords: list[str]) -> Column:
    """60 for a keyword in a table's name, 35 in its label, 20 in its description."""
    return total(*[F.when(contains_any(c, keywords), w).otherwise(0) for c, w in ((name, 60), (label, 35), (description, 20))])


def field_relevance(name: Column, stored: Column, label: Column, description: Column, keywords: list[str]) -> Column:
    """45 for a keyword in a field's name, 40 in its stored name, 25 in its label, 15 in its description."""
    return total(*[F.when(contains_any(c, keywords), w).otherwise(0) for c, w in ((name, 45), (stored, 40), (label, 25), (description, 15))])


def term_weight(question: Column, term: Column, value: int) -> Column:
    """The value where a question holds a term, in any case; empty and null terms are in none."""
    low = F.lower(F.coalesce(term, F.lit("")))
    return F.when((low != "") & F.lower(question).contains(low), value).otherwise(0)


def module_relevance(question: Column, module: Column, label: Column, description: Column, keywords: Column, tables: Column) -> Column:
    """8 for the module's name in a question, 8 for its label, 2 for its description, 5 for each keyword and 4 for each table."""
    each = lambda c, v: F.aggregate(F.coalesce(c, F.array().cast("array<string>")), F.lit(0), lambda s, t: s + term_weight(question, t, v))
    return total(term_weight(question, module, 8), term_weight(question, label, 8), term_weight(question, description, 2), each(keywords, 5), each(tables, 4))


def template_relevance(intent: Column, module: Column, slots: Column, ratio: Column, boost: Column, uses: Column, successes: Column) -> Column:
    """How well a query template answers a question, to four places: slots and ratio are shares of slots and tokens it has; what was used tells by its success."""
    used = F.when(uses > 0, 0.1 * (successes / uses)).otherwise(0.0)
    return rounded(F.least(F.lit(1.0), total(weight(intent, 0.4), weight(module, 0.2), 0.2 * slots, 0.1 * ratio, boost, used)), 4)


def family_relevance(intent: Column, module: Column, ratio: Column) -> Column:
    return rounded(total(weight(intent, 0.4), weight(module, 0.2), 0.4 * ratio), 4)


def config_relevance(number: Column, confidence: Column, customer: Column, product_type: Column, product: Column) -> Column:
    """How sure a configuration match is, to three places: bound product number and its confidence, customer, product type that isn't unknown, product."""
    has = lambda c: F.coalesce(c.isNotNull() & (c.cast("string") != ""), F.lit(False))
    sure = F.when(confidence.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.15), confidence * 0.15)))
    parts = [F.lit(0.45), weight(has(number), 0.25), sure, weight(has(customer), 0.08), weight(has(product_type) & (product_type != "unknown"), 0.05), weight(has(product), 0.07)]
    return clamped(rounded(total(*parts), 3))
