"""How far a document has come, and what is wrong with a candidate of the dictionary: ordered rules, the first or all that hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The columns that a document's state is told from.
LEDGER = "duplicates canonical_id has_blocks extraction_id extraction_status has_plan normalized_id stale items insert_mode dictionary_dirty archive_linked archive_status archive_dirty pending review".split()
#: The stage of a state; all others are `normalized`.
STAGES = {"pending_blocks": "uploaded", "pending_extraction": "blocks_ready", "planned": "planned", "needs_reextract": "raw_extracted", "duplicate_reference": "duplicate", "archived": "archived"}


# Fixed order: the first outcome that holds is the state.
def terminal_state() -> Column:
    """The first of twelve outcomes that holds, from the columns of `LEDGER`."""
    c = {name: F.col(name) for name in LEDGER}
    yes = lambda x: F.coalesce(x, F.lit(False))
    none = c["normalized_id"].isNull()
    return (
        F.when(yes(c["duplicates"] > 0) & c["canonical_id"].isNotNull(), "duplicate_reference")
        .when(~yes(c["has_blocks"]), "pending_blocks")
        .when(c["extraction_id"].isNull(), "pending_extraction")
        .when(yes(c["extraction_status"].contains("needs_reextract")), "needs_reextract")
        .when(none & (yes(c["has_plan"]) | yes(c["extraction_status"] == "planned")), "planned")
        .when(none, "needs_reextract")
        .when(yes(c["stale"]), "needs_reextract")
        .when(~yes(c["items"] > 0), "normalized_empty")
        .when(yes(c["insert_mode"] == "blocked"), "normalized_blocked")
        .when(yes(c["dictionary_dirty"]), "normalized_partial")
        .when(yes(c["archive_linked"]) & yes(c["archive_status"] == "archived") & c["archive_dirty"].isNull(), "archived")
        .when(yes(c["insert_mode"] == "partial_insert") | yes(c["pending"] > 0) | yes(c["review"] > 0), "normalized_partial")
        .otherwise("normalized_full")
    )


def stage(state: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), state), F.lit("normalized"))


# Patterns of the detectors.
PLACEHOLDER = r"(?i)^(?:未选中?|无选中项|未填写|未填|不选|空|n/?a|null|undefined|-|—)$"
PLACED = "(上模|下模|左侧|右侧|前段|后段|入口|出口|内层|外层|第[一二三四五六七八九十0-9]+|[0-9]+#)"
OF_DOCUMENT = "(合同|订单|客户|国家|日期|交期|交货|地址|联系人|电话)"
SEVERAL = "(第[一二三四五六七八九十0-9]+套|[0-9]+#|[一二三四五六七八九十0-9]+号|多套|多台)"
NO_FIELD = "^(备注|说明|序号|编号|客户|合同|订单|日期|签字|审核|制表)$"
COMPOSITE = "[+＋、，,/／|]|(?:及|和|与|或|;|；)"
MEASURE = r"(?i)[0-9]+(?:\.[0-9]+)?\s*(mm|毫米|cm|m|kg|g|mpa|bar|kw|w|v|ccm|rpm|℃|度)"
RATE = "(?i)^(?:kg/h|ml/min|m/min|l/min|n/m|g/10min)$"
LISTED = "[、，,/／|]"


def issues(kind: Column, field: Column, value: Column, term: Column, scope: Column, split: Column, known: Column, source: Column | None = None) -> Column:
    """array<struct(detector, relation, action, confidence, risk)> of what is wrong with a candidate, surest first.

    kind: term_type or value; term: the type that a value is for; known: types in whose dictionaries the name or value is;
    split: whether the value is a part of another already; source: the text that the value was taken from.
    """
    field, value = F.trim(F.coalesce(field, F.lit(""))), F.trim(F.coalesce(value, F.lit("")))
    both = F.concat_ws(" ", field, value)
    is_value, known = kind == "value", F.coalesce(known, F.array().cast("array<string>"))
    whole = F.concat_ws(" ", F.nullif(value, F.lit("")), F.nullif(F.trim(source), F.lit("")) if source is not None else F.lit(None).cast("string"))
    one_thing = F.regexp_replace(value, r"\s+", "").rlike(RATE) | (value.rlike(MEASURE) & ~value.rlike(LISTED))
    parted = (value != "") & whole.rlike(COMPOSITE) & ~F.coalesce(split, F.lit(False)) & ~one_thing
    found = [
        (is_value & value.rlike(PLACEHOLDER), "placeholder_value", "non_config_noise", "mark_non_config", 0.88, "low"),
        ((kind == "term_type") & (F.size(known) > 0) & (F.coalesce(F.nullif(field, F.lit("")), value) != ""), "value_as_type", "value_as_type", "send_to_review", 0.86, "medium"),
        (is_value & F.exists(known, lambda k: ~k.eqNullSafe(term)), "cross_term_type", "different_concept", "send_to_review", 0.83, "high"),
        (both.rlike(OF_DOCUMENT) & ~scope.eqNullSafe(F.lit("document")), "scope_contamination", "wrong_scope", "move_scope", 0.82, "high"),
        (field.rlike(NO_FIELD) | ((F.length(field) <= 2) & (value == "")), "non_config_noise", "non_config_noise", "mark_non_config", 0.80, "low"),
        (both.rlike(PLACED), "qualifier_variant", "qualifier_variant", "map_as_qualifier_variant", 0.78, "medium"),
        (is_value & parted, "composite_value", "composite_value", "split_value", 0.78, "medium"),
        (both.rlike(SEVERAL), "multi_item", "extraction_error", "mark_extraction_error", 0.76, "medium"),
    ]
    one = lambda x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x[1:], ("detector", "relation", "action", "confidence", "risk"), strict=True)])
    return F.array_compact(F.array(*[F.when(x[0], one(x)) for x in found]))
