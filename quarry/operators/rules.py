"""The rule ladders of the dictionary and of the archive, as decision tables. Patterns, lists, scores and thresholds are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.decisions import DecisionTable, Of

# Routing of a candidate

ACCEPT, REVIEW = 0.92, 0.55
ACTION = DecisionTable(
    ("kind", "relation", "issue_action", "has_target", "value_kind"), ("action",),
    (
        ("issue", (("issue_action", "known", True),), {"action": Of("issue_action")}),
        ("split", (("has_target", "is", True), ("relation", "is", "split_component")), {"action": "split_value"}),
        ("known_type", (("has_target", "is", True), ("kind", "is", "term_type")), {"action": "map_to_existing_termtype"}),
        ("known_value", (("has_target", "is", True),), {"action": "add_alias"}),
        ("new_type", (("kind", "is", "term_type"),), {"action": "create_new_termtype_candidate"}),
        ("new_value", (("value_kind", "in", ("enum", "enums")),), {"action": "create_new_enum_value_candidate"}),
    ),
    {"action": "send_to_review"},
)


def _to(route: str, action=Of("action")) -> dict:
    return {"route": route, "action": action}


ROUTING = DecisionTable(
    ("kind", "term_type", "relation", "action", "risk", "occurrences", "alias_exact", "issues", "score", "blocked", "accept", "review", "llm"), ("route", "action"),
    (
        ("noise", (("relation", "in", ("extraction_error", "non_config_noise")),), _to("auto_reject_pending")),
        ("low_risk_value", (("kind", "is", "value"), ("term_type", "in", ("plastic_material", "application")), ("risk", "is", "low")), _to("auto_pass")),
        ("rare", (("occurrences", "below", 2), ("alias_exact", "not", True), ("issues", "at_most", 0)), _to("defer_until_more_occurrences", "defer_until_more_occurrences")),
        ("part_of_a_value", (("relation", "is", "split_component"),), _to("human_review", "split_value")),
        ("exact_value", (("kind", "is", "value"), ("relation", "is", "exact_alias"), ("action", "is", "add_alias"), ("risk", "is", "low"), ("blocked", "not", True)), _to("auto_accept_pending")),
        ("exact_type", (("kind", "is", "term_type"), ("relation", "is", "exact_alias"), ("action", "is", "map_to_existing_termtype"), ("issues", "at_most", 0), ("score", "at_least", Of("accept")), ("blocked", "not", True)), _to("auto_pass")),
        ("sure_type", (("kind", "is", "term_type"), ("score", "at_least", Of("accept"))), _to("human_review")),
        ("sure_but_blocked", (("score", "at_least", Of("accept")), ("blocked", "is", True)), _to("human_review")),
        ("sure_value", (("kind", "is", "value"), ("relation", "in", ("exact_alias", "synonym_alias")), ("action", "is", "add_alias"), ("score", "at_least", Of("accept"))), _to("auto_accept_pending")),
        ("middle_with_model", (("score", "at_least", Of("review")), ("issues", "at_most", 0), ("llm", "is", True)), _to("llm_review")),
        ("middle", (("score", "at_least", Of("review")), ("issues", "at_most", 0)), _to("human_review")),
    ),
    _to("human_review"),
)


def routed(issues: Column, target_relation: Column, target_score: Column, conflict: Column, unified: Column, given: dict[str, Column], accept: float = ACCEPT, review: float = REVIEW) -> Column:
    """struct(rule, route, action, relation, risk, score) of a candidate.

    issues: array<struct(relation, action, confidence, risk)>, surest first; target: the best known concept, of null relation
    if there is none; conflict: whether its type, kind of value or unit is another; unified: the score that is tried.
    `given` has kind, term_type, occurrences, alias_exact, value_kind, blocked and llm.
    """
    top = F.try_element_at(issues, F.lit(1))
    relation = F.coalesce(top["relation"], target_relation, F.lit("different_concept"))
    action = ACTION.first({"kind": given["kind"], "relation": relation, "issue_action": top["action"], "has_target": target_relation.isNotNull(), "value_kind": given["value_kind"]})["action"]
    has = lambda r: F.exists(issues, lambda i: i["risk"] == r)
    risk = F.when(F.coalesce(conflict, F.lit(False)) | has("high"), "high").when(has("medium"), "medium").otherwise("low")
    more = {"relation": relation, "action": action, "risk": risk, "issues": F.size(issues), "score": unified, "accept": F.lit(accept), "review": F.lit(review)}
    columns = {c: given[c] for c in ("kind", "term_type", "occurrences", "alias_exact", "blocked", "llm")} | more
    out = ROUTING.first(columns)
    return F.struct(out["rule"].alias("rule"), out["route"].alias("route"), out["action"].alias("action"), relation.alias("relation"), risk.alias("risk"), F.coalesce(top["confidence"], unified, target_score, F.lit(0.45)).alias("score"))


# Triage of a candidate by its meaning

MATERIALS = (
    ("pvc", "(?i)PVC|聚氯乙烯"), ("pe", "(?i)(^|[^a-z])PE([^a-z]|$)|聚乙烯"), ("pp", "(?i)(^|[^a-z])PP([^a-z]|$)|聚丙烯"), ("abs", "(?i)ABS"), ("pet", "(?i)PET|聚酯"),
    ("pc", "(?i)(^|[^a-z])PC([^a-z]|$)|聚碳酸酯"), ("pa", "(?i)(^|[^a-z])PA([^a-z]|$)|尼龙"), ("tpe/tpu", "(?i)TPE|TPU"), ("eva", "(?i)EVA"),
)
USES = (("film", "(?i)film|薄?膜"), ("sheet", "(?i)sheet|片材|板材"), ("pipe", "(?i)pipe|管材|管道"), ("profile", "(?i)profile|型材"), ("coating", "(?i)coating|涂布|涂层"), ("packaging", "(?i)packaging|包装"))
SEPARATOR = "、|，|,|;|；|\\||／|/|\\+|和|与|及|或"


def _classes(rules, column: str) -> DecisionTable:
    return DecisionTable((column,), ("found",), tuple((name, ((column, "matches", pattern),), {"found": name}) for name, pattern in rules), {"found": None})


MATERIAL, USE = _classes(MATERIALS, "value"), _classes(USES, "value")
NOTE = DecisionTable(
    ("value",), ("note",),
    (
        ("empty", (("value", "is", ""),), {"note": "placeholder"}),
        ("not_chosen", (("value", "matches", r"(?i)^(?:未选|未填写|无|N/?A|-|—)$"),), {"note": "placeholder"}),
        ("date", (("value", "matches", r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$"),), {"note": "document_info"}),
        ("document", (("value", "matches", r"(?i)客户|合同|订单|图纸|日期|交期|HT-[0-9]+"),), {"note": "document_info"}),
        ("note", (("value", "matches", "备注|说明|注意事项"),), {"note": "non_config_note"}),
        ("long", (("value", "matches", r"(?s)^.{81,}$|[。；;，,].*[。；;，,]"),), {"note": "long_note"}),
    ),
    {"note": None},
)
_LABEL = lambda name: (("labels", "matches", f"(^|,){name}(,|$)"),)
TRIAGE = DecisionTable(
    ("labels",), ("action", "confidence"),
    (
        ("noise", _LABEL("noise"), {"action": "reject_as_noise", "confidence": 0.9}),
        ("document_note", _LABEL("document_note"), {"action": "reject_or_doc_note", "confidence": 0.84}),
        ("variant", _LABEL("qualifier_rematch_found"), {"action": "review_as_existing_value_variant", "confidence": 0.86}),
        ("composite", _LABEL("composite_multi_value"), {"action": "review_composite", "confidence": 0.8}),
        ("material", _LABEL("material_classified"), {"action": "review_material_class", "confidence": 0.74}),
        ("application", _LABEL("application_classified"), {"action": "review_application_class", "confidence": 0.74}),
        ("unmatched_variant", _LABEL("qualifier_rematch_miss"), {"action": "normal_review", "confidence": 0.68}),
    ),
    {"action": "normal_review", "confidence": 0.5},
)


def triaged(term_type: Column, value: Column, qualifier: Column, rematched: Column) -> Column:
    """struct(labels, note, family, domain, parts, rule, action, confidence). qualifier: the part of the value that places it, null for none; rematched: whether the rest is a known value."""
    v = F.trim(F.coalesce(value, F.lit("")))
    note = NOTE.first({"value": v})["note"]
    rate = F.regexp_replace(v, r"\s+", "").rlike("(?i)^(?:kg/h|g/10min|ml/min|m/min|l/min|n/m)$")
    parts = F.when(rate, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(F.transform(F.split(v, SEPARATOR), lambda p: F.trim(p)), lambda p: p != "")))
    parts = F.when((F.size(parts) > 1) & v.rlike(SEPARATOR), parts).otherwise(F.array().cast("array<string>"))
    family = F.when(term_type.rlike("(?i)(^|_)(material|plastic_material|product_material)(_|$)"), MATERIAL.first({"value": v})["found"])
    domain = F.when(~F.coalesce(term_type.rlike("(?i)(^|_)(material|plastic_material|product_material)(_|$)"), F.lit(False)) & term_type.rlike("(?i)(^|_)(application|usage|use_case)(_|$)"), USE.first({"value": v})["found"])
    found = F.coalesce(rematched, F.lit(False))
    labels = F.concat_ws(
        ",", F.when(note == "placeholder", "noise").when(note.isNotNull(), "document_note"), F.when(qualifier.isNotNull(), "qualifier_variant"),
        F.when(qualifier.isNotNull(), F.when(found, "qualifier_rematch_found").otherwise("qualifier_rematch_miss")), F.when(F.size(parts) > 0, "composite_multi_value"),
        F.when(family.isNotNull(), "material_classified"), F.when(domain.isNotNull(), "application_classified"),
    )
    out = TRIAGE.first({"labels": labels})
    return F.struct(labels.alias("labels"), note.alias("note"), family.alias("family"), domain.alias("domain"), parts.alias("parts"), out["rule"].alias("rule"), out["action"].alias("action"), out["confidence"].alias("confidence"))


# Configuration of a die

DIE = DecisionTable(
    ("type", "name"), ("die",),
    (
        ("coating", ([("type", "is", "coating_die"), ("name", "matches", "涂布|涂覆")],), {"die": "coating_die"}),
        ("round", ([("type", "is", "blown_film_die"), ("name", "matches", "吹膜|圆模头")],), {"die": "round_die"}),
        ("flat", (("type", "is", "flat_die"),), {"die": "flat_die"}),
        ("by_name", (("type", "is", ""), ("name", "matches", "模头|模具")), {"die": "flat_die"}),
    ),
    {"die": "unknown"},
)
FORM = DecisionTable(
    ("name", "die"), ("form", "business"),
    (
        ("board", (("name", "matches", "板材|厚板|中空(?:格子)?板|波浪瓦"),), {"form": "board", "business": "board_die"}),
        ("sheet", (("name", "matches", "片材"),), {"form": "sheet", "business": "sheet_die"}),
        ("film", ([("name", "matches", "膜"), ("die", "is", "round_die")],), {"form": "film", "business": "film_die"}),
        ("flat", (("die", "is", "flat_die"),), {"form": "board_sheet", "business": "board_sheet_die"}),
    ),
    {"form": "unknown", "business": "unknown"},
)
_HOT = (("application", "is", "thermoforming"), ("die", "not", "unknown"))
CONFIGURATION = DecisionTable(
    ("application", "die", "form", "restrictor", "thickest"), ("family", "conflict"),
    (
        ("other", ([("application", "not", "thermoforming"), ("die", "is", "unknown")],), {"family": "", "conflict": ""}),
        ("board_called_sheet", (*_HOT, ("restrictor", "is", True), ("form", "is", "sheet")), {"family": "thermoforming_board_with_restrictor", "conflict": "name_sheet_structure_board"}),
        ("board", (*_HOT, ("restrictor", "is", True)), {"family": "thermoforming_board_with_restrictor", "conflict": ""}),
        ("thick_called_sheet", (*_HOT, ("thickest", "above", 2.5), ("form", "is", "sheet")), {"family": "thermoforming_board_structure_expected", "conflict": "name_sheet_structure_board"}),
        ("thick", (*_HOT, ("thickest", "above", 2.5)), {"family": "thermoforming_board_structure_expected", "conflict": "board_thickness_missing_restrictor_evidence"}),
        ("thin_called_board", (*_HOT, ("thickest", "known", True), ("form", "is", "board")), {"family": "thermoforming_sheet_standard", "conflict": "name_board_structure_sheet"}),
        ("thin", (*_HOT, ("thickest", "known", True)), {"family": "thermoforming_sheet_standard", "conflict": ""}),
    ),
    {"family": "thermoforming_unresolved", "conflict": ""},
)
_THICK = r"(?i)(?:制品|产品|成品)(?:有效)?\s*厚度(?:\s*范围)?[^0-9]{0,80}?([0-9]+(?:\.[0-9]+)?)\s*(?:(?:-|~|～|—|至)\s*([0-9]+(?:\.[0-9]+)?)\s*)?(?:mm|毫米)"
_ROW = r"\n(?=(?i:Row)\s+[0-9]+\s*[:：])"


def die_configuration(text: Column, name: Column, kind: Column) -> Column:
    """struct(application, die, form, business, thin, thick, restrictor, family, conflict) from a document's text, the product's name and its type (empty if unknown)."""
    text, name, kind = (F.coalesce(c, F.lit("")) for c in (text, name, kind))
    rows = F.split(text, _ROW)
    about = F.regexp_replace(F.coalesce(F.try_element_at(F.filter(rows, lambda r: r.rlike(r"(?:制品|产品|成品)(?:有效)?\s*厚度")), F.lit(1)), F.lit("")), r"(?i)\[[A-Z]+[0-9]*\]", "")
    first, second = (F.regexp_extract(about, _THICK, i).try_cast("double") for i in (1, 2))
    second = F.coalesce(second, first)
    chosen = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?i)(?:\[SEL\]|☑|√)\s*([^\n]*)"), F.lit(1)), lambda x: F.trim(x))
    marked = F.exists(rows, lambda r: r.contains("阻流棒") & F.exists(chosen(r), lambda v: ~v.rlike("^(?:无|不配置|不使用|不用)$") & v.rlike("^(?:有|是)|阻流棒")))
    restrictor = text.rlike(r"(?:配置|采用|安装|带有?)\s*(?:了|有)?\s*阻流棒|阻流棒\s*[:：]\s*(?!无|不)(?:有|已配置|[0-9]+\s*°)") | marked
    application = F.when(F.concat_ws("\n", name, text).rlike("热成型|吸塑"), "thermoforming").otherwise("")
    die = DIE.first({"type": kind, "name": name})["die"]
    form = FORM.first({"name": name, "die": die})
    thick = F.when(first.isNotNull(), F.greatest(first, second))
    out = CONFIGURATION.first({"application": application, "die": die, "form": form["form"], "restrictor": restrictor, "thickest": thick})
    return F.struct(
        application.alias("application"), die.alias("die"), form["form"].alias("form"), form["business"].alias("business"), F.when(first.isNotNull(), F.least(first, second)).alias("thin"), thick.alias("thick"),
        restrictor.alias("restrictor"), out["family"].alias("family"), out["conflict"].alias("conflict"),
    )


# Use of a family of queries

BUSINESS = "(?i)(工单|工序|报工|任务|生产|完工|延期|采购|供应商|入库|收货|采购单|销售|订单|客户|发货|库存|物料|bom|eco|报价|合同|成本|费用|财务|毛利|应付|应收|项目|设计|技术)"
URGENT = "(?i)(生产任务|今日任务|明日任务|bom|eco|产品报价|产品配置|采购及时率|采购延期|采购分析|销售订单|签约额|库存查询|发货通知|工时统计|财务费用|成本数据表)"
FAMILY_USE = DecisionTable(
    ("text", "risks", "joins", "variants"), ("use",),
    (
        ("sensitive", (("text", "matches", "(采购单价|销售金额|成本|毛利|费用|财务|工资|提成|供应商价格|客户价格)"),), {"use": "permission_sensitive"}),
        ("metric", (("text", "matches", "(成本|费用|毛利|及时率|延期率|工时统计|库存金额|采购金额|经营分析)"),), {"use": "business_metric_catalog"}),
        ("template", (("text", "matches", "(库存查询|采购订单明细|销售订单明细|工单进度|报工明细)"), ("risks", "at_most", 0), ("joins", "above", 0)), {"use": "template_candidate"}),
        ("reference", ([("text", "matches", "(生产任务|拉动式生产|销售驾驶舱|采购延期|供应商及时率|发货看板)"), ("variants", "above", 1)],), {"use": "reference_then_template"}),
    ),
    {"use": "reference_retrieval"},
)
FAMILY_PRIORITY = DecisionTable(
    ("text", "use", "module"), ("priority",),
    (("urgent", ([("text", "matches", URGENT), ("use", "is", "template_candidate")],), {"priority": "high"}), ("business", ([("module", "not", "unknown"), ("text", "matches", BUSINESS)],), {"priority": "medium"})),
    {"priority": "low"},
)
FAMILY_DOMAIN = DecisionTable(
    ("text", "module"), ("domain",),
    tuple(
        (domain, ([("text", "matches", pattern), ("module", "is", domain)],), {"domain": domain})
        for domain, pattern in (
            ("finance", "(财务|费用|应付|应收|成本|毛利)"), ("purchase", "(采购|供应商|入库|收货)"), ("sales", "(销售|客户|发货|签约)"), ("production", "(?i)(工单|生产|工序|报工|bom|eco)"), ("inventory", "(库存|物料)"),
        )
    ),
    {"domain": "general"},
)
FAMILY_SENSITIVITY = DecisionTable(
    ("text", "use"), ("sensitivity",),
    (("sensitive", (("use", "is", "permission_sensitive"),), {"sensitivity": "high"}), ("money", (("text", "matches", "(金额|单价|价格|成本|毛利|费用|财务)"),), {"sensitivity": "medium"})),
    {"sensitivity": "low"},
)


def family_use(text: Column, module: Column, risks: Column, joins: Column, variants: Column) -> Column:
    """struct(use, priority, domain, sensitivity) of a family of report queries."""
    use = FAMILY_USE.first({"text": text, "risks": risks, "joins": joins, "variants": variants})["use"]
    module = F.coalesce(module, F.lit("unknown"))
    return F.struct(
        use.alias("use"), FAMILY_PRIORITY.first({"text": text, "use": use, "module": module})["priority"].alias("priority"), FAMILY_DOMAIN.first({"text": text, "module": module})["domain"].alias("domain"),
        FAMILY_SENSITIVITY.first({"text": text, "use": use})["sensitivity"].alias("sensitivity"),
    )


# Features that are missing in the archive

STRUCTURE = ("lip_adjustment_method", "deckle_type")
APPLIED = ("product_type", "effective_width_mm", "plastic_material", "application")
TRUSTED = ("confirmedFieldsJson",)
EXCLUDED = ("other", "其他", "无", "none", "unknown", "未知")
GENERIC = ("外堵式", "external_standard_deckle", "integral_structure", "lip_integral_structure")
SURE, LEAST_SURE = 0.9, 0.75
GAIN = {"product_type": 0.2, "effective_width_mm": 0.2, "die_width_mm": 0.16, "plastic_material": 0.18, "application": 0.14, "lip_adjustment_method": 0.08, "deckle_type": 0.08, "thickness_mm": 0.04}
RISKS = DecisionTable(
    ("feature", "value", "evidence", "source", "confidence"), ("flag",),
    (
        ("low_confidence", (("confidence", "below", LEAST_SURE),), {"flag": "low_confidence"}),
        ("excluded_value", (("value", "in", EXCLUDED),), {"flag": "excluded_value"}),
        ("generic_value", (("value", "in", GENERIC),), {"flag": "generic_value"}),
        ("structure_requires_review", (("feature", "in", STRUCTURE), ("source", "not_in", TRUSTED)), {"flag": "structure_requires_review"}),
        ("low_information_evidence", (("evidence", "below", 2),), {"flag": "low_information_evidence"}),
    ),
    {"flag": None},
)
FEATURE = DecisionTable(
    ("flags", "count", "feature", "source", "confidence"), ("decision",),
    (
        ("refused", (("flags", "matches", "excluded_value|low_confidence"),), {"decision": "reject"}),
        ("sure", (("count", "at_most", 0), ("confidence", "at_least", SURE), ("feature", "in", APPLIED), ("source", "in", TRUSTED)), {"decision": "auto_apply"}),
        ("risky", ([("count", "above", 0), ("feature", "in", STRUCTURE)],), {"decision": "hold"}),
    ),
    {"decision": "human_review"},
)


def feature_decision(feature: Column, value: Column, evidence: Column, source: Column, confidence: Column) -> Column:
    """struct(decision, score, gain, flags) of a value proposed for a missing feature. source: the path that it was found at."""
    root = F.regexp_extract(F.coalesce(source, F.lit("")), r"^([^.\[]*)", 1)
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    every = RISKS.every({"feature": feature, "value": low, "evidence": F.length(F.trim(F.coalesce(evidence, F.lit("")))), "source": root, "confidence": confidence})
    flags, count = F.array_join(F.transform(every, lambda x: x["flag"]), ","), F.size(every)
    decision = FEATURE.first({"flags": flags, "count": count, "feature": feature, "source": root, "confidence": confidence})["decision"]
    score = confidence + F.when(root.isin(*TRUSTED), 0.08).otherwise(0.0) - F.when(feature.isin(*STRUCTURE), 0.08).otherwise(0.0) - count * 0.12
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 10000 + 0.5) / 10000
    gain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GAIN.items() for x in kv]), feature), F.lit(0.02))
    return F.struct(decision.alias("decision"), score.alias("score"), gain.alias("gain"), flags.alias("flags"))


#: Where a feature's value is taken from, and how sure it is then.
SOURCES = (("confirmed", 0.9), ("hint", 0.8), ("name_application", 0.78), ("name_width", 0.76), ("fields", 0.75), ("name_structure", 0.72), ("archive", 0.7))


def backfill(feature: Column, found: dict[str, Column], sources: tuple[tuple[str, float], ...] = SOURCES) -> Column:
    """struct(source, value, confidence) of the first source that has a value that isn't blank and may give this feature; null if none does."""
    only = {"hint": ("product_type",), "name_width": ("effective_width_mm",), "name_application": ("application",), "name_structure": STRUCTURE}
    e = F.lit(None).cast("struct<source:string,value:string,confidence:double>")
    for name, sure in reversed([s for s in sources if s[0] in found]):
        value = found[name].cast("string")
        fits = F.coalesce(F.trim(value) != "", F.lit(False)) & (feature.isin(*only[name]) if name in only else F.lit(True))
        e = F.when(fits, F.struct(F.lit(name).alias("source"), value.alias("value"), F.lit(sure).alias("confidence"))).otherwise(e)
    return e
