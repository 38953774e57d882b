"""Queries of the rule ladders and of the longest alias, over inputs made of the tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.aliases import resolve
from quarry.operators import rules
from quarry.queries.registry import Registry
from quarry.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.query(
    "route_ladder",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_discount AS d, l_tax AS t, CASE WHEN l_returnflag = 'R' THEN 'term_type' ELSE 'value' END AS kind,
                      CASE l_partkey % 4 WHEN 0 THEN 'plastic_material' WHEN 1 THEN 'application' ELSE 'width' END AS term_type,
                      CASE WHEN l_discount >= 0.08 THEN CASE l_partkey % 5 WHEN 0 THEN 'extraction_error' WHEN 1 THEN 'non_config_noise' WHEN 2 THEN 'qualifier_variant' WHEN 3 THEN 'wrong_scope' ELSE 'value_as_type' END END AS issue,
                      CASE l_suppkey % 5 WHEN 0 THEN 'exact_alias' WHEN 1 THEN 'synonym_alias' WHEN 2 THEN 'split_component' WHEN 3 THEN 'exact_alias' END AS target, 0.5e0 + l_quantity / 100.0e0 AS score FROM lineitem),
            i AS (SELECT *, coalesce(issue, target, 'different_concept') AS relation,
                         CASE WHEN issue IS NOT NULL THEN 'act_' || issue WHEN target = 'split_component' THEN 'split_value' WHEN target IS NOT NULL THEN CASE kind WHEN 'term_type' THEN 'map_to_existing_termtype' ELSE 'add_alias' END
                              WHEN kind = 'term_type' THEN 'create_new_termtype_candidate' WHEN l_partkey % 2 = 0 THEN 'create_new_enum_value_candidate' ELSE 'send_to_review' END AS action,
                         CASE WHEN t >= 0.07 OR issue = 'wrong_scope' THEN 'high' WHEN issue IN ('qualifier_variant', 'value_as_type') THEN 'medium' ELSE 'low' END AS risk, issue IS NULL AS clean, l_partkey % 3 = 0 AS blocked, l_suppkey % 2 = 0 AS llm FROM c),
            r AS (SELECT *, CASE WHEN relation IN ('extraction_error', 'non_config_noise') THEN 'noise' WHEN kind = 'value' AND term_type <> 'width' AND risk = 'low' THEN 'low_risk_value'
                         WHEN q < 2 AND target IS DISTINCT FROM 'exact_alias' AND clean THEN 'rare' WHEN relation = 'split_component' THEN 'part_of_a_value'
                         WHEN kind = 'value' AND relation = 'exact_alias' AND action = 'add_alias' AND risk = 'low' AND NOT blocked THEN 'exact_value'
                         WHEN kind = 'term_type' AND relation = 'exact_alias' AND action = 'map_to_existing_termtype' AND clean AND score >= 0.92 AND NOT blocked THEN 'exact_type'
                         WHEN kind = 'term_type' AND score >= 0.92 THEN 'sure_type' WHEN score >= 0.92 AND blocked THEN 'sure_but_blocked'
                         WHEN kind = 'value' AND relation IN ('exact_alias', 'synonym_alias') AND action = 'add_alias' AND score >= 0.92 THEN 'sure_value'
                         WHEN score >= 0.55 AND clean AND llm THEN 'middle_with_model' WHEN score >= 0.55 AND clean THEN 'middle' ELSE 'default' END AS rule FROM i)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rule, CASE rule WHEN 'noise' THEN 'auto_reject_pending' WHEN 'low_risk_value' THEN 'auto_pass' WHEN 'rare' THEN 'defer_until_more_occurrences' WHEN 'exact_value' THEN 'auto_accept_pending'
              WHEN 'exact_type' THEN 'auto_pass' WHEN 'sure_value' THEN 'auto_accept_pending' WHEN 'middle_with_model' THEN 'llm_review' ELSE 'human_review' END AS route,
              CASE rule WHEN 'rare' THEN 'defer_until_more_occurrences' WHEN 'part_of_a_value' THEN 'split_value' ELSE action END AS action, relation, risk, CASE WHEN issue IS NOT NULL THEN 0.8e0 ELSE score END AS score FROM r""",
)
def route_ladder(spark, sf_dir):
    """A candidate for each order line, whose issues, target, risk and score follow from the line's numbers."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda key, n, *names: F.element_at(F.array(*[F.lit(x) for x in names]), (key % n + 1).cast("int"))
    issue = pick(part, 5, "extraction_error", "non_config_noise", "qualifier_variant", "wrong_scope", "value_as_type")
    risk = F.when(issue == "wrong_scope", "high").when(issue.isin("qualifier_variant", "value_as_type"), "medium").otherwise("low")
    one = F.array(F.struct(issue.alias("relation"), F.concat(F.lit("act_"), issue).alias("action"), F.lit(0.8).alias("confidence"), risk.alias("risk")))
    issues = F.when(F.col("l_discount") >= 0.08, one).otherwise(F.slice(one, 1, 0))
    target = pick(supp, 5, "exact_alias", "synonym_alias", "split_component", "exact_alias", None)
    given = {
        "kind": F.when(F.col("l_returnflag") == "R", "term_type").otherwise("value"), "term_type": pick(part, 4, "plastic_material", "application", "width", "width"), "occurrences": F.col("l_quantity"),
        "alias_exact": target == "exact_alias", "value_kind": F.when(part % 2 == 0, "enum"), "blocked": part % 3 == 0, "llm": supp % 2 == 0,
    }
    out = rules.routed(issues, target, F.lit(0.5), F.col("l_tax") >= 0.07, 0.5 + F.col("l_quantity") / 100.0, given)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", out.alias("o")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o.*")


@R.query(
    "triage_ladder",
    """WITH v AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'plastic_material' WHEN 1 THEN 'application' ELSE 'color' END AS term_type,
                      CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '2024-1-' || p_size WHEN 3 THEN '合同 ' || p_name WHEN 4 THEN '备注:' || p_name WHEN 5 THEN p_name || '、' || p_type WHEN 6 THEN 'PVC ' || p_name WHEN 7 THEN p_size || ' kg/h'
                                          WHEN 8 THEN p_name || ' film' WHEN 9 THEN repeat(p_name || ' ', 12) ELSE p_name END AS value FROM part),
            a AS (SELECT *, trim(value) AS x, CASE WHEN p_partkey % 7 = 0 THEN 'left' END AS q, p_partkey % 14 = 0 AS hit FROM v),
            l AS (SELECT *, CASE WHEN x IN ('', 'N/A') THEN 'noise' WHEN regexp_matches(x, '^[0-9]{4}-') OR contains(x, '合同') OR contains(x, '备注') OR length(x) > 80 THEN 'document_note' END AS note,
                         contains(x, '、') OR contains(x, '/') AS composite, CASE WHEN term_type = 'plastic_material' AND contains(x, 'PVC') THEN 'pvc' END AS family, CASE WHEN term_type = 'application' AND contains(x, 'film') THEN 'film' END AS domain FROM a)
       SELECT p_partkey, concat_ws(',', note, CASE WHEN q IS NOT NULL THEN 'qualifier_variant' END, CASE WHEN q IS NOT NULL THEN CASE WHEN hit THEN 'qualifier_rematch_found' ELSE 'qualifier_rematch_miss' END END,
              CASE WHEN composite THEN 'composite_multi_value' END, CASE WHEN family IS NOT NULL THEN 'material_classified' END, CASE WHEN domain IS NOT NULL THEN 'application_classified' END) AS labels, family, domain,
              CASE WHEN note = 'noise' THEN 'reject_as_noise' WHEN note = 'document_note' THEN 'reject_or_doc_note' WHEN q IS NOT NULL AND hit THEN 'review_as_existing_value_variant' WHEN composite THEN 'review_composite' WHEN family IS NOT NULL THEN 'review_material_class'
                   WHEN domain IS NOT NULL THEN 'review_application_class' ELSE 'normal_review' END AS action,
              CASE WHEN note = 'noise' THEN 0.9e0 WHEN note = 'document_note' THEN 0.84e0 WHEN q IS NOT NULL AND hit THEN 0.86e0 WHEN composite THEN 0.8e0 WHEN family IS NOT NULL OR domain IS NOT NULL THEN 0.74e0 WHEN q IS NOT NULL THEN 0.68e0 ELSE 0.5e0 END AS confidence FROM l""",
)
def triage_ladder(spark, sf_dir):
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    shapes = [
        F.lit(""), F.lit("N/A"), F.concat(F.lit("2024-1-"), size), F.concat(F.lit("合同 "), name), F.concat(F.lit("备注:"), name), F.concat(name, F.lit("、"), "p_type"), F.concat(F.lit("PVC "), name), F.concat(size, F.lit(" kg/h")),
        F.concat(name, F.lit(" film")), F.repeat(F.concat(name, F.lit(" ")), F.lit(12)), name,
    ]
    kind = F.element_at(F.array(F.lit("plastic_material"), F.lit("application"), F.lit("color")), (key % 3 + 1).cast("int"))
    out = rules.triaged(kind, F.element_at(F.array(*shapes), (key % 11 + 1).cast("int")), F.when(key % 7 == 0, "left"), key % 14 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("o")).select("p_partkey", "o.labels", "o.family", "o.domain", "o.action", "o.confidence")


@R.query(
    "die_configuration",
    """WITH v AS (SELECT p_partkey, p_size / 10.0e0 AS lo, p_size / 10.0e0 + (p_partkey % 3) AS hi, CASE p_partkey % 6 WHEN 0 THEN '片材模头' WHEN 1 THEN '板材模头' WHEN 2 THEN '薄膜模头' WHEN 3 THEN '涂布模头' WHEN 4 THEN '圆模头' ELSE p_name END AS name,
                      CASE p_partkey % 5 WHEN 0 THEN 'flat_die' WHEN 1 THEN 'coating_die' ELSE '' END AS kind, p_partkey % 4 AS r, p_partkey % 2 = 0 AS hot FROM part),
            d AS (SELECT *, CASE WHEN kind = 'coating_die' OR name = '涂布模头' THEN 'coating_die' WHEN name = '圆模头' THEN 'round_die' WHEN kind = 'flat_die' OR (kind = '' AND contains(name, '模头')) THEN 'flat_die' ELSE 'unknown' END AS die FROM v),
            f AS (SELECT *, CASE WHEN name = '板材模头' THEN 'board' WHEN name = '片材模头' THEN 'sheet' WHEN name = '薄膜模头' OR die = 'round_die' THEN 'film' WHEN die = 'flat_die' THEN 'board_sheet' ELSE 'unknown' END AS form, r IN (1, 2) AS restrictor,
                         CASE WHEN r <> 3 THEN hi END AS thick FROM d)
       SELECT p_partkey, die, form, CASE WHEN r <> 3 THEN lo END AS thin, thick, restrictor,
              CASE WHEN NOT hot OR die = 'unknown' THEN '' WHEN restrictor THEN 'thermoforming_board_with_restrictor' WHEN thick > 2.5 THEN 'thermoforming_board_structure_expected' WHEN thick IS NOT NULL THEN 'thermoforming_sheet_standard' ELSE 'thermoforming_unresolved' END AS family,
              CASE WHEN NOT hot OR die = 'unknown' THEN '' WHEN (restrictor OR thick > 2.5) AND form = 'sheet' THEN 'name_sheet_structure_board' WHEN restrictor THEN '' WHEN thick > 2.5 THEN 'board_thickness_missing_restrictor_evidence'
                   WHEN thick IS NOT NULL AND form = 'board' THEN 'name_board_structure_sheet' ELSE '' END AS conflict FROM f""",
)
def die_configuration(spark, sf_dir):
    """Documents of rows with a thickness, a marked or written restrictor, and a use, for each part."""
    key = F.col("p_partkey")
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]), (key % n + 1).cast("int"))
    low = F.col("p_size") / 10.0
    span = F.concat(F.lit("Row 2: 制品厚度范围[B2] "), low.cast("string"), F.lit("～"), (low + key % 3).cast("string"), F.lit(" mm"))
    restrictor = pick(4, "\nRow 3: 阻流棒 [SEL] 无", "\nRow 3: 阻流棒 [SEL] 有", "\nRow 3: 配置阻流棒", "")
    text = F.concat(F.when(key % 2 == 0, "Row 1: 用于吸塑\n").otherwise("Row 1: x\n"), F.when(key % 4 != 3, span).otherwise("Row 2: -"), restrictor)
    name = pick(6, "片材模头", "板材模头", "薄膜模头", "涂布模头", "圆模头", F.col("p_name"))
    out = rules.die_configuration(text, name, pick(5, "flat_die", "coating_die", "", "", ""))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("o")).select("p_partkey", *[f"o.{c}" for c in ("die", "form", "thin", "thick", "restrictor", "family", "conflict")])


@R.query(
    "family_use_ladder",
    """WITH v AS (SELECT p_type AS name, CASE min(p_partkey) % 7 WHEN 0 THEN '成本分析' WHEN 1 THEN '采购及时率' WHEN 2 THEN '库存查询' WHEN 3 THEN '发货看板' WHEN 4 THEN 'BOM list' WHEN 5 THEN '工资表' ELSE p_type END AS said,
                      count(*) % 2 AS risks, min(p_size) AS joins, count(DISTINCT p_brand) % 3 AS variants, CASE WHEN min(p_partkey) % 4 = 0 THEN 'finance' WHEN min(p_partkey) % 4 = 1 THEN 'sales' ELSE 'unknown' END AS module FROM part GROUP BY p_type),
            u AS (SELECT *, CASE WHEN said IN ('成本分析', '工资表') THEN 'permission_sensitive' WHEN said = '采购及时率' THEN 'business_metric_catalog' WHEN said = '库存查询' AND risks = 0 AND joins > 0 THEN 'template_candidate'
                                 WHEN said = '发货看板' OR variants > 1 THEN 'reference_then_template' ELSE 'reference_retrieval' END AS use FROM v)
       SELECT name, use, CASE WHEN said IN ('采购及时率', '库存查询', 'BOM list') THEN 'high' WHEN module <> 'unknown' OR said IN ('成本分析', '发货看板') THEN 'medium' ELSE 'low' END AS priority,
              CASE WHEN said = '成本分析' OR module = 'finance' THEN 'finance' WHEN said = '采购及时率' THEN 'purchase' WHEN said = '发货看板' OR module = 'sales' THEN 'sales' WHEN said = 'BOM list' THEN 'production' WHEN said = '库存查询' THEN 'inventory' ELSE 'general' END AS domain,
              CASE WHEN use = 'permission_sensitive' THEN 'high' ELSE 'low' END AS sensitivity FROM u""",
)
def family_use_ladder(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("k"), (F.count("*") % 2).alias("risks"), F.min("p_size").alias("joins"), (F.count_distinct("p_brand") % 3).alias("variants"))
    said = F.element_at(F.array(*map(F.lit, ("成本分析", "采购及时率", "库存查询", "发货看板", "BOM list", "工资表")), F.col("name")), (F.col("k") % 7 + 1).cast("int"))
    module = F.element_at(F.array(*map(F.lit, ("finance", "sales", "unknown", "unknown"))), (F.col("k") % 4 + 1).cast("int"))
    return part.select("name", rules.family_use(said, module, F.col("risks"), F.col("joins"), F.col("variants")).alias("o")).select("name", "o.*")


@R.query(
    "feature_decision_ladder",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.7e0 + l_discount * 3 AS confidence, CASE l_partkey % 6 WHEN 0 THEN 'product_type' WHEN 1 THEN 'deckle_type' WHEN 2 THEN 'thickness_mm' WHEN 3 THEN 'application' WHEN 4 THEN 'lip_adjustment_method' ELSE 'other_key' END AS feature,
                      CASE l_suppkey % 8 WHEN 0 THEN 'None' WHEN 1 THEN '外堵式' ELSE 'v' || l_linenumber END AS value, CASE WHEN l_suppkey % 9 = 0 THEN 'x' ELSE 'seen' END AS evidence, l_returnflag = 'N' AS trusted FROM lineitem),
            f AS (SELECT *, feature IN ('deckle_type', 'lip_adjustment_method') AS structure, concat_ws(',', CASE WHEN confidence < 0.75 THEN 'low_confidence' END, CASE WHEN value = 'None' THEN 'excluded_value' END, CASE WHEN value = '外堵式' THEN 'generic_value' END,
                         CASE WHEN feature IN ('deckle_type', 'lip_adjustment_method') AND NOT trusted THEN 'structure_requires_review' END, CASE WHEN evidence = 'x' THEN 'low_information_evidence' END) AS flags FROM v),
            n AS (SELECT *, CASE WHEN flags = '' THEN 0 ELSE len(string_split(flags, ',')) END AS n FROM f)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN contains(flags, 'excluded_value') OR contains(flags, 'low_confidence') THEN 'reject' WHEN n = 0 AND confidence >= 0.9 AND feature IN ('product_type', 'application') AND trusted THEN 'auto_apply'
              WHEN n > 0 OR structure THEN 'hold' ELSE 'human_review' END AS decision,
              floor(greatest(0.0e0, least(1.0e0, confidence + CASE WHEN trusted THEN 0.08e0 ELSE 0.0e0 END - CASE WHEN structure THEN 0.08e0 ELSE 0.0e0 END - n * 0.12e0)) * 10000 + 0.5) / 10000 AS score,
              CASE feature WHEN 'product_type' THEN 0.2e0 WHEN 'application' THEN 0.14e0 WHEN 'thickness_mm' THEN 0.04e0 WHEN 'other_key' THEN 0.02e0 ELSE 0.08e0 END AS gain, flags FROM n""",
)
def feature_decision_ladder(spark, sf_dir):
    pick = lambda c, n, *x: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in x]), (F.col(c) % n + 1).cast("int"))
    own = F.concat(F.lit("v"), F.col("l_linenumber").cast("string"))
    feature = pick("l_partkey", 6, "product_type", "deckle_type", "thickness_mm", "application", "lip_adjustment_method", "other_key")
    value = pick("l_suppkey", 8, "None", "外堵式", own, own, own, own, own, own)
    source = F.when(F.col("l_returnflag") == "N", "confirmedFieldsJson.x").otherwise("fieldsJson[0]")
    out = rules.feature_decision(feature, value, F.when(F.col("l_suppkey") % 9 == 0, "x").otherwise("seen"), source, 0.7 + F.col("l_discount") * 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", out.alias("o")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o.*")


@R.query(
    "backfill_ladder",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'product_type' WHEN 1 THEN 'effective_width_mm' ELSE 'deckle_type' END AS feature,
              CASE WHEN p_size % 5 = 0 THEN 'confirmed' WHEN p_partkey % 3 = 0 AND p_size % 5 = 1 THEN 'hint' WHEN p_partkey % 3 = 1 AND p_size >= 10 THEN 'name_width' WHEN p_size % 2 = 0 THEN 'fields' WHEN p_partkey % 3 = 2 AND p_size % 3 = 0 THEN 'name_structure' WHEN p_size < 40 THEN 'archive' END AS source,
              CASE WHEN p_size % 5 = 0 THEN 0.9e0 WHEN p_partkey % 3 = 0 AND p_size % 5 = 1 THEN 0.8e0 WHEN p_partkey % 3 = 1 AND p_size >= 10 THEN 0.76e0 WHEN p_size % 2 = 0 THEN 0.75e0 WHEN p_partkey % 3 = 2 AND p_size % 3 = 0 THEN 0.72e0 WHEN p_size < 40 THEN 0.7e0 END AS confidence FROM part""",
)
def backfill_ladder(spark, sf_dir):
    n = F.col("p_size")
    feature = F.element_at(F.array(*map(F.lit, ("product_type", "effective_width_mm", "deckle_type"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    found = {
        "confirmed": F.when(n % 5 == 0, F.col("p_brand")).otherwise("  "), "hint": F.when(n % 5 == 1, F.col("p_type")), "name_width": tx.width(F.concat(F.lit("die "), n * 10, F.lit("mm"))), "fields": F.when(n % 2 == 0, F.col("p_name")),
        "name_structure": F.when(n % 3 == 0, F.lit("x")), "archive": F.when(n < 40, F.col("p_name")),
    }
    return table(spark, sf_dir, "part").select("p_partkey", feature.alias("feature"), rules.backfill(feature, found).alias("o")).select("p_partkey", "feature", "o.source", "o.confidence")


#: Product types told by a pattern, and aliases that mean nothing within a longer name.
TYPE_RULES = ((r"(?i)GD[\s_-]*E[0-9]+", "metering_pump"), ("换网器|过滤器", "filter"))
GENERIC = frozenset({"模头", "模具", "设备", "系统", "装置"})


@R.query(
    "longest_alias_resolver",
    r"""WITH cat AS (SELECT lower(p_name) AS canonical, p_name AS alias, min(p_partkey) AS place FROM part GROUP BY 1, 2 UNION ALL SELECT lower(p_type), p_type, 1000000000 + min(p_partkey) FROM part GROUP BY 1, 2
                    UNION ALL SELECT lower(split_part(p_name, ' ', 1)), split_part(p_name, ' ', 1), 2000000000 + min(p_partkey) FROM part GROUP BY 1, 2 UNION ALL VALUES ('metering_pump', '计量泵', 3000000000), ('flat_die', '平模头', 3000000001)),
             n AS (SELECT *, regexp_replace(lower(trim(alias)), '[\s：:，,、;；/\\_\-]+', '', 'g') AS a FROM cat),
             t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || upper(p_name) || ' ' WHEN 1 THEN 'GD-E' || p_size WHEN 2 THEN 'set: ' || p_name || ' / ' || p_type WHEN 3 THEN 'old ' || p_name || ' no. ' || p_size WHEN 4 THEN 'no 模头 ' || p_size ELSE '' END AS said FROM part),
             m AS (SELECT *, regexp_replace(lower(trim(said)), '[\s：:，,、;；/\\_\-]+', '', 'g') AS x FROM t),
             e AS (SELECT p_partkey, canonical, alias, 'exact' AS method, 1 AS rung, 0 AS size, place FROM m JOIN n ON x = a WHERE x <> '' UNION ALL SELECT p_partkey, 'metering_pump', '(?i)GD[\s_-]*E[0-9]+', 'specific_rule', 2, 0, 0 FROM m WHERE p_partkey % 6 = 1
                   UNION ALL SELECT p_partkey, canonical, alias, 'contained_alias', 3, -length(a), place FROM m JOIN n ON contains(x, a) UNION ALL SELECT p_partkey, 'flat_die', '模头', 'generic_fallback', 4, 0, 0 FROM m WHERE contains(said, '模头'))
        SELECT m.p_partkey, canonical, alias AS matched, method FROM m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY rung, size, place) AS r FROM e) b ON b.p_partkey = m.p_partkey AND r = 1""",
)
def longest_alias_resolver(spark, sf_dir):
    """Names resolved against all part names, their first words and all types, by an automaton."""
    p = table(spark, sf_dir, "part")
    listed = lambda c, add: p.groupBy(F.lower(c).alias("canonical"), c.alias("alias")).agg((F.min("p_partkey") + F.lit(add)).alias("place"))
    more = spark.createDataFrame([("metering_pump", "计量泵", 3_000_000_000), ("flat_die", "平模头", 3_000_000_001)], "canonical string, alias string, place long")
    catalogue = listed(F.col("p_name"), 0).unionByName(listed(F.col("p_type"), 1_000_000_000)).unionByName(listed(F.split_part("p_name", F.lit(" "), F.lit(1)), 2_000_000_000)).unionByName(more)
    catalogue = catalogue.select("canonical", F.col("alias").alias("display"), "alias", tx.alias(F.col("alias")).alias("normalised"), "place")
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    shapes = [
        F.concat(F.lit(" "), F.upper(name), F.lit(" ")), F.concat(F.lit("GD-E"), size), F.concat(F.lit("set: "), name, F.lit(" / "), "p_type"), F.concat(F.lit("old "), name, F.lit(" no. "), size), F.concat(F.lit("no 模头 "), size), F.lit(""),
    ]
    said = p.select("p_partkey", F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int")).alias("said"))
    return resolve(said, F.col("said"), tx.alias(F.col("said")), catalogue, TYPE_RULES, GENERIC, ("模头|模具", "flat_die", "模头")).select("p_partkey", "canonical", "matched", "method")
