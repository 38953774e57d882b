"""Records, ledgers, candidates, query texts and evaluation of ranked answers, over whole tables in several shapes of input."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quarry.functions import sqltext
from quarry.functions import text as tx
from quarry.operators import evaluation, records, states
from quarry.queries.documents import units
from quarry.queries.registry import Registry
from quarry.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def shape(key: str, *shapes: Column | str | None) -> Column:
    """One of the shapes by the key's remainder."""
    return F.element_at(F.array(*[F.lit(s) if not isinstance(s, Column) else s for s in shapes]), (F.col(key) % len(shapes) + 1).cast("int"))


# Fields of items


@R.query(
    "record_redirect",
    """WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS item, l_returnflag AS kind, l_partkey AS seq, CASE l_partkey % 5 WHEN 0 THEN 'Die width' WHEN 1 THEN 'oil pressure' ELSE 'speed' END AS name, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS value FROM lineitem),
         h AS (SELECT doc, kind, min(item) AS home FROM f GROUP BY 1, 2),
         w AS (SELECT *, CASE WHEN name = 'Die width' AND kind <> 'A' THEN 'A' WHEN name = 'oil pressure' AND kind <> 'R' THEN 'R' END AS wanted FROM f)
       SELECT w.doc, coalesce(home, item) AS item, CASE WHEN home IS NULL THEN w.kind ELSE wanted END AS kind, seq, name, value, CASE WHEN home IS NOT NULL THEN item END AS moved_from FROM w LEFT JOIN h ON h.doc = w.doc AND h.kind = wanted""",
)
def record_redirect(spark, sf_dir):
    name = F.when(F.col("l_partkey") % 5 == 0, "Die width").when(F.col("l_partkey") % 5 == 1, "oil pressure").otherwise("speed")
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("item"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("seq"), name.alias("name"), F.col("l_quantity").cast("int").cast("string").alias("value"))
    return records.redirected(fields, [("die", "A"), ("oil", "R")])


#: Documents of two items with ten fields each, in four shapes: three numbered models, numbers without a model for each, two plain models, and no numbers.
_NAMES = [
    ["model 1", "model 2", "model 3", "speed 1", "speed#2", "colour", "Model", "Model", "width 3", "note"],
    ["type 1", "type 2", "type 3", "speed 1", "speed#2", "colour", "Model", "Model", "width 3", "note"],
    ["type 1", "type 2", "feed", "speed 1", "speed#2", "colour", "Model", "Model", "width", "note"],
    ["type", "form", "feed", "speed", "note", "colour", "Model", "Model", "width", "note"],
]
_FIELDS_SQL = f"""f AS (SELECT p_partkey // 20 AS doc, CAST(1 + (p_partkey // 10) % 2 AS INTEGER) AS item, p_type AS kind, p_partkey AS seq, ({_NAMES})[(p_partkey // 20) % 4 + 1][p_partkey % 10 + 1] AS name, CAST(p_size AS VARCHAR) AS value FROM part),
    x AS (SELECT *, CAST(nullif(regexp_extract(name, '^(.*?)[ #]*([1-9])$', 2), '') AS INTEGER) AS n, CASE WHEN regexp_matches(name, '[1-9]$') THEN regexp_extract(name, '^(.*?)[ #]*([1-9])$', 1) ELSE name END AS base FROM f)"""


def _fields(spark, sf_dir):
    at = F.col("p_partkey")
    doc, item, place = F.floor(at / 20), (1 + F.floor(at / 10) % 2).cast("int"), (at % 10 + 1).cast("int")
    names = F.array(*[F.array(*[F.lit(n) for n in row]) for row in _NAMES])
    name = F.element_at(F.element_at(names, (doc % 4 + 1).cast("int")), place)
    return table(spark, sf_dir, "part").select(doc.alias("doc"), item.alias("item"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("seq"), name.alias("name"), F.col("p_size").cast("string").alias("value"))


@R.query(
    "record_split",
    f"""WITH {_FIELDS_SQL},
      s AS (SELECT *, CASE doc % 4 WHEN 0 THEN 3 WHEN 2 THEN 2 END AS instances, CASE WHEN name = 'Model' THEN row_number() OVER (PARTITION BY doc, item, name ORDER BY seq) END AS own FROM x),
      e AS (SELECT *, unnest(range(1, coalesce(instances, 1) + 1)) AS i FROM s)
    SELECT doc, CAST(CASE WHEN instances IS NULL OR i = 1 THEN item ELSE 2 + (item - 1) * (instances - 1) + i - 1 END AS INTEGER) AS item, kind, seq, CASE WHEN instances IS NULL THEN name ELSE base END AS name, value, CASE WHEN instances IS NOT NULL THEN item END AS split_from
    FROM e WHERE instances IS NULL OR (CASE WHEN n IS NOT NULL THEN n = i WHEN instances = 2 AND own IS NOT NULL THEN own = i ELSE true END)""",
)
def record_split(spark, sf_dir):
    return records.split_instances(_fields(spark, sf_dir)).withColumn("item", F.col("item").cast("int"))


@R.query(
    "record_merge",
    f"""WITH {_FIELDS_SQL}, g AS (SELECT doc, item, base, max(n) AS top, count(*) AS k, list({{'n': n, 'v': value}} ORDER BY seq) AS l FROM x GROUP BY 1, 2, 3)
    SELECT doc, item, base AS name, CASE WHEN top IS NOT NULL THEN 'indexed' WHEN k > 1 THEN 'list' ELSE 'scalar' END AS shape,
      CASE WHEN top IS NOT NULL THEN array_to_string(list_transform(range(1, top + 1), lambda i: coalesce(list_filter(l, lambda s: s.n = i)[-1].v, '-')), '|') ELSE array_to_string(list_transform(l, lambda s: s.v), '|') END AS value FROM g""",
)
def record_merge(spark, sf_dir):
    return records.merged(_fields(spark, sf_dir)).select("doc", "item", "name", "shape", F.array_join("values", "|", "-").alias("value"))


COMPOSITES = [
    (r"supply|power", r"^([0-9]+)\s*V\s*/\s*([0-9]+)\s*Hz\s*(?:/\s*([0-9])\s*P)?$", ("voltage", "frequency", "phases")),
    (r"holes", r"^([0-9]+)\s*[x×*]\s*(M[0-9]+)$", ("hole count", "hole size")),
    (r"finish", r"^(\w+)\s+(\w+)\s+(\w+)$", ("class", "coat", "metal")),
]


@R.query(
    "record_composite",
    """WITH p AS (SELECT p_partkey, p_type, p_size AS n, p_partkey % 5 AS r FROM part)
       SELECT p_partkey, 'voltage' AS name, n || '0' AS value FROM p WHERE r IN (0, 1) UNION ALL SELECT p_partkey, 'frequency', '50' FROM p WHERE r IN (0, 1) UNION ALL SELECT p_partkey, 'phases', '3' FROM p WHERE r = 0
       UNION ALL SELECT p_partkey, 'hole count', CAST(n AS VARCHAR) FROM p WHERE r = 2 UNION ALL SELECT p_partkey, 'hole size', 'M8' FROM p WHERE r = 2
       UNION ALL SELECT p_partkey, unnest(['class', 'coat', 'metal']), unnest(string_split(p_type, ' ')) FROM p WHERE r = 3 AND len(string_split(p_type, ' ')) = 3""",
)
def record_composite(spark, sf_dir):
    n = F.col("p_size").cast("string")
    name = shape("p_partkey", "Power supply", "power", "Holes", "finish", "speed")
    value = shape("p_partkey", F.concat(n, F.lit("0V/50Hz/3P")), F.concat(n, F.lit("0 V / 50 Hz")), F.concat(n, F.lit("×M8")), F.col("p_type"), F.concat(n, F.lit("0V/50Hz")))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(records.composite(name, value, COMPOSITES)))


@R.query(
    "record_confirm",
    """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'dictionary' ELSE 'unconfirmed' END WHEN 1 THEN 'unit' WHEN 2 THEN 'range' WHEN 3 THEN 'number' WHEN 4 THEN 'boolean' WHEN 5 THEN 'date' WHEN 6 THEN 'text' ELSE 'unconfirmed' END AS status FROM part""",
)
def record_confirm(spark, sf_dir):
    n = F.col("p_size").cast("string")
    kind = shape("p_partkey", "enum", "measure", "measure", "number", "boolean", "date", "text", "date", "number")
    value = shape("p_partkey", F.col("p_brand"), F.concat(n, F.lit(" mm")), F.concat(n, F.lit("-"), F.col("p_size") + 9, F.lit(" bar")), n, F.lit("需要"), F.lit("2024/3/7"), F.lit("as said"), F.lit("2024-13-40"), F.lit("many"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", kind.alias("kind"), value.alias("value")).withColumn("m", tx.measure(F.col("value"), units()))
    known = F.when((F.col("kind") == "enum") & F.col("value").isin("Brand#11", "Brand#12"), F.col("value"))
    status = records.confirmation(F.col("kind"), known, F.col("m.unit"), F.col("m.low"), F.col("m.high"), F.col("m.value"), tx.boolean(F.col("value")), tx.mixed_date(F.col("value")), F.col("value"), F.lit(True))
    return rows.select("p_partkey", status.alias("status"))


# States and candidates


@R.query(
    "progress_ledger",
    """WITH o AS (SELECT o_custkey, min(o_orderkey) AS extraction_id, min(o_orderkey) FILTER (o_orderstatus = 'F') AS normalized_id, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) AS items, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1),
    s AS (SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 AND c_custkey % 2 = 0 THEN 'duplicate_reference' WHEN c_acctbal <= -500 THEN 'pending_blocks' WHEN extraction_id IS NULL THEN 'pending_extraction'
      WHEN c_custkey % 23 = 0 THEN 'needs_reextract' WHEN normalized_id IS NULL AND c_custkey % 3 = 0 THEN 'planned' WHEN normalized_id IS NULL THEN 'needs_reextract' WHEN c_nationkey = 3 THEN 'needs_reextract' WHEN items = 0 THEN 'normalized_empty'
      WHEN c_nationkey % 5 = 0 THEN 'normalized_blocked' WHEN c_mktsegment = 'MACHINERY' THEN 'normalized_partial' WHEN c_nationkey % 2 = 0 AND c_acctbal > 5000 AND c_custkey % 7 <> 0 THEN 'archived'
      WHEN c_nationkey % 5 = 1 OR pending > 0 OR c_custkey % 29 = 0 THEN 'normalized_partial' ELSE 'normalized_full' END AS state FROM customer LEFT JOIN o ON o_custkey = c_custkey)
    SELECT c_custkey, state, CASE state WHEN 'pending_blocks' THEN 'uploaded' WHEN 'pending_extraction' THEN 'blocks_ready' WHEN 'planned' THEN 'planned' WHEN 'needs_reextract' THEN 'raw_extracted' WHEN 'duplicate_reference' THEN 'duplicate' WHEN 'archived' THEN 'archived' ELSE 'normalized' END AS stage FROM s""",
)
def progress_ledger(spark, sf_dir):
    status = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderkey").alias("extraction_id"), F.min(F.when(status == "F", F.col("o_orderkey"))).alias("normalized_id"), F.count_if((status == "F") & (F.col("o_totalprice") > 100000)).alias("items"), F.count_if(status == "P").alias("pending")
    )
    key, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
    ledger = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select(
        "c_custkey", F.when(key % 19 == 0, 2).otherwise(0).alias("duplicates"), F.when(key % 2 == 0, key).alias("canonical_id"), (balance > -500).alias("has_blocks"), "extraction_id",
        F.when(key % 23 == 0, "needs_reextract:schema").when(key % 6 == 3, "planned").otherwise("done").alias("extraction_status"), F.when(key % 6 == 0, True).alias("has_plan"), "normalized_id", (nation == 3).alias("stale"), "items",
        F.when(nation % 5 == 0, "blocked").when(nation % 5 == 1, "partial_insert").otherwise("insert").alias("insert_mode"), (F.col("c_mktsegment") == "MACHINERY").alias("dictionary_dirty"),
        (nation % 2 == 0).alias("archive_linked"), F.when(balance > 5000, "archived").alias("archive_status"), F.when(key % 7 == 0, "changed").alias("archive_dirty"), "pending", F.when(key % 29 == 0, 1).otherwise(0).alias("review"),
    )
    return ledger.select("c_custkey", states.terminal_state().alias("state")).withColumn("stage", states.stage(F.col("state")))


@R.query(
    "candidate_issues",
    """SELECT p_partkey, ['placeholder_value:0.88', 'value_as_type:0.86', 'cross_term_type:0.83', 'scope_contamination:0.82', 'non_config_noise:0.8', 'qualifier_variant:0.78', 'composite_value:0.78', 'multi_item:0.76', '',
      'scope_contamination:0.82,non_config_noise:0.8,qualifier_variant:0.78,composite_value:0.78', 'composite_value:0.78', '', 'composite_value:0.78', CASE WHEN p_size % 2 = 0 THEN 'composite_value:0.78' ELSE '' END][p_partkey % 14 + 1] AS issues FROM part""",
)
def candidate_issues(spark, sf_dir):
    """Each detector's own shape, with the parts' own names and sizes; a unit and measures that are one thing, values joined by a word, and one whose source is a list."""
    c = lambda *x: shape("p_partkey", *x)
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    kind = c("value", "term_type", *["value"] * 12)
    field = c("颜色", F.concat(name, F.lit("色")), "width", F.concat(F.lit("合同号"), size), "备注", "左侧宽度", "material", "部件", "flow", "订单", "material", "length", "flow", "material")
    value = c(
        "未填写", F.col("p_brand"), size, size, name, size, F.concat(name, F.lit("、"), F.col("p_type")), F.concat(size, F.lit("号")), "kg / h", F.concat(F.lit("左侧 "), name, F.lit("/"), size),
        F.concat(name, F.lit("和"), F.col("p_type")), F.concat(size, F.lit("mm;"), size, F.lit("mm")), F.concat(size, F.lit(" kg/h")), name,
    )
    known = F.when(F.col("p_partkey") % 14 == 1, F.array(F.lit("color"))).when(F.col("p_partkey") % 14 == 2, F.array(F.lit("height"), F.lit("width")))
    source = F.when((F.col("p_partkey") % 14 == 13) & (F.col("p_size") % 2 == 0), F.concat(name, F.lit("+"), F.col("p_type")))
    found = states.issues(kind, field, value, F.lit("width"), F.lit("item"), F.lit(False), known, source)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda i: F.concat_ws(":", i["detector"], i["confidence"].cast("string"))), ",").alias("issues"))


# Query texts


@R.query(
    "sql_text_features",
    """WITH p AS (SELECT p_partkey, p_size, p_partkey % 5 AS r FROM part)
    SELECT p_partkey, ['orderhed,customer', 'shipdtl', 'a,b', '', 'dbo.orderhed'][r + 1] AS tables, ['orderhed>customer:company+custnum', '', 'a>b:', '', ''][r + 1] AS joins, [2, 1, 1, 0, 1][r + 1] AS selected,
      ['o.orderdate,o.total', 'qty', '', '', 'needbydate'][r + 1] AS filtered, ['from_day', '', '', '', 'co,since'][r + 1] AS params,
      ['dynamic_parameter', '', 'join_without_shared_key,several_statements', 'non_select_keyword,selected_fields_unparsed', 'dynamic_parameter'][r + 1] AS risks, CAST([100, 100, 65, 0, 100][r + 1] AS INTEGER) AS score, ['low', 'low', 'medium', 'high', 'low'][r + 1] AS risk FROM p""",
)
def sql_text_features(spark, sf_dir):
    """Queries with joins and parameters, plain, with a condition of other names, one that writes, and one with a macro."""
    n = F.col("p_size").cast("string")
    raw = shape(
        "p_partkey",
        F.concat(F.lit("SELECT o.Num, sum(o.Total) AS t FROM OrderHed o LEFT JOIN Customer AS c ON o.Company = c.Company AND o.CustNum = c.CustNum WHERE o.OrderDate >= @from_day AND o.Total > "), n, F.lit(" GROUP BY o.Num ORDER BY t DESC")),
        F.concat(F.lit("select top 5 PackNum from ShipDtl where Qty > "), n, F.lit(" -- from hidden")),
        F.concat(F.lit("SELECT x FROM a JOIN b ON a.k = b.id AND a.v = 'from c'; SELECT "), n),
        F.concat(F.lit("DELETE "), n), F.lit("SELECT [Num] FROM [dbo].[OrderHed] WHERE NeedByDate > @since AND ${co.id} = 1"),
    )
    f = F.col("f")
    known = ("orderhed", "dbo.orderhed", "shipdtl")
    rows = table(spark, sf_dir, "part").select("p_partkey", sqltext.features(raw).alias("f")).withColumns({"risks": sqltext.risks(f), "score": sqltext.quality(f, known)})
    joins = F.transform("f.joins", lambda j: F.concat(j["left"], F.lit(">"), j["right"], F.lit(":"), F.array_join(j["keys"], "+")))
    lists = lambda c: F.array_join(c, ",")
    return rows.select("p_partkey", lists("f.tables").alias("tables"), lists(joins).alias("joins"), F.size("f.selected").alias("selected"), lists("f.filtered").alias("filtered"), lists("f.params").alias("params"), lists("risks").alias("risks"), "score", sqltext.risk_level(F.col("score"), F.col("risks")).alias("risk"))


# Ranked answers

_RANKED_SQL = """s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
    own AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM s), every AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) AS rank FROM t),
    g AS (SELECT doc_id AS query, lang, CASE WHEN n_chars % 7 > 0 THEN source END AS item, n_chars >= 300 AS asked FROM documents)"""
_FIGURES_SQL = """count(*) AS n, count(*) FILTER (asked) AS answered, round(count(*) FILTER (asked AND item IS NOT NULL AND rank = 1) / nullif(count(*) FILTER (asked), 0), 6) AS top1_precision,
    round(count(*) FILTER (item IS NOT NULL AND asked AND rank <= 3) / nullif(count(*) FILTER (item IS NOT NULL), 0), 6) AS top3_recall, round(count(*) FILTER (asked) / count(*), 6) AS coverage,
    round(count(*) FILTER (asked AND NOT coalesce(item IS NOT NULL AND rank = 1, false)) / nullif(count(*) FILTER (asked), 0), 6) AS false_match_rate, round(count(*) FILTER (item IS NULL AND NOT asked) / nullif(count(*) FILTER (item IS NULL), 0), 6) AS abstention_correctness,
    round(sum(CASE WHEN asked AND rank <= 5 THEN 1.0e0 / rank ELSE 0.0e0 END) / nullif(count(*) FILTER (item IS NOT NULL), 0), 6) AS mrr"""


def _ranked(spark, sf_dir):
    """Documents asked for their source, answered by the most frequent ones of their language or of all; short ones are not answered, and some have no right answer."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query"), "lang", "source", "n_chars")
    counts = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("rank <= 5").select("lang", "rank", F.col("source").alias("item"))
    every = counts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "source").limit(5)
    every = every.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source"))).select(F.lit(1).alias("all"), "rank", F.col("source").alias("item"))  # five rows
    asked = docs.where("n_chars >= 300")
    gold = docs.select("query", "lang", F.when(F.col("n_chars") % 7 > 0, F.col("source")).alias("item"))
    return asked.withColumn("all", F.lit(1)).join(every, "all").select("query", "rank", "item"), asked.join(own, "lang").select("query", "rank", "item"), gold


@R.query("retrieval_figures", f"WITH {_RANKED_SQL} SELECT g.lang, {_FIGURES_SQL} FROM g LEFT JOIN own ON own.lang = g.lang AND own.source = g.item AND own.rank <= 5 GROUP BY 1")
def retrieval_figures(spark, sf_dir):
    _, own, gold = _ranked(spark, sf_dir)
    return evaluation.retrieval(own, gold, ["lang"])


@R.query(
    "retrieval_effect",
    f"""WITH {_RANKED_SQL}, b AS (SELECT g.lang, {_FIGURES_SQL} FROM g LEFT JOIN every ON every.source = g.item AND every.rank <= 5 GROUP BY 1), a AS (SELECT g.lang, {_FIGURES_SQL} FROM g LEFT JOIN own ON own.lang = g.lang AND own.source = g.item AND own.rank <= 5 GROUP BY 1)
    SELECT lang, b.top1_precision AS top1_precision_before, a.top1_precision AS top1_precision_after, round(a.top1_precision - b.top1_precision, 6) AS top1_precision_delta, b.mrr AS mrr_before, a.mrr AS mrr_after, round(a.mrr - b.mrr, 6) AS mrr_delta FROM b JOIN a USING (lang)""",
)
def retrieval_effect(spark, sf_dir):
    every, own, gold = _ranked(spark, sf_dir)
    return evaluation.effect(evaluation.retrieval(every, gold, ["lang"]), evaluation.retrieval(own, gold, ["lang"]), ["lang"], ["top1_precision", "mrr"])
