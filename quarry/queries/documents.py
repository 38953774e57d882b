"""Text, scoring, retrieval, evaluation, JSON and record queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import documents as dj
from quarry.functions import scoring as sc
from quarry.functions import text as tx
from quarry.operators.matching import GAP, assign_all
from quarry.queries.registry import Registry
from quarry.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
NORM = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


# Text


@R.query("alias_normalise", "SELECT p_partkey, regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[\\s：:，,、;；/\\\\_\\-]+', '', 'g') AS alias FROM part")
def alias_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.alias(F.concat_ws(" / ", "p_name", "p_brand")).alias("alias"))


@R.query("multi_value_split", "SELECT p_partkey, array_to_string(list_distinct_kept, '|') AS parts FROM (SELECT p_partkey, list_filter(list_transform(string_split_regex(replace(p_type, ' ', ', '), '[,;|]+'), lambda x: trim(x)), lambda x: x <> '') AS list_distinct_kept FROM part)")
def multi_value(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.multi_value(F.replace("p_type", F.lit(" "), F.lit(", "))), "|").alias("parts"))


_UNIT_SQL = """WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ' mm' WHEN 1 THEN p_size || '-' || (p_size + 5) || ' KG extra' WHEN 2 THEN 'about ' || p_size ELSE p_size || '.5.1 m' END AS raw FROM part),
    t AS (SELECT *, regexp_matches(raw, '^[+-]?[0-9]*\\.[0-9]*\\.') AS bad, regexp_matches(raw, '^[+-]?[0-9]+(\\.[0-9]+)?\\s*-\\s*[0-9]') AS rng, regexp_matches(raw, '^[+-]?[0-9]') AS one FROM v)
    SELECT p_partkey, CASE WHEN bad THEN 'none' WHEN rng THEN 'range' WHEN one THEN 'number' ELSE 'none' END AS kind,
      CASE WHEN NOT bad AND NOT rng AND one THEN CAST(regexp_extract(raw, '^([0-9.]+)', 1) AS DOUBLE) END AS value,
      CASE WHEN NOT bad AND rng THEN CAST(regexp_extract(raw, '^([0-9]+)-', 1) AS DOUBLE) END AS low, CASE WHEN NOT bad AND rng THEN CAST(regexp_extract(raw, '-([0-9]+)', 1) AS DOUBLE) END AS high,
      CASE WHEN NOT bad AND one THEN lower(regexp_extract(raw, '^[0-9.\\-]+\\s*([A-Za-z%/]*)', 1)) END AS unit FROM t"""


@R.query("number_unit_parse", _UNIT_SQL)
def number_unit(spark, sf_dir):
    r, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(r == 0, F.concat(n, F.lit(" mm"))).when(r == 1, F.concat(n, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit(" KG extra"))).when(r == 2, F.concat(F.lit("about "), n)).otherwise(F.concat(n, F.lit(".5.1 m")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.number_unit(raw).alias("u")).select("p_partkey", "u.kind", "u.value", "u.low", "u.high", "u.unit")


@R.query("unit_alias_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'm3/h' WHEN 1 THEN 'um' ELSE 'kg/h' END AS unit FROM part")
def unit_alias(spark, sf_dir):
    r = F.col("p_partkey") % 3
    raw = F.when(r == 0, " m³ / hour").when(r == 1, "µM ").otherwise("Kg per hr")
    return table(spark, sf_dir, "part").select("p_partkey", tx.unit_text(raw).alias("unit"))


@R.query(
    "field_key_routing",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'contract_number' WHEN 1 THEN 'customer_id' WHEN 2 THEN 'delivery_date' WHEN 3 THEN replace(p_name, ' ', '_') WHEN 4 THEN p_brand ELSE '客户_' || p_size END AS field FROM part""",
)
def field_key_routing(spark, sf_dir):
    """Names of fields in several spellings: about the document, or the parts' own."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    shapes = [F.lit(" 合同号： "), F.lit("客户Id:"), F.lit("交货日期"), F.concat(F.lit("\t"), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(" ")), F.concat("p_brand", F.lit("::")), F.concat(F.lit("客户 "), size)]
    raw = F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.document_field(raw).alias("field"))


@R.query("qualifier_strip", "SELECT p_partkey, p_brand AS bare, CASE WHEN p_partkey % 2 = 0 THEN 'left' END AS qualifier, CASE WHEN p_partkey % 2 = 0 THEN 0.82e0 END AS confidence FROM (SELECT p_partkey, lower(p_brand) AS p_brand FROM part)")
def qualifier_strip(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Left "), "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.qualifier(raw).alias("q")).select("p_partkey", "q.bare", "q.qualifier", F.col("q.confidence").cast("double").alias("confidence"))


@R.query("selection_split", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '|' || p_type END AS options FROM part")
def selection_split(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("[SEL] "), "p_brand", F.lit("; "), "p_type")).otherwise(F.concat("p_brand", F.lit("; "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.selections(raw), "|").alias("options"))


@R.query("indexed_name_parse", "SELECT c_custkey, regexp_extract(c_name, '^(.*?)[ _#-]*([0-9]*)$', 1) AS base, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INTEGER) AS n FROM customer")
def indexed_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.indexed_name(F.col("c_name")).alias("x")).select("c_custkey", "x.base", "x.n")


@R.query("width_from_text", "SELECT p_partkey, CASE WHEN p_size >= 10 THEN CAST(p_size * 10 AS DOUBLE) END AS width FROM part")
def width_from_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.width(F.concat(F.lit("die, "), (F.col("p_size") * 10).cast("string"), F.lit(" MM wide"))).alias("width"))


@R.query("text_summary", f"SELECT doc_id, CASE WHEN length({NORM}) <= 240 THEN {NORM} ELSE left({NORM}, 239) || '…' END AS summary FROM documents")
def text_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.summary(F.col("text")).alias("summary"))


@R.query("text_slice", "SELECT doc_id, n, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE n BETWEEN 2 AND 4")
def text_slice(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("n"), "line").where("n BETWEEN 2 AND 4")


@R.query("edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@R.query("model_normalise", "SELECT p_partkey, regexp_replace(upper(p_brand || ' - ' || p_type), '[\\s_/.\\-]+', '', 'g') AS model FROM part")
def model_normalise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.model_name(F.concat_ws(" - ", "p_brand", "p_type")).alias("model"))


@R.query("mixed_date_parse", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def mixed_dates(spark, sf_dir):
    r = F.col("o_orderkey") % 3
    raw = F.when(r == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(r == 1, F.date_format("o_orderdate", "yyyy.MM.dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.mixed_date(raw).cast("string").alias("day"))


@R.query(
    "business_date_precedence",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN CAST(l_shipdate AS DATE) <= DATE '2001-08-01' THEN CAST(l_shipdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day,
       CASE WHEN CAST(l_shipdate AS DATE) <= DATE '2001-08-01' THEN 'shipped' ELSE 'ordered' END AS source FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A'""",
)
def business_date(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    shipped, ordered = F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")
    past = shipped <= F.lit("2001-08-01").cast("date")  # a date to come is no business date
    return both.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.when(past, shipped), ordered).cast("string").alias("day"), F.when(past, "shipped").otherwise("ordered").alias("source"))


@R.query(
    "sql_fingerprint",
    """SELECT 'select <n> from t where a = <text> and d >= <date> and v > <number>' AS shape, count(*) AS n, min(o_orderkey) AS first_key FROM orders""",
)
def sql_fingerprint(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    sql = F.concat(F.lit("SELECT  <n> FROM t WHERE a = 'x"), key, F.lit("' AND d >= '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("' AND v > "), key)
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.fingerprint(sql).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@R.query(
    "pii_redact",
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[email]', 'g'), '(?i)(password|token|secret|api[_-]?key)\\s*[:=]\\s*\\S+', '\\1=[secret]', 'g'), '[0-9]{15,18}', '[id]', 'g'), '\\+?[0-9][0-9 -]{8,13}[0-9]', '[phone]', 'g') AS text FROM documents""",
)
def pii_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redacted(F.col("text")).alias("text"))


@R.query("html_dataset_extract", "SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, sha256(html) AS hash, contains(html, '<script') AS scripted FROM pages")
def html_dataset(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)", 1).alias("title"), F.regexp_count(h, F.lit("<p>")).alias("paragraphs"), F.sha2(h, 256).alias("hash"), h.contains("<script").alias("scripted"))


@R.query("schema_tokens", "SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_]+'))), ' ') AS tokens FROM part")
def schema_tokens(spark, sf_dir):
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("([a-z0-9_]+)"), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("tokens"))


@R.query("sql_feature_extract", "SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS links, len(regexp_extract_all(html, '(?i)<(h[1-6])')) AS headings, len(regexp_extract_all(html, '&[a-z]+;')) AS entities FROM pages")
def features(spark, sf_dir):
    h = F.col("html")
    links = F.size(F.array_distinct(F.regexp_extract_all(h, F.lit('href="([^"]*)"'), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("links"), F.regexp_count(h, F.lit("(?i)<(h[1-6])")).alias("headings"), F.regexp_count(h, F.lit("&[a-z]+;")).alias("entities"))


@R.query("sql_masking", "SELECT p_partkey, 'SELECT a FROM t WHERE b = ' || repeat(' ', 2 + CAST(length(replace(p_name, chr(39), chr(39) || chr(39))) AS INTEGER)) || ' ' || repeat(' ', 3 + CAST(length(p_type) AS INTEGER)) AS masked, CAST(32 + length(replace(p_name, chr(39), chr(39) || chr(39))) + length(p_type) AS INTEGER) AS n FROM part")
def sql_masking(spark, sf_dir):
    raw = F.concat(F.lit("SELECT a FROM t WHERE b = '"), F.replace("p_name", F.lit("'"), F.lit("''")), F.lit("' -- "), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.without_literals(raw).alias("masked"), F.length(raw).alias("n"))


#: The tables' texts hold no compatibility characters, so that canonical composition gives the same.
@R.query("nfkc_normalise", "SELECT doc_id, nfc_normalize(text) AS normal FROM documents")
def nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.nfkc("text").alias("normal"))


@R.query("quantity_parse", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN 10 + p_size % 9 + 1 WHEN 2 THEN 200 WHEN 3 THEN 1005 WHEN 4 THEN 300 + 10 * (p_size % 9 + 1) + 7 END AS n FROM part")
def quantities(spark, sf_dir):
    """Counts in digits with a counter, and in numerals of one to four steps; the last kind is no count."""
    one = F.substring(F.lit("一二三四五六七八九"), F.col("p_size") % 9 + 1, F.lit(1))
    shapes = [F.concat(F.col("p_size").cast("string"), F.lit(" 台")), F.concat(F.lit("十"), one), F.lit("两百"), F.lit("一千零五套"), F.concat(F.lit("叁佰"), one, F.lit("拾柒")), F.concat(F.lit("about "), one)]
    raw = F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.quantity(raw).alias("n"))


#: Units by names as `unit_text` spells them: canonical and shown.
UNITS = {"mm": ("mm", "mm"), "毫米": ("mm", "mm"), "kg/h": ("kg/h", "kg/h"), "m3/h": ("m3/h", "m³/h"), "℃": ("C", "℃")}


def units():
    entry = lambda c, d: F.struct(F.lit(c).alias("canonical"), F.lit(d).alias("display"))
    return F.create_map(*[x for name, (c, d) in UNITS.items() for x in (F.lit(name), entry(c, d))])


@R.query(
    "number_unit_aliases",
    """WITH v AS (SELECT p_partkey, p_size AS n, p_size + 5 AS m, p_partkey % 8 AS r FROM part)
    SELECT p_partkey, CASE WHEN r IN (1, 6) THEN 'range' WHEN r IN (4, 5) THEN 'none' ELSE 'number' END AS kind,
      CASE WHEN r IN (0, 2, 3, 7) THEN CAST(n AS DOUBLE) END AS value, CASE WHEN r IN (1, 6) THEN CAST(n AS DOUBLE) END AS low, CASE WHEN r IN (1, 6) THEN CAST(m AS DOUBLE) END AS high,
      CASE r WHEN 0 THEN 'mm' WHEN 1 THEN 'mm' WHEN 2 THEN 'kg/h' WHEN 3 THEN NULL WHEN 6 THEN 'C' END AS unit,
      CASE r WHEN 0 THEN n || ' mm' WHEN 1 THEN m || '-' || n || ' mm' WHEN 2 THEN n || ' kg/h' WHEN 3 THEN n || ' bar' WHEN 4 THEN n || '.5.1 m' WHEN 5 THEN n || '的模头正常产量' WHEN 6 THEN n || '-' || m || ' ℃' ELSE CAST(n AS VARCHAR) END AS text,
      CASE r WHEN 0 THEN '宽度30' WHEN 7 THEN 'spare 2' END AS rest, CASE r WHEN 0 THEN '宽度' WHEN 7 THEN 'spare' END AS field, CASE r WHEN 0 THEN '30' WHEN 7 THEN '2' END AS field_value,
      CASE WHEN r = 0 THEN 'number_unit_trailing_text' WHEN r = 3 THEN 'unit_alias_no_match' WHEN r IN (4, 5) THEN 'number_unit_parse_failed' WHEN r = 7 THEN 'unit_missing,number_unit_trailing_text' ELSE '' END AS warnings FROM v""",
)
def number_unit_aliases(spark, sf_dir):
    """Sizes in eight spellings: with text after a known unit, ranges either way, per-hour forms, an unknown unit, a broken number, a sentence, signs of degrees, and no unit."""
    n, m = F.col("p_size").cast("string"), (F.col("p_size") + 5).cast("string")
    said = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    shapes = [said(n, "mm宽度30"), said(" ", m, "～", n, " 毫米 "), said(n, " Kg/Hour左右"), said(n, "bar"), said(n, ".5.1 m"), said(n, "的模头正常产量"), said(n, "°C至", m, "°C"), said(n, "(spare 2)")]
    raw = F.element_at(F.array(*shapes), (F.col("p_partkey") % 8 + 1).cast("int"))
    parsed = table(spark, sf_dir, "part").select("p_partkey", tx.measure(raw, units()).alias("u"))
    return parsed.select("p_partkey", *[f"u.{c}" for c in ("kind", "value", "low", "high", "unit", "text", "rest", "field", "field_value")], F.array_join("u.warnings", ",").alias("warnings"))


@R.query(
    "question_token_overlap",
    """WITH q AS (SELECT ['订单金额', '订单', '单金', '金额', 'top10', '2024'] AS w), v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['订单', 'top10'] WHEN 1 THEN ['金额', '2024'] WHEN 2 THEN ['订单', '单金', '金额', '订单金额'] ELSE [] END AS h FROM part)
       SELECT p_partkey, round(len(list_intersect(w, h)) / 6.0, 4) AS ratio FROM v, q""",
)
def question_overlap(spark, sf_dir):
    """A question in Chinese and Latin words against texts in both."""
    wanted = tx.question_tokens(F.lit("订单金额 top10 2024?"))
    shapes = [said for said in ("的订单 top10", "看金额2024年", "订单金额", "nothing here")]
    have = tx.question_tokens(F.element_at(F.array(*[F.lit(v) for v in shapes]), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sc.token_ratio(wanted, have), 4).alias("ratio"))


# Scoring and retrieval


@R.query(
    "token_overlap_score",
    """WITH q AS (SELECT ['small', 'plated', 'brushed', 'steel'] AS w) SELECT p_partkey, round(len(list_intersect(w, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')))) / 4.0, 4) AS ratio FROM part, q""",
)
def token_overlap(spark, sf_dir):
    wanted = F.array(*[F.lit(w) for w in ("small", "plated", "brushed", "steel")])
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sc.token_ratio(wanted, tx.tokens(F.col("p_type"))), 4).alias("ratio"))


@R.query(
    "width_closeness",
    "SELECT p_partkey, round(1 - least(abs(p_size * 40.0 - 1000) / greatest(100.0, 100.0), 1.0), 6) AS closeness FROM part",
)
def width_closeness(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sc.closeness(F.col("p_size") * 40.0, F.lit(1000.0)), 6).alias("closeness"))


@R.query(
    "schema_relevance",
    "SELECT p_brand AS name, max(CASE WHEN lower(p_brand) = 'brand#12' THEN 60 WHEN contains(lower(p_brand), '12') THEN 35 ELSE 0 END) + sum(CASE WHEN contains(lower(p_type), 'steel') THEN 20 ELSE 0 END) AS score FROM part GROUP BY 1",
)
def schema_relevance(spark, sf_dir):
    brand = F.lower("p_brand")
    own = F.when(brand == "brand#12", 60).when(brand.contains("12"), 35).otherwise(0)
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg((F.max(own) + F.sum(F.when(F.lower("p_type").contains("steel"), 20).otherwise(0))).alias("score"))


_COS = "list_cosine_similarity([CAST(x AS DOUBLE) for x in e.embedding], [CAST(x AS DOUBLE) for x in p.embedding])"


@R.query("cosine_topk", f"SELECT e.vec_id, round({_COS}, 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) p WHERE e.vec_id <> 7 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    """One probe against all vectors: its row is broadcast, the best ten are a top-k in each task."""
    e = table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 7").limit(1).select(F.col("embedding").alias("probe"))
    scored = e.where("vec_id <> 7").join(F.broadcast(probe), how="cross").select("vec_id", sc.cosine(F.col("embedding"), F.col("probe")).alias("c"))
    return scored.orderBy(F.desc("c"), "vec_id").limit(10).select("vec_id", F.round("c", 6).alias("cosine"))


@R.query(
    "hybrid_rerank",
    f"""WITH s AS (SELECT e.vec_id, round((e.vec_id % 10) / 10.0, 4) AS lexical, greatest(0.0, ({_COS} + 1) / 2) AS v FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) p)
        SELECT vec_id, floor((0.75 * lexical + 0.25 * v) * 10000 + 0.5) / 10000 AS score FROM s ORDER BY 0.75 * lexical + 0.25 * v DESC, vec_id LIMIT 20""",
)
def hybrid_rerank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 3").limit(1).select(F.col("embedding").alias("probe"))
    lexical = F.round((F.col("vec_id") % 10) / 10.0, 4)
    rows = e.join(F.broadcast(probe), how="cross").select("vec_id", lexical.alias("l"), sc.mapped_cosine(F.col("embedding"), F.col("probe")).alias("v"))
    return rows.orderBy(F.desc(0.75 * F.col("l") + 0.25 * F.col("v")), "vec_id").limit(20).select("vec_id", sc.hybrid(F.col("l"), F.col("v")).alias("score"))


@R.query(
    "quality_grade",
    """WITH s AS (SELECT doc_id, 60 + CASE WHEN n_chars > 1000 THEN 15 ELSE 0 END + CASE WHEN lang = 'en' THEN 10 ELSE 0 END - CASE WHEN contains(text, '|') THEN 20 ELSE 0 END + CASE WHEN contains(text, 'License') THEN 5 ELSE 0 END AS score FROM documents)
       SELECT doc_id, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM s""",
)
def quality_grade(spark, sf_dir):
    bonus = lambda c, n: F.when(c, n).otherwise(0)
    score = 60 + bonus(F.col("n_chars") > 1000, 15) + bonus(F.col("lang") == "en", 10) - bonus(F.col("text").contains("|"), 20) + bonus(F.col("text").contains("License"), 5)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).withColumn("grade", sc.grade(F.col("score")))


@R.query(
    "policy_score",
    """SELECT doc_id, floor(CASE WHEN doc_id % 5 = 0 THEN least(s, 0.69) ELSE s END * 10000 + 0.5) / 10000 AS score FROM (SELECT doc_id, least(1.0, greatest(0.0, 0.9 - 0.35 * (doc_id % 2) - 0.20 * (doc_id % 3) - 0.08 * (doc_id % 4) - least(0.1 * (doc_id % 7), 0.4)
       + CASE WHEN n_chars >= 1000 THEN 0.04 ELSE 0.0 END - CASE WHEN lang = 'fr' THEN 0.4 ELSE 0.0 END)) AS s FROM documents)""",
)
def policy_score(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("n_chars")
    score = sc.policy_score(F.lit(0.9), d % 2, d % 3, d % 4, 0.1 * (d % 7), F.when(n >= 1000, 10).otherwise(1), F.col("lang") == "fr", d % 5 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@R.query("governance_priority", "SELECT p_partkey, (p_size % 4) * 1000000 + p_size * 1000 + CAST(floor((p_size / 60.0) * 999 + 0.5) AS BIGINT) AS priority FROM part ORDER BY priority DESC, p_partkey LIMIT 40")
def governance(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", sc.governance_priority(size % 4, size, size / 60.0).alias("priority")).orderBy(F.desc("priority"), "p_partkey").limit(40)


@R.query("module_score", "SELECT lang, sum(CASE WHEN contains(text, 'License') THEN 8 ELSE 0 END + CASE WHEN contains(text, '|') THEN 5 ELSE 0 END + CASE WHEN n_chars > 4000 THEN 2 ELSE 0 END) AS score FROM documents GROUP BY 1")
def module_score(spark, sf_dir):
    bonus = lambda c, n: F.when(c, n).otherwise(0)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(bonus(F.col("text").contains("License"), 8) + bonus(F.col("text").contains("|"), 5) + bonus(F.col("n_chars") > 4000, 2)).alias("score"))


@R.query(
    "template_score",
    "SELECT o_custkey, floor(least(1.0, 0.3 + 0.5 * (count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE) + CASE WHEN count(*) >= 10 THEN 0.2 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS score FROM orders GROUP BY 1",
)
def template_score(spark, sf_dir):
    rate = F.count_if(F.col("o_orderstatus") == "F") / F.count("*")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(sc.rounded(sc.clamped(0.3 + 0.5 * rate + sc.weight(F.count("*") >= 10, 0.2)), 4).alias("score"))


@R.query("config_score", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#12' THEN 0.45e0 ELSE 0.0e0 END + CASE WHEN contains(p_type, 'STEEL') THEN 0.25e0 ELSE 0.0e0 END + least(0.15e0, p_size * 0.003e0) + CASE WHEN p_size > 20 THEN 0.08e0 ELSE 0.0e0 END AS score FROM part")
def config_score(spark, sf_dir):
    w = sc.weight
    score = sc.total(w(F.col("p_brand") == "Brand#12", 0.45), w(F.col("p_type").contains("STEEL"), 0.25), F.least(F.lit(0.15), F.col("p_size") * 0.003), w(F.col("p_size") > 20, 0.08))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


@R.query("clue_confidence", "SELECT c_custkey, least(0.95e0, CASE WHEN c_acctbal > 0 THEN 0.45e0 ELSE 0.0e0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.25e0 ELSE 0.0e0 END + CASE WHEN c_nationkey < 10 THEN 0.15e0 ELSE 0.0e0 END + 0.15e0) AS confidence FROM customer")
def clue_confidence(spark, sf_dir):
    w = sc.weight
    score = sc.total(w(F.col("c_acctbal") > 0, 0.45), w(F.col("c_mktsegment") == "BUILDING", 0.25), w(F.col("c_nationkey") < 10, 0.15), F.lit(0.15))
    return table(spark, sf_dir, "customer").select("c_custkey", F.least(F.lit(0.95), score).alias("confidence"))


@R.query("feature_decision", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'reject' WHEN p_retailprice > 1500 THEN 'review' WHEN p_size > 30 THEN 'accept' ELSE 'observe' END AS decision, array_to_string(list_filter([CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END], lambda x: x IS NOT NULL), ',') AS flags FROM part")
def feature_decision(spark, sf_dir):
    small, dear = F.col("p_size") < 5, F.col("p_retailprice") > 1500
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.when(small, "reject").when(dear, "review").when(F.col("p_size") > 30, "accept").otherwise("observe").alias("decision"),
        F.array_join(F.array_compact(F.array(F.when(small, "small"), F.when(dear, "dear"))), ",").alias("flags"),
    )


@R.query("family_score", "SELECT p_type AS family, round(avg(p_size) / 50.0 * 0.6 + least(1.0, count(*) / 20.0) * 0.4, 6) AS score FROM part GROUP BY 1")
def family_score(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("family")).agg(F.round(F.avg("p_size") / 50.0 * 0.6 + F.least(F.lit(1.0), F.count("*") / 20.0) * 0.4, 6).alias("score"))


def _similar(a: str, b: str) -> str:
    """SQL of `tx.similarity` of two texts without nulls."""
    grams = lambda c: f"list_distinct(CASE WHEN length({c}) < 2 THEN [] ELSE [substr({c}, i, 2) for i in range(1, length({c}))] END)"
    dice = f"coalesce(2 * len(list_intersect({grams(a)}, {grams(b)})) / CAST(nullif(len({grams(a)}) + len({grams(b)}), 0) AS DOUBLE), 0.0e0)"
    inside = f"least(length({a}), length({b})) > 0 AND (contains({a}, {b}) OR contains({b}, {a}))"
    return f"CASE WHEN {a} = {b} THEN 1.0e0 WHEN {inside} THEN 0.65e0 + 0.3e0 * least(length({a}), length({b})) / greatest(length({a}), length({b})) ELSE {dice} END"


@R.query(
    "alias_gap",
    f"""WITH p AS (SELECT p_partkey, lower(p_name) AS name, min(lower(p_name)) OVER (PARTITION BY p_brand) AS anchor FROM part),
             s AS (SELECT p_partkey, anchor, round({_similar("name", "anchor")}, 6) AS similarity FROM p WHERE name <> anchor)
        SELECT p_partkey, anchor, similarity FROM s WHERE similarity >= 0.35""",
)
def alias_gap(spark, sf_dir):
    """Names that are like the first of their brand, yet not equal: a brand has one anchor, so this is an equi-join."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower("p_name").alias("name"))
    ranked = part.groupBy("p_brand").agg(F.min("name").alias("anchor"))
    both = part.join(ranked, "p_brand").where("name <> anchor")
    return both.select("p_partkey", "anchor", F.round(tx.similarity(F.col("name"), F.col("anchor")), 6).alias("similarity")).where("similarity >= 0.35")


_GREEDY_SQL = f"""
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS place
                     FROM lineitem WHERE l_returnflag = 'A'),
     n AS (SELECT l.*, lower(p_type) AS kind FROM l JOIN part ON p_partkey = l_partkey),
     kinds AS (SELECT DISTINCT a.kind AS a, b.kind AS b FROM n a JOIN n b USING (l_orderkey)),
     alike AS (SELECT a, b, {_similar("a", "b")} AS x FROM kinds),
     pairs AS (SELECT c.l_orderkey, c.place AS clue, n.place AS line, n.l_linenumber, n.l_partkey, n.l_suppkey,
                      floor(least(0.99e0, 0.5e0 * x + CASE WHEN n.l_quantity = c.l_quantity THEN 0.45e0 ELSE 0.0e0 END) * 100 + 0.5) / 100 AS score
               FROM n c JOIN n ON n.l_orderkey = c.l_orderkey JOIN alike ON a = n.kind AND b = c.kind),
     seen AS (SELECT *, coalesce(score - lead(score) OVER (PARTITION BY l_orderkey, clue ORDER BY score DESC, line) >= 0.12, true) AS clear FROM pairs),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, clue, line) AS k FROM seen WHERE score >= 0.45),
     taken AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS k, false AS ok, CAST([] AS BIGINT[]) AS clues, CAST([] AS BIGINT[]) AS lines FROM ranked WHERE k = 1
               UNION ALL
               SELECT t.l_orderkey, r.k, NOT list_contains(clues, clue) AND NOT list_contains(lines, line),
                      CASE WHEN NOT list_contains(clues, clue) AND NOT list_contains(lines, line) THEN list_append(clues, clue) ELSE clues END,
                      CASE WHEN NOT list_contains(clues, clue) AND NOT list_contains(lines, line) THEN list_append(lines, line) ELSE lines END
               FROM taken t JOIN ranked r ON r.l_orderkey = t.l_orderkey AND r.k = t.k + 1)
SELECT r.l_orderkey, r.clue, r.line, r.l_linenumber, r.l_partkey, r.l_suppkey, r.score, r.clear FROM taken JOIN ranked r USING (l_orderkey, k) WHERE ok
"""


@R.query("greedy_assignment", _GREEDY_SQL)
def greedy(spark, sf_dir):
    """Lines of an order matched one to one with the parts it names, by similarity of name and quantity; ambiguous where the next best is near.

    A line number can occur twice in an order, so a line's key is its number, part, supplier and, for what is still alike,
    its place by all other columns. `clue` and `line` are such keys, numbered within the order.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    key = ["l_linenumber", "l_partkey", "l_suppkey"]
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*key, *[c for c in lines.columns if c not in ("l_orderkey", *key)]))
    line = lines.select("l_orderkey", *key, "l_quantity", place.alias("place"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("kind"))
    named = line.join(part, F.col("p_partkey") == F.col("l_partkey"))
    classes = named.groupBy("l_orderkey", "kind", "l_quantity").agg(F.collect_list(F.struct("place", *key)).alias("lines"))
    clue = classes.select("l_orderkey", F.col("lines").alias("clues"), F.col("kind").alias("clue_kind"), F.col("l_quantity").alias("clue_quantity"))
    scored = classes.join(clue, "l_orderkey").select(
        "l_orderkey", "clues", "lines",
        sc.rounded(F.least(F.lit(0.99), 0.5 * tx.similarity(F.col("kind"), F.col("clue_kind")) + sc.weight(F.col("l_quantity") == F.col("clue_quantity"), 0.45)), 2).alias("score"),
    )
    pairs = scored.select("l_orderkey", F.explode("clues.place").alias("clue"), "lines", "score").select("l_orderkey", "clue", F.explode("lines").alias("l"), "score")
    pairs = pairs.select("l_orderkey", "clue", F.col("l.place").alias("line"), *[F.col(f"l.{c}").alias(c) for c in key], "score")
    ahead = F.lead("score").over(Window.partitionBy("l_orderkey", "clue").orderBy(F.desc("score"), "line"))
    pairs = pairs.withColumn("clear", F.coalesce(F.col("score") - ahead >= GAP, F.lit(True)))
    return assign_all(pairs, "l_orderkey", "clue", "line", "score")


# Evaluation


@R.query(
    "prf_metrics",
    """WITH p AS (SELECT quality = 1 AS gold, n_chars > 800 AS said FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) FILTER (gold AND said) AS tp, count(*) FILTER (NOT gold AND said) AS fp, count(*) FILTER (gold AND NOT said) AS fn FROM p)
       SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def prf(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    gold, said = F.col("quality") == 1, F.col("n_chars") > 800
    c = both.agg(F.count_if(gold & said).alias("tp"), F.count_if(~gold & said).alias("fp"), F.count_if(gold & ~said).alias("fn"))
    return c.select("tp", "fp", "fn", *_rates())


def _rates():
    tp, fp, fn, none = F.col("tp"), F.col("fp"), F.col("fn"), F.lit(0)
    return [F.round(tp / F.nullif(tp + fp, none), 6).alias("precision"), F.round(tp / F.nullif(tp + fn, none), 6).alias("recall"), F.round(2 * tp / F.nullif(2 * tp + fp + fn, none), 6).alias("f1")]


_CLASSES = "WITH p AS (SELECT lang AS gold, CASE WHEN doc_id % 9 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS said, source FROM documents), c AS (SELECT g.label, (SELECT count(*) FROM p WHERE gold = g.label AND said = g.label) AS tp, (SELECT count(*) FROM p WHERE gold <> g.label AND said = g.label) AS fp, (SELECT count(*) FROM p WHERE gold = g.label AND said <> g.label) AS fn FROM (SELECT DISTINCT gold AS label FROM p) g)"


def _said():
    return F.when(F.col("doc_id") % 9 == 0, "en").when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang"))


@R.query("macro_f1", _CLASSES + " SELECT round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, count(*) AS labels FROM c")
def macro_f1(spark, sf_dir):
    """Over the labels of the gold side only. Each row counts for its gold label and for its predicted one, so one shuffle of label counts is enough."""
    p = table(spark, sf_dir, "documents").select(F.col("lang").alias("gold"), _said().alias("said"))
    hits = F.array(F.struct(F.col("gold").alias("label"), F.lit(True).alias("is_gold"), (F.col("gold") == F.col("said")).alias("hit")), F.struct(F.col("said").alias("label"), F.lit(False).alias("is_gold"), (F.col("gold") == F.col("said")).alias("hit")))
    c = p.select(F.inline(hits)).groupBy("label").agg(F.count_if(F.col("is_gold") & F.col("hit")).alias("tp"), F.count_if(~F.col("is_gold") & ~F.col("hit")).alias("fp"), F.count_if(F.col("is_gold") & ~F.col("hit")).alias("fn"), F.bool_or("is_gold").alias("gold"))
    return c.where("gold").agg(F.round(F.avg(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))), 6).alias("macro_f1"), F.count("*").alias("labels"))


@R.query(
    "stratified_metrics",
    """SELECT stratum, count(*) AS n, round(avg(ok), 6) AS accuracy FROM (SELECT unnest([lang, source]) AS stratum, CASE WHEN (CASE WHEN doc_id % 9 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END) = lang THEN 1.0 ELSE 0.0 END AS ok FROM documents) GROUP BY 1""",
)
def stratified(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("stratum"), F.when(_said() == F.col("lang"), 1.0).otherwise(0.0).alias("ok"))
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@R.query(
    "top_k_recall",
    """SELECT label, count(*) AS n, round(avg(CASE WHEN label % 3 = vec_id % 3 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN list_contains([vec_id % 3, (vec_id + 1) % 3], label % 3) THEN 1.0 ELSE 0.0 END), 6) AS top2 FROM embeddings GROUP BY 1""",
)
def top_k(spark, sf_dir):
    guesses, gold = F.array(F.col("vec_id") % 3, (F.col("vec_id") + 1) % 3), (F.col("label") % 3).cast("long")
    hit = lambda k: F.round(F.avg(F.when(F.array_contains(F.slice(guesses, 1, k), gold), 1.0).otherwise(0.0)), 6)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(2).alias("top2"))


@R.query("acceptance_ratio", "SELECT source, count(*) AS n, round(avg(CASE WHEN n_chars BETWEEN 200 AND 20000 AND NOT contains(text, '###') THEN 1.0 ELSE 0.0 END), 6) AS passed FROM documents GROUP BY 1")
def acceptance(spark, sf_dir):
    ok = F.col("n_chars").between(200, 20000) & ~F.col("text").contains("###")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("passed"))


@R.query(
    "index_coverage",
    """SELECT count(*) AS n, round(count(quality) / count(*), 6) AS labelled, round(count(*) FILTER (n_chars >= 1000) / count(*), 6) AS long, count(DISTINCT lang) AS languages, count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id)""",
)
def index_coverage(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.count("*")
    return both.agg(n.alias("n"), F.round(F.count("quality") / n, 6).alias("labelled"), F.round(F.count_if(F.col("n_chars") >= 1000) / n, 6).alias("long"), F.count_distinct("lang").alias("languages"), F.count_distinct("source").alias("sources"))


@R.query("funnel_counts", "SELECT count(*) AS seen, count(*) FILTER (lang = 'en') AS in_scope, count(*) FILTER (lang = 'en' AND n_chars > 500) AS long_enough, count(*) FILTER (lang = 'en' AND n_chars > 500 AND NOT contains(text, '|')) AS accepted FROM documents")
def funnel(spark, sf_dir):
    a, b, c = F.col("lang") == "en", F.col("n_chars") > 500, ~F.col("text").contains("|")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("seen"), F.count_if(a).alias("in_scope"), F.count_if(a & b).alias("long_enough"), F.count_if(a & b & c).alias("accepted"))


@R.query(
    "health_findings",
    """WITH f(finding, n) AS (SELECT 'no label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'too short', count(*) FROM documents WHERE n_chars < 50 UNION ALL SELECT 'copied text', coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM documents GROUP BY text)) SELECT finding, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""",
)
def health(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    parts = [
        docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("no label").alias("finding"), "n"),
        docs.where("n_chars < 50").agg(F.count("*").alias("n")).select(F.lit("too short").alias("finding"), "n"),
        docs.agg((F.count("*") - F.count_distinct(F.sha2("text", 256))).alias("n")).select(F.lit("copied text").alias("finding"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n > 0")


# Rule ladders


@R.query(
    "triage_label",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsafe' WHEN quality = 0 THEN 'poor' WHEN quality IS NULL AND contains(text, '***') THEN 'noise' WHEN quality IS NULL THEN 'unknown' ELSE 'good' END AS label, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 WHEN quality IS NULL THEN 1 ELSE 0 END AS risk FROM documents LEFT JOIN labels USING (doc_id)""",
)
def triage(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    toxic, poor, none = F.col("toxic") == 1, F.col("quality") == 0, F.col("quality").isNull()
    label = F.when(toxic, "unsafe").when(poor, "poor").when(none & F.col("text").contains("***"), "noise").when(none, "unknown").otherwise("good")
    return both.select("doc_id", label.alias("label"), F.when(toxic, 3).when(poor, 2).when(none, 1).otherwise(0).alias("risk"))


@R.query(
    "terminal_state",
    """SELECT o_orderkey, CASE WHEN n IS NULL THEN 'empty' WHEN o_orderstatus = 'F' AND r > 0 THEN 'returned' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'P' THEN 'partial' WHEN late > 0 THEN 'overdue' ELSE 'waiting' END AS state
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (CAST(l_shipdate AS DATE) < DATE '2001-08-01') AS late FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def terminal_state(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_shipdate").cast("date") < F.lit("2001-08-01").cast("date")).alias("late")
    )
    s = F.col("o_orderstatus")
    state = F.when(F.col("n").isNull(), "empty").when((s == "F") & (F.col("r") > 0), "returned").when(s == "F", "finished").when(s == "P", "partial").when(F.col("late") > 0, "overdue").otherwise("waiting")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@R.query(
    "readiness_gate",
    "SELECT o_custkey, bool_or(o_totalprice > 100000) AS searchable, bool_and(o_orderstatus <> 'O') AS ready, CASE WHEN bool_and(o_orderstatus <> 'O') THEN 'full' WHEN bool_or(o_totalprice > 100000) THEN 'search' ELSE 'hold' END AS mode FROM orders GROUP BY 1",
)
def readiness(spark, sf_dir):
    some, every = F.bool_or(F.col("o_totalprice") > 100000), F.bool_and(F.col("o_orderstatus") != "O")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(some.alias("searchable"), every.alias("ready"), F.when(every, "full").when(some, "search").otherwise("hold").alias("mode"))


@R.query(
    "type_resolver",
    """WITH t(alias, family, pri) AS (VALUES ('STANDARD PLATED STEEL', 'exact', 1), ('PLATED', 'plated', 3), ('POLISHED', 'polished', 3), ('STEEL', 'steel', 3)),
       h AS (SELECT p_partkey, family, pri, -length(alias) AS l, alias FROM part JOIN t ON (pri = 1 AND p_type = alias) OR (pri = 3 AND contains(p_type, alias)) UNION ALL SELECT p_partkey, 'economy', 2, 0, '' FROM part WHERE regexp_matches(p_type, '^ECONOMY'))
       SELECT p_partkey, coalesce(f, 'other') AS family FROM part LEFT JOIN (SELECT p_partkey, arg_min(family, struct_pack(p := pri, l := l, a := alias)) AS f FROM h GROUP BY 1) USING (p_partkey)""",
)
def type_resolver(spark, sf_dir):
    """Exact alias, then pattern, then the longest alias contained; a short list of aliases is an expression, not a join."""
    kind = F.col("p_type")
    contained = sorted((("PLATED", "plated"), ("POLISHED", "polished"), ("STEEL", "steel")), key=lambda a: (-len(a[0]), a[0]))
    family = F.when(kind == "STANDARD PLATED STEEL", "exact").when(kind.rlike("^ECONOMY"), "economy")
    for name, f in contained:
        family = family.when(kind.contains(name), f)
    return table(spark, sf_dir, "part").select("p_partkey", family.otherwise("other").alias("family"))


@R.query("blocker_reason", "SELECT c_custkey, CASE WHEN n IS NULL THEN 'no_orders' WHEN c_acctbal < 0 THEN 'in_debt' WHEN open > 5 THEN 'too_many_open' END AS reason FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def blocker(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    reason = F.when(F.col("n").isNull(), "no_orders").when(F.col("c_acctbal") < 0, "in_debt").when(F.col("open") > 5, "too_many_open")
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").select("c_custkey", reason.alias("reason"))


@R.query("route_decision", "SELECT doc_id, CASE WHEN n_chars < 100 THEN 'discard' WHEN contains(text, '###') THEN 'repair' WHEN lang IN ('en', 'de') THEN 'index' ELSE 'translate' END AS route FROM documents")
def route(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 100, "discard").when(F.col("text").contains("###"), "repair").when(F.col("lang").isin("en", "de"), "index").otherwise("translate").alias("route"))


@R.query("issue_detect", "SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'short:0.9' END, CASE WHEN contains(text, '###') THEN 'noise:0.8' END, CASE WHEN contains(text, '|') THEN 'table:0.7' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents")
def issues(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_compact(F.array(F.when(F.col("n_chars") < 100, "short:0.9"), F.when(t.contains("###"), "noise:0.8"), F.when(t.contains("|"), "table:0.7"))), ",").alias("issues"))


@R.query("form_classify", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRUSHED|POLISHED') AND p_size > 25 THEN 'large finish' WHEN regexp_matches(p_type, 'BRUSHED|POLISHED') THEN 'finish' WHEN contains(p_type, 'PLATED') THEN 'coat' ELSE 'plain' END AS form FROM part")
def form(spark, sf_dir):
    kind = F.col("p_type")
    finish = kind.rlike("BRUSHED|POLISHED")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(finish & (F.col("p_size") > 25), "large finish").when(finish, "finish").when(kind.contains("PLATED"), "coat").otherwise("plain").alias("form"))


@R.query("family_use_class", "SELECT source, CASE WHEN count(*) >= 50 THEN 'core' WHEN avg(n_chars) > 3000 THEN 'deep' ELSE 'tail' END AS use_class FROM documents GROUP BY 1")
def family_use(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.when(F.count("*") >= 50, "core").when(F.avg("n_chars") > 3000, "deep").otherwise("tail").alias("use_class"))


@R.query("source_precedence", "SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'label' WHEN contains(text, 'License') THEN 'text' ELSE 'default' END AS origin, CASE WHEN quality IS NOT NULL THEN 0.9e0 WHEN contains(text, 'License') THEN 0.75e0 ELSE 0.5e0 END AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def source_precedence(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = lambda name, c: F.struct(F.lit(name).alias("origin"), F.lit(c).alias("confidence"))
    best = F.coalesce(F.when(F.col("quality").isNotNull(), s("label", 0.9)), F.when(F.col("text").contains("License"), s("text", 0.75)), s("default", 0.5))
    return both.select("doc_id", best.alias("b")).select("doc_id", "b.origin", "b.confidence")


# JSON and records


@R.query("json_path_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def json_path(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@R.query("json_explode", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def json_explode(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@R.query(
    "json_array_explode",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN [] WHEN event_type = 'view' THEN [event_type, CAST(user_id AS VARCHAR), json_extract_string(props, '$.k')] ELSE [CAST(event_id AS VARCHAR), event_type] END AS l FROM events)
       SELECT event_id, unnest(range(0, len(l))) AS idx, unnest(l) AS item FROM e""",
)
def json_array(spark, sf_dir):
    """Arrays in JSON text, as documents store them, one row an element; an array is as long as its own row's."""
    user, key, kind = F.col("user_id").cast("string"), F.get_json_object("props", "$.k"), F.col("event_type")
    array = F.when(kind == "error", F.array().cast("array<string>")).when(kind == "view", F.array(kind, user, key)).otherwise(F.array(F.col("event_id").cast("string"), kind))
    stored = table(spark, sf_dir, "events").select("event_id", F.to_json(array).alias("j"))
    return stored.select("event_id", F.posexplode(F.from_json("j", "array<string>")).alias("idx", "item")).withColumn("idx", F.col("idx").cast("long"))


@R.query("canonical_json_hash", "SELECT event_id, sha256('{\"a\":1,\"k\":' || json_extract_string(props, '$.k') || '}') AS hash FROM events")
def canonical_hash(spark, sf_dir):
    raw = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": 1}'))
    return table(spark, sf_dir, "events").select("event_id", F.sha2(dj.canonical(raw), 256).alias("hash"))


@R.query("flatten_json", "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS flat FROM events")
def flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dj.flattened("props").alias("flat"))


@R.query("path_patch", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"meta\":{\"checked\":true}}' AS props FROM events")
def path_patch(spark, sf_dir):
    set_ = dj.patched(("meta", "checked"), True, frozenset({"meta", "checked"}))
    return table(spark, sf_dir, "events").select("event_id", set_("props").alias("props"))


@R.query("value_protect", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"token\":\"[hidden]\"}' AS props FROM events")
def value_protect(spark, sf_dir):
    raw = F.concat(F.lit('{"token": "x", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", dj.protected()(raw).alias("props"))


@R.query("json_set", "SELECT event_id, '{\"k\":' || (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) || '}' AS props FROM events")
def json_set(spark, sf_dir):
    m = F.from_json("props", "map<string,int>")
    changed = F.map_concat(F.map_filter(m, lambda k, v: k != "k"), F.create_map(F.lit("k"), m["k"] + 1))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(changed).alias("props"))


@R.query("field_merge", "SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'scalar' ELSE 'list' END AS shape, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS value FROM lineitem GROUP BY 1")
def field_merge(spark, sf_dir):
    """Fields of one name collide into a list, in the order of their instances."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"].cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(F.count("*") == 1, "scalar").otherwise("list").alias("shape"), F.array_join(values, "|").alias("value"))


@R.query("instance_split", "SELECT c_custkey, n, c_name || ' ' || n AS instance FROM (SELECT c_custkey, c_name, unnest(range(1, 1 + 1 + CAST(c_custkey % 3 AS BIGINT))) AS n FROM customer)")
def instance_split(spark, sf_dir):
    """One row becomes as many numbered instances as it says."""
    n = F.explode(F.sequence(F.lit(1).cast("long"), F.col("c_custkey") % 3 + 1)).alias("n")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", n).select("c_custkey", "n", F.concat_ws(" ", "c_name", F.col("n").cast("string")).alias("instance"))


@R.query(
    "field_redirect",
    """WITH main AS (SELECT l_orderkey, min(l_linenumber) AS main_line FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN main_line ELSE l_linenumber END AS owner_line, count(*) AS fields FROM lineitem JOIN main USING (l_orderkey) GROUP BY 1, 2""",
)
def field_redirect(spark, sf_dir):
    """Fields that belong to the order's first item are counted there."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    main = line.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("main_line"))
    owner = F.when(F.col("l_returnflag") == "R", F.col("main_line")).otherwise(F.col("l_linenumber"))
    return line.join(main, "l_orderkey").groupBy("l_orderkey", owner.alias("owner_line")).agg(F.count("*").alias("fields"))


@R.query("field_confirm", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'dictionary' WHEN p_size BETWEEN 1 AND 50 AND p_size % 2 = 0 THEN 'number' ELSE 'unconfirmed' END AS status FROM part")
def field_confirm(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "dictionary").when(size.between(1, 50) & (size % 2 == 0), "number").otherwise("unconfirmed").alias("status"))


@R.query("composite_split", "SELECT p_partkey, unnest(['finish', 'coat', 'metal']) AS field, unnest(string_split(p_type, ' ')) AS value FROM part WHERE len(string_split(p_type, ' ')) = 3")
def composite_split(spark, sf_dir):
    parts = F.split("p_type", " ")
    fields = F.arrays_zip(F.array(F.lit("finish"), F.lit("coat"), F.lit("metal")).alias("field"), parts.alias("value"))
    return table(spark, sf_dir, "part").where(F.size(parts) == 3).select("p_partkey", F.inline(fields)).toDF("p_partkey", "field", "value")


@R.query(
    "eval_top1_top3",
    """WITH r AS (SELECT lang, source, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)) SELECT lang, round(sum(n) FILTER (rank = 1) / sum(n), 6) AS top1, round(sum(n) FILTER (rank <= 3) / sum(n), 6) AS top3 FROM r GROUP BY 1""",
)
def top1_top3(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source")))
    share = lambda k: F.round(F.sum(F.when(F.col("rank") <= k, F.col("n"))) / F.sum("n"), 6)
    return r.groupBy("lang").agg(share(1).alias("top1"), share(3).alias("top3"))


@R.query(
    "search_effect_delta",
    """SELECT source, round(avg(n_chars) FILTER (lang = 'en') - avg(n_chars) FILTER (lang <> 'en'), 6) AS delta, count(*) FILTER (lang = 'en') AS before_n, count(*) FILTER (lang <> 'en') AS after_n FROM documents GROUP BY 1""",
)
def effect_delta(spark, sf_dir):
    en, n = F.col("lang") == "en", F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg(F.when(en, n)) - F.avg(F.when(~en, n)), 6).alias("delta"), F.count_if(en).alias("before_n"), F.count_if(~en).alias("after_n"))
