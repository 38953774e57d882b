"""Queries of ranked retrieval over persisted indexes, and of relevance scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scoring as sc
from quarry.functions import text as tx
from quarry.operators import search
from quarry.queries.registry import Registry
from quarry.sources.tables import table
from quarry.sources.workspace import fingerprint, folder

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def question(spark, text: str) -> list[str]:
    """The tokens of a question; a constant, so no job runs."""
    return spark.sql("SELECT :q AS q", args={"q": text}).select(tx.index_tokens(F.col("q")).alias("t")).first().t


_OPEN: dict[tuple, search.Index] = {}


def _index(df, name: str, id, tokens, features, cluster, buckets: int = 8, zones: int = 16) -> search.Index:
    """The table's index, built once for as long as its files stay as they are."""
    spark = df.sparkSession
    path = f"{folder(spark)}/index-{name}-{fingerprint(df, name, f'layout 3, {buckets} buckets, {zones} zones')}"
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPEN:
        _OPEN[key] = search.opened(df, path, id, tokens, features, cluster, buckets, zones)
    return _OPEN[key]


def _documents(spark, sf_dir) -> search.Index:
    n = F.coalesce("n_chars", F.lit(0))
    features = {"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")), "metrics": n % 3, "fields": n % 5, "finance": n > 2000, "verified": F.col("doc_id") % 2 == 0}
    return _index(table(spark, sf_dir, "documents"), "documents", F.col("doc_id"), tx.index_tokens(F.col("text")), features, ["finance", "lang", "source", "metrics"], search.BUCKETS, search.ZONES)


@R.query(
    "reference_rank",
    """WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, lang, source, n_chars FROM documents),
       s AS (SELECT doc_id, floor(least(1.0, greatest(0.0, CASE WHEN lang = 'en' THEN 0.25 ELSE 0.0 END + CASE WHEN source = 'src3' THEN 0.18 ELSE 0.0 END + 0.35 * (len(list_intersect(['license', 'version', 'under', 'apache'], w)) / 4.0)
       + least(0.16, 0.08 * (n_chars % 3)) + least(0.12, 0.03 * (n_chars % 5)) + CASE WHEN n_chars > 2000 THEN 0.20 ELSE 0.0 END + 0.0 + CASE WHEN doc_id % 2 = 0 THEN 0.03 ELSE 0.0 END)) * 10000 + 0.5) / 10000 AS score FROM d)
       SELECT doc_id, score FROM s ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 10""",
)
def reference_rank(spark, sf_dir):
    """The best references for a question, its intent and module; texts are not read, their tokens are in the index."""

    def score(f: search.Features, ratio):
        return sc.reference_score(f.may_equal("lang", "en"), f.may_equal("source", "src3"), ratio, f.metrics, f.fields, f.finance, F.lit(False), f.verified)

    found = _documents(spark, sf_dir).search(question(spark, "license version under Apache"), score, 10, lambda: [F.col("id").cast("string")])
    return found.withColumnRenamed("id", "doc_id")


@R.query(
    "index_audit",
    """WITH d AS (SELECT list_distinct(list_concat(list_concat(regexp_extract_all(lower(text), '[a-z0-9]+'), regexp_extract_all(lower(text), '[a-z]+[0-9]*|[0-9]+')), [])) AS w FROM documents)
       SELECT CAST(count(*) AS BIGINT) AS indexed, 1.0e0 AS coverage, CAST(0 AS BIGINT) AS missing, count(*) FILTER (len(w) = 0) AS without_tokens, CAST(sum(len(w)) AS BIGINT) AS postings,
              (SELECT count(DISTINCT t) FROM (SELECT unnest(w) AS t FROM d)) AS vocabulary FROM d""",
)
def index_audit(spark, sf_dir):
    return search.coverage(_documents(spark, sf_dir), table(spark, sf_dir, "documents").count())


def _parts(spark, sf_dir) -> search.Index:
    t = F.coalesce("p_type", F.lit(""))
    features = {
        "kind": t, "brand": F.coalesce("p_brand", F.lit("")), "size": F.coalesce("p_size", F.lit(0)), "dear": F.coalesce(F.col("p_retailprice") > 1000, F.lit(False)),
        "standard": t.startswith("STANDARD"), "steel": t.endswith("STEEL"), "phrase": F.lower(t).contains("plated steel"),
    }
    return _index(table(spark, sf_dir, "part"), "part", F.col("p_partkey"), tx.tokens(t), features, ["standard", "steel", "phrase", "size"])


_ARCHIVE_SQL = """WITH s AS (SELECT p_partkey, floor(least(1.0, greatest(0.0, CASE WHEN contains(lower(p_type), 'plated steel') THEN 0.12 ELSE 0.0 END
      + 0.18 * (len(list_intersect(['standard', 'plated', 'steel'], list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')))) / 3.0)
      + CASE WHEN starts_with(p_type, 'STANDARD') THEN 0.20 ELSE 0.0 END + CASE WHEN ends_with(p_type, 'STEEL') THEN 0.18 ELSE 0.0 END + CASE WHEN p_brand = 'Brand#12' THEN 0.14 ELSE 0.0 END
      + 0.20 * (1 - least(abs(p_size * 40.0 - 1000) / 100.0, 1.0)) + CASE WHEN p_retailprice > 1000 THEN 0.03 ELSE 0.0 END + CASE WHEN p_size > 10 THEN 0.03 ELSE 0.0 END + CASE WHEN p_size > 30 THEN 0.02 ELSE 0.0 END)) * 1000 + 0.5) / 1000 AS score FROM part)
    SELECT p_partkey, score FROM s ORDER BY score DESC, p_partkey DESC LIMIT 50"""


@R.query("archive_rank", _ARCHIVE_SQL)
def archive_rank(spark, sf_dir):
    def score(f: search.Features, ratio):
        near = sc.closeness(f.nearest("size", 25.0) * 40.0, F.lit(1000.0))
        return sc.item_score(f.phrase, ratio, f.standard, f.steel, f.may_equal("brand", "Brand#12"), near, (f.dear, f.high("size") > 10, f.high("size") > 30))

    return _parts(spark, sf_dir).search(question(spark, "standard plated steel"), score, 50, lambda: [F.desc("id")]).withColumnRenamed("id", "p_partkey")


#: Words of the parts' types in Chinese, to have texts in it.
CHINESE = {"STANDARD": "标准", "SMALL": "小型", "MEDIUM": "中型", "LARGE": "大型", "ECONOMY": "经济型", "PROMO": "促销", "ANODIZED": "阳极氧化", "BURNISHED": "抛光", "PLATED": "电镀", "POLISHED": "精抛光", "BRUSHED": "拉丝", "TIN": "锡板", "NICKEL": "镍板", "BRASS": "黄铜板", "STEEL": "钢板", "COPPER": "紫铜板"}
_SAID = "p_type"
for _latin, _chinese in CHINESE.items():
    _SAID = f"replace({_SAID}, '{_latin}', '{_chinese}')"


@R.query(
    "reference_rank_chinese",
    f"""WITH d AS (SELECT p_partkey, p_size, replace({_SAID}, ' ', '') || ' no.' || p_size AS said FROM part),
        s AS (SELECT p_partkey, 0.35 * ((CASE WHEN contains(said, '电镀钢板') THEN 1 ELSE 0 END + CASE WHEN contains(said, '电镀') THEN 1 ELSE 0 END + CASE WHEN contains(said, '镀钢') THEN 1 ELSE 0 END
              + CASE WHEN contains(said, '钢板') THEN 1 ELSE 0 END + CASE WHEN p_size = 12 THEN 1 ELSE 0 END) / 5.0) + least(0.16, 0.08 * (p_size % 3)) AS x FROM d)
        SELECT p_partkey, floor(x * 10000 + 0.5) / 10000 AS score FROM s ORDER BY score DESC, CAST(p_partkey AS VARCHAR) LIMIT 25""",
)
def reference_rank_chinese(spark, sf_dir):
    """A question in Chinese: its runs and their neighbouring pairs of characters are looked up."""
    said = F.col("p_type")
    for latin, chinese in CHINESE.items():
        said = F.regexp_replace(said, latin, chinese)
    said = F.concat(F.regexp_replace(said, " ", ""), F.lit(" no."), F.col("p_size").cast("string"))
    parts = table(spark, sf_dir, "part")
    index = _index(parts, "chinese", F.col("p_partkey"), tx.index_tokens(said), {"metrics": F.col("p_size") % 3}, ["metrics"])
    tokens = spark.range(1).select(tx.question_tokens(F.lit("电镀钢板 12"))).first()[0]

    def score(f: search.Features, ratio):
        none = F.lit(False)
        return sc.reference_score(none, none, ratio, f.metrics, F.lit(0), none, none, none)

    return index.search(tokens, score, 25, lambda: [F.col("id").cast("string")]).withColumnRenamed("id", "p_partkey")


@R.query(
    "schema_ranking",
    """WITH t AS (SELECT p_brand AS name, max(CASE WHEN regexp_matches(lower(p_brand), '#1|steel') THEN 60 ELSE 0 END + CASE WHEN regexp_matches(lower(p_type), '#1|steel') THEN 35 ELSE 0 END
                     + CASE WHEN regexp_matches(lower(p_name), '#1|steel') THEN 20 ELSE 0 END) AS own FROM part GROUP BY 1),
            f AS (SELECT p_brand AS name, sum(CASE WHEN regexp_matches(lower(p_name), '#1|steel') THEN 45 ELSE 0 END + CASE WHEN regexp_matches(CAST(p_partkey AS VARCHAR), '#1|steel') THEN 40 ELSE 0 END
                     + CASE WHEN regexp_matches(lower(p_type), '#1|steel') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(lower(p_brand), '#1|steel') THEN 15 ELSE 0 END) AS fields FROM part GROUP BY 1)
       SELECT name, own + fields AS score FROM t JOIN f USING (name)""",
)
def schema_ranking(spark, sf_dir):
    """Tables by the keywords in their names, labels and descriptions, and in those of their fields: brands stand for tables, parts for fields."""
    words = ["#1", "Steel"]
    p = table(spark, sf_dir, "part")
    own = sc.table_relevance(F.col("p_brand"), F.col("p_type"), F.col("p_name"), words)
    fields = sc.field_relevance(F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_type"), F.col("p_brand"), words)
    return p.groupBy(F.col("p_brand").alias("name")).agg((F.max(own) + F.sum(fields)).alias("score"))


@R.query(
    "module_relevance",
    """WITH m AS (SELECT r_name AS module, list(lower(n_name)) AS k FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1),
            q AS (SELECT c_custkey, lower('orders of ' || n_name || ' or ' || c_mktsegment || ' in ' || r_name) AS said FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
       SELECT c_custkey, module, 8 * CAST(contains(said, lower(module)) AS INT) + 8 * CAST(contains(said, lower(module) || ' sales') AS INT) + 2 * CAST(contains(said, 'orders of ') AS INT)
              + 5 * len(list_filter(k, lambda x: contains(said, x))) + 4 * CAST(contains(said, 'building') AS INT) AS score FROM q, m""",
)
def module_relevance(spark, sf_dir):
    """Each customer's question against the modules: the five regions, whose keywords are their nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    home = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    modules = home.groupBy(F.col("r_name").alias("module")).agg(F.collect_list("n_name").alias("keywords"))  # one row a region
    said = F.concat(F.lit("orders of "), "n_name", F.lit(" or "), "c_mktsegment", F.lit(" in "), "r_name")
    asked = table(spark, sf_dir, "customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", said.alias("said"))
    score = sc.module_relevance(F.col("said"), F.col("module"), F.concat("module", F.lit(" sales")), F.lit("Orders of "), F.col("keywords"), F.array(F.lit("Building")))
    return asked.join(F.broadcast(modules), F.lit(True)).select("c_custkey", "module", score.alias("score"))


@R.query(
    "template_relevance",
    """WITH o AS (SELECT o_custkey, count(*) AS uses, count(*) FILTER (o_orderstatus = 'F') AS good, max(o_orderpriority) AS p, min(o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS slots FROM orders GROUP BY 1)
       SELECT o_custkey, floor(least(1.0e0, CASE WHEN p = '5-LOW' THEN 0.4e0 ELSE 0.0e0 END + CASE WHEN s = 'O' THEN 0.2e0 ELSE 0.0e0 END + 0.2e0 * (slots / 5.0e0) + 0.1e0 * (CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END / 2.0e0) + CASE WHEN uses >= 20 THEN 0.1e0 ELSE 0.0e0 END
              + 0.1e0 * (good / CAST(uses AS DOUBLE))) * 10000 + 0.5) / 10000 AS score FROM o""",
)
def template_relevance(spark, sf_dir):
    used = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("uses"), F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.max("o_orderpriority").alias("p"), F.min("o_orderstatus").alias("s"), F.count_distinct("o_orderpriority").alias("slots")
    )
    score = sc.template_relevance(F.col("p") == "5-LOW", F.col("s") == "O", F.col("slots") / 5.0, F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0) / 2.0, sc.weight(F.col("uses") >= 20, 0.1), F.col("uses"), F.col("good"))
    return used.select("o_custkey", score.alias("score"))


@R.query(
    "config_relevance",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(1.0e0, floor((0.45e0 + CASE WHEN p_brand IS NOT NULL THEN 0.25e0 ELSE 0.0e0 END + greatest(0.0e0, least(0.15e0, (l_discount * 20 - 0.2e0) * 0.15e0)) + CASE WHEN o_custkey % 4 <> 0 THEN 0.08e0 ELSE 0.0e0 END
              + CASE WHEN p_type NOT LIKE '%STEEL' THEN 0.05e0 ELSE 0.0e0 END + CASE WHEN s_name IS NOT NULL AND l_suppkey % 2 = 0 THEN 0.07e0 ELSE 0.0e0 END) * 1000 + 0.5) / 1000) AS score
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""",
)
def config_relevance(spark, sf_dir):
    """How sure the product, customer and type of each order line are."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    customer = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey"))
    kind = F.when(F.col("p_type").endswith("STEEL"), "unknown").otherwise(F.col("p_type"))
    score = sc.config_relevance(F.col("p_brand"), F.col("l_discount") * 20 - 0.2, customer, kind, F.when(F.col("l_suppkey") % 2 == 0, F.col("s_name")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))
