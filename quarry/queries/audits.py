"""Queries of audits with samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators.audit import Finding, audit, repeated
from quarry.queries.registry import Registry
from quarry.sources.tables import table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_ALIAS = r"regexp_replace(lower(trim(p_name)), '[\s：:，,、;；/\\_\-]+', '', 'g')"


def _shown(df, name: str):
    """Samples as one text, so that they can be compared with SQL's."""
    return df.withColumn("samples", F.array_join(F.transform("samples", lambda s: F.concat(s[name].cast("string"), F.when(s["mendable"], "+").otherwise(""))), ","))


@R.query(
    "coverage_audit",
    """WITH d AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, quality, toxic, url FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN pages ON page_id = d.doc_id),
            g AS (SELECT doc_id, unnest(['quality', 'toxic', 'quality_or_toxic', 'lang', 'page', 'long']) AS finding, unnest([quality IS NULL, toxic IS NULL, quality IS NULL AND toxic IS NULL, lang IS NULL, url IS NULL, n_chars > 5000]) AS holds,
                         unnest([source IS NOT NULL, n_chars > 500, false, true, lang = 'en', false]) AS mend FROM d),
            r AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY doc_id) AS k FROM g WHERE holds)
       SELECT finding, CASE finding WHEN 'long' THEN 'info' ELSE 'warning' END AS severity, count(*) AS n, count(*) FILTER (mend) AS mendable, string_agg(doc_id || CASE WHEN mend THEN '+' ELSE '' END, ',' ORDER BY k) FILTER (k <= 10) AS samples FROM r GROUP BY 1""",
)
def coverage_audit(spark, sf_dir):
    """What documents lack, what of it can be recovered, and the first ten of each gap, in one scan after the joins."""
    labels, pages = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality", "toxic"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("p"), "url")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    both = docs.join(labels, F.col("doc_id") == F.col("l"), "left").join(pages, F.col("doc_id") == F.col("p"), "left")
    none = lambda c: F.col(c).isNull()
    findings = [
        Finding("quality", "warning", none("quality"), ~none("source")), Finding("toxic", "warning", none("toxic"), F.col("n_chars") > 500), Finding("quality_or_toxic", "warning", none("quality") & none("toxic")),
        Finding("lang", "warning", none("lang"), F.lit(True)), Finding("page", "warning", none("url"), F.col("lang") == "en"), Finding("long", "info", F.col("n_chars") > 5000),
    ]
    return _shown(audit(both, findings, {"doc": F.col("doc_id")}, {"doc": F.col("doc_id")}), "doc")


@R.query(
    "health_audit",
    f"""WITH a AS (SELECT {_ALIAS} AS alias, p_brand FROM part), dup AS (SELECT alias, count(DISTINCT p_brand) AS owners FROM a WHERE alias IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p_brand) > 1),
             c AS (SELECT CAST(p_partkey AS VARCHAR) AS id, -p_retailprice AS o, p_size, p_retailprice, p_type FROM part),
             f AS (SELECT 'pending_pressure' AS finding, 'info' AS severity, id, o FROM c WHERE p_size < 10 UNION ALL SELECT 'non_enum', 'warning', id, o FROM c WHERE p_type LIKE '%STEEL' AND p_size < 10
                   UNION ALL SELECT 'value_like', 'warning', id, o FROM c WHERE regexp_matches(p_type, '^(SMALL|LARGE)') UNION ALL SELECT 'dear', 'info', id, o FROM c WHERE p_retailprice > 1800),
             r AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY o, id) AS k FROM f UNION ALL SELECT 'duplicate_alias', 'warning', alias, -owners, row_number() OVER (ORDER BY -owners, alias) FROM dup)
        SELECT finding, severity, count(*) AS n, string_agg(id, ',' ORDER BY k) FILTER (k <= 10) AS samples FROM r GROUP BY 1, 2""",
)
def health_audit(spark, sf_dir):
    """Findings on parts as dictionary candidates, dearest first, and aliases that several brands share."""
    part = table(spark, sf_dir, "part")
    pending = F.col("p_size") < 10
    findings = [
        Finding("pending_pressure", "info", pending), Finding("non_enum", "warning", F.col("p_type").endswith("STEEL") & pending), Finding("value_like", "warning", F.col("p_type").rlike("^(SMALL|LARGE)")),
        Finding("dear", "info", F.col("p_retailprice") > 1800),
    ]
    key = F.col("p_partkey").cast("string")
    own = audit(part, findings, {"price": -F.col("p_retailprice")}, {"id": key})
    twice = repeated(part, tx.alias(F.col("p_name")), F.col("p_brand"))
    shared = audit(twice, [Finding("duplicate_alias", "warning", F.lit(True))], {"owners": -F.col("owners")}, {"id": F.col("key")})
    return _shown(own.unionByName(shared), "id").drop("mendable")
