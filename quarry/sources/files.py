"""File sources and sinks: CSV, TSV, JSON reports, file listings, sealed artefacts and batched upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Rows with a given schema; rows that don't fit go to `_corrupt`."""
    from pyspark.sql.types import StringType, _parse_datatype_string

    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    whole = StructType(list(schema.fields)).add("_corrupt", StringType())
    return spark.read.schema(whole).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").csv(path, header=True, sep=sep, multiLine=True, escape='"')


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def flat(df: DataFrame) -> DataFrame:
    """Tabs and line ends in strings as single spaces, as a table of lines needs it."""
    return df.withColumns({c: F.regexp_replace(c, r"[\t\r\n]+", " ") for c, kind in df.dtypes if kind == "string"})


def write_tsv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").csv(path, header=True, sep="\t", quote="")


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object for each line."""
    df.write.mode("overwrite").json(path)


def listing(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """path, length and SHA-256 of all files of an extension below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(files: DataFrame, sealed: DataFrame) -> DataFrame:
    """Sealed files (name, length, sha256) with a status: ok, missing, or changed."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("name"), F.col("length").alias("found_length"), F.col("sha256").alias("found_sha256"))
    same = (F.col("length") == F.col("found_length")) & (F.col("sha256") == F.col("found_sha256"))
    return sealed.join(found, "name", "left").select("name", F.when(F.col("found_sha256").isNull(), "missing").when(same, "ok").otherwise("changed").alias("status"))


# The report format's elements, and what query texts are flagged for.
TABLE_DATA = r"(?is)(<TableData\b[^>]*>.*?</TableData>)"
FORMULA = r"(?is)<Formula\b[^>]*>\s*<!\[CDATA\[(.*?)\]\]>\s*</Formula>"
QUERY = r"(?is)<Query\b[^>]*>\s*<!\[CDATA\[(.*?)\]\]>\s*</Query>"
DATABASE = r"(?is)<DatabaseName\b[^>]*>\s*<!\[CDATA\[(.*?)\]\]>\s*</DatabaseName>"
PARAMETER = r"\$\{\s*([^}]+?)\s*\}"
FLAGS = {"dynamic_param": PARAMETER, "non_select_keyword": r"(?i)\b(insert|update|delete|merge|drop|truncate|alter|create|exec|execute)\b", "string_concat_like": r"\+\s*\w+\s*\+"}


def reports(files: DataFrame) -> DataFrame:
    """Queries in report XML (binaryFile rows), of datasets and of formulas that are queries: path, kind, name, connection, query, parameters, flags, hash."""
    text = F.decode("content", "UTF-8")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    datasets = F.transform(F.regexp_extract_all(text, F.lit(TABLE_DATA), F.lit(1)), lambda b: F.struct(
        F.lit("query").alias("kind"), blank(F.regexp_extract(b, r'(?is)^<TableData\b[^>]*?\bname="([^"]*)"', 1)).alias("name"), blank(F.regexp_extract(b, DATABASE, 1)).alias("connection"), blank(F.regexp_extract(b, QUERY, 1)).alias("query")
    ))
    none = F.lit(None).cast("string")
    formulas = F.transform(F.regexp_extract_all(text, F.lit(FORMULA), F.lit(1)), lambda q: F.struct(F.lit("formula_sql").alias("kind"), none.alias("name"), none.alias("connection"), F.when(q.rlike(r"(?i)^\s*(select|with)\b"), blank(q)).alias("query")))
    rows = files.select("path", F.explode(F.concat(datasets, formulas)).alias("d")).select("path", "d.*").where("query IS NOT NULL")
    flags = F.array_compact(F.array(*[F.when(F.col("query").rlike(p), name) for name, p in FLAGS.items()]))
    return rows.withColumns({"parameters": F.array_distinct(F.regexp_extract_all("query", F.lit(PARAMETER), F.lit(1))), "flags": flags, "hash": F.sha2("query", 256)})
