"""Fields of extracted items brought into order: moved to the item they belong to, parted by instance, merged, split and confirmed.

Fields are rows (doc, item, kind, seq, name, value): an item of a document with its kind, and a field of it by place,
name and value. All steps are joins, windows and aggregates by document and item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A number from 1 to 99 at a name's end is an instance.
_INDEXED = r"^(.*?)[\s_#-]*([1-9][0-9]?)#?$"


def redirected(fields: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The fields whose name fits a rule (pattern, kind) moved to the first item of that kind in their document, if it has one; moved_from is the item before."""
    wants = reduce(lambda c, r: c.when(F.lower("name").rlike(r[0]) & ~F.col("kind").eqNullSafe(F.lit(r[1])), r[1]), rules, F.when(F.lit(False), ""))
    homes = fields.where(F.col("kind").isin(*[k for _, k in rules])).groupBy("doc", F.col("kind").alias("wanted")).agg(F.min("item").alias("home"))
    moved = fields.withColumn("wanted", wants).join(homes, ["doc", "wanted"], "left")
    goes = F.col("home").isNotNull()
    return moved.select("doc", F.coalesce("home", "item").alias("item"), F.when(goes, F.col("wanted")).otherwise(F.col("kind")).alias("kind"), "seq", "name", "value", F.when(goes, F.col("item")).alias("moved_from"))


def indexed(fields: DataFrame) -> DataFrame:
    """The fields with `base` and `n`: a name's number at the end parted from it; n is null where there is none."""
    n = F.regexp_extract("name", _INDEXED, 2).try_cast("int")
    return fields.withColumn("n", n).withColumn("base", F.when(n.isNotNull(), F.regexp_extract("name", _INDEXED, 1)).otherwise(F.col("name")))


def split_instances(fields: DataFrame, primary: str = r"(型号|model)$") -> DataFrame:
    """Items whose numbered fields tell of several instances, as an item for each of these: doc, item, kind, seq, name, value, split_from.

    The instances need something that tells them apart: a numbered field whose name fits `primary` for each of them, or as
    many plain ones, which are dealt out by place. The first instance keeps the item's number, others get the document's
    next free ones. Fields without a number go to every instance. Items that can't be split stay as they are.
    """
    f = indexed(fields)
    item = ["doc", "item"]
    # Names are compared in small letters; of several that fit, the least leads.
    many = f.where("n IS NOT NULL").groupBy(*item).agg(F.array_sort(F.collect_set("n")).alias("ns")).where(F.size("ns") > 1)
    lead = f.where(F.lower("base").rlike(primary))
    numbered = lead.where("n IS NOT NULL").groupBy(*item, F.lower("base").alias("leader")).agg(F.count_distinct("n").alias("k"))
    plain = lead.where("n IS NULL").groupBy(*item, F.lower("base").alias("leader")).agg(F.count("*").alias("k"))
    fits = lambda d: many.join(d, item).where(F.col("k") == F.size("ns")).groupBy(*item).agg(F.min("leader").alias("leader"))
    leaders = fits(numbered).select(*item, F.lit(None).cast("string").alias("dealt")).unionByName(fits(plain).join(fits(numbered), item, "left_anti").select(*item, F.col("leader").alias("dealt")))
    parts = many.join(leaders, item).select(*item, "dealt", F.posexplode("ns").alias("place", "n"))
    last = fields.groupBy("doc").agg(F.max("item").alias("last"))
    free = F.row_number().over(Window.partitionBy("doc").orderBy("item", "place"))
    later = parts.where("place > 0").withColumn("free", free).join(last, "doc").select(*item, "place", (F.col("last") + F.col("free")).alias("new"))
    parts = parts.join(later, [*item, "place"], "left").select(*item, "dealt", "place", "n", F.coalesce("new", "item").alias("new"))
    # A plain leading field belongs to the instance of its own place among them.
    order = F.row_number().over(Window.partitionBy(*item, F.lower("base"), F.col("n").isNull()).orderBy("seq")) - 1
    f = f.withColumn("own", order)
    p = parts.alias("p")
    both = f.alias("f").join(p, [F.col(f"f.{c}") == F.col(f"p.{c}") for c in item])
    is_dealt = F.col("f.n").isNull() & (F.lower("f.base") == F.col("p.dealt"))
    here = F.when(F.col("f.n").isNotNull(), F.col("f.n") == F.col("p.n")).when(F.coalesce(is_dealt, F.lit(False)), F.col("f.own") == F.col("p.place")).otherwise(True)
    out = both.where(here).select("f.doc", F.col("p.new").alias("item"), "f.kind", "f.seq", F.col("f.base").alias("name"), "f.value", F.col("f.item").alias("split_from"))
    rest = f.join(parts.select(*item).distinct(), item, "left_anti")
    return out.unionByName(rest.select("doc", "item", "kind", "seq", "name", "value", F.lit(None).cast(fields.schema["item"].dataType).alias("split_from")))


def merged(fields: DataFrame) -> DataFrame:
    """One row for each name of an item: doc, item, name, shape and `values`.

    One value is a `scalar`, several of one name a `list` in their order, and numbered ones an `indexed` list in which each
    stands at its number, with nulls between; of two with one number the later stays.
    """
    f = indexed(fields)
    by = f.groupBy("doc", "item", F.col("base").alias("name")).agg(
        F.max_by(F.struct("n"), "n").alias("top"), F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.struct("seq", "value")))).alias("plain"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "seq", "value")))).alias("numbered"),
    )
    placed = F.transform(F.sequence(F.lit(1), F.col("top.n")), lambda i: F.try_element_at(F.transform(F.filter("numbered", lambda x: x["n"] == i), lambda x: x["value"]), F.lit(-1)))
    plain = F.transform("plain", lambda x: x["value"])
    indexed_ = F.size("numbered") > 0
    shape = F.when(indexed_, "indexed").when(F.size("plain") > 1, "list").otherwise("scalar")
    return by.select("doc", "item", "name", shape.alias("shape"), F.when(indexed_, F.concat(placed, plain)).otherwise(plain).alias("values"))


def composite(name: Column, value: Column, rules: list[tuple[str, str, tuple[str, ...]]]) -> Column:
    """array<struct(name, value)> of the first rule (name pattern, value pattern with groups, names of the groups) that fits; empty if none does. Groups that are empty give no field."""
    out = F.array().cast("array<struct<name:string,value:string>>")
    for at, pattern, names in reversed(rules):
        parts = F.array(*[F.struct(F.lit(n).alias("name"), F.trim(F.regexp_extract(value, pattern, i)).alias("value")) for i, n in enumerate(names, 1)])
        out = F.when(F.lower(name).rlike(at) & value.rlike(pattern), F.filter(parts, lambda x: x["value"] != "")).otherwise(out)
    return out


def confirmation(kind: Column, known: Column, unit: Column, low: Column, high: Column, number: Column, flag: Column, date: Column, text: Column, free: Column) -> Column:
    """By what a field's value is confirmed, the first of: a dictionary's word, a number with a known unit, a range, a number, yes or no, a date, free text where that is allowed; else `unconfirmed`.

    kind is what the field is to hold (enum, measure, number, boolean, date or text); the others are what was read from it.
    """
    return (
        F.when(known.isNotNull(), "dictionary").when((kind == "measure") & unit.isNotNull() & F.coalesce(number, low).isNotNull(), "unit")
        .when(kind.isin("measure", "number") & low.isNotNull() & high.isNotNull(), "range").when((kind == "number") & number.isNotNull(), "number")
        .when((kind == "boolean") & flag.isNotNull(), "boolean").when((kind == "date") & date.isNotNull(), "date")
        .when((kind == "text") & free & (F.trim(text) != ""), "text").otherwise("unconfirmed")
    )
