"""Audits in one scan: how many rows each finding holds for, how many of them can be mended, and the first few as samples.

Every task keeps a count and its first rows for each finding, whatever it reads;
these few rows are merged, so nothing of the table is shuffled or sorted.

Defined cases: a condition that is null doesn't hold; nulls come first in the
order; rows that repeat whole are counted and shown each; a finding that holds
for no row isn't listed; an empty table has no findings; columns of the table may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.workspace import saved

SAMPLES = 10


@dataclass(frozen=True)
class Finding:
    name: str
    severity: str
    holds: Column
    mendable: Column | None = None
    least: int = 1  # it is a finding only from so many rows on


def audit(rows: DataFrame, findings: list[Finding], order: dict[str, Column], sample: dict[str, Column], most: int = SAMPLES) -> DataFrame:
    """finding, severity, n, mendable and samples: the first `most` rows by `order`, then by their own values, as structs of `sample` and whether each is mendable."""
    if len({f.name for f in findings}) < len(findings):
        raise ValueError("findings need names of their own")
    yes = lambda c: F.coalesce(c, F.lit(False))
    keys, shown = [f"k{i}" for i in range(len(order))], [f"s{i}" for i in range(len(sample))]
    flags = [f"f{i}" for i in range(len(findings))]
    chosen = rows.select(
        *[c.alias(k) for k, c in zip(keys, order.values(), strict=True)], *[c.alias(s) for s, c in zip(shown, sample.values(), strict=True)],
        *[yes(f.holds).alias(n) for n, f in zip(flags, findings, strict=True)], *[yes(f.mendable if f.mendable is not None else F.lit(False)).alias(f"m{i}") for i, f in enumerate(findings)],
    )
    kinds = dict(chosen.dtypes)
    types = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *shown))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * len(flags)
        count, mend = [0] * len(flags), [0] * len(flags)
        for b in batches:
            table = pa.Table.from_batches([b])
            for i, flag in enumerate(flags):
                own = table.filter(table.column(flag))
                if not own.num_rows:
                    continue
                count[i] += own.num_rows
                mend[i] += pc.sum(own.column(f"m{i}").cast(pa.int64())).as_py() or 0
                own = own.select([*keys, *shown, f"m{i}"]).rename_columns([*keys, *shown, "mendable"])
                own = own if held[i] is None else pa.concat_tables([held[i], own])
                by = [(c, "ascending") for c in own.column_names if not pa.types.is_nested(own.schema.field(c).type)]
                held[i] = own.take(pc.sort_indices(own, sort_keys=by, null_placement="at_start")[:most])
        for i, own in enumerate(held):
            if own is None:
                continue
            n = own.num_rows
            own = own.append_column("finding", pa.array([i] * n, pa.int32()))
            own = own.append_column("n", pa.array([count[i]] + [0] * (n - 1), pa.int64())).append_column("mended", pa.array([mend[i]] + [0] * (n - 1), pa.int64()))
            yield from own.combine_chunks().to_batches()

    parts = saved(chosen.mapInArrow(first, f"{types}, mendable boolean, finding int, n long, mended long"))  # a few rows a task
    place = F.row_number().over(Window.partitionBy("finding").orderBy(*[F.asc_nulls_first(c) for c in (*keys, *shown, "mendable") if not kinds.get(c, "").startswith(("array", "map", "struct"))]))
    best = parts.withColumn("place", place).where(F.col("place") <= most)
    shape = F.struct(*[F.col(s).alias(n) for s, n in zip(shown, sample, strict=True)], F.col("mendable"))
    samples = best.groupBy("finding").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", shape.alias("row")))), lambda x: x["row"]).alias("samples"))  # at most `most` rows
    totals = parts.groupBy("finding").agg(F.sum("n").alias("n"), F.sum("mended").alias("mendable"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("finding") + 1)
    out = totals.join(samples, "finding").where(F.col("n") >= pick([f.least for f in findings]))
    return out.select(pick([f.name for f in findings]).alias("finding"), pick([f.severity for f in findings]).alias("severity"), "n", "mendable", "samples")


def repeated(rows: DataFrame, key: Column, owner: Column, most: int = SAMPLES) -> DataFrame:
    """Keys that several owners have, such as an alias of two types: key, n, owners (how many) and the first few of them. Null keys are none."""
    pairs = rows.select(key.alias("key"), owner.alias("owner")).where(F.col("key").isNotNull()).groupBy("key", "owner").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_first("owner")))
    few = pairs.withColumn("place", place).where(F.col("place") <= most).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "owner"))), lambda x: x["owner"]).alias("first"))
    several = pairs.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("owners")).where(F.col("owners") > 1)
    return several.join(few, "key").select("key", "n", "owners", "first")
