"""Scans in order over groups of any size.

Rows are dealt by ranges of (group, order), so that a large group is cut into many
ranges, each of which a task scans by itself.  What a range hands on (a count, a
minimum, ...) is a row of a summary table; the values carried into each range are
running totals over that table, which is small, and are joined back to the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions.lineage import checkpointed

PART = "__part"


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df dealt by ranges, with the range's number in PART. Ranges are cut at sampled keys: they are written down, so that a repeated task finds the same ones."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(ranges, *by, *order).withColumn(PART, F.spark_partition_id()))


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, null meeting null."""
    renamed = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= left[k].eqNullSafe(renamed[f"__k{i}"])
    return left.join(renamed, on, how).drop(*(f"__k{i}" for i in range(len(keys))))


def carried(ranged: DataFrame, by: list[str], partial: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
    """A row per range of each group: by, PART and, for each name, merge over the partial results of the ranges before (null for the first)."""
    summary = ranged.groupBy(*by, PART).agg(*(v.alias(k) for k, v in partial.items()))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*by, PART, *(merge[k].over(before).alias(k) for k in partial))


def numbered(ranged: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds each row's number within its group, from 1."""
    counts = carried(ranged, by, {"__before": F.count("*")}, {"__before": F.sum("__before")})
    local = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*by, PART).orderBy(*order)))
    return same(local, counts, [*by, PART]).withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__before")


def quantiles(df: DataFrame, by: list[str], col: str, shares: list[float]) -> DataFrame:
    """by, k (the place in shares) and value: exact quantiles of each group, linear between neighbours; nulls do not count.

    Equal values are counted first, so that no value, however common, is more than a
    row.  Each wanted rank is looked up in the one range where it falls.
    """
    c = F.col
    counts = df.select(*by, c(col).cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__count"))
    ranged = in_ranges(counts, by, ["__v"])
    parts = ranged.groupBy(*by, PART).agg(F.sum("__count").alias("__size"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__size").over(group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, PART, before.alias("__at"), F.sum("__size").over(group).alias("__n"))
    wanted = F.posexplode(F.array(*(F.lit(float(s)) for s in shares))).alias("k", "__share")
    ranks = parts.filter("__at = 0").select(*by, "__n", wanted).withColumn("__exact", c("__share") * (c("__n") - 1)).withColumn("__low", F.floor("__exact"))
    ranks = ranks.select(*by, "k", (c("__exact") - c("__low")).alias("__part_of"), F.explode(F.array(F.struct(F.lit(0).alias("side"), c("__low").alias("at")), F.struct(F.lit(1).alias("side"), F.least(c("__low") + 1, c("__n") - 1).alias("at")))).alias("__r"))
    ranks = ranks.select(*by, "k", "__part_of", c("__r.side").alias("__side"), c("__r.at").alias("__at"))

    def looked_up(keys: list[str], held: DataFrame, found: str) -> DataFrame:
        """ranks with the last `found` of held (by, __at) at or before their place."""
        mark = held.select(*keys, "__at", F.lit(0).alias("__kind"), found, *(F.lit(None).cast(t).alias(x) for x, t in ranks.dtypes if x not in (*keys, "__at")))
        asked = ranks.select(*keys, "__at", F.lit(1).alias("__kind"), F.lit(None).cast(dict(held.dtypes)[found]).alias(found), *(x for x in ranks.columns if x not in (*keys, "__at")))
        last = F.last(found, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__at", "__kind"))
        return mark.unionByName(asked).withColumn(found, last).filter("__kind = 1").drop("__kind")

    ranks = looked_up(by, parts, PART)
    local = F.coalesce(F.sum("__count").over(Window.partitionBy(*by, PART).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = same(ranged.withColumn("__local", local), parts.select(*by, PART, "__at"), [*by, PART]).withColumn("__at", c("__at") + c("__local"))
    found = looked_up([*by, PART], placed, "__v").groupBy(*by, "k").agg(
        F.max(F.when(c("__side") == 0, c("__v"))).alias("__low"), F.max(F.when(c("__side") == 1, c("__v"))).alias("__high"), F.max("__part_of").alias("__part_of"),
    )
    return found.select(*by, "k", (c("__low") + (c("__high") - c("__low")) * c("__part_of")).alias("value"))
