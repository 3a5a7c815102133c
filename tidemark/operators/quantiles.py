"""Exact grouped quantiles that never hold a whole group in one task.

``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable
sketch gives each group a bracket around the wanted ranks, values below the bracket are
only counted, and just the bracket's distinct values are ranked. A rank that its bracket does
not hold is an error, never a wrong value. Where the bracket's margin would be a rank or two,
the whole range is the bracket. Results equal linear interpolation between order statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL = 4096
ACCURACY = 10000
MARGIN = 0.001  # ten times the sketch's rank error


def grouped_quantiles(table: DataFrame, keys: tuple[str, ...], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per group with a column per wanted ``name: (value column, probability)``.

    Groups without any defined value are left out; join the result to the group table.
    """
    columns = sorted({c for c, _ in wanted.values()})
    values = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])
    group = F.struct(*[F.col(k) for k in keys], F.col("_v.name").alias("_name"))
    long = (table.withColumn("_v", F.explode(values)).where(F.col("_v.x").isNotNull())
            .select(group.alias("_group"), F.col("_v.x").alias("x")))
    probs = sorted({p for _, p in wanted.values()})
    sketch_at = [b for p in probs for b in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    small = F.col("_n") <= SMALL
    ranks = long.groupBy("_group").agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_min"), F.max("x").alias("_max"),
        F.percentile_approx("x", sketch_at, ACCURACY).alias("_at"))
    brackets = F.array(*[F.struct(
        F.lit(p).alias("p"), (F.lit(p) * (F.col("_n") - 1)).alias("h"),
        F.when(small, F.col("_min")).otherwise(F.get("_at", 2 * i)).alias("low"),
        F.when(small, F.col("_max")).otherwise(F.get("_at", 2 * i + 1)).alias("high")) for i, p in enumerate(probs)])
    ranks = ranks.select("_group", brackets.alias("_brackets"))
    placed = (long.join(ranks, "_group").withColumn("_b", F.explode("_brackets"))
              .where(F.col("x") <= F.col("_b.high"))
              .groupBy("_group", F.col("_b.p").alias("_p"), F.col("_b.h").alias("_h"),
                       F.when(F.col("x") >= F.col("_b.low"), F.col("x")).alias("_x"))
              .agg(F.count(F.lit(1)).alias("_rows")))
    upto = (Window.partitionBy("_group", "_p").orderBy(F.col("_x").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_upto", F.sum("_rows").over(upto))

    def at_rank(rank):
        # Values below the bracket have a null for all of them, so a rank among those is not found either.
        found = F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_rows") <= rank), F.col("_x")))
        return F.coalesce(found, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))

    low, high = at_rank(F.floor("_h")), at_rank(F.ceil("_h"))
    found = placed.groupBy("_group", "_p", "_h").agg(low.alias("_low"), high.alias("_high")).withColumn(
        "_q", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_h") - F.floor("_h")))
    picks = [F.max(F.when((F.col("_group._name") == c) & (F.col("_p") == p), F.col("_q"))).alias(name)
             for name, (c, p) in wanted.items()]
    return found.groupBy(*[F.col(f"_group.{k}").alias(k) for k in keys]).agg(*picks)


def with_quantiles(groups: DataFrame, table: DataFrame, keys: tuple[str, ...],
                   wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Left join of the quantiles to a table with one row per group; keys may be NULL."""
    found = grouped_quantiles(table, keys, wanted)
    renamed = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *wanted)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return groups.join(renamed, same, "left").drop(*[f"_k_{k}" for k in keys])
