"""Cross-sectional summaries over symbols, folds and regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import with_quantiles
from tidemark.operators.stats import share


def in_sets(table: DataFrame, sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each row once per named grouping, keys outside the grouping blanked.

    Grouping by ``grouping`` plus all keys then answers every grouping in one shuffle,
    with partial aggregation before it.
    """
    keys = sorted({k for columns in sets.values() for k in columns})
    kinds = dict(table.dtypes)
    copies = F.array(*[F.struct(F.lit(name).alias("grouping"), *[
        (F.col(k) if k in columns else F.lit(None).cast(kinds[k])).alias(k) for k in keys])
        for name, columns in sets.items()])
    rest = [c for c in table.columns if c not in keys]
    return table.withColumn("_set", F.explode(copies)).select("_set.*", *rest)


def frequency(observations: DataFrame) -> DataFrame:
    """Observed, eligible and ready rows, conditions and events per fold and symbol."""
    ready = F.col("member") & F.col("dip_ready_v1")
    return with_rates(observations.groupBy("fold", "ticker").agg(
        F.min("timestamp").alias("first_date"), F.max("timestamp").alias("last_date"),
        F.count(F.lit(1)).alias("observed"), F.count_if("member").alias("eligible"), F.count_if(ready).alias("ready"),
        F.count_if(ready & F.col("dip_condition_v1")).alias("conditions"),
        F.count_if(ready & F.col("dip_event_v1")).alias("events")))


COUNTS = ("observed", "eligible", "ready", "conditions", "events")


def with_rates(table: DataFrame) -> DataFrame:
    ready, eligible = F.col("ready"), F.col("eligible")
    return table.withColumns({
        "condition_fraction_ready": F.when(ready > 0, F.col("conditions") / ready),
        "condition_fraction_eligible": F.when(eligible > 0, F.col("conditions") / eligible),
        "events_per_252_ready": F.when(ready > 0, 252 * F.col("events") / ready)})


def completed_frequency(counts: DataFrame, every: DataFrame) -> DataFrame:
    """Zero exposure for each requested symbol and fold that has no rows."""
    return every.join(counts, ["fold", "ticker"], "left").withColumns({
        c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in COUNTS})


def frequency_by_fold(counts: DataFrame) -> DataFrame:
    return with_rates(counts.groupBy("fold").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def exclusions(completed: DataFrame, available: DataFrame) -> DataFrame:
    """Requested symbols not measured in a fold, and available ones measured in none."""
    by_fold = completed.where(F.col("ready") == 0).select(
        "ticker", "fold", F.lit("no_ready_oos_observations").alias("reason"))
    never = (completed.groupBy("ticker").agg(F.sum("ready").alias("ready"))
             .where(F.col("ready") == 0).join(available, "ticker", "left_semi")
             .select("ticker", F.lit("all").alias("fold"), F.lit("insufficient_history").alias("reason")))
    return by_fold.unionByName(never)


def concentration(ledger: DataFrame, value: str, requested: DataFrame) -> DataFrame:
    """Per requested symbol: summed returns and shares of the positive and absolute totals, which are one row for all."""
    sums = ledger.where(F.col(value).isNotNull()).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("return_sum"))
    table = requested.select("ticker").join(sums, "ticker", "left").withColumns({
        "count": F.coalesce("count", F.lit(0).cast("long")), "return_sum": F.coalesce("return_sum", F.lit(0.0))})
    gain, size = F.greatest(F.col("return_sum"), F.lit(0.0)), F.abs("return_sum")
    gains, sizes = (table.agg(F.sum(x).alias("total")).scalar() for x in (gain, size))
    return table.select(
        "ticker", "count", "return_sum", F.when(F.col("count") > 0, F.col("return_sum") / F.col("count")).alias("mean"),
        F.when(gains > 0, gain / gains).alias("positive_share"), F.when(sizes > 0, size / sizes).alias("absolute_share"))


def concentration_totals(table: DataFrame, top: int = 5) -> DataFrame:
    """Total, positive, negative and absolute sums with the share of the largest symbols, of which each task hands on ``top``."""
    x = F.col("return_sum")
    winners = table.where(x > 0).orderBy(x.desc(), "ticker").limit(top)
    names = F.array_sort(F.collect_list(F.struct((-x).alias("order"), "ticker")))
    winners = winners.agg(F.struct(F.sum(x).alias("sum"), F.array_join(F.transform(names, lambda n: n.ticker), ",").alias("names")).alias("w")).scalar()
    largest = table.orderBy(F.abs(x).desc(), "ticker").limit(top).agg(F.sum(F.abs(x)).alias("sum")).scalar()
    totals = table.agg(
        F.sum(x).alias("total_sum"), F.sum(F.greatest(x, F.lit(0.0))).alias("positive_sum"),
        F.sum(F.least(x, F.lit(0.0))).alias("negative_sum"), F.sum(F.abs(x)).alias("absolute_sum")).withColumns({"_w": winners, "_l": largest})
    gains, sizes = F.col("positive_sum"), F.col("absolute_sum")
    return totals.select(
        "total_sum", "positive_sum", "negative_sum", "absolute_sum", F.col("_w.names").alias("top_positive_tickers"),
        F.when(gains > 0, F.col("_w.sum") / gains).alias("top_positive_share"), F.when(sizes > 0, F.col("_l") / sizes).alias("top_absolute_share"))


def described(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts, return moments, excursions and matched index return of each group."""
    done = F.col("status") == "completed"
    r, b, excess = (F.when(done, F.col(c)) for c in ("forward_return", "benchmark_return", "excess_return"))
    groups = table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(done).alias("completed"), F.avg(r).alias("mean"),
        share(r > 0, r).alias("win_rate"), F.avg(F.when(done, F.col("mfe"))).alias("mfe"),
        F.avg(F.when(done, F.col("mae"))).alias("mae"), F.avg(b).alias("matched_index"), F.avg(excess).alias("excess"),
        F.count(excess).alias("paired_count"))
    return with_quantiles(groups, table.withColumn("_r", r), by, {"median": ("_r", 0.5)})


def distribution_in_sets(table: DataFrame, values: tuple[str, ...], by: tuple[str, ...],
                         sets: dict[str, tuple[str, ...]], *, undefined: bool = False) -> DataFrame:
    """Spread of several values for each named grouping of ``table``.

    With ``undefined`` a group whose values are all undefined has a row too, with a count of 0.
    """
    long = table.select(*by, *sorted({k for c in sets.values() for k in c}), F.explode(F.array(*[
        F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("x")) for v in values])).alias("_m"))
    long = in_sets(long.select("*", "_m.measure", "_m.x").drop("_m").where(F.col("x").isNotNull() | F.lit(undefined)), sets)
    keys = (*by, "grouping", *sorted({k for c in sets.values() for k in c}), "measure")
    groups = long.groupBy(*keys).agg(F.count("x").alias("count"), F.avg("x").alias("mean"),
                                     F.min("x").alias("minimum"), F.max("x").alias("maximum"))
    return with_quantiles(groups, long, keys, {"median": ("x", 0.5), "q25": ("x", 0.25), "q75": ("x", 0.75)})


RANGES = 64  # of values that are ranked apart


def average_ranks(table: DataFrame, by: tuple[str, ...], column: str) -> DataFrame:
    """Ranks (from 1) of the distinct values of ``column`` in each group, ties at their average: by, column, rank.

    Equal values are counted before they are shuffled. Distinct values are then dealt into ranges between approximate
    quantiles, and a range only needs the number of rows in the ranges below it, so no task ranks a whole group.
    """
    values = table.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    marks = values.groupBy(*by).agg(F.percentile_approx(column, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("_marks"))
    placed = values.join(marks, list(by)).withColumn("_range", F.size(F.filter("_marks", lambda m: m < F.col(column)))).drop("_marks")
    sizes = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows"))
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_range", F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_below"))
    upto = Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_upto", F.sum("_n").over(upto)).join(sizes, [*by, "_range"])
    return placed.select(*by, column, (F.col("_below") + F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))


def rank_correlation(table: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Spearman correlation across symbols, ties at their average rank.

    One row per symbol goes in. Rows where either side is missing are left out first.
    """
    long = table.select(F.explode(F.array(*[F.struct(
        F.lit(a).alias("feature"), F.lit(b).alias("outcome"), F.col(a).cast("double").alias("x"),
        F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("p")).select("p.*")
    pair = ["feature", "outcome"]
    both = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = both
    for c in ("x", "y"):
        ranked = ranked.join(average_ranks(both, tuple(pair), c).withColumnRenamed("rank", f"r{c}"), [*pair, c])
    found = ranked.groupBy("feature", "outcome").agg(
        F.count(F.lit(1)).alias("tickers"),
        F.when((F.count(F.lit(1)) > 2) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0), F.corr("rx", "ry")).alias("spearman"))
    every = long.groupBy("feature", "outcome").agg(F.count(F.lit(1)).alias("_rows"))
    return every.join(found, ["feature", "outcome"], "left").select(
        "feature", "outcome", F.coalesce("tickers", F.lit(0).cast("long")).alias("tickers"), "spearman")


def histogram(table: DataFrame, by: str, value: str, bins: int = 12) -> DataFrame:
    """Equal-width counts over the observed range of each group; the last bin is closed."""
    x = F.col(value)
    limits = table.where(x.isNotNull()).groupBy(by).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))
    # A single value gets a range of one around it.
    flat = F.col("_low") == F.col("_high")
    limits = limits.select(by, F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
                           F.when(flat, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    placed = table.where(x.isNotNull()).join(limits, by).withColumn(
        "bin", F.least(F.floor((x - F.col("_low")) / width), F.lit(bins - 1).cast("long")))
    counts = placed.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = limits.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(counts, [by, "bin"], "left").select(
        by, "bin", (F.col("_low") + width * F.col("bin")).alias("lower"),
        (F.col("_low") + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def compared_to_baselines(summary: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Events beside the unconditional and non-signal means of the same group."""
    def of(selection: str, column: str) -> Column:
        return F.max(F.when(F.col("selection") == selection, F.col(column)))
    event, every, quiet = of("events", "mean"), of("eligible", "mean"), of("non_signal", "mean")
    return summary.groupBy(*by).agg(
        of("events", "count").alias("count"), event.alias("mean"), every.alias("unconditional"), quiet.alias("non_signal"),
        (event - every).alias("difference_unconditional"), (event - quiet).alias("difference_non_signal"),
        of("events", "mean_excess_return").alias("difference_index"))
