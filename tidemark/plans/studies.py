"""Ledgers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import calendar, outcomes
from tidemark.plans import market
from tidemark.plans.market import kept

HISTORY_YEARS = 2


@kept
def split_signals(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.with_split(market.signals(spark, folder),
                               calendar.split_dates(market.context(spark, folder)))


@kept
def folds(spark: SparkSession, folder: str) -> DataFrame:
    return calendar.annual_folds(market.context(spark, folder), initial_history_years=HISTORY_YEARS)


def requested(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol seen in the ticks and one that never traded."""
    seen = market.bars(spark, folder).select("ticker").distinct()
    missing = market.index(spark, folder).select(F.lit("XX").alias("ticker")).distinct()
    return seen.unionByName(missing)


def membership(spark: SparkSession, folder: str) -> DataFrame:
    """Two intervals per symbol, the second one open, placed by its own history."""
    spans = market.bars(spark, folder).groupBy("ticker").agg(F.min("timestamp").alias("first"))
    return spans.select("ticker", F.explode(F.array(
        F.struct(F.date_add("first", 300).alias("start_date"), F.date_add("first", 1400).alias("end_date")),
        F.struct(F.date_add("first", 1500).alias("start_date"), F.lit(None).cast("date").alias("end_date")),
    )).alias("i")).select("ticker", "i.start_date", "i.end_date")


@kept
def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Signal rows of each fold's test year, with membership and regime.

    Flags are masked by membership and fold; rising edges are never recomputed.
    """
    table = market.signals(spark, folder).withColumn("regime", calendar.regime())
    table = calendar.with_membership(calendar.test_fold(table, folds(spark, folder)), membership(spark, folder))
    return table


@kept
def fold_signals(spark: SparkSession, folder: str) -> DataFrame:
    """All signal rows, tagged with their fold where they have one; the bars between stay.

    Paths may use any bar up to ``test_end``, so rows outside a test year keep no flags.
    """
    table = market.signals(spark, folder).withColumn("regime", calendar.regime())
    years = folds(spark, folder).select(F.year("test_start").alias("_year"), "fold", "test_start", "test_end")
    table = (table.withColumn("_year", F.year("timestamp")).join(F.broadcast(years), "_year", "left").drop("_year"))
    table = calendar.with_membership(table, membership(spark, folder))
    usable = F.col("member") & F.coalesce(F.col("timestamp").between(F.col("test_start"), F.col("test_end")), F.lit(False))
    return table.withColumns({
        flag: F.col(flag) & usable for flag in ("dip_ready_v1", "dip_condition_v1", "dip_event_v1")})


@kept
def fold_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Events, eligible rows and non-signals of every fold, censored at its end."""
    table = fold_signals(spark, folder).withColumn("split", F.lit("test"))
    return outcomes.forward_outcomes(
        table, selections=("events", "eligible", "non_signal"), until="test_end", keep=("fold", "regime"))


@kept
def fold_single(spark: SparkSession, folder: str) -> DataFrame:
    """Default barriers for every event of every fold."""
    table = fold_signals(spark, folder).withColumn("split", F.lit("test"))
    ledger = outcomes.barrier_trades(table, until="test_end", commission=fixed.COMMISSION, slippage=fixed.SLIPPAGE)
    return ledger.select("fold", "regime", "position", *outcomes.TRADE_COLUMNS)


@kept
def fold_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Both modes of the default barriers in every fold."""
    single = fold_single(spark, folder)
    return single.withColumn("mode", F.lit("independent")).unionByName(
        outcomes.thin(single, keys=("fold", "ticker")).withColumn("mode", F.lit("non_overlapping")))
