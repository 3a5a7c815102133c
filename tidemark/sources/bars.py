"""Bars from ticks: one pre-aggregated pass, then roll-ups of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed


def bars_from_ticks(ticks: DataFrame, *, at: Column, series: Column, price: Column,
                    size: Column, order: list[str], spread: int | None = None) -> DataFrame:
    """Open, high, low, close and volume per series and period.

    ``order`` names the columns that rank ticks inside a bar and must rank them fully.
    Each map task folds its ticks into partial bars first, so a hot series costs one
    partial bar per task in the shuffle, not its ticks. ``first_tick`` and ``last_tick``
    stay on the row so that bars can be merged further without going back to the ticks.

    In a wide universe nearly every tick is a bar of its own: folding saves nothing there, but sorts
    each map task and ships every tick twice, as the first and the last one. ``spread`` deals the ticks
    themselves to so many partitions by bar, where one sort folds them.
    """
    tick = F.struct(*[F.col(c) for c in order], price.alias("price"))
    dealt = ticks.withColumns({"_at": at, "_series": series})
    if spread is not None:
        dealt = dealt.repartition(spread, "_at", "_series")
    prepared = dealt.select(F.col("_at").alias("timestamp"), F.col("_series").alias("ticker"), tick.alias("tick"),
                            size.alias("size"))
    return _finish(prepared.groupBy("timestamp", "ticker").agg(
        F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"),
        F.max("tick.price").alias("high"), F.min("tick.price").alias("low"),
        F.sum("size").cast("long").alias("volume")))


def merge_bars(bars: DataFrame, ticker: str) -> DataFrame:
    """All series of a period merged into one bar named ``ticker``."""
    return _finish(bars.groupBy("timestamp").agg(
        F.min("first_tick").alias("first_tick"), F.max("last_tick").alias("last_tick"),
        F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("volume").alias("volume")).withColumn("ticker", F.lit(ticker)))


def _finish(merged: DataFrame) -> DataFrame:
    return merged.select(
        "timestamp", "ticker", F.col("first_tick.price").alias("open"), "high", "low",
        F.col("last_tick.price").alias("close"), "volume", "first_tick", "last_tick")


def plain(bars: DataFrame) -> DataFrame:
    return bars.select(*fixed.BAR_COLUMNS)
