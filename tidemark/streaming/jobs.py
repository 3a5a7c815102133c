"""Structured Streaming counterparts of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.decisions import timing_class
from tidemark.streaming.state import SERIES_SCHEMA, SeriesProcessor


def bar_stream(ticks: DataFrame, *, at: str, series: Column, price: Column, size: Column, order: list[str],
               width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Ticks to tumbling bars; a bar is emitted once the watermark has passed its end.

    State per open bar is a first tick, a last tick and three numbers, merged map-side.
    """
    tick = F.struct(*[F.col(c) for c in order], price.alias("price"))
    prepared = ticks.withWatermark(at, late).select(
        F.col(at).alias("_at"), series.alias("ticker"), tick.alias("tick"), size.alias("size"))
    bars = prepared.groupBy(F.window("_at", width).alias("_w"), "ticker").agg(
        F.min("tick").alias("first"), F.max("tick").alias("last"), F.max("tick.price").alias("high"),
        F.min("tick.price").alias("low"), F.sum("size").cast("long").alias("volume"))
    return bars.select(F.col("_w.start").alias("timestamp"), "ticker", F.col("first.price").alias("open"), "high", "low",
                       F.col("last.price").alias("close"), "volume")


def unique_bars(bars: DataFrame, *, at: str = "timestamp", late: str = "3 days") -> DataFrame:
    """Bars ingested once: copies equal in all columns that arrive within the watermark are dropped.

    Bars of one key with different contents all pass; ``checked_bars`` tells them apart in the stream, ``conflicts`` in a table.
    """
    return bars.withWatermark(at, late).dropDuplicatesWithinWatermark(bars.columns)


def checked_bars(bars: DataFrame, *, at: str = "timestamp", late: str = "3 days") -> DataFrame:
    """Each content of a key (``at``, ticker) once, with ``conflict`` where the key came with several.

    A key is held until the watermark has passed it, so the outcome is the same in whatever order and batches its rows
    arrive, and none of several contents is chosen. Its state is its distinct contents; it goes when they are emitted. Rows
    later than ``late`` behind the newest are dropped by Spark, which counts them in the query's progress. Keys
    may be null in the ticker, not in ``at``.
    """
    content = F.struct(*[F.col(c) for c in bars.columns])
    held = (bars.withWatermark(at, late).select(F.col(at).alias("_at"), F.col("ticker").alias("_ticker"), content.alias("_content"))
            .groupBy("_at", "_ticker").agg(F.collect_set("_content").alias("_contents")))
    return (held.select(F.explode("_contents").alias("_content"), (F.size("_contents") > 1).alias("conflict"))
            .select("_content.*", "conflict"))


def routed(accept: Callable[[DataFrame], None], reject: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for ``checked_bars`` that hands sound bars to one sink and conflicting ones to another."""
    def batch(bars: DataFrame, _: int) -> None:
        accept(bars.where("not conflict").drop("conflict"))
        reject(bars.where("conflict").drop("conflict"))
    return batch


def conflicts(bars: DataFrame, *, at: str = "timestamp") -> DataFrame:
    """Bars of a table whose key occurs with more than one content: to be rejected, not chosen from."""
    several = bars.distinct().groupBy(at, "ticker").count().where("count > 1").drop("count")
    return bars.join(several, [at, "ticker"], "left_semi")


def edges_and_range(rows: DataFrame, *, window: int = 14) -> DataFrame:
    """Rising edges and Wilder range per symbol, carried across micro-batches, each row answered in its own batch.

    Input: ``timestamp, ticker, high, low, close, dip_condition_v1``, in order between batches; rows of a batch are sorted first.
    """
    fed = rows.withColumns({"open": F.lit(None).cast("double"), "micros": F.unix_micros("timestamp")})
    found = fed.groupBy("ticker").transformWithState(SeriesProcessor(window=window), SERIES_SCHEMA, "append", "None")
    return found.where("trade is null").select(F.timestamp_micros("micros").alias("timestamp"), "ticker", "dip_event_v1", "atr")


def series_state(rows: DataFrame, *, window: int = 14, holding: int = fixed.HOLDING_BARS, stop: float | None = fixed.STOP_LOSS,
                 target: float | None = fixed.TAKE_PROFIT, late: str = "3 days", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """Rising edges, Wilder range and non-overlapping trades per symbol, in event time.

    Input: ``timestamp, ticker, open, high, low, close, dip_condition_v1``. Rows wait until the watermark, ``late`` behind the newest,
    has passed them and are then taken in order of time, so any split into batches gives the results of the batch
    operators. Each row is answered once (``trade`` null); each event is answered again with its trade once its window is
    full. A symbol without rows for ``idle`` is closed: windows still open get their status, and its state goes. Rows behind the
    watermark are dropped by Spark, which counts them; of rows of one symbol and time the first to arrive counts.
    """
    processor = SeriesProcessor(window=window, holding=holding, stop=stop, target=target, idle=idle, ordered=True)
    found = (rows.withWatermark("timestamp", late).withColumn("micros", F.unix_micros("timestamp")).groupBy("ticker")
             .transformWithState(processor, SERIES_SCHEMA, "append", "EventTime"))
    trade = F.col("trade")
    return found.select(
        F.timestamp_micros("micros").alias("timestamp"), "ticker", "position", "dip_event_v1", "atr",
        F.when(trade.isNotNull(), F.struct(
            trade.status.alias("status"), F.timestamp_micros(trade.entry_micros).alias("entry_timestamp"),
            trade.entry_price.alias("entry_price"), F.timestamp_micros(trade.exit_micros).alias("exit_timestamp"),
            *[trade[c].alias(c) for c in ("exit_price", "exit_reason", "fill_type", "holding_bars", "ambiguous_bar")])).alias("trade"))


def label_timing(effective_session: Column, sink: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that classifies each batch of records before ``sink``."""
    def batch(records: DataFrame, _: int) -> None:
        sink(records.withColumn("classification", timing_class(effective_session)))
    return batch
