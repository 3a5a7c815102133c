"""Stored bar and ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import symbols
from tidemark.sources import quality

BAR_SCHEMA = T.StructType([
    T.StructField("timestamp", T.DateType()), T.StructField("ticker", T.StringType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType())])


def write_bars(bars: DataFrame, path: str) -> None:
    """One directory per symbol; a new write replaces just the symbols it holds."""
    (bars.select(*BAR_SCHEMA.names).write.mode("overwrite").option("compression", "zstd")
     .option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(path))


def read_bars(spark: SparkSession, path: str, *, tickers: list[str] | None = None,
              start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some or all symbols in ``[start, end)``: partitions pruned, dates pushed down."""
    bars = spark.read.schema(BAR_SCHEMA).parquet(path)
    if tickers is not None:
        bars = bars.where(F.col("ticker").isin(sorted({t.strip().upper() for t in tickers})))
    if start is not None:
        bars = bars.where(F.col("timestamp") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("timestamp") < F.lit(end).cast("date"))
    return bars.select(*BAR_SCHEMA.names)


SCHEMA_VERSION = 1
INTERVAL = "1d"


def write_snapshot(bars: DataFrame, path: str, ranges: DataFrame, *, source: str, interval: str = INTERVAL) -> None:
    """Bars under ``path`` with a catalogue of what each symbol's snapshot was asked for.

    ``ranges`` has ``ticker, saved_start, saved_end`` (end exclusive). Bars that break a rule are refused before
    anything is written. A new snapshot of a symbol replaces its bars and its catalogue row; other symbols stay.
    """
    quality.require_sound(bars)
    write_bars(bars, f"{path}/bars")
    held = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    rows = ranges.join(held, "ticker").select(
        "ticker", "saved_start", "saved_end", "rows", F.lit(source).alias("source"), F.lit(interval).alias("interval"),
        F.lit(SCHEMA_VERSION).alias("schema_version"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(f"{path}/catalogue"))


CATALOGUE_SCHEMA = ("saved_start date, saved_end date, rows long, source string, interval string, schema_version int, ticker string")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOGUE_SCHEMA).parquet(f"{path}/catalogue")


def refusals(catalogue: DataFrame, requested: DataFrame) -> DataFrame:
    """Requests (``ticker, start, end``, end exclusive; null for all there is) no snapshot can answer, with the reason."""
    asked = requested.select(symbols.normalized(F.col("ticker")).alias("ticker"), "start", "end")
    reason = (F.when(~symbols.is_valid(F.col("ticker")), "bad_symbol").when(F.col("start") >= F.col("end"), "empty_range")
              .when(F.col("schema_version").isNull(), "missing")
              .when((F.col("schema_version") != SCHEMA_VERSION) | (F.col("interval") != INTERVAL), "unsupported")
              .when((F.col("saved_start") > F.col("start")) | (F.col("saved_end") < F.col("end")), "not_covered"))
    found = asked.join(catalogue.select("ticker", "saved_start", "saved_end", "interval", "schema_version"), "ticker", "left")
    return found.select("ticker", "start", "end", reason.alias("reason")).where("reason is not null")


def scan(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    """Bars of all requests (``ticker, start, end``), each once even if requests overlap.

    Raises if any request is not covered. The catalogue drives the scan: symbols join as the partitions to read,
    which Spark prunes when it runs, and the widest range of all requests is pushed down to the files.
    """
    catalogue = read_catalogue(spark, path)
    bad = refusals(catalogue, requested).limit(5).collect()
    if bad:
        raise ValueError("no snapshot for " + ", ".join(f"{r['ticker']} ({r['reason']})" for r in bad))
    asked = requested.select(symbols.normalized(F.col("ticker")).alias("ticker"), "start", "end").distinct()
    widest = asked.agg(*[F.count_if(F.col(c).isNull()).alias(f"open_{c}") for c in ("start", "end")], F.min("start").alias("start"),
                       F.max("end").alias("end")).first()
    bars = spark.read.schema(BAR_SCHEMA).parquet(f"{path}/bars")
    if not widest["open_start"] and widest["start"] is not None:
        bars = bars.where(F.col("timestamp") >= F.lit(widest["start"]))
    if not widest["open_end"] and widest["end"] is not None:
        bars = bars.where(F.col("timestamp") < F.lit(widest["end"]))
    chosen = catalogue.where(_supported()).join(asked.select("ticker").distinct(), "ticker").select("ticker")
    ranges = asked.groupBy("ticker").agg(F.collect_set(F.struct("start", "end")).alias("_ranges"))
    rows = bars.join(chosen, "ticker").join(ranges, "ticker")
    wanted = F.exists("_ranges", lambda r: F.coalesce(F.col("timestamp") >= r.start, F.lit(True)) &
                      F.coalesce(F.col("timestamp") < r.end, F.lit(True)))
    return rows.where(wanted).select(*BAR_SCHEMA.names)


def _supported() -> Column:
    return (F.col("schema_version") == SCHEMA_VERSION) & (F.col("interval") == INTERVAL)


def uncovered(catalogue: DataFrame, requested: DataFrame, start, end) -> DataFrame:
    """Requested symbols whose stored range does not hold ``[start, end)``."""
    held = catalogue.where((F.col("saved_start") <= start) & (F.col("saved_end") >= end))
    return requested.join(held, "ticker", "left_anti")


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """Small result tables as CSV; Spark prints doubles so that they read back unchanged."""
    summary.write.mode("overwrite").option("header", True).csv(path)
