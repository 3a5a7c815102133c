"""The driver tables seen as ticks, bars, an index, features and signals."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, signals as signal_ops
from tidemark.sources import bars as bar_ops
from tidemark.storage import scratch_folder

INDEX = "ALL"
TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_KEPT: WeakKeyDictionary = WeakKeyDictionary()


def kept(build):
    """Write a bar-sized table once and let every later step read it from there.

    This cuts lineage: plans stay small, a lost executor costs no recomputation, and each
    reader prunes columns and pushes filters into the written files. Tables are written
    once per session and source folder; ``forget`` makes the next use write them anew.
    """
    @wraps(build)
    def table_of(spark: SparkSession, folder: str) -> DataFrame:
        tables = _KEPT.setdefault(spark, {})
        key = (build.__module__, build.__name__, folder)
        if key not in tables:
            frame = build(spark, folder)
            path = f"{scratch_folder(spark)}/{build.__name__}-{uuid.uuid4().hex}"
            frame.write.parquet(path)
            tables[key] = spark.read.schema(frame.schema).parquet(path)
        return tables[key]
    return table_of


def kept_folder(spark: SparkSession, folder: str, name: str, write: Callable[[str], None]) -> str:
    """Folder that ``write`` has filled, once per session and source folder; for layouts of several tables."""
    tables = _KEPT.setdefault(spark, {})
    if (name, folder) not in tables:
        path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write(path)
        tables[name, folder] = path
    return tables[name, folder]


def forget(spark: SparkSession) -> None:
    """Stop reusing the tables written so far in this session."""
    _KEPT.pop(spark, None)


@kept
def merged_bars(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bar_ops.bars_from_ticks(
        table(spark, folder, "lineitem"), at=F.to_date("l_shipdate"),
        series=F.concat("l_returnflag", "l_linestatus"), price=price,
        size=F.col("l_quantity"), order=TICK_ORDER)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.plain(merged_bars(spark, folder))


def partitions_for(scan: DataFrame) -> int:
    """Partitions for a shuffle of all rows of a table read from files: they grow with the files, so that a task's
    rows still fit its memory when the session's own number was meant for less."""
    own = int(scan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, 4 * scan.rdd.getNumPartitions())


@kept
def wide_bars(spark: SparkSession, folder: str) -> DataFrame:
    """The same ticks as one series for each supplier: a universe that grows with the data."""
    ticks = table(spark, folder, "lineitem")
    return bar_ops.plain(bar_ops.bars_from_ticks(
        ticks, at=F.to_date("l_shipdate"), series=F.concat(F.lit("S"), F.col("l_suppkey")),
        price=F.col("l_extendedprice") / F.col("l_quantity"), size=F.col("l_quantity"), order=TICK_ORDER, spread=partitions_for(ticks)))


def index(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.plain(bar_ops.merge_bars(merged_bars(spark, folder), INDEX))


def hourly_event_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.plain(bar_ops.bars_from_ticks(
        table(spark, folder, "events"), at=F.date_trunc("hour", "ts").cast("timestamp_ntz"),
        series=F.col("event_type"), price=F.col("value"), size=F.lit(1), order=["ts", "event_id"]))


def order_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.plain(bar_ops.bars_from_ticks(
        table(spark, folder, "orders"), at=F.to_date("o_orderdate"),
        series=F.regexp_extract("o_orderpriority", "^([^-]+)", 1), price=F.col("o_totalprice"),
        size=F.lit(1), order=["o_orderkey"]))


@kept
def context(spark: SparkSession, folder: str) -> DataFrame:
    """One row per session: the index, its trailing measures and the session number."""
    return features.index_context(index(spark, folder))


@kept
def signals(spark: SparkSession, folder: str) -> DataFrame:
    return signal_ops.build_signals(bars(spark, folder), context(spark, folder))


@kept
def wide_signals(spark: SparkSession, folder: str) -> DataFrame:
    rows = wide_bars(spark, folder)
    return signal_ops.build_signals(rows, context(spark, folder), only_inputs=True, spread=partitions_for(rows))
