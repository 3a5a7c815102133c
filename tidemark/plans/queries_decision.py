"""Registered queries: decision records and their archive."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.numeric import rounded
from tidemark.operators import calendar, decisions
from tidemark.plans import market, studies
from tidemark.plans.market import kept

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: rounded(function(spark, folder))
    return function


def last_session(spark, folder):
    return market.context(spark, folder).agg(F.max("timestamp").alias("d")).scalar()


def sessions(spark, folder) -> DataFrame:
    return decisions.session_calendar(market.context(spark, folder).select("timestamp"), zone="UTC")


@query
def decision_records(spark, folder):
    day = last_session(spark, folder)
    asked = studies.requested(spark, folder)
    eligible = calendar.with_membership(asked.withColumn("timestamp", day), studies.membership(spark, folder))
    return decisions.decision_records(asked, market.signals(spark, folder), day, eligible)


@query
def decision_checks(spark, folder):
    """Every signal row taken as a decision."""
    return decisions.decision_violations(market.signals(spark, folder))


@query
def decision_checks_faulty(spark, folder):
    """The same on decisions whose flags no longer follow from their values, dealt out by volume."""
    v, first = F.col("volume"), fixed.SIGNAL_COMPONENTS[0]

    def flipped(name: str, each: int):
        return F.when(v % each == 0, ~F.col(name)).otherwise(F.col(name))
    return decisions.decision_violations(market.signals(spark, folder).withColumns({
        first: flipped(first, 7), "dip_component_count": F.when(v % 11 == 0, 4 - F.col("dip_component_count")).otherwise(F.col("dip_component_count")),
        "dip_ready_v1": flipped("dip_ready_v1", 13), "dip_condition_v1": flipped("dip_condition_v1", 17),
        "dip_event_v1": F.col("dip_event_v1") | (v % 19 == 0)}))


@kept
def archive_rows(spark, folder) -> DataFrame:
    """Each bar as an archived record whose publication lags its session by its volume in hours.

    Bars stand in for records so that the table grows with the data; the traits that decide
    the timing class are read off the volume.
    """
    rows = market.signals(spark, folder).select(
        F.col("timestamp").alias("session"), "ticker", "volume", "dip_component_count", "dip_condition_v1", "dip_event_v1")
    rows = rows.join(F.broadcast(sessions(spark, folder)), "session")  # the last session has no next open yet
    hours = F.make_dt_interval(F.lit(0), (F.col("volume") % 48).cast("int"))
    published = F.col("close") + hours
    source = F.col("close") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("volume") % 90).cast("int"))
    return rows.withColumns({
        "published_at": published, "source_times": F.array(source, F.when(F.col("volume") % 17 != 0, source)),
        "latest_sessions": F.array(F.col("session"), F.when(F.col("volume") % 19 == 0, F.date_sub("session", 1)).otherwise(F.col("session"))),
        "mode": F.when(F.col("volume") % 13 == 0, "replay").otherwise("collect"),
        "available": F.col("volume") % 7 != 0, "clean_revision": F.col("volume") % 11 != 0,
        "correction": F.col("volume") % 23 == 0, "future_input": F.col("volume") % 29 == 0})


def classified(spark, folder) -> DataFrame:
    start = calendar.split_dates(market.context(spark, folder)).select("validation_start").scalar()
    return archive_rows(spark, folder).withColumn("classification", decisions.timing_class(start))


@query
def timing_class(spark, folder):
    return classified(spark, folder).select("session", "ticker", "published_at", "classification")


@query
def class_counts(spark, folder):
    return classified(spark, folder).groupBy("classification").agg(F.count(F.lit(1)).alias("count"))


def as_of(spark, folder):
    """Noon of the first test session."""
    start = calendar.split_dates(market.context(spark, folder)).select("test_start").scalar()
    return start.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))


@query
def due_sessions(spark, folder):
    return decisions.due_sessions(sessions(spark, folder), as_of(spark, folder)).select("session", "next_session", "next_open")


def runs(spark, folder) -> DataFrame:
    """Sessions with a run, by all their first records: those of which one was out before the next open, where that is known."""
    rows = archive_rows(spark, folder).where(~F.col("correction"))
    in_time = F.coalesce(F.col("published_at") < F.col("next_open"), F.lit(True))
    made = rows.groupBy("session").agg(F.bool_or(in_time).alias("made")).where("made")
    return decisions.run_status(rows).join(made, "session", "left_semi")


@query
def run_status(spark, folder):
    return runs(spark, folder)


@query
def coverage(spark, folder):
    due = decisions.due_sessions(sessions(spark, folder), as_of(spark, folder))
    return decisions.coverage(due, runs(spark, folder))


@query
def correction_checks(spark, folder):
    """Orders of one day and priority as runs; each corrects the one before, some an older one."""
    orders = market.table(spark, folder, "orders").select(
        F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority").alias("session"),
        F.col("o_orderkey").alias("run_id"), "o_custkey")
    w = Window.partitionBy("session").orderBy("run_id")
    before = F.lag("run_id", 1).over(w)
    older = F.coalesce(F.lag("run_id", 2).over(w), before)
    return decisions.correction_violations(orders.select(
        "session", "run_id", F.when(F.col("o_custkey") % 4 == 0, older).when(F.col("o_custkey") % 31 == 0, F.lit(-1))
        .otherwise(before).alias("corrects")))


DIGESTED = ["session", "ticker", "dip_component_count", "dip_condition_v1", "dip_event_v1"]


@query
def record_digest(spark, folder):
    rows = archive_rows(spark, folder)
    return rows.select("session", "ticker", decisions.record_digest(rows, DIGESTED).alias("digest"))


@query
def linkage_checks(spark, folder):
    """Records against digests taken before events were masked by membership."""
    rows = archive_rows(spark, folder)
    stored = rows.select("session", "ticker", decisions.record_digest(rows, DIGESTED).alias("digest"))
    masked = calendar.with_membership(rows.withColumn("timestamp", F.col("session")), studies.membership(spark, folder))
    masked = masked.withColumn("dip_event_v1", F.col("dip_event_v1") & F.col("member"))
    return decisions.linkage_violations(masked, stored, DIGESTED, ("session", "ticker"))


@query
def archive_flat(spark, folder):
    """Records with the status of their run and the entry they would get."""
    rows = classified(spark, folder).join(runs(spark, folder).select("session", F.col("status").alias("run_status")), "session", "left")
    return rows.select("session", "ticker", "mode", "classification", F.coalesce("run_status", F.lit("interrupted")).alias("run_status"),
                       F.col("next_open").alias("expected_entry_timestamp"), "dip_event_v1")


@query
def context_checks(spark, folder):
    """Context records as a collector might send them, some with a field too many or too few, against the allow-list.

    A record is a map of its fields; by volume some have lost one, hold an outcome of the future, or are empty.
    """
    table, v = market.signals(spark, folder), F.col("volume")
    field = lambda name: F.struct(F.lit(name).alias("key"), F.col(name).cast("double").alias("value"))
    lost = v % len(fixed.CONTEXT_FIELDS)
    kept_fields = F.filter(F.array(*map(field, fixed.CONTEXT_FIELDS)), lambda f, i: (v % 7 != 0) | (i != lost))
    future = F.array(F.struct(F.lit("forward_return").alias("key"), F.col("close").alias("value")))
    entries = F.when(v % 11 == 0, F.concat(kept_fields, future)).otherwise(kept_fields)
    return decisions.context_violations(table.select(F.when(v % 13 != 0, F.map_from_entries(entries)).alias("features")), "features", fixed.CONTEXT_FIELDS)


@query
def ticker_payload(spark, folder):
    """Known rows and future outcomes as separate JSON fields, one row per symbol and fold.

    A fold is one year of sessions, which bounds the lists. Numbers have six decimals; an undefined one is left out.
    """
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("date")

    def number(name: str) -> Column:
        # Rounded as a double, so that every engine rounds alike, and then exact.
        return (F.floor(F.col(name) * 1e6 + 0.5).cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).alias(name)
    known = studies.observations(spark, folder).groupBy("ticker", "fold").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        day, number("close"), "dip_component_count", "dip_event_v1")))).alias("known_at_signal"))
    trades = studies.fold_trades(spark, folder).groupBy("ticker", "fold").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        day, "mode", "status", number("net_return"))))).alias("future_outcomes"))
    return known.join(trades, ["ticker", "fold"], "left")
