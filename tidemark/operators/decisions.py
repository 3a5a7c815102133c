"""Decision records per session and symbol: status, timing, coverage and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed

DECISION_COLUMNS = (
    *fixed.SIGNAL_FEATURES, *[f"{c}_threshold" for c in fixed.SIGNAL_FEATURES], *fixed.SIGNAL_COMPONENTS,
    "dip_ready_v1", "dip_condition_v1", "dip_event_v1", "dip_component_count")


def decision_records(requested: DataFrame, signals: DataFrame, day: Column, eligible: DataFrame) -> DataFrame:
    """One row per requested symbol for one session; nothing requested is dropped.

    ``signals`` may hold later rows; they are left out first. A symbol whose last bar is
    older than the session is stale, one without bars is unavailable.
    """
    known = signals.where(F.col("timestamp") <= day)
    last = known.groupBy("ticker").agg(F.max("timestamp").alias("latest_session"))
    today = known.where(F.col("timestamp") == day).select("ticker", *DECISION_COLUMNS)
    rows = (requested.select("ticker").join(last, "ticker", "left").join(today, "ticker", "left")
            .join(eligible.select("ticker", "member"), "ticker", "left"))
    status = (F.when(F.col("latest_session").isNull(), "unavailable")
              .when(F.col("latest_session") != day, "stale").otherwise("available"))
    error = (F.when(F.col("latest_session").isNull(), "series unavailable")
             .when(F.col("latest_session") != day, "signal-date bar unavailable"))
    return rows.select(
        "ticker", day.alias("session"), F.coalesce("member", F.lit(False)).alias("eligible"), status.alias("status"),
        error.alias("error"), "latest_session", *DECISION_COLUMNS)


def decision_violations(records: DataFrame) -> DataFrame:
    """Counts of decisions whose flags do not follow from their values."""
    wrong_component, count, ready = F.lit(False), F.lit(0), F.lit(True)
    for c, flag in zip(fixed.SIGNAL_FEATURES, fixed.SIGNAL_COMPONENTS):
        expected = F.coalesce(F.col(c) <= F.col(f"{c}_threshold"), F.lit(False))
        wrong_component = wrong_component | (F.col(flag) != expected)
        count = count + F.col(flag).cast("int")
        ready = ready & F.col(c).isNotNull() & F.col(f"{c}_threshold").isNotNull()
    condition = ready & (F.col("dip_component_count") >= fixed.REQUIRED_COMPONENTS)
    return records.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(wrong_component).alias("wrong_components"),
        F.count_if(F.col("dip_component_count") != count).alias("wrong_counts"),
        F.count_if(F.col("dip_ready_v1") != ready).alias("wrong_ready"),
        F.count_if(F.col("dip_condition_v1") != condition).alias("wrong_conditions"),
        F.count_if(F.col("dip_event_v1") & ~F.col("dip_condition_v1")).alias("events_without_condition"))


def session_calendar(sessions: DataFrame, *, zone: str = "America/New_York") -> DataFrame:
    """Close, collection start and next open of each session as instants.

    Sessions are the observed dates: one row each, bounded by the calendar.
    """
    following = F.lead("timestamp").over(Window.partitionBy(F.lit(0)).orderBy("timestamp"))

    def at(day: Column, clock: str) -> Column:
        local = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {clock}")).cast("timestamp_ntz")
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)

    return sessions.select(F.col("timestamp").alias("session"), following.alias("next_session")).select(
        "session", "next_session", at(F.col("session"), "16:00:00").alias("close"),
        at(F.date_add("session", 1), "00:15:00").alias("collection_start"),
        at(F.col("next_session"), "09:30:00").alias("next_open"))


def timing_class(effective_session: Column) -> Column:
    """When a record became known, by fixed precedence; columns as in ``archive_rows``."""
    now = F.col("published_at")
    sourced = F.size(F.filter("source_times", lambda t: t.isNotNull())) == 2
    outside = F.exists("source_times", lambda t: (t < F.col("close")) | (t > now))
    current = (F.size("latest_sessions") == 2) & F.forall("latest_sessions", lambda d: d.eqNullSafe(F.col("session")))
    return (F.when(F.col("correction"), "correction")
            .when((F.col("mode") == "replay") | (F.col("session") < effective_session), "retrospective")
            .when(~F.col("available"), "unavailable").when(~F.col("clean_revision"), "unverifiable")
            .when(~current, "stale").when(now >= F.col("next_open"), "late")
            .when(now < F.col("collection_start"), "early")
            .when(F.col("future_input") | ~sourced | F.coalesce(outside, F.lit(True)), "unverifiable")
            .otherwise("prospective"))


def due_sessions(calendar: DataFrame, as_of: Column) -> DataFrame:
    """Sessions whose next open has passed."""
    return calendar.where(F.col("next_open") <= as_of)


def run_status(records: DataFrame) -> DataFrame:
    """Complete, partial or failed per session, by its available records."""
    n = F.col("available_records")
    return records.groupBy("session").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("available").alias("available_records")).withColumn(
        "status", F.when(n == F.col("records"), "complete").when(n > 0, "partial").otherwise("failed"))


def coverage(due: DataFrame, runs: DataFrame) -> DataFrame:
    """Every due session with its run's status, or ``missing_run``."""
    return due.select("session").join(runs.select("session", "status"), "session", "left").withColumn(
        "status", F.coalesce("status", F.lit("missing_run")))


def correction_violations(runs: DataFrame) -> DataFrame:
    """Counts of broken correction chains in ``(session, run_id, corrects)``."""
    per_session = runs.groupBy("session").agg(F.count_if(F.col("corrects").isNull()).alias("primaries"))
    per_parent = runs.where(F.col("corrects").isNotNull()).groupBy("session", F.col("corrects").alias("run_id")).agg(
        F.count(F.lit(1)).alias("successors"))
    orphans = per_parent.join(runs.select("session", "run_id"), ["session", "run_id"], "left_anti")
    several = per_session.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("primaries") != 1).alias("sessions_without_one_primary"))
    forks = per_parent.agg(F.count_if(F.col("successors") > 1).alias("forked")).scalar()
    lost = orphans.agg(F.count(F.lit(1)).alias("lost")).scalar()
    return several.select("*", forks.alias("parents_with_several_successors"), lost.alias("missing_parents"))


def record_digest(records: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a record as JSON with sorted keys and a closing newline."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(body, F.lit("\n")), 256)


def linkage_violations(records: DataFrame, stored: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Records whose digest differs from the stored one, or has none."""
    found = records.withColumn("_digest", record_digest(records, columns)).select(*keys, "_digest")
    return found.join(stored.select(*keys, "digest"), list(keys), "left").where(
        ~F.col("_digest").eqNullSafe(F.col("digest"))).select(*keys)


def context_violations(contexts: DataFrame, features: str, allowed: tuple[str, ...]) -> DataFrame:
    """Counts of context records with fields outside, or missing from, the allow-list."""
    keys = F.map_keys(features)
    listed = F.array(*[F.lit(c) for c in allowed])
    return contexts.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.size(F.array_except(keys, listed)) > 0).alias("unregistered_fields"),
        F.count_if(F.size(F.array_except(listed, keys)) > 0).alias("missing_fields"))
