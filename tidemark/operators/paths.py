"""What happened after an event, and what earlier events at the same price did."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.outcomes import event_paths


def _first_at(values: Column, test) -> Column:
    """1-based index of the first element that passes."""
    steps = F.transform(values, lambda v, i: F.when(test(v), i + 1))
    return F.get(F.filter(steps, lambda s: s.isNotNull()), 0).cast("long")


def rebound_paths(observations: DataFrame, *, bars: int = fixed.HOLDING_BARS,
                  within: tuple[str, ...] = ("ticker", "fold")) -> DataFrame:
    """Shape of each complete path that stays inside its group; short paths are dropped."""
    paths = event_paths(observations, holding=bars, within=within).where(F.size("path") == bars)
    entry = F.get("path", 0).open
    paths = paths.withColumns({
        "_highs": F.transform("path", lambda b: b.high / entry - 1),
        "_closes": F.transform("path", lambda b: b.close / entry - 1),
        "_lows": F.transform("path", lambda b: b.low / entry - 1)})
    top = F.array_max("_highs")
    reach = {f"reach_{level}pct": _first_at(F.col("_highs"), lambda v, level=level: v >= level / 100)
             for level in fixed.REBOUND_LEVELS}
    return paths.select(
        *within, "timestamp", F.get("path", bars - 1).timestamp.alias("maturity"), F.col("low").alias("signal_low"),
        (entry / F.col("close") - 1).alias("entry_gap"),
        F.when(top > 0, F.array_position("_highs", top)).cast("long").alias("time_to_mfe"),
        F.greatest(top, F.lit(0.0)).alias("full_mfe"), F.least(F.array_min("_lows"), F.lit(0.0)).alias("full_mae"),
        _first_at(F.col("_closes"), lambda v: v > 0).alias("positive_close"), *[v.alias(k) for k, v in reach.items()])


def prior_visits(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Per row: earlier recovered events of its symbol near its close, at most a year old.

    A band join on age and price. Each earlier event is filed under the two age cells and
    the three price cells it can serve; a row looks into the one cell it lies in. Rows meet
    only near events, and every pair at most once.
    """
    age_width, price_width = fixed.MAXIMUM_AGE_DAYS, -log(1 - fixed.ZONE_DISTANCE) * 1.01
    epoch = F.lit("1970-01-01").cast("date")

    def age_cell(stamp: str) -> Column:
        return F.floor(F.date_diff(F.col(stamp), epoch) / age_width)

    def price_cell(price: str) -> Column:
        return F.floor(F.ln(F.col(price)) / price_width)

    earlier = (paths.where(F.col("full_mfe") >= fixed.PRIOR_RECOVERY)
               .select("ticker", F.col("timestamp").alias("visited"), "maturity", "signal_low",
                       F.explode(F.sequence(age_cell("timestamp"), age_cell("timestamp") + 1)).alias("_age"),
                       price_cell("signal_low").alias("_near"))
               .withColumn("_price", F.explode(F.sequence(F.col("_near") - 1, F.col("_near") + 1))).drop("_near"))
    asked = rows.select("ticker", "timestamp", "close", age_cell("timestamp").alias("_age"),
                        price_cell("close").alias("_price"))
    days = F.date_diff("timestamp", "visited")
    met = (asked.join(earlier, ["ticker", "_age", "_price"])
           .where((F.col("maturity") < F.col("timestamp")) & days.between(1, fixed.MAXIMUM_AGE_DAYS)
                  & (F.abs(F.col("close") / F.col("signal_low") - 1) <= fixed.ZONE_DISTANCE))
           .groupBy("ticker", "timestamp").agg(
               F.count(F.lit(1)).alias("_visits"), F.min(days).cast("long").alias("days_since_visit")))
    return (rows.select("ticker", "timestamp").join(met, ["ticker", "timestamp"], "left")
            .select("ticker", "timestamp", F.coalesce("_visits", F.lit(0)).alias("prior_successful_visits"),
                    F.when(F.col("_visits").isNotNull(), "revisit").otherwise("no_known_successful_zone")
                    .alias("support_group"), "days_since_visit"))


def context_as_of(signals: DataFrame, day: Column, regime: Column) -> DataFrame:
    """What was known about each symbol at one session's close, past paths included."""
    known = signals.where(F.col("timestamp") <= day)
    today = known.where(F.col("timestamp") == day)
    visits = prior_visits(today, rebound_paths(known, within=("ticker",)))
    return (today.withColumn("regime", regime)
            .select("ticker", "timestamp", *fixed.CONTEXT_FIELDS, F.col("benchmark_sma").alias("benchmark_sma200"), "regime")
            .join(visits, ["ticker", "timestamp"]).drop("support_group"))
