"""Checks, cleaning and audits of bars; each is one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import symbols
from tidemark.functions.numeric import spacing


def _not_finite(c: str) -> Column:
    value = F.col(c).cast("double")
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def bar_violations(bars: DataFrame) -> DataFrame:
    """One row with the number of rows that break each bar rule; all zero for sound bars."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    missing = F.lit(False)
    for name in fixed.BAR_COLUMNS:
        missing = missing | F.col(name).isNull()
    number = F.lit(False)
    for name in (*fixed.PRICE_COLUMNS, "volume"):
        number = number | _not_finite(name)
    # Counting per key first keeps the duplicate check mergeable and the key table distributed.
    per_key = bars.groupBy("timestamp", "ticker").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(missing).alias("missing"), F.count_if(number).alias("not_finite"),
        F.count_if((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)).alias("not_positive"),
        F.count_if((l > h) | (o < l) | (o > h) | (c < l) | (c > h)).alias("malformed_range"),
        F.count_if(v < 0).alias("negative_volume"),
        F.count_if(~symbols.is_valid(F.col("ticker")) | (F.col("ticker") != symbols.normalized(F.col("ticker"))))
        .alias("bad_symbol"),
        F.count_if(~F.date_format("timestamp", "HH:mm:ss.SSSSSS").eqNullSafe("00:00:00.000000") & F.col("timestamp").isNotNull())
        .alias("not_midnight"))
    totals = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in (
        "missing", "not_finite", "not_positive", "malformed_range", "negative_volume", "bad_symbol", "not_midnight")]
    return per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), *totals,
                       F.count_if(F.col("_n") > 1).alias("duplicate_keys"))


def require_sound(bars: DataFrame) -> DataFrame:
    """``bars`` if they break no rule; else an error that names the rules, before anything is written or computed."""
    broken = {k: v for k, v in bar_violations(bars).first().asDict().items() if k != "rows" and v}
    if broken:
        raise ValueError("unsound bars: " + ", ".join(f"{k} in {v}" for k, v in broken.items()))
    return bars


def clean(raw: DataFrame) -> DataFrame:
    """Provider rows as bars: lower-case names, cast numbers, local session date, one copy.

    Rows that do not cast keep NULLs for ``bar_violations`` to count; conflicting copies
    of a key stay and are counted there too.
    """
    frame = raw.toDF(*[c.strip().lower() for c in raw.columns])
    stamp = "timestamp" if "timestamp" in frame.columns else "date"
    # The first ten characters are the local date: an offset is dropped, never applied.
    day = F.to_date(F.substring(F.col(stamp).cast("string"), 1, 10))
    numbers = [F.expr(f"try_cast({c} as double)").alias(c) for c in fixed.PRICE_COLUMNS]
    volume = F.expr("case when try_cast(volume as double) = floor(try_cast(volume as double)) "
                    "then cast(try_cast(volume as double) as bigint) end")
    return frame.select(day.alias("timestamp"), symbols.normalized(F.col("ticker")).alias("ticker"),
                        *numbers, volume.alias("volume")).dropDuplicates()


AUDIT_PAIRS = (
    ("low_gt_high", "low", "high"), ("open_lt_low", "low", "open"), ("open_gt_high", "open", "high"),
    ("close_lt_low", "low", "close"), ("close_gt_high", "close", "high"))


def audit_ohlc(raw: DataFrame) -> DataFrame:
    """One row per broken rule of each raw row (``ticker, row_position, session`` and prices).

    Nothing is repaired. Row-local: the rules of a row are an array that is exploded.
    """
    usable = {c: F.when(~_not_finite(c), F.col(c).cast("double")) for c in fixed.PRICE_COLUMNS}
    frame = raw.select("ticker", "row_position", "session", *[v.alias(c) for c, v in usable.items()])
    nothing = F.lit(None).cast("double")
    found = []
    for c in fixed.PRICE_COLUMNS:
        bad = F.col(c).isNull() | (F.col(c) <= 0)
        found.append(F.when(bad, F.struct(
            F.lit(f"invalid_{c}").alias("rule"), nothing.alias("gap"), nothing.alias("scale"))))
    for rule, larger, smaller in AUDIT_PAIRS:
        a, b = F.col(larger), F.col(smaller)
        found.append(F.when(a > b, F.struct(F.lit(rule).alias("rule"), (a - b).alias("gap"),
                                            F.greatest(F.abs(a), F.abs(b)).alias("scale"))))
    broken = F.filter(F.array(*found), lambda f: f.isNotNull())
    gap, scale = F.col("_f.gap"), F.col("_f.scale")
    return frame.withColumn("_f", F.explode(broken)).select(
        "ticker", "row_position", "session", *fixed.PRICE_COLUMNS, F.col("_f.rule").alias("rule"),
        gap.alias("absolute_gap"), (gap / scale).alias("relative_gap"), (gap / spacing(scale)).alias("spacing_units"))


def audit_summary(raw: DataFrame, findings: DataFrame, requested: DataFrame) -> DataFrame:
    """Per requested symbol: rows, affected rows, rules met and largest gaps.

    Symbols without rows stay in the table as failed acquisitions.
    """
    rows = raw.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))
    broken = findings.groupBy("ticker").agg(
        F.countDistinct("row_position").alias("affected_rows"), F.count(F.lit(1)).alias("violations"),
        F.min("session").alias("first_affected"), F.max("session").alias("last_affected"),
        F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"),
        *[F.max(c).alias(f"max_{c}") for c in ("absolute_gap", "relative_gap", "spacing_units")])
    joined = requested.select("ticker").join(rows, "ticker", "left").join(broken, "ticker", "left")
    count = F.coalesce(F.col("affected_rows"), F.lit(0))
    return joined.withColumns({
        "diagnostic_status": F.when(F.col("rows").isNull(), "acquisition_failed").otherwise("measured"),
        "rows": F.coalesce(F.col("rows"), F.lit(0)), "affected_rows": count,
        "affected_fraction": F.when(F.col("rows") > 0, count / F.col("rows")),
        "violations": F.coalesce(F.col("violations"), F.lit(0)), "rules": F.coalesce(F.col("rules"), F.lit(""))})
