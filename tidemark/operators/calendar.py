"""Splits, walk-forward folds, regimes and universes: small tables keyed by date or symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import symbols


def split_dates(context: DataFrame, *, research: float = 0.6, validation: float = 0.2) -> DataFrame:
    """One row with the first validation and the first test date, by session number."""
    number, count = F.col("session_number"), F.col("session_count")
    return context.agg(
        F.min(F.when(number == F.floor(count * research), F.col("timestamp"))).alias("validation_start"),
        F.min(F.when(number == F.floor(count * (research + validation)), F.col("timestamp"))).alias("test_start"))


def split_label(stamp: Column, validation_start: Column, test_start: Column) -> Column:
    """Left-inclusive chronological label."""
    research, validation, test = fixed.SPLITS
    return F.when(stamp < validation_start, research).when(stamp < test_start, validation).otherwise(test)


def with_split(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """Label rows by the two cut dates, read as one-row subqueries."""
    return table.withColumn("split", split_label(
        F.col("timestamp"), cuts.select("validation_start").scalar(), cuts.select("test_start").scalar()))


def annual_folds(context: DataFrame, *, initial_history_years: int = 4) -> DataFrame:
    """Full calendar test years after an initial history; a short last year is flagged."""
    per_year = (context.groupBy(F.year("timestamp").alias("year")).agg(
        F.min("timestamp").alias("test_start"), F.max("timestamp").alias("test_end"),
        F.count(F.lit(1)).alias("test_sessions")))
    start = context.agg(F.min("timestamp").alias("s")).scalar()
    anniversary = F.add_months(start, 12 * initial_history_years)
    first_year = F.year(anniversary) + F.when(
        (F.month(anniversary) == 1) & (F.dayofmonth(anniversary) == 1), 0).otherwise(1)
    # Years are few: one row each, so one window over all of them is bounded by the calendar.
    earlier = Window.partitionBy(F.lit(0)).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    year_end = F.make_date("year", F.lit(12), F.lit(31))
    weekday = F.weekday(year_end)
    last_business_day = F.date_sub(year_end, F.greatest(weekday - 4, F.lit(0)))
    return (per_year.withColumn("history_end", F.max("test_end").over(earlier))
            .where((F.col("year") >= first_year) & F.col("history_end").isNotNull())
            .select(F.col("year").cast("string").alias("fold"), start.alias("history_start"), "history_end",
                    "test_start", "test_end", "test_sessions",
                    (F.col("test_end") < last_business_day).alias("partial_year")))


def fold_violations(folds: DataFrame) -> DataFrame:
    """Counts of broken fold rules: overlap, shrinking history, changing origin."""
    w = Window.partitionBy(F.lit(0)).orderBy("test_start")
    seen = folds.withColumns({
        "_test_end": F.lag("test_end").over(w), "_history_end": F.lag("history_end").over(w)})
    return seen.agg(
        F.count(F.lit(1)).alias("folds"),
        (F.countDistinct("history_start") - 1).alias("changed_origins"),
        (F.count(F.lit(1)) - F.countDistinct("fold")).alias("duplicate_folds"),
        F.count_if(F.col("history_start") > F.col("history_end")).alias("empty_histories"),
        F.count_if(F.col("history_end") >= F.col("test_start")).alias("history_in_test"),
        F.count_if(F.col("test_start") > F.col("test_end")).alias("empty_tests"),
        F.count_if(F.col("test_start") <= F.col("_test_end")).alias("overlapping_tests"),
        F.count_if(F.col("history_end") < F.col("_test_end")).alias("gaps_in_history"),
        F.count_if(F.col("history_end") < F.col("_history_end")).alias("shrinking_histories"))


def regime() -> Column:
    """Index close against its long mean; ``unknown`` while either is missing."""
    return (F.when(F.col("benchmark_sma").isNull(), "unknown")
            .when(F.col("benchmark_close") >= F.col("benchmark_sma"), "above").otherwise("below"))


def test_fold(table: DataFrame, folds: DataFrame) -> DataFrame:
    """Inner join of rows to the fold whose test year holds them (one at most)."""
    years = folds.select(F.year("test_start").alias("_year"), "fold", "test_start", "test_end")
    return (table.withColumn("_year", F.year("timestamp")).join(F.broadcast(years), "_year")
            .where(F.col("timestamp").between(F.col("test_start"), F.col("test_end"))).drop("_year"))


def training_folds(table: DataFrame, folds: DataFrame) -> DataFrame:
    """Join rows to every fold whose history holds them, through the years of that history.

    Folds and years come from the calendar, so the year table is small by construction.
    """
    years = folds.select(
        "fold", "history_start", "history_end",
        F.explode(F.sequence(F.year("history_start"), F.year("history_end"))).alias("_year"))
    return (table.withColumn("_year", F.year("timestamp")).join(F.broadcast(years), "_year")
            .where(F.col("timestamp").between(F.col("history_start"), F.col("history_end"))).drop("_year"))


def each_fold(table: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row once per fold, from the list of fold names."""
    names = folds.agg(F.sort_array(F.collect_list("fold"))).scalar()
    return table.withColumn("fold", F.explode(names))


def static_universe(requested: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Distinct normalized symbols, less the excluded ones."""
    names = requested.select(symbols.normalized(F.col("ticker")).alias("ticker")).distinct()
    if excluded is None:
        return names
    return names.join(excluded.select(symbols.normalized(F.col("ticker")).alias("ticker")).distinct(),
                      "ticker", "left_anti")


def membership_violations(intervals: DataFrame) -> DataFrame:
    """Counts of empty, overlapping or prematurely open intervals."""
    w = Window.partitionBy("ticker").orderBy("start_date")
    seen = intervals.withColumn("_next", F.lead("start_date").over(w))
    return seen.agg(
        F.count(F.lit(1)).alias("intervals"),
        F.count_if(F.col("start_date").isNull()).alias("missing_start"),
        F.count_if(F.col("end_date") <= F.col("start_date")).alias("empty_intervals"),
        F.count_if(F.col("_next") < F.col("end_date")).alias("overlaps"),
        F.count_if(F.col("_next").isNotNull() & F.col("end_date").isNull()).alias("open_before_last"))


def with_membership(table: DataFrame, intervals: DataFrame) -> DataFrame:
    """Add ``member``: date inside any half-open interval of the symbol.

    A symbol's intervals are folded into one row, so observations keep their count and
    the join stays an equi-join on the symbol.
    """
    spans = intervals.groupBy("ticker").agg(F.collect_list(F.struct("start_date", "end_date")).alias("_spans"))
    inside = F.exists("_spans", lambda s: (F.col("timestamp") >= s.start_date)
                      & (s.end_date.isNull() | (F.col("timestamp") < s.end_date)))
    return (table.join(spans, "ticker", "left")
            .withColumn("member", F.coalesce(inside, F.lit(False))).drop("_spans"))
