"""Return summaries, date-clustered bootstrap, trade metrics and compounding."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark import fixed
from tidemark.operators.quantiles import with_quantiles


def _when_done(name: str) -> Column:
    return F.when(F.col("status") == "completed", F.col(name))


def profit_factor(x: Column) -> Column:
    """Gains over losses; undefined without losses."""
    losses = F.sum(F.when(x < 0, -x))
    gains = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))
    return F.when(losses > 0, gains / losses)


def share(flag: Column, among: Column) -> Column:
    """Mean of a flag over the rows where ``among`` is defined."""
    return F.avg(F.when(among.isNotNull(), flag.cast("double")))


def summarize_returns(table: DataFrame, value: str, *, by: tuple[str, ...], date: str = "timestamp",
                      block: int = fixed.BLOCK_SIZE, draws: int = fixed.DRAWS, seed: int = fixed.SEED,
                      confidence: float = fixed.CONFIDENCE) -> DataFrame:
    """Moments, rates and bootstrap uncertainty of ``value`` per group."""
    x = F.col(value)
    groups = table.groupBy(*by).agg(
        F.count(x).alias("count"), F.count_if(x.isNull()).alias("missing_count"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), share(x > 0, x).alias("win_rate"),
        F.avg(x).alias("expectancy"), profit_factor(x).alias("profit_factor"),
        F.countDistinct(F.when(x.isNotNull(), F.col(date))).alias("cluster_count"))
    groups = with_quantiles(groups, table, by, {"median": (value, 0.5)})
    ci = bootstrap(table, value, by=by, date=date, block=block, draws=draws, seed=seed, confidence=confidence)
    return _join_groups(groups, ci, by)


def _join_groups(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") if k in by else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, same, "left").drop(*[f"_k_{k}" for k in by])


def block_hashes(seed: int, draws: int, blocks: int) -> np.ndarray:
    """For each draw and block a repeatable number from a hash of its place; modulo the dates of a group it is the block's start."""
    return np.array([[int(md5(f"{seed}:{draw}:{block}".encode()).hexdigest()[:8], 16) for block in range(blocks)]
                     for draw in range(draws)], np.int64).reshape(draws, blocks)


def resampled(sums: np.ndarray, rows: np.ndarray, block: int, hashes: np.ndarray) -> np.ndarray:
    """Mean of each draw, from the sums and row counts of a group's dates in order, a circle of which ``block`` are drawn at a time."""
    dates = len(sums)
    blocks = -(-dates // block)
    tail = dates - (blocks - 1) * block
    starts = hashes[:, :blocks] % dates

    def total(values: np.ndarray) -> np.ndarray:
        cells = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:block - 1]]), block)
        return cells.sum(1)[starts[:, :-1]].sum(1) + cells[:, :tail].sum(1)[starts[:, -1]]
    return total(sums) / total(rows)


def bootstrap(table: DataFrame, value: str, *, by: tuple[str, ...], date: str = "timestamp",
              block: int = fixed.BLOCK_SIZE, draws: int = fixed.DRAWS, seed: int = fixed.SEED,
              confidence: float = fixed.CONFIDENCE) -> DataFrame:
    """Circular block bootstrap of the row-weighted mean over date clusters.

    Values are summed per date first, and a group becomes one row of its (at most calendar-many) dates. The draws are one
    table that all groups share, made once per task: a group looks up the sum of each drawn block
    instead of single dates. Groups with fewer than two blocks of dates are left out.
    """
    group = F.struct(*[F.col(k) for k in by]) if by else F.struct(F.lit(0).alias("_all"))
    clusters = (table.where(F.col(value).isNotNull()).groupBy(group.alias("_group"), F.col(date).alias("_date"))
                .agg(F.sum(F.col(value).cast("double")).alias("_sum"), F.count(F.lit(1)).alias("_rows")))
    dates = clusters.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("_date", "_sum", "_rows"))).alias("_dates"))
    dates = dates.where(F.size("_dates") >= 2 * block).select("_group", "_dates._sum", "_dates._rows")
    schema = StructType([dates.schema["_group"], *(StructField(c, DoubleType()) for c in ("standard_error", "ci_lower", "ci_upper"))])
    bounds = [100 * (1 - confidence) / 2, 100 * (1 + confidence) / 2]

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.zeros((draws, 0), np.int64)
        for part in parts:
            found = []
            for sums, rows in zip(part.column("_sum"), part.column("_rows")):
                sums, rows = sums.values.to_numpy(), rows.values.to_numpy()
                if -(-len(sums) // block) > hashes.shape[1]:
                    hashes = block_hashes(seed, draws, -(-len(sums) // block))
                means = resampled(sums, rows, block, hashes)
                found.append((means.std(ddof=1), *np.percentile(means, bounds)))
            columns = zip(*found) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([part.column("_group"), *(pa.array(c, pa.float64(), from_pandas=True) for c in columns)], names=schema.names)

    return dates.mapInArrow(draw, schema).select(*[F.col(f"_group.{k}").alias(k) for k in by], "standard_error", "ci_lower", "ci_upper")


def risk_adjusted(table: DataFrame, value: str, *, by: tuple[str, ...], periods: float = 252.0,
                  risk_free: float = 0.0, target: float = 0.0) -> DataFrame:
    """Sharpe and Sortino of a regular, complete return series per group."""
    x = F.col(value)
    deviation = F.stddev_samp(x - risk_free)
    downside = F.sqrt(F.avg(F.pow(F.least(x - target, F.lit(0.0)), 2)))
    enough = F.count(x) >= 2
    return table.groupBy(*by).agg(
        F.count(x).alias("periods"),
        F.when(enough & (deviation > 0), F.avg(x - risk_free) / deviation * sqrt(periods)).alias("sharpe"),
        F.when(enough & (downside > 0), F.avg(x - target) / downside * sqrt(periods)).alias("sortino"))


UNIT = 4096  # of an order that is no time


def _wealth(parts: Column, product: str, peak: str, trough: str, fall: str) -> Column:
    """Summary of a run of steps from the summaries of its parts, in order.

    ``product`` is what one unit becomes, ``peak`` and ``trough`` its highest and lowest value on the way, the start included
    in the peak only, and ``fall`` the lowest ratio of a value to the peak before it. The summary of two runs follows from theirs: a
    value of the second stands against the higher of its own peak and that of the first.
    """
    def after(s: Column, p: Column) -> Column:
        return F.struct((s.product * p[product]).alias("product"), F.greatest(s.peak, s.product * p[peak]).alias("peak"),
                        F.least(s.trough, s.product * p[trough]).alias("trough"),
                        F.least(s.fall, p[fall], s.product * p[trough] / s.peak).alias("fall"))
    one, none = F.lit(1.0), F.lit(float("inf"))
    return F.aggregate(parts, F.struct(one.alias("product"), one.alias("peak"), none.alias("trough"), none.alias("fall")), after)


def sequential_metrics(table: DataFrame, value: str, *, by: tuple[str, ...], order: str, each: str = "month") -> DataFrame:
    """Compounded return and the deepest fall from a running peak that starts at one.

    The steps of one series within a unit (``each`` of time, or ``UNIT`` of a number) are folded into four numbers, and these are
    folded in order, so a long series spreads over many tasks; what is gathered is one unit, then one entry a unit.
    Undefined values are no steps; a group without any defined one is left out.
    """
    timed = table.schema[order].dataType.typeName().startswith(("date", "timestamp"))
    unit = F.date_trunc(each, F.col(order)) if timed else F.floor(F.col(order) / UNIT)
    step = F.struct(F.col(order).alias("at"), (1 + F.col(value)).alias("step"))
    units = (table.where(F.col(value).isNotNull()).groupBy(*by, unit.alias("_unit"))
             .agg(F.sort_array(F.collect_list(step)).alias("_steps")))
    # A step is a run of one: no peak lies below the value it starts from, so the step itself may stand for its fall.
    folded = _wealth(F.col("_steps"), "step", "step", "step", "step")
    series = units.select(*by, F.struct(F.col("_unit").alias("unit"), folded.alias("run")).alias("_run"))
    series = series.groupBy(*by).agg(F.sort_array(F.collect_list("_run")).alias("_runs"))
    total = _wealth(F.transform("_runs", lambda r: r.run), "product", "peak", "trough", "fall")
    return series.withColumn("_total", total).select(
        *by, (F.col("_total.product") - 1).alias("cumulative_return"),
        F.least(F.col("_total.fall") - 1, F.lit(0.0)).alias("maximum_drawdown"))


def summarize_outcomes(outcomes: DataFrame, by: tuple[str, ...], *, uncertainty: bool = True,
                       **bootstrap_rules) -> DataFrame:
    """Grouped outcome summary with means paired to the matched index return."""
    done = outcomes.withColumns({
        "_r": _when_done("forward_return"), "_b": _when_done("benchmark_return")})
    r, b = F.col("_r"), F.col("_b")
    paired = F.when(b.isNotNull(), r)
    groups = done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("status") != "completed").alias("excluded"),
        F.count(r).alias("count"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
        share(r > 0, r).alias("win_rate"), profit_factor(r).alias("profit_factor"),
        F.countDistinct(F.when(r.isNotNull(), F.col("timestamp"))).alias("cluster_count"),
        F.avg(_when_done("mfe")).alias("average_mfe"), F.avg(_when_done("mae")).alias("average_mae"),
        F.count(paired).alias("benchmark_count"), F.avg(paired).alias("paired_stock_mean"),
        F.avg(b).alias("benchmark_mean"), F.avg(paired - b).alias("mean_excess_return"))
    groups = with_quantiles(groups, done, by, {"median": ("_r", 0.5)})
    return _join_groups(groups, bootstrap(done, "_r", by=by, **bootstrap_rules), by) if uncertainty else groups


def trade_columns() -> list[Column]:
    """Additive trade metrics; medians are joined by ``trade_metrics``."""
    x = _when_done("net_return")
    reason = _when_done("exit_reason")
    win, loss = F.avg(F.when(x > 0, x)), F.avg(F.when(x < 0, x))
    return [
        F.count(F.lit(1)).alias("candidate_count"), F.count(x).alias("trade_count"),
        F.count_if(F.col("status") != "completed").alias("excluded_count"),
        share(x > 0, x).alias("win_rate"), share(x > 0, x).alias("win_probability"),
        share(x < 0, x).alias("loss_probability"), win.alias("average_win"), loss.alias("average_loss"),
        F.avg(x).alias("average_return"), F.stddev_samp(x).alias("std"), F.avg(x).alias("expectancy"),
        F.avg(x).alias("expected_value"), (F.abs(loss) / (win + F.abs(loss))).alias("break_even_win_rate"),
        F.avg(_when_done("gross_return")).alias("average_gross_return"),
        F.avg(_when_done("mfe")).alias("average_mfe"), F.avg(_when_done("mae")).alias("average_mae"),
        F.avg(_when_done("holding_bars")).alias("average_holding_bars"),
        share(reason == "take_profit", reason).alias("take_profit_rate"),
        share(reason == "stop_loss", reason).alias("stop_loss_rate"),
        share(reason == "time_exit", reason).alias("time_exit_rate"), profit_factor(x).alias("profit_factor")]


def trade_metrics(trades: DataFrame, by: tuple[str, ...], *, extra: list[Column] = (),
                  quantiles: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Summary of completed trades per group, candidates and exclusions counted."""
    groups = trades.groupBy(*by).agg(*trade_columns(), *extra)
    done = trades.withColumn("_x", _when_done("net_return"))
    return with_quantiles(groups, done, by, {"median_return": ("_x", 0.5), **(quantiles or {})})


def trade_groups(trades: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Trade metrics plus a count per exclusion status and of ambiguous exits."""
    counts = [F.count_if(F.col("status") == s).alias(s)
              for s in ("overlap", "no_next_bar", "incomplete_window", "split_boundary")]
    return trade_metrics(trades, by, extra=[*counts, F.count_if("ambiguous_bar").alias("ambiguous_exits")])


def spread(table: DataFrame, value: str, *, by: tuple[str, ...], requested: Column | None = None) -> DataFrame:
    """Equal-weight distribution over symbols: signs, mean and quartiles.

    One row per symbol goes in, so exact percentiles stay as small as the universe.
    """
    x = F.col(value)
    total = F.count(F.lit(1)) if requested is None else F.first(requested)
    q25, q50, q75 = (F.percentile(x, F.lit(p)) for p in (0.25, 0.5, 0.75))
    return table.groupBy(*by).agg(
        total.alias("requested_count"), F.count(x).alias("defined_count"),
        (total - F.count(x)).alias("undefined_count"), F.count_if(x > 0).alias("positive_count"),
        F.count_if(x < 0).alias("negative_count"), F.count_if(x == 0).alias("zero_count"),
        share(x > 0, x).alias("positive_fraction_defined"), F.avg(x).alias("equal_ticker_mean"),
        q50.alias("median"), q25.alias("q25"), q75.alias("q75"), (q75 - q25).alias("iqr"),
        F.min(x).alias("minimum"), F.max(x).alias("maximum"))
