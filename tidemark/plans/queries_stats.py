"""Registered queries: summaries, robustness and diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.numeric import binned, rounded
from tidemark.operators import (
    calendar, features, outcomes, paths, robustness, series, signals as signal_ops, stats)
from tidemark.plans import market, queries_core, studies
from tidemark.plans.market import kept

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: rounded(function(spark, folder))
    return function


def events(spark, folder) -> DataFrame:
    return studies.fold_outcomes(spark, folder).where(F.col("selection") == "events")


@query
def return_summary(spark, folder):
    table = queries_core.forward(spark, folder, "events").where(F.col("horizon") == 10)
    return stats.summarize_returns(table, "forward_return", by=("split",))


@query
def bootstrap_ci(spark, folder):
    table = queries_core.forward(spark, folder, "events")
    return stats.bootstrap(table, "forward_return", by=("horizon",))


@query
def outcome_summary(spark, folder):
    return stats.summarize_outcomes(queries_core.forward(spark, folder, "events"), ("split", "horizon"))


@query
def risk_adjusted(spark, folder):
    daily = market.signals(spark, folder).where(F.col("return_1d").isNotNull())
    return stats.risk_adjusted(daily, "return_1d", by=("ticker",))


@query
def sequential_metrics(spark, folder):
    done = studies.fold_trades(spark, folder).where((F.col("mode") == "non_overlapping") & (F.col("status") == "completed"))
    return stats.sequential_metrics(done, "net_return", by=("ticker",), order="timestamp")


@query
def trade_metrics(spark, folder):
    return stats.trade_metrics(studies.fold_trades(spark, folder), ("mode",))


@query
def trade_groups(spark, folder):
    return stats.trade_groups(studies.fold_trades(spark, folder), ("mode", "regime"))


def _ledger_checks(trades: DataFrame) -> DataFrame:
    """Counts of trade rows that break the ledger's own rules."""
    done = F.col("status") == "completed"
    numbers = ("net_return", "gross_return", "mfe", "mae")
    missing, endless = F.col("holding_bars").isNull(), F.lit(False)
    for c in numbers:
        missing = missing | F.col(c).isNull()
        endless = endless | F.isnan(c) | (F.abs(c) == float("inf"))
    return trades.groupBy("mode").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("completed"), F.count_if(done & missing).alias("missing"),
        F.count_if(done & endless).alias("not_finite"),
        F.count_if(~F.col("status").isin("completed", "overlap", "no_next_bar", "incomplete_window", "split_boundary"))
        .alias("unknown_status"),
        F.count_if(done & ~F.col("exit_reason").isin("take_profit", "stop_loss", "time_exit")).alias("unknown_reason"),
        F.count_if(done & ((F.col("net_return") <= -1) | (F.col("gross_return") <= -1) | (F.col("mfe") < 0)
                           | (F.col("mae") > 0) | (F.col("holding_bars") < 1))).alias("bad_values"),
        F.count_if(done & (F.col("holding_bars") != F.floor("holding_bars"))).alias("broken_bars"),
        F.count_if(done & (F.col("exit_timestamp") < F.col("entry_timestamp"))).alias("exit_before_entry"),
        F.count_if(~done & F.col("net_return").isNotNull()).alias("measured_exclusions"))


@query
def ledger_checks(spark, folder):
    return _ledger_checks(studies.fold_trades(spark, folder))


@query
def ledger_checks_faulty(spark, folder):
    """The same on a ledger with faults of every kind, dealt out by the place of its signals."""
    p = F.col("position")

    def spoilt(name: str, each: int, value):
        return F.when(p % each == 0, value).otherwise(F.col(name))
    return _ledger_checks(studies.fold_trades(spark, folder).withColumns({
        "status": spoilt("status", 7, F.lit("lost")), "net_return": spoilt("net_return", 5, F.lit(float("inf"))),
        "gross_return": spoilt("gross_return", 11, F.lit(-1.5)), "mfe": spoilt("mfe", 13, F.lit(None).cast("double")),
        "mae": spoilt("mae", 17, F.lit(0.25)), "holding_bars": spoilt("holding_bars", 3, F.col("holding_bars") + 0.5),
        "exit_reason": spoilt("exit_reason", 19, F.lit("unknown")), "exit_timestamp": spoilt("exit_timestamp", 23, F.date_sub("entry_timestamp", 1))}))


@kept
def counts(spark, folder) -> DataFrame:
    every = calendar.each_fold(studies.requested(spark, folder), studies.folds(spark, folder))
    return robustness.completed_frequency(robustness.frequency(studies.observations(spark, folder)), every)


@query
def frequency(spark, folder):
    return counts(spark, folder)


@query
def frequency_fold(spark, folder):
    return robustness.frequency_by_fold(counts(spark, folder))


@query
def exclusions(spark, folder):
    return robustness.exclusions(counts(spark, folder), market.bars(spark, folder).select("ticker").distinct())


OUTCOME_SETS = {
    "fold_summary": ("fold", "horizon"), "oos_summary": ("horizon",), "ticker_summary": ("ticker", "horizon"),
    "regime_summary": ("regime", "horizon"), "fold_regime_summary": ("fold", "regime", "horizon"),
    "component_summary": ("fold", "dip_component_count", "horizon"), "component_oos_summary": ("dip_component_count", "horizon"),
}
TRADE_SETS = {
    "trade_fold_summary": ("mode", "fold"), "trade_oos_summary": ("mode",), "trade_ticker_summary": ("mode", "ticker"),
    "trade_regime_summary": ("mode", "regime"), "trade_fold_regime_summary": ("mode", "fold", "regime"),
}


@kept
def outcome_sets(spark, folder) -> DataFrame:
    """All outcome groupings in one pass, with uncertainty; component groupings hold ten-bar events only."""
    table = robustness.in_sets(studies.fold_outcomes(spark, folder), OUTCOME_SETS)
    by_component = F.col("grouping").startswith("component")
    table = table.where(~by_component | ((F.col("selection") == "events") & (F.col("horizon") == 10)))
    keys = ("grouping", "selection", "fold", "ticker", "regime", "dip_component_count", "horizon")
    return stats.summarize_outcomes(table, keys)


@query
def robustness_sets(spark, folder):
    return outcome_sets(spark, folder)


@kept
def trade_sets(spark, folder) -> DataFrame:
    table = robustness.in_sets(studies.fold_trades(spark, folder), TRADE_SETS)
    return stats.trade_groups(table, ("grouping", "mode", "fold", "ticker", "regime"))


@query
def robustness_trades(spark, folder):
    return trade_sets(spark, folder)


def by_ticker(spark, folder) -> DataFrame:
    """Event means per symbol and horizon, net expectancy and event totals, in one long table."""
    table = outcome_sets(spark, folder).where((F.col("grouping") == "ticker_summary") & (F.col("selection") == "events"))
    event = table.select(
        F.lit("event").alias("kind"), F.col("horizon").cast("long").alias("horizon"), "ticker", F.explode(F.array(
            F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("value")),
            F.struct(F.lit("mean_excess_return").alias("metric"), F.col("mean_excess_return").alias("value")))).alias("m")
    ).select("kind", "horizon", "ticker", "m.metric", "m.value")
    trade = trade_sets(spark, folder).where(
        (F.col("grouping") == "trade_ticker_summary") & (F.col("mode") == "non_overlapping")).select(
        F.lit("trade").alias("kind"), F.lit(10).cast("long").alias("horizon"), "ticker",
        F.lit("net_expectancy").alias("metric"), F.col("average_return").alias("value"))
    total = counts(spark, folder).groupBy("ticker").agg(F.sum("events").alias("n")).select(
        F.lit("frequency").alias("kind"), F.lit(0).cast("long").alias("horizon"), "ticker",
        F.lit("total_events").alias("metric"), F.col("n").cast("double").alias("value"))
    return event.unionByName(trade).unionByName(total)


@query
def distribution(spark, folder):
    asked = studies.requested(spark, folder).agg(F.count(F.lit(1)).alias("n")).scalar()
    table = by_ticker(spark, folder).withColumn("requested", asked)
    return stats.spread(table, "value", by=("kind", "horizon", "metric"), requested=F.col("requested"))


def contribution_ledgers(spark, folder) -> dict[str, tuple[DataFrame, str]]:
    net = studies.fold_trades(spark, folder).where((F.col("mode") == "non_overlapping") & (F.col("status") == "completed"))
    excess = events(spark, folder).where((F.col("horizon") == 10) & (F.col("status") == "completed"))
    return {"net_trades": (net, "net_return"), "event_excess_10": (excess, "excess_return")}


def _both(spark, folder, step) -> DataFrame:
    parts = [step(robustness.concentration(ledger, value, studies.requested(spark, folder))).withColumn("source", F.lit(name))
             for name, (ledger, value) in contribution_ledgers(spark, folder).items()]
    return parts[0].unionByName(parts[1])


@query
def concentration(spark, folder):
    return _both(spark, folder, lambda t: t)


@query
def concentration_top5(spark, folder):
    return _both(spark, folder, robustness.concentration_totals)


@query
def barrier_distribution(spark, folder):
    table = studies.split_signals(spark, folder).withColumns({
        "own_stop": F.least(F.col("atr_pct_14"), F.lit(0.2)), "own_target": F.least(F.col("atr_pct_14") * 2, F.lit(0.3))})
    ledger = outcomes.barrier_trades(table, stop_loss_column="own_stop", take_profit_column="own_target")
    spread = robustness.distribution_in_sets(
        ledger.where(F.col("status") == "completed").select("ticker", "stop_fraction", "target_fraction"),
        ("stop_fraction", "target_fraction"), (), {"ALL": (), "ticker": ("ticker",)})
    return spread.withColumn("ticker", F.coalesce("ticker", F.lit("ALL"))).drop("grouping")


# Diagnosis

@kept
def diagnosis_rows(spark, folder) -> DataFrame:
    """Fold events with the covariates known at signal time and their earlier visits."""
    observed = studies.observations(spark, folder)
    # The change is taken over observed rows only, so positions are counted anew.
    own = series.with_position(observed.drop("position", "length"))
    changed = series.own_rows(features.drawdown_change(series.cut(own, back=5, ahead=0)))
    known = changed.select(
        "ticker", "timestamp", *fixed.SIGNAL_COMPONENTS, signal_ops.combination().alias("combination"),
        *[c for c in fixed.DIAGNOSIS_EDGES if c != "entry_gap"], "volatility_20d")
    walked = paths.rebound_paths(observed)
    visits = paths.prior_visits(observed.where("dip_event_v1"), walked)
    keys = ["ticker", "timestamp"]
    return (events(spark, folder).join(known, keys, "left")
            .join(walked.select(*keys, "entry_gap"), keys, "left").join(visits, keys, "left"))


def diagnosis_labels() -> list:
    """(analysis, group) of a row: the whole, its keys, each component and each bin."""
    def label(analysis, group):
        return F.struct(F.lit(analysis).alias("analysis"), group.alias("group"))
    labels = [label("all_events", F.lit("all"))]
    for c in ("combination", "dip_component_count", "regime", "support_group"):
        labels.append(label(c, F.coalesce(F.col(c).cast("string"), F.lit("nan"))))
    for letter, c in zip("ABCD", fixed.SIGNAL_COMPONENTS):
        labels.append(label("component_presence", F.concat(F.lit(f"{letter} "), F.when(F.col(c), "active").otherwise("inactive"))))
    for c, edges in fixed.DIAGNOSIS_EDGES.items():
        labels.append(label(c, binned(F.col(c), edges)))
    return labels


@query
def diag_groups(spark, folder):
    table = diagnosis_rows(spark, folder)
    found = robustness.described(table.withColumn("_l", F.explode(F.array(*diagnosis_labels()))).select(
        "*", "_l.analysis", "_l.group"), ("analysis", "group", "horizon"))
    # Bins and component states are reported even when nothing falls into them.
    fixed_groups = [(c, g) for c in fixed.DIAGNOSIS_EDGES for g in ("low", "middle", "high", "unknown")]
    fixed_groups += [("component_presence", f"{x} {s}") for x in "ABCD" for s in ("active", "inactive")]
    grid = table.select("horizon").distinct().select("horizon", F.explode(F.array(*[
        F.struct(F.lit(a).alias("analysis"), F.lit(g).alias("group")) for a, g in fixed_groups])).alias("_g")).select(
        "horizon", "_g.analysis", "_g.group")
    every = found.select("horizon", "analysis", "group").unionByName(grid).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("events", "completed", "paired_count")}
    return every.join(found, ["horizon", "analysis", "group"], "left").withColumns(zero)


@query
def rebound_timing(spark, folder):
    walked = paths.rebound_paths(studies.observations(spark, folder))
    metrics = ("positive_close", "time_to_mfe", *[f"reach_{p}pct" for p in fixed.REBOUND_LEVELS])
    long = walked.select("fold", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("bars")) for m in metrics])).alias("m")).select("fold", "m.*")
    long = robustness.in_sets(long, {"all": (), "fold": ("fold",)}).withColumn("group", F.coalesce("fold", F.lit("all")))
    groups = long.groupBy("group", "metric").agg(
        F.count(F.lit(1)).alias("complete_paths"), F.count("bars").alias("reached"),
        (F.count("bars") / F.count(F.lit(1))).alias("fraction"), F.avg("bars").alias("mean_bars_if_reached"))
    return stats.with_quantiles(groups, long, ("group", "metric"), {"median_bars_if_reached": ("bars", 0.5)})


PROFILE = ("atr_pct_14", "relative_volume_20d", "relative_return_10d", "volatility_20d")


@kept
def profiles(spark, folder) -> DataFrame:
    table = diagnosis_rows(spark, folder).where(F.col("horizon") == 10)
    observed = studies.observations(spark, folder)
    known = observed.groupBy("ticker").agg(
        F.when(F.count_if("dip_ready_v1") > 0, F.count_if("dip_event_v1") / F.count_if("dip_ready_v1") * 252).alias("events_per_252"),
        *[F.avg(F.when(F.col("dip_event_v1"), F.col(c))).alias(c) for c in PROFILE])
    return robustness.described(table, ("ticker",)).join(known, "ticker", "left")


@query
def ticker_profile(spark, folder):
    return profiles(spark, folder)


@query
def spearman(spark, folder):
    pairs = [(a, b) for a in (*PROFILE, "events_per_252") for b in ("mean", "excess")]
    return robustness.rank_correlation(profiles(spark, folder), pairs)


@query
def cohort_means(spark, folder):
    table = diagnosis_rows(spark, folder).where((F.col("horizon") == 10) & (F.col("status") == "completed"))
    cohort = F.when(F.col("forward_return") > 0, "positive_gross").otherwise("nonpositive_gross")
    return table.groupBy(cohort.alias("group")).agg(F.count(F.lit(1)).alias("completed"), *[
        F.avg(c).alias(c) for c in ("return_5d", "drawdown_change_5", "atr_pct_14", "relative_volume_20d",
                                    "relative_return_10d", "entry_gap")])


# Report tables

@query
def status_counts(spark, folder):
    return studies.fold_outcomes(spark, folder).groupBy("selection", "fold", "horizon", "status").agg(
        F.count(F.lit(1)).alias("count"))


@query
def histogram(spark, folder):
    """Twelve bins of the per-symbol means: gross, excess and net expectancy."""
    table = by_ticker(spark, folder).where(F.col("horizon") == 10)
    return robustness.histogram(table, "metric", "value")


@query
def exit_counts(spark, folder):
    return studies.fold_trades(spark, folder).where(F.col("status") == "completed").groupBy("mode", "exit_reason").agg(
        F.count(F.lit(1)).alias("count"))


@query
def baseline_comparison(spark, folder):
    pooled = outcome_sets(spark, folder).where(F.col("grouping") == "oos_summary")
    return robustness.compared_to_baselines(pooled, ("horizon",))


@query
def criteria(spark, folder):
    """Breadth over symbols and favourable folds at ten bars."""
    excess = by_ticker(spark, folder).where((F.col("horizon") == 10) & (F.col("metric") == "mean_excess_return"))
    breadth = excess.agg(F.count_if(F.col("value") > 0).alias("positive_excess_tickers"), F.count("value").alias("defined_tickers"))
    by_fold = outcome_sets(spark, folder).where((F.col("grouping") == "fold_summary") & (F.col("horizon") == 10))
    fold_table = robustness.compared_to_baselines(by_fold, ("fold",))
    better = (F.col("mean") > F.col("unconditional")) & (F.col("difference_index") > 0)
    favorable = fold_table.agg(F.count_if(better).alias("favorable"), F.count(F.lit(1)).alias("folds"))
    return breadth.select(
        "positive_excess_tickers", "defined_tickers",
        (F.col("positive_excess_tickers") > F.col("defined_tickers") / 2).alias("breadth_passed"),
        favorable.select("favorable").scalar().alias("favorable_folds"), favorable.select("folds").scalar().alias("fold_count"),
        F.lit(0.5).alias("concentration_threshold"))


@query
def exposure_quantiles(spark, folder):
    """Events per usable symbol, and events per 252 ready rows over ready symbol-years."""
    table = counts(spark, folder)
    usable = table.groupBy("ticker").agg(F.sum("events").alias("n"), F.sum("ready").alias("ready")).where("ready > 0").select(
        F.lit("events_per_ticker").alias("measure"), F.col("n").cast("double").alias("x"))
    rates = table.where("ready > 0").select(F.lit("events_per_252_ready").alias("measure"), F.col("events_per_252_ready").alias("x"))
    return usable.unionByName(rates).groupBy("measure").agg(
        F.count("x").alias("count"), F.percentile("x", F.lit(0.5)).alias("median"), F.percentile("x", F.lit(0.25)).alias("q25"),
        F.percentile("x", F.lit(0.75)).alias("q75"), F.min("x").alias("minimum"), F.max("x").alias("maximum"))


@query
def regime_vs_control(spark, folder):
    table = outcome_sets(spark, folder).where(F.col("grouping") == "regime_summary")
    return robustness.compared_to_baselines(table, ("regime", "horizon"))


# Orderings

@query
def extremes(spark, folder):
    """Five lowest and five highest symbols by net expectancy, each once."""
    table = trade_sets(spark, folder).where((F.col("grouping") == "trade_ticker_summary") & (F.col("mode") == "independent")
                                            & F.col("average_return").isNotNull())
    low = table.orderBy("average_return", "ticker").limit(5)
    high = table.orderBy(F.col("average_return").desc(), "ticker").limit(5)
    chosen = low.select("ticker").union(high.select("ticker")).distinct()
    return table.join(chosen, "ticker", "left_semi").select(
        "ticker", "trade_count", "average_return", "median_return", "win_rate", "profit_factor")


@query
def ranked_page(spark, folder):
    """Second page of the trades sorted by net return, missing values last."""
    table = studies.fold_trades(spark, folder).select("mode", "timestamp", "ticker", "status", "net_return")
    return table.orderBy(F.col("net_return").desc_nulls_last(), "mode", "timestamp", "ticker").offset(25).limit(25)


@query
def table_diff(spark, folder):
    """Rows in one of two event tables only: detected events against fold events."""
    keys = ("timestamp", "ticker", "dip_component_count")
    detected = market.signals(spark, folder).where("dip_event_v1").select(*keys)
    used = events(spark, folder).select(*keys).distinct()
    missing = detected.exceptAll(used).withColumn("side", F.lit("detected_only"))
    return missing.unionByName(used.exceptAll(detected).withColumn("side", F.lit("used_only")))
