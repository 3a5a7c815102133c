"""Registered queries: exit-policy research."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.numeric import rounded
from tidemark.operators import calendar, outcomes, policies, robustness, stats
from tidemark.plans import market, studies
from tidemark.plans.market import kept

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: rounded(function(spark, folder))
    return function


@kept
def paths(spark, folder) -> DataFrame:
    """Every event with its next ten bars and its range at the signal."""
    table = outcomes.event_paths(market.signals(spark, folder))
    return table.select("timestamp", "ticker", "position", "split", "dip_component_count", "atr_pct_14", "path", "_split_end")


def ledger(spark, folder) -> DataFrame:
    """Events under every candidate; row-local, so it is labelled where it is needed."""
    return policies.label(policies.each_candidate(paths(spark, folder)))


@kept
def training(spark, folder) -> DataFrame:
    """Every candidate's trades as each fold's history knows them; labelled once, for all that follows."""
    table = ledger(spark, folder).select(
        "timestamp", "ticker", "position", "candidate_id", "family", "status", "stop_fraction", "target_fraction", "ambiguous_bar",
        "next_timestamp", "window_end_timestamp", *outcomes.OUTCOME_COLUMNS)
    return policies.training_view(table, studies.folds(spark, folder))


@kept
def surface(spark, folder) -> DataFrame:
    return policies.on_frontier(policies.training_surface(training(spark, folder)))


@kept
def chosen(spark, folder) -> DataFrame:
    return policies.select_policies(surface(spark, folder), studies.folds(spark, folder))


@kept
def independent(spark, folder) -> DataFrame:
    return policies.out_of_sample(paths(spark, folder), studies.folds(spark, folder), chosen(spark, folder))


@kept
def oos(spark, folder) -> DataFrame:
    """Both modes of the chosen policies; diagnostics follow the trades that were taken."""
    single = independent(spark, folder)
    thinned = outcomes.thin(single, keys=("fold", "policy", "ticker")).drop(
        "full_window_mfe", "full_window_mae", "post_exit_mfe", "mfe_capture", "net_mfe_capture", "remaining_mfe", "net_r",
        *[f"stopped_recovered_{p}pct" for p in fixed.REBOUND_LEVELS])
    thinned = policies.with_diagnostics(thinned)
    return (single.withColumn("mode", F.lit("independent"))
            .unionByName(thinned.withColumn("mode", F.lit("non_overlapping"))).drop("path", "_split_end"))


@query
def catalog(spark, folder):
    """The catalogue with the mean fractions it gives the events."""
    stop, target = policies.fractions(F.col("atr_pct_14"))
    rows = policies.each_candidate(paths(spark, folder)).withColumns({"s": stop, "t": target})
    return rows.groupBy(*policies.CANDIDATE_FIELDS).agg(
        F.count(F.lit(1)).alias("events"), F.avg("s").alias("mean_stop"), F.avg("t").alias("mean_target"))


@query
def candidate_fractions(spark, folder):
    stop, target = policies.fractions(F.col("atr_pct_14"))
    return policies.each_candidate(paths(spark, folder)).select(
        "timestamp", "ticker", "candidate_id", stop.alias("stop_fraction"), target.alias("target_fraction"))


@query
def candidate_ledger(spark, folder):
    return ledger(spark, folder).select(
        "timestamp", "ticker", "candidate_id", "status", "exit_timestamp", "exit_reason", "holding_bars", "net_return", "mfe", "mae")


@query
def boundary_view(spark, folder):
    """Training ledgers after the maturity gate, per fold, candidate and status."""
    known = calendar.training_folds(ledger(spark, folder), studies.folds(spark, folder))
    return policies.boundary_view(known, F.col("history_end")).groupBy("fold", "candidate_id", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("net_return").alias("net_sum"))


@query
def non_overlap_view(spark, folder):
    return oos(spark, folder).where(F.col("mode") == "non_overlapping").select(
        "fold", "policy", "timestamp", "ticker", "status", "exit_timestamp", "exit_reason", "net_return")


METRICS = ("candidate_count", "trade_count", "excluded_count", "win_rate", "average_win", "average_loss", "expected_value",
           "median_return", "std", "break_even_win_rate", "profit_factor", "take_profit_count", "stop_loss_count",
           "time_exit_count", "r_count", "expectancy_r", "median_r", "average_winning_r", "average_losing_r", "r_win_rate",
           "fifth_percentile_net", "worst_ticker_trade_close_drawdown", "median_ticker_trade_close_drawdown")


@kept
def fold_summary(spark, folder) -> DataFrame:
    return policies.policy_metrics(oos(spark, folder), ("fold", "policy", "mode"))


@kept
def aggregate_summary(spark, folder) -> DataFrame:
    return policies.policy_metrics(oos(spark, folder), ("policy", "mode"))


@kept
def ticker_summary(spark, folder) -> DataFrame:
    return policies.policy_metrics(oos(spark, folder), ("policy", "mode", "ticker"))


@query
def training_surface(spark, folder):
    return surface(spark, folder).select("fold", "candidate_id", "family", *METRICS)


@query
def policy_metrics(spark, folder):
    return fold_summary(spark, folder).select("fold", "policy", "mode", *METRICS)


@query
def policy_walkforward(spark, folder):
    return aggregate_summary(spark, folder).select("policy", "mode", *METRICS)


@query
def policy_by_ticker(spark, folder):
    return ticker_summary(spark, folder).select("policy", "mode", "ticker", *METRICS)


@query
def training_selection(spark, folder):
    return chosen(spark, folder)


@query
def stop_target_distribution(spark, folder):
    """Spread of both barriers of completed trades by fold and symbol: of each candidate in training, of each policy and mode after it."""
    fractions = ("stop_fraction", "target_fraction")
    done = F.col("status") == "completed"
    before = training(spark, folder).where(done).select("fold", "ticker", "candidate_id", "family", *fractions)
    after = oos(spark, folder).where(done).select("fold", "ticker", "policy", "mode", *fractions)
    table = before.withColumn("period", F.lit("training")).unionByName(after.withColumn("period", F.lit("oos")), allowMissingColumns=True)
    by = ("period", "fold", "candidate_id", "family", "policy", "mode")
    spread = robustness.distribution_in_sets(table, fractions, by, {"ALL": (), "ticker": ("ticker",)}, undefined=True)
    return spread.withColumn("ticker", F.coalesce("ticker", F.lit("ALL"))).drop("grouping")


@query
def frontier(spark, folder):
    return surface(spark, folder).where("ev_win_frontier").select("fold", "candidate_id", "family", "expected_value", "win_rate")


@query
def plateaus(spark, folder):
    return policies.plateaus(surface(spark, folder))


@query
def exit_diagnostics(spark, folder):
    return oos(spark, folder).select(
        "fold", "policy", "mode", "timestamp", "ticker", "status", "full_window_mfe", "full_window_mae", "mfe_capture",
        "net_mfe_capture", "remaining_mfe", "net_r", "post_exit_mfe", *[f"stopped_recovered_{p}pct" for p in fixed.REBOUND_LEVELS])


@query
def exit_efficiency(spark, folder):
    table = robustness.in_sets(oos(spark, folder), {"ALL": (), "fold": ("fold",)})
    table = table.withColumn("fold", F.coalesce("fold", F.lit("ALL"))).drop("grouping")
    return policies.exit_efficiency(table, ("fold", "policy", "mode"))


@kept
def paired(spark, folder) -> DataFrame:
    return policies.paired_with_control(oos(spark, folder).where(F.col("mode") == "independent")).select(
        "fold", "timestamp", "ticker", "policy", "candidate_id", "net_return", "net_return_control", "paired_net_difference")


@query
def paired_comparison(spark, folder):
    return paired(spark, folder)


@query
def paired_uncertainty(spark, folder):
    return stats.summarize_returns(paired(spark, folder), "paired_net_difference", by=("policy",))


@query
def paired_by_ticker(spark, folder):
    means = paired(spark, folder).groupBy("policy", "ticker").agg(F.avg("paired_net_difference").alias("x"))
    return means.groupBy("policy").agg(
        F.count("x").alias("tickers"), F.count_if(F.col("x") > 0).alias("positive"), F.count_if(F.col("x") < 0).alias("negative"),
        *[F.percentile("x", F.lit(p)).alias(n) for n, p in (("median", 0.5), ("q25", 0.25), ("q75", 0.75))])


@query
def policy_pivot(spark, folder):
    """Expected value per fold of four policies, the gain over the control and changed choices."""
    names = ("training_selected", "v1_control", "time_only", "target_only")
    table = fold_summary(spark, folder).where(F.col("mode") == "independent").groupBy("fold").pivot(
        "policy", list(names)).agg(F.first("expected_value"))
    choice = chosen(spark, folder).where(F.col("policy") == "training_selected").select("fold", "candidate_id")
    before = F.lag("candidate_id").over(Window.partitionBy(F.lit(0)).orderBy("fold"))
    choice = choice.withColumn("changed", F.coalesce(F.col("candidate_id") != before, F.lit(False)))
    return table.join(choice, "fold").withColumn("gain", F.col("training_selected") - F.col("v1_control"))


SCORES = ("expected_value", "median_return", "win_rate", "profit_factor", "average_loss", "average_mfe", "average_mae")


@query
def scorecard(spark, folder):
    """Metric rows by policy columns, with the shares of positive folds and symbols as text."""
    names = ("training_selected", "v1_control", "time_only")
    values = aggregate_summary(spark, folder).select("mode", "policy", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in SCORES])).alias("m")).select("mode", "policy", "m.*")
    numbers = values.groupBy("mode", "metric").pivot("policy", list(names)).agg(F.first("value"))
    numbers = numbers.withColumn("difference", F.col("training_selected") - F.col("v1_control"))
    texts = None
    for metric, source in (("positive_folds", fold_summary), ("positive_tickers", ticker_summary)):
        counted = source(spark, folder).groupBy("mode", "policy").agg(F.concat_ws(
            "/", F.count_if(F.col("expected_value") > 0).cast("string"), F.count("expected_value").cast("string")).alias("text"))
        wide = counted.groupBy("mode").pivot("policy", list(names)).agg(F.first("text")).select(
            "mode", F.lit(metric).alias("metric"), *[F.col(n).alias(f"{n}_text") for n in names])
        texts = wide if texts is None else texts.unionByName(wide)
    return numbers.unionByName(texts, allowMissingColumns=True)
