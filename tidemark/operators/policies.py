"""Exit-policy research: catalogue, labels, training-only selection and diagnostics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.numeric import clip
from tidemark.operators import calendar, outcomes, stats
from tidemark.operators.quantiles import with_quantiles

CANDIDATE_SCHEMA = ("array<struct<candidate_id string, family string, stop double, target double, "
                    "stop_multiplier double, target_multiplier double, reward_risk double, x int, y int>>")
CANDIDATE_FIELDS = ("candidate_id", "family", "stop", "target", "stop_multiplier", "target_multiplier", "reward_risk")


def candidates() -> list[dict]:
    """The catalogue from its axes; ``x`` and ``y`` are places on the family's grid."""
    stops = sorted({s for s, _ in fixed.FIXED_PAIRS})
    targets = sorted({t for _, t in fixed.FIXED_PAIRS})
    rows = [{"candidate_id": f"fixed_s{s:02d}_t{t:02d}", "family": "fixed", "stop": s / 100, "target": t / 100,
             "x": stops.index(s), "y": targets.index(t)} for s, t in fixed.FIXED_PAIRS]
    grids = (("atr", "atr_s{}_t{}", "target_multiplier", fixed.TARGET_MULTIPLIERS),
             ("r_multiple", "r_s{}_r{}", "reward_risk", fixed.REWARD_RISK_RATIOS))
    for family, name, second, axis in grids:
        rows += [{"candidate_id": name.format(s, v), "family": family, "stop_multiplier": float(s), second: float(v),
                  "x": i, "y": j} for i, s in enumerate(fixed.STOP_MULTIPLIERS) for j, v in enumerate(axis)]
    barriers = {"v1_control": (fixed.STOP_LOSS, fixed.TAKE_PROFIT), "target_only": (None, fixed.TAKE_PROFIT),
                "stop_only": (fixed.STOP_LOSS, None), "time_only": (None, None)}
    return rows + [{"candidate_id": c, "family": "control", "stop": barriers[c][0], "target": barriers[c][1]}
                   for c in fixed.CONTROL_POLICIES]


def each_candidate(table: DataFrame) -> DataFrame:
    """Every row once per candidate, by exploding the catalogue constant on the row."""
    catalogue = F.from_json(F.lit(json.dumps(candidates())), CANDIDATE_SCHEMA)
    return table.withColumn("_c", F.explode(catalogue)).select("*", "_c.*").drop("_c")


def fractions(atr: Column) -> tuple[Column, Column]:
    """Stop and target fraction of a candidate row, frozen at the signal.

    A family that scales by the range refuses a row whose range is undefined or not positive and finite: a null
    fraction would switch its barriers off.
    """
    direct = F.col("family").isin("fixed", "control")
    sound = F.coalesce((atr > 0) & (atr < float("inf")), F.lit(False))
    atr = F.when(direct | sound, atr).otherwise(F.raise_error(F.concat(
        F.lit("no usable range at the signal for "), F.col("candidate_id"))).cast("double"))
    stop = clip(atr * F.col("stop_multiplier"), *fixed.STOP_BOUNDS)
    wanted = F.when(F.col("family") == "atr", atr * F.col("target_multiplier")).otherwise(stop * F.col("reward_risk"))
    return (F.when(direct, F.col("stop")).otherwise(stop),
            F.when(direct, F.col("target")).otherwise(clip(wanted, *fixed.TARGET_BOUNDS)))


def label(rows: DataFrame, *, until: str | None = None) -> DataFrame:
    """Barrier labels for rows that carry a path and a candidate; adds the path's dates."""
    stop, target = fractions(F.col("atr_pct_14"))
    labelled = outcomes.label_barriers(rows, stop=stop, target=target, until=until,
                                       commission=fixed.COMMISSION, slippage=fixed.SLIPPAGE)
    whole = F.size("path") == fixed.HOLDING_BARS
    return labelled.withColumns({
        "next_timestamp": F.get("path", 0).timestamp,
        "window_end_timestamp": F.when(whole, F.get("path", fixed.HOLDING_BARS - 1).timestamp)})


def boundary_view(ledger: DataFrame, end: Column) -> DataFrame:
    """Blank trades whose full path was not over by ``end``; a filter on knowledge, not on rows."""
    no_next = F.col("next_timestamp").isNull() | (F.col("next_timestamp") > end)
    incomplete = F.col("window_end_timestamp").isNull() | (F.col("window_end_timestamp") > end)
    status = F.when(no_next, "no_next_bar").when(incomplete, "incomplete_window").otherwise(F.col("status"))
    gated = ledger.withColumn("status", status)
    return outcomes.cleared(gated, F.col("status") == "completed")


def policy_metrics(ledger: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Trade metrics, exit counts, multiples of risk, tail and per-symbol drawdowns."""
    done = F.col("status") == "completed"
    risk = F.when(F.col("stop_fraction") > 0, F.col("stop_fraction"))
    table = ledger.withColumn("_r", F.when(done, F.col("net_return") / risk))
    r = F.col("_r")
    extra = [F.count_if(done & (F.col("exit_reason") == c)).alias(f"{c}_count")
             for c in ("take_profit", "stop_loss", "time_exit")]
    extra += [F.count(r).alias("r_count"), F.avg(r).alias("expectancy_r"), F.avg(r).alias("average_r"),
              F.avg(F.when(r > 0, r)).alias("average_winning_r"), F.avg(F.when(r < 0, r)).alias("average_losing_r"),
              stats.share(r > 0, r).alias("r_win_rate")]
    metrics = stats.trade_metrics(table, by, extra=extra, quantiles={
        "median_r": ("_r", 0.5), "fifth_percentile_net": ("_x", 0.05)})
    slim = ledger.select(*by, *[c for c in ("ticker", "timestamp") if c not in by], "position", "status",
                         "holding_bars", "ambiguous_bar", *[c for c in outcomes.OUTCOME_COLUMNS if c != "holding_bars"])
    keys = tuple(dict.fromkeys((*by, "ticker")))
    thinned = outcomes.thin(slim, keys=keys).where(done)
    falls = stats.sequential_metrics(thinned, "net_return", by=keys, order="timestamp").groupBy(*by).agg(
        F.min("maximum_drawdown").alias("worst_ticker_trade_close_drawdown"),
        F.percentile("maximum_drawdown", F.lit(0.5)).alias("median_ticker_trade_close_drawdown"))
    return metrics.join(falls, list(by), "left")


def training_view(ledger: DataFrame, folds: DataFrame) -> DataFrame:
    """The ledger once for each fold whose history holds a signal, immature paths excluded."""
    return boundary_view(calendar.training_folds(ledger, folds), F.col("history_end"))


def training_surface(known: DataFrame) -> DataFrame:
    """Metrics of every candidate on each fold's history, from its ``training_view``."""
    return policy_metrics(known, ("fold", "candidate_id", "family"))


def parameters() -> Column:
    """A candidate's parameters as JSON, by its id; keys in order, those it lacks left out."""
    rows = F.from_json(F.lit(json.dumps(candidates())), CANDIDATE_SCHEMA)
    names = sorted(set(CANDIDATE_FIELDS) - {"candidate_id"})
    pairs = F.transform(rows, lambda c: F.struct(c.candidate_id.alias("key"), F.to_json(F.struct(
        c.candidate_id.alias("candidate_id"), *[c[n].alias(n) for n in names])).alias("value")))
    return F.element_at(F.map_from_entries(pairs), F.col("candidate_id"))


def value_for_ties(column: str) -> Column:
    """Means summed in parallel differ in their last bits; ties are decided at twelve decimals."""
    return F.round(F.col(column), 12)


def on_frontier(surface: DataFrame) -> DataFrame:
    """Flag candidates of a fold that no other beats on expected value and win rate.

    A better win rate at an equal or higher value shows in a running maximum; a higher
    value at an equal win rate shows in the maximum over that win rate. No pairs are formed.
    """
    table = surface.withColumns({"_ev": value_for_ties("expected_value"), "_win": value_for_ties("win_rate")})
    better_win = F.max("_win").over(Window.partitionBy("fold").orderBy(F.col("_ev").desc_nulls_last())
                                    .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    better_value = F.max("_ev").over(Window.partitionBy("fold", "_win"))
    beaten = (better_win > F.col("_win")) | (better_value > F.col("_ev"))
    return table.withColumn("ev_win_frontier", F.col("_ev").isNotNull() & F.col("_win").isNotNull() & ~F.coalesce(beaten, F.lit(False))
                            ).drop("_ev", "_win")


def plateaus(surface: DataFrame) -> DataFrame:
    """Per fold and family: the winner, near-best candidates and those next to it on the grid."""
    grid = each_candidate(surface.select("fold").distinct()).select("fold", "candidate_id", "x", "y")
    table = surface.where(F.col("family") != "control").join(grid, ["fold", "candidate_id"]).withColumn(
        "_ev", value_for_ties("expected_value"))
    best = F.first(F.struct("candidate_id", "_ev", "x", "y")).over(
        Window.partitionBy("fold", "family").orderBy(F.col("_ev").desc_nulls_last(), "candidate_id"))
    table = table.withColumn("_best", best)
    near = F.col("_ev") >= F.col("_best._ev") - fixed.PLATEAU_TOLERANCE
    apart = F.abs(F.col("x") - F.col("_best.x")) + F.abs(F.col("y") - F.col("_best.y"))
    return (table.where(F.col("_best._ev").isNotNull()).groupBy("fold", "family", F.col("_best.candidate_id").alias("winner"))
            .agg(F.count_if(near).alias("near_best_count"), F.count_if(near & (apart == 1)).alias("adjacent_near_best_count"))
            .withColumn("plateau_flag", (F.col("near_best_count") >= 3) & (F.col("adjacent_near_best_count") >= 2)))


def select_policies(surface: DataFrame, folds: DataFrame, *, minimum: int = fixed.MINIMUM_TRAINING_TRADES) -> DataFrame:
    """Per fold: best candidate overall and per family by training value, and the controls.

    Only training metrics are looked at. Where nothing qualifies the first control stands in.
    """
    usable = surface.where((F.col("family") != "control") & (F.col("trade_count") >= minimum)
                           & F.col("expected_value").isNotNull())
    asked = usable.withColumn("policy", F.explode(F.array(F.lit("training_selected"), F.concat(F.lit("best_"), F.col("family")))))
    order = Window.partitionBy("fold", "policy").orderBy(value_for_ties("expected_value").desc(), "candidate_id")
    best = asked.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == 1).select("fold", "policy", "candidate_id")
    searched = ["training_selected", *[f"best_{f}" for f in fixed.POLICY_FAMILIES]]
    slots = folds.select("fold", "history_end", "test_start", "test_end", F.explode(F.array(*[
        F.lit(p) for p in (*searched, *fixed.CONTROL_POLICIES)])).alias("policy"))
    control = F.when(F.col("policy").isin(*fixed.CONTROL_POLICIES), F.col("policy")).otherwise(F.lit(fixed.CONTROL_POLICIES[0]))
    chosen = slots.join(best, ["fold", "policy"], "left").withColumn("candidate_id", F.coalesce("candidate_id", control))
    fit = surface.select("fold", "candidate_id", F.col("expected_value").alias("training_net_ev"),
                         F.col("trade_count").alias("training_trades"))
    chosen = chosen.withColumn("parameters", parameters())
    return chosen.join(fit, ["fold", "candidate_id"], "left").withColumn(
        "fallback", F.col("policy").isin(*searched) & (F.col("candidate_id") == fixed.CONTROL_POLICIES[0]))


def with_diagnostics(ledger: DataFrame, holding: int = fixed.HOLDING_BARS) -> DataFrame:
    """Excursion capture and what followed the exit; the path on the row has it all."""
    done = F.col("status") == "completed"
    entry, highs = F.col("entry_price"), F.transform("path", lambda b: b.high)
    full = F.when(done, F.greatest(F.array_max(highs) / entry - 1, F.lit(0.0)))
    low = F.when(done, F.least(F.array_min(F.transform("path", lambda b: b.low)) / entry - 1, F.lit(0.0)))
    bars = F.col("holding_bars").cast("int")
    left = F.when(done & (bars < holding), F.array_max(F.slice(highs, bars + 1, F.lit(holding) - bars)) / entry - 1)
    table = ledger.withColumns({"full_window_mfe": full, "full_window_mae": low, "post_exit_mfe": left})
    base = F.when(F.col("full_window_mfe") > 0, F.col("full_window_mfe"))
    stopped = (F.col("exit_reason") == "stop_loss") & F.col("post_exit_mfe").isNotNull()
    return table.withColumns({
        "mfe_capture": F.col("gross_return") / base, "net_mfe_capture": F.col("net_return") / base,
        "remaining_mfe": F.when(done, F.greatest(F.col("full_window_mfe") - F.col("mfe"), F.lit(0.0))),
        "net_r": F.col("net_return") / F.when(F.col("stop_fraction") > 0, F.col("stop_fraction")),
        **{f"stopped_recovered_{p}pct": F.when(stopped, (F.col("post_exit_mfe") >= p / 100).cast("double"))
           for p in fixed.REBOUND_LEVELS}})


def out_of_sample(paths: DataFrame, folds: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen policies on their own test year, independent trades with diagnostics.

    Policies per fold are a fixed handful, so the choice is a small table by construction.
    """
    picked = chosen.select("fold", "policy", "candidate_id")
    grid = each_candidate(picked.select("fold").distinct()).select("fold", *CANDIDATE_FIELDS)
    picked = picked.join(grid, ["fold", "candidate_id"])
    rows = calendar.test_fold(paths, folds).join(F.broadcast(picked), "fold")
    return with_diagnostics(label(rows, until="test_end"))


def exit_efficiency(table: DataFrame, by: tuple[str, ...]) -> DataFrame:
    done = F.col("status") == "completed"
    values = {f"_{c}": F.when(done, F.col(c)) for c in ("full_window_mfe", "full_window_mae", "mfe_capture", "remaining_mfe")}
    table = table.withColumns(values)
    recovery = []
    for p in fixed.REBOUND_LEVELS:
        x = F.col(f"stopped_recovered_{p}pct")
        recovery += [F.count(x).alias(f"recovery_{p}pct_measurable_stops"),
                     F.coalesce(F.sum(x), F.lit(0.0)).cast("long").alias(f"recovery_{p}pct_count"),
                     F.avg(x).alias(f"recovery_{p}pct_rate")]
    groups = table.groupBy(*by).agg(
        F.count_if(done).alias("completed"), F.avg("_full_window_mfe").alias("mean_full_window_mfe"),
        F.avg("_full_window_mae").alias("mean_full_window_mae"), F.avg("_mfe_capture").alias("mean_capture"),
        F.count("_mfe_capture").alias("capture_count"), F.avg("_remaining_mfe").alias("mean_remaining_mfe"),
        F.count_if(done & (F.col("exit_reason") == "stop_loss")).alias("stopped_count"), *recovery)
    return with_quantiles(groups, table, by, {"median_capture": ("_mfe_capture", 0.5)})


def paired_with_control(ledger: DataFrame) -> DataFrame:
    """Each policy's trade beside the first control's trade of the same event.

    The handful of policies of one event share a window, so no self-join is needed.
    """
    done = F.col("status") == "completed"
    base = F.max(F.when(done & (F.col("policy") == fixed.CONTROL_POLICIES[0]), F.col("net_return"))).over(
        Window.partitionBy("fold", "timestamp", "ticker"))
    paired = ledger.withColumn("net_return_control", base)
    return paired.where((F.col("policy") != fixed.CONTROL_POLICIES[0]) & done & F.col("net_return_control").isNotNull()).withColumn(
        "paired_net_difference", F.col("net_return") - F.col("net_return_control"))
