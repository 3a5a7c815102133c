"""Registered queries: sources, checks, features, signals, calendar, outcomes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import symbols
from tidemark.functions.numeric import binned, rounded, scaled_barriers, with_costs
from tidemark.operators import calendar, features, outcomes, paths, series, signals as signal_ops
from tidemark.plans import market, studies
from tidemark.sources import quality, snapshots

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = lambda spark, folder: rounded(function(spark, folder))
    return function


KEYS = ("timestamp", "ticker")


# Sources and checks

@query
def bars_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return market.bars(spark, folder)


@query
def bars_events_hour(spark, folder):
    return market.hourly_event_bars(spark, folder)


@query
def scan_bars(spark, folder):
    return market.order_bars(spark, folder)


def stored(spark, folder) -> str:
    """Folder of a snapshot of both sources, written once for each session and source folder.

    Symbols of the second source were asked for only until the end of their history's last full month.
    """
    def write(path: str) -> None:
        both = market.bars(spark, folder).unionByName(market.order_bars(spark, folder))
        ranges = both.groupBy("ticker").agg(F.min("timestamp").alias("saved_start"), F.date_add(F.max("timestamp"), 1).alias("saved_end"))
        snapshots.write_snapshot(both, path, ranges, source="driver tables")
    return market.kept_folder(spark, folder, "stored", write)


@query
def scan_universe(spark, folder):
    """Two sources as one long table, read back from the stored snapshot; symbols are asked for untidily."""
    path = stored(spark, folder)
    asked = snapshots.read_catalogue(spark, path).select(
        F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))
    return snapshots.scan(spark, path, asked)


@query
def scan_requests(spark, folder):
    """Of the stored snapshot one and a half years of each symbol of the first source, and another year of those whose name ends in F."""
    path = stored(spark, folder)
    first = market.bars(spark, folder).groupBy("ticker").agg(F.min("timestamp").alias("start"))
    asked = first.select("ticker", "start", F.add_months("start", 18).alias("end")).unionByName(
        first.where(F.col("ticker").endswith("F")).select(
            "ticker", F.add_months("start", 12).alias("start"), F.add_months("start", 24).alias("end")))
    return snapshots.scan(spark, path, asked)


@query
def snapshot_refusals(spark, folder):
    """Requests of every kind against the stored snapshot: customers' segments as symbols, and ranges moved by the parity of a symbol's rows."""
    catalogue = snapshots.read_catalogue(spark, stored(spark, folder))
    moved = catalogue.select(
        "ticker", F.date_add("saved_start", (F.col("rows") % 2).cast("int") - 1).alias("start"),
        F.date_add("saved_end", (F.col("rows") % 3).cast("int") - 1).alias("end"))
    empty = catalogue.select("ticker", F.col("saved_end").alias("start"), F.col("saved_end").alias("end"))
    strange = market.table(spark, folder, "customer").groupBy("c_mktsegment").count().select(
        F.when(F.col("count") % 2 == 0, F.concat_ws(" ", F.col("c_mktsegment"), F.lit("?"))).otherwise(F.col("c_mktsegment")).alias("ticker"),
        F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))
    # Part of the catalogue is seen as written by another version.
    other = catalogue.withColumn("schema_version", F.when(F.col("rows") % 5 == 0, 2).otherwise(F.col("schema_version")))
    return snapshots.refusals(other, moved.unionByName(empty).unionByName(strange))


@query
def scan_date_range(spark, folder):
    """Bars in ``[validation start, test start)`` of symbols whose history covers it."""
    cuts = calendar.split_dates(market.context(spark, folder))
    start, end = cuts.select("validation_start").scalar(), cuts.select("test_start").scalar()
    bars = market.bars(spark, folder)
    covered = bars.groupBy("ticker").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    covered = covered.where((F.col("first") <= start) & (F.col("last") >= end))
    inside = bars.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return inside.join(covered, "ticker", "left_semi").select(*fixed.BAR_COLUMNS)


@query
def validate_bars(spark, folder):
    return quality.bar_violations(market.bars(spark, folder))


@query
def validate_faulty_bars(spark, folder):
    """The same checks on bars with faults of every kind, dealt out by a bar's volume."""
    bars = market.bars(spark, folder)
    v, at = F.col("volume"), F.col("timestamp").cast("timestamp_ntz")
    rows = bars.select(
        F.when(v % 53 == 0, None).otherwise(F.when(v % 11 == 0, at + F.expr("interval 90 minutes")).otherwise(at)).alias("timestamp"),
        F.when(v % 13 == 0, F.lower("ticker")).when(v % 31 == 0, F.concat("ticker", F.lit(" ?"))).otherwise(F.col("ticker")).alias("ticker"),
        F.when(v % 17 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"),
        F.when(v % 7 == 0, F.col("low") / 2).otherwise(F.col("high")).alias("high"), "low",
        F.when(v % 19 == 0, F.lit(float("nan"))).when(v % 23 == 0, F.lit(float("inf"))).when(v % 29 == 0, None).otherwise(F.col("close")).alias("close"),
        F.when(v % 37 == 0, -v).otherwise(v).alias("volume"), F.when(v % 41 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"))
    return quality.bar_violations(rows.withColumn("copy", F.explode("copies")).drop("copy", "copies"))


def raw_provider_rows(spark, folder) -> DataFrame:
    """Bars as a provider might send them: text, local offsets, untidy symbols, each row twice."""
    bars = market.bars(spark, folder)
    raw = bars.select(
        F.concat(F.date_format("timestamp", "yyyy-MM-dd"), F.lit("T00:00:00-05:00")).alias("Date"),
        F.concat(F.lit(" "), F.lower("ticker")).alias("Ticker"),
        *[F.col(c).cast("string").alias(c.capitalize()) for c in (*fixed.PRICE_COLUMNS, "volume")])
    return raw.unionByName(raw)


@query
def clean_bars(spark, folder):
    return quality.clean(raw_provider_rows(spark, folder))


def faulty_rows(spark, folder) -> DataFrame:
    """Bars whose high is wrongly the middle of open and close, and whose open came a day late."""
    frame = series.cut(series.with_position(market.bars(spark, folder)), back=1, ahead=0)
    frame = frame.withColumns({
        "high": (F.col("open") + F.col("close")) / 2, "open": F.lag("open", 1).over(series.over())})
    return series.own_rows(frame).select(
        "ticker", F.col("position").alias("row_position"), F.col("timestamp").alias("session"), *fixed.PRICE_COLUMNS)


@query
def audit_ohlc(spark, folder):
    return quality.audit_ohlc(faulty_rows(spark, folder))


@query
def audit_summary(spark, folder):
    raw = faulty_rows(spark, folder)
    return quality.audit_summary(raw, quality.audit_ohlc(raw), studies.requested(spark, folder))


@query
def audit_totals(spark, folder):
    return audit_summary(spark, folder).groupBy("diagnostic_status").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("rows").alias("rows"), F.sum("affected_rows").alias("affected_rows"),
        F.sum("violations").alias("violations"), F.max("max_relative_gap").alias("max_relative_gap"))


# Trailing features

def feature_frame(spark, folder, back: int = features.FEATURE_REACH) -> DataFrame:
    bars = features.with_index(market.bars(spark, folder), market.context(spark, folder))
    return series.cut(series.with_position(bars), back=back, ahead=0)


def _features(spark, folder, step, *columns, back: int = features.FEATURE_REACH) -> DataFrame:
    return series.own_rows(step(feature_frame(spark, folder, back))).select(*KEYS, *columns)


LONG = {"return_windows": (1, 250, 1000), "location_windows": (250, 1000), "zscore_windows": (1000,), "rsi_window": 60, "atr_window": 60,
        "volatility_windows": (250, 1000), "volume_windows": (1000,), "relative_windows": (1000,)}


@query
def features_long(spark, folder):
    """Measurements over windows far longer than the defaults, across segment boundaries."""
    built = features.build_features(market.bars(spark, folder), market.index(spark, folder), context_window=250, **LONG)
    return built.select(*KEYS, "return_250d", "return_1000d", "drawdown_1000d", "distance_from_low_1000d", "price_zscore_1000d", "rsi_60",
                        "atr_60", "volatility_1000d", "relative_volume_1000d", "relative_return_1000d", "benchmark_return_250d")


@query
def feat_returns(spark, folder):
    return _features(spark, folder, features.returns, *[f"return_{n}d" for n in features.RETURN_WINDOWS])


@query
def feat_location(spark, folder):
    return _features(spark, folder, features.locations, *[
        f"{c}_{n}d" for n in features.LOCATION_WINDOWS for c in ("drawdown", "distance_from_low", "distance_from_high")])


@query
def feat_zscore(spark, folder):
    return _features(spark, folder, features.zscores, "price_zscore_20d")


@query
def feat_rsi(spark, folder):
    return _features(spark, folder, lambda f: features.wilder_measures(f, atr=None), "rsi_14")


@query
def feat_atr(spark, folder):
    return _features(spark, folder, lambda f: features.wilder_measures(f, rsi=None), "true_range", "atr_14", "atr_pct_14")


@query
def wilder(spark, folder):
    """Recursive smoothing of the true range."""
    def step(frame):
        return features.wilder_measures(frame, rsi=None, atr=20)
    return _features(spark, folder, step, "atr_20", back=features.wilder_reach(20) + 1)


@query
def feat_volatility(spark, folder):
    return _features(spark, folder, lambda f: features.volatility(features.returns(f, (1,))), "volatility_20d", "volatility_60d")


@query
def feat_volume(spark, folder):
    return _features(spark, folder, features.volumes, "volume_mean_20d", "relative_volume_20d", "volume_zscore_20d")


@query
def feat_benchmark(spark, folder):
    return features.with_index(market.bars(spark, folder), market.context(spark, folder)).select(
        *KEYS, "benchmark_return_20d", "benchmark_drawdown_20d", "benchmark_volatility_20d")


@query
def feat_relative(spark, folder):
    return _features(spark, folder, features.relative, *[f"relative_return_{n}d" for n in features.RELATIVE_WINDOWS])


FEATURE_COLUMNS = (
    *[f"return_{n}d" for n in features.RETURN_WINDOWS],
    *[f"{c}_{n}d" for n in (20, 60) for c in ("drawdown", "distance_from_low", "distance_from_high")],
    "price_zscore_20d", "rsi_14", "true_range", "atr_14", "atr_pct_14", "volatility_20d", "volatility_60d",
    "volume_mean_20d", "relative_volume_20d", "volume_zscore_20d",
    *[f"relative_return_{n}d" for n in features.RELATIVE_WINDOWS],
    "benchmark_return_20d", "benchmark_drawdown_20d", "benchmark_volatility_20d")


@query
def features_all(spark, folder):
    return features.build_features(market.bars(spark, folder), market.index(spark, folder)).select(
        *fixed.BAR_COLUMNS, *FEATURE_COLUMNS)


def middle_of(rows: int):
    """A user's function: median close of ``rows`` rows and how far the close is above it."""
    def callback(bars: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        close, middle = bars["close"], np.full(len(bars["close"]), np.nan)
        if len(close) >= rows:
            middle[rows - 1:] = np.median(np.lib.stride_tricks.sliding_window_view(close, rows), axis=1)
        return {"median_close": middle, "above_median": close / middle - 1}
    return callback


@query
def feat_callback(spark, folder):
    """A measure the library does not have, by a function over the arrays of a series."""
    made = features.with_callback(market.bars(spark, folder), middle_of(15), "median_close double, above_median double", reach=14)
    return made.select(*KEYS, "median_close", "above_median")


@query
def feat_dd_change(spark, folder):
    def step(frame):
        return features.drawdown_change(features.locations(frame, (60,)))
    return _features(spark, folder, step, "drawdown_change_5")


@query
def vol_tercile(spark, folder):
    return signal_ops.volatility_tercile(market.signals(spark, folder)).select(
        *KEYS, "atr_pct_14", "volatility_low", "volatility_high", "volatility_group")


# Thresholds and events

THRESHOLD_COLUMNS = tuple(f"{c}_threshold" for c in fixed.SIGNAL_FEATURES)
FLAG_COLUMNS = ("dip_ready_v1", "dip_component_count", "dip_condition_v1", "dip_event_v1")


@query
def thresholds(spark, folder):
    return market.signals(spark, folder).select(*KEYS, *THRESHOLD_COLUMNS)


@query
def components(spark, folder):
    return market.signals(spark, folder).select(*KEYS, *fixed.SIGNAL_COMPONENTS, "dip_ready_v1")


@query
def signals(spark, folder):
    return market.signals(spark, folder).select(*KEYS, *FLAG_COLUMNS)


@query
def dip_events(spark, folder):
    """Flagship: raw ticks to event rows in one declarative plan, nothing kept between steps."""
    context = features.index_context(market.index(spark, folder))
    return signal_ops.build_signals(market.bars(spark, folder), context).where("dip_event_v1").select(*KEYS, "close", *fixed.SIGNAL_FEATURES, *THRESHOLD_COLUMNS, "dip_component_count")


@query
def combination(spark, folder):
    return (market.signals(spark, folder).where("dip_ready_v1").groupBy(signal_ops.combination().alias("combination"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count_if("dip_event_v1").alias("events")))


@query
def signal_input_checks(spark, folder):
    """Counts of signal rows with bad keys or infinite inputs."""
    infinite = F.lit(False)
    for c in fixed.SIGNAL_FEATURES:
        infinite = infinite | F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf"))
    per_key = market.signals(spark, folder).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(infinite, F.lit(False))).alias("bad"),
        *[F.count(c).alias(c) for c in fixed.SIGNAL_FEATURES])
    return per_key.agg(
        F.sum("n").alias("rows"), F.count_if(F.col("timestamp").isNull() | F.col("ticker").isNull()).alias("missing_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.sum("bad").alias("infinite_inputs"),
        *[F.sum(c).alias(f"defined_{c}") for c in fixed.SIGNAL_FEATURES])


def _invariants(table: DataFrame) -> DataFrame:
    """Counts of rows that break the order event, condition, ready, or the split rules."""
    per_date = table.groupBy("timestamp").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("splits"),
        F.count_if(F.col("dip_event_v1") & ~F.col("dip_condition_v1")).alias("event_without_condition"),
        F.count_if(F.col("dip_condition_v1") & ~F.col("dip_ready_v1")).alias("condition_without_ready"),
        F.count_if(~F.col("dip_component_count").between(0, 4)).alias("bad_count"),
        F.collect_set("split").alias("names"))

    def within(name: str, pick) -> Column:
        return pick(F.when(F.array_contains("names", name), F.col("timestamp")))
    found = per_date.agg(
        F.sum("n").alias("rows"), F.sum("event_without_condition").alias("event_without_condition"),
        F.sum("condition_without_ready").alias("condition_without_ready"), F.sum("bad_count").alias("bad_count"),
        F.count_if(F.col("splits") > 1).alias("mixed_dates"), within("research", F.max).alias("last_research"),
        within("validation", F.min).alias("_first_validation"), within("validation", F.max).alias("_last_validation"),
        within("test", F.min).alias("first_test"))
    late = [(F.col("last_research") >= F.col("_first_validation")), (F.col("_last_validation") >= F.col("first_test")),
            (F.col("last_research") >= F.col("first_test"))]
    unordered = sum((F.coalesce(x.cast("long"), F.lit(0).cast("long")) for x in late), F.lit(0).cast("long"))
    return found.withColumn("unordered_splits", unordered).drop("_first_validation", "_last_validation")


@query
def signal_invariants(spark, folder):
    return _invariants(studies.split_signals(spark, folder))


@query
def signal_invariants_faulty(spark, folder):
    """The same on rows whose flags, counts and splits are spoilt, dealt out by volume."""
    table, v = studies.split_signals(spark, folder), F.col("volume")
    return _invariants(table.withColumns({
        "dip_event_v1": F.col("dip_event_v1") | (v % 13 == 0), "dip_condition_v1":
        F.when(v % 17 == 0, ~F.col("dip_condition_v1")).otherwise(F.col("dip_condition_v1")),
        "dip_component_count": F.when(v % 19 == 0, F.col("dip_component_count") + 5).otherwise(F.col("dip_component_count")),
        "split": F.when(v % 23 == 0, "research").otherwise(F.col("split"))}))


@query
def extract_events(spark, folder):
    return outcomes.extract_events(studies.split_signals(spark, folder))


@query
def observation_filter(spark, folder):
    """Explorer view: events of three or more components in the validation period."""
    table = studies.split_signals(spark, folder)
    return table.where((F.col("split") == "validation") & F.col("dip_event_v1") & (F.col("dip_component_count") >= 3)
                       ).select(*KEYS, "close", "dip_component_count", "dip_condition_v1", "split")


@query
def diag_bins(spark, folder):
    table = market.signals(spark, folder)
    value = F.col("relative_volume_20d")
    return table.groupBy(binned(value, fixed.DIAGNOSIS_EDGES["relative_volume_20d"]).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(value).alias("smallest"), F.max(value).alias("largest"))


# Calendar and universe

@query
def splits(spark, folder):
    return studies.split_signals(spark, folder).groupBy("split").agg(
        F.countDistinct("timestamp").alias("sessions"), F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query
def folds(spark, folder):
    return studies.folds(spark, folder)


@query
def fold_checks(spark, folder):
    return calendar.fold_violations(studies.folds(spark, folder))


@query
def regimes(spark, folder):
    return market.context(spark, folder).select("timestamp", calendar.regime().alias("regime"))


@query
def universe_select(spark, folder):
    """Requested symbols less those on an excluded status."""
    wanted = studies.requested(spark, folder).select(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"))
    excluded = market.table(spark, folder, "lineitem").where(F.col("l_linestatus") == "F").select(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"))
    return calendar.static_universe(wanted, excluded)


@query
def membership_checks(spark, folder):
    return calendar.membership_violations(studies.membership(spark, folder))


@query
def membership(spark, folder):
    table = calendar.with_membership(market.bars(spark, folder), studies.membership(spark, folder))
    return table.select(*KEYS, "member")


@query
def norm_symbol(spark, folder):
    """Brand, type and name texts as symbols, with their validity."""
    part = market.table(spark, folder, "part")
    texts = part.select(F.explode(F.array("p_brand", "p_type", "p_name")).alias("text")).groupBy("text").agg(
        F.count(F.lit(1)).alias("uses"))
    symbol = symbols.normalized(F.regexp_replace("text", " ", "."))
    return texts.select("text", "uses", symbol.alias("symbol"), symbols.is_valid(symbol).alias("valid"))


@query
def walkforward(spark, folder):
    """Outcomes and trades of every fold, as counts and sums per fold and ledger."""
    forward = studies.fold_outcomes(spark, folder).select(
        "fold", F.col("selection").alias("ledger"), F.col("horizon").cast("long").alias("horizon"), "status",
        F.col("forward_return").alias("value"), F.col("excess_return").alias("extra"))
    trades = studies.fold_trades(spark, folder).select(
        "fold", F.col("mode").alias("ledger"), F.lit(10).cast("long").alias("horizon"), "status",
        F.col("net_return").alias("value"), F.col("mfe").alias("extra"))
    return forward.unionByName(trades).groupBy("fold", "ledger", "horizon", "status").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value_sum"), F.sum("extra").alias("extra_sum"))


# Outcomes

OUTCOME_COLUMNS = (*outcomes.IDENTITY, "horizon", "selection", "status", "entry_timestamp", "end_timestamp",
                   "entry_price", "forward_return", "mfe", "mae")


def forward(spark, folder, *selections) -> DataFrame:
    return outcomes.forward_outcomes(studies.split_signals(spark, folder), selections=selections)


@query
def outcomes_events(spark, folder):
    return forward(spark, folder, "events").select(*OUTCOME_COLUMNS)


@query
def outcomes_eligible(spark, folder):
    return forward(spark, folder, "eligible").select(*OUTCOME_COLUMNS)


@query
def outcomes_non_signal(spark, folder):
    return forward(spark, folder, "non_signal").select(*OUTCOME_COLUMNS)


@query
def outcomes_excess(spark, folder):
    return forward(spark, folder, "events").select(
        *KEYS, "horizon", "status", "forward_return", "benchmark_return", "excess_return")


COSTS = {"commission": fixed.COMMISSION, "slippage": fixed.SLIPPAGE}


def trades(spark, folder, **parameters) -> DataFrame:
    return outcomes.barrier_trades(studies.split_signals(spark, folder).select(*outcomes.TRADE_INPUTS), **{**COSTS, **parameters})


@query
def barrier_independent(spark, folder):
    return trades(spark, folder).select(*outcomes.TRADE_COLUMNS)


@query
def barrier_optimistic(spark, folder):
    return trades(spark, folder, ambiguity="optimistic", take_profit=0.5, stop_loss=0.3).select(*outcomes.TRADE_COLUMNS)


@query
def barrier_non_overlapping(spark, folder):
    return trades(spark, folder, mode="non_overlapping").select(*outcomes.TRADE_COLUMNS)


def wide_split(spark, folder) -> DataFrame:
    """Signals of a universe of one series a supplier with their splits, as labels need them."""
    split = calendar.with_split(market.wide_signals(spark, folder), calendar.split_dates(market.context(spark, folder)))
    return split.select(*outcomes.TRADE_INPUTS)


@query
def bars_wide(spark, folder):
    return market.wide_bars(spark, folder)


@query
def dip_events_wide(spark, folder):
    return market.wide_signals(spark, folder).where("dip_event_v1").select(
        *KEYS, "close", *fixed.SIGNAL_FEATURES, *THRESHOLD_COLUMNS, "dip_component_count")


@market.kept
def wide_single(spark, folder) -> DataFrame:
    """Every trade of the wide universe on its own, labelled once for both modes."""
    spread = market.partitions_for(market.wide_signals(spark, folder))
    return outcomes.barrier_trades(wide_split(spark, folder), spread=spread, **COSTS).select("position", *outcomes.TRADE_COLUMNS)


@query
def barrier_wide(spark, folder):
    return wide_single(spark, folder).select(*outcomes.TRADE_COLUMNS)


@query
def barrier_non_overlapping_wide(spark, folder):
    return outcomes.thin(wide_single(spark, folder)).select(*outcomes.TRADE_COLUMNS)


@query
def barrier_columns(spark, folder):
    """Per-event fractions from the signal row's own range."""
    table = studies.split_signals(spark, folder).withColumns({
        "own_stop": F.least(F.col("atr_pct_14"), F.lit(0.2)), "own_target": F.least(F.col("atr_pct_14") * 2, F.lit(0.3))})
    return outcomes.barrier_trades(table, stop_loss_column="own_stop", take_profit_column="own_target", **COSTS).select(
        *outcomes.TRADE_COLUMNS, "stop_fraction", "target_fraction")


@query
def apply_costs(spark, folder):
    """Buying each bar's open and selling its close, costs on both sides."""
    costs = with_costs(F.col("open"), F.col("close"), fixed.COMMISSION, fixed.SLIPPAGE)
    return market.bars(spark, folder).select(*KEYS, *[v.alias(k) for k, v in costs.items()])


@query
def atr_barriers(spark, folder):
    table = market.signals(spark, folder).where("dip_event_v1")
    levels = scaled_barriers(F.col("close"), F.col("atr_14"), 0.5, 1.5)
    return table.select(*KEYS, *[v.alias(k) for k, v in levels.items()])


@query
def event_context(spark, folder):
    return outcomes.event_context(outcomes.event_paths(market.signals(spark, folder)))


@query
def rebound_paths(spark, folder):
    return paths.rebound_paths(studies.observations(spark, folder))


@query
def prior_visits(spark, folder):
    table = studies.observations(spark, folder)
    return paths.prior_visits(table.where("dip_event_v1"), paths.rebound_paths(table))


@query
def context_as_of(spark, folder):
    """Context of every symbol at the session where the validation period starts."""
    cuts = calendar.split_dates(market.context(spark, folder))
    return paths.context_as_of(market.signals(spark, folder), cuts.select("validation_start").scalar(), calendar.regime())
