"""Forward outcomes and first-touch barrier labels of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.numeric import touches, with_costs
from tidemark.operators import series

IDENTITY = ("timestamp", "ticker", "dip_component_count", "split")


def _split_column(table: DataFrame) -> DataFrame:
    return table if "split" in table.columns else table.withColumn("split", F.lit("all"))


def extract_events(signals: DataFrame) -> DataFrame:
    return _split_column(signals).where("dip_event_v1").select(*IDENTITY)


def _status(next_stamp: Column, end_stamp: Column, same_split: Column, until: Column | None) -> Column:
    if until is not None:
        next_stamp = F.when(next_stamp <= until, next_stamp)
        end_stamp = F.when(end_stamp <= until, end_stamp)
    return (F.when(next_stamp.isNull(), "no_next_bar").when(end_stamp.isNull(), "incomplete_window")
            .when(~same_split, "split_boundary").otherwise("completed"))


SELECTIONS = {
    "events": "dip_event_v1",
    "eligible": "dip_ready_v1",
    "non_signal": "dip_ready_v1 and not dip_condition_v1",
}


def forward_outcomes(signals: DataFrame, *, horizons=fixed.HORIZONS, selections=("events",),
                     until: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per selected row and horizon, entered at the next open.

    All horizons are read from one cut frame: leads for the end points, bounded frames for
    the extremes. Index open and close ride on the series' own rows, so the matched index
    return needs no further join. ``until`` names a date column no path may cross.
    """
    sizes = sorted(set(horizons))
    frame = series.cut(_split_column(signals), back=0, ahead=max(sizes))
    w = series.over()
    frame = frame.withColumns({
        "_entry_at": F.lead("timestamp", 1).over(w), "_entry": F.lead("open", 1).over(w),
        "_index_open": F.lead("benchmark_open", 1).over(w)})
    for n in sizes:
        path = w.rowsBetween(1, n)
        frame = frame.withColumns({
            f"_at_{n}": F.lead("timestamp", n).over(w), f"_close_{n}": F.lead("close", n).over(w),
            f"_split_{n}": F.lead("split", n).over(w), f"_index_{n}": F.lead("benchmark_close", n).over(w),
            f"_high_{n}": F.max("high").over(path), f"_low_{n}": F.min("low").over(path)})
    chosen = [(name, F.expr(SELECTIONS[name])) for name in selections]
    frame = series.own_rows(frame).withColumn(
        "_selections", F.filter(F.array(*[F.when(flag, name) for name, flag in chosen]), lambda s: s.isNotNull()))
    frame = frame.where(F.size("_selections") > 0)
    limit = F.col(until) if until else None
    per_horizon = F.array(*[F.struct(
        F.lit(n).alias("horizon"),
        _status(F.col("_entry_at"), F.col(f"_at_{n}"), F.col(f"_split_{n}") == F.col("split"), limit).alias("status"),
        F.col(f"_at_{n}").alias("end_at"), F.col(f"_close_{n}").alias("close"), F.col(f"_high_{n}").alias("high"),
        F.col(f"_low_{n}").alias("low"), F.col(f"_index_{n}").alias("index_close")) for n in sizes])
    long = (frame.withColumn("_h", F.explode(per_horizon))
            .withColumn("selection", F.explode("_selections")))
    done = F.col("_h.status") == "completed"
    entry, matched = F.col("_entry"), F.col("_h.index_close") / F.col("_index_open") - 1
    moved = F.col("_h.close") / entry - 1
    return long.select(
        *IDENTITY, *keep, F.col("_h.horizon").alias("horizon"), "selection", F.col("_h.status").alias("status"),
        F.when(done, F.col("_entry_at")).alias("entry_timestamp"), F.when(done, F.col("_h.end_at")).alias("end_timestamp"),
        F.when(done, entry).alias("entry_price"), F.when(done, moved).alias("forward_return"),
        F.when(done, F.col("_h.high") / entry - 1).alias("mfe"), F.when(done, F.col("_h.low") / entry - 1).alias("mae"),
        F.when(done, matched).alias("benchmark_return"), F.when(done, moved - matched).alias("excess_return"))


def event_paths(signals: DataFrame, *, holding: int = fixed.HOLDING_BARS,
                within: tuple[str, ...] = ("ticker",), spread: int | None = None) -> DataFrame:
    """Events with their next ``holding`` bars as an array, cut short at the series' end.

    The array is bounded by ``holding``; everything downstream of it is row-local. ``spread`` is the
    number of partitions the segments are dealt to, if not the session's.
    """
    frame = series.cut(_split_column(signals), back=0, ahead=holding)
    if spread is not None:
        frame = frame.repartition(spread, *within, "segment")
    w = series.over(within)
    bar = F.struct("timestamp", "open", "high", "low", "close")
    frame = frame.withColumns({
        "path": F.collect_list(bar).over(w.rowsBetween(1, holding)),
        "_split_end": F.lead("split", holding).over(w)})
    return series.own_rows(frame).where("dip_event_v1")


def _first_exit(holding: int, optimistic: bool) -> Column:
    """First bar of ``path`` that closes the trade, as a struct; NULL if the path is short."""
    upper, lower = F.col("_upper"), F.col("_lower")

    def exit_at(bar: Column, step: Column) -> Column:
        def leave(reason, price, fill, ambiguous):
            return F.struct(F.lit(reason).alias("reason"), price.alias("price"), F.lit(fill).alias("fill"),
                            ambiguous.alias("ambiguous"), (step + 1).cast("long").alias("bars"),
                            bar.timestamp.alias("at"))
        hit_high = F.coalesce(touches(bar.high, upper, above=True), F.lit(False))
        hit_low = F.coalesce(touches(bar.low, lower, above=False), F.lit(False))
        both, never = hit_high & hit_low, F.lit(False)
        stop_first = hit_low & ~hit_high if optimistic else hit_low
        return (F.when(touches(bar.open, lower, above=False), leave("stop_loss", bar.open, "open", never))
                .when(touches(bar.open, upper, above=True), leave("take_profit", bar.open, "open", never))
                .when(stop_first, leave("stop_loss", lower, "barrier", both))
                .when(hit_high, leave("take_profit", upper, "barrier", both))
                .when(step == holding - 1, leave("time_exit", bar.close, "close", never)))

    return F.get(F.filter(F.transform("path", exit_at), lambda hit: hit.isNotNull()), 0)


def label_barriers(paths: DataFrame, *, stop: Column, target: Column, holding: int = fixed.HOLDING_BARS,
                   ambiguity: str = "conservative", commission: float = 0.0, slippage: float = 0.0,
                   until: str | None = None) -> DataFrame:
    """First-touch label per event path; a NULL fraction disables that barrier.

    Row-local: no shuffle, whatever the number of policies the paths were exploded into.
    The signal's own position is kept as ``position``.
    """
    if ambiguity not in ("conservative", "optimistic"):
        raise ValueError("ambiguity must be conservative or optimistic")
    limit = F.col(until) if until else None
    entry = F.get("path", 0)
    end_at = F.when(F.size("path") == holding, F.get("path", holding - 1).timestamp)
    frame = paths.withColumns({
        "stop_fraction": stop.cast("double"), "target_fraction": target.cast("double"), "_entry": entry.open,
        "status": _status(entry.timestamp, end_at, F.col("_split_end") == F.col("split"), limit)})
    frame = frame.withColumns({
        "_upper": F.col("_entry") * (1 + F.col("target_fraction")),
        "_lower": F.col("_entry") * (1 - F.col("stop_fraction"))})
    frame = frame.withColumn("_exit", F.when(F.col("status") == "completed",
                                             _first_exit(holding, ambiguity == "optimistic")))
    bars, fill = F.col("_exit.bars"), F.col("_exit.fill")
    seen = F.slice("path", 1, bars.cast("int"))

    def extreme(field: str) -> Column:
        return F.transform(seen, lambda bar, i: F.when((i == bars - 1) & (fill == "open"), bar.open)
                           .otherwise(bar[field]))
    frame = frame.withColumns({
        "_best": F.when(bars.isNotNull(), F.array_max(extreme("high"))),
        "_worst": F.when(bars.isNotNull(), F.array_min(extreme("low")))})
    done = F.col("status") == "completed"
    price, base = F.col("_exit.price"), F.col("_entry")
    costs = with_costs(base, price, commission, slippage)
    return frame.withColumns({
        "entry_timestamp": F.when(done, entry.timestamp), "entry_price": F.when(done, base),
        "entry_fill_price": F.when(done, costs["entry_fill_price"]),
        "exit_timestamp": F.col("_exit.at"), "exit_price": price, "exit_fill_price": costs["exit_fill_price"],
        "exit_reason": F.col("_exit.reason"), "fill_type": fill, "holding_bars": bars,
        "gross_return": F.when(done, costs["gross_return"]), "net_return": F.when(done, costs["net_return"]),
        "mfe": F.when(done, F.greatest(F.col("_best"), base) / base - 1),
        "mae": F.when(done, F.least(F.col("_worst"), base) / base - 1),
        "ambiguous_bar": F.coalesce(F.col("_exit.ambiguous"), F.lit(False)),
        "excursion_scope": F.when(fill == "open", "through_exit_open").when(done, "through_exit_bar"),
    }).drop("_entry", "_upper", "_lower", "_exit", "_best", "_worst")


TRADE_INPUTS = (*IDENTITY, "position", "length", "open", "high", "low", "close", "dip_event_v1")
TRADE_COLUMNS = (
    *IDENTITY, "status", "entry_timestamp", "entry_price", "entry_fill_price", "exit_timestamp", "exit_price",
    "exit_fill_price", "exit_reason", "fill_type", "holding_bars", "gross_return", "net_return", "mfe", "mae",
    "ambiguous_bar", "excursion_scope")
OUTCOME_COLUMNS = (
    "entry_timestamp", "entry_price", "entry_fill_price", "exit_timestamp", "exit_price", "exit_fill_price",
    "exit_reason", "fill_type", "holding_bars", "gross_return", "net_return", "mfe", "mae", "excursion_scope")


def cleared(ledger: DataFrame, keep: Column) -> DataFrame:
    """Blank every outcome where ``keep`` does not hold."""
    out = {c: F.when(keep, F.col(c)) for c in OUTCOME_COLUMNS}
    return ledger.withColumns({**out, "ambiguous_bar": F.col("ambiguous_bar") & keep})


CELL = 256  # positions of a series whose rows one fold replays
FAN = 256  # children of a node
LEVELS = 2  # of nodes above the cells: a top node stands for 2**24 positions of a series


def _next_marker(marker: Column, row: Column) -> Column:
    """The last accepted exit after ``row``; only a completed trade that enters beyond the marker moves it."""
    return F.when((row._at + 1 > marker) & row._exit.isNotNull(), row._exit).otherwise(marker)


def _passed(children: Column, marker: Column) -> Column:
    """The marker behind a node that ``marker`` enters, from its children (at, sends) in order.

    A marker reaches less than a cell far, so a child that is missing, having no rows, sends nothing on.
    """
    end = F.aggregate(children, F.struct(F.lit(0).cast("long").alias("next"), marker.alias("marker")), lambda s, c: F.struct(
        (c.at + 1).alias("next"), F.get(c.sends, F.when(c.at == s.next, s.marker).otherwise(0)).alias("marker")))
    return F.when(end.next == FAN, end.marker).otherwise(0)


def _arrivals(children: Column, marker: Column) -> Column:
    """For each child (at, sends) in order the marker that enters it, if ``marker`` enters the first place of all."""
    def step(s: Column, c: Column) -> Column:
        arrived = F.when(c.at == s.next, s.marker).otherwise(0)
        return F.struct((c.at + 1).alias("next"), F.get(c.sends, arrived).alias("marker"),
                        F.concat(s.found, F.array(F.struct(c.at.alias("at"), arrived.alias("marker")))).alias("found"))
    none = F.array().cast("array<struct<at:bigint,marker:int>>")
    return F.aggregate(children, F.struct(F.lit(0).cast("long").alias("next"), marker.alias("marker"), none.alias("found")), step).found


def thin(ledger: DataFrame, *, keys: tuple[str, ...] = ("ticker",), holding: int = fixed.HOLDING_BARS) -> DataFrame:
    """Mark entries on or before the last accepted exit of their series as ``overlap``.

    The rule is sequential: only an accepted trade moves the marker. It is spread over tasks as a composition of
    functions. Positions are grouped into cells; an incoming marker reaches at most ``holding`` rows into a cell, so a cell is the
    function that sends each of these ``holding + 1`` markers on to the next cell, written out as a list. Functions compose
    associatively: ``FAN`` neighbours make one node with a list as short as theirs, and so on up. On
    the way down every node learns the marker that enters it and passes it through its children, and
    each cell then replays its own rows once. No list grows with the series but that of its top nodes, one entry for every
    ``CELL * FAN ** LEVELS`` positions, and rows are shuffled once. Keys may be null; a null key is one series.
    """
    size = max(CELL, holding)
    last = F.when(F.col("status") == "completed", F.col("position") + F.col("holding_bars"))
    row = F.struct(F.col("position").alias("_at"), last.cast("long").alias("_exit"), F.struct(*ledger.columns).alias("_all"))
    # As one struct, null keys are equal in the joins below.
    cells = (ledger.select(F.struct(*keys).alias("_key"), F.floor(F.col("position") / size).alias("_node"), row.alias("_row"))
             .groupBy("_key", "_node").agg(F.sort_array(F.collect_list("_row")).alias("_rows")))
    start = F.col("_node") * size - 1
    sends = F.transform(F.sequence(F.lit(0), F.lit(holding)), lambda d: F.greatest(
        F.aggregate("_rows", start + d, _next_marker) - (start + size), F.lit(0)).cast("int"))
    table, nodes = cells.select("_key", "_node", sends.alias("_sends")), []
    for _ in range(LEVELS):
        child = F.struct((F.col("_node") % FAN).alias("at"), F.col("_sends").alias("sends"))
        nodes.append(table.select("_key", F.floor(F.col("_node") / FAN).alias("_node"), child.alias("_child"))
                     .groupBy("_key", "_node").agg(F.sort_array(F.collect_list("_child")).alias("_children")))
        composed = F.transform(F.sequence(F.lit(0), F.lit(holding)), lambda d: _passed(F.col("_children"), d))
        table = nodes[-1].select("_key", "_node", composed.alias("_sends"))
    top = table.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct(F.col("_node").alias("at"), F.col("_sends").alias("sends")))).alias("_children"))
    entering = top.select("_key", F.explode(_arrivals(F.col("_children"), F.lit(0))).alias("_c")).select(
        "_key", F.col("_c.at").alias("_node"), F.col("_c.marker").alias("_marker"))
    for level in reversed(nodes):
        below = level.join(entering, ["_key", "_node"]).select(
            "_key", "_node", F.explode(_arrivals(F.col("_children"), F.col("_marker"))).alias("_c"))
        entering = below.select("_key", (F.col("_node") * FAN + F.col("_c.at")).alias("_node"), F.col("_c.marker").alias("_marker"))

    def replay(s: Column, r: Column) -> Column:
        return F.struct(_next_marker(s.marker, r).alias("marker"), F.concat(s.late, F.array(r._at + 1 <= s.marker)).alias("late"))
    late = F.aggregate("_rows", F.struct((start + F.col("_marker")).alias("marker"), F.array().cast("array<boolean>").alias("late")), replay).late
    rows = F.zip_with("_rows", late, lambda r, o: F.struct(r._all.alias("all"), o.alias("_overlap")))
    found = cells.join(entering, ["_key", "_node"]).select(F.explode(rows).alias("_r")).select("_r.all.*", "_r._overlap")
    return cleared(found.withColumn("status", F.when(F.col("_overlap"), "overlap").otherwise(F.col("status"))),
                   ~F.col("_overlap")).drop("_overlap")


def barrier_trades(signals: DataFrame, *, take_profit: float | None = fixed.TAKE_PROFIT,
                   stop_loss: float | None = fixed.STOP_LOSS, holding: int = fixed.HOLDING_BARS,
                   mode: str = "independent", take_profit_column: str | None = None,
                   stop_loss_column: str | None = None, until: str | None = None,
                   keys: tuple[str, ...] = ("ticker",), spread: int | None = None, **rules) -> DataFrame:
    """Label every event; in ``non_overlapping`` mode, thin the result per series.

    Thinning gathers whole rows, and no optimizer drops columns of those: paths go before it, and columns that are
    not asked for of the result are best left out of ``signals`` (``TRADE_INPUTS`` are what labels need).
    """
    if mode not in ("independent", "non_overlapping"):
        raise ValueError("mode must be independent or non_overlapping")
    target = F.col(take_profit_column) if take_profit_column else F.lit(take_profit)
    stop = F.col(stop_loss_column) if stop_loss_column else F.lit(stop_loss)
    ledger = label_barriers(event_paths(signals, holding=holding, spread=spread), stop=stop, target=target,
                            holding=holding, until=until, **rules)
    return ledger if mode == "independent" else thin(ledger.drop("path", "_split_end"), keys=keys, holding=holding)


def event_context(paths: DataFrame, *, holding: int = fixed.HOLDING_BARS) -> DataFrame:
    """Full-window excursions and, per possible exit bar, the best high after it."""
    whole = F.size("path") == holding
    entry = F.get("path", 0).open
    highs = F.transform("path", lambda b: b.high)
    after = {f"post_mfe_{h}": F.when(whole, F.array_max(F.slice(highs, h + 1, holding - h)) / entry - 1)
             for h in range(1, holding)}
    return paths.select(
        "timestamp", "ticker", F.get("path", 0).timestamp.alias("next_timestamp"),
        F.when(whole, F.get("path", holding - 1).timestamp).alias("window_end_timestamp"),
        F.when(whole, F.greatest(F.array_max(highs) / entry - 1, F.lit(0.0))).alias("full_window_mfe"),
        F.when(whole, F.least(F.array_min(F.transform("path", lambda b: b.low)) / entry - 1, F.lit(0.0)))
        .alias("full_window_mae"), *[v.alias(k) for k, v in after.items()])
