"""Trailing measurements per series. Frames come from ``series.cut``."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tidemark import fixed
from tidemark.operators import series

RETURN_WINDOWS = (1, 5, 10, 20)
LOCATION_WINDOWS = (20, 60)
ZSCORE_WINDOWS = (20,)
WILDER_WINDOW = 14
VOLATILITY_WINDOWS = (20, 60)
VOLUME_WINDOWS = (20,)
RELATIVE_WINDOWS = (5, 10, 20)
CONTEXT_WINDOW = 20


def window_sizes(sizes, *, minimum: int = 1) -> tuple[int, ...]:
    """Distinct sizes in ascending order; anything but whole numbers >= minimum fails."""
    values = tuple(sizes)
    if not values or any(isinstance(n, bool) or not isinstance(n, int) or n < minimum for n in values):
        raise ValueError(f"window sizes must be whole numbers >= {minimum}")
    return tuple(sorted(set(values)))


def _lag(column: str, rows: int) -> str:
    return f"lag({column}, {rows}) {series.OVER}"


def _full(rows: int, value: str) -> str:
    """``value`` where the series already has ``rows`` rows, else undefined."""
    return f"if(position >= {rows - 1}, {value}, null)"


def _ratio(top: str, bottom: str) -> str:
    """Quotient for positive denominators only."""
    return f"if({bottom} > 0, ({top}) / {bottom}, null)"


def _moments(column: str, rows: int, *, first: int = 0) -> tuple[str, str]:
    """Mean and sample deviation once the window holds ``rows`` defined values.

    ``first`` is the position of the column's first defined value.
    """
    w = series.trailing(rows)
    return _full(rows + first, f"avg({column}) {w}"), _full(rows + first, f"stddev_samp({column}) {w}")


def _with(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns given as SQL text; one parsed expression per column keeps planning short."""
    return frame.withColumns({name: F.expr(text) for name, text in columns.items()})


def returns(frame: DataFrame, windows=RETURN_WINDOWS) -> DataFrame:
    series.need(frame, max(window_sizes(windows)))
    return _with(frame, {f"return_{n}d": _ratio("close", _lag("close", n)) + " - 1" for n in window_sizes(windows)})


def locations(frame: DataFrame, windows=LOCATION_WINDOWS) -> DataFrame:
    series.need(frame, max(window_sizes(windows)) - 1)
    out = {}
    for n in window_sizes(windows):
        w = series.trailing(n)
        out[f"drawdown_{n}d"] = _full(n, f"close / max(close) {w} - 1")
        out[f"distance_from_low_{n}d"] = _full(n, f"close / min(close) {w} - 1")
        out[f"distance_from_high_{n}d"] = out[f"drawdown_{n}d"]
    return _with(frame, out)


def zscores(frame: DataFrame, windows=ZSCORE_WINDOWS) -> DataFrame:
    series.need(frame, max(window_sizes(windows, minimum=2)) - 1)
    out = {}
    for n in window_sizes(windows, minimum=2):
        mean, deviation = _moments("close", n)
        out[f"price_zscore_{n}d"] = _ratio(f"close - {mean}", deviation)
    return _with(frame, out)


def volatility(frame: DataFrame, windows=VOLATILITY_WINDOWS, annualization=fixed.ANNUALIZATION,
               *, prefix: str = "volatility") -> DataFrame:
    """Needs ``return_1d``; the first value appears one row after a full window."""
    series.need(frame, max(window_sizes(windows, minimum=2)))
    return _with(frame, {f"{prefix}_{n}d": f"{_moments('return_1d', n, first=1)[1]} * sqrt({float(annualization)}D)"
                         for n in window_sizes(windows, minimum=2)})


def volumes(frame: DataFrame, windows=VOLUME_WINDOWS) -> DataFrame:
    series.need(frame, max(window_sizes(windows, minimum=2)) - 1)
    out = {}
    for n in window_sizes(windows, minimum=2):
        mean, deviation = _moments("volume", n)
        out[f"volume_mean_{n}d"] = mean
        out[f"relative_volume_{n}d"] = _ratio("volume", mean)
        out[f"volume_zscore_{n}d"] = _ratio(f"volume - {mean}", deviation)
    return _with(frame, out)


def wilder_reach(n: int) -> int:
    """Rows after which an old value weighs less than double rounding."""
    return ceil(39 * n)


def wilder(frame: DataFrame, values: dict[str, str], n: int, *, first: int = 1) -> DataFrame:
    """Smooth columns recursively: y = y' + (x - y')/n, seeded with the mean of n values.

    ``values`` maps output to input names; the first defined input sits at position
    ``first``. Blocks of ``wilder_reach`` rows are summed in closed form and joined to the
    end of the block before; anything older than that weighs nothing in a double.
    """
    series.need(frame, 1 if n == 1 else wilder_reach(n) + 1)
    if n == 1:
        return _with(frame, values)
    keep, reach, rank = f"{1 - 1 / n!r}D", wilder_reach(n), f"(position - {first - 1})"
    fed = _with(frame, {
        f"_{out}": f"case when {rank} < {n} then 0D when {rank} = {n} then avg({x}) {series.trailing(n)} "
                   f"else coalesce({x}, 0D) / {n} end" for out, x in values.items()})
    fed = _with(fed, {"_block": f"floor(position / {reach})", "_step": f"cast(position % {reach} as double)"})
    block = "over (partition by ticker, segment, _block order by position rows unbounded preceding)"
    fed = _with(fed, {f"_{out}": f"pow({keep}, _step) * sum(_{out} * pow({keep}, -_step)) {block}" for out in values})
    before = "over (partition by ticker, segment order by _block range between 1 preceding and 1 preceding)"
    fed = _with(fed, {f"_end_{out}": f"max_by(_{out}, position) {before}" for out in values})
    return _with(fed, {
        out: f"if({rank} >= {n}, _{out} + pow({keep}, _step + 1) * coalesce(_end_{out}, 0D), null)" for out in values
    }).drop("_block", "_step", *[f"_{o}" for o in values], *[f"_end_{o}" for o in values])


def wilder_measures(frame: DataFrame, *, rsi: int | None = WILDER_WINDOW,
                    atr: int | None = WILDER_WINDOW) -> DataFrame:
    """``rsi_n``, ``true_range``, ``atr_n`` and ``atr_pct_n``, sharing the smoothing passes."""
    frame = _with(frame, {"_before": _lag("close", 1)})
    # greatest() skips missing operands, so the first row is kept undefined explicitly.
    frame = _with(frame, {
        "_gain": "if(_before is not null, greatest(close - _before, 0D), null)",
        "_loss": "if(_before is not null, greatest(_before - close, 0D), null)",
        "true_range": "if(_before is not null, greatest(high - low, abs(high - _before), abs(low - _before)), null)"})
    smooth: dict[int, dict[str, str]] = {}
    if rsi is not None:
        smooth.setdefault(rsi, {}).update({"_mean_gain": "_gain", "_mean_loss": "_loss"})
    if atr is not None:
        smooth.setdefault(atr, {})[f"atr_{atr}"] = "true_range"
    for n, values in smooth.items():
        frame = wilder(frame, values, n)
    shares = {}
    if rsi is not None:
        shares[f"rsi_{rsi}"] = f"100 * {_ratio('_mean_gain', '(_mean_gain + _mean_loss)')}"
    if atr is not None:
        shares[f"atr_pct_{atr}"] = _ratio(f"atr_{atr}", "close")
    return _with(frame, shares).drop("_before", "_gain", "_loss", "_mean_gain", "_mean_loss")


def index_context(index: DataFrame, window: int = CONTEXT_WINDOW,
                  annualization=fixed.ANNUALIZATION) -> DataFrame:
    """The index on its own bars: open, close, return, drawdown, volatility and regime inputs.

    One row per session date, so the index is bounded by the calendar and stays whole. A session that
    occurs twice is refused, as it would double the bars it is joined to.
    """
    frame = series.whole(index.select(*fixed.BAR_COLUMNS))
    frame = volatility(returns(frame, (1,)), (window,), annualization, prefix="benchmark_volatility")
    n = fixed.REGIME_WINDOW
    frame = _with(frame, {
        f"benchmark_return_{window}d": _ratio("close", _lag("close", window)) + " - 1",
        f"benchmark_drawdown_{window}d": _full(window, f"close / max(close) {series.trailing(window)} - 1"),
        "benchmark_sma": _full(n, f"avg(close) {series.trailing(n)}"), "_earlier": _lag("timestamp", 1)})
    once = F.when(F.col("_earlier") == F.col("timestamp"), F.raise_error(F.concat(
        F.lit("the index has several rows for "), F.col("timestamp").cast("string")))).otherwise(F.col("timestamp"))
    return frame.select(
        once.alias("timestamp"), F.col("open").alias("benchmark_open"), F.col("close").alias("benchmark_close"),
        f"benchmark_return_{window}d", f"benchmark_drawdown_{window}d", f"benchmark_volatility_{window}d",
        "benchmark_sma", F.col("position").alias("session_number"), F.col("length").alias("session_count"))


def with_index(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Exact-date left join; the context has one row per session (``index_context`` sees to it), hence the broadcast."""
    return bars.join(F.broadcast(context), "timestamp", "left")


def relative(frame: DataFrame, windows=RELATIVE_WINDOWS) -> DataFrame:
    """Series return minus index return between the same two rows of the series."""
    series.need(frame, max(window_sizes(windows)))
    return _with(frame, {
        f"relative_return_{n}d": f"{_ratio('close', _lag('close', n))} - {_ratio('benchmark_close', _lag('benchmark_close', n))}"
        for n in window_sizes(windows)})


def reach_of(*, return_windows=RETURN_WINDOWS, location_windows=LOCATION_WINDOWS, zscore_windows=ZSCORE_WINDOWS,
             rsi_window=WILDER_WINDOW, atr_window=WILDER_WINDOW, volatility_windows=VOLATILITY_WINDOWS,
             volume_windows=VOLUME_WINDOWS, relative_windows=RELATIVE_WINDOWS, **others) -> int:
    """Rows before a row that the measurements of these windows look at."""
    longest = max((*window_sizes(return_windows), *window_sizes(location_windows), *window_sizes(zscore_windows, minimum=2),
                   *window_sizes(volatility_windows, minimum=2), *window_sizes(volume_windows, minimum=2),
                   *window_sizes(relative_windows)))
    return max(longest, wilder_reach(max(rsi_window, atr_window)) + 1)


FEATURE_REACH = reach_of()


def add_features(frame: DataFrame, *, return_windows=RETURN_WINDOWS, location_windows=LOCATION_WINDOWS,
                 zscore_windows=ZSCORE_WINDOWS, rsi_window: int = WILDER_WINDOW, atr_window: int = WILDER_WINDOW,
                 volatility_windows=VOLATILITY_WINDOWS, volume_windows=VOLUME_WINDOWS,
                 annualization: float = fixed.ANNUALIZATION, relative_windows=RELATIVE_WINDOWS,
                 with_relative: bool = True) -> DataFrame:
    """Every family on one cut frame, with one shuffle behind it."""
    asked = window_sizes(return_windows)
    window_sizes((rsi_window,), minimum=2)
    window_sizes((atr_window,))
    frame = returns(frame, {1, *asked})  # volatility needs returns of one row
    frame = volumes(zscores(locations(frame, location_windows), zscore_windows), volume_windows)
    if with_relative:
        frame = relative(frame, relative_windows)
    frame = wilder_measures(volatility(frame, volatility_windows, annualization), rsi=rsi_window, atr=atr_window)
    return frame if 1 in asked else frame.drop("return_1d")


def build_features(bars: DataFrame, index: DataFrame | None = None, *, context_window: int = CONTEXT_WINDOW, **parameters) -> DataFrame:
    """Bars plus all trailing measurements; parameters as in ``add_features``.

    The halo follows from the windows. Columns of ``bars`` that a measurement would replace are
    refused. Further columns of ``bars`` are kept.
    """
    scale = parameters.get("annualization", fixed.ANNUALIZATION)
    window_sizes((context_window,), minimum=2)
    if isinstance(scale, bool) or not 0 < scale < float("inf"):
        raise ValueError("annualization must be positive")
    if clash := set(bars.columns) & _made(parameters, index is not None, context_window):
        raise ValueError(f"columns would be replaced: {sorted(clash)}")
    frame = bars if index is None else with_index(bars, index_context(index, context_window, scale))
    frame = series.cut(series.with_position(frame), back=reach_of(**parameters), ahead=0)
    return series.own_rows(add_features(frame, with_relative=index is not None, **parameters))


def _made(parameters: dict, with_relative: bool, context_window: int) -> set[str]:
    """Names of the columns that ``build_features`` adds."""
    sizes = lambda name, default: window_sizes(parameters.get(name, default))
    atr = parameters.get("atr_window", WILDER_WINDOW)
    out = {"true_range", f"rsi_{parameters.get('rsi_window', WILDER_WINDOW)}", f"atr_{atr}", f"atr_pct_{atr}", "position", "length"}
    out |= {f"return_{n}d" for n in sizes("return_windows", RETURN_WINDOWS)} | {f"price_zscore_{n}d" for n in sizes("zscore_windows", ZSCORE_WINDOWS)}
    out |= {f"{c}_{n}d" for n in sizes("location_windows", LOCATION_WINDOWS) for c in ("drawdown", "distance_from_low", "distance_from_high")}
    out |= {f"volatility_{n}d" for n in sizes("volatility_windows", VOLATILITY_WINDOWS)}
    out |= {f"{c}_{n}d" for n in sizes("volume_windows", VOLUME_WINDOWS) for c in ("volume_mean", "relative_volume", "volume_zscore")}
    if with_relative:
        out |= {f"relative_return_{n}d" for n in sizes("relative_windows", RELATIVE_WINDOWS)}
        out |= {f"benchmark_{c}_{context_window}d" for c in ("return", "drawdown", "volatility")} | {"benchmark_open", "benchmark_close", "benchmark_sma"}
    return out


def drawdown_change(frame: DataFrame, rows: int = 5) -> DataFrame:
    series.need(frame, rows)  # of the drawdown column, which reaches back on its own
    return _with(frame, {f"drawdown_change_{rows}": f"drawdown_60d - {_lag('drawdown_60d', rows)}"})


def with_callback(bars: DataFrame, callback: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], outputs: str, *,
                  reach: int, columns: tuple[str, ...] = fixed.BAR_COLUMNS) -> DataFrame:
    """``bars`` with columns a user's function computes for each series.

    ``callback`` gets ``columns`` of consecutive rows of one series, in order, as arrays and gives an array of the same length for each of
    ``outputs`` (a schema); a value may depend on its own row and the ``reach`` rows before it. Series are cut
    into segments that carry these rows along, so a long series spreads over tasks; only a segment's own values are
    kept. The first ``reach`` rows of a series see fewer rows. NaN becomes null. A result of another length, with other names or
    with an infinite value is refused.
    """
    if reach < 0:
        raise ValueError("reach must not be negative")
    kind = to_arrow_schema(_parse_datatype_string(outputs))
    if clash := {f.name for f in kind} & {*bars.columns, "position", "length"}:
        raise ValueError(f"columns would be replaced: {sorted(clash)}")
    frame = series.cut(series.with_position(bars), back=reach, ahead=0)
    kept = [c for c in frame.columns if c not in ("segment", "own")]
    schema = StructType([*(frame.schema[c] for c in kept), *_parse_datatype_string(outputs).fields])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        own = rows["own"].to_numpy()
        made = callback({c: rows[c].to_numpy() for c in columns})
        if set(made) != set(kind.names) or any(len(v) != rows.num_rows for v in made.values()):
            raise ValueError(f"the callback has to give {rows.num_rows} values for each of {kind.names}")
        if any(np.isinf(v).any() for v in made.values() if np.issubdtype(v.dtype, np.floating)):
            raise ValueError("the callback gave an infinite value")
        rows = rows.select(kept)
        for f in kind:
            rows = rows.append_column(f, pa.array(made[f.name], f.type, from_pandas=True))
        return rows.filter(pa.array(own))
    return frame.groupBy("ticker", "segment").applyInArrow(run, schema)
