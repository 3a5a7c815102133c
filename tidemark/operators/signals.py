"""Thresholds from prior history, components, conditions and rising-edge events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark import fixed
from tidemark.operators import features, series

WINDOWS = 4096  # windows sorted at a time


def _quantiles_before(values: np.ndarray, given: np.ndarray, rows: np.ndarray, quantiles: list[float], lookback: int, minimum: int) -> np.ma.MaskedArray:
    """For each of ``rows`` the quantiles of the ``lookback`` values before it that are ``given``, masked for fewer than ``minimum``."""
    out = np.ma.masked_all((len(quantiles), len(rows)))
    count = np.r_[0, np.cumsum(given)]
    count = count[rows] - count[np.maximum(rows - lookback, 0)]
    # What isn't given is NaN, which sorting puts last.
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[np.full(lookback, np.nan), values], lookback)
    enough = np.flatnonzero(count >= max(minimum, 1))
    for a in range(0, len(enough), WINDOWS):
        at = enough[a:a + WINDOWS]
        ranked, n = np.sort(windows[rows[at]], axis=1), count[at]
        each = np.arange(len(at))
        for q, quantile in enumerate(quantiles):
            rank = (n - 1) * quantile
            floor = np.floor(rank).astype(np.int64)
            low, high = ranked[each, floor], ranked[each, np.minimum(floor + 1, n - 1)]
            with np.errstate(invalid="ignore"):
                out[q, at] = low + (high - low) * (rank - floor)
    return out


def prior_quantiles(frame: DataFrame, wanted: dict[str, tuple[str, float]], *, lookback: int = fixed.LOOKBACK,
                    minimum: int = fixed.MIN_HISTORY, before: bool = False) -> DataFrame:
    """Linear quantiles over the previous ``lookback`` rows, the current row left out; of the halo no rows are left.

    Undefined values keep their slot in the window but do not enter the quantile.
    ``wanted`` maps an output to its column and quantile. Spark deals out the segments, and numpy sorts all windows of
    a segment at once: a window function would gather and sort ``lookback`` boxed values for every row.
    With ``before``, ``_before_`` and the name is the output of the row before, so that a comparison with it needs no further shuffle.
    """
    columns = sorted({column for column, _ in wanted.values()})
    quantiles = sorted({quantile for _, quantile in wanted.values()})
    names = [*wanted, *(f"_before_{name}" for name in wanted if before)]
    frame = frame.drop(*names)
    schema = StructType([*frame.schema.fields, *(StructField(name, DoubleType()) for name in names)])

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        own = np.flatnonzero(rows["own"].to_numpy())
        # A segment's own rows follow each other, so the row before the first one is all that is added.
        first = max(own[0] - 1, 0) if len(own) else 0
        asked = np.arange(first, own[-1] + 1) if len(own) else own
        found = {}
        for c in columns:
            given, values = rows[c].is_valid().to_numpy(), rows[c].cast(pa.float64()).to_numpy()
            made = _quantiles_before(values, given, asked, quantiles, lookback, minimum)
            for shift in (0, 1)[:1 + before]:
                found.update({(c, q, shift): made[k, np.maximum(own - shift, 0) - first] for k, q in enumerate(quantiles)})
        rows = rows.take(own)
        for shift in (0, 1)[:1 + before]:
            for name, (c, q) in wanted.items():
                made = found[c, q, shift]
                rows = rows.append_column(("_before_" if shift else "") + name, pa.array(made.data, pa.float64(), mask=np.ma.getmaskarray(made)))
        return rows
    return frame.groupBy("ticker", "segment").applyInArrow(run, schema)


def thresholds(frame: DataFrame, *, quantile: float = fixed.QUANTILE, **history) -> DataFrame:
    return prior_quantiles(
        frame, {f"{c}_threshold": (c, quantile) for c in fixed.SIGNAL_FEATURES}, **history)


def _flags(prefix: str = "") -> list[str]:
    return [f"coalesce({prefix}{c} <= {prefix}{c}_threshold, false)" for c in fixed.SIGNAL_FEATURES]


def _ready(prefix: str = "") -> str:
    return " and ".join(f"{prefix}{c}{kind} is not null" for c in fixed.SIGNAL_FEATURES for kind in ("", "_threshold"))


def components(frame: DataFrame) -> DataFrame:
    """One flag per feature at or below its threshold; missing operands give false."""
    flags = {name: F.expr(flag) for name, flag in zip(fixed.SIGNAL_COMPONENTS, _flags())}
    return frame.withColumns({**flags, "dip_ready_v1": F.expr(_ready())})


def conditions(frame: DataFrame, required: int = fixed.REQUIRED_COMPONENTS) -> DataFrame:
    count = " + ".join(f"bigint({c})" for c in fixed.SIGNAL_COMPONENTS)
    return (frame.withColumn("dip_component_count", F.expr(count))
            .withColumn("dip_condition_v1", F.expr(f"dip_ready_v1 and dip_component_count >= {required}")))


def rising_edges(frame: DataFrame, required: int = fixed.REQUIRED_COMPONENTS) -> DataFrame:
    """First row of each run of true conditions; features and thresholds of the row before are at hand as ``_before_*``."""
    count = " + ".join(f"bigint({flag})" for flag in _flags("_before_"))
    return frame.withColumn("dip_event_v1", F.expr(
        f"dip_condition_v1 and not ({_ready('_before_')} and {count} >= {required})")).drop(
        *[f"_before_{c}{kind}" for c in fixed.SIGNAL_FEATURES for kind in ("", "_threshold")])


def add_signals(frame: DataFrame, *, quantile: float = fixed.QUANTILE, lookback: int = fixed.LOOKBACK,
                minimum: int = fixed.MIN_HISTORY, required: int = fixed.REQUIRED_COMPONENTS) -> DataFrame:
    """Thresholds, flags and edges of a cut frame's own rows."""
    frame = frame.withColumns({f"_before_{c}": F.expr(f"lag({c}, 1) {series.OVER}") for c in fixed.SIGNAL_FEATURES})
    frame = thresholds(frame, quantile=quantile, lookback=lookback, minimum=minimum, before=True)
    return rising_edges(conditions(components(frame), required), required)


def build_signals(bars: DataFrame, context: DataFrame, *, only_inputs: bool = False, spread: int | None = None, **parameters) -> DataFrame:
    """Bars to events in one cut: features, thresholds, flags and edges share a shuffle.

    ``context`` is the result of ``features.index_context``. ``only_inputs`` builds just the features that signals are made
    of, for wide universes. ``spread`` is the number of partitions rows are dealt to, if not the session's.
    """
    lookback = parameters.get("lookback", fixed.LOOKBACK)
    reach = lookback + 60 + 1
    frame = series.cut(series.with_position(bars, spread=spread), back=reach if only_inputs else max(features.FEATURE_REACH, reach), ahead=0)
    if spread is not None:
        frame = frame.repartition(spread, "ticker", "segment")
    frame = features.with_index(frame, context)
    if only_inputs:
        frame = features.relative(features.zscores(features.locations(frame, (20, 60)), (20,)), (10,))
        frame = frame.select(*fixed.BAR_COLUMNS, "position", "length", "segment", "own", *fixed.SIGNAL_FEATURES)
    else:
        frame = features.add_features(frame)
    return series.own_rows(add_signals(frame, **parameters))


def signals_from_features(table: DataFrame, **parameters) -> DataFrame:
    """The same flags for a stored feature table that has ``position`` and ``length``."""
    reach = parameters.get("lookback", fixed.LOOKBACK) + 1
    return series.own_rows(add_signals(series.cut(table, back=reach, ahead=0), **parameters))


def combination() -> Column:
    """Letters of the active components, in order."""
    return F.concat(*[F.when(F.col(c), letter).otherwise("")
                      for letter, c in zip("ABCD", fixed.SIGNAL_COMPONENTS)])


def volatility_tercile(table: DataFrame) -> DataFrame:
    """Low, middle or high range against terciles of the prior rows."""
    low, high = fixed.VOLATILITY_QUANTILES
    frame = series.cut(table, back=fixed.LOOKBACK, ahead=0)
    frame = prior_quantiles(frame, {"volatility_low": ("atr_pct_14", low), "volatility_high": ("atr_pct_14", high)})
    value = F.col("atr_pct_14")
    label = (F.when(value.isNull() | F.col("volatility_low").isNull(), "unavailable")
             .when(value <= F.col("volatility_low"), "low")
             .when(value <= F.col("volatility_high"), "middle").otherwise("high"))
    return series.own_rows(frame.withColumn("volatility_group", label))
