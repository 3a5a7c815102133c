"""Positions, segments and trailing measures."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, series, signals
from tests.conftest import bars_of, day, walk


def ordered(frame, ticker, *columns):
    return [tuple(r[c] for c in columns) for r in frame.where(F.col("ticker") == ticker).orderBy("timestamp").collect()]


def close_enough(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


def test_positions_run_over_years(spark):
    bars = bars_of(spark, {"AA": walk(900, 1), "BB": walk(400, 2)})
    frame = series.with_position(bars)
    for ticker, n in (("AA", 900), ("BB", 400)):
        assert ordered(frame, ticker, "position", "length") == [(i, n) for i in range(n)]


def test_cut_keeps_each_row_once(spark):
    frame = series.with_position(bars_of(spark, {"AA": walk(100, 1)}))
    cut = series.cut(frame, back=7, ahead=3, size=10)
    assert series.own_rows(cut).count() == 100
    held = {(r.segment, r.position) for r in cut.collect()}
    assert held == {(s, p) for s in range(10) for p in range(100) if s * 10 - 7 <= p < s * 10 + 10 + 3}


def test_returns_exact(spark):
    bars = bars_of(spark, {"AA": [(c, c, c, c) for c in (10, 12, 9, 18)]})
    frame = features.returns(series.cut(series.with_position(bars), back=5, ahead=0), (1, 2))
    got = ordered(frame, "AA", "return_1d", "return_2d")
    want = [(None, None), (0.2, None), (-0.25, -0.1), (1.0, 0.5)]
    assert all(close_enough(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.parametrize("size", [16, 4096])
def test_segments_do_not_change_results(spark, size):
    index = features.index_context(bars_of(spark, {"ALL": walk(420, 9)}))
    bars = features.with_index(bars_of(spark, {"AA": walk(420, 1), "BB": walk(300, 2)}), index)
    frame = series.cut(series.with_position(bars), back=700, ahead=0, size=size)
    got = series.own_rows(signals.add_signals(features.add_features(frame), lookback=60, minimum=30))
    whole = series.cut(series.with_position(bars), back=700, ahead=0, size=10**6)
    want = series.own_rows(signals.add_signals(features.add_features(whole), lookback=60, minimum=30))
    columns = ("rsi_14", "atr_14", "volatility_60d", "drawdown_60d_threshold", "dip_component_count", "dip_event_v1")
    for ticker in ("AA", "BB"):
        for a, b in zip(ordered(got, ticker, *columns), ordered(want, ticker, *columns), strict=True):
            assert all(close_enough(x, y) for x, y in zip(a, b)), (a, b)


def test_wilder_against_recursion(spark):
    prices = walk(900, 3)
    for n in (2, 5, 14):
        frame = series.cut(series.with_position(bars_of(spark, {"AA": prices})), back=features.wilder_reach(n) + 1, ahead=0, size=200)
        got = ordered(series.own_rows(features.wilder_measures(frame, rsi=n, atr=n)), "AA", f"atr_{n}", f"rsi_{n}")
        spans, gains, losses = [], [], []
        for (_, _, _, before), (_, high, low, last) in zip(prices, prices[1:]):
            spans.append(max(high - low, abs(high - before), abs(low - before)))
            gains.append(max(last - before, 0.0))
            losses.append(max(before - last, 0.0))

        def smooth(values):
            out, y = [None] * (n - 1), statistics.fmean(values[:n])
            out.append(y)
            for x in values[n:]:
                y += (x - y) / n
                out.append(y)
            return [None, *out]
        a, g, low = smooth(spans), smooth(gains), smooth(losses)
        want = [(x, None if u is None or u + v == 0 else 100 * u / (u + v)) for x, u, v in zip(a, g, low)]
        assert all(close_enough(p, q) for x, y in zip(got, want, strict=True) for p, q in zip(x, y))


def test_flat_prices_are_undefined(spark):
    frame = features.build_features(bars_of(spark, {"AA": [(5, 5, 5, 5)] * 40}))
    last = ordered(frame, "AA", "price_zscore_20d", "rsi_14", "drawdown_20d", "atr_14")[-1]
    assert last == (None, None, 0.0, 0.0)


def test_future_rows_change_nothing(spark):
    prices, index = walk(360, 5), features.index_context(bars_of(spark, {"ALL": walk(360, 6)}))
    short = signals.build_signals(bars_of(spark, {"AA": prices[:320]}), index, lookback=60, minimum=30)
    full = signals.build_signals(bars_of(spark, {"AA": prices, "BB": walk(360, 7)}), index, lookback=60, minimum=30)
    columns = ("rsi_14", "relative_return_10d", "price_zscore_20d_threshold", "dip_event_v1")
    a, b = ordered(short, "AA", *columns), ordered(full.where(F.col("timestamp") < F.lit(day(320))), "AA", *columns)
    assert len(a) == 320 and all(close_enough(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q))


def test_missing_index_date_breaks_relative_return(spark):
    bars = bars_of(spark, {"AA": walk(12, 1)})
    index = bars_of(spark, {"ALL": walk(12, 2)}).where(F.col("timestamp") != F.lit(day(3)))
    frame = features.with_index(bars, features.index_context(index))
    got = ordered(features.relative(series.cut(series.with_position(frame), back=9, ahead=0), (2,)), "AA", "relative_return_2d")
    assert [i for i, (x,) in enumerate(got) if x is None] == [0, 1, 3, 5]


def test_prior_quantile_ignores_current_and_counts_slots(spark):
    rows = [(day(i), "AA", i, 9, v) for i, v in enumerate([5.0, None, 1.0, 3.0, None, 2.0, -9.0, 7.0, 8.0])]
    frame = spark.createDataFrame(rows, "timestamp date, ticker string, position long, length long, x double")
    out = signals.prior_quantiles(series.cut(frame, back=9, ahead=0), {"q": ("x", 0.5)}, lookback=4, minimum=2)
    assert [x for (x,) in ordered(out, "AA", "q")] == [None, None, None, 3.0, 3.0, 2.0, 2.0, 2.0, 2.0]


@pytest.mark.parametrize("size", [7, 4096])
def test_prior_quantiles_in_any_segments(spark, size):
    rng = random.Random(8)
    values = [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.05 else rng.choice([0.5, rng.gauss(0, 1)]) for _ in range(90)]
    frame = spark.createDataFrame([(day(i), "AA", i, 90, v) for i, v in enumerate(values)], "timestamp date, ticker string, position long, length long, x double")
    wanted = {"low": ("x", 0.2), "high": ("x", 0.9)}
    out = signals.prior_quantiles(series.cut(frame, back=21, ahead=0, size=size), wanted, lookback=20, minimum=11, before=True)
    got = ordered(series.own_rows(out), "AA", *wanted, *(f"_before_{name}" for name in wanted))

    def quantile(rows, q):
        rows = sorted((v for v in rows if v is not None), key=lambda v: (v != v, v))
        at = (len(rows) - 1) * q
        if len(rows) < 11:
            return None
        low, high = rows[int(at)], rows[min(int(at) + 1, len(rows) - 1)]
        return low + (high - low) * (at - int(at))
    want = [tuple(quantile(values[max(i - 20, 0):i], q) for i in (k, k - 1) for q in (0.2, 0.9)) if k else (None,) * 4 for k in range(90)]
    assert str(got) == str(want) and sum(x is not None for x, *_ in want) > 50  # as text, NaN equals NaN


def test_wide_signals_equal_those_with_all_features(spark):
    index = features.index_context(bars_of(spark, {"ALL": walk(300, 6)}))
    bars = bars_of(spark, {"AA": walk(300, 5), "BB": walk(130, 4)})
    want = signals.build_signals(bars, index, lookback=60, minimum=30)
    got = signals.build_signals(bars, index, lookback=60, minimum=30, only_inputs=True, spread=3)
    columns = ("position", "price_zscore_20d_threshold", "dip_component_count", "dip_condition_v1", "dip_event_v1")
    for ticker in ("AA", "BB"):
        assert ordered(got, ticker, *columns) == ordered(want, ticker, *columns)
    # Neither lists of prior values nor smoothing passes are part of the plan, and segments are dealt to the asked number of partitions.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "pow(" not in plan.lower() and "hashpartitioning(ticker" in plan and ", 3)" in plan


def test_signals_from_a_stored_feature_table(spark):
    index = features.index_context(bars_of(spark, {"ALL": walk(300, 6)}))
    bars = bars_of(spark, {"AA": walk(300, 5)})
    want = signals.build_signals(bars, index, lookback=60, minimum=30)
    stored = want.drop(*[c for c in want.columns if c.startswith("dip_") or c.endswith("_threshold")])
    got = signals.signals_from_features(stored, lookback=60, minimum=30)
    columns = ("dip_component_count", "dip_condition_v1", "dip_event_v1")
    assert ordered(got, "AA", *columns) == ordered(want, "AA", *columns)


def test_window_sizes_are_checked():
    assert features.window_sizes([5, 1, 5]) == (1, 5)
    for bad in ([], [0], [True], [1.5]):
        with pytest.raises(ValueError):
            features.window_sizes(bad)


def test_long_windows_cross_segment_boundaries(spark):
    prices = walk(3000, 11)
    built = ordered(features.build_features(bars_of(spark, {"AA": prices}), location_windows=(1000,), return_windows=(1, 1000), rsi_window=60, atr_window=60),
                    "AA", "drawdown_1000d", "return_1000d", "atr_60")
    close = [p[3] for p in prices]
    spans = [max(p[1] - p[2], abs(p[1] - c), abs(p[2] - c)) for p, c in zip(prices[1:], close)]
    atr = sum(spans[:60]) / 60
    for i in range(60, 3000):
        atr = atr + (spans[i - 1] - atr) / 60 if i > 60 else atr
        drawdown, change, got = built[i]
        assert got == pytest.approx(atr, rel=1e-12)
        assert (drawdown is None) == (i < 999) and (change is None) == (i < 1000)
        if i >= 1000:
            assert drawdown == pytest.approx(close[i] / max(close[i - 999:i + 1]) - 1, rel=1e-12)
            assert change == pytest.approx(close[i] / close[i - 1000] - 1, rel=1e-12)


def test_a_short_halo_is_refused(spark):
    frame = series.cut(series.with_position(bars_of(spark, {"AA": walk(50, 1)})), back=20, ahead=0)
    features.returns(frame, (20,))
    for family, windows in ((features.returns, (21,)), (features.locations, (22,)), (features.zscores, (22,)), (features.volumes, (22,))):
        with pytest.raises(ValueError, match="rows back"):
            family(frame, windows)
    with pytest.raises(ValueError, match="rows back"):
        features.wilder_measures(frame)


def test_columns_are_not_replaced(spark):
    bars = bars_of(spark, {"AA": walk(30, 1)})
    with pytest.raises(ValueError, match="atr_14"):
        features.build_features(bars.withColumn("atr_14", bars.close))


def test_a_callback_equals_the_built_in_family_across_segments(spark, monkeypatch):
    bars = bars_of(spark, {"AA": walk(300, 1), "BB": walk(7, 2), "CC": walk(64, 3)})

    def zscore(columns):
        close, out = columns["close"], np.full(len(columns["close"]), np.nan)
        if len(close) >= 20:
            seen = np.lib.stride_tricks.sliding_window_view(close, 20)
            out[19:] = (close[19:] - seen.mean(1)) / seen.std(1, ddof=1)
        return {"z": out, "rows": np.arange(len(close))}
    whole = series.own_rows(features.zscores(series.cut(series.with_position(bars), back=19, ahead=0), (20,)))
    want = {(r.ticker, r.position): r.price_zscore_20d for r in whole.collect()}
    real = series.cut
    monkeypatch.setattr(series, "cut", lambda frame, **rules: real(frame, **{"size": 32, **rules}))
    got = features.with_callback(bars, zscore, "z double, rows long", reach=19).collect()
    assert len(got) == 371 and {(r.ticker, r.position) for r in got} == set(want)
    for r in got:
        expected = want[r.ticker, r.position]
        assert r.z is None if expected is None else r.z == pytest.approx(expected, rel=1e-9)
    assert max(r.rows for r in got) <= 32 + 19
    for wrong, message in ((lambda c: {"z": c["close"][1:], "rows": c["volume"]}, "values for each"),
                           (lambda c: {"z": c["close"] / 0, "rows": c["volume"]}, "infinite")):
        with pytest.raises(Exception, match=message):
            features.with_callback(bars, wrong, "z double, rows long", reach=3).collect()
    with pytest.raises(ValueError, match="replaced"):
        features.with_callback(bars, zscore, "close double", reach=3)
