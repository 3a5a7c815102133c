"""Exact quantiles, bootstrap and summaries against plain recomputation."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles, robustness, stats
from tests.conftest import day


@pytest.mark.parametrize("small", [4096, 150])
def test_quantiles_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    monkeypatch.setattr(quantiles, "MARGIN", 0.02)
    rng = random.Random(1)
    groups = {"ties": [rng.choice([0.0, 0.0, 0.0, 1.0]) for _ in range(3000)], "spread": [rng.gauss(0, 1) for _ in range(5000)],
              "one": [4.0], "two": [1.0, 2.0], None: [float(i) for i in range(11)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("empty", None), ("one", None)]
    table = spark.createDataFrame(rows, "k string, x double")
    wanted = {"q05": ("x", 0.05), "q50": ("x", 0.5), "q75": ("x", 0.75)}
    base = table.groupBy("k").agg(F.count("x").alias("n"))
    got = {r.k: r for r in quantiles.with_quantiles(base, table, ("k",), wanted).collect()}
    assert got["empty"].q50 is None
    for k, values in groups.items():
        for name, (_, p) in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), abs=1e-12), (k, name)


def test_bootstrap_against_date_by_date_draws(spark):
    rng = random.Random(2)
    dates = [(day(i), rng.gauss(0.01, 0.1)) for i in range(47) for _ in range(rng.randint(1, 4))]
    table = spark.createDataFrame([("g", *d) for d in dates] + [("few", day(0), 1.0)], "k string, timestamp date, x double")
    rows = stats.bootstrap(table, "x", by=("k",), block=6, draws=200).collect()
    assert [r.k for r in rows] == ["g"]
    sums, counts = {}, {}
    for d, x in dates:
        sums[d], counts[d] = sums.get(d, 0) + x, counts.get(d, 0) + 1
    s, n = [sums[d] for d in sorted(sums)], [counts[d] for d in sorted(sums)]
    means = []
    for draw in range(200):
        starts = [int(hashlib.md5(f"42:{draw}:{b}".encode()).hexdigest()[:8], 16) % 47 for b in range(8)]
        picks = [(a + o) % 47 for a in starts for o in range(6)][:47]
        means.append(sum(s[i] for i in picks) / sum(n[i] for i in picks))
    assert rows[0].standard_error == pytest.approx(np.std(means, ddof=1))
    assert rows[0].ci_lower == pytest.approx(np.quantile(means, 0.025))
    assert rows[0].ci_upper == pytest.approx(np.quantile(means, 0.975))


def test_quantiles_of_a_large_skewed_group(spark):
    table = spark.range(1_000_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.pow(F.lit(1.00003), F.pmod(F.xxhash64("id"), F.lit(700_000)).cast("double"))).alias("x"),
        F.when(F.col("id") % 1000 == 0, "b").otherwise("a").alias("k"))
    asked = {f"q{i}": ("x", p) for i, p in enumerate((0.0, 0.01, 0.3, 0.5, 0.999, 1.0))}
    got = {r.k: r for r in quantiles.grouped_quantiles(table, ("k",), asked).collect()}
    rows = table.toPandas()
    for k, own in rows.groupby("k"):
        assert [got[k][n] for n in asked] == pytest.approx(list(np.quantile(own.x, [p for _, p in asked.values()])), rel=1e-12)


def test_a_rank_outside_its_bracket_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 0)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    monkeypatch.setattr(quantiles, "ACCURACY", 2)
    table = spark.range(100_000).select(F.lit("a").alias("k"), F.rand(3).alias("x"))
    with pytest.raises(Exception, match="outside its bracket"):
        quantiles.grouped_quantiles(table, ("k",), {"q": ("x", 0.3)}).collect()


def test_trade_metrics_rules(spark):
    rows = [("completed", x, x, 0.2, -0.1, 2, "time_exit") for x in (0.10, -0.05, 0.0, 0.20)] + [("overlap", *[None] * 6)]
    table = spark.createDataFrame(rows, "status string, net_return double, gross_return double, mfe double, mae double, "
                                        "holding_bars long, exit_reason string").withColumn("g", F.lit(1))
    row = stats.trade_metrics(table, ("g",)).collect()[0]
    assert (row.candidate_count, row.trade_count, row.excluded_count) == (5, 4, 1)
    assert row.win_rate == 0.5 and row.loss_probability == 0.25
    assert row.profit_factor == pytest.approx(6.0) and row.median_return == pytest.approx(0.05)
    assert row.break_even_win_rate == pytest.approx(0.05 / 0.2)
    winners = table.where("net_return > 0")
    assert stats.trade_metrics(winners, ("g",)).collect()[0].profit_factor is None


def test_sequential_metrics_count_a_first_loss(spark):
    table = spark.createDataFrame([("a", i, r) for i, r in enumerate((-0.5, 0.2, 0.1))], "k string, i int, r double")
    row = stats.sequential_metrics(table, "r", by=("k",), order="i").collect()[0]
    assert row.cumulative_return == pytest.approx(0.5 * 1.2 * 1.1 - 1) and row.maximum_drawdown == pytest.approx(-0.5)


@pytest.mark.parametrize("order", ["position", "at"])
def test_a_long_series_compounds_as_one(spark, order):
    rng = np.random.default_rng(11)
    steps = rng.normal(0.0001, 0.01, 100_000)
    frame = spark.createDataFrame(pd.DataFrame({"position": np.arange(len(steps)), "r": steps}))
    frame = frame.withColumns({"k": F.lit("a"), "at": F.timestamp_seconds(F.lit(1_500_000_000) + F.col("position") * 1800)})
    row = stats.sequential_metrics(frame, "r", by=("k",), order=order).first()
    wealth = np.cumprod(1 + steps)
    peak = np.maximum(np.maximum.accumulate(wealth), 1)
    assert row.cumulative_return == pytest.approx(wealth[-1] - 1, rel=1e-9)
    assert row.maximum_drawdown == pytest.approx((wealth / peak - 1).min(), rel=1e-9)


def test_concentration_without_any_contribution(spark):
    ledger = spark.createDataFrame([("AA", 0.0)], "ticker string, v double")
    asked = spark.createDataFrame([("AA",), ("BB",)], "ticker string")
    rows = {r.ticker: r for r in robustness.concentration(ledger, "v", asked).collect()}
    assert rows["BB"]["count"] == 0 and rows["BB"]["mean"] is None and rows["AA"].positive_share is None


def test_histogram_of_one_value(spark):
    table = spark.createDataFrame([("m", 2.0)], "metric string, value double")
    rows = robustness.histogram(table, "metric", "value").orderBy("bin").collect()
    assert [r["count"] for r in rows] == list(np.histogram([2.0], bins=12)[0])


def test_average_ranks_over_many_ranges(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": np.repeat(["a", "b"], [30_000, 50]), "x": np.r_[rng.zipf(1.3, 30_000).clip(0, 10**6), np.ones(50)].astype(float)})
    got = robustness.average_ranks(spark.createDataFrame(frame), ("g",), "x").toPandas()
    want = frame.assign(rank=frame.groupby("g").x.rank()).drop_duplicates()
    assert sorted(map(tuple, got[["g", "x", "rank"]].values)) == sorted(map(tuple, want[["g", "x", "rank"]].values))
