"""Forward outcomes, barriers, overlap and what follows an event."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, outcomes, paths, policies, series
from tests.conftest import bars_of, day, walk

EPS = 8 * 2.220446049250313e-16


def flagged(spark, series_, events):
    """Bars with events at the given rows of each ticker and no index."""
    marks = [(t, i) for t, rows in events.items() for i in rows]
    marks = spark.createDataFrame(marks, "ticker string, position long").withColumn("dip_event_v1", F.lit(True))
    frame = series.with_position(bars_of(spark, series_)).join(marks, ["ticker", "position"], "left")
    return frame.withColumns({
        "dip_event_v1": F.coalesce("dip_event_v1", F.lit(False)), "dip_condition_v1": F.coalesce("dip_event_v1", F.lit(False)),
        "dip_ready_v1": F.lit(True), "dip_component_count": F.lit(4).cast("long"),
        "benchmark_open": F.lit(None).cast("double"), "benchmark_close": F.lit(None).cast("double")})


FLAT = [(100, 101, 99, 100)] * 30


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("bar, policy, want", [
    ((100, 111, 99, 100), "conservative", ("take_profit", "barrier", 110.0, False)),
    ((100, 101, 90, 100), "conservative", ("stop_loss", "barrier", 93.0, False)),
    ((100, 111, 90, 100), "conservative", ("stop_loss", "barrier", 93.0, True)),
    ((100, 111, 90, 100), "optimistic", ("take_profit", "barrier", 110.0, True)),
    ((85, 111, 80, 100), "optimistic", ("stop_loss", "open", 85.0, False)),
    ((120, 121, 90, 100), "conservative", ("take_profit", "open", 120.0, False)),
])
def test_first_touch_rules(spark, bar, policy, want):
    prices = list(FLAT)
    prices[3] = bar
    row = one(outcomes.barrier_trades(flagged(spark, {"AA": prices}, {"AA": [0]}), ambiguity=policy))
    assert (row.exit_reason, row.fill_type, round(row.exit_price, 9), row.ambiguous_bar) == want
    assert row.holding_bars == 3 and row.exit_timestamp == day(3)


def test_time_exit_and_censoring(spark):
    row = one(outcomes.barrier_trades(flagged(spark, {"AA": FLAT}, {"AA": [0]})))
    assert (row.exit_reason, row.holding_bars, row.gross_return, row.mfe, row.mae) == ("time_exit", 10, 0.0, 101 / 100 - 1, 99 / 100 - 1)
    ledger = outcomes.barrier_trades(flagged(spark, {"AA": FLAT}, {"AA": [19, 20, 29]})).orderBy("timestamp").collect()
    assert [r.status for r in ledger] == ["completed", "incomplete_window", "no_next_bar"]
    assert ledger[1].entry_price is None


def test_barriers_can_be_off(spark):
    prices = list(FLAT)
    prices[2] = (100, 150, 50, 100)
    table = flagged(spark, {"AA": prices}, {"AA": [0]})
    assert one(outcomes.barrier_trades(table, take_profit=None)).exit_reason == "stop_loss"
    assert one(outcomes.barrier_trades(table, stop_loss=None)).exit_reason == "take_profit"
    assert one(outcomes.barrier_trades(table, take_profit=None, stop_loss=None)).exit_reason == "time_exit"


def replay(prices, events, stop, target, holding, optimistic):
    """Straight simulation of one series, with the overlap rule."""
    out, last = {}, -1
    for i in events:
        status = ("no_next_bar" if i + 1 >= len(prices) else "incomplete_window" if i + holding >= len(prices) else "completed")
        if i + 1 <= last:
            status = "overlap"
        out[i] = (status, None, None)
        if status != "completed":
            continue
        entry = prices[i + 1][0]
        up, low_ = entry * (1 + target), entry * (1 - stop)
        over = lambda v: v >= up - EPS * max(v, up)
        under = lambda v: v <= low_ + EPS * max(v, low_)
        for j in range(i + 1, i + 1 + holding):
            o, h, low, _ = prices[j]
            reason = ("stop_loss" if under(o) else "take_profit" if over(o) else
                      ("stop_loss" if under(low) and not (optimistic and over(h)) else "take_profit" if over(h) else
                       "time_exit" if j == i + holding else None))
            if reason:
                out[i], last = (status, reason, j - i), j
                break
    return out


@pytest.mark.parametrize("density, optimistic", [(1.0, False), (0.3, True), (0.05, False)])
def test_trades_against_replay(spark, monkeypatch, density, optimistic):
    monkeypatch.setattr(outcomes, "CELL", 16)  # many cells, so that markers cross them
    monkeypatch.setattr(outcomes, "FAN", 3)  # and several levels of nodes above them
    rng = random.Random(7)
    prices = {t: walk(300, i) for i, t in enumerate(("AA", "BB"))}
    events = {t: [i for i in range(300) if rng.random() < density] for t in prices}
    ledger = outcomes.barrier_trades(flagged(spark, prices, events), mode="non_overlapping", stop_loss=0.05, take_profit=0.06,
                                     ambiguity="optimistic" if optimistic else "conservative")
    got = {(r.ticker, r.position): (r.status, r.exit_reason, r.holding_bars) for r in ledger.collect()}
    want = {(t, i): v for t in prices for i, v in replay(prices[t], events[t], 0.05, 0.06, 10, optimistic).items()}
    assert got == want


def test_thinning_carries_no_paths(spark):
    table = flagged(spark, {"AA": walk(120, 3), "BB": walk(90, 4)}, {"AA": [3, 7, 30, 35, 118], "BB": [0, 1, 60]})
    ledger = outcomes.barrier_trades(table, mode="non_overlapping")
    assert not {"path", "_split_end"} & set(ledger.columns)
    slim = outcomes.barrier_trades(table.withColumn("split", F.lit("all")).select(*outcomes.TRADE_INPUTS), mode="non_overlapping", spread=3)
    rows = [sorted(map(str, t.select(*outcomes.TRADE_COLUMNS).collect())) for t in (ledger, slim)]
    assert rows[0] == rows[1] and len(rows[0]) == 8


def thin_rows(spark, entries):
    """A ledger of (ticker, position, holding bars or None), all other outcomes blank."""
    blank = {c: F.lit(None).cast("double") for c in outcomes.OUTCOME_COLUMNS if c != "holding_bars"}
    frame = spark.createDataFrame(entries, "ticker string, position long, holding_bars long")
    return frame.withColumns({**blank, "ambiguous_bar": F.lit(False), "status": F.when(
        F.col("holding_bars").isNull(), "incomplete_window").otherwise("completed")})


def accepted(entries):
    last, out = {}, {}
    for ticker, at, bars in sorted(entries, key=lambda e: (str(e[0]), e[1])):
        late = at + 1 <= last.get(ticker, -1)
        out[ticker, at] = "overlap" if late else "completed" if bars else "incomplete_window"
        if bars and not late:
            last[ticker] = at + bars
    return out


def test_one_long_series_against_replay(spark):
    rng = random.Random(4)
    # Dense, sparse and empty stretches, longer than a node of cells; also a series without name.
    places = [i for i in range(200_000) if not 70_000 <= i < 140_000 and rng.random() < (1 if i < 60_000 else 0.02)]
    entries = [("AA", i, rng.choice([1, 2, 9, 10, 10, None])) for i in places] + [(None, i, 10) for i in range(0, 5_000, 3)]
    table = outcomes.thin(thin_rows(spark, entries))
    got = {(r.ticker, r.position): r.status for r in table.select("ticker", "position", "status").collect()}
    assert len(entries) > 60_000 and got == accepted(entries)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_holding_longer_than_a_cell(spark, monkeypatch):
    monkeypatch.setattr(outcomes, "CELL", 4)
    monkeypatch.setattr(outcomes, "FAN", 2)
    rng = random.Random(6)
    entries = [("AA", i, rng.randint(1, 12)) for i in range(500) if rng.random() < 0.6]
    table = outcomes.thin(thin_rows(spark, entries), holding=12)
    assert {(r.ticker, r.position): r.status for r in table.collect()} == accepted(entries)


def test_forward_outcomes(spark):
    prices = walk(60, 3)
    table = flagged(spark, {"AA": prices}, {"AA": [5, 45, 59]})
    got = {(r.timestamp, r.horizon): r for r in outcomes.forward_outcomes(table, horizons=(1, 20)).collect()}
    row = got[day(5), 20]
    entry = prices[6][0]
    assert row.entry_timestamp == day(6) and row.end_timestamp == day(25)
    assert row.forward_return == pytest.approx(prices[25][3] / entry - 1)
    assert row.mfe == pytest.approx(max(p[1] for p in prices[6:26]) / entry - 1)
    assert row.mae == pytest.approx(min(p[2] for p in prices[6:26]) / entry - 1)
    assert [got[day(45), n].status for n in (1, 20)] == ["completed", "incomplete_window"]
    assert got[day(59), 1].status == "no_next_bar"


def test_split_boundary(spark):
    table = flagged(spark, {"AA": FLAT}, {"AA": [0, 8]}).withColumn(
        "split", F.when(F.col("position") < 15, "research").otherwise("test"))
    statuses = [r.status for r in outcomes.barrier_trades(table).orderBy("timestamp").collect()]
    assert statuses == ["completed", "split_boundary"]


def test_prior_visits_against_all_pairs(spark):
    prices = {t: walk(500, i) for i, t in enumerate(("AA", "BB"))}
    rng = random.Random(3)
    events = {t: sorted(rng.sample(range(500), 150)) for t in prices}
    table = flagged(spark, prices, events).withColumn("fold", F.lit("all"))
    walked = paths.rebound_paths(table)
    got = {(r.ticker, r.timestamp): (r.prior_successful_visits, r.days_since_visit)
           for r in paths.prior_visits(table.where("dip_event_v1"), walked).collect()}
    known = walked.collect()
    asked = table.where("dip_event_v1").select("ticker", "timestamp", "close").collect()
    assert len(known) > 200
    for a in asked:
        ages = [(a.timestamp - p.timestamp).days for p in known
                if p.ticker == a.ticker and p.maturity < a.timestamp and 1 <= (a.timestamp - p.timestamp).days <= 365
                and p.full_mfe >= 0.05 and abs(a.close / p.signal_low - 1) <= 0.02]
        assert got[a.ticker, a.timestamp] == (len(ages), min(ages) if ages else None)


def test_undefined_range_is_refused_not_unbarred(spark):
    rows = spark.createDataFrame([("AA", 0.03), ("BB", None)], "ticker string, atr_pct_14 double")
    table = policies.each_candidate(rows).withColumns(dict(zip(("s", "t"), policies.fractions(F.col("atr_pct_14")))))
    direct = table.where(F.col("family").isin("fixed", "control"))
    assert direct.where("ticker = 'BB' and candidate_id = 'v1_control'").select("s", "t").first()[:] == (0.07, 0.10)
    with pytest.raises(Exception, match="no usable range"):
        table.select("ticker", "s", "t").collect()


def test_a_doubled_session_is_refused(spark):
    index = bars_of(spark, {"ALL": walk(5, 1)})
    assert features.index_context(index).count() == 5
    with pytest.raises(Exception, match="several rows"):
        features.with_index(index, features.index_context(index.union(index.limit(1)))).collect()
