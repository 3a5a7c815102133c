"""Reading, writing, cleaning and auditing bars; streaming twins."""

import datetime
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, outcomes, series
from tidemark.plans import market
from tidemark.sources import bars, quality, snapshots
from tidemark.streaming import jobs
from tests.conftest import SMALL, bars_of, day, walk
from tests.test_outcomes import flagged


def test_round_trip_replaces_only_given_symbols(spark, tmp_path):
    path = str(tmp_path / "bars")
    snapshots.write_bars(bars_of(spark, {"AA": walk(20, 1), "BB": walk(20, 2)}), path)
    snapshots.write_bars(bars_of(spark, {"BB": walk(5, 3)}), path)
    counts = {r.ticker: r["count"] for r in snapshots.read_bars(spark, path).groupBy("ticker").count().collect()}
    assert counts == {"AA": 20, "BB": 5}
    part = snapshots.read_bars(spark, path, tickers=[" aa "], start=str(day(3)), end=str(day(6)))
    assert [r.timestamp for r in part.orderBy("timestamp").collect()] == [day(3), day(4), day(5)]


def test_snapshots_answer_only_what_they_cover(spark, tmp_path):
    path = str(tmp_path / "stored")
    bars = bars_of(spark, {t: walk(40, i) for i, t in enumerate(("AA", "BB", "CC"))})
    ranges = spark.createDataFrame([(t, day(0), day(40)) for t in ("AA", "BB", "CC")], "ticker string, saved_start date, saved_end date")
    snapshots.write_snapshot(bars, path, ranges, source="test")
    asked = lambda *rows: spark.createDataFrame(rows, "ticker string, start date, end date")
    got = snapshots.scan(spark, path, asked((" aa", day(3), day(6)), ("AA", day(5), day(8)), ("BB", day(38), day(40))))
    assert sorted((r.ticker, r.timestamp) for r in got.collect()) == [("AA", day(i)) for i in range(3, 8)] + [("BB", day(38)), ("BB", day(39))]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert snapshots.scan(spark, path, asked(("CC", None, None))).count() == 40
    for row, reason in ((("AA", day(39), day(41)), "not_covered"), (("DD", None, None), "missing"), (("A A", None, None), "bad_symbol"),
                        (("AA", day(3), day(3)), "empty_range")):
        with pytest.raises(ValueError, match=reason):
            snapshots.scan(spark, path, asked(row))
    # A new snapshot of one symbol replaces its range; unsound bars are refused and change nothing.
    snapshots.write_snapshot(bars.where("ticker = 'BB'").limit(5), path, ranges.where("ticker = 'BB'"), source="again", interval="1h")
    with pytest.raises(ValueError, match="unsupported"):
        snapshots.scan(spark, path, asked(("BB", None, None)))
    with pytest.raises(ValueError, match="malformed_range"):
        snapshots.write_snapshot(bars.withColumn("high", F.col("low") / 2), path, ranges, source="broken")
    assert snapshots.scan(spark, path, asked(("AA", None, None))).count() == 40


def test_ledgers_summaries_and_coverage(spark, tmp_path):
    bars = bars_of(spark, {"AA": walk(30, 1), "BB": walk(10, 2)})
    snapshots.write_ledger(bars, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).exceptAll(bars).count() == 0
    snapshots.write_summary(bars.select("close"), str(tmp_path / "summary"))
    back = spark.read.schema("close double").option("header", True).csv(str(tmp_path / "summary"))
    assert back.exceptAll(bars.select("close")).count() == 0
    held = bars.groupBy("ticker").agg(F.min("timestamp").alias("saved_start"), F.max("timestamp").alias("saved_end"))
    asked = spark.createDataFrame([("AA",), ("BB",), ("CC",)], "ticker string")
    missing = snapshots.uncovered(held, asked, F.lit(day(2)), F.lit(day(20)))
    assert sorted(r.ticker for r in missing.collect()) == ["BB", "CC"]


def test_clean_and_violations(spark):
    raw = spark.createDataFrame([
        ("2024-01-02T00:00:00-05:00", " aa", "1", "3", "1", "2", "10.0"), ("2024-01-02T00:00:00-05:00", "AA ", "1", "3", "1", "2", "10"),
        ("2024-01-03", "aa", "1", "3", "1", "2", "1.5"), ("2024-01-04", "aa", "1", "3", "1", "x", "5"),
        ("2024-01-05", "aa", "1", "3", "1", "2", "5"), ("2024-01-05", "aa", "1", "3", "1", "2", "6"), ("2024-01-06", "aa", "4", "3", "1", "2", "5"),
    ], "Date string, Ticker string, Open string, High string, Low string, Close string, Volume string")
    bars = quality.clean(raw)
    assert bars.where(F.col("timestamp") == F.lit(datetime.date(2024, 1, 2))).count() == 1
    row = quality.bar_violations(bars).collect()[0]
    assert (row.rows, row.missing, row.duplicate_keys, row.malformed_range) == (6, 2, 1, 1)


def test_audit_measures_one_spacing(spark):
    close = 10.000000000000002
    raw = spark.createDataFrame([("AA", 0, day(0), 9.0, 10.0, 8.0, close), ("AA", 1, day(1), 7.0, 6.0, 8.0, None)],
                                "ticker string, row_position long, session date, open double, high double, low double, close double")
    rows = {(r.row_position, r.rule): r for r in quality.audit_ohlc(raw).collect()}
    assert rows[0, "close_gt_high"].spacing_units == 1.0
    assert {rule for p, rule in rows if p == 1} == {"low_gt_high", "open_lt_low", "open_gt_high", "invalid_close"}


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_hourly_bars_stream_matches_batch(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    shutil.copy(f"{SMALL}/events.parquet", source / "events.parquet")
    schema = spark.read.parquet(str(source)).schema
    ticks = spark.readStream.schema(schema).parquet(str(source)).withColumn("ts", F.col("ts").cast("timestamp"))
    run(jobs.bar_stream(ticks, at="ts", series=F.col("event_type"), price=F.col("value"), size=F.lit(1), order=["ts", "event_id"]), "hourly")
    got = spark.table("hourly").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    want = market.hourly_event_bars(spark, SMALL)
    assert got.count() > 0 and got.exceptAll(want).count() == 0
    # Only bars the watermark has not passed yet may be missing.
    last = want.agg(F.max("timestamp")).collect()[0][0]
    assert want.exceptAll(got).where(F.col("timestamp") < F.lit(last - datetime.timedelta(hours=3))).count() == 0


def test_copies_are_ingested_once(spark, tmp_path):
    bars = bars_of(spark, {"AA": walk(5, 1)}).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = str(tmp_path / "in")
    bars.union(bars).repartition(2).write.parquet(path)
    run(jobs.unique_bars(spark.readStream.schema(bars.schema).parquet(path)), "unique_bars")
    assert spark.table("unique_bars").count() == 5


def test_conflicting_bars_pass_and_are_told_apart(spark, tmp_path):
    bars = bars_of(spark, {"AA": walk(5, 1)}).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    other = bars.where(F.col("timestamp") == F.lit(day(2)).cast("timestamp")).withColumn("close", F.col("close") + 1)
    path = str(tmp_path / "in")
    bars.union(bars).union(other).repartition(2).write.parquet(path)
    run(jobs.unique_bars(spark.readStream.schema(bars.schema).parquet(path)), "conflicting_bars")
    kept = spark.createDataFrame(spark.table("conflicting_bars").collect(), bars.schema)
    assert kept.count() == 6 and jobs.conflicts(kept).count() == 2


def test_edges_carry_over_batches(spark, tmp_path):
    path = str(tmp_path / "rows")
    flags = [False, True, True, False, True, True]
    for i, flag in enumerate(flags):
        frame = bars_of(spark, {"AA": walk(6, 1)}).where(F.col("timestamp") == F.lit(day(i)))
        frame = frame.withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "dip_condition_v1": F.lit(flag)})
        frame.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (jobs.edges_and_range(stream, window=2).writeStream.format("memory").queryName("edges").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.table("edges").orderBy("timestamp").collect()
    assert [r.dip_event_v1 for r in rows] == [False, True, False, False, True, False]
    assert rows[1].atr is None and rows[2].atr is not None


def in_files(frames, path):
    """One file for each frame, read in this order."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def test_conflicting_bars_are_routed_out_in_any_order(spark, tmp_path):
    bars = bars_of(spark, {"AA": walk(8, 1), "BB": walk(8, 2)}).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    rows = bars.collect()
    changed = [r for r in rows if r.timestamp.day in (3, 6) and r.ticker == "AA"]
    other = [(*r[:5], r.close + 1, r.volume) for r in changed]
    nameless = [(rows[0].timestamp, None, *rows[0][2:])] * 2
    late = (rows[0].timestamp + datetime.timedelta(days=60), "ZZ", *rows[0][2:])
    deck = [tuple(r) for r in rows] * 2 + other + nameless
    for seed in (1, 2):
        random.Random(seed).shuffle(deck)
        path = str(tmp_path / f"in{seed}")
        in_files([spark.createDataFrame(part, bars.schema) for part in (deck[:9], deck[9:20], deck[20:], [late])], path)
        good, bad = [], []
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(path)
        sink = jobs.routed(lambda f: good.extend(f.collect()), lambda f: bad.extend(f.collect()))
        jobs.checked_bars(stream, late="20 days").writeStream.foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, bad), key=str) == sorted([*map(tuple, changed), *other], key=str)
        assert sorted(map(tuple, good), key=str) == sorted([*(tuple(r) for r in rows if r not in changed), nameless[0]], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_state_equals_batch_in_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    prices = {t: walk(90, i) for i, t in enumerate(("AA", "BB"))}
    conditions = {t: [rng.random() < 0.5 for _ in range(90)] for t in prices}
    events = {t: [i for i, c in enumerate(own) if c and not (i and own[i - 1])] for t, own in conditions.items()}
    schema = "timestamp timestamp, ticker string, open double, high double, low double, close double, dip_condition_v1 boolean"
    at = lambda i: datetime.datetime(2019, 1, 1) + datetime.timedelta(days=i)
    deck = [(i + rng.uniform(0, 4), (at(i), t, *map(float, prices[t][i]), conditions[t][i])) for t in prices for i in range(90)]
    rows = [r for _, r in sorted(deck)]
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [[(at(300), "ZZ", 1.0, 1.0, 1.0, 1.0, False)]]
    path = str(tmp_path / "in")
    in_files([spark.createDataFrame(p, schema) for p in parts], path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(jobs.series_state(stream, late="6 days", stop=0.05, target=0.06), f"series_{seed}")
    found = spark.table(f"series_{seed}").where("ticker <> 'ZZ'").collect()
    bars = [r for r in found if r.trade is None]
    assert sorted((r.ticker, r.position) for r in bars) == [(t, i) for t in sorted(prices) for i in range(90)]
    assert {(r.ticker, r.position) for r in bars if r.dip_event_v1} == {(t, i) for t in prices for i in events[t]}
    table = flagged(spark, prices, events)
    ranges = features.wilder_measures(series.whole(table.drop("position", "length")), rsi=None)
    want = {(r.ticker, r.position): r.atr_14 for r in ranges.select("ticker", "position", "atr_14").collect()}
    assert all(r.atr == pytest.approx(want[r.ticker, r.position], rel=1e-12) if r.atr else want[r.ticker, r.position] is None for r in bars)
    batch = outcomes.barrier_trades(table, mode="non_overlapping", stop_loss=0.05, take_profit=0.06)
    fields = ("status", "entry_price", "exit_price", "exit_reason", "fill_type", "holding_bars", "ambiguous_bar")
    want = {(r.ticker, r.position): tuple(r[f] for f in fields) for r in batch.collect()}
    assert {(r.ticker, r.position): tuple(r.trade[f] for f in fields) for r in found if r.trade} == want
    assert len({v[0] for v in want.values()}) >= 3


def test_timing_labels_in_each_batch(spark):
    stamp = datetime.datetime(2024, 1, 2, 21)
    base = dict(session=datetime.date(2024, 1, 2), close=stamp, collection_start=stamp + datetime.timedelta(hours=8),
                next_open=stamp + datetime.timedelta(hours=17), mode="collect", available=True, clean_revision=True, correction=False,
                future_input=False, source_times=[stamp, stamp], latest_sessions=[datetime.date(2024, 1, 2)] * 2)
    at = lambda h: stamp + datetime.timedelta(hours=h)
    cases = [("prospective", dict(published_at=at(9))), ("late", dict(published_at=at(17))), ("early", dict(published_at=at(7))),
             ("unverifiable", dict(published_at=at(9), source_times=[stamp, None])), ("correction", dict(published_at=at(9), correction=True)),
             ("stale", dict(published_at=at(9), latest_sessions=[datetime.date(2024, 1, 2), datetime.date(2024, 1, 1)])),
             ("retrospective", dict(published_at=at(9), mode="replay")), ("unavailable", dict(published_at=at(9), available=False)),
             ("unverifiable", dict(published_at=at(9), clean_revision=False))]
    schema = ("published_at timestamp_ntz, session date, close timestamp_ntz, collection_start timestamp_ntz, next_open timestamp_ntz, mode string, "
              "available boolean, clean_revision boolean, correction boolean, future_input boolean, source_times array<timestamp_ntz>, latest_sessions array<date>")
    names = [c.split()[0] for c in schema.split(", ")]
    frame = spark.createDataFrame([tuple({**base, **c}[n] for n in names) for _, c in cases], schema)
    seen = []
    jobs.label_timing(F.lit("2024-01-01").cast("date"), lambda f: seen.extend(r.classification for r in f.collect()))(frame, 0)
    assert sorted(seen) == sorted(w for w, _ in cases)


def test_ticks_are_dealt_whole_or_folded_first(spark):
    rows = [(i % 7, f"S{i % 3}", i, float(i * 37 % 101), float(i % 5 + 1)) for i in range(400)] + [(0, None, 1, 2.0, 3.0), (0, None, 0, 4.0, 5.0)]
    ticks = spark.createDataFrame(rows, "at int, name string, id int, price double, size double")
    parts = {"at": F.col("at"), "series": F.col("name"), "price": F.col("price"), "size": F.col("size"), "order": ["id"]}
    folded, dealt = bars.bars_from_ticks(ticks, **parts), bars.bars_from_ticks(ticks, **parts, spread=5)
    # One exchange, of ticks: no partial bar, which holds each tick twice, is sorted or shipped.
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "tick#" not in plan[plan.index("Exchange"):]
    assert sorted(map(str, dealt.collect())) == sorted(map(str, folded.collect()))
