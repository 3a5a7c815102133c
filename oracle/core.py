"""Checking SQL for the core queries."""

from __future__ import annotations

from oracle.base import COMPONENTS, EVENT_ID, SIGNAL_FEATURES, THRESHOLDS, barrier_parts, part, r, rounded, sql

SQL: dict[str, str] = {}
BARS = "timestamp, ticker, volume"
PRICES = "open, high, low, close"
KEYS = "timestamp, ticker"

part("order_bars", "", """
  SELECT CAST(o_orderdate AS DATE) AS timestamp, regexp_extract(o_orderpriority, '^([^-]+)', 1) AS ticker,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2""")
SQL["bars_lineitem"] = sql(rounded(BARS, PRICES, "FROM bars"), "bars")
SQL["scan_bars"] = sql(rounded(BARS, PRICES, "FROM order_bars"), "order_bars")
SQL["bars_events_hour"] = rounded(BARS, PRICES, """
  FROM (SELECT date_trunc('hour', ts) AS timestamp, event_type AS ticker, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
               min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)""")
SQL["scan_universe"] = sql(rounded(BARS, PRICES, """
  FROM (SELECT timestamp, upper(trim(ticker)) AS ticker, open, high, low, close, volume FROM bars
        UNION SELECT timestamp, upper(trim(ticker)), open, high, low, close, volume FROM order_bars)"""), "bars", "order_bars")
part("catalogue", "bars order_bars", """
  SELECT ticker, min(timestamp) AS saved_start, max(timestamp) + 1 AS saved_end, count(*) AS n
  FROM (SELECT timestamp, ticker FROM bars UNION ALL SELECT timestamp, ticker FROM order_bars) GROUP BY 1""")
SQL["scan_requests"] = sql(rounded(BARS, PRICES, """
  FROM bars JOIN (SELECT ticker, min(timestamp) AS first FROM bars GROUP BY 1) f USING (ticker)
  WHERE timestamp < CAST(first + INTERVAL 18 MONTH AS DATE)
     OR (ticker LIKE '%F' AND timestamp >= CAST(first + INTERVAL 12 MONTH AS DATE) AND timestamp < CAST(first + INTERVAL 24 MONTH AS DATE))"""), "bars")
SQL["snapshot_refusals"] = sql("""
  SELECT ticker, CAST(saved_start + CAST(n % 2 AS INT) - 1 AS DATE) AS start, CAST(saved_end + CAST(n % 3 AS INT) - 1 AS DATE) AS "end",
         CASE WHEN n % 5 = 0 THEN 'unsupported' ELSE 'not_covered' END AS reason
  FROM catalogue WHERE n % 5 = 0 OR n % 2 = 0 OR n % 3 = 2
  UNION ALL SELECT ticker, saved_end, saved_end, 'empty_range' FROM catalogue
  UNION ALL SELECT CASE WHEN count(*) % 2 = 0 THEN c_mktsegment || ' ?' ELSE c_mktsegment END, NULL, NULL,
                   CASE WHEN count(*) % 2 = 0 THEN 'bad_symbol' ELSE 'missing' END FROM customer GROUP BY c_mktsegment""", "catalogue")
SQL["scan_date_range"] = sql(rounded(BARS, PRICES, """
  FROM bars b, cuts c WHERE b.timestamp >= validation_start AND b.timestamp < test_start AND b.ticker IN
    (SELECT ticker FROM bars, cuts GROUP BY ticker HAVING min(timestamp) <= min(validation_start) AND max(timestamp) >= min(test_start))"""), "bars", "cuts")
SQL["validate_bars"] = sql("""
  SELECT count(*) AS rows, count(*) FILTER (timestamp IS NULL OR ticker IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS missing,
         count(*) FILTER (NOT (isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close))) AS not_finite,
         count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive,
         count(*) FILTER (low > high OR open < low OR open > high OR close < low OR close > high) AS malformed_range,
         count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (NOT regexp_full_match(ticker, '[A-Z0-9^][A-Z0-9.^=-]{0,31}')) AS bad_symbol,
         0::BIGINT AS not_midnight, count(*) - count(DISTINCT (timestamp, ticker)) AS duplicate_keys FROM bars""", "bars")
part("broken", "bars", """
  SELECT CASE WHEN volume % 53 = 0 THEN NULL WHEN volume % 11 = 0 THEN CAST(timestamp AS TIMESTAMP) + INTERVAL 90 MINUTE ELSE CAST(timestamp AS TIMESTAMP) END AS timestamp,
         CASE WHEN volume % 13 = 0 THEN lower(ticker) WHEN volume % 31 = 0 THEN ticker || ' ?' ELSE ticker END AS ticker,
         CASE WHEN volume % 17 = 0 THEN -open ELSE open END AS open, CASE WHEN volume % 7 = 0 THEN low / 2 ELSE high END AS high, low,
         CASE WHEN volume % 19 = 0 THEN 'nan'::DOUBLE WHEN volume % 23 = 0 THEN 'inf'::DOUBLE WHEN volume % 29 = 0 THEN NULL ELSE close END AS close,
         CASE WHEN volume % 37 = 0 THEN -volume ELSE volume END AS volume
  FROM bars, range(2) c(copy) WHERE copy = 0 OR volume % 41 = 0""")
SQL["validate_faulty_bars"] = sql("""
  SELECT count(*) AS rows, count(*) FILTER (timestamp IS NULL OR close IS NULL) AS missing, count(*) FILTER (close IS NULL OR NOT isfinite(close)) AS not_finite,
         count(*) FILTER (open <= 0) AS not_positive,
         count(*) FILTER (low > high OR open < low OR open > high OR close < low OR close > high) AS malformed_range, count(*) FILTER (volume < 0) AS negative_volume,
         count(*) FILTER (ticker <> upper(ticker) OR ticker LIKE '% ?') AS bad_symbol,
         count(*) FILTER (CAST(timestamp AS TIME) <> TIME '00:00:00') AS not_midnight,
         (SELECT count(*) FROM (SELECT 1 FROM broken GROUP BY timestamp, ticker HAVING count(*) > 1)) AS duplicate_keys FROM broken""", "broken")
SQL["clean_bars"] = sql(rounded(BARS, PRICES, "FROM bars"), "bars")

part("faulty", "base", """
  SELECT ticker, position AS row_position, timestamp AS session, lag(open) OVER (PARTITION BY ticker ORDER BY timestamp) AS open,
         (open + close) / 2 AS high, low, close FROM base""")
part("findings", "faulty", " UNION ALL ".join(
    [f"SELECT *, 'invalid_{c}' AS rule, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM faulty WHERE {c} IS NULL OR {c} <= 0"
     for c in ("open", "high", "low", "close")]
    + [f"SELECT *, '{rule}' AS rule, {a} AS a, {b} AS b FROM faulty WHERE {a} > {b}" for rule, a, b in (
        ("low_gt_high", "low", "high"), ("open_lt_low", "low", "open"), ("open_gt_high", "open", "high"),
        ("close_lt_low", "low", "close"), ("close_gt_high", "close", "high"))]))
part("audit", "findings", """
  SELECT *, a - b AS absolute_gap, (a - b) / greatest(abs(a), abs(b)) AS relative_gap,
         (a - b) / pow(2, floor(log2(greatest(abs(a), abs(b)))) - 52) AS spacing_units FROM findings""")
SQL["audit_ohlc"] = sql(rounded("ticker, row_position, session, rule",
                                PRICES + ", absolute_gap, relative_gap, spacing_units", "FROM audit"), "audit")
part("audit_sum", "audit requested faulty", """
  SELECT r.ticker, CASE WHEN f.n IS NULL THEN 'acquisition_failed' ELSE 'measured' END AS diagnostic_status, coalesce(f.n, 0) AS rows,
         coalesce(a.affected, 0) AS affected_rows, coalesce(a.affected, 0) / f.n AS affected_fraction, coalesce(a.violations, 0) AS violations,
         first_affected, last_affected, coalesce(rules, '') AS rules, max_absolute_gap, max_relative_gap, max_spacing_units
  FROM requested r LEFT JOIN (SELECT ticker, count(*) AS n FROM faulty GROUP BY 1) f ON r.ticker = f.ticker
  LEFT JOIN (SELECT ticker, count(DISTINCT row_position) AS affected, count(*) AS violations, min(session) AS first_affected,
                    max(session) AS last_affected, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, max(absolute_gap) AS max_absolute_gap,
                    max(relative_gap) AS max_relative_gap, max(spacing_units) AS max_spacing_units FROM audit GROUP BY 1) a ON r.ticker = a.ticker""")
SQL["audit_summary"] = sql(rounded(
    "ticker, diagnostic_status, rows, affected_rows, violations, first_affected, last_affected, rules",
    "affected_fraction, max_absolute_gap, max_relative_gap, max_spacing_units", "FROM audit_sum"), "audit_sum")
SQL["audit_totals"] = sql(f"""
  SELECT diagnostic_status, count(*) AS symbols, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(affected_rows) AS BIGINT) AS affected_rows,
         CAST(sum(violations) AS BIGINT) AS violations, {r('max(max_relative_gap)')} AS max_relative_gap FROM audit_sum GROUP BY 1""", "audit_sum")


def _feature(columns: str, source: str = "plainfeat") -> str:
    return sql(rounded(KEYS, columns, f"FROM {source}"), source)


SQL["feat_returns"] = _feature("return_1d, return_5d, return_10d, return_20d")
LOCATION = ", ".join(f"{c}_{n}d" for n in (20, 60) for c in ("drawdown", "distance_from_low", "distance_from_high"))
SQL["feat_location"] = _feature(LOCATION)
SQL["feat_zscore"] = _feature("price_zscore_20d")
SQL["feat_rsi"] = _feature("rsi_14", "feat")
SQL["feat_atr"] = _feature("true_range, atr_14, atr_pct_14", "feat")
SQL["feat_volatility"] = _feature("volatility_20d, volatility_60d", "feat")
SQL["feat_volume"] = _feature("volume_mean_20d, relative_volume_20d, volume_zscore_20d")
SQL["feat_benchmark"] = _feature("benchmark_return_20d, benchmark_drawdown_20d, benchmark_volatility_20d")
SQL["feat_relative"] = _feature("relative_return_5d, relative_return_10d, relative_return_20d")
ALL_FEATURES = (
    "return_1d, return_5d, return_10d, return_20d, " + LOCATION + ", price_zscore_20d, rsi_14, true_range, atr_14, atr_pct_14, "
    "volatility_20d, volatility_60d, volume_mean_20d, relative_volume_20d, volume_zscore_20d, relative_return_5d, relative_return_10d, "
    "relative_return_20d, benchmark_return_20d, benchmark_drawdown_20d, benchmark_volatility_20d")
SQL["features_all"] = sql(rounded(BARS, PRICES + ", " + ALL_FEATURES, "FROM feat"), "feat")
part("rec_wilder", "plainfeat", """
  SELECT ticker, CAST(20 AS BIGINT) AS position, avg(true_range) AS y FROM plainfeat WHERE position BETWEEN 1 AND 20 GROUP BY ticker HAVING count(*) = 20
  UNION ALL SELECT r.ticker, p.position, r.y + (p.true_range - r.y) / 20 FROM rec_wilder r JOIN plainfeat p ON p.ticker = r.ticker AND p.position = r.position + 1""")
SQL["wilder"] = sql("SELECT p.timestamp, p.ticker, " + r('r.y') + " AS atr_20 FROM plainfeat p LEFT JOIN rec_wilder r ON r.ticker = p.ticker AND r.position = p.position",
                    "plainfeat", "rec_wilder")
part("long_wilder", "plainfeat", """
  SELECT ticker, CAST(60 AS BIGINT) AS position, avg(true_range) AS tr, avg(gain) AS up, avg(loss) AS down
  FROM plainfeat WHERE position BETWEEN 1 AND 60 GROUP BY ticker HAVING count(*) = 60
  UNION ALL SELECT w.ticker, p.position, w.tr + (p.true_range - w.tr) / 60, w.up + (p.gain - w.up) / 60, w.down + (p.loss - w.down) / 60
  FROM long_wilder w JOIN plainfeat p ON p.ticker = w.ticker AND p.position = w.position + 1""")
part("long_ctx", "idx", "SELECT timestamp, close / lag(close, 250) OVER (ORDER BY timestamp) - 1 AS benchmark_return_250d FROM idx")
F1000 = "(PARTITION BY p.ticker ORDER BY p.timestamp ROWS 999 PRECEDING)"
part("long", "plainfeat long_wilder long_ctx", f"""
  SELECT p.timestamp, p.ticker, close / lag(close, 250) OVER w - 1 AS return_250d, close / lag(close, 1000) OVER w - 1 AS return_1000d,
         CASE WHEN p.position >= 999 THEN close / max(close) OVER {F1000} - 1 END AS drawdown_1000d,
         CASE WHEN p.position >= 999 THEN close / min(close) OVER {F1000} - 1 END AS distance_from_low_1000d,
         CASE WHEN p.position >= 999 THEN (close - avg(close) OVER {F1000}) / stddev_samp(close) OVER {F1000} END AS price_zscore_1000d,
         CASE WHEN up + down > 0 THEN 100 * up / (up + down) END AS rsi_60, tr AS atr_60,
         CASE WHEN p.position >= 1000 THEN stddev_samp(return_1d) OVER {F1000} * sqrt(252.0) END AS volatility_1000d,
         CASE WHEN p.position >= 999 THEN volume / avg(volume) OVER {F1000} END AS relative_volume_1000d,
         close / lag(close, 1000) OVER w - benchmark_close / lag(benchmark_close, 1000) OVER w AS relative_return_1000d, benchmark_return_250d
  FROM plainfeat p LEFT JOIN long_wilder s ON p.ticker = s.ticker AND p.position = s.position LEFT JOIN long_ctx c ON p.timestamp = c.timestamp
  WINDOW w AS (PARTITION BY p.ticker ORDER BY p.timestamp)""")
SQL["features_long"] = sql(rounded(KEYS, "return_250d, return_1000d, drawdown_1000d, distance_from_low_1000d, price_zscore_1000d, rsi_60, atr_60, "
                                   "volatility_1000d, relative_volume_1000d, relative_return_1000d, benchmark_return_250d", "FROM long"), "long")
SQL["feat_dd_change"] = sql(rounded(KEYS, "drawdown_change_5", """
  FROM (SELECT timestamp, ticker, drawdown_60d - lag(drawdown_60d, 5) OVER (PARTITION BY ticker ORDER BY timestamp) AS drawdown_change_5 FROM plainfeat)"""), "plainfeat")
part("tercile", "feat", """
  SELECT timestamp, ticker, atr_pct_14, CASE WHEN n >= 126 THEN lo END AS volatility_low, CASE WHEN n >= 126 THEN hi END AS volatility_high,
         CASE WHEN atr_pct_14 IS NULL OR n < 126 THEN 'unavailable' WHEN atr_pct_14 <= lo THEN 'low' WHEN atr_pct_14 <= hi THEN 'middle' ELSE 'high' END AS volatility_group
  FROM (SELECT timestamp, ticker, atr_pct_14, count(atr_pct_14) OVER p AS n, quantile_cont(atr_pct_14, 0.3333333333333333) OVER p AS lo,
               quantile_cont(atr_pct_14, 0.6666666666666666) OVER p AS hi
        FROM feat WINDOW p AS (PARTITION BY ticker ORDER BY timestamp ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))""")
SQL["vol_tercile"] = sql(rounded(KEYS + ", volatility_group", "atr_pct_14, volatility_low, volatility_high", "FROM tercile"), "tercile")

SQL["thresholds"] = sql(rounded(KEYS, ", ".join(THRESHOLDS), "FROM sig"), "sig")
SQL["components"] = sql(f"SELECT {KEYS}, {', '.join(COMPONENTS)}, dip_ready_v1 FROM sig", "sig")
SQL["signals"] = sql(f"SELECT {KEYS}, dip_ready_v1, dip_component_count, dip_condition_v1, dip_event_v1 FROM sig", "sig")
SQL["dip_events"] = sql(rounded(KEYS + ", dip_component_count", "close, " + ", ".join(SIGNAL_FEATURES + THRESHOLDS), "FROM sig WHERE dip_event_v1"), "sig")
LETTERS = " || ".join(f"CASE WHEN {c} THEN '{x}' ELSE '' END" for x, c in zip("ABCD", COMPONENTS))
SQL["combination"] = sql(f"SELECT {LETTERS} AS combination, count(*) AS rows, count(*) FILTER (dip_event_v1) AS events FROM sig WHERE dip_ready_v1 GROUP BY 1", "sig")
SQL["signal_input_checks"] = sql(
    "SELECT count(*) AS rows, count(*) FILTER (timestamp IS NULL OR ticker IS NULL) AS missing_keys, count(*) - count(DISTINCT (timestamp, ticker)) AS duplicate_keys, "
    + " + ".join(f"count(*) FILTER (isinf({c}) OR isnan({c}))" for c in SIGNAL_FEATURES) + " AS infinite_inputs, "
    + ", ".join(f"count({c}) AS defined_{c}" for c in SIGNAL_FEATURES) + " FROM sig", "sig")
def invariants(source: str) -> str:
    return f"""
  SELECT *, CAST(coalesce(last_research >= v0, false) AS BIGINT) + CAST(coalesce(v1 >= first_test, false) AS BIGINT)
            + CAST(coalesce(last_research >= first_test, false) AS BIGINT) AS unordered_splits FROM (
  SELECT count(*) AS rows, count(*) FILTER (dip_event_v1 AND NOT dip_condition_v1) AS event_without_condition,
         count(*) FILTER (dip_condition_v1 AND NOT dip_ready_v1) AS condition_without_ready, count(*) FILTER (dip_component_count NOT BETWEEN 0 AND 4) AS bad_count,
         (SELECT count(*) FROM (SELECT timestamp FROM {source} GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS mixed_dates,
         max(timestamp) FILTER (split = 'research') AS last_research, min(timestamp) FILTER (split = 'test') AS first_test,
         min(timestamp) FILTER (split = 'validation') AS v0, max(timestamp) FILTER (split = 'validation') AS v1 FROM {source})"""


part("spoilt_sig", "split_sig", """
  SELECT * REPLACE (dip_event_v1 OR volume % 13 = 0 AS dip_event_v1,
                    CASE WHEN volume % 17 = 0 THEN NOT dip_condition_v1 ELSE dip_condition_v1 END AS dip_condition_v1,
                    CASE WHEN volume % 19 = 0 THEN dip_component_count + 5 ELSE dip_component_count END AS dip_component_count,
                    CASE WHEN volume % 23 = 0 THEN 'research' ELSE split END AS split) FROM split_sig""")
SQL["signal_invariants"] = sql(f"SELECT * EXCLUDE (v0, v1) FROM ({invariants('split_sig')})", "split_sig")
SQL["signal_invariants_faulty"] = sql(f"SELECT * EXCLUDE (v0, v1) FROM ({invariants('spoilt_sig')})", "spoilt_sig")
SQL["extract_events"] = sql("SELECT timestamp, ticker, dip_component_count, split FROM split_sig WHERE dip_event_v1", "split_sig")
SQL["observation_filter"] = sql(rounded(KEYS + ", dip_component_count, dip_condition_v1, split", "close",
                                        "FROM split_sig WHERE split = 'validation' AND dip_event_v1 AND dip_component_count >= 3"), "split_sig")


def bin_sql(column: str, low: float, high: float) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'unknown' WHEN {column} <= {low} THEN 'low' WHEN {column} <= {high} THEN 'middle' ELSE 'high' END"


SQL["diag_bins"] = sql(f"""
  SELECT {bin_sql('relative_volume_20d', 1.0, 2.0)} AS bin, count(*) AS rows, {r('min(relative_volume_20d)')} AS smallest,
         {r('max(relative_volume_20d)')} AS largest FROM plainfeat GROUP BY 1""", "plainfeat")

SQL["splits"] = sql("SELECT split, count(DISTINCT timestamp) AS sessions, count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last FROM split_sig GROUP BY 1", "split_sig")
SQL["folds"] = sql("SELECT * FROM folds", "folds")
SQL["fold_checks"] = sql("""
  SELECT count(*) AS folds, count(DISTINCT history_start) - 1 AS changed_origins, count(*) - count(DISTINCT fold) AS duplicate_folds,
         count(*) FILTER (history_start > history_end) AS empty_histories, count(*) FILTER (history_end >= test_start) AS history_in_test,
         count(*) FILTER (test_start > test_end) AS empty_tests, count(*) FILTER (test_start <= pt) AS overlapping_tests,
         count(*) FILTER (history_end < pt) AS gaps_in_history, count(*) FILTER (history_end < ph) AS shrinking_histories
  FROM (SELECT *, lag(test_end) OVER (ORDER BY test_start) AS pt, lag(history_end) OVER (ORDER BY test_start) AS ph FROM folds)""", "folds")
SQL["regimes"] = sql("SELECT timestamp, regime FROM ctx", "ctx")
SQL["universe_select"] = sql("SELECT ticker FROM requested WHERE ticker NOT IN (SELECT l_returnflag || l_linestatus FROM lineitem WHERE l_linestatus = 'F')", "requested")
SQL["membership_checks"] = sql("""
  SELECT count(*) AS intervals, count(*) FILTER (start_date IS NULL) AS missing_start, count(*) FILTER (end_date <= start_date) AS empty_intervals,
         count(*) FILTER (nxt < end_date) AS overlaps, count(*) FILTER (nxt IS NOT NULL AND end_date IS NULL) AS open_before_last
  FROM (SELECT *, lead(start_date) OVER (PARTITION BY ticker ORDER BY start_date) AS nxt FROM membership)""", "membership")
SQL["membership"] = sql("""
  SELECT s.timestamp, s.ticker, EXISTS (SELECT 1 FROM membership m WHERE m.ticker = s.ticker AND s.timestamp >= m.start_date
         AND (m.end_date IS NULL OR s.timestamp < m.end_date)) AS member FROM bars s""", "bars", "membership")
SQL["norm_symbol"] = """
  WITH t AS (SELECT unnest([p_brand, p_type, p_name]) AS text FROM part), u AS (SELECT text, count(*) AS uses FROM t GROUP BY 1),
       s AS (SELECT text, uses, upper(trim(replace(text, ' ', '.'))) AS symbol FROM u)
  SELECT text, uses, symbol, regexp_full_match(symbol, '[A-Z0-9^][A-Z0-9.^=-]{0,31}') AND NOT suffix(symbol, '.')
         AND NOT regexp_full_match(split_part(symbol, '.', 1), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') AS valid FROM s"""
SQL["walkforward"] = sql(f"""
  SELECT fold, ledger, horizon, status, count(*) AS rows, {r('sum(value)')} AS value_sum, {r('sum(extra)')} AS extra_sum
  FROM (SELECT fold, selection AS ledger, CAST(horizon AS BIGINT) AS horizon, status, forward_return AS value, excess_return AS extra FROM fold_fwd
        UNION ALL SELECT fold, mode, 10, status, net_return, mfe FROM fold_trade) GROUP BY 1, 2, 3, 4""", "fold_fwd", "fold_trade")

for selection in ("events", "eligible", "non_signal"):
    SQL[f"outcomes_{selection}"] = sql(rounded(
        "timestamp, ticker, dip_component_count, split, horizon, selection, status, entry_timestamp, end_timestamp",
        "entry_price, forward_return, mfe, mae", f"FROM fwd WHERE selection = '{selection}'"), "fwd")
SQL["outcomes_excess"] = sql(rounded("timestamp, ticker, horizon, status", "forward_return, benchmark_return, excess_return",
                                     "FROM fwd WHERE selection = 'events'"), "fwd")
TRADE = "timestamp, ticker, dip_component_count, split, status, entry_timestamp, exit_timestamp, exit_reason, fill_type, holding_bars, ambiguous_bar, excursion_scope"
TRADE_NUMBERS = "entry_price, entry_fill_price, exit_price, exit_fill_price, gross_return, net_return, mfe, mae"
SQL["barrier_independent"] = sql(rounded(TRADE, TRADE_NUMBERS, "FROM trade"), "trade")
SQL["barrier_non_overlapping"] = sql(rounded(TRADE, TRADE_NUMBERS, "FROM trade_thin"), "trade_thin")
barrier_parts("trade_opt", "split_sig", f"SELECT *, 3e-1 AS stop, 5e-1 AS target, {EVENT_ID} FROM split_sig WHERE dip_event_v1", optimistic=True)
SQL["barrier_optimistic"] = sql(rounded(TRADE, TRADE_NUMBERS, "FROM trade_opt"), "trade_opt")
part("split_sig_full", "sig_full cuts", """
  SELECT s.*, CASE WHEN s.timestamp < c.validation_start THEN 'research' WHEN s.timestamp < c.test_start THEN 'validation'
         ELSE 'test' END AS split, CAST(NULL AS DATE) AS until FROM sig_full s, cuts c""")
barrier_parts("trade_col", "split_sig_full", f"SELECT *, least(atr_pct_14, 0.2) AS stop, least(atr_pct_14 * 2, 0.3) AS target, {EVENT_ID} FROM split_sig_full WHERE dip_event_v1")
SQL["barrier_columns"] = sql(rounded(TRADE, TRADE_NUMBERS + ", stop_fraction, target_fraction", "FROM trade_col"), "trade_col")
SQL["apply_costs"] = sql(rounded(KEYS, "entry_fill_price, exit_fill_price, gross_return, net_return", """
  FROM (SELECT timestamp, ticker, open * 1.0005 AS entry_fill_price, close * 0.9995 AS exit_fill_price, close / open - 1 AS gross_return,
               close * 0.9995 * 0.9999 / (open * 1.0005 * 1.0001) - 1 AS net_return FROM bars)"""), "bars")
SQL["atr_barriers"] = sql(rounded(KEYS, "stop_price, target_price, stop_fraction, target_fraction", """
  FROM (SELECT timestamp, ticker, CASE WHEN ok THEN close - d END AS stop_price, CASE WHEN ok THEN close + 3 * d END AS target_price,
               CASE WHEN ok THEN d / close END AS stop_fraction, CASE WHEN ok THEN 3 * d / close END AS target_fraction
        FROM (SELECT timestamp, ticker, close, atr_14 * 0.5 AS d, atr_14 > 0 AND close - atr_14 * 0.5 > 0 AS ok FROM sig_full WHERE dip_event_v1))"""), "sig_full")
part("evctx", "sig", "SELECT s.timestamp, s.ticker, min(b.timestamp) AS next_timestamp, CASE WHEN count(*) FILTER (b.position IS NOT NULL) = 10 THEN max(b.timestamp) END AS window_end_timestamp, "
     "CASE WHEN count(b.position) = 10 THEN greatest(max(b.high) / any_value(b.open) FILTER (b.position = s.position + 1) - 1, 0) END AS full_window_mfe, "
     "CASE WHEN count(b.position) = 10 THEN least(min(b.low) / any_value(b.open) FILTER (b.position = s.position + 1) - 1, 0) END AS full_window_mae, "
     + ", ".join(f"CASE WHEN count(b.position) = 10 THEN max(b.high) FILTER (b.position > s.position + {h}) / any_value(b.open) FILTER (b.position = s.position + 1) - 1 END AS post_mfe_{h}" for h in range(1, 10))
     + " FROM sig s LEFT JOIN sig b ON b.ticker = s.ticker AND b.position BETWEEN s.position + 1 AND s.position + 10 WHERE s.dip_event_v1 GROUP BY s.timestamp, s.ticker, s.position")
SQL["event_context"] = sql(rounded(KEYS + ", next_timestamp, window_end_timestamp",
                                   "full_window_mfe, full_window_mae, " + ", ".join(f"post_mfe_{h}" for h in range(1, 10)), "FROM evctx"), "evctx")


def path_part(name: str, source: str, group: str) -> None:
    same = " AND ".join(f"b.{g.strip()} = s.{g.strip()}" for g in group.split(","))
    keys = ", ".join(f"s.{g.strip()}" for g in group.split(","))
    hits = ", ".join(f"min(j) FILTER (h >= {p} / 100.0) AS reach_{p}pct" for p in (2, 5, 10))
    part(name, source, f"""
      SELECT {group}, timestamp, max(stamp) AS maturity, any_value(low) AS signal_low, any_value(entry / close - 1) AS entry_gap,
             CASE WHEN max(h) > 0 THEN arg_max(j, row(h, -j)) END AS time_to_mfe, greatest(max(h), 0) AS full_mfe, least(min(l), 0) AS full_mae,
             min(j) FILTER (c > 0) AS positive_close, {hits}
      FROM (SELECT {keys}, s.timestamp, s.low, s.close, b.timestamp AS stamp, b.position - s.position AS j, e.open AS entry, b.high / e.open - 1 AS h,
                   b.low / e.open - 1 AS l, b.close / e.open - 1 AS c
            FROM {source} s JOIN {source} b ON {same} AND b.position BETWEEN s.position + 1 AND s.position + 10
            JOIN {source} e ON e.ticker = s.ticker AND e.position = s.position + 1 WHERE s.dip_event_v1)
      GROUP BY {group}, timestamp HAVING count(*) = 10""")


path_part("paths", "obs", "ticker, fold")
SQL["rebound_paths"] = sql(rounded(
    "ticker, fold, timestamp, maturity, time_to_mfe, positive_close, reach_2pct, reach_5pct, reach_10pct",
    "signal_low, entry_gap, full_mfe, full_mae", "FROM paths"), "paths")


def visits(asked: str, paths: str) -> str:
    return f"""
      SELECT s.ticker, s.timestamp, count(p.timestamp) AS prior_successful_visits,
             CASE WHEN count(p.timestamp) > 0 THEN 'revisit' ELSE 'no_known_successful_zone' END AS support_group,
             min(s.timestamp - p.timestamp) AS days_since_visit
      FROM ({asked}) s LEFT JOIN {paths} p ON p.ticker = s.ticker AND p.maturity < s.timestamp AND s.timestamp - p.timestamp BETWEEN 1 AND 365
           AND p.full_mfe >= 0.05 AND abs(s.close / p.signal_low - 1) <= 0.02 GROUP BY s.ticker, s.timestamp"""


part("visited", "obs paths", visits("SELECT * FROM obs WHERE dip_event_v1", "paths"))
SQL["prior_visits"] = sql("SELECT * FROM visited", "visited")
part("known", "sig_full cuts", "SELECT * FROM sig_full WHERE timestamp <= (SELECT validation_start FROM cuts)")
path_part("known_paths", "known", "ticker")
part("known_visits", "known known_paths cuts", visits("SELECT * FROM known WHERE timestamp = (SELECT validation_start FROM cuts)", "known_paths"))
CONTEXT = ("open, high, low, close, atr_14, atr_pct_14, return_5d, return_10d, drawdown_60d, relative_volume_20d, relative_return_10d, "
           "benchmark_return_20d, benchmark_drawdown_20d, benchmark_volatility_20d")
SQL["context_as_of"] = sql(rounded("k.ticker, k.timestamp, volume, regime, prior_successful_visits, days_since_visit",
                                   CONTEXT + ", benchmark_sma200", """
  FROM (SELECT *, benchmark_sma AS benchmark_sma200 FROM known) k JOIN known_visits v ON k.ticker = v.ticker AND k.timestamp = v.timestamp"""), "known", "known_visits")

SQL["feat_callback"] = sql(rounded(KEYS, "median_close, above_median", """
  FROM (SELECT timestamp, ticker, m AS median_close, close / m - 1 AS above_median FROM (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY timestamp) >= 15
                   THEN median(close) OVER (PARTITION BY ticker ORDER BY timestamp ROWS 14 PRECEDING) END AS m FROM bars))"""), "bars")


def wide(name: str) -> str:
    """The SQL of a query with one series for each supplier."""
    narrow = "l_returnflag || l_linestatus AS ticker"
    assert SQL[name].count(narrow) == 1
    return SQL[name].replace(narrow, "'S' || l_suppkey AS ticker")


SQL |= {"bars_wide": wide("bars_lineitem"), "dip_events_wide": wide("dip_events"), "barrier_wide": wide("barrier_independent"),
        "barrier_non_overlapping_wide": wide("barrier_non_overlapping")}
