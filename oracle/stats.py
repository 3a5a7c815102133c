"""Checking SQL for summaries, robustness and diagnosis."""

from __future__ import annotations

from oracle.base import COMPONENTS, part, rounded, sql
from oracle.core import LETTERS, bin_sql

SQL: dict[str, str] = {}


def draws_part(name: str, source: str, by: str, value: str, draws: int, block: int = 20) -> None:
    """Block bootstrap drawn date by date; ``source`` holds completed rows only."""
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    part(f"{name}_cl", source, f"""
      SELECT {by}, s, n, row_number() OVER (PARTITION BY {by} ORDER BY timestamp) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS c
      FROM (SELECT {by}, timestamp, sum({value}) AS s, count({value}) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL)""")
    part(f"{name}_pl", f"{name}_cl", f"""
      SELECT {by}, c, h.draw, k.k // {block} AS blk, k.k % {block} AS off, h.hash % c AS start
      FROM (SELECT DISTINCT {by}, c FROM {name}_cl WHERE c >= {2 * block}) g JOIN range(20000) k(k) ON k.k < c
      JOIN (SELECT draw, blk, ('0x' || substr(md5('42:' || draw || ':' || blk), 1, 8))::BIGINT AS hash FROM range({draws}) d(draw), range({20000 // block}) b(blk)) h
        ON h.blk = k.k // {block} AND h.blk <= (SELECT max(c) FROM {name}_cl) // {block}""")
    part(name, f"{name}_pl {name}_cl", f"""
      SELECT {by}, stddev_samp(m) AS standard_error, quantile_cont(m, {(1 - 0.95) / 2!r}) AS ci_lower, quantile_cont(m, {(1 + 0.95) / 2!r}) AS ci_upper
      FROM (SELECT {', '.join('a.' + k for k in keys)}, a.draw, sum(b.s) / sum(b.n) AS m FROM {name}_pl a JOIN {name}_cl b
            ON {same} AND b.i = (a.start + a.off) % a.c GROUP BY ALL) GROUP BY {by}""")


BOOT = "standard_error, ci_lower, ci_upper"
PF = "CASE WHEN sum(CASE WHEN {x} < 0 THEN -{x} END) > 0 THEN coalesce(sum(CASE WHEN {x} > 0 THEN {x} END), 0) / sum(CASE WHEN {x} < 0 THEN -{x} END) END"

part("ev", "fwd", "SELECT *, forward_return AS x FROM fwd WHERE selection = 'events'")
part("ev10", "ev", "SELECT * FROM ev WHERE horizon = 10")
draws_part("boot10", "ev10", "split", "x", 2000)
SQL["return_summary"] = sql(rounded("a.split, count, missing_count, cluster_count", f"mean, median, std, win_rate, expectancy, profit_factor, {BOOT}", f"""
  FROM (SELECT split, count(x) AS count, count(*) - count(x) AS missing_count, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std,
               avg(CASE WHEN x IS NOT NULL THEN CAST(x > 0 AS INT) END) AS win_rate, avg(x) AS expectancy, {PF.format(x='x')} AS profit_factor,
               count(DISTINCT CASE WHEN x IS NOT NULL THEN timestamp END) AS cluster_count FROM ev10 GROUP BY split) a
  LEFT JOIN boot10 b ON a.split = b.split"""), "ev10", "boot10")
draws_part("booth", "ev", "horizon", "x", 2000)
SQL["bootstrap_ci"] = sql(rounded("horizon", BOOT, "FROM booth"), "booth")

OUTCOME_COUNTS = "observations, excluded, count, cluster_count, benchmark_count"
OUTCOME_NUMBERS = "mean, std, win_rate, profit_factor, average_mfe, average_mae, paired_stock_mean, benchmark_mean, mean_excess_return, median"


def outcome_summary(source: str, by: str) -> str:
    return f"""
      SELECT {by}, count(*) AS observations, count(*) FILTER (status <> 'completed') AS excluded, count(forward_return) AS count,
             avg(forward_return) AS mean, stddev_samp(forward_return) AS std,
             avg(CASE WHEN forward_return IS NOT NULL THEN CAST(forward_return > 0 AS INT) END) AS win_rate, {PF.format(x='forward_return')} AS profit_factor,
             count(DISTINCT CASE WHEN forward_return IS NOT NULL THEN timestamp END) AS cluster_count, avg(mfe) AS average_mfe, avg(mae) AS average_mae,
             count(benchmark_return) AS benchmark_count, avg(CASE WHEN benchmark_return IS NOT NULL THEN forward_return END) AS paired_stock_mean,
             avg(benchmark_return) AS benchmark_mean, avg(forward_return - benchmark_return) AS mean_excess_return, median(forward_return) AS median
      FROM {source} GROUP BY ALL"""


part("ev_sum", "ev", outcome_summary("ev", "split, horizon"))
draws_part("boot_sh", "ev", "split, horizon", "x", 2000)
SQL["outcome_summary"] = sql(rounded("a.split, a.horizon, " + OUTCOME_COUNTS, f"{OUTCOME_NUMBERS}, {BOOT}",
                                     "FROM ev_sum a LEFT JOIN boot_sh b ON a.split = b.split AND a.horizon = b.horizon"), "ev_sum", "boot_sh")
SQL["risk_adjusted"] = sql(rounded("ticker, periods", "sharpe, sortino", """
  FROM (SELECT ticker, count(*) AS periods, avg(return_1d) / stddev_samp(return_1d) * sqrt(252) AS sharpe,
               avg(return_1d) / sqrt(avg(pow(least(return_1d, 0), 2))) * sqrt(252) AS sortino FROM plainfeat WHERE return_1d IS NOT NULL GROUP BY 1)"""), "plainfeat")
part("seq_ord", "fold_thin", "SELECT ticker, net_return, row_number() OVER (PARTITION BY ticker ORDER BY timestamp) AS n FROM fold_thin WHERE status = 'completed'")
part("rec_seq", "seq_ord", """
  SELECT ticker, n, 1 + net_return AS w, greatest(1, 1 + net_return) AS p, least(0, (1 + net_return) / greatest(1, 1 + net_return) - 1) AS d FROM seq_ord WHERE n = 1
  UNION ALL SELECT r.ticker, o.n, r.w * (1 + o.net_return), greatest(r.p, r.w * (1 + o.net_return)),
         least(r.d, r.w * (1 + o.net_return) / greatest(r.p, r.w * (1 + o.net_return)) - 1) FROM rec_seq r JOIN seq_ord o ON o.ticker = r.ticker AND o.n = r.n + 1""")
SQL["sequential_metrics"] = sql(rounded("ticker", "cumulative_return, maximum_drawdown", """
  FROM (SELECT ticker, arg_max(w, n) - 1 AS cumulative_return, min(d) AS maximum_drawdown FROM rec_seq GROUP BY 1)"""), "rec_seq")

TRADE_COUNTS = "candidate_count, trade_count, excluded_count"
TRADE_NUMBERS = ("win_rate, win_probability, loss_probability, average_win, average_loss, average_return, median_return, std, expectancy, expected_value, "
                 "break_even_win_rate, average_gross_return, average_mfe, average_mae, average_holding_bars, take_profit_rate, stop_loss_rate, "
                 "time_exit_rate, profit_factor")


def trade_summary(source: str, by: str, extra: str = "") -> str:
    x = "net_return"
    rate = lambda e: f"avg(CASE WHEN {x} IS NOT NULL THEN CAST({e} AS INT) END)"
    win, loss = f"avg(CASE WHEN {x} > 0 THEN {x} END)", f"avg(CASE WHEN {x} < 0 THEN {x} END)"
    return f"""
      SELECT {by}, count(*) AS candidate_count, count({x}) AS trade_count, count(*) - count({x}) AS excluded_count, {rate(x + ' > 0')} AS win_rate,
             {rate(x + ' > 0')} AS win_probability, {rate(x + ' < 0')} AS loss_probability, {win} AS average_win, {loss} AS average_loss,
             avg({x}) AS average_return, median({x}) AS median_return, stddev_samp({x}) AS std, avg({x}) AS expectancy, avg({x}) AS expected_value,
             abs({loss}) / ({win} + abs({loss})) AS break_even_win_rate, avg(gross_return) AS average_gross_return, avg(mfe) AS average_mfe,
             avg(mae) AS average_mae, avg(holding_bars) AS average_holding_bars, {rate("exit_reason = 'take_profit'")} AS take_profit_rate,
             {rate("exit_reason = 'stop_loss'")} AS stop_loss_rate, {rate("exit_reason = 'time_exit'")} AS time_exit_rate, {PF.format(x=x)} AS profit_factor{extra}
      FROM {source} GROUP BY ALL"""


STATUSES = "overlap, no_next_bar, incomplete_window, split_boundary"
GROUP_EXTRA = ", " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in STATUSES.split(", ")) + ", count(*) FILTER (ambiguous_bar) AS ambiguous_exits"
SQL["trade_metrics"] = sql(rounded("mode, " + TRADE_COUNTS, TRADE_NUMBERS, f"FROM ({trade_summary('fold_trade', 'mode')})"), "fold_trade")
SQL["trade_groups"] = sql(rounded(f"mode, regime, {TRADE_COUNTS}, {STATUSES}, ambiguous_exits", TRADE_NUMBERS,
                                  f"FROM ({trade_summary('fold_trade', 'mode, regime', GROUP_EXTRA)})"), "fold_trade")
def ledger_checks(source: str) -> str:
    return f"""
  SELECT mode, count(*) AS rows, count(*) FILTER (status = 'completed') AS completed,
         count(*) FILTER (status = 'completed' AND (net_return IS NULL OR gross_return IS NULL OR mfe IS NULL OR mae IS NULL OR holding_bars IS NULL)) AS missing,
         count(*) FILTER (status = 'completed' AND NOT (isfinite(net_return) AND isfinite(gross_return) AND coalesce(isfinite(mfe), true) AND isfinite(mae))) AS not_finite,
         count(*) FILTER (status NOT IN ('completed', 'overlap', 'no_next_bar', 'incomplete_window', 'split_boundary')) AS unknown_status,
         count(*) FILTER (status = 'completed' AND exit_reason NOT IN ('take_profit', 'stop_loss', 'time_exit')) AS unknown_reason,
         count(*) FILTER (status = 'completed' AND (net_return <= -1 OR gross_return <= -1 OR mfe < 0 OR mae > 0 OR holding_bars < 1)) AS bad_values,
         count(*) FILTER (status = 'completed' AND holding_bars <> floor(holding_bars)) AS broken_bars,
         count(*) FILTER (status = 'completed' AND exit_timestamp < entry_timestamp) AS exit_before_entry,
         count(*) FILTER (status <> 'completed' AND net_return IS NOT NULL) AS measured_exclusions FROM {source} GROUP BY 1"""


def spoilt(name: str, each: int, value: str) -> str:
    return f"CASE WHEN position % {each} = 0 THEN {value} ELSE {name} END AS {name}"


part("spoilt_trade", "fold_trade", f"""
  SELECT * REPLACE ({spoilt('status', 7, "'lost'")}, {spoilt('net_return', 5, "'inf'::DOUBLE")}, {spoilt('gross_return', 11, '-1.5')},
                    {spoilt('mfe', 13, 'NULL')}, {spoilt('mae', 17, '0.25')}, {spoilt('holding_bars', 3, 'holding_bars + 0.5')},
                    {spoilt('exit_reason', 19, "'unknown'")}, {spoilt('exit_timestamp', 23, 'entry_timestamp - INTERVAL 1 DAY')}) FROM fold_trade""")
SQL["ledger_checks"] = sql(ledger_checks("fold_trade"), "fold_trade")
SQL["ledger_checks_faulty"] = sql(ledger_checks("spoilt_trade"), "spoilt_trade")

RATES = ("CASE WHEN ready > 0 THEN conditions / ready END AS condition_fraction_ready, CASE WHEN eligible > 0 THEN conditions / eligible END AS condition_fraction_eligible, "
         "CASE WHEN ready > 0 THEN 252 * events / ready END AS events_per_252_ready")
RATE_NAMES = "condition_fraction_ready, condition_fraction_eligible, events_per_252_ready"
part("freq", "obs requested folds", f"""
  SELECT *, {RATES} FROM (
    SELECT f.fold, r.ticker, min(o.timestamp) AS first_date, max(o.timestamp) AS last_date, count(o.timestamp) AS observed,
           count(*) FILTER (o.member) AS eligible, count(*) FILTER (o.member AND o.dip_ready_v1) AS ready,
           count(*) FILTER (o.member AND o.dip_condition_v1) AS conditions, count(*) FILTER (o.member AND o.dip_event_v1) AS events
    FROM requested r CROSS JOIN folds f LEFT JOIN obs o ON o.fold = f.fold AND o.ticker = r.ticker GROUP BY 1, 2)""")
SQL["frequency"] = sql(rounded("fold, ticker, first_date, last_date, observed, eligible, ready, conditions, events", RATE_NAMES, "FROM freq"), "freq")
SQL["frequency_fold"] = sql(rounded("fold, observed, eligible, ready, conditions, events", RATE_NAMES, f"""
  FROM (SELECT *, {RATES} FROM (SELECT fold, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('observed', 'eligible', 'ready', 'conditions', 'events'))}
        FROM freq GROUP BY 1))"""), "freq")
SQL["exclusions"] = sql("""
  SELECT ticker, fold, 'no_ready_oos_observations' AS reason FROM freq WHERE ready = 0
  UNION ALL SELECT ticker, 'all', 'insufficient_history' FROM freq WHERE ticker IN (SELECT ticker FROM bars) GROUP BY 1 HAVING sum(ready) = 0""", "freq", "bars")

SETS = {"fold_summary": "fold, horizon", "oos_summary": "horizon", "ticker_summary": "ticker, horizon", "regime_summary": "regime, horizon",
        "fold_regime_summary": "fold, regime, horizon", "component_summary": "fold, dip_component_count, horizon",
        "component_oos_summary": "dip_component_count, horizon"}
part("oset", "fold_fwd", " UNION ALL BY NAME ".join(
    f"SELECT '{name}' AS grouping, * FROM ({outcome_summary('(SELECT * FROM fold_fwd' + (chr(32) + 'WHERE horizon = 10 AND selection = ' + chr(39) + 'events' + chr(39) if name.startswith('component') else '') + ')', 'selection, ' + by)})"
    for name, by in SETS.items()))
SET_KEYS = "grouping, selection, fold, ticker, regime, dip_component_count, horizon"
part("oset_rows", "fold_fwd", " UNION ALL BY NAME ".join(
    f"SELECT '{name}' AS grouping, selection, {by}, timestamp, forward_return AS x FROM fold_fwd WHERE status = 'completed'"
    + (" AND horizon = 10 AND selection = 'events'" if name.startswith("component") else "") for name, by in SETS.items()))
draws_part("boot_oset", "oset_rows", SET_KEYS, "x", 2000)
SQL["robustness_sets"] = sql(rounded(", ".join(f"a.{k}" for k in SET_KEYS.split(", ")) + ", " + OUTCOME_COUNTS, f"{OUTCOME_NUMBERS}, {BOOT}",
                                     "FROM oset a LEFT JOIN boot_oset b ON " + " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in SET_KEYS.split(", "))),
                             "oset", "boot_oset")
TSETS = {"trade_fold_summary": "mode, fold", "trade_oos_summary": "mode", "trade_ticker_summary": "mode, ticker", "trade_regime_summary": "mode, regime",
         "trade_fold_regime_summary": "mode, fold, regime"}
part("tset", "fold_trade", " UNION ALL BY NAME ".join(
    f"SELECT '{name}' AS grouping, * FROM ({trade_summary('fold_trade', by, GROUP_EXTRA)})" for name, by in TSETS.items()))
SQL["robustness_trades"] = sql(rounded(f"grouping, mode, fold, ticker, regime, {TRADE_COUNTS}, {STATUSES}, ambiguous_exits", TRADE_NUMBERS, "FROM tset"), "tset")

part("per_ticker", "oset tset freq", """
  SELECT 'event' AS kind, CAST(horizon AS BIGINT) AS horizon, ticker, 'mean' AS metric, mean AS value FROM oset WHERE grouping = 'ticker_summary' AND selection = 'events'
  UNION ALL SELECT 'event', horizon, ticker, 'mean_excess_return', mean_excess_return FROM oset WHERE grouping = 'ticker_summary' AND selection = 'events'
  UNION ALL SELECT 'trade', 10, ticker, 'net_expectancy', average_return FROM tset WHERE grouping = 'trade_ticker_summary' AND mode = 'non_overlapping'
  UNION ALL SELECT 'frequency', 0, ticker, 'total_events', CAST(sum(events) AS DOUBLE) FROM freq GROUP BY ticker""")
SQL["distribution"] = sql(rounded(
    "kind, horizon, metric, requested_count, defined_count, undefined_count, positive_count, negative_count, zero_count",
    "positive_fraction_defined, equal_ticker_mean, median, q25, q75, iqr, minimum, maximum", """
  FROM (SELECT kind, horizon, metric, (SELECT count(*) FROM requested) AS requested_count, count(value) AS defined_count,
               (SELECT count(*) FROM requested) - count(value) AS undefined_count, count(*) FILTER (value > 0) AS positive_count,
               count(*) FILTER (value < 0) AS negative_count, count(*) FILTER (value = 0) AS zero_count,
               avg(CASE WHEN value IS NOT NULL THEN CAST(value > 0 AS INT) END) AS positive_fraction_defined, avg(value) AS equal_ticker_mean,
               median(value) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75,
               quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS minimum, max(value) AS maximum
        FROM per_ticker GROUP BY 1, 2, 3)"""), "per_ticker", "requested")
part("contrib", "fold_trade fold_fwd", """
  SELECT 'net_trades' AS source, ticker, net_return AS v FROM fold_trade WHERE mode = 'non_overlapping' AND status = 'completed'
  UNION ALL SELECT 'event_excess_10', ticker, excess_return FROM fold_fwd WHERE selection = 'events' AND horizon = 10 AND status = 'completed'""")
part("conc", "contrib requested", """
  SELECT *, CASE WHEN count > 0 THEN return_sum / count END AS mean,
         CASE WHEN sum(greatest(return_sum, 0)) OVER w > 0 THEN greatest(return_sum, 0) / sum(greatest(return_sum, 0)) OVER w END AS positive_share,
         CASE WHEN sum(abs(return_sum)) OVER w > 0 THEN abs(return_sum) / sum(abs(return_sum)) OVER w END AS absolute_share
  FROM (SELECT s.source, r.ticker, count(c.v) AS count, coalesce(sum(c.v), 0.0) AS return_sum FROM requested r
        CROSS JOIN (VALUES ('net_trades'), ('event_excess_10')) s(source) LEFT JOIN contrib c ON c.source = s.source AND c.ticker = r.ticker GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY source)""")
SQL["concentration"] = sql(rounded("source, ticker, count", "return_sum, mean, positive_share, absolute_share", "FROM conc"), "conc")
SQL["concentration_top5"] = sql(rounded("source, top_positive_tickers", "total_sum, positive_sum, negative_sum, absolute_sum, top_positive_share, top_absolute_share", """
  FROM (SELECT source, sum(return_sum) AS total_sum, sum(greatest(return_sum, 0)) AS positive_sum, sum(least(return_sum, 0)) AS negative_sum,
               sum(abs(return_sum)) AS absolute_sum, coalesce(string_agg(ticker, ',' ORDER BY return_sum DESC, ticker) FILTER (g <= 5 AND return_sum > 0), '') AS top_positive_tickers,
               CASE WHEN sum(greatest(return_sum, 0)) > 0 THEN sum(return_sum) FILTER (g <= 5 AND return_sum > 0) / sum(greatest(return_sum, 0)) END AS top_positive_share,
               CASE WHEN sum(abs(return_sum)) > 0 THEN sum(abs(return_sum)) FILTER (a <= 5) / sum(abs(return_sum)) END AS top_absolute_share
        FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY return_sum DESC, ticker) AS g,
                     row_number() OVER (PARTITION BY source ORDER BY abs(return_sum) DESC, ticker) AS a FROM conc) GROUP BY 1)"""), "conc")
part("bdist", "trade_col", " UNION ALL ".join(
    f"SELECT {t} AS ticker, '{c}' AS measure, {c} AS x FROM trade_col WHERE status = 'completed'"
    for c in ("stop_fraction", "target_fraction") for t in ("'ALL'", "ticker")))
SPREAD = ("count(x) AS count, avg(x) AS mean, median(x) AS median, min(x) AS minimum, max(x) AS maximum, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75")
SQL["barrier_distribution"] = sql(rounded("ticker, measure, count", "mean, median, minimum, maximum, q25, q75",
                                          f"FROM (SELECT ticker, measure, {SPREAD} FROM bdist GROUP BY 1, 2)"), "bdist")

# Diagnosis
EDGES = {"return_5d": (-0.05, 0.0), "atr_pct_14": (0.02, 0.04), "relative_volume_20d": (1.0, 2.0), "relative_return_10d": (-0.05, 0.0),
         "drawdown_change_5": (-0.05, 0.0), "benchmark_return_20d": (-0.05, 0.0), "benchmark_drawdown_20d": (-0.10, -0.05),
         "benchmark_volatility_20d": (0.15, 0.25), "entry_gap": (-0.01, 0.01)}
part("diag", "fold_fwd obs_full paths visited", f"""
  SELECT e.*, {', '.join('o.' + c for c in COMPONENTS)}, {LETTERS.replace('dip_', 'o.dip_')} AS combination,
         {', '.join('o.' + c for c in EDGES if c not in ('entry_gap', 'drawdown_change_5'))}, o.volatility_20d, o.drawdown_change_5, p.entry_gap, v.support_group
  FROM fold_fwd e LEFT JOIN (SELECT *, drawdown_60d - lag(drawdown_60d, 5) OVER (PARTITION BY ticker ORDER BY timestamp) AS drawdown_change_5 FROM obs_full) o
    ON e.ticker = o.ticker AND e.timestamp = o.timestamp
  LEFT JOIN paths p ON e.ticker = p.ticker AND e.timestamp = p.timestamp LEFT JOIN visited v ON e.ticker = v.ticker AND e.timestamp = v.timestamp
  WHERE e.selection = 'events'""")
_labels = [("all_events", "'all'")] + [(c, f"coalesce(CAST({c} AS VARCHAR), 'nan')") for c in ("combination", "dip_component_count", "regime", "support_group")]
_labels += [("component_presence", f"'{x} ' || CASE WHEN {c} THEN 'active' ELSE 'inactive' END") for x, c in zip("ABCD", COMPONENTS)]
_labels += [(c, bin_sql(c, *e)) for c, e in EDGES.items()]
part("labelled", "diag", " UNION ALL ".join(f"SELECT '{a}' AS analysis, {g} AS \"group\", * FROM diag" for a, g in _labels))
_grid = [(c, g) for c in EDGES for g in ("low", "middle", "high", "unknown")] + [("component_presence", f"{x} {s}") for x in "ABCD" for s in ("active", "inactive")]
DESCRIBE = ("count(status) AS events, count(*) FILTER (status = 'completed') AS completed, avg(forward_return) AS mean, median(forward_return) AS median, "
            "avg(CASE WHEN forward_return IS NOT NULL THEN CAST(forward_return > 0 AS INT) END) AS win_rate, avg(mfe) AS mfe, avg(mae) AS mae, "
            "avg(benchmark_return) AS matched_index, avg(excess_return) AS excess, count(excess_return) AS paired_count")
DESCRIBED = "mean, median, win_rate, mfe, mae, matched_index, excess"
part("slots", "labelled", "SELECT DISTINCT horizon, analysis, \"group\" FROM labelled UNION SELECT DISTINCT horizon, g.a, g.g FROM diag, (VALUES "
     + ", ".join(f"('{a}', '{g}')" for a, g in _grid) + ") g(a, g)")
SQL["diag_groups"] = sql(rounded('horizon, analysis, "group", events, completed, paired_count', DESCRIBED, f"""
  FROM (SELECT s.horizon, s.analysis, s."group", {DESCRIBE} FROM slots s LEFT JOIN labelled l
        ON l.horizon = s.horizon AND l.analysis = s.analysis AND l."group" = s."group" GROUP BY 1, 2, 3)"""), "slots", "labelled")
part("timing", "paths", " UNION ALL ".join(
    f"SELECT {g} AS \"group\", '{m}' AS metric, {m} AS bars FROM paths" for m in ("positive_close", "time_to_mfe", "reach_2pct", "reach_5pct", "reach_10pct")
    for g in ("'all'", "fold")))
SQL["rebound_timing"] = sql(rounded('"group", metric, complete_paths, reached', "fraction, median_bars_if_reached, mean_bars_if_reached", """
  FROM (SELECT "group", metric, count(*) AS complete_paths, count(bars) AS reached, count(bars) / count(*) AS fraction, median(bars) AS median_bars_if_reached,
               avg(bars) AS mean_bars_if_reached FROM timing GROUP BY 1, 2)"""), "timing")
PROFILE = ("atr_pct_14", "relative_volume_20d", "relative_return_10d", "volatility_20d")
part("profile", "diag obs_full", f"""
  SELECT a.*, b.* EXCLUDE (ticker) FROM (SELECT ticker, {DESCRIBE} FROM diag WHERE horizon = 10 GROUP BY 1) a LEFT JOIN
    (SELECT ticker, CASE WHEN count(*) FILTER (dip_ready_v1) > 0 THEN count(*) FILTER (dip_event_v1) / count(*) FILTER (dip_ready_v1) * 252 END AS events_per_252,
            {', '.join(f'avg({c}) FILTER (dip_event_v1) AS {c}' for c in PROFILE)} FROM obs_full GROUP BY 1) b ON a.ticker = b.ticker""")
SQL["ticker_profile"] = sql(rounded("ticker, events, completed, paired_count", DESCRIBED + ", events_per_252, " + ", ".join(PROFILE), "FROM profile"), "profile")
part("corrs", "profile", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS outcome, {a} AS x, {b} AS y FROM profile" for a in (*PROFILE, "events_per_252") for b in ("mean", "excess")))
SQL["spearman"] = sql(rounded("feature, outcome, tickers", "spearman", """
  FROM (SELECT feature, outcome, count(*) AS tickers, CASE WHEN count(*) > 2 THEN corr(rx, ry) END AS spearman FROM (
          SELECT feature, outcome, rank() OVER (PARTITION BY feature, outcome ORDER BY x) + (count(*) OVER (PARTITION BY feature, outcome, x) - 1) / 2 AS rx,
                 rank() OVER (PARTITION BY feature, outcome ORDER BY y) + (count(*) OVER (PARTITION BY feature, outcome, y) - 1) / 2 AS ry
          FROM corrs WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY 1, 2)"""), "corrs")
COHORT = "return_5d, drawdown_change_5, atr_pct_14, relative_volume_20d, relative_return_10d, entry_gap"
SQL["cohort_means"] = sql(rounded('"group", completed', COHORT, f"""
  FROM (SELECT CASE WHEN forward_return > 0 THEN 'positive_gross' ELSE 'nonpositive_gross' END AS "group", count(*) AS completed,
               {', '.join(f'avg({c}) AS {c}' for c in COHORT.split(', '))} FROM diag WHERE horizon = 10 AND status = 'completed' GROUP BY 1)"""), "diag")

# Report tables
SQL["status_counts"] = sql("SELECT selection, fold, horizon, status, count(*) AS count FROM fold_fwd GROUP BY ALL", "fold_fwd")
SQL["histogram"] = sql(rounded("metric, bin, count", "lower, upper", """
  FROM (SELECT l.metric, g.bin, lo + (hi - lo) / 12 * g.bin AS lower, lo + (hi - lo) / 12 * (g.bin + 1) AS upper,
               count(p.value) AS count
        FROM (SELECT metric, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
                     CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi FROM per_ticker WHERE horizon = 10 GROUP BY 1) l
        CROSS JOIN (SELECT range AS bin FROM range(12)) g
        LEFT JOIN per_ticker p ON p.metric = l.metric AND p.horizon = 10 AND least(floor((p.value - lo) / ((hi - lo) / 12)), 11) = g.bin GROUP BY 1, 2, 3, 4)"""), "per_ticker")
SQL["exit_counts"] = sql("SELECT mode, exit_reason, count(*) AS count FROM fold_trade WHERE status = 'completed' GROUP BY 1, 2", "fold_trade")


def compare(by: str, grouping: str) -> str:
    pick = lambda s, c: f"max({c}) FILTER (selection = '{s}')"
    return f"""SELECT {by}, {pick('events', 'count')} AS count, {pick('events', 'mean')} AS mean, {pick('eligible', 'mean')} AS unconditional,
      {pick('non_signal', 'mean')} AS non_signal, {pick('events', 'mean')} - {pick('eligible', 'mean')} AS difference_unconditional,
      {pick('events', 'mean')} - {pick('non_signal', 'mean')} AS difference_non_signal, {pick('events', 'mean_excess_return')} AS difference_index
      FROM oset WHERE grouping = '{grouping}' GROUP BY {by}"""


COMPARED = "mean, unconditional, non_signal, difference_unconditional, difference_non_signal, difference_index"
SQL["baseline_comparison"] = sql(rounded("horizon, count", COMPARED, f"FROM ({compare('horizon', 'oos_summary')})"), "oset")
SQL["regime_vs_control"] = sql(rounded("regime, horizon, count", COMPARED, f"FROM ({compare('regime, horizon', 'regime_summary')})"), "oset")
SQL["criteria"] = sql(f"""
  SELECT e.*, e.positive_excess_tickers > e.defined_tickers / 2 AS breadth_passed, f.*, CAST(0.5 AS DOUBLE) AS concentration_threshold
  FROM (SELECT count(*) FILTER (value > 0) AS positive_excess_tickers, count(value) AS defined_tickers FROM per_ticker WHERE horizon = 10 AND metric = 'mean_excess_return') e,
       (SELECT count(*) FILTER (mean > unconditional AND difference_index > 0) AS favorable_folds, count(*) AS fold_count
        FROM ({compare('fold, horizon', 'fold_summary')}) WHERE horizon = 10) f""", "per_ticker", "oset")
part("exposure", "freq", """
  SELECT 'events_per_ticker' AS measure, CAST(sum(events) AS DOUBLE) AS x FROM freq GROUP BY ticker HAVING sum(ready) > 0
  UNION ALL SELECT 'events_per_252_ready', events_per_252_ready FROM freq WHERE ready > 0""")
SQL["exposure_quantiles"] = sql(rounded("measure, count", "median, q25, q75, minimum, maximum", f"FROM (SELECT measure, {SPREAD} FROM exposure GROUP BY 1)"), "exposure")
SQL["extremes"] = sql(rounded("ticker, trade_count", "average_return, median_return, win_rate, profit_factor", """
  FROM (SELECT *, row_number() OVER (ORDER BY average_return, ticker) AS a, row_number() OVER (ORDER BY average_return DESC, ticker) AS b
        FROM tset WHERE grouping = 'trade_ticker_summary' AND mode = 'independent' AND average_return IS NOT NULL) WHERE a <= 5 OR b <= 5"""), "tset")
SQL["ranked_page"] = sql(rounded("mode, timestamp, ticker, status", "net_return",
                                 "FROM (SELECT * FROM fold_trade ORDER BY net_return DESC NULLS LAST, mode, timestamp, ticker LIMIT 25 OFFSET 25)"), "fold_trade")
SQL["table_diff"] = sql("""
  SELECT timestamp, ticker, dip_component_count, 'detected_only' AS side FROM (SELECT timestamp, ticker, dip_component_count FROM sig WHERE dip_event_v1
    EXCEPT ALL SELECT DISTINCT timestamp, ticker, dip_component_count FROM fold_fwd WHERE selection = 'events')
  UNION ALL SELECT timestamp, ticker, dip_component_count, 'used_only' FROM (SELECT DISTINCT timestamp, ticker, dip_component_count FROM fold_fwd WHERE selection = 'events'
    EXCEPT ALL SELECT timestamp, ticker, dip_component_count FROM sig WHERE dip_event_v1)""", "sig", "fold_fwd")
