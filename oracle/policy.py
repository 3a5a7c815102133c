"""Checking SQL for exit-policy research."""

from __future__ import annotations

from oracle.base import barrier_parts, part, rounded, sql, thin_parts
from oracle.stats import BOOT, PF, SPREAD, draws_part, trade_summary
from tidemark import fixed

SQL: dict[str, str] = {}


def grid() -> list[tuple]:
    """The catalogue by itself, as rows of literals; only the axes come from outside."""
    def number(v) -> str:
        return f"CAST('{float(v)!r}' AS DOUBLE)"
    stops, targets = (sorted({pair[i] for pair in fixed.FIXED_PAIRS}) for i in (0, 1))
    rows = [(f"'fixed_s{s:02d}_t{t:02d}'", "'fixed'", number(s / 100), number(t / 100), "NULL", "NULL", "NULL", stops.index(s), targets.index(t))
            for s, t in fixed.FIXED_PAIRS]
    for x, s in enumerate(fixed.STOP_MULTIPLIERS):
        rows += [(f"'atr_s{s}_t{t}'", "'atr'", "NULL", "NULL", number(s), number(t), "NULL", x, y) for y, t in enumerate(fixed.TARGET_MULTIPLIERS)]
        rows += [(f"'r_s{s}_r{r}'", "'r_multiple'", "NULL", "NULL", number(s), "NULL", number(r), x, y) for y, r in enumerate(fixed.REWARD_RISK_RATIOS)]
    stop, target = number(fixed.STOP_LOSS), number(fixed.TAKE_PROFIT)
    for name, s, t in (("v1_control", stop, target), ("target_only", "NULL", target), ("stop_only", stop, "NULL"), ("time_only", "NULL", "NULL")):
        rows.append((f"'{name}'", "'control'", s, t, "NULL", "NULL", "NULL", "NULL", "NULL"))
    return rows


part("cat", "", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(str, row)) + ")" for row in grid())
     + ") c(candidate_id, family, c_stop, c_target, stop_multiplier, target_multiplier, reward_risk, x, y)")
part("event_full", "sig_full", "SELECT * FROM sig_full WHERE dip_event_v1")
part("frac", "event_full cat", """
  SELECT *, CASE WHEN family IN ('fixed', 'control') THEN c_stop ELSE sf END AS stop,
         CASE WHEN family IN ('fixed', 'control') THEN c_target
              ELSE least(greatest(CASE WHEN family = 'atr' THEN atr_pct_14 * target_multiplier ELSE sf * reward_risk END, 1e-2), 3e-1) END AS target,
         candidate_id || ':' || ticker || ':' || position AS eid, 'all' AS split, CAST(NULL AS DATE) AS until
  FROM (SELECT *, least(greatest(atr_pct_14 * stop_multiplier, 1e-2), 2e-1) AS sf FROM event_full CROSS JOIN cat)""")
SQL["catalog"] = sql(rounded("candidate_id, family, events", "stop, target, stop_multiplier, target_multiplier, reward_risk, mean_stop, mean_target", """
  FROM (SELECT candidate_id, family, c_stop AS stop, c_target AS target, stop_multiplier, target_multiplier, reward_risk, count(*) AS events,
               avg(frac.stop) AS mean_stop, avg(frac.target) AS mean_target FROM frac GROUP BY ALL)"""), "frac")
SQL["candidate_fractions"] = sql(rounded("timestamp, ticker, candidate_id", "stop_fraction, target_fraction",
                                         "FROM (SELECT *, stop AS stop_fraction, target AS target_fraction FROM frac)"), "frac")
part("price_rows", "sig_full", "SELECT ticker, position, timestamp, open, high, low, close, 'all' AS split FROM sig_full")
barrier_parts("cled", "price_rows", "SELECT timestamp, ticker, position, split, until, candidate_id, family, dip_component_count, stop, target, eid FROM frac", needs="frac")
SQL["candidate_ledger"] = sql(rounded("timestamp, ticker, candidate_id, status, exit_timestamp, exit_reason, holding_bars", "net_return, mfe, mae", "FROM cled"), "cled")
NUMBERS = ("entry_price", "entry_fill_price", "exit_price", "exit_fill_price", "gross_return", "net_return", "mfe", "mae")
BLANK = ("entry_timestamp", "exit_timestamp", "exit_reason", "fill_type", "holding_bars", "excursion_scope") + NUMBERS
part("train", "cled folds", f"""
  SELECT fold, candidate_id, family, ticker, timestamp, position, stop_fraction, target_fraction, status, ambiguous_bar AND status = 'completed' AS ambiguous_bar,
         {', '.join(f"CASE WHEN status = 'completed' THEN {c} END AS {c}" for c in BLANK)}
  FROM (SELECT c.* EXCLUDE (status), f.fold, CASE WHEN next_timestamp IS NULL OR next_timestamp > f.history_end THEN 'no_next_bar'
               WHEN window_end_timestamp IS NULL OR window_end_timestamp > f.history_end THEN 'incomplete_window' ELSE c.status END AS status
        FROM cled c JOIN folds f ON c.timestamp BETWEEN f.history_start AND f.history_end)""")
SQL["boundary_view"] = sql(rounded("fold, candidate_id, status, rows", "net_sum",
                                   "FROM (SELECT fold, candidate_id, status, count(*) AS rows, sum(net_return) AS net_sum FROM train GROUP BY 1, 2, 3)"), "train")


def metrics_parts(name: str, source: str, by: str) -> None:
    keys = by if "ticker" in by else by + ", ticker"
    thin_parts(f"{name}_thin", source, keys)
    ks = [k.strip() for k in keys.split(",")]
    part(f"{name}_seq", f"{name}_thin", f"SELECT {keys}, net_return, row_number() OVER (PARTITION BY {keys} ORDER BY timestamp) AS n FROM {name}_thin WHERE status = 'completed'")
    part(f"{name}_w", f"{name}_seq", f"SELECT *, product(1 + net_return) OVER (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING) AS w FROM {name}_seq")
    part(f"{name}_dd", f"{name}_w", f"""
      SELECT {by}, min(d) AS worst_ticker_trade_close_drawdown, median(d) AS median_ticker_trade_close_drawdown
      FROM (SELECT {keys}, least(min(w / p - 1), 0) AS d FROM (
              SELECT *, greatest(max(w) OVER (PARTITION BY {keys} ORDER BY n ROWS UNBOUNDED PRECEDING), 1) AS p FROM {name}_w) GROUP BY {keys}) GROUP BY {by}""")
    r = "(net_return / CASE WHEN stop_fraction > 0 THEN stop_fraction END)"
    extra = ", " + ", ".join(f"count(*) FILTER (exit_reason = '{c}') AS {c}_count" for c in ("take_profit", "stop_loss", "time_exit")) + f""",
      count({r}) AS r_count, avg({r}) AS expectancy_r, median({r}) AS median_r, avg(CASE WHEN {r} > 0 THEN {r} END) AS average_winning_r,
      avg(CASE WHEN {r} < 0 THEN {r} END) AS average_losing_r, avg(CASE WHEN {r} IS NOT NULL THEN CAST({r} > 0 AS INT) END) AS r_win_rate,
      quantile_cont(net_return, 0.05) AS fifth_percentile_net"""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in by.split(","))
    part(name, f"{source} {name}_dd", f"SELECT a.*, b.worst_ticker_trade_close_drawdown, b.median_ticker_trade_close_drawdown "
         f"FROM ({trade_summary(source, by, extra)}) a LEFT JOIN {name}_dd b ON {same}")


COUNTS = "candidate_count, trade_count, excluded_count, take_profit_count, stop_loss_count, time_exit_count, r_count"
VALUES = ("win_rate, average_win, average_loss, expected_value, median_return, std, break_even_win_rate, profit_factor, expectancy_r, median_r, "
          "average_winning_r, average_losing_r, r_win_rate, fifth_percentile_net, worst_ticker_trade_close_drawdown, median_ticker_trade_close_drawdown")
metrics_parts("surf", "train", "fold, candidate_id, family")
SQL["training_surface"] = sql(rounded("fold, candidate_id, family, " + COUNTS, VALUES, "FROM surf"), "surf")
part("picked", "surf folds", """
  SELECT s.fold, s.policy, s.history_end, s.test_start, s.test_end, s.searched, coalesce(b.candidate_id, CASE WHEN s.searched THEN 'v1_control' ELSE s.policy END) AS candidate_id
  FROM (SELECT fold, history_end, test_start, test_end, p.policy, p.searched FROM folds CROSS JOIN (VALUES ('training_selected', true), ('best_fixed', true), ('best_atr', true),
          ('best_r_multiple', true), ('v1_control', false), ('target_only', false), ('stop_only', false), ('time_only', false)) p(policy, searched)) s
  LEFT JOIN (SELECT fold, policy, candidate_id, row_number() OVER (PARTITION BY fold, policy ORDER BY round(expected_value, 12) DESC, candidate_id) AS n
             FROM (SELECT fold, candidate_id, expected_value, unnest(['training_selected', 'best_' || family]) AS policy FROM surf
                   WHERE family <> 'control' AND trade_count >= 200 AND expected_value IS NOT NULL)) b
    ON b.fold = s.fold AND b.policy = s.policy AND b.n = 1""")
PARAMETERS = "'{\"candidate_id\":\"' || c.candidate_id || '\"' || " + " || ".join(
    f"coalesce(',\"{k}\":' || {v}, '')" for k, v in (
        ("family", "'\"' || c.family || '\"'"), ("reward_risk", "c.reward_risk"), ("stop", "c.c_stop"), ("stop_multiplier", "c.stop_multiplier"),
        ("target", "c.c_target"), ("target_multiplier", "c.target_multiplier"))) + " || '}'"
SQL["training_selection"] = sql(rounded("p.fold, policy, history_end, test_start, test_end, p.candidate_id, parameters, training_trades, fallback", "training_net_ev", f"""
  FROM (SELECT p.*, {PARAMETERS} AS parameters, s.trade_count AS training_trades, s.expected_value AS training_net_ev,
               searched AND p.candidate_id = 'v1_control' AS fallback
        FROM picked p JOIN cat c ON c.candidate_id = p.candidate_id LEFT JOIN surf s ON s.fold = p.fold AND s.candidate_id = p.candidate_id) p"""), "picked", "surf", "cat")
part("surf_r", "surf", "SELECT *, round(expected_value, 12) AS ev, round(win_rate, 12) AS win FROM surf")
SQL["frontier"] = sql(rounded("fold, candidate_id, family", "expected_value, win_rate", """
  FROM surf_r b WHERE ev IS NOT NULL AND win IS NOT NULL AND NOT EXISTS (SELECT 1 FROM surf_r a WHERE a.fold = b.fold AND a.ev >= b.ev AND a.win >= b.win AND (a.ev > b.ev OR a.win > b.win))"""), "surf_r")
part("grid", "surf_r cat", """
  SELECT s.fold, s.family, s.candidate_id, s.ev, c.x, c.y, row_number() OVER (PARTITION BY s.fold, s.family ORDER BY s.ev DESC NULLS LAST, s.candidate_id) AS n
  FROM surf_r s JOIN cat c ON c.candidate_id = s.candidate_id WHERE s.family <> 'control'""")
SQL["plateaus"] = sql("""
  SELECT fold, family, winner, near_best_count, adjacent_near_best_count, near_best_count >= 3 AND adjacent_near_best_count >= 2 AS plateau_flag
  FROM (SELECT g.fold, g.family, w.candidate_id AS winner, count(*) FILTER (g.ev >= w.ev - 0.0005) AS near_best_count,
               count(*) FILTER (g.ev >= w.ev - 0.0005 AND abs(g.x - w.x) + abs(g.y - w.y) = 1) AS adjacent_near_best_count
        FROM grid g JOIN grid w ON w.fold = g.fold AND w.family = g.family AND w.n = 1 WHERE w.ev IS NOT NULL GROUP BY 1, 2, 3)""", "grid")
part("single", "cled picked folds", f"""
  SELECT fold, policy, candidate_id, family, ticker, timestamp, position, stop_fraction, target_fraction, status, next_timestamp, ambiguous_bar AND status = 'completed' AS ambiguous_bar,
         {', '.join(f"CASE WHEN status = 'completed' THEN {c} END AS {c}" for c in BLANK)}
  FROM (SELECT c.* EXCLUDE (status), p.fold, p.policy, CASE WHEN next_timestamp IS NULL OR next_timestamp > p.test_end THEN 'no_next_bar'
               WHEN window_end_timestamp IS NULL OR window_end_timestamp > p.test_end THEN 'incomplete_window' ELSE c.status END AS status
        FROM cled c JOIN picked p ON c.candidate_id = p.candidate_id AND c.timestamp BETWEEN p.test_start AND p.test_end)""")
thin_parts("single_thin", "single", "fold, policy, ticker")
part("modes", "single single_thin", "SELECT *, 'independent' AS mode FROM single UNION ALL BY NAME SELECT *, 'non_overlapping' AS mode FROM single_thin")
SQL["non_overlap_view"] = sql(rounded("fold, policy, timestamp, ticker, status, exit_timestamp, exit_reason", "net_return", "FROM single_thin"), "single_thin")
for name, source, by in (("fsum", "modes", "fold, policy, mode"), ("asum", "modes", "policy, mode"), ("tsum", "modes", "policy, mode, ticker")):
    metrics_parts(name, source, by)
SQL["policy_metrics"] = sql(rounded("fold, policy, mode, " + COUNTS, VALUES, "FROM fsum"), "fsum")
SQL["policy_walkforward"] = sql(rounded("policy, mode, " + COUNTS, VALUES, "FROM asum"), "asum")
SQL["policy_by_ticker"] = sql(rounded("policy, mode, ticker, " + COUNTS, VALUES, "FROM tsum"), "tsum")
part("dgn", "modes evctx", f"""
  SELECT *, CASE WHEN full_window_mfe > 0 THEN gross_return / full_window_mfe END AS mfe_capture, CASE WHEN full_window_mfe > 0 THEN net_return / full_window_mfe END AS net_mfe_capture,
         CASE WHEN status = 'completed' THEN greatest(full_window_mfe - mfe, 0) END AS remaining_mfe, CASE WHEN stop_fraction > 0 THEN net_return / stop_fraction END AS net_r,
         {', '.join(f"CASE WHEN exit_reason = 'stop_loss' AND post_exit_mfe IS NOT NULL THEN CAST(post_exit_mfe >= {p} / 100.0 AS DOUBLE) END AS stopped_recovered_{p}pct" for p in (2, 5, 10))}
  FROM (SELECT b.*, CASE WHEN status = 'completed' THEN c.full_window_mfe END AS full_window_mfe, CASE WHEN status = 'completed' THEN c.full_window_mae END AS full_window_mae,
               CASE holding_bars {' '.join(f'WHEN {h} THEN c.post_mfe_{h}' for h in range(1, 10))} END AS post_exit_mfe
        FROM modes b JOIN evctx c ON b.timestamp = c.timestamp AND b.ticker = c.ticker)""")
RECOVERED = ", ".join(f"stopped_recovered_{p}pct" for p in (2, 5, 10))
SQL["exit_diagnostics"] = sql(rounded("fold, policy, mode, timestamp, ticker, status",
    "full_window_mfe, full_window_mae, mfe_capture, net_mfe_capture, remaining_mfe, net_r, post_exit_mfe, " + RECOVERED, "FROM dgn"), "dgn")
part("dgn2", "dgn", "SELECT * FROM dgn UNION ALL BY NAME SELECT * REPLACE ('ALL' AS fold) FROM dgn")
SQL["exit_efficiency"] = sql(rounded(
    "fold, policy, mode, completed, capture_count, stopped_count, " + ", ".join(f"recovery_{p}pct_measurable_stops, recovery_{p}pct_count" for p in (2, 5, 10)),
    "mean_full_window_mfe, mean_full_window_mae, mean_capture, median_capture, mean_remaining_mfe, " + ", ".join(f"recovery_{p}pct_rate" for p in (2, 5, 10)), f"""
  FROM (SELECT fold, policy, mode, count(*) FILTER (status = 'completed') AS completed, avg(full_window_mfe) AS mean_full_window_mfe, avg(full_window_mae) AS mean_full_window_mae,
               avg(mfe_capture) AS mean_capture, median(mfe_capture) AS median_capture, count(mfe_capture) AS capture_count, avg(remaining_mfe) AS mean_remaining_mfe,
               count(*) FILTER (exit_reason = 'stop_loss') AS stopped_count,
               {', '.join(f"count(stopped_recovered_{p}pct) AS recovery_{p}pct_measurable_stops, CAST(coalesce(sum(stopped_recovered_{p}pct), 0) AS BIGINT) AS recovery_{p}pct_count, avg(stopped_recovered_{p}pct) AS recovery_{p}pct_rate" for p in (2, 5, 10))}
        FROM dgn2 GROUP BY 1, 2, 3)"""), "dgn2")
part("pairs", "single", """
  SELECT a.fold, a.timestamp, a.ticker, a.policy, a.candidate_id, a.net_return, b.net_return AS net_return_control, a.net_return - b.net_return AS paired_net_difference
  FROM single a JOIN single b ON a.fold = b.fold AND a.timestamp = b.timestamp AND a.ticker = b.ticker AND b.policy = 'v1_control'
  WHERE a.policy <> 'v1_control' AND a.status = 'completed' AND b.status = 'completed'""")
SQL["paired_comparison"] = sql(rounded("fold, timestamp, ticker, policy, candidate_id", "net_return, net_return_control, paired_net_difference", "FROM pairs"), "pairs")
draws_part("pboot", "pairs", "policy", "paired_net_difference", 2000)
X = "paired_net_difference"
SQL["paired_uncertainty"] = sql(rounded("a.policy, count, missing_count, cluster_count", f"mean, median, std, win_rate, expectancy, profit_factor, {BOOT}", f"""
  FROM (SELECT policy, count({X}) AS count, count(*) - count({X}) AS missing_count, avg({X}) AS mean, median({X}) AS median, stddev_samp({X}) AS std,
               avg(CAST({X} > 0 AS INT)) AS win_rate, avg({X}) AS expectancy, {PF.format(x=X)} AS profit_factor, count(DISTINCT timestamp) AS cluster_count FROM pairs GROUP BY 1) a
  LEFT JOIN pboot b ON a.policy = b.policy"""), "pairs", "pboot")
SQL["paired_by_ticker"] = sql(rounded("policy, tickers, positive, negative", "median, q25, q75", """
  FROM (SELECT policy, count(x) AS tickers, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative, median(x) AS median, quantile_cont(x, 0.25) AS q25,
               quantile_cont(x, 0.75) AS q75 FROM (SELECT policy, ticker, avg(paired_net_difference) AS x FROM pairs GROUP BY 1, 2) GROUP BY 1)"""), "pairs")
NAMES = ("training_selected", "v1_control", "time_only", "target_only")
SQL["policy_pivot"] = sql(rounded("fold, candidate_id, changed", ", ".join(NAMES) + ", gain", f"""
  FROM (SELECT p.*, c.candidate_id, c.changed, p.training_selected - p.v1_control AS gain
        FROM (SELECT fold, {', '.join(f"max(expected_value) FILTER (policy = '{n}') AS {n}" for n in NAMES)} FROM fsum WHERE mode = 'independent' GROUP BY 1) p
        JOIN (SELECT fold, candidate_id, coalesce(candidate_id <> lag(candidate_id) OVER (ORDER BY fold), false) AS changed FROM picked WHERE policy = 'training_selected') c
          ON c.fold = p.fold)"""), "fsum", "picked")
SCORES = ("expected_value", "median_return", "win_rate", "profit_factor", "average_loss", "average_mfe", "average_mae")
N3 = NAMES[:3]
part("scores", "asum fsum tsum", " UNION ALL BY NAME ".join(
    [f"SELECT mode, '{m}' AS metric, {', '.join(f'max({m}) FILTER (policy = {chr(39)}{n}{chr(39)}) AS {n}' for n in N3)} FROM asum GROUP BY mode" for m in SCORES]
    + [f"SELECT mode, '{m}' AS metric, {', '.join(f'(count(*) FILTER (expected_value > 0 AND policy = {chr(39)}{n}{chr(39)})) || {chr(39)}/{chr(39)} || (count(expected_value) FILTER (policy = {chr(39)}{n}{chr(39)})) AS {n}_text' for n in N3)} FROM {t} GROUP BY mode"
       for m, t in (("positive_folds", "fsum"), ("positive_tickers", "tsum"))]))
SQL["scorecard"] = sql(rounded("mode, metric, " + ", ".join(f"{n}_text" for n in N3), ", ".join(N3) + ", difference",
                               "FROM (SELECT *, training_selected - v1_control AS difference FROM scores)"), "scores")
SIDES = " UNION ALL ".join(f"SELECT * EXCLUDE (stop_fraction, target_fraction), '{m}' AS measure, {m} AS x FROM both_periods" for m in ("stop_fraction", "target_fraction"))
part("both_periods", "train modes", """
  SELECT 'training' AS period, fold, candidate_id, family, NULL::VARCHAR AS policy, NULL::VARCHAR AS mode, ticker, stop_fraction, target_fraction FROM train WHERE status = 'completed'
  UNION ALL SELECT 'oos', fold, NULL::VARCHAR, NULL::VARCHAR, policy, mode, ticker, stop_fraction, target_fraction FROM modes WHERE status = 'completed'""")
part("sides", "both_periods", f"SELECT * FROM ({SIDES}) UNION ALL SELECT * REPLACE ('ALL' AS ticker) FROM ({SIDES})")
SQL["stop_target_distribution"] = sql(rounded("period, fold, candidate_id, family, policy, mode, ticker, measure, count", "mean, median, minimum, maximum, q25, q75", f"""
  FROM (SELECT period, fold, candidate_id, family, policy, mode, ticker, measure, {SPREAD} FROM sides GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)"""), "sides")
