"""SQL building blocks for checking query results, written against the raw tables."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: str, body: str) -> None:
    PARTS[name] = (tuple(needs.split()), body)


def sql(final: str, *needs: str) -> str:
    """``WITH`` chain of the named parts, in order of need, and the final select."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in PARTS[name][0]:
            visit(need)
        order.append(name)

    for name in needs:
        visit(name)
    chain = ",\n".join(f"{n} AS {'' if n.startswith('rec_') else 'MATERIALIZED '}({PARTS[n][1]})" for n in order)
    return f"WITH RECURSIVE {chain}\n{final}" if order else final


def r(x: str) -> str:
    """A double rounded as the queries round it: six decimals below ten, three below a million."""
    return (f"CASE WHEN abs({x}) < 10 THEN floor({x} * 1e6 + 0.5) / 1e6 "
            f"WHEN abs({x}) < 1e6 THEN floor({x} * 1e3 + 0.5) / 1e3 ELSE {x} END")


def rounded(plain: str, doubles: str, tail: str) -> str:
    """Select list with doubles rounded as the queries round them."""
    items = [c.strip() for c in plain.split(",") if c.strip()]
    items += [f"{r(c.strip())} AS {c.strip()}" for c in doubles.split(",") if c.strip()]
    return f"SELECT {', '.join(items)} {tail}"


part("ticks", "", """
  SELECT CAST(l_shipdate AS DATE) AS timestamp, l_returnflag || l_linestatus AS ticker,
         l_extendedprice / l_quantity AS px, l_quantity AS q,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k
  FROM lineitem""")
part("bars", "ticks", """
  SELECT timestamp, ticker, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         CAST(sum(q) AS BIGINT) AS volume FROM ticks GROUP BY timestamp, ticker""")
part("idx", "ticks", """
  SELECT timestamp, 'ALL' AS ticker, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         CAST(sum(q) AS BIGINT) AS volume FROM ticks GROUP BY timestamp""")
part("ctx", "idx", """
  SELECT timestamp, benchmark_open, benchmark_close, benchmark_return_20d, benchmark_drawdown_20d,
         CASE WHEN n >= 21 THEN stddev_samp(r1) OVER (ORDER BY timestamp ROWS 19 PRECEDING) * sqrt(252.0) END
           AS benchmark_volatility_20d, benchmark_sma, n - 1 AS session_number, sessions AS session_count,
         CASE WHEN benchmark_sma IS NULL THEN 'unknown' WHEN benchmark_close >= benchmark_sma THEN 'above' ELSE 'below' END AS regime
  FROM (SELECT timestamp, open AS benchmark_open, close AS benchmark_close,
               close / lag(close) OVER w - 1 AS r1, close / lag(close, 20) OVER w - 1 AS benchmark_return_20d,
               row_number() OVER w AS n, count(*) OVER () AS sessions,
               CASE WHEN row_number() OVER w >= 20 THEN close / max(close) OVER (ORDER BY timestamp ROWS 19 PRECEDING) - 1 END
                 AS benchmark_drawdown_20d,
               CASE WHEN row_number() OVER w >= 200 THEN avg(close) OVER (ORDER BY timestamp ROWS 199 PRECEDING) END AS benchmark_sma
        FROM idx WINDOW w AS (ORDER BY timestamp))""")
part("base", "bars ctx", """
  SELECT b.*, c.* EXCLUDE (timestamp), row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY b.ticker) AS length,
         lag(b.close) OVER w AS prev
  FROM bars b LEFT JOIN ctx c ON b.timestamp = c.timestamp WINDOW w AS (PARTITION BY b.ticker ORDER BY b.timestamp)""")


def _lagged(n: int) -> str:
    return f"close / lag(close, {n}) OVER w - 1 AS return_{n}d"


def _located(n: int) -> str:
    f = f"(PARTITION BY ticker ORDER BY timestamp ROWS {n - 1} PRECEDING)"
    return (f"CASE WHEN position >= {n - 1} THEN close / max(close) OVER {f} - 1 END AS drawdown_{n}d, "
            f"CASE WHEN position >= {n - 1} THEN close / min(close) OVER {f} - 1 END AS distance_from_low_{n}d, "
            f"CASE WHEN position >= {n - 1} THEN close / max(close) OVER {f} - 1 END AS distance_from_high_{n}d")


def _relative(n: int) -> str:
    return (f"close / lag(close, {n}) OVER w - benchmark_close / lag(benchmark_close, {n}) OVER w AS relative_return_{n}d")


F20 = "(PARTITION BY ticker ORDER BY timestamp ROWS 19 PRECEDING)"
part("plainfeat", "base", f"""
  SELECT *, {', '.join(_lagged(n) for n in (1, 5, 10, 20))}, {_located(20)}, {_located(60)},
         {', '.join(_relative(n) for n in (5, 10, 20))},
         CASE WHEN position >= 19 AND stddev_samp(close) OVER {F20} > 0
              THEN (close - avg(close) OVER {F20}) / stddev_samp(close) OVER {F20} END AS price_zscore_20d,
         CASE WHEN position >= 19 THEN avg(volume) OVER {F20} END AS volume_mean_20d,
         CASE WHEN position >= 19 AND avg(volume) OVER {F20} > 0 THEN volume / avg(volume) OVER {F20} END AS relative_volume_20d,
         CASE WHEN position >= 19 AND stddev_samp(volume) OVER {F20} > 0
              THEN (volume - avg(volume) OVER {F20}) / stddev_samp(volume) OVER {F20} END AS volume_zscore_20d,
         CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS true_range,
         CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS gain,
         CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS loss
  FROM base WINDOW w AS (PARTITION BY ticker ORDER BY timestamp)""")
# Smoothing as a direct weighted sum: each value after the seed weighs (13/14)^age / 14.
part("smooth", "plainfeat", """
  SELECT a.ticker, a.timestamp,
         sum(pow(13.0 / 14, a.position - b.position) / 14 * CASE WHEN b.position > 14 THEN b.true_range ELSE 0 END)
           + pow(13.0 / 14, a.position - 14) * avg(CASE WHEN b.position <= 14 THEN b.true_range END) AS atr_14,
         sum(pow(13.0 / 14, a.position - b.position) / 14 * CASE WHEN b.position > 14 THEN b.gain ELSE 0 END)
           + pow(13.0 / 14, a.position - 14) * avg(CASE WHEN b.position <= 14 THEN b.gain END) AS mean_gain,
         sum(pow(13.0 / 14, a.position - b.position) / 14 * CASE WHEN b.position > 14 THEN b.loss ELSE 0 END)
           + pow(13.0 / 14, a.position - 14) * avg(CASE WHEN b.position <= 14 THEN b.loss END) AS mean_loss
  FROM plainfeat a JOIN plainfeat b ON a.ticker = b.ticker AND b.position BETWEEN 1 AND a.position
       AND (b.position <= 14 OR b.position > a.position - 700)
  WHERE a.position >= 14 GROUP BY a.ticker, a.timestamp, a.position""")
F60 = "(PARTITION BY ticker ORDER BY timestamp ROWS 59 PRECEDING)"
part("feat", "plainfeat smooth", f"""
  SELECT p.*, CASE WHEN position >= 20 THEN stddev_samp(return_1d) OVER (PARTITION BY p.ticker ORDER BY p.timestamp ROWS 19 PRECEDING) * sqrt(252.0) END AS volatility_20d,
         CASE WHEN position >= 60 THEN stddev_samp(return_1d) OVER (PARTITION BY p.ticker ORDER BY p.timestamp ROWS 59 PRECEDING) * sqrt(252.0) END AS volatility_60d,
         CASE WHEN mean_gain + mean_loss > 0 THEN 100 * mean_gain / (mean_gain + mean_loss) END AS rsi_14,
         s.atr_14, s.atr_14 / p.close AS atr_pct_14
  FROM plainfeat p LEFT JOIN smooth s ON p.ticker = s.ticker AND p.timestamp = s.timestamp""")

SIGNAL_FEATURES = ("drawdown_60d", "price_zscore_20d", "distance_from_low_20d", "relative_return_10d")
COMPONENTS = ("dip_drawdown_component", "dip_price_zscore_component", "dip_low_proximity_component",
              "dip_relative_weakness_component")
THRESHOLDS = tuple(f"{c}_threshold" for c in SIGNAL_FEATURES)


def _signal_parts(source: str, tag: str) -> None:
    prior = "(PARTITION BY ticker ORDER BY timestamp ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
    limits = ", ".join(f"CASE WHEN count({c}) OVER {prior} >= 126 THEN quantile_cont({c}, 0.2) OVER {prior} END AS {c}_threshold"
                       for c in SIGNAL_FEATURES)
    part(f"thr{tag}", source, f"SELECT *, {limits} FROM {source}")
    flags = ", ".join(f"coalesce({c} <= {c}_threshold, false) AS {k}" for c, k in zip(SIGNAL_FEATURES, COMPONENTS))
    ready = " AND ".join(f"{c} IS NOT NULL" for c in SIGNAL_FEATURES + THRESHOLDS)
    part(f"comp{tag}", f"thr{tag}", f"SELECT *, {flags}, {ready} AS dip_ready_v1 FROM thr{tag}")
    count = " + ".join(f"CAST({k} AS BIGINT)" for k in COMPONENTS)
    part(f"cond{tag}", f"comp{tag}", f"SELECT *, {count} AS dip_component_count, dip_ready_v1 AND ({count}) >= 3 AS dip_condition_v1 FROM comp{tag}")
    part(f"sig{tag}", f"cond{tag}", f"""
      SELECT *, dip_condition_v1 AND NOT coalesce(lag(dip_condition_v1) OVER (PARTITION BY ticker ORDER BY timestamp), false)
        AS dip_event_v1 FROM cond{tag}""")


_signal_parts("plainfeat", "")       # without the smoothed measures
_signal_parts("feat", "_full")       # with them

part("cuts", "ctx", """
  SELECT min(CASE WHEN session_number = floor(session_count * 0.6) THEN timestamp END) AS validation_start,
         min(CASE WHEN session_number = floor(session_count * 0.8) THEN timestamp END) AS test_start FROM ctx""")
part("split_sig", "sig cuts", """
  SELECT s.*, CASE WHEN s.timestamp < c.validation_start THEN 'research' WHEN s.timestamp < c.test_start THEN 'validation'
         ELSE 'test' END AS split, CAST(NULL AS DATE) AS until, 'all' AS fold FROM sig s, cuts c""")
part("folds", "ctx", """
  SELECT CAST(y AS VARCHAR) AS fold, first AS history_start, history_end, test_start, test_end, test_sessions,
         test_end < CASE dayofweek(make_date(y, 12, 31)) WHEN 6 THEN make_date(y, 12, 30) WHEN 0 THEN make_date(y, 12, 29)
                    ELSE make_date(y, 12, 31) END AS partial_year
  FROM (SELECT y, test_start, test_end, test_sessions, first, max(test_end) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history_end
        FROM (SELECT year(timestamp) AS y, min(timestamp) AS test_start, max(timestamp) AS test_end, count(*) AS test_sessions,
                     (SELECT min(timestamp) FROM ctx) AS first FROM ctx GROUP BY 1))
  WHERE history_end IS NOT NULL AND y >= year(first + INTERVAL 2 YEAR)
        + CASE WHEN month(first + INTERVAL 2 YEAR) = 1 AND day(first + INTERVAL 2 YEAR) = 1 THEN 0 ELSE 1 END""")
part("membership", "bars", """
  SELECT ticker, min(timestamp) + 300 AS start_date, min(timestamp) + 1400 AS end_date FROM bars GROUP BY ticker
  UNION ALL BY NAME SELECT ticker, min(timestamp) + 1500 AS start_date, CAST(NULL AS DATE) AS end_date FROM bars GROUP BY ticker""")
part("requested", "bars", "SELECT DISTINCT ticker FROM bars UNION ALL SELECT 'XX' AS ticker FROM (SELECT 1 FROM bars LIMIT 1)")
MEMBER = ("EXISTS (SELECT 1 FROM membership m WHERE m.ticker = s.ticker AND s.timestamp >= m.start_date "
          "AND (m.end_date IS NULL OR s.timestamp < m.end_date))")


def _fold_parts(tag: str) -> None:
    part(f"obs{tag}", f"sig{tag} folds membership",
         f"SELECT s.*, f.fold, f.test_start, f.test_end, {MEMBER} AS member FROM sig{tag} s JOIN folds f ON s.timestamp BETWEEN f.test_start AND f.test_end")
    usable = "fold IS NOT NULL AND member"
    part(f"fold_sig{tag}", f"sig{tag} folds membership", f"""
      SELECT * EXCLUDE (dip_ready_v1, dip_condition_v1, dip_event_v1), dip_ready_v1 AND {usable} AS dip_ready_v1,
             dip_condition_v1 AND {usable} AS dip_condition_v1, dip_event_v1 AND {usable} AS dip_event_v1,
             'test' AS split, test_end AS until
      FROM (SELECT s.*, f.fold, f.test_end, {MEMBER} AS member
            FROM sig{tag} s LEFT JOIN folds f ON s.timestamp BETWEEN f.test_start AND f.test_end)""")


_fold_parts("")
_fold_parts("_full")


def outcome_part(name: str, source: str, horizons=(1, 3, 5, 10, 20)) -> None:
    """Long ledger over all selections; joins bars by position."""
    hs = ", ".join(f"({h})" for h in horizons)
    part(name, source, f"""
      SELECT timestamp, ticker, dip_component_count, split, fold, regime, horizon, selection, status,
             CASE WHEN ok THEN e_ts END AS entry_timestamp, CASE WHEN ok THEN x_ts END AS end_timestamp,
             CASE WHEN ok THEN e_open END AS entry_price, CASE WHEN ok THEN x_close / e_open - 1 END AS forward_return,
             CASE WHEN ok THEN hi / e_open - 1 END AS mfe, CASE WHEN ok THEN lo / e_open - 1 END AS mae,
             CASE WHEN ok THEN b_close / b_open - 1 END AS benchmark_return,
             CASE WHEN ok THEN x_close / e_open - 1 - (b_close / b_open - 1) END AS excess_return
      FROM (SELECT *, status = 'completed' AS ok FROM (
        SELECT s.timestamp, s.ticker, s.dip_component_count, s.split, s.fold, s.regime, h.horizon, sel.selection,
               e.timestamp AS e_ts, e.open AS e_open, e.benchmark_open AS b_open, x.timestamp AS x_ts, x.close AS x_close,
               x.benchmark_close AS b_close, p.hi, p.lo,
               CASE WHEN e.timestamp IS NULL OR e.timestamp > s.until THEN 'no_next_bar'
                    WHEN x.timestamp IS NULL OR x.timestamp > s.until THEN 'incomplete_window'
                    WHEN x.split <> s.split THEN 'split_boundary' ELSE 'completed' END AS status
        FROM {source} s CROSS JOIN (VALUES {hs}) h(horizon)
        JOIN (VALUES ('events'), ('eligible'), ('non_signal')) sel(selection)
          ON CASE sel.selection WHEN 'events' THEN s.dip_event_v1 WHEN 'eligible' THEN s.dip_ready_v1
             ELSE s.dip_ready_v1 AND NOT s.dip_condition_v1 END
        LEFT JOIN {source} e ON e.ticker = s.ticker AND e.position = s.position + 1
        LEFT JOIN {source} x ON x.ticker = s.ticker AND x.position = s.position + h.horizon
        LEFT JOIN (SELECT a.ticker, a.position, v.horizon, max(b.high) AS hi, min(b.low) AS lo
                   FROM {source} a CROSS JOIN (VALUES {hs}) v(horizon)
                   JOIN {source} b ON a.ticker = b.ticker AND b.position BETWEEN a.position + 1 AND a.position + v.horizon
                   WHERE a.dip_ready_v1 GROUP BY ALL) p
          ON p.ticker = s.ticker AND p.position = s.position AND p.horizon = h.horizon))""")


outcome_part("fwd", "split_sig")
outcome_part("fold_fwd", "fold_sig")


def barrier_parts(name: str, source: str, events: str, *, holding: int = 10, optimistic: bool = False,
                  commission: float = 0.0001, slippage: float = 0.0005, needs: str = "") -> None:
    """Labels for ``events`` (columns of ``source`` plus stop, target and eid), bar by bar."""
    eps = "8 * 2.220446049250313e-16"
    below = lambda v: f"({v} <= lo_ + {eps} * greatest(abs({v}), abs(lo_)))"
    above = lambda v: f"({v} >= up_ - {eps} * greatest(abs({v}), abs(up_)))"
    stop_first = f"{below('b.low')} AND NOT coalesce({above('b.high')}, false)" if optimistic else below("b.low")
    part(f"{name}_ev", f"{source} {needs}", f"""
      SELECT s.*, e.open AS entry, e.timestamp AS e_ts, x.timestamp AS x_ts, e.open * (1 + target) AS up_, e.open * (1 - stop) AS lo_,
             CASE WHEN e.timestamp IS NULL OR e.timestamp > s.until THEN 'no_next_bar'
                  WHEN x.timestamp IS NULL OR x.timestamp > s.until THEN 'incomplete_window'
                  WHEN x.split <> s.split THEN 'split_boundary' ELSE 'completed' END AS status
      FROM ({events}) s LEFT JOIN {source} e ON e.ticker = s.ticker AND e.position = s.position + 1
      LEFT JOIN {source} x ON x.ticker = s.ticker AND x.position = s.position + {holding}""")
    part(f"{name}_hit", f"{name}_ev", f"""
      SELECT s.eid, s.entry, b.position - s.position AS j, b.timestamp AS at, b.open, b.high, b.low,
             CASE WHEN {below('b.open')} THEN row('stop_loss', b.open, 'open', false)
                  WHEN {above('b.open')} THEN row('take_profit', b.open, 'open', false)
                  WHEN {stop_first} THEN row('stop_loss', lo_, 'barrier', coalesce({above('b.high')}, false))
                  WHEN {above('b.high')} THEN row('take_profit', up_, 'barrier', coalesce({below('b.low')}, false))
                  WHEN b.position = s.position + {holding} THEN row('time_exit', b.close, 'close', false) END AS hit
      FROM {name}_ev s JOIN {source} b ON b.ticker = s.ticker AND b.position BETWEEN s.position + 1 AND s.position + {holding}
      WHERE s.status = 'completed'""")
    part(f"{name}_exit", f"{name}_hit", f"""
      SELECT h.eid, f.j AS holding_bars, any_value(CASE WHEN h.j = f.j THEN h.at END) AS exit_timestamp,
             any_value(CASE WHEN h.j = f.j THEN h.hit[1] END) AS exit_reason, any_value(CASE WHEN h.j = f.j THEN h.hit[2] END) AS exit_price,
             any_value(CASE WHEN h.j = f.j THEN h.hit[3] END) AS fill_type, bool_or(h.j = f.j AND h.hit[4]) AS ambiguous_bar,
             greatest(max(CASE WHEN h.j = f.j AND h.hit[3] = 'open' THEN h.open ELSE h.high END), any_value(h.entry)) / any_value(h.entry) - 1 AS mfe,
             least(min(CASE WHEN h.j = f.j AND h.hit[3] = 'open' THEN h.open ELSE h.low END), any_value(h.entry)) / any_value(h.entry) - 1 AS mae
      FROM {name}_hit h JOIN (SELECT eid, min(j) AS j FROM {name}_hit WHERE hit IS NOT NULL GROUP BY eid) f
        ON h.eid = f.eid AND h.j <= f.j GROUP BY h.eid, f.j""")
    part(name, f"{name}_exit", f"""
      SELECT s.* EXCLUDE (up_, lo_, entry, e_ts, x_ts), CASE WHEN status = 'completed' THEN e_ts END AS entry_timestamp,
             CASE WHEN status = 'completed' THEN entry END AS entry_price,
             CASE WHEN status = 'completed' THEN entry * {1 + slippage!r} END AS entry_fill_price,
             x.exit_timestamp, x.exit_price, x.exit_price * {1 - slippage!r} AS exit_fill_price, x.exit_reason, x.fill_type, x.holding_bars,
             x.exit_price / entry - 1 AS gross_return,
             x.exit_price * {1 - slippage!r} * {1 - commission!r} / (entry * {1 + slippage!r} * {1 + commission!r}) - 1 AS net_return,
             x.mfe, x.mae, coalesce(x.ambiguous_bar, false) AS ambiguous_bar,
             CASE WHEN x.fill_type = 'open' THEN 'through_exit_open' WHEN status = 'completed' THEN 'through_exit_bar' END AS excursion_scope,
             stop AS stop_fraction, target AS target_fraction, x_ts AS window_end_timestamp, e_ts AS next_timestamp
      FROM {name}_ev s LEFT JOIN {name}_exit x ON s.eid = x.eid""")


OUTCOMES = ("entry_timestamp", "entry_price", "entry_fill_price", "exit_timestamp", "exit_price", "exit_fill_price",
            "exit_reason", "fill_type", "holding_bars", "gross_return", "net_return", "mfe", "mae", "excursion_scope")


def thin_parts(name: str, source: str, keys: str) -> None:
    """Sequential replay of the no-overlap rule, one step per event."""
    ks = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"o.{k} = r.{k}" for k in ks)
    part(f"{name}_ord", source, f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY position) AS n FROM {source}")
    exit_ = "CASE WHEN {0}status = 'completed' THEN {0}position + {0}holding_bars END"
    part(f"rec_{name}", f"{name}_ord", f"""
      SELECT {keys}, n, {exit_.format('')} AS last, false AS over_ FROM {name}_ord WHERE n = 1
      UNION ALL
      SELECT {', '.join('o.' + k for k in ks)}, o.n,
             CASE WHEN coalesce(o.position + 1 <= r.last, false) THEN r.last ELSE coalesce({exit_.format('o.')}, r.last) END,
             coalesce(o.position + 1 <= r.last, false)
      FROM rec_{name} r JOIN {name}_ord o ON {same} AND o.n = r.n + 1""")
    blank = ", ".join(f"CASE WHEN NOT over_ THEN {c} END AS {c}" for c in OUTCOMES)
    part(name, f"{name}_ord rec_{name}", f"""
      SELECT o.* EXCLUDE (n, status, ambiguous_bar, {', '.join(OUTCOMES)}), CASE WHEN over_ THEN 'overlap' ELSE status END AS status,
             ambiguous_bar AND NOT over_ AS ambiguous_bar, {blank}
      FROM {name}_ord o JOIN rec_{name} r ON {same} AND o.n = r.n""")


EVENT_ID = "ticker || ':' || position AS eid"
barrier_parts("trade", "split_sig", f"SELECT *, 7e-2 AS stop, 1e-1 AS target, {EVENT_ID} FROM split_sig WHERE dip_event_v1")
thin_parts("trade_thin", "trade", "ticker")
barrier_parts("fold_single", "fold_sig", f"SELECT *, 7e-2 AS stop, 1e-1 AS target, {EVENT_ID} FROM fold_sig WHERE dip_event_v1")
thin_parts("fold_thin", "fold_single", "fold, ticker")
part("fold_trade", "fold_single fold_thin",
     "SELECT *, 'independent' AS mode FROM fold_single UNION ALL BY NAME SELECT *, 'non_overlapping' AS mode FROM fold_thin")
