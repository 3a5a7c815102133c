"""Checking SQL for decision records."""

from __future__ import annotations

from oracle.base import COMPONENTS, MEMBER, SIGNAL_FEATURES, THRESHOLDS, part, rounded, sql

SQL: dict[str, str] = {}
FLAGS = "dip_ready_v1, dip_condition_v1, dip_event_v1, dip_component_count, " + ", ".join(COMPONENTS)
part("last_day", "ctx", "SELECT max(timestamp) AS day FROM ctx")
SQL["decision_records"] = sql(rounded("s.ticker, session, eligible, status, error, latest_session, " + FLAGS, ", ".join(SIGNAL_FEATURES + THRESHOLDS), f"""
  FROM (SELECT s.ticker, s.timestamp AS session, {MEMBER} AS eligible, l.latest_session, g.* EXCLUDE (ticker, timestamp),
               CASE WHEN l.latest_session IS NULL THEN 'unavailable' WHEN l.latest_session <> s.timestamp THEN 'stale' ELSE 'available' END AS status,
               CASE WHEN l.latest_session IS NULL THEN 'series unavailable' WHEN l.latest_session <> s.timestamp THEN 'signal-date bar unavailable' END AS error
        FROM (SELECT ticker, day AS timestamp FROM requested, last_day) s
        LEFT JOIN (SELECT ticker, max(timestamp) AS latest_session FROM sig GROUP BY 1) l ON l.ticker = s.ticker
        LEFT JOIN sig g ON g.ticker = s.ticker AND g.timestamp = s.timestamp) s"""), "requested", "last_day", "sig", "membership")
WRONG = " OR ".join(f"{k} <> coalesce({c} <= {c}_threshold, false)" for c, k in zip(SIGNAL_FEATURES, COMPONENTS))
READY = "(" + " AND ".join(f"{c} IS NOT NULL" for c in SIGNAL_FEATURES + THRESHOLDS) + ")"
def decision_checks(source: str) -> str:
    return f"""
  SELECT count(*) AS records, count(*) FILTER ({WRONG}) AS wrong_components,
         count(*) FILTER (dip_component_count <> {' + '.join(f'CAST({c} AS INT)' for c in COMPONENTS)}) AS wrong_counts,
         count(*) FILTER (dip_ready_v1 <> {READY}) AS wrong_ready, count(*) FILTER (dip_condition_v1 <> ({READY} AND dip_component_count >= 3)) AS wrong_conditions,
         count(*) FILTER (dip_event_v1 AND NOT dip_condition_v1) AS events_without_condition FROM {source}"""


def flipped(name: str, each: int) -> str:
    return f"CASE WHEN volume % {each} = 0 THEN NOT {name} ELSE {name} END AS {name}"


part("spoilt", "sig", f"""
  SELECT * REPLACE ({flipped(COMPONENTS[0], 7)}, CASE WHEN volume % 11 = 0 THEN 4 - dip_component_count ELSE dip_component_count END AS dip_component_count,
                    {flipped('dip_ready_v1', 13)}, {flipped('dip_condition_v1', 17)}, dip_event_v1 OR volume % 19 = 0 AS dip_event_v1) FROM sig""")
SQL["decision_checks"] = sql(decision_checks("sig"), "sig")
SQL["decision_checks_faulty"] = sql(decision_checks("spoilt"), "spoilt")
part("cal", "ctx", """
  SELECT timestamp AS session, nxt AS next_session, timestamp + INTERVAL 16 HOUR AS close, timestamp + INTERVAL 24 HOUR + INTERVAL 15 MINUTE AS collection_start,
         nxt + INTERVAL 9 HOUR + INTERVAL 30 MINUTE AS next_open FROM (SELECT timestamp, lead(timestamp) OVER (ORDER BY timestamp) AS nxt FROM ctx)""")
part("arch", "sig cal", """
  SELECT s.timestamp AS session, s.ticker, s.volume, s.dip_component_count, s.dip_condition_v1, s.dip_event_v1, c.close, c.collection_start, c.next_open,
         c.close + to_hours(volume % 48) AS published_at, c.close + to_minutes(volume % 90) AS source,
         CASE WHEN volume % 13 = 0 THEN 'replay' ELSE 'collect' END AS mode
  FROM sig s JOIN cal c ON c.session = s.timestamp""")
part("classed", "arch cuts", """
  SELECT a.*, CASE WHEN volume % 23 = 0 THEN 'correction' WHEN mode = 'replay' OR session < validation_start THEN 'retrospective'
    WHEN volume % 7 = 0 THEN 'unavailable' WHEN volume % 11 = 0 THEN 'unverifiable' WHEN volume % 19 = 0 THEN 'stale' WHEN published_at >= next_open THEN 'late'
    WHEN published_at < collection_start THEN 'early' WHEN volume % 29 = 0 OR volume % 17 = 0 OR source < close OR source > published_at THEN 'unverifiable'
    ELSE 'prospective' END AS classification FROM arch a, cuts""")
SQL["timing_class"] = sql("SELECT session, ticker, published_at, classification FROM classed", "classed")
SQL["class_counts"] = sql("SELECT classification, count(*) AS count FROM classed GROUP BY 1", "classed")
part("due", "cal cuts", "SELECT cal.* FROM cal, cuts WHERE next_open <= test_start + INTERVAL 12 HOUR")
SQL["due_sessions"] = sql("SELECT session, next_session, next_open FROM due", "due")
part("run", "arch", """
  SELECT session, records, available_records, CASE WHEN available_records = records THEN 'complete' WHEN available_records > 0 THEN 'partial' ELSE 'failed' END AS status
  FROM (SELECT session, count(*) AS records, count(*) FILTER (volume % 7 <> 0) AS available_records FROM arch WHERE volume % 23 <> 0 GROUP BY 1
        HAVING bool_or(next_open IS NULL OR published_at < next_open))""")
SQL["run_status"] = sql("SELECT * FROM run", "run")
SQL["coverage"] = sql("SELECT d.session, coalesce(r.status, 'missing_run') AS status FROM due d LEFT JOIN run r ON r.session = d.session", "due", "run")
part("chain", "", """
  SELECT session, run_id, CASE WHEN o_custkey % 4 = 0 THEN coalesce(lag(run_id, 2) OVER w, lag(run_id) OVER w) WHEN o_custkey % 31 = 0 THEN -1 ELSE lag(run_id) OVER w END AS corrects
  FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderpriority AS session, o_orderkey AS run_id, o_custkey FROM orders)
  WINDOW w AS (PARTITION BY session ORDER BY run_id)""")
SQL["correction_checks"] = sql("""
  SELECT (SELECT count(DISTINCT session) FROM chain) AS sessions,
         (SELECT count(*) FROM (SELECT session FROM chain GROUP BY 1 HAVING count(*) FILTER (corrects IS NULL) <> 1)) AS sessions_without_one_primary,
         (SELECT count(*) FROM (SELECT session, corrects FROM chain WHERE corrects IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)) AS parents_with_several_successors,
         (SELECT count(*) FROM (SELECT DISTINCT session, corrects FROM chain WHERE corrects IS NOT NULL) c
          WHERE NOT EXISTS (SELECT 1 FROM chain p WHERE p.session = c.session AND p.run_id = c.corrects)) AS missing_parents""", "chain")
BODY = ("'{\"dip_component_count\":' || dip_component_count || ',\"dip_condition_v1\":' || dip_condition_v1 || ',\"dip_event_v1\":' || {e} || "
        "',\"session\":\"' || session || '\",\"ticker\":\"' || ticker || '\"}' || chr(10)")
DIGEST = "sha256(" + BODY.replace("{e}", "dip_event_v1") + ")"
SQL["record_digest"] = sql(f"SELECT session, ticker, {DIGEST} AS digest FROM arch", "arch")
SQL["linkage_checks"] = sql(f"SELECT s.session, s.ticker FROM (SELECT *, session AS timestamp FROM arch) s WHERE dip_event_v1 AND NOT {MEMBER}", "arch", "membership")
SQL["archive_flat"] = sql("""
  SELECT c.session, c.ticker, c.mode, c.classification, coalesce(r.status, 'interrupted') AS run_status, c.next_open AS expected_entry_timestamp, c.dip_event_v1
  FROM classed c LEFT JOIN run r ON r.session = c.session""", "classed", "run")
SQL["context_checks"] = sql("""
  SELECT count(*) AS records, count(*) FILTER (volume % 13 <> 0 AND volume % 11 = 0) AS unregistered_fields,
         count(*) FILTER (volume % 13 <> 0 AND volume % 7 = 0) AS missing_fields FROM sig""", "sig")
DAY = "strftime(timestamp, '%Y-%m-%d')"
SQL["ticker_payload"] = sql(f"""
  SELECT ticker, fold, known_at_signal, future_outcomes FROM
    (SELECT ticker, fold, '[' || string_agg('{{"date":"' || {DAY} || '","close":' || (CAST(floor(close * 1e6 + 0.5) AS DECIMAL(18, 0)) * 0.000001) || ',"dip_component_count":' || dip_component_count
            || ',"dip_event_v1":' || dip_event_v1 || '}}', ',' ORDER BY timestamp) || ']' AS known_at_signal FROM obs GROUP BY 1, 2) a
  LEFT JOIN
    (SELECT ticker, fold, '[' || string_agg('{{"date":"' || {DAY} || '","mode":"' || mode || '","status":"' || status || '"'
            || coalesce(',"net_return":' || (CAST(floor(net_return * 1e6 + 0.5) AS DECIMAL(18, 0)) * 0.000001), '') || '}}', ',' ORDER BY timestamp, mode) || ']' AS future_outcomes
     FROM fold_trade GROUP BY 1, 2) b USING (ticker, fold)""", "obs", "fold_trade")
