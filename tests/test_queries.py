"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from oracle import all_sql
from tidemark.plans import all_queries
from tests.conftest import SMALL
from tools.check import TABLES, compare

NAMES = ("bars_lineitem", "clean_bars", "audit_summary", "features_all", "signals", "combination", "folds", "frequency", "exclusions",
         "walkforward", "outcomes_excess", "barrier_non_overlapping", "event_context", "prior_visits", "context_as_of", "return_summary",
         "trade_groups", "concentration_top5", "diag_groups", "spearman", "histogram", "boundary_view", "training_selection", "frontier",
         "plateaus", "exit_efficiency", "paired_uncertainty", "scorecard", "decision_records", "coverage", "record_digest", "scan_universe", "scan_requests",
         "snapshot_refusals", "validate_faulty_bars", "ticker_payload", "signal_invariants_faulty", "decision_checks_faulty", "context_checks",
         "ledger_checks_faulty", "stop_target_distribution", "dip_events_wide", "barrier_non_overlapping_wide", "feat_callback")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, db, name):
    assert compare(entry_points.queries()[name](spark, SMALL), db.sql(entry_points.oracle_sql()[name])) == ""
