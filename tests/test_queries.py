"""Registered queries against their checking SQL on the smallest tables.

A few of each family by default; FULL_CHECK=1 runs all of them.
"""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points

SOME = [
    "cpp_functions", "cobol_paragraphs", "java_classes", "rust_functions", "cpp_globals", "segments", "file_summaries",
    "rule_results", "rule_violations", "payroll", "stock_after_sales", "event_labels", "transition_check", "state_fold",
    "segment_state", "latest_events", "assembled_files", "rewrite_cpp_transform", "rewrite_cpp_hard", "rewrite_cobol",
    "rewrite_java", "construct_census", "prompts", "clean_responses", "folder_totals", "fixed_width_records",
    "state_at", "state_table", "copybook_tree", "copybook_records",
]
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
NAMES = sorted(ORACLES) if os.environ.get("FULL_CHECK") else SOME


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, int) and not isinstance(value, bool):
        return f"{float(value):.6g}" if abs(value) < 10**6 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    result = tables.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(plain(v) for v in row) for row in result.fetchall())
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
