"""Every registered query against its DuckDB statement."""

import re

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()
NAMES = sorted(n for n in queries() if not re.fullmatch(r"op\d+_.*|pipeline", n))  # those have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    if name not in SQL:
        lines = queries()[name](spark, SF).collect()  # report_lines: numbered without gaps below each heading, one title a repository
        places = [(r.repo_id, r.line_no) for r in lines]
        assert len(set(places)) == len(places) and sum(r.line.startswith("# ") for r in lines) == len({p for p, _ in places}) == 7
        return
    ok, detail = compare(spark, con, SF, name, queries()[name], SQL[name])
    assert ok, detail


def test_entry(spark):
    assert entry(spark).count() > 0
