"""Registered queries against their SQL on the smallest tables, and the registry itself."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry
from groundwork import queries
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_subpackage():
    code = """
import importlib.util as u, sys
real = u.find_spec
u.find_spec = lambda name, *a: None if name in ("groundwork.llm", "corpus_pipeline") else real(name, *a)
import __spark_entry__ as e
assert "fact_lookup" in e.queries() and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert not [m for m in sys.modules if m.startswith("groundwork.llm")]
"""
    subprocess.run([sys.executable, "-c", code], check=True)
