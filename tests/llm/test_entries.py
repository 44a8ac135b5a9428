"""Registered queries: their SQL, their names, and empty or one-row tables."""

import pytest

import __spark_entry__ as entry
from compare import differences, oracle
from spreadloom.llm.entries import CHECKS, QUERIES


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_agrees_with_sql(spark, sf_dir, name):
    verdict = differences(name, spark, oracle(sf_dir), sf_dir)
    assert verdict.startswith("ok") and not verdict.endswith("(0)"), verdict


def test_every_operator_is_registered():
    numbered = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbered == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())
