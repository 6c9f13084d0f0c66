"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest

from checks import all_queries
from checks.compare import check, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = check(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert result["status"] == "ok", result


def test_every_operator_is_covered():
    from checks.coverage import missing

    assert missing() == []
