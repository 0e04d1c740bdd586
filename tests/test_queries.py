"""Every registered query against its SQL, on the smallest data."""

import os
import re

import pytest

from tests.helpers import explain
from verification.check import connect, differences
from verification.oracle import ORACLE_SQL
from verification.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
# These round to three digits as part of the result. The smallest data has a mean
# that is an exact half there, which depends on the order of adding up.
ROUNDED = {"dom13_legacy_comparison_table", "dom14_legacy_comparison_mixed_codes"}
UNWANTED = ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def databases():
    return {folder: connect(folder) for folder in (FOLDER, LARGER)}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, databases, name):
    folder = LARGER if name in ROUNDED else FOLDER
    df = QUERIES[name](spark, folder)
    plan = explain(df)
    assert not [word for word in UNWANTED if word in plan]
    for window in re.findall(r"\(\d+\) Window\n.*?\n\n", plan, re.S):
        keys = re.search(r"Arguments: .*\], \[([^\]]*)\]", window)
        assert keys and keys.group(1), f"window over everything: {window}"
    assert differences(df, databases[folder], ORACLE_SQL[name]) is None
