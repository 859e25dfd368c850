"""The corpus queries that SQL can express against DuckDB, on the small tables."""

import os

import pytest

from docloom.llm.sql import SQL
from tests.test_entry import SF, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    compare(spark, name)
