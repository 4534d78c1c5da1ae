"""The named queries on the smallest tables, against their SQL twins if any."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from twins import DATA, assert_twin, connect  # noqa: E402

from grafloom.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    if name in queries.SQL:
        assert_twin(df, connect(), queries.SQL[name])
    else:
        assert df.count() >= 0
