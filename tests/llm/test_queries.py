"""Every query of the llm operators against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from notefold.llm import queries
from notefold.session import shipped
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(name, spark, duck):
    df = shipped(queries.QUERIES[name])(spark, SF)
    if name in queries.ORACLES:
        same_rows(df, duck, queries.ORACLES[name])
    else:
        df.collect()
