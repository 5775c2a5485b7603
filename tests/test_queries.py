"""Every query of the core against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from notefold.plans import registry
from notefold.session import shipped
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(name, spark, duck):
    df = shipped(registry.QUERIES[name])(spark, SF)
    if name in registry.ORACLES:
        same_rows(df, duck, registry.ORACLES[name])
    else:
        df.collect()


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() >= 0
