from __future__ import annotations

import pytest
from compare import spark_rows, sql_rows

from quillon import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns, wanted = sql_rows(catalog.oracle_sql()[name], sf_dir)
    assert sorted(df.columns) == columns
    assert wanted, "the comparison says nothing"
    assert spark_rows(df) == wanted


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
