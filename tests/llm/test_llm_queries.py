"""Every query of the subpackage runs on the smallest tables and again gives the same rows."""

import pytest

from folio.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() == len(df.collect()) > 0
