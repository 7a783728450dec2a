"""The status of tables without a key or with repeated rows."""

import __spark_entry__ as entry
from tablesense.catalogue import schema as S


def test_every_given_table_has_a_status(spark, data):
    found = {r.table_name: r.status for r in entry.queries()["triage_status_all"](spark, data).collect()}
    assert set(found) == set(S.GIVEN)
    assert found["lineitem"] == "needs_attention"
