"""Tables that are small only in their files are not sent to the driver and every task."""

import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("query", ["undocumented_units", "covered_modules", "unit_fragment_matches"])
def test_keys_cut_from_parts_are_not_broadcast(spark, query):
    found = queries()[query](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
