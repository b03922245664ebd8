"""Tables with several readers in a query are made once."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, scans", [("snk_twin_json", 2), ("scr_attribute", 1), ("val_attach", 0), ("rev_resolve", 1), ("dlv_map", 0)])
def test_claims_are_not_read_again(spark, name, scans):
    """Scans of lineitem that are left once the shared tables are written."""
    told = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "lineitem" in line for line in told.splitlines()) <= scans
