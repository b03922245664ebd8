"""Registered queries against DuckDB on the smallest data (the full set: ``python -m workload.check``)."""

import duckdb  # noqa: F401
import pandas as pd
import pytest

import __spark_entry__ as entry
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ("src_reject_split", "src_line_chunk", "cln_flags", "er_clean_value", "er_candidate_brand", "tax_classify", "ext_physical", "nrm_dispatch",
          "ret_fallback", "clm_best", "cnf_detect", "xsr_compare", "val_bounds", "scr_product", "rev_apply", "rev_prev_value", "dsc_long", "dlv_triplets", "cat_list")


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF).toPandas(), connect(SF).execute(entry.oracle_sql()[name]).df()) == ""


def test_comparison_sees_differences():
    a = pd.DataFrame({"x": [1, 2], "y": ["a", "b"]})
    assert compare(a, a.iloc[::-1]) == "" and compare(a, a.assign(y=["a", "c"])) and compare(a, a.iloc[:1]) and compare(a, a.rename(columns={"x": "z"}))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
