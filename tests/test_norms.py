"""Different values are normalised once, and looked up by the rows that hold them."""

from shelfmark.functions import units
from shelfmark.operators import claims as cl

ROWS = [(1, "voltage", "24 V", "A", 1), (1, "voltage", "24 volts", "B", 2), (1, "voltage", None, "A", 3), (2, "current", "500 mA", "A", 4),
        (2, "current", "0.5 A", "B", 5), (2, None, "0.5 A", None, 6), (3, "dimensions", " 3 x 4 in", "A", 7), (3, "dimensions", "3 x 4 in", "A", 8), (3, "poles", "", "B", 9)]


def _claims(spark):
    return spark.createDataFrame(ROWS, "product_id int, attribute string, value string, source_name string, claim_ord int")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_looked_up_forms_are_the_same(spark):
    d = _claims(spark)
    known = units.norms(d.unionByName(d))
    assert known.count() == len({r[1:3] for r in ROWS})
    assert _rows(units.with_norm(d, known=known)) == _rows(units.with_norm(d))
    assert _rows(cl.conflicts(d, known=known)) == _rows(cl.conflicts(d))
    assert _rows(cl.compare_sources(d, known=known)) == _rows(cl.compare_sources(d))
