"""Small rule tables as local relations.

A local relation has exact size statistics, so the optimizer broadcasts it by
its own threshold and falls back to a shuffled join when a caller's table is big.
No join in this package forces a broadcast hint.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
          "boolean": pa.bool_()}


def rule_table(spark: SparkSession, rows: list[tuple], **columns: str) -> DataFrame:
    """``rule_table(spark, [(1, "a")], ord="int", key="string")``."""
    data = list(zip(*rows)) if rows else [[] for _ in columns]
    arrays = [pa.array(list(v), type=_ARROW[t]) for v, t in zip(data, columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))
