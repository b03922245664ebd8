"""What the optimizer sends to all tasks goes through the driver, so it must be small in memory, not in its file."""

from pyspark.sql import functions as F

from shelfmark.plans.session import tune
from shelfmark.sources.store import Staging


def test_a_small_file_is_not_taken_for_a_small_table(spark):
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    tune(spark)
    stored = Staging(spark).keep(spark.range(1_000_000).select("id", *[F.md5((F.col("id") % 100).cast("string")).alias(c) for c in "ab"]).coalesce(2), "stored")
    large = spark.range(3_000_000)
    told = large.join(stored, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in told
    few = Staging(spark).keep(stored.where("id < 100"), "few")
    assert "BroadcastExchange" in large.join(few, "id")._jdf.queryExecution().executedPlan().toString()


def test_operators_of_training_data_keep_file_sizes(spark):
    import __spark_entry__ as entry

    for name, factor in (("op12_fill_in_middle", "1.0"), ("cln_flags", "10.0")):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == factor
