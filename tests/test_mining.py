"""Mining is dealt out by key, and texts that a pattern can't match in are not read by it."""

from pyspark.sql import functions as F

from shelfmark.operators import extract

TEXTS = ['4-1/2" x .045 x 7/8" disc', "2X4 stud", "3 × .5 in", '5/8"', "10' rope", '6\' x 8"', "no sizes, exact", "box x", 'P40 x 3 grit', "1 x 2 x 3 pack", "", None]


def test_rows_are_dealt_out_before_they_are_mined(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        feed = spark.range(400).coalesce(1).select(F.col("id").alias("product_id"), F.lit('3" x 4"').alias("text"), F.lit("A 1").alias("part_number"))
        long = extract.explode_facts(feed, "product_id", extract.dimension_facts(F.col("text"), F.col("part_number")))
        assert long.select(F.spark_partition_id()).distinct().count() > 1
        plan = extract.dedupe_facts(long)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_guards_lose_no_match(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "product_id int, text string").withColumn("part_number", F.lit("10 20"))
    facts = lambda: [tuple(r) for r in extract.explode_facts(d, "product_id", extract.dimension_facts(F.col("text"), F.col("part_number"))).orderBy("product_id", "ord").collect()]
    guarded, names = facts(), ("HAS_BY", "HAS_INCH", "HAS_FOOT")
    kept = [getattr(extract, n) for n in names]
    try:
        for n in names:
            setattr(extract, n, "")
        assert guarded == facts() and len({r[0] for r in guarded}) == 6
    finally:
        for n, v in zip(names, kept):
            setattr(extract, n, v)
