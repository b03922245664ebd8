"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every source gets whole copies of its documents (target div size) and, for what is left, the documents whose hash is at most a
threshold. The threshold is found from sums of words by (source, leading hash digits): the bucket in which the sum passes what
is left is refined by its next digits, level by level, and only its documents are read again. Nothing is sorted; a source that
holds most rows is only ever summed, with partial sums before the shuffle.

Cases: a null text has size 0; a null source is a source of its own and comes last; sources without words get target 0; repeated
rows share one hash and are taken together; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACES, stage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
DIGITS = 3  # hex digits to a level: 4096 buckets a source
LEVELS = 4
WIDE = "decimal(38,0)"


def word_count(text):
    bare = F.btrim(text, F.lit("\t\n\x0b\x0c\r "))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of every row."""
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds each source's place in code point order, null last, counted from 0; counts of range partitions carry it across tasks."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = stage(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    ahead = parts.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("ahead")
    return parts.join(ahead, "part").withColumn("place", place).drop("part", "ahead")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, copies, left_over, unit): what is left of the target is left_over / unit words.

    Shares by weight; a source stops at ``most`` times its size, and what it can't take is shared by weight among the others,
    until none is above. Each round is one sum; exact in whole numbers.
    """
    at = F.col("place") % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("long")
    s = stage(ranked(sizes).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most), "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    left, unit, full = total, 1, F.lit(False)
    while True:
        a = s.where(~full).agg(F.sum("weight")).first()[0] or 0
        used = s.where(full).agg(F.sum("limit")).first()[0] or 0
        if (left, unit) == (total - used, a):
            break
        left, unit = total - used, a
        full = F.col("limit").cast(WIDE) * F.lit(unit).cast(WIDE) <= F.lit(left).cast(WIDE) * F.col("weight").cast(WIDE)
        if not unit:
            full = F.lit(True)
            break
    share, unit = F.lit(left).cast("long") * F.col("weight"), max(unit, 1)
    copies = F.when(full, F.when(F.col("source_size") > 0, most).otherwise(0)).otherwise(
        F.expr(f"CAST({left} * weight AS BIGINT) div (CAST({unit} AS BIGINT) * greatest(source_size, 1))")).cast("long")
    rest = share.cast(WIDE) - copies.cast(WIDE) * F.col("source_size").cast(WIDE) * F.lit(unit).cast(WIDE)
    return s.select("source", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(share.cast("double") / F.lit(float(unit))).alias("target"),
                    copies.alias("copies"), F.when(full, 0).otherwise(rest).cast(WIDE).alias("left_over"), F.lit(unit).cast(WIDE).alias("unit"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, cut): documents with h <= cut are taken once more than the whole copies."""
    bound = stage(goals.where("source_size > 0").select("source", "left_over", "unit", F.lit("").alias("lead"), F.lit(0).cast("long").alias("before")), "bound")
    by = Window.partitionBy("source")
    for level in range(1, LEVELS + 1):
        inside = rows.join(bound.select(F.col("source").alias("s"), "lead"), F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, DIGITS * (level - 1)) == F.col("lead")), "left_semi")
        sums = inside.groupBy("source", F.substring("h", 1, DIGITS * level).alias("b")).agg(F.sum("size").alias("size")).select(F.col("source").alias("s"), "b", "size")
        upto = sums.join(bound, F.col("s").eqNullSafe(F.col("source"))).withColumn("through", F.col("before") + F.sum("size").over(by.orderBy("b")))
        at = upto.where("(through - size) * unit <= left_over AND left_over < through * unit")
        bound = stage(at.select("source", "left_over", "unit", F.col("b").alias("lead"), (F.col("through") - F.col("size")).alias("before")), f"bound{level}")
    inside = rows.join(bound.select(F.col("source").alias("s"), "lead"), F.col("source").eqNullSafe(F.col("s")) & F.col("h").startswith(F.col("lead")) & (F.substring("h", 1, DIGITS * LEVELS) == F.col("lead")), "left_semi")
    sums = inside.groupBy("source", "h").agg(F.sum("size").alias("size")).select(F.col("source").alias("s"), "h", "size")
    upto = sums.join(bound, F.col("s").eqNullSafe(F.col("source"))).withColumn("through", F.col("before") + F.sum("size").over(by.orderBy("h")))
    # the last hash belongs to the mix if that comes nearer to the target
    last = F.max(F.when(F.expr("(2 * through - size) * unit <= 2 * left_over"), F.col("h")))
    return upto.groupBy("source", "lead").agg(last.alias("h")).select("source", F.coalesce("h", "lead").alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, h, source_size, target, taken) for every row of ``docs``; taken / size copies of it go in the mix."""
    rows = stage(measured(docs), "measured")
    goals = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "goals")
    cuts = thresholds(rows, goals)
    plan = goals.select(F.col("source").alias("s"), "source_size", "target", "copies").join(cuts.select(F.col("source").alias("c"), "cut"), F.col("s").eqNullSafe(F.col("c")), "left").drop("c")
    once = F.when(F.col("h") <= F.coalesce("cut", F.lit("")), 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("taken", F.col("size") * (F.col("copies") + once)).drop("s", "copies", "cut")


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS weight, 3 * source_size::HUGEINT AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, row_number() OVER k AS k, sum(cap) OVER k - cap AS used, sum(weight) OVER () - sum(weight) OVER k + weight AS open
      FROM w WINDOW k AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
first_open AS (SELECT total - used AS rest, open AS unit, k FROM o WHERE cap * open > (total - used) * weight ORDER BY k LIMIT 1),
g AS (SELECT o.source, source_size, CASE WHEN f.k IS NULL OR o.k < f.k THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / unit::DOUBLE END AS target,
    CASE WHEN f.k IS NULL OR o.k < f.k THEN CASE WHEN source_size > 0 THEN 3 ELSE 0 END ELSE (rest * weight) // (unit * source_size) END AS copies,
    CASE WHEN f.k IS NULL OR o.k < f.k THEN 0 ELSE (rest * weight) % (unit * source_size) END AS left_over, coalesce(unit, 1) AS unit
    FROM o LEFT JOIN first_open f ON TRUE),
hs AS (SELECT source, h, sum(size) AS size FROM sized GROUP BY ALL),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS through FROM hs),
cut AS (SELECT c.source, max(h) AS cut FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE (2 * through - size) * unit <= 2 * left_over GROUP BY c.source)
SELECT d.doc_id, d.size, g.source_size, g.target, (d.size * (copies + CASE WHEN h <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""
