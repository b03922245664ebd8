"""Review decisions arriving one by one.

``decisions`` is the append-only log, which no batch reads again. What it amounts to is kept as folded effects per attribute, in
buckets by product: ``snapshot/bucket=b/upto=B`` and the ``delta/bucket=b/batch_id=B`` that came since. A batch adds a delta to the
buckets it touches and reads those buckets only; a bucket with more than ``compact_after`` deltas is folded into a new snapshot.
So the files that a batch reads are bounded by the buckets it touches, however long the log is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import review
from shelfmark.sources.store import overwrite_partitions, remove_folder, subfolders

DECISION_SCHEMA = ("product_id bigint, attribute string, action string, selected_value string, reason string, "
                   "ts timestamp_ntz, decision_id bigint")


class ReviewState:
    """Folded decisions of a folder.  The number of buckets is part of the folder's name, so it can't change under the files.

    Effects merge by maximum and minimum: a batch that is done again, or a delta left beside the snapshot that holds it
    (after a kill in the middle of a compaction), changes nothing. One writer at a time; read between runs."""

    def __init__(self, spark: SparkSession, out: str, buckets: int = 64, compact_after: int = 8):
        self.spark, self.buckets, self.compact_after = spark, buckets, compact_after
        self.folder = f"{out}/state_{buckets}"

    def bucket(self, product: str = "product_id") -> Column:
        return F.pmod(F.xxhash64(product), F.lit(self.buckets)).cast("int")

    def _deltas(self, b: int) -> list[str]:
        return [f"{self.folder}/delta/bucket={b}/{x}" for x in subfolders(self.spark, f"{self.folder}/delta/bucket={b}")]

    def _snapshots(self, b: int) -> list[str]:
        """Oldest first."""
        names = sorted(subfolders(self.spark, f"{self.folder}/snapshot/bucket={b}"), key=lambda x: int(x.split("=")[1]))
        return [f"{self.folder}/snapshot/bucket={b}/{x}" for x in names]

    def paths(self, buckets: list[int] | None = None) -> list[str]:
        """Folders that hold the state of these buckets: the newest snapshot of each and its deltas."""
        return [p for b in (range(self.buckets) if buckets is None else buckets) for p in self._snapshots(b)[-1:] + self._deltas(b)]

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """Merged effects, None where there are none yet."""
        paths = self.paths(buckets)
        return review.merge_folds(self.spark.read.parquet(*paths)) if paths else None

    def add(self, usable: DataFrame, batch_id: int) -> list[int]:
        """The buckets that the batch touches, after its effects are added to them."""
        part = review.partial_fold(usable).withColumn("bucket", self.bucket()).withColumn("batch_id", F.lit(batch_id))
        # one file a bucket
        overwrite_partitions(part.repartition("bucket"), f"{self.folder}/delta", "bucket", "batch_id")
        # no more numbers than buckets
        touched = [r.bucket for r in usable.select(self.bucket().alias("bucket")).distinct().collect()]
        self.compact([b for b in touched if len(self._deltas(b)) > self.compact_after], batch_id)
        return touched

    def compact(self, buckets: list[int], upto: int) -> None:
        """New snapshots of these buckets; what they hold goes after they are written."""
        old = {b: (self._snapshots(b), self._deltas(b)) for b in buckets}
        if not any(deltas for _, deltas in old.values()):
            return
        state = self.read(buckets).withColumn("bucket", self.bucket())
        # never over a snapshot that is being read
        number = max([upto, *(int(s[-1].rsplit("=", 1)[1]) + 1 for s, _ in old.values() if s)])
        overwrite_partitions(state.withColumn("upto", F.lit(number)).repartition("bucket"), f"{self.folder}/snapshot", "bucket", "upto")
        for snapshots, deltas in old.values():
            for p in snapshots + deltas:
                remove_folder(self.spark, p)


def decision_writer(out: str, attributes: Callable[[], DataFrame], conflicts: Callable[[], DataFrame], buckets: int = 64, compact_after: int = 8) -> Callable[[DataFrame, int], None]:
    """Appends the batch to the log and its effects to the state, then rewrites the touched products.

    Results come from the base tables and the state, so the order in which decisions arrive and repeated batches do not matter.
    Decisions that can't be used go to ``rejected`` with a reason."""

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = f"{out}/decisions/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(log)
        usable, rejected = review.split_decisions(spark.read.schema(batch.schema).parquet(log))
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch_id={batch_id}")
        state = ReviewState(spark, out, buckets, compact_after)
        touched = state.add(usable, batch_id)
        if not touched:
            return
        products = usable.select("product_id").distinct()
        effects = review.folded(state.read(touched).join(products, "product_id", "left_semi"))
        a = attributes().join(products, "product_id", "left_semi")
        c = conflicts().join(products, "product_id", "left_semi")
        review.apply_folded(a, effects).write.mode("overwrite").parquet(f"{out}/attributes/batch_id={batch_id}")
        review.close_folded(c, effects).write.mode("overwrite").parquet(f"{out}/conflicts/batch_id={batch_id}")

    return process


def run_reviews(stream: DataFrame, out: str, checkpoint: str, attributes, conflicts, buckets: int = 64, compact_after: int = 8):
    query = (stream.writeStream.foreachBatch(decision_writer(out, attributes, conflicts, buckets, compact_after))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def current(base: DataFrame, out: str, table: str, buckets: int = 64) -> DataFrame:
    """``base`` (``attributes`` or ``conflicts``) under all decisions so far, from the state alone."""
    state = ReviewState(base.sparkSession, out, buckets).read()
    if state is None:
        return base
    apply = {"attributes": review.apply_folded, "conflicts": review.close_folded}[table]
    return apply(base, review.folded(state)).select(*base.columns)
