"""A maintained index of chunks with their vectors, in a folder all executors see.

Every change is a numbered step. ``add`` writes a part where the chunks are, without a shuffle, their vectors computed once and kept as whole
numbers and a length; ``delete`` writes the documents that go as tombstones; ``clear`` writes a step that ends everything before it.
Files are never changed, a step counts once its folder is complete, and a reader sees the steps there are when it starts. Reading merges them: of chunks
with one id the last step stays, and chunks of steps before a tombstone of their document are left out. ``compact`` writes what is read as a new base in
files of even size and ends what came before, so reads stay as cheap as the number of steps since. One writer at a time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.functions.embedding import hashed_counts, length_of, unit_vector
from shelfmark.operators.retrieve import named_chunks


class ChunkIndex:
    """Index of chunk rows (evidence_id, document_id, product_id, text, embedding, ...) below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, dim: int = 128):
        self.spark, self.folder, self.dim = spark, folder, dim
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _steps(self) -> list[tuple[int, str]]:
        """(number, kind) of the complete steps since the last that ends what came before."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        steps = sorted((int(n.split("-")[0]), n.split("-")[1]) for n in names if "-" in n and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))
        last = max((k for k, (_, kind) in enumerate(steps) if kind in ("base", "clear")), default=0)
        return steps[last:]

    def _next(self, kind: str) -> str:
        """Folder of a new step; numbers of incomplete steps are not used again."""
        taken = [0]
        if self._fs.exists(self._path(self.folder)):
            taken += [int(s.getPath().getName().split("-")[0]) for s in self._fs.listStatus(self._path(self.folder)) if "-" in s.getPath().getName()]
        return f"{self.folder}/{max(taken) + 1:09d}-{kind}"

    def _write(self, rows: DataFrame, kind: str) -> None:
        path = self._next(kind)
        if kind in ("add", "base"):
            known = self._schema()
            if known is None:
                self.spark.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.text(f"{self.folder}/schema")
            else:
                rows = rows.select(*known.names)
            (rows if kind == "add" else rows.hint("rebalance")).write.parquet(path)
        else:
            rows.write.parquet(path)

    def add(self, chunks: DataFrame) -> None:
        """Chunks with their vectors; blank ones are left out, known ids replaced."""
        d = named_chunks(chunks).withColumn("counts", hashed_counts(F.col("text"), self.dim))
        self._write(d.withColumn("length", length_of(F.col("counts"))), "add")

    def delete(self, documents: DataFrame) -> None:
        """All chunks of ``documents(document_id)`` that are there now go."""
        self._write(documents.select("document_id").distinct(), "delete")

    def clear(self) -> None:
        self._write(self.spark.range(0).toDF("document_id"), "clear")

    def compact(self) -> None:
        """The same content as one step."""
        if self._schema() is not None:
            self._write(self._merged(), "base")

    def _schema(self) -> StructType | None:
        path = f"{self.folder}/schema"
        if not self._fs.exists(self._path(f"{path}/_SUCCESS")):
            return None
        return StructType.fromJson(json.loads(self.spark.read.text(path).first()[0]))

    def read(self) -> DataFrame:
        """The chunks there are, with unit vectors."""
        d = self._merged()
        return d.withColumn("embedding", unit_vector(F.col("counts"), F.col("length"))).drop("counts", "length")

    def _merged(self) -> DataFrame:
        schema = self._schema()
        if schema is None:
            raise ValueError(f"no chunk was ever added to {self.folder}")
        steps = self._steps()
        parts = [(n, kind) for n, kind in steps if kind in ("add", "base")]
        rows = None
        for n, kind in parts:
            part = self.spark.read.schema(schema).parquet(f"{self.folder}/{n:09d}-{kind}").withColumn("step", F.lit(n))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        if len(parts) > 1:
            # the step that holds an id last; only ids are shuffled for that, rows of replaced chunks are few
            last = rows.groupBy("evidence_id").agg(F.max("step").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("evidence_id", "last")
            rows = rows.join(last, "evidence_id", "left").where("last IS NULL OR step = last").drop("last")
        gone = None
        for n, kind in steps:
            if kind == "delete":
                some = self.spark.read.parquet(f"{self.folder}/{n:09d}-{kind}").select(F.col("document_id").alias("gone"), F.lit(n).alias("gone_at"))
                gone = some if gone is None else gone.unionByName(some)
        if gone is not None:
            rows = rows.join(gone, (F.col("document_id") == F.col("gone")) & (F.col("step") < F.col("gone_at")), "left_anti")
        return rows.drop("step")

    def counts(self) -> DataFrame:
        """One row: n_chunks, n_documents."""
        if self._schema() is None:
            return self.spark.sql("SELECT 0L AS n_chunks, 0L AS n_documents")
        d = self._merged().groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        return d.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_chunks"), F.count("document_id").alias("n_documents"))
