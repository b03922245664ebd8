"""Quality by nearest neighbours among labelled latent-semantic vectors.

About ``PER_LABEL`` labelled texts of each label (chosen by a hash of the row) give a latent space of ``RANK`` directions: the main
singular directions of their hashed n-gram counts and shape figures. The labelled vectors and the projection have a fixed size and are
broadcast. For every document all cosines with the labelled vectors are computed, in blocks of documents, and the labels of the
``NEIGHBOURS`` nearest are weighted by similarity; nothing is searched approximately.

Cases: a null or empty text is scored like any other, from its shape; label rows that are null, or of documents that don't exist, are not
used; a document with several labels counts with their least; a null id is not held out and is not learned from; without labels
every score is 1 (nothing is known against a text); repeated rows get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfmark.llm.features import BUCKETS, SHAPE, text_features
from shelfmark.llm.languages import held_out, learnable
from shelfmark.llm.tokens import Reader

PER_LABEL, RANK, NEIGHBOURS, CUT, SHAPE_WEIGHT = 1000, 48, 15, 0.3, 0.5


COLUMNS_AT_ONCE = 256


def weighted(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x[:, BUCKETS:] *= SHAPE_WEIGHT
    return x


def latent_space(x: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(centre, projection) on the main singular directions, from the smaller Gram matrix.

    It is summed over blocks of columns, so the driver holds no copy of ``x`` in double precision."""
    centre = x.mean(0)
    block = lambda at: (x[:, at:at + COLUMNS_AT_ONCE] - centre[at:at + COLUMNS_AT_ONCE]).astype(np.float64)
    starts = range(0, x.shape[1], COLUMNS_AT_ONCE)
    gram = np.zeros((len(x), len(x)))
    for at in starts:
        c = block(at)
        gram += c @ c.T
    values, u = np.linalg.eigh(gram)
    del gram
    keep = [k for k in np.argsort(values)[::-1][:rank] if values[k] > 1e-9]
    u = u[:, keep] / np.sqrt(values[keep])
    return centre, np.vstack([block(at).T @ u for at in starts]).astype(np.float32)


def unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def vote(z: np.ndarray, labelled: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest; ties go to the earlier labelled vector."""
    near = z @ labelled.T
    k = min(k, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(near, at, 1).min(1, keepdims=True)
    # rows where more vectors are as similar as the last one than were taken
    for row in np.flatnonzero((near >= last).sum(1) > k):
        at[row] = np.argsort(-near[row], kind="stable")[:k]
    weight = np.maximum(np.take_along_axis(near, at, 1), 1e-6)
    return np.clip((weight * labels[at]).sum(1) / weight.sum(1), 0, 1)


def vectors(batches):
    reader = Reader("space")
    for batch in batches:
        for at, x in text_features(batch.column("text"), False, reader):
            yield pa.record_batch({"label": batch.column("label").slice(at, len(x)), "h": batch.column("h").slice(at, len(x)),
                                   "x": pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame):
    """(centre, projection, labelled vectors, their labels); None without labels."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    marks = marks.where(learnable(F.col("doc_id")))
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("label IN (0, 1)").collect()}
    if not counts:
        return None
    of = F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col("label"))
    some = marks.where("label IN (0, 1)").withColumn("h", F.xxhash64("doc_id")).where(F.pmod("h", of) < PER_LABEL)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("label", "h", "text")  # some: about 2 * PER_LABEL rows
    # a document that comes several times counts once
    rows = rows.groupBy("label", "h").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = rows.mapInArrow(vectors, "label int, h long, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["label"], r["h"], r["x"]))
    marks = np.array([r["label"] for r in got], np.float32)
    x = np.empty((len(got), BUCKETS + SHAPE), np.float32)
    # the driver holds the vectors once: a row goes as soon as it is taken over
    for k in range(len(got)):
        x[k] = np.frombuffer(got[k]["x"], np.float32)
        got[k] = None
    x[:, BUCKETS:] *= SHAPE_WEIGHT
    centre, project = latent_space(x)
    x -= centre
    return centre, project, unit(x @ project), marks


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` added (or put in place of a column of that name)."""
    known = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    docs = docs.drop("score")
    names = docs.columns

    def score(batches):
        reader = Reader("space")
        for batch in batches:
            out = np.ones(len(batch))
            if known.value is not None:
                centre, project, labelled, marks = known.value
                for at, x in text_features(batch.column("text"), False, reader):
                    out[at:at + len(x)] = vote(unit((weighted(x) - centre) @ project), labelled, marks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "score"])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(d, labels).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
