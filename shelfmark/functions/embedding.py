"""Hashed bag-of-words vectors.

Tokenising runs in the JVM. One Arrow UDF hashes each different word and pair of a batch once and adds up
their buckets in a single numpy bincount. Weights are multiples of a half, so vectors can be kept as small whole numbers.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

try:  # starts in half the time of that of hashlib, which is most of it for short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
WORD_WEIGHT = 1.0
PAIR_WEIGHT = 1.5


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_pairs(words: Column) -> Column:
    """Adjacent words joined by ``_``."""
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(words, rest, lambda a, b: F.concat(a, F.lit("_"), b))
    return F.filter(pairs, lambda p: p.isNotNull())


def bucket(token: Column, dim: int) -> Column:
    """The token's 128-bit md5 modulo ``dim``, folded 32 bits at a time."""
    digest = F.md5(token)
    step = (1 << 32) % dim
    out = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        part = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        out = (out * step + part) % dim
    if dim & (dim - 1) == 0 and dim <= 1 << 32:  # only the last bits matter
        out = F.conv(F.substring(digest, 25, 8), 16, 10).cast("bigint") % dim
    return out.cast("int")


def _buckets(tokens: list[bytes], dim: int) -> np.ndarray:
    """The 128-bit md5 of each token modulo ``dim``, from its two halves at once."""
    digests = np.frombuffer(b"".join([md5(t).digest() for t in tokens]), ">u8").reshape(-1, 2).astype(np.uint64)
    d = np.uint64(dim)
    return ((digests[:, 0] % d * np.uint64((1 << 64) % dim) + digests[:, 1] % d) % d).astype(np.int64)


def _counts(words: pa.Array, dim: int) -> np.ndarray:
    """Twice the weight of each bucket, a row for each list of words."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(words), 0).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known, code = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    out = np.bincount(row * dim + _buckets(known, dim)[code], minlength=len(words) * dim) * int(2 * WORD_WEIGHT)
    i = np.flatnonzero(row[1:] == row[:-1])
    pairs = pa.array(code[i] * max(len(known), 1) + code[i + 1]).dictionary_encode()
    first, second = np.divmod(pairs.dictionary.to_numpy(), max(len(known), 1))
    told = [known[a] + b"_" + known[b] for a, b in zip(first.tolist(), second.tolist())]
    out += np.bincount(row[i] * dim + _buckets(told, dim)[pairs.indices.to_numpy()], minlength=len(words) * dim) * int(2 * PAIR_WEIGHT)
    return out.reshape(-1, dim)


def _vectors_of_keys(dim: int):
    """A row of non-zero buckets and weights for each key; rows of a key stand together, also over batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(keys: pa.Array, total: np.ndarray) -> pa.RecordBatch:
            total = total / 2.0
            rows, buckets = np.nonzero(total)
            weights = total[rows, buckets] / np.sqrt((total * total).sum(1))[rows]
            ends = pa.array(np.searchsorted(rows, np.arange(len(total) + 1)).astype(np.int32))
            return pa.RecordBatch.from_arrays([keys, *[pa.ListArray.from_arrays(ends, pa.array(v)) for v in (buckets.astype(np.int32), weights)]], names=["key", "bucket", "weight"])

        held = None
        for batch in batches:
            keys = batch.column(0)
            if not len(keys):
                continue
            new = pa.compute.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], new]))
            total, keys = np.add.reduceat(_counts(batch.column(1), dim), first, axis=0), keys.take(pa.array(first))
            if held is not None:
                if held[0][0] == keys[0]:
                    total[0] += held[1][0]
                else:
                    yield told(*held)
            if len(keys) > 1:
                yield told(keys.slice(0, len(keys) - 1), total[:-1])
            held = keys.slice(len(keys) - 1), total[-1:]
        if held is not None:
            yield told(*held)

    return run


def sparse_vectors(df: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """Long form ``(key, bucket, weight)`` of unit vectors; texts of one key make one vector.

    Texts are shuffled once, by key. Words and buckets never are."""
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key IS NOT NULL").repartition("key").sortWithinPartitions("key")
    kind = d.schema["key"].dataType.simpleString()
    rows = d.select("key", tokens(F.col("text"))).mapInArrow(_vectors_of_keys(dim), f"key {kind}, bucket array<int>, weight array<double>")
    return rows.select(F.col("key").alias(key), F.inline(F.arrays_zip("bucket", "weight")))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def hashed_counts(text: Column, dim: int = 128) -> Column:
    """Twice the weights of a text's buckets, before they are made a unit vector."""

    @F.arrow_udf("array<int>")
    def count(words: pa.Array) -> pa.Array:
        return _lists(_counts(words, dim).astype(np.int32))

    return count(tokens(text))


def length_of(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def unit_vector(counts: Column, length: Column) -> Column:
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0)))


def dense_vector(text: Column, dim: int = 128, element: str = "double") -> Column:
    """Unit vector of a text as an array column."""

    @F.arrow_udf(f"array<{element}>")
    def pack(words: pa.Array) -> pa.Array:
        total = _counts(words, dim).astype(np.float64)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        return _lists(np.divide(total, norm, out=total, where=norm > 0).astype(np.float32 if element == "float" else np.float64))

    return pack(tokens(text))


def query_vector(text: str, dim: int = 128) -> dict[int, float]:
    """Non-zero entries of a search phrase's unit vector (driver side, one phrase)."""
    words = re.findall(r"\w+", text.lower())
    weights: dict[int, float] = defaultdict(float)
    for token, weight in [(w, WORD_WEIGHT) for w in words] + [
            (f"{a}_{b}", PAIR_WEIGHT) for a, b in zip(words, words[1:])]:
        weights[int(hashlib.md5(token.encode()).hexdigest(), 16) % dim] += weight
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {b: w / norm for b, w in sorted(weights.items())} if norm else {}


def similarity(vector: Column, query: dict[int, float]) -> Column:
    """Dot product with a known query, unrolled over its non-zero entries, in 0..1."""
    if not query:
        return F.lit(0.0)
    terms = [F.get(vector, F.lit(i)).cast("double") * F.lit(w) for i, w in query.items()]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms)))


def unit(vector: list[float]) -> dict[int, float]:
    """Dense query vector normalised to the sparse form used here."""
    norm = math.sqrt(sum(v * v for v in vector))
    return {i: v / norm for i, v in enumerate(vector) if v} if norm else {}
