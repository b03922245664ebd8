"""Language ID in two steps: a family of languages first, then one-versus-one linear SVMs within it.

Families are learned: languages are joined, nearest mean n-gram vectors first, until about the square root of their number is
left. A linear SVM for each family (against the others), and one for each pair of languages of a family, is trained in a task of its
own on a sample of about ``PER_LANG`` texts a language (``PER_LANG_FAMILY`` for the family step), chosen by a hash of the row;
only weights come to the driver, of one size for each model. Whole texts are scored by matrix products.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing can be learned; with one
language every text with letters is of it; a null id is not held out and is not learned from; rows with null lang are predicted
only; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stage
from shelfmark.llm.features import BUCKETS, text_features
from shelfmark.llm.tokens import Reader

PER_LANG, PER_LANG_FAMILY, EPOCHS, COST, STEEP = 400, 100, 30, 10.0, 3.0


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights, bias last, of a linear SVM with squared hinge loss, by dual coordinate descent (Hsieh et al. 2008)."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    each = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1))) * cost
    diagonal = (x * x).sum(1) + 1 / (2 * each)
    a, w, rng = np.zeros(len(y)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            step = (1 - y[i] * (x[i] @ w) - a[i] / (2 * each[i])) / diagonal[i]
            new = max(0.0, a[i] + step)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def families(means: dict[str, np.ndarray]) -> list[list[str]]:
    """Average-link groups of languages, about the square root of their number."""
    groups = [[k] for k in sorted(means)]
    near = {(a, b): float(means[a] @ means[b] / max(np.linalg.norm(means[a]) * np.linalg.norm(means[b]), 1e-12)) for a in means for b in means}
    while len(groups) > max(1, round(len(means) ** 0.5)):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: np.mean([near[a, b] for a in groups[p[0]] for b in groups[p[1]]]))
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def learn(rows: DataFrame) -> tuple[list[list[str]], dict[tuple, np.ndarray]]:
    """Families, and weights by ("family", k) and (language, language). ``rows``: lang and text to learn from."""
    different = rows.select("lang", F.xxhash64("text", "lang").alias("h")).distinct()
    counts = {r["lang"]: r["n"] for r in different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], {}
    of = F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col("lang"))

    def vectors(batches):
        reader = Reader("space")
        for batch in batches:
            for at, x in text_features(batch.column("text"), True, reader):
                yield pa.record_batch({"lang": batch.column("lang").slice(at, len(x)), "place": batch.column("place").slice(at, len(x)),
                                       "x": pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())})

    # about PER_LANG different texts a language: a hash of the text below the wanted share; copies of one count once
    some = rows.withColumn("place", F.pmod(F.xxhash64("text", "lang"), of)).where(F.col("place") < PER_LANG).groupBy("lang", "place", "text").agg(F.count(F.lit(1)).alias("copies"))
    some = stage(some.select("lang", "place", "text").mapInArrow(vectors, "lang string, place long, x binary"), "vectors")
    unpack = lambda x: np.frombuffer(b"".join(x), np.float32).reshape(-1, BUCKETS)

    def mean(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [g["lang"].iloc[0]], "x": [unpack(g["x"]).mean(0).astype(np.float32).tobytes()]})

    means = {r["lang"]: np.frombuffer(r["x"], np.float32) for r in some.groupBy("lang").applyInPandas(mean, "lang string, x binary").collect()}
    groups = families(means)
    todo = [(f"f{k}", x, 1 if x in g else -1, PER_LANG_FAMILY) for k, g in enumerate(groups) for x in sorted(means)] if len(groups) > 1 else []
    pairs = [(a, b) for g in groups for a, b in combinations(g, 2)]
    todo += [(f"p{k}", x, s, PER_LANG) for k, (a, b) in enumerate(pairs) for x, s in ((a, 1), (b, -1))]
    if not todo:
        return groups, {}

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["lang", "place", "x"])
        return pd.DataFrame({"model": [g["model"].iloc[0]], "w": [svm(unpack(g["x"]), g["side"].to_numpy()).tobytes()]})

    plan = rows.sparkSession.createDataFrame(todo, "model string, lang string, side int, most long")
    fitted = some.join(plan, "lang").where("place < most").groupBy("model").applyInPandas(fit, "model string, w binary").collect()
    name = lambda m: ("family", int(m[1:])) if m[0] == "f" else pairs[int(m[1:])]
    return groups, {name(r["model"]): np.frombuffer(r["w"], np.float64) for r in fitted}


def sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(STEEP * margin, -50, 50)))


def decide(x: np.ndarray, groups, weights) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each row: chance of the family, times mean chance against the family's other languages."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    by_family = np.stack([sure(x @ weights["family", k]) for k in range(len(groups))], 1) if len(groups) > 1 else np.ones((len(x), 1))
    family = by_family.argmax(1)
    out, score = np.empty(len(x), object), by_family.max(1)
    for k, g in enumerate(groups):
        i = np.flatnonzero(family == k)
        votes = np.zeros((len(i), len(g)))
        for a, b in combinations(range(len(g)), 2):
            p = sure(x[i] @ weights[g[a], g[b]])
            votes[:, a] += p
            votes[:, b] += 1 - p
        out[i] = np.array(g, object)[votes.argmax(1)] if len(i) else []
        if len(g) > 1:
            score[i] *= votes.max(1) / (len(g) - 1)
    return out, np.clip(score, 0, 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def identify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score. Learns from rows that aren't held out."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    model = learn(d.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text"))
    known = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        reader = Reader("space")
        for batch in batches:
            groups, weights = known.value
            pred, score = np.full(len(batch), "und", object), np.zeros(len(batch))
            if groups:
                for at, x in text_features(batch.column("text"), True, reader):
                    pred[at:at + len(x)], score[at:at + len(x)] = decide(x, groups, weights)
            letters = np.array([has_letter(t) for t in batch.column("text").to_pylist()], bool)
            pred[~letters], score[~letters] = "und", 0.0
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
