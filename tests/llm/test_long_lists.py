"""A large group of loose copies: few of its pairs are made, and none with the similarity is lost."""

import random

from shelfmark.llm import jaccard
from tests.llm.test_operators import same, sql


def test_loose_copies_of_one_text_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(140)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rng.sample(range(140), rng.randint(3, 5)):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    made, verified = [], jaccard.verified
    monkeypatch.setattr(jaccard, "LONG", 8)
    monkeypatch.setattr(jaccard, "verified", lambda pairs, members: (made.append(pairs.count()), verified(pairs, members))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(jaccard.near_groups(docs), sql(jaccard.SQL, documents=docs))
    assert sum(made) < 5000, made
