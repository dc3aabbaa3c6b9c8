from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, row string, score double, lo binary, sid string, item_ids string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and columns named like the operators' own."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [(1, "a b c"), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, long), (7, passage), (8, f"Start here {passage} end"), (8, f"Start here {passage} end"), (None, passage), (None, None), (9, "x"), (10, "Ünïcode ß \x0b ﬁ Ω 😀 <|endoftext|> \u00a0 end"), (11, "x " * 50), (12, "|" * 3000)]
    return spark.createDataFrame([(i, t, None if k % 2 else "en", "r", None, b"z", "s", None) for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="session")
def mixed(spark):
    """Random documents of few words with copies, near copies and shared passages."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs, shared = [], make(40)
    base = [make(rng.randint(1, 150)) for _ in range(60)]
    for i in range(160):
        w = list(rng.choice(base)) if i % 2 else make(rng.randint(0, 60))
        for _ in range(rng.choice([0, 0, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        if i % 9 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = shared
        docs.append((rng.randrange(10**6), " ".join(w)))
    return spark.createDataFrame(list(dict(docs).items()), "doc_id long, text string").repartition(5)
