"""Ranked lexical search against scoring everything, and the accumulator limit."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import lexical
from fleetlens.llm.lexical import lexical_top_k, rank_item

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for d, c in counts:
            m = 10 + 90 * c.total() * n_docs // total
            score = 0
            for t in wanted:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if none else d, -score))
    return sorted(out, key=str)


def search(spark, docs, items, **more):
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS).repartition(3)
    found = lexical_top_k(df, spark.createDataFrame(items, ITEMS), **more).collect()
    return sorted(map(tuple, found), key=str)


def corpus(seed, docs, words):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(rng.choices([f"t{i}" for i in range(words)], weights, k=rng.randrange(1, 120))) for _ in range(docs)]
    items = [(i, " ".join(rng.choices([f"t{j}" for j in range(words)], k=25))) for i in range(15)]
    return list(enumerate(texts)), items


@pytest.mark.parametrize("shard", [300, 5000, 2_000_000])
def test_equals_scoring_everything(spark, monkeypatch, shard):
    """Whatever the size of a shard; the smallest ones hold a text each."""
    docs, items = corpus(1, 300, 400)
    docs += [(1000 + i, items[0][1]) for i in range(25)]  # ties
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    assert search(spark, docs, items) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(2, 80, 200)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    assert search(spark, docs, items, k=3) == brute(docs, items, 3)


def test_stated_cases(spark):
    docs = [
        (5, "Alpha beta_gamma"),
        (4, "alpha BETA gamma"),  # ties with 5
        (4, "alpha BETA gamma"),  # a row of its own
        (None, "alpha beta gamma"),
        (6, None),
        (7, ""),
        (8, "-- !! "),
        (9, "Ärger 東京 x1"),
        (10, "alpha " * 50_000),
        (11, "rare"),
    ]
    items = [(1, "ALPHA, alpha"), (2, "Ärger"), (3, "ärger"), (4, None), (5, ""), (6, "unheard"),
             (7, "gamma"), (7, "rare"), (None, "東京 beta")]
    assert search(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(3, 5, 20)
    assert search(spark, [], items) == []
    assert search(spark, docs, []) == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, term int, score int")
    items = spark.createDataFrame([(1, "a c", 4)], "item_id long, text string, doc_id int")
    assert [tuple(r)[:3] for r in lexical_top_k(docs, items).collect()] == [(1, 1, 1)]


def test_accumulators_are_limited_and_survivors_exact():
    """Once ten documents hold the rare terms, the frequent ones create no accumulator."""
    size = 5000
    rare, common = np.arange(0, 5000, 250), np.arange(size)
    impacts = [np.full(len(rare), 700_000), np.full(len(rare), 650_000), np.full(size, 400_000)]
    weights = np.array([9000, 9000, 100])
    at, scores, accumulators = rank_item(np.arange(3), weights, impacts, [rare, rare, common], size, 10, 0)
    assert accumulators == len(rare)
    assert set(at) == set(rare)
    assert set(scores.tolist()) == {9000 * 1_350_000 + 100 * 400_000}


def test_an_equal_bound_still_creates():
    """A document that can only tie with the k-th one may have the smaller doc_id."""
    at, scores, _ = rank_item(
        np.arange(2), np.array([10, 10]), [np.array([50]), np.array([50])], [np.array([3]), np.array([1])], 5, 1, 0
    )
    assert sorted(at.tolist()) == [1, 3] and scores.tolist() == [500, 500]
