"""Short lines and templated lines in line deduplication."""

import random

import numpy as np

from fleetlens.llm import lines
from fleetlens.llm.lines import jaccard, line_counts

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def short_pairs(n, seed=1):
    """Pairs of lines of 12 to 40 characters that are just similar enough."""
    chance, out = random.Random(seed), []
    while len(out) < n:
        a = "".join(chance.choice(LETTERS) for _ in range(chance.randint(12, 39)))
        b = a
        while jaccard(a, b + "x") >= 0.8 and len(b) < 40:
            b += chance.choice(LETTERS)
        if a != b and jaccard(a, b) >= 0.8:
            out.append((a, b))
    return out


def test_short_similar_lines_are_found(spark):
    pairs = short_pairs(1500)
    docs = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    kept = [r.kept_lines for r in line_counts(docs).collect()]
    missed = sum(k == 2 for k in kept) / len(pairs)
    print("missed", missed)
    assert len(kept) == len(pairs) and missed <= 0.004


def test_bands_of_short_lines_are_selective():
    chance, shared = random.Random(2), 0
    for _ in range(400):
        # Ten shingles each, two of them the same.
        a, b = ("".join(chance.choice(LETTERS) for _ in range(8)) for _ in range(2))
        keys = lines.band_keys(["postedbyyo" + a, "postedbyyo" + b])
        shared += (keys[0] == keys[1]).any()
    print("shared", shared / 400)
    assert shared <= 4


def test_a_key_of_many_lines_is_one_entry_of_its_bucket():
    names = [f"a heading with a long common part that all of these lines have, number {i:03d}" for i in range(300)]
    batch = lines._pack(list(range(300)), names, 4)
    entries = [np.frombuffer(r["entries"], lines._ENTRY) for r in batch.to_pylist() if r["bucket"] < 4]
    assert max(np.unique(np.concatenate(entries)["key"], return_counts=True)[1]) == 1


def test_templated_lines_make_few_pairs_and_none_is_lost(spark, monkeypatch):
    chance = random.Random(3)
    word = lambda n: "".join(chance.choice(LETTERS) for _ in range(n))
    texts = ["this heading is the same for all and was posted by " + word(22) for _ in range(500)]
    texts += [t[:-1] + "_" for t in texts[:40]] + [t + word(4) for t in texts[20:60]]
    compared = []

    def counted(pairs, *rest, plain=lines._verified):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(lines, "_verified", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sum(r.kept_lines for r in line_counts(docs).collect())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    print("compared", compared)
    assert kept == sum(find(i) == i for i in range(len(texts)))
    assert sum(compared) <= 40 * len(texts)
