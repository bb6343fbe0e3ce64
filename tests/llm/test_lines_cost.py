"""What line deduplication compares and writes."""

import random

import numpy as np

from fleetlens.llm import lines
from fleetlens.llm.lines import jaccard, line_counts, similar


def test_similar_is_jaccard():
    rng = random.Random(4)
    x, y = [], []
    for n in [3, 8, 9, 10, 12, 20, 60, 200, 900] * 30:
        a = [rng.choice("abcdeé ") for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(0, 2 + n // 60)):
            b[rng.randrange(n)] = rng.choice("xyz")
        x.append("".join(a))
        y.append("".join(b) + rng.choice(["", "q", "qq"]))
    expected = [jaccard(a, b) >= 0.8 for a, b in zip(x, y, strict=True)]
    assert similar(x, y, 0.8).tolist() == expected and 0 < sum(expected) < len(expected)


def test_lenders_asked_one_by_one_are_those_of_the_rank(monkeypatch):
    texts = ["".join(random.Random(i).choices("abcdef", k=9 + i % 70)) for i in range(200)]
    one = lines.signatures(texts)
    monkeypatch.setattr(lines, "WALK", 1)
    assert np.array_equal(one, lines.signatures(texts))


def test_shingles_of_lines_apart_are_not_written(spark, monkeypatch):
    """Only the rarest shingles are: a fifth of them, about."""
    rows = {}

    def watched(df, name, plain=lines.save):
        out = plain(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "save", watched)
    monkeypatch.setattr(lines, "CENTRES", 0)
    rng = random.Random(5)
    template = "a heading with a long common part that all of these lines have in front of their own "
    docs = [(i, template + " ".join(rng.choice(["red", "blue", "green", "ochre"]) for _ in range(9))) for i in range(120)]
    list(line_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    shingles = sum(len({t[i : i + 9] for i in range(len(t) - 8)}) for _, t in docs)
    assert "shingles" not in rows and 0 < rows["rare"][0] < shingles / 3
