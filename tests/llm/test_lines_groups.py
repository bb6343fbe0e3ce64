"""How lines are read, and groups of lines that one centre does not connect."""

import random

from fleetlens.llm import lines
from fleetlens.llm.components import connected_components
from fleetlens.llm.lines import jaccard, line_counts, normal_line, normal_lines

from test_disk import roots


def test_later_links_join_components(spark):
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21), (5, 6)], [(3, 11), (21, 30), (40, 41), (30, 4)]
    table = lambda edges: spark.createDataFrame(edges, "a long, b long")
    found = lines._merged(connected_components(table(first)), table(more))
    assert sorted(map(tuple, found.collect())) == roots(first + more)


def test_normal_lines_are_those_of_single_lines():
    texts = ["A  b\tc\n\n x \nΣΑΣ\nÉ\xa0é z\r\n", "", " lead", "trail ", "a\x1cb\n", "İx\nς", "One\ntwo THREE\n\nΟΔΟΣ", "\n", "a b\n c"]
    for text in texts:
        assert normal_lines(text) == [normal_line(x) for x in text.split("\n")]


def test_small_groups_are_compared_without_shingles_of_all(spark, monkeypatch):
    """All pairs of a group of up to 64 lines that are apart, and none by shingles in common."""

    def fails(*_):
        raise AssertionError("rare shingles were joined")

    monkeypatch.setattr(lines, "_sharing_rare_shingles", fails)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(60)]
    base, texts = [rng.choice(words) for _ in range(40)], []
    for _ in range(50):
        own = [rng.choice(words) if rng.random() < 0.06 else w for w in base]
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sum(r.kept_lines for r in line_counts(docs).collect())
    distinct = sorted(set(texts))
    pairs = [(i, j) for j in range(len(distinct)) for i in range(j) if jaccard(distinct[i], distinct[j]) >= 0.8]
    assert 0 < len(pairs) < len(distinct) * (len(distinct) - 1) // 2
    assert kept == len(distinct) - len(roots(pairs))
