"""MinHash near-dedup against all pairs of full sets."""

import random

import numpy as np
import pytest

from fleetlens.llm import minhash
from fleetlens.llm.minhash import band_keys, minhash_components, shingle_sets, sketches, star_pairs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ") if w]
    if len(words) < 2:
        return frozenset(words)
    return frozenset(zip(words, words[1:], strict=False))


def brute(docs):
    """doc_id -> (set size, smallest doc_id reachable); doc_ids are distinct."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(spark, docs):
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in docs], DOCS)
    found = minhash_components(df).collect()
    want = brute(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("length", [6, 15, 60, 400])
def test_near_copies_at_all_distances(spark, length):
    """Edits around the threshold, so many pairs lie just on either side of it, and chains."""
    rng = random.Random(length)
    docs, number = [], 0
    for group in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        chain = base
        for _ in range(8):
            chain = edited(chain, rng.randrange(1 + length // 12), rng)
            docs.append((number, " ".join(chain)))
            docs.append((number + 1, " ".join(edited(base, rng.randrange(1 + length // 8), rng))))
            number += 2
    rng.shuffle(docs)
    check(spark, docs)


def test_a_crowd_of_half_similar_texts(spark):
    """All share a boilerplate, so they meet in buckets without being linked; some are linked."""
    rng = random.Random(5)
    frame = [f"f{i}" for i in range(40)]
    docs = []
    for i in range(150):
        own = [f"o{i}-{j}" for j in range(14)]
        docs.append((2 * i, " ".join(frame + own)))
        if i % 10 == 0:
            docs.append((2 * i + 1, " ".join(frame + edited(own, 2, rng))))
    check(spark, docs)


def test_stated_cases(spark):
    docs = [
        (7, "One two THREE"),
        (3, "one  two\tthree"),
        (9, None),
        (1, ""),
        (2, " \n "),
        (4, "word"),
        (6, "WORD "),
        (5, "Ünï Ünï"),
        (8, "ünï ünï"),  # only A-Z are lower-cased
        (10, "long " * 100_000),
        (11, "long long"),
    ]
    check(spark, docs)


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c", 1, 2), (5, "a b c", 1, 2), (5, "a b c", 1, 2), (None, None, 1, 2), (None, "x y", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, key int")
    found = sorted(map(tuple, minhash_components(df).collect()), key=str)
    assert found == sorted(
        [(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True), (None, 1, None, True)],
        key=str,
    )
    assert minhash_components(spark.createDataFrame([], DOCS)).count() == 0


def test_densified_bins_agree_like_the_sets():
    """Also where there are far fewer shingles than bins."""
    rng = random.Random(3)
    for size in (5, 40, 300, 3000):
        agree = []
        for _ in range(20):
            base = [f"a{rng.random()}" for _ in range(size)]
            other = base[: -max(size // 5, 1)]
            pair = [" ".join(x).encode() for x in (base, other)]
            hashes, edge = shingle_sets(pair, 1)
            keys = band_keys(hashes, edge)
            agree.append(float((keys[0] == keys[1]).mean()))
        similar = len(other) / size
        assert abs(np.mean(agree) - similar**minhash.BAND) < 0.06, size


def test_walk_and_rank_choose_the_same_bin(monkeypatch):
    texts = [" ".join(f"q{i * 7 % 50 + j}" for j in range(n)).encode() for i, n in enumerate((2, 3, 9, 40, 700))]
    hashes, edge = shingle_sets(texts)
    first = band_keys(hashes, edge)
    monkeypatch.setattr(minhash, "WALK", 0)
    assert (band_keys(hashes, edge) == first).all()
    monkeypatch.setattr(minhash, "WALK", minhash.BINS)
    assert (band_keys(hashes, edge) == first).all()


def test_pairs_are_stars(spark):
    """A group of similar texts gives a number of pairs in proportion to it."""
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base, f"x{i}"]), None, None, 1) for i in range(400)]
    sets = sketches(spark.createDataFrame(docs, DOCS).repartition(3)).withColumnRenamed("doc_id", "row")
    assert star_pairs(sets).count() < 400 * 8
