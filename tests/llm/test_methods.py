"""The methods themselves, without Spark, against plain computations."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fleetlens.llm import language, lm
from fleetlens.llm.components import forest
from fleetlens.llm.lines import SKETCH, band_keys, jaccard, normal_line, shingle_hashes, signatures
from fleetlens.llm.packing import plan_lengths
from fleetlens.llm.simhash import fingerprint_texts, steps
from fleetlens.llm.tokens import WordEncoder
from fleetlens.llm.toxicity import Grammar, clause_contexts, compose, seed_symbols
from fleetlens.llm.words import split_words, xxh64

TEXTS = [
    "",
    " \n\t ",
    "one",
    "Two  words\x0b",
    "The quick BROWN fox; it's 12,5% \"quoted\" don't I'LL",
    "Größe ÉCOLE straße İstanbul ΣΑΣ   x́ 日本語 \x01\x00 <|endoftext|> a<|startoftext|>b",
    "w" * 300 + " end",
    "\n".join(f"line {i} of text" for i in range(40)),
]
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(LOWER))


def test_words_and_hashes():
    words = split_words([t.encode() for t in TEXTS])
    found = [
        [words.text(i) for i in range(words.first[t], words.first[t + 1])] for t in range(len(TEXTS))
    ]
    assert found == [plain_words(t) for t in TEXTS]
    every = [w for text in found for w in text]
    assert xxh64(words.data, words.start, words.length).tolist() == [
        xxhash.xxh64_intdigest(w, 42) for w in every
    ]


def test_encoder_gives_the_tokenizers_ids():
    encoder = WordEncoder(limit=20)
    for text in TEXTS * 2:
        plain = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain
    assert encoder.encode(None) == b""


def plain_fingerprint(text):
    words = plain_words(text)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    found = fingerprint_texts([t.encode() for t in TEXTS]).tolist()
    assert found == [plain_fingerprint(t) for t in TEXTS]


def test_balls_meet_for_every_distance_up_to_three():
    masks, few = steps()
    chance = random.Random(1)
    for _ in range(300):
        a = chance.getrandbits(64)
        b = a
        for bit in chance.sample(range(64), chance.randint(1, 3)):
            b ^= 1 << bit

        def ball(x):
            return {x ^ int(m) for m in (masks if x.bit_count() % 2 else masks[:few])}

        assert ball(a) & ball(b)


def test_forest():
    a, b = forest(np.array([5, 4, 9, 7]), np.array([4, 3, 8, 9]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {4: 3, 5: 3, 8: 7, 9: 7}
    assert len(forest(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def best_packing(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for at in {b: n for n, b in enumerate(bins)}.values():
            if bins[at] + lengths[i] <= capacity:
                place(i + 1, [*bins[:at], bins[at] + lengths[i], *bins[at + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_whole_and_near_the_best(seed):
    chance = random.Random(seed)
    capacity = chance.choice([10, 17, 30])
    lengths = sorted((chance.randint(1, capacity) for _ in range(9)), reverse=True)
    histogram = {x: lengths.count(x) for x in lengths}
    plan = plan_lengths(histogram, capacity)
    held = {}
    for length, count, first, offset in plan.placed:
        for s in range(first, first + count):
            held.setdefault(s, []).append((offset, length))
    assert sorted(x for parts in held.values() for _, x in parts) == sorted(lengths)
    assert sorted(held) == list(range(plan.sequences))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    best = best_packing(lengths, capacity)
    assert best <= plan.sequences <= best + 1


def test_bands_find_nearly_all_similar_lines():
    chance = random.Random(3)
    words = ["".join(chance.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    missed = total = 0
    for _ in range(400):
        line = [chance.choice(words) for _ in range(40)]
        other = list(line)
        other[chance.randrange(40)] = chance.choice(words)
        a, b = " ".join(line), " ".join(other)
        if jaccard(a, b) >= 0.8:
            keys = band_keys([a, b])
            total += 1
            sketch = signatures([a, b]).astype(np.uint8)
            missed += not (keys[0] == keys[1]).any() or (sketch[0] == sketch[1]).mean() < SKETCH
    assert total > 100 and missed <= total * 0.01
    value, owner = shingle_hashes(["short", "x", "a line that is long enough", "short"])
    assert np.bincount(owner).tolist() == [1, 1, 18, 1] and value[0] == value[-1] != value[1]
    twice, _ = shingle_hashes(["abcdefghi abcdefghi"])
    assert len(twice) == 11 and twice[0] == twice[10] and len(set(twice.tolist())) == 10
    assert band_keys(["short", "x"]).shape == (2, 20)
    assert normal_line("  A \t B ") == "a b"


def test_grammar_reads_clauses():
    to, out, contexts = compose()
    machine = (to.tolist(), out.tolist())
    grammar = Grammar(seed_symbols(), frozenset({"zork"}), [], 0.1)

    def read(text):
        return [[contexts[c] for c in clause] for clause in clause_contexts(text, grammar, machine)]

    assert read("You are an idiot") == [[("insult", "targeted")]]
    assert read("such an IDIOT") == [[("insult", "plain")]]
    assert read("not an idiot. idiot") == [[("insult", "negated")], [("insult", "plain")]]
    assert read("she said that idiot") == [[("insult", "reported")]]
    assert read("not one of these four was an idiot") == [[("insult", "targeted")]]
    assert read("we kill them") == [[("threat", "plain")]]
    assert read("zorkish zork idiots'") == [[("insult", "plain"), ("insult", "plain")]]
    assert read("") == read("fine weather") == []


def numeric(loss, array, at, step=1e-5):
    old = array[at]
    array[at] = old + step
    up = loss()
    array[at] = old - step
    down = loss()
    array[at] = old
    return (up - down) / (2 * step)


def test_gradients_through_time():
    chance = np.random.default_rng(0)
    weights = language.new_weights(3, 4, chance)
    data, label = chance.integers(0, 256, (6, 5)).astype(np.uint8), chance.integers(0, 3, 5)
    _, g = language.gradients(weights, data, label)
    for name, array in weights.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), array.shape)
        told = numeric(lambda: language.gradients(weights, data, label)[0], array, at)
        assert told == pytest.approx(g[name][at], rel=1e-3)


def test_attention_gradients():
    chance = np.random.default_rng(0)
    w = lm.new_weights(7, chance)
    w["mask"] = lm.causal_mask(np.float64)
    inputs, target = chance.integers(0, 50, (3, lm.WINDOW)), chance.integers(0, 7, (3, lm.NEW))
    new = chance.random((3, lm.NEW)) < 0.8
    _, g, (used, g_embed) = lm.gradients(w, inputs, target, new)
    whole = np.zeros_like(w["embed"])
    whole[used] = g_embed
    for name, gradient in (g | {"embed": whole}).items():
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        told = numeric(lambda: lm.gradients(w, inputs, target, new)[0], w[name], at)
        assert told == pytest.approx(gradient[at], rel=1e-3), name


@pytest.mark.parametrize("n", [1, 23, 24, 25, 48, 100])
def test_windows_score_each_id_once(n):
    ids = np.arange(1, n + 1)
    inputs, targets, new = lm.windows(ids)
    assert targets[new].tolist() == ids.tolist()
    assert inputs[:, lm.WINDOW - lm.NEW :][new].tolist() == [lm.END, *ids[:-1].tolist()]


def test_states_do_not_see_later_ids():
    chance = np.random.default_rng(0)
    w = lm.new_weights(7, chance)
    w["mask"] = lm.causal_mask(np.float64)
    inputs = chance.integers(0, 50, (1, lm.WINDOW))
    other = inputs.copy()
    other[0, -1] = 77
    a, b = lm.hidden(w, inputs), lm.hidden(w, other)
    assert np.allclose(a[0, :-1], b[0, :-1]) and not np.allclose(a[0, -1], b[0, -1])


def test_all_pairs_within_radius_are_connected_like_brute_force():
    from fleetlens.llm.simhash import _emit, _meet

    import pyarrow as pa

    chance = random.Random(5)
    values = set()
    for _ in range(12):
        centre = chance.getrandbits(64)
        for _ in range(8):
            x = centre
            for bit in chance.sample(range(64), chance.randint(0, 4)):
                x ^= 1 << bit
            values.add(x)
    fps = np.array(sorted(values), dtype=np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])
    packed = pa.Table.from_batches(list(_emit(4)([batch])))
    edges = []
    for bucket in range(4):
        part = packed.filter(pa.compute.equal(packed["bucket"], bucket))
        found = _meet(part)
        edges += list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))

    def parts(links):
        root = {int(x): int(x) for x in fps.view(np.int64)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in root}

    near = [
        (int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64)))
        for a, b in combinations(sorted(values), 2)
        if (a ^ b).bit_count() <= 3
    ]
    assert parts(edges) == parts(near)
