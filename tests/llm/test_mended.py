"""Samples of any table, rare languages, ids of any size, and stars without a centre."""

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import toxicity
from fleetlens.llm.components import connected_components
from fleetlens.llm.language import identify_language
from fleetlens.llm.lm import score_documents
from fleetlens.llm.sampling import hash_limit
from fleetlens.llm.simhash import _emit, _meet, simhash_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("count", [10, 1000, 10**6, 10**11, 10**15])
def test_limits_draw_as_many_rows_from_any_table(count):
    limit = hash_limit(1000, count)
    share = (limit + 2**63 + 1) / 2**64
    assert share == pytest.approx(min(1, 1000 / count), rel=1e-9)
    assert -(2**63) <= limit < 2**63
    assert share * count >= min(count, 999)


def test_a_rare_language_is_learned(spark):
    """5 documents of 4000: a sample of 300 from the whole would rarely hold enough of them."""
    rng = np.random.default_rng(1)
    common = ["the cat and the dog run over there with them", "when they think that this thing is there"]
    rare = ["щука живёт в воде быстро плывёт", "вода чиста и рыба сыта всегда"]
    rows = [(i, " ".join(rng.permutation(common[i % 2].split())), "en", "s", 1) for i in range(4000)]
    # Fold 1 of 3 is held out; a few ids of the others.
    rows += [(10_000 + i, " ".join(rng.permutation(rare[i % 2].split()).tolist() * 3), "ru", "s", 1) for i in range(15)]
    found = identify_language(spark.createDataFrame(rows, DOCS), most=300).where("doc_id >= 10000").collect()
    assert {r.lang_pred for r in found} == {"ru"}


def test_scores_for_ids_of_any_size(spark):
    ids = [2**62, -(2**62) - 5, 2**63 - 1, -(2**63), 0, None, None]
    rows = [(d, "some words here" if i % 2 else "other words there", "en", "s", 1) for i, d in enumerate(ids)]
    found = score_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(d) for d in ids)
    assert all(r.n_tokens == 4 and r.base_score < 0 and r.score < 0 for r in found)


def test_no_link_through_a_missing_centre():
    """Two fingerprints 4 apart, both within 3 of all ones, which is no fingerprint here."""
    ones = np.uint64(2**64 - 1)
    pair = np.array([ones ^ np.uint64(0b11001), ones ^ np.uint64(0b111)], dtype=np.uint64)
    assert np.bitwise_count(pair[0] ^ pair[1]) == 4
    batch = pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64))], names=["fp"])
    for part in _emit(1)(iter([batch])):
        links = _meet(pa.Table.from_batches([part]))
        assert links.num_rows == 0


def test_empty_texts_link_to_fingerprints_near_zero(spark):
    found = simhash_components(spark.createDataFrame([(1, None, "e", "s", 1), (2, "", "e", "s", 1)], DOCS)).collect()
    assert {r.component_id for r in found} == {1}


def test_components_of_hubs_chains_and_loops(spark):
    edges = [(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000), (499, 1040)]
    edges += [(3000 + i % 7, 3007 + i) for i in range(100)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    want = {x: find(x) for x in root if find(x) != x}
    assert {r.node: r.root for r in connected_components(df).collect()} == want


def test_toxic_rows_leave_a_large_batch_in_small_slices():
    """One batch of 8 MB goes back in slices of about 1 MB: the worker and the JVM hold no second one."""
    texts = ["you are an idiot. " * 20, "a mild word. " * 300, None, "", "x" * 2_500_000] + ["fine. " * 100] * 9000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    grammar = toxicity.Grammar(toxicity.seed_symbols(), frozenset(), [0.9] * 8, 0.1)
    parts = list(toxicity._clean(grammar, 1, 0.3)(iter([batch, batch.slice(0, 0)])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, len(texts)))
    assert len(parts) >= 5 and max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts) < 3_600_000
