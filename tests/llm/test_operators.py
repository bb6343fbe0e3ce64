"""The operators on small tables with nulls, empty and repeated rows, against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fleetlens.llm.language import identify_language
from fleetlens.llm.licenses import scan_licenses
from fleetlens.llm.lines import jaccard, line_counts, normal_line, without_repeated_lines
from fleetlens.llm.lm import score_documents
from fleetlens.llm.mixing import mix_documents, mixed_corpus
from fleetlens.llm.packing import pack_documents
from fleetlens.llm.permutation import permutation_neighbours
from fleetlens.llm.simhash import fingerprint_texts, keep_one_of_each, simhash_components
from fleetlens.llm.threshold import exact_top_k
from fleetlens.llm.tokens import WordEncoder
from fleetlens.llm.toxicity import toxicity, without_toxic
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest driver table and the rows that real tables should not have but do."""
    long = " ".join(f"word{i % 977}" for i in range(9000))
    odd = [
        (None, "no id here", "en", "s1", 1),
        (None, None, None, None, None),
        (5001, None, "en", None, 0),
        (5002, "", None, "s1", 0),
        (5003, " \n\t", "de", "s2", 3),
        (5004, long, "en", "s2", None),
        (5004, long, "en", "s2", None),
        (5005, "12 34 !!", "fr", "s1", 8),
    ]
    extra = spark.createDataFrame(odd, DOCS)
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """With columns that have the operators' own names."""
    for name in ("row", "_row", "doc", "kept", "lines", "fp", "copies", "n", "rank", "size", "score"):
        df = df.withColumn(name, F.lit(7))
    return df


def test_packing(documents, nothing):
    rows = pack_documents(clashing(documents), with_ids=True).collect()
    encoder = WordEncoder()
    expected = Counter()
    for r in documents.collect():
        raw = encoder.encode(r.text) + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(raw), 8192)):
            part = raw[at : at + 8192]
            expected[r.doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    held = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // 2048) + 1
    assert pack_documents(nothing).count() == 0


def components(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def test_simhash(documents, nothing):
    rows = simhash_components(clashing(documents)).collect()
    texts = documents.collect()
    prints = fingerprint_texts([(r.text or "").encode() for r in texts]).tolist()
    distinct = sorted(set(prints))
    near = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 3]
    of = components(distinct, near)
    least = defaultdict(list)
    for r, p in zip(texts, prints, strict=True):
        least[of[p]] += [] if r.doc_id is None else [r.doc_id]
    expected = Counter(
        (r.doc_id, f"{p:016x}", min(least[of[p]], default=None)) for r, p in zip(texts, prints, strict=True)
    )
    assert Counter(tuple(r) for r in rows) == expected
    assert simhash_components(nothing).count() == 0
    kept = keep_one_of_each(clashing(documents))
    assert kept.columns == clashing(documents).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(min(v) for v in least.values() if v)
    assert len(ids) == len(least)
    assert keep_one_of_each(nothing).count() == 0


def brute_lines(documents):
    lines = [
        (r.doc_id, at, normal_line(raw))
        for r in sorted(documents, key=lambda r: r.doc_id)
        for at, raw in enumerate((r.text or "").split("\n"))
    ]
    lines = [x for x in lines if x[2]]
    distinct = sorted({x[2] for x in lines})
    similar = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if close(a, b)]
    of = components(distinct, similar)
    seen, kept = set(), defaultdict(list)
    for doc, at, line in lines:
        if of[line] not in seen:
            seen.add(of[line])
            kept[doc].append(at)
    return Counter(x[0] for x in lines), kept


def close(a, b):
    return 0.7 < len(a) / len(b) < 1.4 and jaccard(a, b) >= 0.8


def test_lines(spark, nothing):
    base = "the first line of all has quite a number of words, and so one word more or less matters little here"
    texts = [
        (3, f"{base}\n\nanother one"),
        (1, f"{base.replace('quite', 'about')}\nANOTHER   one\n  \nlast"),
        (2, f"{base.replace('little', 'hardly')}\n{base.replace('words', 'terms')}\nlast"),
        (4, None),
        (5, ""),
        (6, "x"),
        (7, "x\nlast\nAnother one"),
    ]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts], DOCS)
    counts, kept = brute_lines(docs.collect())
    rows = {r.doc_id: r for r in line_counts(clashing(docs)).collect()}
    assert {i: r.lines for i, r in rows.items()} == dict(counts)
    assert {i: r.kept for i, r in rows.items()} == {i: kept[i] for i in counts}
    found = {r.doc_id: r for r in without_repeated_lines(clashing(docs)).collect()}
    assert len(found) == len(texts)
    for doc, text in texts:
        want = text
        if doc in counts:
            want = "\n".join(
                raw for at, raw in enumerate(text.split("\n")) if at in kept[doc] or not raw.strip()
            )
        assert found[doc].text == want
        assert found[doc].n_chars == (None if want is None else len(want))
        assert found[doc].kept == 7
    assert line_counts(nothing).count() == 0
    assert without_repeated_lines(nothing).count() == 0


def test_lines_of_the_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    counts, kept = brute_lines(docs.collect())
    rows = {r.doc_id: r.kept for r in line_counts(docs).collect()}
    assert rows == {i: kept[i] for i in counts}


def targets(sizes):
    """Dealing out again and again, as the definition says."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total = sum(sizes.values())
    held, target = set(), {}
    while True:
        open_ = [s for s in order if s not in held]
        rest = total - sum(3 * sizes[s] for s in held)
        target = {s: 3.0 * sizes[s] for s in held}
        target |= {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def test_mixing(documents, nothing):
    rows = mix_documents(clashing(documents)).collect()
    again = mix_documents(documents.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    texts = documents.collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode().split())) for r in texts
    )
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source, size in taken.items():
        assert abs(size - want[source]) <= largest[source] + 2
    assert mix_documents(nothing).count() == 0
    mixed = mixed_corpus(clashing(documents))
    assert mixed.columns == clashing(documents).columns
    found, words = Counter(), defaultdict(int)
    for r in mixed.collect():
        found[r.doc_id] += 1
        words[r.source] += len((r.text or "").encode().split())
    assert all(found[r.doc_id] <= 3 for r in texts if r.doc_id is not None and r.doc_id < 5000)
    for source in sizes:
        assert abs(words[source] - want[source]) <= largest[source]
    assert mixed_corpus(nothing).count() == 0


def test_dominant_source_is_held(spark):
    rows = [(i, "a b c d", None, "big", 0) for i in range(60)]
    rows += [(100 + i, "a b", None, s, 0) for i in range(4) for s in ("x", "y", None)]
    found = mix_documents(spark.createDataFrame(rows, DOCS)).collect()
    target = {r.source: r.target for r in found}
    assert target["x"] == target["y"] == target[None] == 24.0
    assert {r.copies for r in found if r.source != "big"} == {3}


def vectors(spark, n=300, seed=0):
    chance = np.random.default_rng(seed)
    rows = [(i, chance.normal(size=8).round(3).tolist(), 0) for i in range(n)]
    rows[40] = (40, rows[20][1], 0)
    rows += [(1000, None, 0), (1020, [float("nan")] * 8, 0), (1040, [None] * 8, 0), (1060, [0.0] * 8, 0)]
    rows += [(1080, [float("inf")] * 8, 1), (None, [0.1] * 8, 1), (1100, [1.0], 1), (1120, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_search(table, step, k, steps=None):
    rows = [
        (r.vec_id, np.array(r.embedding, dtype=float))
        for r in table.collect()
        if r.embedding and len(r.embedding) == 8 and None not in r.embedding and np.isfinite(r.embedding).all()
    ]
    if steps:
        rows = [(i, np.floor(steps * x)) for i, x in rows]
    else:
        rows = [(i, x) for i, x in rows if x.any()]
    out = {}
    for n, (i, q) in enumerate(rows):
        if i is not None and i % step == 0:
            scored = [(-(x * q).sum(), -1 if j is None else j, j) for m, (j, x) in enumerate(rows) if m != n]
            out[i] = [(j, -s) for s, _, j in sorted(scored, key=lambda t: t[:2])[:k]]
    return out


def results(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return dict(out)


def test_exact_top_k(spark):
    table = vectors(spark)
    found = results(exact_top_k(clashing(table), F.col("vec_id") % 10 == 0))
    assert found == brute_search(table, 10, 5, 256)
    few = table.where("vec_id < 3")
    assert results(exact_top_k(few, F.col("vec_id") % 10 == 0)) == brute_search(few, 10, 5, 256)
    assert exact_top_k(table.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_permutation_index(spark):
    table = vectors(spark)
    want = brute_search(table, 20, 20)
    found = results(permutation_neighbours(clashing(table), F.col("vec_id") % 20 == 0, least=60))
    assert found.keys() == want.keys()
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    all_ranked = results(permutation_neighbours(table, F.col("vec_id") % 20 == 0))
    assert {q: [j for j, _ in v] for q, v in all_ranked.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert permutation_neighbours(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_language(spark, documents, nothing):
    rows = identify_language(clashing(documents)).collect()
    assert len(rows) == documents.count()
    lang = {r.doc_id: r.lang for r in documents.collect()}
    told = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert sum(r.lang_pred == lang[r.doc_id] for r in told) >= 0.95 * len(told)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (5001, 5002, 5003, 5005)} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id)
    assert identify_language(nothing).count() == 0
    none = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify_language(none).collect()} == {"und"}


def test_lm_scores(documents, nothing):
    rows = score_documents(clashing(documents)).collect()
    texts = documents.collect()
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\0end"]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for r in texts if not held(r.doc_id) for w in words(r.text))
    total = sum(counts.values())
    unit = total + 0.5 * (len(counts) + 1)
    expected = Counter()
    for r in texts:
        own = words(r.text)
        base = sum(np.log10((counts[w] + 0.5) / unit) for w in own)
        known = sum(w in counts for w in own)
        expected[r.doc_id, held(r.doc_id), len(own), known, total, round(base, 4)] += 1
    assert Counter((*r[:5], round(r.base_score, 4)) for r in rows) == expected
    assert all(r.score < 0 for r in rows)
    unseen = [r for r in rows if r.held_out and r.n_tokens > 20]
    # Better than a uniform choice of ids by far, even with this little to learn from.
    assert sum(r.score for r in unseen) > -7 * sum(r.n_tokens for r in unseen)
    assert score_documents(nothing).count() == 0


def test_toxicity(spark, documents, nothing):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = toxicity(clashing(documents), labels).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.predicted for r in rows if r.doc_id in (None, 5001, 5002, 5003, 5005)} == {0}
    assert toxicity(nothing, labels).count() == 0
    assert toxicity(documents, labels.where("false")).count() == len(rows)
    kept = without_toxic(clashing(documents), labels)
    assert kept.count() == sum(r.predicted == 0 for r in rows)
    bad = spark.createDataFrame([(1, "You are an idiot and a moron!", "en", "s", 1), (2, "A fine day.", "en", "s", 1)], DOCS)
    assert [r.doc_id for r in without_toxic(bad, labels).collect()] == [2]


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    told = [(found[r.doc_id], r.toxic) for r in labels.collect() if r.toxic is not None and r.doc_id in found]
    unseen = [(r.predicted, t) for r, t in told if r.held_out]
    assert sum(p for p, t in unseen if t == 0) <= 0.02 * len(unseen)
    assert sum(p for p, t in unseen if t == 1) >= 0.5 * sum(t for _, t in unseen)


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.", True),
        ("a/b/c/x.py", "code\nmore code", False),
        ("a/b/LICENSE", "some unrelated words that grant nothing", True),
        ("a/d/LICENSE", "Licensed under the Apache License, Version 2.0.", True),
        ("a/d/e/y.py", None, None),
        ("a/d/e/z.py", "# This work is licensed under the GNU General Public License, version 3.\ncode", False),
        ("q/w.py", "the license of this story is poetic, and the version of it is long and winding", False),
        ("top.py", "", False),
        (None, "Released under the MIT License.", True),
    ]
    files = spark.createDataFrame(rows, "path string, text string, licence_file boolean")
    found = {r.path: (r.licence, r.origin, r.declared_in) for r in scan_licenses(clashing(files)).collect()}
    assert found == {
        "a/LICENSE": ("MIT", "notice", None),
        "a/b/c/x.py": ("MIT", "directory", "a/LICENSE"),
        "a/b/LICENSE": ("MIT", "directory", "a/LICENSE"),
        "a/d/LICENSE": ("Apache-2.0", "notice", None),
        "a/d/e/y.py": ("Apache-2.0", "directory", "a/d/LICENSE"),
        "a/d/e/z.py": ("GPL-3.0", "notice", None),
        "q/w.py": (None, "none", None),
        "top.py": (None, "none", None),
    }
    assert scan_licenses(files.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = after
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and {r.doc_id for r in pieces} <= {r.doc_id for r in docs.collect()}
