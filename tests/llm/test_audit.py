"""The filter audit against counting and averaging over all orders."""

from fractions import Fraction
from itertools import permutations

import pytest

from fleetlens.llm.audit import FILTERS, audit_filters, failures, shapley_weights, solve

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = (
    "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
)


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    judged = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        mask = failures(text.encode())
        same = [d[0] for d in docs if (d[1] or "") == text and d[0] is not None]
        if doc_id is not None and min(same) < doc_id:
            mask |= 16
        judged.append((lang or "", {f for i, f in enumerate(FILTERS) if mask >> i & 1}, doc_id))
    out = []
    for part in {j[0] for j in judged}:
        rows = [(fails, d) for p, fails, d in judged if p == part]
        removed_by = {}
        for order in permutations(FILTERS):
            for step, f in enumerate(order):
                before = set(order[:step])
                removed = [r for r in rows if f in r[0] and not r[0] & before]
                removed_by.setdefault(f, []).append(len(removed))
                out.append(
                    [
                        part,
                        "".join(order),
                        step + 1,
                        sum(not fails & (before | {f}) for fails, _ in rows),
                        len(removed),
                        sum(f in fails and bool(fails & before) for fails, _ in rows),
                        sum(fails == {f} for fails, _ in rows),
                        sum(d in good for _, d in removed),
                        sum(d in toxic for _, d in removed),
                    ]
                )
        for row in out:
            if row[0] == part:
                row.append(sum(removed_by[row[1][row[2] - 1]]))
    return sorted(map(tuple, out))


def text(words, distinct=None, tail=""):
    return " ".join(f"w{i % (distinct or words)}" for i in range(words)) + tail


DOCUMENTS = [
    (1, text(120), "en", "a", 1),
    (2, text(120), "en", "a", 1),  # a copy
    (3, text(120), "de", "a", 1),  # a copy in another part
    (3, text(120), "de", "a", 1),  # the row again
    (4, text(100), "en", "b", 1),
    (5, text(99), "en", "b", 1),
    (6, text(100, 80), "en", None, 1),
    (7, text(100, 79), "en", "b", 1),
    (8, text(100, 79, " A $"), "de", "b", 1),
    (9, None, None, "b", 1),
    (10, "", "", "b", 1),
    (None, "", "de", "b", 1),
    (None, text(120), "de", "b", 1),
    (11, "ABCDEFGHIJ" * 3 + " é" * 200, "de", "b", 1),
    (12, "x" * 300_000, "de", "b", 1),
    (13, "a b\u0085c " * 100 + "|", "fr", "b", 1),
    (14, text(120), "fr", "b", 1),
]
MARKS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (5, 0, 1), (8, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1)]


def test_equals_counting(spark):
    docs, labels = spark.createDataFrame(DOCUMENTS, DOCS), spark.createDataFrame(MARKS, LABELS)
    found = audit_filters(docs, labels).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == brute(DOCUMENTS, MARKS)


def test_empty_table_and_clashing_columns(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit_filters(spark.createDataFrame([], DOCS), labels).count() == 0
    named = "doc_id long, text string, lang string, mask string, digest int, part int, n int, good int"
    rows = [(1, "a b", None, "x", 1, 2, 3, 4)]
    found = audit_filters(spark.createDataFrame(rows, named), labels)
    assert found.count() == 600
    assert found.where("kept <> 0 and filter_order like 'A%'").count() == 0


@pytest.mark.parametrize("players", [2, 3, 5])
def test_least_squares_gives_the_average_over_orders(players):
    weights = shapley_weights(players)
    for player in range(players):
        want = [Fraction(0)] * (1 << players)
        orders = list(permutations(range(players)))
        for order in orders:
            before = sum(1 << p for p in order[: order.index(player)])
            want[before | 1 << player] += Fraction(1, len(orders))
            want[before] -= Fraction(1, len(orders))
        # Nothing is removed by no filter, so the weight of that coalition is free.
        assert weights[player][1:] == want[1:]


def test_solve_needs_a_row_exchange():
    zero, one, two = Fraction(0), Fraction(1), Fraction(2)
    assert solve([[zero, two], [one, zero]], [[one], [two]]) == [[two], [Fraction(1, 2)]]
