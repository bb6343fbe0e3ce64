"""Toxicity by a weighted grammar of composed finite-state transducers over clauses.

A text is cut into clauses.  Every word becomes a symbol: insult, threat, target, negation, report
or other.  Four small transducers read the symbols: reported speech and negation remember that they
were seen, target remembers who was spoken of, and the match transducer gives out a context for
every insult or threat under what the others remember.  Their composition is one table of states
by symbols; the contexts' weights are chances learned from labelled documents.  A clause counts its
weightiest match, a document the chance that any of its clauses is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.sampling import hash_limit
from fleetlens.llm.storage import save
from fleetlens.llm.words import batch_slices

#: Seed words of the grammar (fixed values); insults are mostly learned from labels.
INSULTS = (
    "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown "
    "dumb fool imbecile jerk vermin filth depp trottel abschaum idiota imbécile crétin basura"
).split()
THREATS = "kill hurt destroy stab shoot burn beat murder strangle töten umbringen tuer matar".split()
TARGETS = (
    "you your you're he she they them him her those these people du dich ihr euch sie tu toi vous "
    "ils elles tú usted ustedes ellos"
).split()
NEGATIONS = "not no never isn't aren't don't without nicht kein keine pas jamais ne nunca sin".split()
REPORTS = (
    "said says wrote quoted reported claimed called calls alleged sagte schrieb dit écrit dijo escribió"
).split()
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words that a negation reaches over.
REACH = 3
#: Lengths of word beginnings that may stand for a whole family of insults.
STEMS = (4, 5, 6)
CLAUSE = re.compile(r"[.!?;:\n\r]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Prior chance of a clause with each kind of match, and how many clauses the prior is worth.
PRIOR = {"plain": 0.85, "targeted": 0.95, "negated": 0.45, "reported": 0.35}
PRIOR_WORTH = 4.0


def compose() -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]]]:
    """The composed transducer: next state and output for every state and symbol.

    A state is (reported, words a negation still reaches, target seen).  Output -1 is nothing,
    else the number of a context (kind of match, what the other transducers remembered).
    """
    states = list(product((0, 1), range(REACH + 1), (0, 1)))
    number = {s: i for i, s in enumerate(states)}
    contexts = list(product(("insult", "threat"), PRIOR))
    context = {c: i for i, c in enumerate(contexts)}
    to = np.zeros((len(states), len(SYMBOLS)), dtype=np.int64)
    out = np.full((len(states), len(SYMBOLS)), -1, dtype=np.int64)
    for (reported, reach, target), symbol in product(states, range(len(SYMBOLS))):
        now = number[reported, reach, target]
        to[now, symbol] = number[
            int(reported or symbol == REPORT),
            REACH if symbol == NEGATION else max(reach - 1, 0),
            int(target or symbol == TARGET),
        ]
        if symbol in (INSULT, THREAT):
            kind = "negated" if reach else "reported" if reported else "targeted" if target else "plain"
            out[now, symbol] = context["insult" if symbol == INSULT else "threat", kind]
    return to, out, contexts


@dataclass
class Grammar:
    """Lexicon of the symbols, beginnings of insult words, and the weight of every context."""

    symbol: dict[str, int]
    stems: frozenset[str]
    weights: list[float]
    base: float

    def of(self, word: str) -> int:
        found = self.symbol.get(word)
        if found is None:
            found = INSULT if any(word[:n] in self.stems for n in STEMS if len(word) > n) else OTHER
        return found

    def marked(self, words: set[str]) -> bool:
        """Whether any word can give a match; the transducers need not run otherwise."""
        symbol, stems = self.symbol, self.stems
        if any(symbol.get(w) in (INSULT, THREAT) for w in symbol.keys() & words):
            return True
        return any(not stems.isdisjoint([w[:n] for w in words if len(w) > n]) for n in STEMS)


def clause_contexts(text: str, grammar: Grammar, machine: tuple) -> list[list[int]]:
    """Contexts of the matches of every clause that has any."""
    to, out = machine
    small = text.lower()
    if not grammar.marked(set(WORD.findall(small))):
        return []
    found = []
    for clause in CLAUSE.split(small):
        state, matches = 0, []
        for word in WORD.findall(clause):
            symbol = grammar.of(word)
            if out[state][symbol] >= 0:
                matches.append(out[state][symbol])
            state = to[state][symbol]
        if matches:
            found.append(matches)
    return found


def seed_symbols() -> dict[str, int]:
    table = {}
    for words, symbol in (
        (TARGETS, TARGET),
        (NEGATIONS, NEGATION),
        (REPORTS, REPORT),
        (THREATS, THREAT),
        (INSULTS, INSULT),
    ):
        table |= dict.fromkeys(words, symbol)
    return table


def learn_lexicon(labelled: DataFrame, least: int = 3, ratio: float = 15.0, most: int = 20_000):
    """Words, and beginnings of words, that documents labelled toxic have far more often.

    ``labelled``: text, toxic.  Counts are over documents, on the cluster.  ``most`` bounds the
    lexicon (the surest entries are kept) and so what the driver receives.
    """
    totals = labelled.agg(F.sum("toxic"), F.count("*")).first()
    bad, all_ = float(totals[0] or 0), float(totals[1])
    if not bad or bad == all_:
        return [], [], (bad + 1) / (all_ + 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def drain() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(keys, pa.string())]
            columns += [pa.array([c[k] for k in keys], pa.int64()) for c in seen]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "clean", "toxic"])

        for part in (s for batch in batches for s in batch_slices(batch, 0)):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                terms = words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))
                seen[toxic].update(terms)
                if len(seen[0]) + len(seen[1]) > 150_000:
                    yield drain()
        yield drain()

    terms = (
        labelled.select("text", "toxic")
        .mapInArrow(count, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    odds = ((F.col("toxic") + 0.5) / bad) / ((F.col("clean") + 0.5) / max(all_ - bad, 1.0))
    rows = (
        terms.where(F.col("toxic") >= least)
        .where((odds >= ratio) & (F.col("clean") * 4 <= F.col("toxic")))
        .orderBy(F.desc(F.col("toxic") * F.log(odds)), "term")
        .limit(most)
        .collect()
    )
    sure = {r.term: r for r in rows}
    stems = {t[:-1] for t in sure if t.endswith("*")}
    words = [
        t
        for t, r in sure.items()
        if not t.endswith("*")
        and (r.toxic >= 8 or any(t[:n] in stems for n in STEMS))
    ]
    # A beginning needs a family behind it: more documents than any one of its words.
    strong = [s for s in stems if sure[s + "*"].toxic >= 8 and sure[s + "*"].clean == 0]
    return words, strong, (bad + 1) / (all_ + 2)


def fit_grammar(labelled: DataFrame) -> Grammar:
    """The grammar of labelled documents (text, toxic): lexicon first, then context weights."""
    words, stems, share = learn_lexicon(labelled)
    symbols = dict.fromkeys(words, INSULT) | seed_symbols()
    draft = Grammar(symbols, frozenset(stems), [], share)
    to, out, contexts = compose()
    machine = (to.tolist(), out.tolist())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        for part in (s for batch in batches for s in batch_slices(batch, 0)):
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                clauses = clause_contexts(text or "", draft, machine)
                kinds = {c for clause in clauses for c in clause} or {-1}
                # A document teaches about one context only where no other could explain it.
                if len(kinds) == 1:
                    totals[kinds.pop(), toxic] += 1
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([totals[k] for k in keys], pa.int64()),
            ],
            names=["context", "toxic", "n"],
        )

    rows = (
        labelled.select("text", "toxic")
        .mapInArrow(tally, "context long, toxic long, n long")
        .groupBy("context", "toxic")
        .agg(F.sum("n").alias("n"))
        .collect()  # two rows for each context
    )
    n = {(r.context, r.toxic): r.n for r in rows}
    weights = [
        (n.get((i, 1), 0) + PRIOR_WORTH * PRIOR[kind])
        / (n.get((i, 1), 0) + n.get((i, 0), 0) + PRIOR_WORTH)
        for i, (_, kind) in enumerate(contexts)
    ]
    base = (n.get((-1, 1), 0) + share) / (n.get((-1, 1), 0) + n.get((-1, 0), 0) + 1)
    return Grammar(symbols, draft.stems, weights, min(base, 0.25))


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every document, by its whole text.

    Null, empty and wordless texts get the score of documents without any match.
    """
    to, out, _ = compose()
    machine = (to.tolist(), out.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for text in batch.column(1):
                clean = 1.0 - grammar.base
                for clause in clause_contexts(text.as_py() or "", grammar, machine):
                    clean *= 1.0 - max(grammar.weights[c] for c in clause)
                scores.append(1.0 - clean)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = 40_000) -> DataFrame:
    """text and toxic of the documents to learn from, never of the held-out fold.

    Rows without a label teach nothing.  At most about ``most`` documents are taken, by a hash of
    doc_id; this bounds the fit, not the scoring.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy(
        F.col("doc_id").alias("_id")
    ).agg(F.max("toxic").cast("long").alias("toxic"))
    known = save(known, "labels")
    taken = known.where(F.xxhash64("_id") <= hash_limit(most, known.count()))
    # About ``most`` pairs of numbers: a bounded side.
    joined = docs.select("doc_id", "text").join(F.broadcast(taken), F.col("doc_id") == F.col("_id"))
    return save(joined.select("text", "toxic"), "labelled")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A row per document: doc_id, held_out, score and predicted (score >= threshold).

    A null doc_id is not held out.  Repeated rows are scored alike; an empty table gives no rows,
    and without labels the prior weights of the grammar hold.
    """
    grammar = fit_grammar(labelled_texts(docs, labels))
    return score_toxicity(docs, grammar).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _clean(grammar: Grammar, position: int, threshold: float):
    """The rows whose text, in column ``position``, scores below the threshold, a small slice at a time."""
    to, out, _ = compose()
    machine = (to.tolist(), out.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for batch in batches for s in batch_slices(batch, position)):
            kept = []
            for text in part.column(position):
                clean = 1.0 - grammar.base
                for clause in clause_contexts(text.as_py() or "", grammar, machine):
                    clean *= 1.0 - max(grammar.weights[c] for c in clause)
                kept.append(1.0 - clean < threshold)
            yield part.filter(pa.array(kept, pa.bool_()))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that the grammar scores at ``threshold`` or more.

    The decision is made while the row is read, so no row needs to be found again by its id.
    """
    grammar = fit_grammar(labelled_texts(docs, labels))
    return docs.mapInArrow(_clean(grammar, docs.columns.index("text"), threshold), docs.schema)
