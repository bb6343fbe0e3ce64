"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.audit import audit_filters
from fleetlens.llm.language import identify_language
from fleetlens.llm.lexical import lexical_top_k
from fleetlens.llm.licenses import scan_licenses
from fleetlens.llm.lines import line_counts
from fleetlens.llm.lm import score_documents
from fleetlens.llm.minhash import minhash_components
from fleetlens.llm.mixing import mix_documents, word_count
from fleetlens.llm.packing import pack_documents
from fleetlens.llm.permutation import permutation_neighbours
from fleetlens.llm.simhash import simhash_components
from fleetlens.llm.threshold import exact_top_k
from fleetlens.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query("op2_best_fit_packing")
def packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(load(spark, sf, "documents"))


@query("op3_simhash")
def simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_components(load(spark, sf, "documents"))


@query("op10_mixing")
def mixing(spark: SparkSession, sf: str) -> DataFrame:
    mix = mix_documents(load(spark, sf, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


@query("op7_line_dedup")
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_counts(load(spark, sf, "documents"))


@query("op8_toxicity")
def toxic(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query("op1_permutation_index")
def permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    return permutation_neighbours(load(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op5_threshold_top_k")
def threshold_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return exact_top_k(load(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_language")
def language(spark: SparkSession, sf: str) -> DataFrame:
    return identify_language(load(spark, sf, "documents"))


@query("op6_lm_scoring")
def lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(load(spark, sf, "documents"))


#: A document of so few words acts as the licence file of its directory, if it holds a notice.
LICENCE_FILE_WORDS = 40


@query("op4_licenses")
def licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    docs = load(spark, sf, "documents")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id")]
    files = docs.select(
        F.concat_ws("/", *named).alias("path"),
        "text",
        (word_count(F.col("text")) <= LICENCE_FILE_WORDS).alias("licence_file"),
    )
    found = scan_licenses(files)
    number = F.regexp_extract("path", "([^/]*)$", 1)
    return found.select(
        number.try_cast("long").alias("doc_id"),
        "path",
        "licence",
        "origin",
        "declared_in",
        F.round("cosine", 6).alias("cosine"),
    )


@query("op11_filter_audit")
def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit_filters(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query("op12_minhash")
def minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_components(load(spark, sf, "documents"))


@query("op13_lexical_search")
def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_top_k(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


ORACLES["op11_filter_audit"] = r"""
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), low AS (
    SELECT text, min(doc_id) AS first_id FROM words GROUP BY text
), judged AS (
    SELECT w.doc_id, w.part,
           len(w.words) < 100 AS a,
           100 * len(list_distinct(w.words)) < 80 * len(w.words) AS b,
           100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) AS c,
           regexp_matches(w.text, '[#$%&*|]') AS d,
           coalesce(w.doc_id > low.first_id, false) AS e
    FROM words w JOIN low USING (text)
), labelled AS (
    SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask,
           count(*) AS n,
           count(*) FILTER (coalesce(l.good, false)) AS good,
           count(*) FILTER (coalesce(l.toxic, false)) AS toxic
    FROM judged LEFT JOIN labelled l USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT v.f || w.f || x.f || y.f || z.f AS filter_order,
           [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
    FROM letters v
    JOIN letters w ON w.f <> v.f
    JOIN letters x ON x.f NOT IN (v.f, w.f)
    JOIN letters y ON y.f NOT IN (v.f, w.f, x.f)
    JOIN letters z ON z.f NOT IN (v.f, w.f, x.f, y.f)
), steps AS (
    SELECT filter_order, step, bits[step] AS bit,
           list_sum(bits[1:step])::INT - bits[step] AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost,
       toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

ORACLES["op12_minhash"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) < 2 THEN w
        ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id,
       s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""

ORACLES["op13_lexical_search"] = r"""
WITH doc_terms AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), item_terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), lengths AS (
    SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths
), postings AS (
    SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM postings, corpus GROUP BY term, docs
), scored AS (
    SELECT i.item_id, p.doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
    FROM item_terms i JOIN postings p USING (term) JOIN weights USING (term)
    JOIN lengths l ON l.doc_id = p.doc_id, corpus
    GROUP BY i.item_id, p.doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES["op5_threshold_top_k"] = r"""
WITH whole AS (
    SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)])::BIGINT AS score
    FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
