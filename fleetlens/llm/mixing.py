"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / size of the source`` times, a fraction.  The
whole part is taken outright.  Of the fractional parts two at a time are paired: word mass moves
from one to the other, in a random direction whose odds keep every expectation, until one of them
is 0 or 1.  The pairings form a tree: blocks of a few hundred documents are folded one by one, each
leaves one residual at most, and the residuals go into the blocks of the next level.  A source's
taken words so miss its target by less than the size of its last residual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.storage import save

#: Documents of one block of the reduction tree, about.
BLOCK = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``target`` of every row (source, source_size): shares by weight of all sizes, held at
    ``most`` times the own size, the excess dealt out again by weight.

    Sources in code point order, null last, take the weights in turn.  The fixpoint of dealing out
    again is one level per unit of weight for all sources that are not held, and the held ones are
    those of the smallest limit per weight; one pass in that order finds the level.
    """
    # One row per source from here on.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    ranked = sizes.withColumn("_w", turn).withColumn("_cap", most * F.col("source_size"))
    by_limit = Window.orderBy(
        F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(by_limit), F.lit(0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(by_limit), F.lit(0))
    )
    # The level rises while the next source is held and falls from there on: its peak is the answer.
    tried = ranked.withColumn("_level", level)
    return tried.withColumn("_found", F.max("_level").over(every)).select(
        "source",
        "source_size",
        F.least(F.col("_found") * F.col("_w"), F.col("_cap").cast("double")).alias("target"),
    )


def _uniform(*parts: str) -> str:
    return f"((xxhash64({', '.join(parts)}) & 9007199254740991) / 9007199254740992D)"


def _fold(level: int, seed: int) -> str:
    """SQL of one block's fold: ``carry`` is the document still fractional, ``done`` the others."""
    up = "least((1 - acc.carry.part) * acc.carry.mass, x.part * x.mass)"
    down = "least(acc.carry.part * acc.carry.mass, (1 - x.part) * x.mass)"
    # Mass ``up`` moves to the carried document with odds down : up, else ``down`` away from it.
    pair = (
        f"CASE WHEN acc.carry IS NULL THEN named_struct('c', cast(null as double), 'x', x.part) "
        f"WHEN {_uniform('acc.carry.h', 'x.h', str(level), str(seed))} * ({up} + {down}) < {down} "
        f"THEN named_struct("
        f"'c', if((1 - acc.carry.part) * acc.carry.mass <= x.part * x.mass, 1D, "
        f"acc.carry.part + {up} / acc.carry.mass), "
        f"'x', if((1 - acc.carry.part) * acc.carry.mass <= x.part * x.mass, "
        f"x.part - {up} / x.mass, 0D)) "
        f"ELSE named_struct("
        f"'c', if(acc.carry.part * acc.carry.mass <= (1 - x.part) * x.mass, 0D, "
        f"acc.carry.part - {down} / acc.carry.mass), "
        f"'x', if(acc.carry.part * acc.carry.mass <= (1 - x.part) * x.mass, "
        f"x.part + {down} / x.mass, 1D)) END"
    )
    with_part = "named_struct('h', {0}.h, 'part', {1}, 'mass', {0}.mass, 'item', {0}.item)"
    carry_now, x_now = with_part.format("acc.carry", "p.c"), with_part.format("x", "p.x")
    open_ = "{0} > 1e-12 AND {0} < 1 - 1e-12"
    merged = (
        "named_struct("
        f"'carry', CASE WHEN {open_.format('p.x')} THEN {x_now} "
        f"WHEN acc.carry IS NOT NULL AND {open_.format('p.c')} THEN {carry_now} END, "
        f"'done', concat(acc.done, "
        f"if(acc.carry IS NOT NULL AND (NOT ({open_.format('p.c')}) OR {open_.format('p.x')}), "
        f"array({carry_now}), array()), "
        f"if({open_.format('p.x')}, array(), array({x_now}))))"
    )
    step = f"element_at(transform(array({pair}), p -> {merged}), 1)"
    none = "cast(null as struct<h: bigint, part: double, mass: double, item: {item}>)"
    start = f"named_struct('carry', {none}, 'done', cast(array() as array<struct<h: bigint, part: double, mass: double, item: {{item}}>>))"
    return f"aggregate(items, {start}, (acc, x) -> {step})"


def pivotal_rounding(items: DataFrame, key: str, item: Sequence[str], seed: int) -> DataFrame:
    """``up`` (0 or 1) for every row of ``items``: columns ``key``, ``item``, ``part``, ``mass``.

    0 < part < 1 and mass > 0.  The sum of mass * up over a key is that of mass * part but for one
    residual.  Blocks hold a few hundred rows of one key, however many rows the key has.
    """
    shape = items.select(F.struct(*item).alias("item")).schema["item"].dataType.simpleString()
    h = F.xxhash64(*item, F.lit(seed))
    now = items.select(key, h.alias("h"), "part", "mass", F.struct(*item).alias("item"))
    decided, level = [], 0
    while True:
        counts = now.groupBy(key).agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        sized = counts.select(
            F.col(key).alias("_key"), F.greatest(F.lit(1), F.ceil(F.col("_n") / BLOCK)).alias("_blocks")
        )
        block = F.pmod(F.xxhash64("h", F.lit(level)), F.col("_blocks"))
        row = F.struct("h", "part", "mass", "item")
        folded = (
            now.join(sized, F.col(key).eqNullSafe(F.col("_key")))
            .groupBy(key, block.alias("_block"))
            .agg(F.array_sort(F.collect_list(row)).alias("items"))
            .select(key, F.expr(_fold(level, seed).replace("{item}", shape)).alias("f"))
        )
        folded = save(folded, "folded")
        decided.append(folded.select(key, F.explode("f.done").alias("d")))
        now = folded.where("f.carry IS NOT NULL").select(key, "f.carry.*")
        if most <= BLOCK:
            break
        level += 1
    # One residual a key at most is left: it is rounded by its own odds.
    last = now.select(
        key, "item", F.expr(f"if({_uniform('h', str(seed))} < part, 1, 0)").alias("up")
    )
    out = last.select(key, "item.*", "up")
    for part in decided:
        out = out.union(part.select(key, "d.item.*", F.expr("cast(round(d.part) as int)")))
    return out


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 17
) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken.

    size: words of the text (null: 0); taken = size * copies; copies: 0 to ``most``.  Documents
    without words take 0 copies.  Null sources are one source, last in order.  Equal rows (same
    doc_id, source and size) are decided together and share the copies as evenly as can be.  An
    empty table gives no rows; other columns play no part.  Reruns agree: chance comes from
    hashes of doc_id, size and ``seed``.
    """
    sized = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")
    ).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    sized = save(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = save(source_targets(sources, weights, most), "targets").withColumnRenamed("source", "_s")
    rate = F.col("target") / F.col("source_size") * F.col("rows")
    whole = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)))
        .withColumn("_whole", F.floor(F.col("_rate") + 1e-12))
        .withColumn("part", F.greatest(F.col("_rate") - F.col("_whole"), F.lit(0.0)))
        .withColumn("mass", F.col("size").cast("double"))
        .drop("_rate")
    )
    whole = save(whole, "rates")
    item = ["doc_id", "size", "rows", "source_size", "target", "_whole"]
    chosen = pivotal_rounding(whole.where("part > 1e-12"), "source", item, seed)
    fixed = whole.where("part <= 1e-12").select("source", *item, F.lit(0).alias("up"))
    each = (
        chosen.union(fixed)
        .withColumn("_total", F.col("_whole") + F.col("up"))
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    )
    copies = F.floor(F.col("_total") / F.col("rows")) + F.when(
        F.col("_i") <= F.pmod("_total", "rows"), 1
    ).otherwise(0)
    return each.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        F.coalesce("target", F.lit(0.0)).alias("target"),
        copies.cast("int").alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def mixed_corpus(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 17
) -> DataFrame:
    """``docs`` with every document as often as the mix takes it, all columns kept.

    Rows get a number of their own for the time of the mix, so repeated and null doc_ids are safe.
    """
    kept = save(
        docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")),
        "rows",
    )
    narrow = kept.select(F.col("row").alias("doc_id"), "doc.source", "doc.text")
    mix = mix_documents(narrow, weights, most, seed).where("copies > 0")
    mix = mix.select(F.col("doc_id").alias("id"), "copies")
    return (
        kept.join(mix, F.col("row") == F.col("id"))
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("doc.*")
    )
