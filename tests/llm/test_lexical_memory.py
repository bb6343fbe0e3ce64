"""The lexical index as it is read again: what broke by memory on tables 360 times as large."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fleetlens.llm import lexical


def test_a_task_decodes_few_shards_at_once(spark, monkeypatch):
    """A reader decodes a row group at once, and all shards of a task made one."""
    saved, save = {}, lexical.save
    monkeypatch.setattr(lexical, "save", lambda df, name, *more: saved.setdefault(name, save(df, name, *more)))
    words = F.transform(F.sequence(F.lit(1), F.lit(250)), lambda i: F.hex(F.xxhash64("doc_id", i)))
    docs = spark.range(3000).select(F.col("id").alias("doc_id")).coalesce(1)
    docs = docs.select("doc_id", F.array_join(words, " ").alias("text"))
    asked = docs.where("doc_id % 1000 = 7").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 100).alias("text"))
    found = lexical.lexical_top_k(docs, asked, 1).collect()
    assert sorted((r.item_id, r.doc_id) for r in found) == [(7, 7), (1007, 1007), (2007, 2007)]
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in saved["shards"].inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) >= 6 and max(groups) <= 2


def test_a_worker_gets_few_shards_at_once(spark, monkeypatch):
    """Up to 64 MB went to each worker at once, and were copied several times outside the heap."""
    limit, whole, search = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.files.minPartitionNum", lexical._search
    before = spark.conf.get(limit)

    def watched(*known):
        run = search(*known)

        def few(batches):
            for batch in batches:
                assert batch.num_rows <= 2
                yield batch

        return lambda batches: run(few(batches))

    monkeypatch.setattr(lexical, "_search", watched)
    words = F.transform(F.sequence(F.lit(1), F.lit(250)), lambda i: F.hex(F.xxhash64("doc_id", i)))
    docs = spark.range(3000).select(F.col("id").alias("doc_id")).coalesce(1)
    docs = docs.select("doc_id", F.array_join(words, " ").alias("text"))
    spark.conf.set(whole, "1")
    try:
        items = docs.where("doc_id = 2999").select(F.col("doc_id").alias("item_id"), "text")
        assert [r.doc_id for r in lexical.lexical_top_k(docs, items, 1).collect()] == [2999]
    finally:
        spark.conf.unset(whole)
    assert spark.conf.get(limit) == before
