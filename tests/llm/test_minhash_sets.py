"""Which sets the comparison of pairs moves, and how often."""

from pyspark.sql import functions as F

from fleetlens.llm import minhash


def test_centres_sets_are_copied_for_many_pairs_only(spark, monkeypatch):
    saved = {}

    def watched(df, name, plain=minhash.save):
        saved[name] = plain(df, name)
        return saved[name]

    monkeypatch.setattr(minhash, "save", watched)
    members = [(i, [1, 2, 3, 4, 5, 6, 7, 8, 9, 100 + i % 3], 10) for i in range(400)]
    sets = spark.createDataFrame(members, "row long, members array<long>, n long")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 40)], "a long, b long")
    links = minhash.confirmed(pairs, sets, 80)
    assert links.count() == 39
    assert saved["able"].select("b", "salt").distinct().count() == 1
    assert minhash._sets_of(saved["able"], sets).count() < 60
    crowd = spark.range(1, 400).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    assert minhash.confirmed(crowd, sets, 80).count() == 399
    assert saved["able"].select("b", "salt").distinct().count() == 7
