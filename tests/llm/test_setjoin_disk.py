"""Shuffle files are let go while a join still runs."""

import time

from pyspark.sql import functions as F

from graphloom.llm import setjoin
from graphloom.storage import settle, tidy


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def gone(spark, names):
    for _ in range(20):
        if not names & shuffles(spark):
            return True
        time.sleep(0.1)
    return False


def test_the_last_jobs_shuffle_files_go(spark):
    before = shuffles(spark)
    df = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    new = shuffles(spark) - before
    tidy(spark)
    assert new and gone(spark, new) and df.count() == 7


def test_what_blocks_sent_goes_before_sets_are_made(spark, words, monkeypatch):
    docs = spark.createDataFrame([(i, i, words(40, i // 2)) for i in range(60)], "h1 bigint, h2 bigint, text string")
    before, seen = shuffles(spark), []

    def watched(s):
        new = shuffles(s) - before
        tidy(s)
        seen.append((len(new), gone(s, new)))

    monkeypatch.setattr(setjoin, "tidy", watched)
    sets, members = setjoin.distinct_sets(docs, 3, 0.5, 10_000)
    assert len(seen) == 1 and seen[0][0] > 0 and seen[0][1]
    assert sets.count() == 30 and members.count() == 60
