import hashlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.sharding import assign, gather, jump


def one(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_matches_scalar_version():
    keys = np.random.default_rng(1).integers(0, 2**64, 2000, dtype=np.uint64)
    for n in (1, 2, 7, 1024):
        assert jump(keys, n).tolist() == [one(int(k), n) for k in keys]


def test_appending_moves_only_to_new_shards():
    keys = np.random.default_rng(2).integers(0, 2**64, 50_000, dtype=np.uint64)
    a, b = jump(keys, 60), jump(keys, 64)
    moved = a != b
    assert (b[moved] >= 60).all() and abs(moved.mean() - 4 / 64) < 0.01


def test_rows(clashing, empty, odd_rows):
    out = gather(assign(clashing, n=16, before=12), 16)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        if r.doc_id is not None:
            key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
            assert (r["shard"], r.shard_before, r.moved) == (one(key, 16), one(key, 12), one(key, 16) != one(key, 12))
    assert assign(empty).count() == 0


def test_null_keys_are_dealt_out_and_tasks_hold_whole_shards(spark):
    df = spark.range(2000).selectExpr("cast(null as bigint) as doc_id", "concat('t', id) as text")
    out = gather(assign(df, n=8), 8).withColumn("task", F.spark_partition_id())
    n = {r["shard"]: (r["n"], r["tasks"]) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).collect()}
    assert set(n) == set(range(8)) and all(150 < k < 350 and t == 1 for k, t in n.values())
    tasks = out.groupBy("task").agg(F.countDistinct("shard").alias("n")).collect()
    assert {r.n for r in tasks} == {2} and len(tasks) == 4
