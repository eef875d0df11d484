import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from graphloom.llm.mixing import _units, cuts, mix, mix_documents, words_in


def brute(rows, weights, default=1, seed="mix-1"):
    units = [(d, s, t or "", len((t or "").split())) for d, t, _, s, _ in rows]
    have = defaultdict(int)
    for _, s, _, n in units:
        have[s] += n
    total, ws = sum(have.values()), sum(weights.get(s, default) for s in have)
    out = []
    for s, h in have.items():
        budget = total * weights.get(s, default) // ws
        epochs, rest = divmod(budget, h) if h else (1 if weights.get(s, default) > 0 else 0, 0)
        mine = [u for u in units if u[1] == s]
        for e in range(epochs + 1):
            keyed = defaultdict(list)
            for d, _, t, n in mine:
                keyed[hashlib.md5(f"{seed}:{e}:{'' if d is None else d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()].append((d, n))
            at = 0
            for k in sorted(keyed):
                for d, n in keyed[k]:
                    if e < epochs:
                        out.append((d, s, e, n))
                    elif at < rest:
                        out.append((d, s, e, n if at + n * len(keyed[k]) < rest else (rest - at) // len(keyed[k])))
                at += sum(n for _, n in keyed[k])
    return sorted(out, key=str)


def test_matches_brute_force(odd, odd_rows):
    weights = {"s0": 3, "s1": 1}
    got = [(r.doc_id, r.source, r.epoch, r.take_tokens) for r in mix(odd, weights).collect()]
    assert sorted(got, key=str) == brute(odd_rows, weights)


def test_budgets_are_exact(spark, words):
    rows = [(i, words(20 + i, i), "en", f"s{i % 3}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    weights = {"s0": 5, "s1": 1, "s2": 0}
    total = sum(len(r[1].split()) for r in rows)
    got = {r.source: r.t for r in mix(docs, weights).groupBy("source").agg({"take_tokens": "sum"}).withColumnRenamed("sum(take_tokens)", "t").collect()}
    assert got == {"s0": total * 5 // 6, "s1": total // 6}
    text = {r.source: r.n for r in mix_documents(docs, weights).selectExpr("source", "size(split(text, ' ')) n").groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert text == got


def test_documents_keep_columns(clashing, empty):
    out = mix_documents(clashing, {"s0": 3})
    assert out.columns == clashing.columns and out.dtypes == clashing.dtypes
    assert out.count() == mix(clashing, {"s0": 3}).count()
    assert mix(empty).count() == 0 and mix_documents(empty).count() == 0


def test_tokens_are_counted_like_split(spark):
    texts = ["", " ", "a", " a  b\t\nc\r", "x" * 3_000_000, "é ü ö", None, "a b " * 500_000, "\n\n", "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(1).select("doc_id", words_in(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in rows} == {i: len(re.findall("[^ \t\n\r]+", t or "")) for i, t in enumerate(texts)}


def test_a_budget_of_many_epochs(spark):
    docs = spark.createDataFrame([(1, "one", "en", "s0", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    at = cuts(_units(docs), {"s0": 1}, total=10**13).first()
    assert (at.epochs, at.rest) == (10**13, 0)
    assert mix(docs, {"s0": 1}, total=40_000).selectExpr("max(epoch) z", "count(distinct epoch) n", "count(1) k").first()[:] == (39_999, 40_000, 40_000)
