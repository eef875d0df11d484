"""Quality rules: robust multivariate outliers among text statistics.

For each language and source the minimum-covariance-determinant estimate: concentration steps run
from several deterministic starts (medians with quartile scales alone, and with the correlations of
squashed and of spatial-sign vectors), all at the same time, each until its determinant falls no more, and
the one with the least determinant is taken. A step makes the mean and covariance of the share
SUPPORT of documents with the smallest Mahalanobis distances.

Vectors are made once and kept, by group, in chunks of bounded size; a step goes over the chunks
once and adds up counts, sums and products by bins of distance, from which both the cut and
the estimate under it follow. So a source of any size is never in one place, and results don't
depend on partitions but for rounding.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, settle, table, whole_row
from graphloom.llm.textstats import ROBUST, vector_of

P = len(ROBUST)
#: Least standard deviation of each statistic, added to every covariance: below it, a difference is of no interest. Small groups lean on it.
FLOORS = [0.05] * P
#: Pairs of language and source with fewer documents are judged by the estimate of all documents of the language, those of smaller languages by that of all documents.
LEAST_GROUP = 100
SUPPORT, TAIL = 0.7, 1e-5
#: A start has converged when the logarithm of its determinant falls by less. Determinants fall from step to step, so MOST_STEPS is for bins' rounding only.
FALL, MOST_STEPS = 1e-3, 40
#: Vectors to a chunk, bins to an octave of squared distance, width of the grid for medians.
CHUNK, BINS, GRID = 4096, 16, 0.005
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_ROW = np.array([i for i, _ in PAIRS])
_COL = np.array([j for _, j in PAIRS])


def chi2_quantile(q: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    a = 2 / (9 * k)
    return k * (1 - a + NormalDist().inv_cdf(q) * a**0.5) ** 3


def _whiten(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Lower triangular w with w cov w' = 1, the floors added to the variances, and the logarithm of the determinant."""
    low = np.linalg.cholesky(cov + np.diag(np.square(FLOORS)))
    return np.linalg.inv(low), 2 * float(np.log(np.diag(low)).sum())


def _square(sums: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    out[_ROW, _COL] = out[_COL, _ROW] = sums
    return out


def _each(f, schema: pa.Schema):
    """mapInArrow of a function from a row, as a dictionary, to rows."""

    def run(batches):
        for b in batches:
            rows = [r for i in range(b.num_rows) for r in f({c: b.column(c)[i] for c in b.schema.names})]
            cols = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, schema)], schema=schema)

    return run


def _vectors(x: pa.Scalar) -> np.ndarray:
    return np.array(x.values).reshape(-1, P)


_HIST = pa.schema([("g", pa.string()), ("j", pa.int32()), ("b", pa.int64()), ("c", pa.int64())])


def _histograms(r: dict):
    b = np.floor(_vectors(r["xs"]) / GRID).astype(np.int64)
    for j in range(P):
        v, c = np.unique(b[:, j], return_counts=True)
        yield from ((r["g"].as_py(), j, int(x), int(k)) for x, k in zip(v, c))


def _scales(chunks: DataFrame) -> DataFrame:
    """(g, n, mid, sd): number of documents, medians, and quartile distances as standard deviations."""
    h = chunks.mapInArrow(_each(_histograms, _HIST), "g string, j int, b bigint, c bigint").groupBy("g", "j", "b").agg(F.sum("c").alias("c"))
    by = Window.partitionBy("g", "j")  # over bins, which are bounded
    h = h.withColumn("cum", F.sum("c").over(by.orderBy("b"))).withColumn("n", F.sum("c").over(by))
    q = h.groupBy("g", "j", "n").agg(*[F.min(F.when(F.col("cum") >= F.col("n") * s, F.col("b"))).alias(a) for a, s in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))])
    sd = F.greatest((F.col("hi") - F.col("lo")) * (GRID / 1.349), F.element_at(F.array(*[F.lit(f) for f in FLOORS]), F.col("j") + 1))
    got = q.groupBy("g").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", ((F.col("mid") + 0.5) * GRID).alias("m"), sd.alias("s")))).alias("q"))
    return settle(got.select("g", "n", F.col("q.m").alias("mid"), F.col("q.s").alias("sd")))


_SUMS = pa.schema([("g", pa.string()), ("kind", pa.int32()), ("v", pa.list_(pa.float64()))])


def _squashed_sums(r: dict):
    """Sums and products of z squashed by tanh (kind 1) and products of z of length 1 (kind 2)."""
    z = (_vectors(r["xs"]) - np.array(r["mid"].values)) / np.array(r["sd"].values)
    t = np.tanh(z)
    u = z / np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9)
    for kind, v in ((1, t), (2, u)):
        yield r["g"].as_py(), kind, np.concatenate([v.sum(0), (v.T @ v)[_ROW, _COL]])


_PARAMS = pa.schema([("g", pa.string()), ("start", pa.int32()), ("n", pa.int64()), ("mu", pa.list_(pa.float64())), ("w", pa.list_(pa.float64())), ("logdet", pa.float64())])
_PARAMS_SQL = "g string, start int, n bigint, mu array<double>, w array<double>, logdet double"


def start_covariance(kind: int, n: float, sums: np.ndarray | None, sd: np.ndarray) -> np.ndarray:
    """Scales with no correlations (0), with those of squashed (1) or of spatial-sign vectors (2)."""
    r = np.eye(P)
    if kind:
        c = _square(sums[P:]) / n
        if kind == 1:
            c = c - np.outer(sums[:P], sums[:P]) / n**2
        c = c + 1e-6 * np.eye(P)
        r = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
    return r * np.outer(sd, sd)


def _starts(chunks: DataFrame) -> DataFrame:
    scales = _scales(chunks)
    sums = chunks.join(scales, "g").mapInArrow(_each(_squashed_sums, _SUMS), "g string, kind int, v array<double>")
    sums = sums.groupBy("g", "kind").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(P + len(PAIRS))]).alias("v"))
    none = scales.select("g", F.lit(0).alias("kind"), F.lit(None).cast("array<double>").alias("v"))

    def f(r):
        sd, n = np.array(r["sd"].values), r["n"].as_py()
        w, _ = _whiten(start_covariance(r["kind"].as_py(), n, np.array(r["v"].values) if r["v"].is_valid else None, sd))
        yield r["g"].as_py(), r["kind"].as_py(), n, np.array(r["mid"].values), w.ravel(), float("inf")

    return settle(sums.unionByName(none).join(scales, "g").mapInArrow(_each(f, _PARAMS), _PARAMS_SQL))


_BINNED = pa.schema([("g", pa.string()), ("start", pa.int32()), ("b", pa.int32()), ("c", pa.int64()), ("v", pa.list_(pa.float64()))])


def _binned(r: dict):
    """For each start, by bins of squared distance: number, sums and products of what vectors differ from the mean."""
    x = _vectors(r["xs"])
    for p in r["starts"].as_py():
        y = x - np.array(p["mu"])
        d2 = ((y @ np.array(p["w"]).reshape(P, P).T) ** 2).sum(1)
        b = np.floor(np.log2(d2 + 1e-9) * BINS).astype(np.int32)
        order = np.argsort(b, kind="stable")
        y, b = y[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        v = np.add.reduceat(np.concatenate([y, y[:, _ROW] * y[:, _COL]], axis=1), at)
        yield from ((r["g"].as_py(), p["start"], int(k), int(c), s) for k, c, s in zip(b[at], np.diff(np.append(at, len(b))), v))


def _step(chunks: DataFrame, params: DataFrame) -> DataFrame:
    """A concentration step of every start in `params`, with the logarithm of the determinant that it leads to; moved says whether that fell."""
    per = params.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "mu", "w"))).alias("starts"))
    got = chunks.join(per, "g").mapInArrow(_each(_binned, _BINNED), "g string, start int, b int, c bigint, v array<double>")
    k = P + len(PAIRS)
    bins = got.groupBy("g", "start", "b").agg(F.sum("c").alias("c"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(k)])
    by = Window.partitionBy("g", "start")  # over bins, which are bounded
    near = bins.withColumn("cum", F.sum("c").over(by.orderBy("b"))).withColumn("n", F.sum("c").over(by)).where(F.col("cum") - F.col("c") < F.col("n") * SUPPORT)
    sums = near.groupBy("g", "start").agg(F.sum("c").alias("m"), F.array(*[F.sum(f"v{i}") for i in range(k)]).alias("v"))

    def f(r):
        m, v = r["m"].as_py(), np.array(r["v"].values)
        mean = v[:P] / m
        w, logdet = _whiten(_square(v[P:]) / m - np.outer(mean, mean))
        yield r["g"].as_py(), r["start"].as_py(), r["n"].as_py(), np.array(r["mu"].values) + mean, w.ravel(), logdet

    now = sums.join(params.select("g", "start", "n", "mu"), ["g", "start"]).mapInArrow(_each(f, _PARAMS), _PARAMS_SQL)
    return settle(now.join(params.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).withColumn("moved", F.col("logdet") < F.col("was") - FALL))


def _groups(x: DataFrame) -> DataFrame:
    """(lang, source, g, feeds): the group by whose estimate a pair is judged, and those in whose estimates its documents are."""
    n = x.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    name = lambda *c: F.to_json(F.array(*[F.coalesce(F.col(x), F.lit("\u0000")) for x in c]))
    of = n.groupBy("lang").agg(F.sum("n").alias("ln"), F.min("n").alias("least")).withColumn("l", name("lang"))
    small = of.agg(F.min("ln").alias("smallest"))
    j = n.alias("n").join(of.alias("o"), F.col("n.lang").eqNullSafe(F.col("o.lang"))).select("n.*", "l", "ln", "least").crossJoin(F.broadcast(small))
    g = F.when(F.col("n") >= LEAST_GROUP, name("lang", "source")).when(F.col("ln") >= LEAST_GROUP, F.col("l")).otherwise("all")
    feeds = F.filter(F.array(
        F.when(F.col("n") >= LEAST_GROUP, name("lang", "source")), F.when((F.col("least") < LEAST_GROUP) & (F.col("ln") >= LEAST_GROUP), F.col("l")), F.when(F.col("smallest") < LEAST_GROUP, F.lit("all")),
    ), lambda f: f.isNotNull())
    return settle(j.select("lang", "source", "n", g.alias("g"), feeds.alias("feeds")))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _chunks(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, xs): vectors of each group, some CHUNK to a row."""
    parts = F.ceil(F.col("n") / CHUNK)
    p = pairs.select("lang", "source", "feeds", parts.alias("parts"))
    v = vectors.select("lang", "source", "x", F.xxhash64(F.monotonically_increasing_id()).alias("salt"))  # equal vectors, too, are dealt out
    j = v.alias("v").join(p.alias("p"), _same("v", "p")).select("v.x", "p.lang", "p.source", "p.feeds", F.pmod("v.salt", F.col("p.parts").cast("bigint")).alias("part"))
    return settle(j.groupBy("lang", "source", "feeds", "part").agg(F.flatten(F.collect_list("x")).alias("xs")).select(F.explode("feeds").alias("g"), "xs"))


def fit(vectors: DataFrame) -> DataFrame:
    """(lang, source, mu, w) from settled (lang, source, x)."""
    pairs = _groups(vectors)
    chunks = _chunks(vectors, pairs)
    moving, ended = _starts(chunks), None
    for _ in range(MOST_STEPS):
        now = _step(chunks, moving)
        discard(moving)
        ended = now.drop("moved") if ended is None else ended.unionByName(now.drop("moved"))
        moving = now.where("moved").select(*_PARAMS.names)
        if moving.isEmpty():
            break
    best = ended.groupBy("g").agg(F.min(F.struct("logdet", "start", "mu", "w")).alias("m"))
    return settle(pairs.join(best, "g").select("lang", "source", "m.mu", "m.w"))


def _d2(x: Column, mu: Column, w: Column) -> Column:
    """Squared length of w (x - mu)."""
    y = F.zip_with(x, mu, lambda a, b: a - b)
    rows = F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda i: F.aggregate(F.zip_with(F.slice(w, i * P + 1, P), y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    return F.aggregate(rows, F.lit(0.0), lambda s, v: s + v * v)


def judge(rows: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """All columns of `rows` (lang, source, x and others) but x, with d2 and keep."""
    m = model.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "mu", "w")
    j = rows.join(m, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    d2 = F.when(F.col("x").isNotNull(), _d2(F.col("x"), F.col("mu"), F.col("w")))
    return j.withColumn("d2", d2).withColumn("keep", F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, P), F.lit(False))).drop("of_lang", "of_source", "mu", "w", "x")


def _judged(rows: DataFrame, tail: float) -> DataFrame:
    v = settle(rows)  # texts are gone through once
    return judge(v, fit(v.where("x is not null").select("lang", "source", "x")), tail)


def assess(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """(doc_id, lang, source, d2, keep): squared robust distance of each document, and whether it stays.

    It goes if its distance has a probability under `tail` among normal vectors of its language and
    source. No statistic depends on a text's size. A null, empty or wordless text has no vector: d2
    is null and it goes. Nulls in lang or source are values of their own. Pairs under LEAST_GROUP
    documents are judged by the estimate of all documents of their language, and where these are
    fewer still by that of all documents; in small groups the floors outweigh what is estimated.
    Repeated rows count each time and get the same result. Other columns are ignored; an empty
    table gives an empty table.
    """
    return _judged(docs.select("doc_id", "lang", "source", vector_of(F.col("text")).alias("x")), tail).select("doc_id", "lang", "source", "d2", "keep")


def keep_documents(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The documents that stay, with the columns of `docs`; which they are is said at assess()."""
    return _judged(docs.select(whole_row(docs), "lang", "source", vector_of(F.col("text")).alias("x")), tail).where("keep").select("__row.*")


def query(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents"))
