"""Quality classifier: document evidence combined with hierarchical empirical-Bayes site posteriors.

A logistic model on text statistics gives each document a probability of its own. Soft counts of
these by host and by path (for documents: source, and language within source) give beta posteriors;
a path shrinks towards its host and a host towards the global rate, with strengths estimated from
the spread between sites. A document's log odds move by how far its site stands from the global rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import settle, table, whole_row
from graphloom.llm.textstats import stats, vectors
from graphloom.llm.urls import split_url
from graphloom.llm.words import buffers

#: The classifier is fitted on at most so many labelled documents, those first by hash. Everything else covers all.
MAX_LABELLED = 20_000
RIDGE, ROUNDS, KEEP_FROM = 1.0, 25, 0.5
LEAST, MOST = 1e-6, 1 - 1e-6


def features(s: np.ndarray) -> np.ndarray:
    """A constant, the statistics' vector, and its products in pairs."""
    v = vectors(s)
    i, j = np.triu_indices(v.shape[1])
    return np.concatenate([np.ones((len(v), 1)), v, v[:, i] * v[:, j]], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights) by ridge-penalized Newton steps."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[0] = 0, 1
    sd[sd < 1e-9] = 1
    z, w = (x - mean) / sd, np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, sd, w


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The document model; None where the labels hold fewer than two classes. Null labels are left out, documents labelled twice count by their smallest label."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    chosen = y.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_labelled)
    # At most max_labelled rows, whatever the corpus: small enough to send to where the texts are.
    d = docs.select("doc_id", F.col("text")).join(F.broadcast(chosen), "doc_id")
    got = d.select("y", _stats(F.col("text")).alias("s")).toArrow()
    ys = np.array(got["y"], dtype=float)
    if len(set(ys.tolist())) < 2:
        return None
    s = np.array(got["s"].combine_chunks().flatten()).reshape(len(ys), -1)
    order = np.lexsort((*s.T, ys))
    return fit_logistic(features(s[order]), (ys[order] > 0).astype(float))


def _stats(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def f(t: pa.Array) -> pa.Array:
        s = stats(*buffers(t))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.ravel()))

    return f(text)


def own_probability(text: Column, model) -> Column:
    """What the document model says; texts without words are 0, and all others 0.5 where there is no model."""

    @F.arrow_udf("double")
    def f(t: pa.Array) -> pa.Array:
        s = stats(*buffers(t))
        if model is None:
            p = np.full(len(s), 0.5)
        else:
            mean, sd, w = model
            p = 1 / (1 + np.exp(-np.clip(((features(s) - mean) / sd) @ w, -30, 30)))
        return pa.array(np.where(s[:, 1] == 0, 0.0, np.clip(p, LEAST, MOST)))

    return f(text)


def site_of(docs: DataFrame, url: str | None = None) -> tuple[Column, Column]:
    """Host and path of each document: of its URL the host and the first part of the path, where the name of such a column is given, else its source and language."""
    if url is None:
        return F.col("source").alias("host"), F.col("lang").alias("path")
    host, path, _ = split_url(F.col(url))
    return F.nullif(host, F.lit("")).alias("host"), F.regexp_extract(path, "^/([^/]*)", 1).alias("path")


def site_posteriors(scored: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(lang, source, n, s, prior, k, mu) from path, host and p, lang and source standing for path and host: counts and soft counts of each path, and what it shrinks towards, how strongly.

    A level's strength follows from the variance between its sites beyond what chance gives.
    """
    paths = scored.select(F.col(host).alias("source"), F.col(path).alias("lang"), "p").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    paths = paths.withColumn("hn", F.sum("n").over(Window.partitionBy("source"))).withColumn("hs", F.sum("s").over(Window.partitionBy("source")))
    paths = settle(paths)
    hosts = paths.groupBy("source").agg(F.first("hn").alias("hn"), F.first("hs").alias("hs"))
    world = hosts.agg(F.sum("hn").alias("N"), F.sum("hs").alias("S"), F.count(F.lit(1)).alias("H"))
    mu = F.least(F.greatest(F.col("S") / F.col("N"), F.lit(LEAST)), F.lit(MOST))
    world = world.where("N > 0").select(mu.alias("mu"), "N", "H")

    def strength(between: Column, sites: Column) -> Column:
        chance = F.col("mu") * (1 - F.col("mu"))
        extra = (between - sites * chance) / F.col("N")
        return F.least(F.greatest(chance / F.greatest(extra, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))

    h = hosts.crossJoin(F.broadcast(world))
    hb = h.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - F.col("mu"), 2)).alias("hb"))
    pb = paths.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)).alias("pb"), F.count(F.lit(1)).alias("Q"))
    world = world.crossJoin(F.broadcast(hb)).crossJoin(F.broadcast(pb)).select("mu", strength(F.col("hb"), F.col("H")).alias("kh"), strength(F.col("pb"), F.col("Q")).alias("k"))
    out = paths.crossJoin(F.broadcast(world))
    return settle(out.select("lang", "source", "n", "s", ((F.col("hs") + F.col("kh") * F.col("mu")) / (F.col("hn") + F.col("kh"))).alias("prior"), "k", "mu"))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST)), F.lit(MOST))
    return F.log(p / (1 - p))


def combine(scored: DataFrame, sites: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """`scored` (with host, path and p) with __site and __posterior; a document's own evidence is left out of its site's."""
    m = sites.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.struct("n", "s", "prior", "k", "mu").alias("__m"))
    j = scored.join(m, F.col(path).eqNullSafe(F.col("__lang")) & F.col(host).eqNullSafe(F.col("__source"))).drop("__lang", "__source")
    site = (F.col("__m.s") - F.col("p") + F.col("__m.k") * F.col("__m.prior")) / (F.col("__m.n") - 1 + F.col("__m.k"))
    j = j.withColumn("__site", site)
    odds = _logit(F.col("p")) + _logit(F.col("__site")) - _logit(F.col("__m.mu"))
    return j.withColumn("__posterior", F.when(F.col("p") <= 0, 0.0).otherwise(1 / (1 + F.exp(-odds)))).drop("__m")


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, url: str | None = None) -> DataFrame:
    """(doc_id, lang, source, p, site, posterior, keep): own probability, that of its site, both combined, and whether it reaches KEEP_FROM.

    A site is a host and a path in it: those of the column `url` where that is given, else source
    and lang. Null, empty and wordless texts have probability 0 and go. Nulls in what makes a site
    are values of their own. Without labels of both kinds every other document has probability 0.5.
    Repeated rows count each time and get the same result. Other columns are ignored; an empty table
    gives an empty table. A site's lone document has its host's posterior as site.
    """
    model = train(docs, labels, max_labelled)
    scored = settle(docs.select("doc_id", "lang", "source", *site_of(docs, url), own_probability(F.col("text"), model).alias("p")))
    out = combine(scored, site_posteriors(scored, "host", "path"), "host", "path")
    return out.select("doc_id", "lang", "source", "p", F.col("__site").alias("site"), F.col("__posterior").alias("posterior"), (F.col("__posterior") >= KEEP_FROM).alias("keep"))


def keep_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, url: str | None = None) -> DataFrame:
    """The documents that stay, with the columns of `docs`; texts are scored once."""
    p = own_probability(F.col("text"), train(docs, labels, max_labelled))
    rows = settle(docs.select(whole_row(docs), *site_of(docs, url), p.alias("p")))
    return combine(rows, site_posteriors(rows, "host", "path"), "host", "path").where(F.col("__posterior") >= KEEP_FROM).select("__row.*")


def query(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
