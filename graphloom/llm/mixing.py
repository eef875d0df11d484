"""Mixing of sources to target weights.

Within a source, documents are ordered by a random key that is a hash of epoch and document. The
key's leading digits range-partition the order (the hash is uniform, so equal ranges hold equal
shares and no sampling is needed); prefix sums of tokens run over the ranges first and then over
the documents of the one range in which a source's budget ends.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import settle, table, text_of, whole_row
from graphloom.llm.words import buffers, token_counts

WEIGHTS = {"src0": 4, "src1": 2, "src2": 2, "src3": 2}
DEFAULT_WEIGHT, SEED, RANGE_DIGITS = 1, "mix-1", 3
#: Epochs are numbers of four digits to this base, more than any budget reaches.
DIGIT = 1 << 14


def words_in(text: Column) -> Column:
    """Tokens of a text: runs of anything but blanks, tabs and line ends. Counted over whole Arrow columns, which takes a tenth of the time of regular expressions."""

    @F.arrow_udf("bigint")
    def f(t: pa.Array) -> pa.Array:
        return pa.array(token_counts(*buffers(t)))

    return f(text)


def _key(epoch: Column, doc: Column, digest: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("")), digest).cast("binary"))


def _weight(source: Column, weights: dict[str, int], default: int) -> Column:
    w = F.lit(default)
    for k, v in weights.items():
        w = F.when(source == k, F.lit(int(v))).otherwise(w)
    return w.cast("bigint")


def _units(docs: DataFrame) -> DataFrame:
    text = text_of("text")
    return docs.select("doc_id", "source", F.md5(text.cast("binary")).alias("digest"), words_in(text).alias("tokens"))


def cuts(units: DataFrame, weights=WEIGHTS, default=DEFAULT_WEIGHT, total: int | None = None, seed=SEED) -> DataFrame:
    """For each source: its whole epochs, and the key, document and tokens at which the epoch after those ends."""
    per = units.groupBy("source").agg(F.sum("tokens").alias("have")).withColumn("w", _weight(F.col("source"), weights, default))
    all_ = per.agg(F.sum("have").alias("t"), F.sum("w").alias("ws"))
    want = F.lit(total).cast("bigint") if total is not None else F.col("t")
    per = per.crossJoin(F.broadcast(all_)).withColumn("budget", F.when(F.col("ws") > 0, F.floor(want.cast("decimal(38,0)") * F.col("w") / F.greatest("ws", F.lit(1)).cast("decimal(19,0)"))).otherwise(0).cast("bigint"))
    full = F.when(F.col("have") > 0, F.expr("budget div have")).when(F.col("w") > 0, 1).otherwise(0).cast("bigint")
    per = per.withColumn("epochs", full).withColumn("rest", F.when(F.col("have") > 0, F.expr("budget % have")).otherwise(0)).select("source", "budget", "epochs", "rest")
    per = settle(per)
    same = F.col("u.source").eqNullSafe(F.col("p.source"))
    open_ = units.alias("u").join(per.where("rest > 0").alias("p"), same).select("u.*", "p.rest", "p.epochs")
    open_ = open_.withColumn("key", _key(F.col("epochs"), F.col("doc_id"), F.col("digest"), seed)).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = open_.groupBy("source", "range").agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")
    ranges = ranges.withColumn("before", before).where("before < rest and before + n >= rest")
    ranges = ranges.select("source", "range", "before")
    last = open_.alias("o").join(ranges.alias("r"), F.col("o.source").eqNullSafe(F.col("r.source")) & (F.col("o.range") == F.col("r.range")))
    last = last.select("o.*", "r.before")
    # Copies alike in source, document and text are peers in the order: the frame takes them together.
    end = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0))
    alike = Window.partitionBy("source", "key")
    last = last.withColumn("end", end).withColumn("start", F.col("end") - F.sum("tokens").over(alike)).withColumn("copies", F.count(F.lit(1)).over(alike))
    last = last.where("start < rest and end >= rest").groupBy("source").agg(F.min("key").alias("cut_key"), F.min(F.expr("(rest - start) div copies")).alias("cut_tokens"))
    joined = per.alias("p").join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
    return settle(joined.select("p.*", "l.cut_key", "l.cut_tokens"))


def _picked(rows: DataFrame, at: DataFrame, seed: str) -> DataFrame:
    """`rows` (with doc_id, source, __digest, __tokens) once for each epoch that takes them, with epoch, mix_key and take_tokens."""
    at = at.select(F.col("source").alias("__source"), "budget", "epochs", "cut_key", "cut_tokens").select("__source", F.struct("epochs", "cut_key", "cut_tokens").alias("__at"))
    j = rows.join(at, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    last = _key(F.col("__at.epochs"), F.col("doc_id"), F.col("__digest"), seed)
    j = j.withColumn("__last", F.when(F.col("__at.cut_key").isNotNull(), last))
    partly = F.col("__last") <= F.col("__at.cut_key")
    n = F.col("__at.epochs") + F.coalesce(partly, F.lit(False)).cast("int")
    # Epochs are counted up digit by digit, so that no row ever holds an array of all of them.
    j = j.withColumn("__n", n).where("__n > 0").withColumn("epoch", F.lit(0).cast("bigint"))
    for low in (DIGIT**3, DIGIT**2, DIGIT, 1):
        most = F.expr(f"(__n - 1 - epoch) div {low}")
        j = j.withColumn("__digit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(most, F.lit(DIGIT - 1))))).withColumn("epoch", F.col("epoch") + F.col("__digit") * low).drop("__digit")
    cut = (F.col("epoch") == F.col("__at.epochs")) & (F.col("__last") == F.col("__at.cut_key"))
    j = j.withColumn("take_tokens", F.when(F.coalesce(cut, F.lit(False)), F.col("__at.cut_tokens")).otherwise(F.col("__tokens")))
    return j.withColumn("mix_key", _key(F.col("epoch"), F.col("doc_id"), F.col("__digest"), seed)).drop("__at", "__last", "__n")


def mix(docs: DataFrame, weights=WEIGHTS, default=DEFAULT_WEIGHT, total: int | None = None, seed=SEED) -> DataFrame:
    """(doc_id, source, epoch, mix_key, tokens, take_tokens): the documents of the mix, each once for every epoch.

    A source's budget is its integer weight's share of `total` (the input's tokens if None), rounded
    down; sources not in `weights` have weight `default`, and a null source is a source. Each takes
    all its documents budget // tokens times, then the beginning of one more epoch's order up to
    the exact budget, the document at the cut giving only its first take_tokens tokens. Null and
    empty texts have no tokens; they come with every whole epoch, and with the last if their key is
    before the cut. A source without any tokens gives its documents once if its weight is positive.
    Copies alike in document, source and text stand or fall together and share what is left at the
    cut evenly, rounded down. The result has a row for each document and epoch, so a `total` far beyond a source's tokens makes it
    as long as it says. Other columns are ignored; an empty table gives an empty table.
    """
    units = settle(_units(docs))
    rows = units.withColumnsRenamed({"digest": "__digest", "tokens": "__tokens"})
    return _picked(rows, cuts(units, weights, default, total, seed), seed).select("doc_id", "source", "epoch", "mix_key", F.col("__tokens").alias("tokens"), "take_tokens")


def mix_documents(docs: DataFrame, weights=WEIGHTS, default=DEFAULT_WEIGHT, total: int | None = None, seed=SEED) -> DataFrame:
    """The mix as documents, with the columns of `docs`: repeated by epoch, the text at a cut shortened and n_chars made anew.

    The texts are not shuffled: what decides is one small row for each source.
    """
    at = cuts(settle(_units(docs)), weights, default, total, seed)
    text = text_of("text")
    rows = docs.select(whole_row(docs), "doc_id", "source", F.md5(text.cast("binary")).alias("__digest"), words_in(text).alias("__tokens"))
    p = _picked(rows, at, seed)
    text = text_of(F.col("__row.text"))
    short = F.array_join(F.slice(F.split(F.regexp_replace(text, "^[ \\t\\n\\r]+", ""), "[ \\t\\n\\r]+"), 1, F.col("take_tokens").cast("int")), " ")
    is_cut = F.col("take_tokens") < F.col("__tokens")
    p = p.withColumn("__text", F.when(is_cut, short).otherwise(F.col("__row.text")))
    made = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(is_cut, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return p.select(*[made.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


_CASE = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + f" ELSE {DEFAULT_WEIGHT} END"
SQL = f"""
WITH u AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS have, {_CASE} AS w FROM u GROUP BY source),
b AS (SELECT source, have, w, ((SELECT sum(have) FROM s) * w // (SELECT sum(w) FROM s))::BIGINT AS budget FROM s),
e AS (
  SELECT u.*, b.budget, CASE WHEN have > 0 THEN budget // have WHEN w > 0 THEN 1 ELSE 0 END AS epochs,
    CASE WHEN have > 0 THEN budget % have ELSE 0 END AS rest FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source),
x AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM e),
k AS (SELECT *, md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest) AS mix_key FROM x),
c AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY mix_key RANGE UNBOUNDED PRECEDING) AS fin,
    sum(tokens) OVER (PARTITION BY source, epoch, mix_key) AS own, count(*) OVER (PARTITION BY source, epoch, mix_key) AS copies FROM k)
SELECT doc_id, source, epoch::BIGINT AS epoch, mix_key, tokens,
  (CASE WHEN epoch < epochs OR fin < rest THEN tokens ELSE (rest - (fin - own)) // copies END)::BIGINT AS take_tokens
FROM c WHERE epoch < epochs OR fin - own < rest
"""
