"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply, with the mark that ends it, is trainable. Marks in what turns say are escaped, so that no
text can open or end a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table

OPEN, SHUT, TRAIN = "<|{}|>\n", "<|end|>\n", "assistant"


def escaped(text: Column) -> Column:
    """Each "<|" as "<||", which can be undone and is no mark."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, n_context, context, target, train_from, train_to) for each assistant turn.

    The example is context followed by target; characters train_from up to, not including, train_to
    of it are trainable, which is the reply and its end mark without its role heading. Roles are
    taken in lower case without outer blanks, and a null one is "unknown". "<|" in texts and roles becomes "<||". A null text is
    empty. Turns with equal or null numbers (nulls first) are ordered by role and then text, and
    each repeated row is a turn of its own. A row without a conversation's id is a conversation of
    its own. An assistant turn that opens a conversation has an empty context. A conversation
    without assistant turns gives nothing, and other columns are ignored.

    One shuffle, on the conversation; the work in a conversation is the size of its output, which grows with the square of its length.
    """
    r = escaped(F.lower(F.trim(F.coalesce(F.col(role), F.lit("unknown")))))
    body = escaped(F.coalesce(F.col(text), F.lit("")))
    head = F.concat(F.lit("<|"), r, F.lit("|>\n"))
    one = turns.select(F.col(conv).alias("c"), F.struct(F.col(turn).alias("t"), r.alias("r"), body.alias("x"), F.concat(head, body, F.lit(SHUT)).alias("s")).alias("m"))
    convs = one.where("c is not null").groupBy("c").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    each = convs.select("c", "ms", F.posexplode("ms").alias("i", "m")).where(F.col("m.r") == TRAIN)
    context = F.array_join(F.transform(F.slice("ms", 1, F.col("i")), lambda m: m["s"]), "")
    ready = each.select("c", "i", "m", context.alias("context"))
    ready = ready.unionByName(one.where("c is null").where(F.col("m.r") == TRAIN).select("c", F.lit(0).alias("i"), "m", F.lit("").alias("context")))
    start = F.length("context") + len(OPEN.format(TRAIN))
    return ready.select(
        F.col("c").alias("conv_id"), F.col("m.t").alias("turn"), F.col("i").alias("n_context"), "context", F.col("m.s").alias("target"),
        start.alias("train_from"), (start + F.length("m.x") + len(SHUT)).alias("train_to"),
    )


def query(spark, sf_dir):
    return expand(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(lower(trim(coalesce(role, 'unknown'))), '<|', '<||') AS r, replace(coalesce(text, ''), '<|', '<||') AS x,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations),
w AS (
  SELECT *, row_number() OVER o - 1 AS n_context,
    coalesce(string_agg('<|' || r || '|>' || chr(10) || x || '<|end|>' || chr(10), '') OVER (
      PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, r, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
  FROM t WINDOW o AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, r, x))
SELECT conv_id, turn, n_context::INT AS n_context, context, '<|assistant|>' || chr(10) || x || '<|end|>' || chr(10) AS target,
  (length(context) + 14)::INT AS train_from, (length(context) + 14 + length(x) + 8)::INT AS train_to
FROM w WHERE r = 'assistant'
"""
