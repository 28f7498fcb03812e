"""Chat formatting by prefix-target expansion (operator 8), in DataFrame functions only.

A conversation is formatted once: each turn stands between control strings, and control
strings inside texts are escaped reversibly.  Every assistant turn becomes an example of its
own: all that precedes it is context and only the reply is trainable.  As the context is
always a prefix of the formatted conversation, examples keep the end of that prefix and the
span of the reply; ``examples`` cuts the texts out.  So storage grows with the conversations
and not with the square of their lengths.

Defined results: null role or text counts as empty; turns go by turn number (null first),
then role, then text, so repeated and tied rows have one order; a null conv_id is one
conversation; one without assistant turn has no example and an empty loss text; other columns
are ignored.  A conversation's text is one value, so a conversation must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    r"""Backslashes are doubled, then ``<|`` becomes ``<\|``; no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As escape; a line end, which ends the role, becomes ``<\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def starts(sizes: Column) -> Column:
    """Running sums before each of the sizes.

    An aggregate that grows an array copies it at each step, so sums run over blocks of about the square root of all, and over
    the blocks' totals."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes))).cast("int"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda so_far, n: F.struct((so_far["at"] + n).alias("at"), F.concat(so_far["starts"], F.array(so_far["at"])).alias("starts"))
    cut = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, block), lambda k: F.slice(sizes, k + 1, block))
    local = F.transform(F.when(F.size(sizes) > 0, cut).otherwise(F.array()), lambda xs: F.aggregate(xs, none, step))
    bases = F.aggregate(local, none, lambda so_far, x: step(so_far, x["at"]))["starts"]
    return F.flatten(F.zip_with(local, bases, lambda x, base: F.transform(x["starts"], lambda at: at + base)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, replies) with replies = [(begin, chars)] of assistant texts, from 0, in code points."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == TRAINED).alias("trained"),
        ),
    )
    sized = gathered.select("conv_id", parts.alias("parts"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    place = lambda p, at: F.struct((at + F.length(p["head"])).alias("begin"), F.length(p["body"]).alias("chars"), p["trained"].alias("trained"))
    # Columns of their own, so that they are worked out once and not at each use inside another function.
    sized = sized.withColumn("sizes", F.transform("parts", size)).withColumn("starts", starts(F.col("sizes")))
    placed = F.zip_with("parts", "starts", place)
    spans = F.transform(F.filter(placed, lambda r: r["trained"]), lambda r: F.struct(r["begin"].alias("begin"), r["chars"].alias("chars")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return sized.select("conv_id", text.alias("formatted"), spans.alias("replies"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: (conv_id, example, context, reply); only reply is trainable. Both are still escaped."""
    each = formatted.select("conv_id", "formatted", F.posexplode("replies").alias("example", "r"))
    return each.select(
        "conv_id",
        "example",
        F.expr("substring(formatted, 1, r.begin)").alias("context"),
        F.expr("substring(formatted, r.begin + 1, r.chars)").alias("reply"),
    )


def turns(formatted: Column) -> Column:
    """[(role, text)] read back from a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all conversations and one made of control strings, formatted, written and read back."""
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = common.written(format_conversations(rows), "chat")
    whole = made.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns(F.col("formatted")).alias("turns"))
    whole = whole.select(
        "conv_id",
        "formatted_chars",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    replies = F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: unescape(x["reply"]))
    losses = examples(made).groupBy("conv_id").agg(F.array_join(replies, "").alias("loss"))
    loss = F.coalesce("loss", F.lit(""))
    return (
        whole.join(losses.withColumnRenamed("conv_id", "loss_id"), F.col("conv_id").eqNullSafe(F.col("loss_id")), "left")
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


#: DuckDB twin of op8.  Escapes only lengthen texts: a backslash and `<|` by one character each.
CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + 1 + 11
    + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
