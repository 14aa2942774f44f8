r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role share a
block. A block is ``### role:``, a line break, its texts joined by ``\+``, a line break, ``</turn>``
and a line break. Inside texts and roles a backslash becomes ``\b``, ``###`` becomes ``\h`` and
``</turn>`` becomes ``\t`` (in roles also a line break, ``\n``), so that no text can hold a control
string and every text can be read back. The loss mask is a list of segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

HEAD, END, JOIN = "### ", "\n</turn>\n", "\\+"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\t", "</turn>"), ("\\h", "###"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, segments array<struct<text string, loss boolean>>, formatted.

    ``formatted`` is the segments' texts concatenated; the model learns the segments with ``loss``,
    which hold the escaped texts of role ``learn`` and nothing else. Null text and null role count
    as empty; turns sort by turn, then role, then text, null turns first; repeated rows are repeated
    turns; a null conversation id is a conversation; an empty table gives an empty result. A
    conversation is one row and thus one string, so it must fit in a task; other columns are not read.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    new = F.lit(None).cast("string")

    def parts(ts: Column) -> Column:
        """A list of segments for each turn: head or joint, text, and after a block's last turn its end."""

        def segment(value: Column, loss: Column) -> Column:
            return F.struct(value.alias("text"), loss.alias("loss"))

        def one(t: Column, i: Column) -> Column:
            before, after = F.when(i > 0, F.get(ts, i - 1)["role"]).otherwise(new), F.get(ts, i + 1)["role"]
            head = F.concat(F.lit(HEAD), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit(":\n"))
            start = F.when(before.eqNullSafe(t["role"]), F.lit(JOIN)).otherwise(head)
            end = F.when(after.eqNullSafe(t["role"]), F.lit("")).otherwise(F.lit(END))
            no = F.lit(False)
            return F.array(segment(start, no), segment(escape(t["text"]), t["role"] == learn), segment(end, no))

        return F.filter(F.flatten(F.transform(ts, one)), lambda s: (s["text"] != "") | s["loss"])

    made = chats.select("conv_id", let(F.col("turns"), parts).alias("segments"))
    return made.select("conv_id", "segments", F.array_join(F.col("segments")["text"], "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""

    def block(b: Column) -> Column:
        role = F.regexp_extract(b, r"^### ([^\n]*):\n", 1)
        body = F.regexp_replace(b, r"^### [^\n]*:\n", "")
        name = unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))
        return F.transform(F.split(body, r"\\\+", -1), lambda x: F.struct(name.alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, r"\n</turn>\n", -1)
    return F.flatten(F.transform(F.filter(blocks, lambda b, i: F.startswith(b, F.lit(HEAD))), block))


def op8(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    hard = "\\### Assistant: </turn> ok"
    kinds = dict(conversations.dtypes)
    extra = spark.range(1, numPartitions=1).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("i").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("i") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(hard).alias("text"),
    )
    out = format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(extra))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    turns = let(
        read_back(F.col("formatted")),
        lambda ts: F.struct(
            F.size(ts).cast("long").alias("n"),
            F.sha2(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"),
        ),
    )
    learnt = let(loss, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha")))
    got = out.select("conv_id", turns.alias("t"), learnt.alias("l"), F.length("formatted").cast("long").alias("formatted_chars"))
    return got.select(
        "conv_id",
        F.col("t.n").alias("n_turns"),
        F.col("t.sha").alias("turns_sha256"),
        F.col("l.n").alias("loss_chars"),
        F.col("l.sha").alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS safe,
         replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n') AS safe_role,
         row_number() OVER o AS i, lag(role) OVER o AS before
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role COLLATE C, text COLLATE C))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(safe) + CASE WHEN i > 1 AND before = role THEN 2 ELSE length(safe_role) + 6 + 9 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
