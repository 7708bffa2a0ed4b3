"""Chat formatting from event logs, in DataFrame operations alone.

A log holds events (conv_id, message_id, seq, kind, role, text). By sequence, a
``message`` opens a message, a ``delta`` appends to it, an ``edit`` puts its text in
place of what stood there, a ``regenerate`` discards it and starts over. The folded
messages are rendered into one string a conversation, with the loss mask over what
assistants say.

A turn is ``<s>[INST] role [/INST] text </s>``. ``<s>``, ``</s>``, ``[INST]`` and
``[/INST]`` inside roles and texts get a backslash after their first character, and
any that already have backslashes there get one more; taking one away again restores
every text exactly, and no text can imitate a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, END = "<s>[INST] ", " [/INST] ", " </s>"
MARKS = r"/?s>|/?INST\]"
SPOKEN = "assistant"
#: Code points of a draft.
DRAFT = 16
#: Kinds after which nothing said before counts.
AFRESH = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={MARKS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={MARKS})", r"$1$2")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, part, role, text).

    Several ``message`` events of one id are messages of their own, told apart by
    ``part``; so repeated rows stay repeated. Ties in ``seq`` go by role, then text.
    Null texts are empty; a message's role is the first that is not null, else empty.
    """
    line = Window.partitionBy("conv_id", "message_id").orderBy("seq", "role", "text")
    events = events.select("conv_id", "message_id", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    numbered = events.withColumn("n", F.row_number().over(line)).withColumn(
        "part", F.sum((F.col("kind") == "message").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    said = F.struct("n", "text")
    folded = numbered.groupBy("conv_id", "message_id", "part").agg(
        F.max(F.when(F.col("kind").isin(*AFRESH), F.col("n"))).alias("afresh"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("n", "role"))).alias("speaker"),
        F.collect_list(said).alias("said"),
    )
    # Named columns inside the lambda come from the row.
    held = F.filter("said", lambda x: x["n"] >= F.coalesce(F.col("afresh"), F.lit(0)))
    return folded.select(
        "conv_id", "message_id", "part", F.coalesce("speaker.role", F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(held), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """A row a conversation: conv_id, formatted, loss_spans.

    Empty messages are turns like any other; no message gives no conversation.
    A span is (turn, start, at, length): its turn from 0, its first code point in the
    whole string and in its turn, and its length, all after escaping.
    """
    escaped = messages.select("conv_id", "message_id", "part", "role", escape(F.col("role")).alias("r"), escape(F.col("text")).alias("t"))
    turned = escaped.select(
        "conv_id", "message_id", "part", "role",
        F.concat(F.lit(OPEN), "r", F.lit(MIDDLE), "t", F.lit(END)).alias("turn"),
        (F.length("r") + len(OPEN + MIDDLE)).alias("at"), F.length("t").alias("length"),
    )
    line = Window.partitionBy("conv_id").orderBy("message_id", "part")
    before = F.coalesce(F.sum(F.length("turn")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turned.withColumn("before", before).withColumn("n", F.row_number().over(line) - 1)
    span = F.struct(F.col("n").alias("turn"), (F.col("before") + F.col("at")).alias("start"), "at", "length")
    return placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "turn"))), lambda x: x["turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == SPOKEN, span))).alias("loss_spans"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """``rendered`` with ``turns`` (role, text) and ``loss`` (the text under the mask, empty if there is none), both unescaped."""
    pieces = rendered.withColumn("pieces", F.split("formatted", "</s>"))
    pieces = pieces.withColumn("pieces", F.slice("pieces", 1, F.size("pieces") - 1))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r" \[/INST\] ", 2)
        text = F.get(halves, F.lit(1))
        return F.struct(
            unescape(F.substring(F.get(halves, F.lit(0)), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.left(text, F.length(text) - 1)).alias("text"),
        )

    under = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.get(F.col("pieces"), s["turn"]), s["at"] + 1, s["length"]))
    )
    return pieces.withColumns({"turns": F.transform("pieces", turn), "loss": F.array_join(under, "")}).drop("pieces")


def from_table(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as the log of a chat that ended with them.

    A row is a message at its place in its conversation, by turn, role and text, nulls last. What
    a user says is typed in two pieces; what an assistant says is begun, thrown away and streamed
    anew; what others say is drafted and then edited.
    """
    line = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_last() for c in ("turn", "role", "text")))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    left, right, draft = F.left(text, half), F.substr(text, half + 1), F.left(text, F.lit(DRAFT))

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), said.alias("text")) for n, (kind, said) in enumerate(events)))

    typed = log(("message", left), ("delta", right))
    streamed = log(("message", draft), ("regenerate", F.lit("")), ("delta", left), ("delta", right))
    edited = log(("message", draft), ("edit", text))
    events = F.when(F.col("role") == SPOKEN, streamed).when(F.col("role") == "user", typed).otherwise(edited)
    placed = conversations.select("conv_id", F.row_number().over(line).alias("message_id"), "role", events.alias("events"))
    return placed.select("conv_id", "message_id", "role", F.explode("events").alias("e")).select(
        "conv_id", "message_id", F.col("e.step").alias("seq"), "e.kind", "role", "e.text"
    )


def op4(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, and of conversation -1.

    Rows go by turn, then role, then text, nulls last; null texts and roles are empty; repeated
    rows are turns of their own; rows without conv_id are one conversation. An empty table leaves
    conversation -1. A conversation is one string, so its turns meet in one task.
    """
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.sql(
        f"SELECT -1L conv_id, turn, role, '{said}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    read_back = parse(render(fold(from_table(rows))))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The texts as they went in: what is read back must say the same. The template adds
#: 24 characters a turn, its role, and a backslash for each control string.
ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(coalesce(role, '')) + 24 + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""
assert len(OPEN + MIDDLE + END) == 24
