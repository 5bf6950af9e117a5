"""Operator 1, chat formatting: a grammar with a round trip, in SQL functions.

Grammar of a rendered conversation (a concatenation of turns)::

    turn := '<s>' role '[INST]' text '[/INST]</s>'

``<s>``, ``[INST]``, ``[/INST]`` and ``</s>`` are control strings.  The parser
is fixed: it splits at ``</s>``, takes role and text between the other
control strings, and removes one escape level from both.  Rendering first
writes a turn verbatim and parses it; a turn that does not come back
identical is rendered again with its control strings escaped and parsed
again; a conversation that still differs fails the job instead of passing
silently.

Escaping puts one backslash after the first character of a control string
(``</s>`` -> ``<\\/s>``); a string that already carries backslashes there gets
one more, so unescaping is its exact inverse for every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the grammar.
TURN_START, TEXT_START, TEXT_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
# A control string with any number of escaping backslashes.
ANGLE, SQUARE = r"(<)(\\*)(/?s>)", r"(\[)(\\*)(/?INST\])"


@dataclass(frozen=True)
class ChatColumns:
    conversation: str = "conv_id"
    turn: str = "turn"
    role: str = "role"
    text: str = "text"


def escape(col: Column) -> Column:
    """One escape level more on every control string."""
    for pattern in (ANGLE, SQUARE):
        col = F.regexp_replace(col, pattern, r"$1\\$2$3")
    return col


def unescape(col: Column) -> Column:
    """One escape level less (control strings without a backslash stay)."""
    for pattern in (r"(<)\\(\\*/?s>)", r"(\[)\\(\\*/?INST\])"):
        col = F.regexp_replace(col, pattern, r"$1$2")
    return col


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(TURN_START), role, F.lit(TEXT_START), text, F.lit(TEXT_END), F.lit(TURN_END)
    )


def parse(rendered: Column) -> Column:
    """Array of (role, text) read back from rendered turns.

    Text after the last turn end, and a turn without its control strings in
    place, come back as a turn with null role and text, so that a damaged
    rendering can never equal its source.
    """
    pieces = F.split(rendered, r"</s>", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    shape = r"(?s)\A<s>(.*?)\[INST\](.*?)\[/INST\](.*)\z"

    def one(piece: Column) -> Column:
        ok = piece.rlike(shape) & (F.regexp_extract(piece, shape, 3) == "")
        part = lambda k: F.when(ok, unescape(F.regexp_extract(piece, shape, k)))
        return F.struct(part(1).alias("role"), part(2).alias("text"))

    return F.transform(turns, one)


def format_conversations(df: DataFrame, cols: ChatColumns = ChatColumns()) -> DataFrame:
    """One rendered text per conversation, with the source turns beside it.

    Turns are ordered by (turn, role, text), nulls first, so ties and
    repeated rows have one defined order and every row is one turn.  Null
    roles and texts are empty; rows with a null conversation id form one
    conversation.  Other columns are ignored.

    The escape decision is per turn, before grouping, so the work on a hot
    conversation is spread over its rows; only the rendered pieces of one
    conversation meet in one row, which is the operator's result.

    Columns: conv_id, formatted, turns (role, text), escaped_turns.
    """
    role = F.coalesce(F.col(cols.role).cast("string"), F.lit(""))
    text = F.coalesce(F.col(cols.text).cast("string"), F.lit(""))
    turns = df.select(
        F.col(cols.conversation).alias("conv_id"),
        F.col(cols.turn).alias("turn"),
        role.alias("role"),
        text.alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    plain = render_turn(F.col("role"), F.col("text"))
    safe = render_turn(escape(F.col("role")), escape(F.col("text")))
    conflicts = F.col("role").rlike(f"{ANGLE}|{SQUARE}") | F.col("text").rlike(f"{ANGLE}|{SQUARE}")
    turns = turns.withColumn("plain_ok", ~conflicts | (parse(plain) == source))
    turns = turns.withColumn("piece", F.when(F.col("plain_ok"), plain).otherwise(safe))
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("t"),
        F.sum((~F.col("plain_ok")).cast("long")).alias("escaped_turns"),
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias(
            "turns"
        ),
        "escaped_turns",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse the rendered texts and require them to equal the source turns.

    Adds ``recovered``; a difference raises, naming the conversation.
    """
    parsed = formatted.withColumn("recovered", parse(F.col("formatted")))
    same = F.col("recovered") == F.col("turns")
    return parsed.withColumn(
        "recovered",
        F.when(F.coalesce(same, F.lit(False)), F.col("recovered")).otherwise(
            F.raise_error(
                F.concat(
                    F.lit("chat round trip differs in conversation "),
                    F.coalesce(F.col("conv_id").cast("string"), F.lit("null")),
                )
            ).cast("array<struct<role:string,text:string>>")
        ),
    )


def digests(parsed: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """The contract's columns, taken from the turns read back."""
    turns = F.col("recovered")
    all_turns = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(F.filter(turns, lambda t: t["role"] == loss_role)["text"], "")
    return parsed.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("escaped_turns").cast("long").alias("escaped_turns"),
    )
