"""Chat formatting: every reply becomes an example of its own, with all turns before it as context."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
ASK, ASKED = "[INST]", "[/INST]"
#: Strings that mean something in the template.
CONTROLS = (BEGIN, END, ASK, ASKED)


def _tails(controls: Sequence[str]) -> dict[str, str]:
    """A pattern for what follows the first character, for each first character of the controls."""
    if any(len(c) < 2 or "\\" in c for c in controls) or {c[0] for c in controls} & {x for c in controls for x in c[1:]}:
        raise ValueError("controls need two characters, no backslash, and a first character that none of them has later")
    return {x: "|".join(sorted(re.escape(c[1:]) for c in controls if c[0] == x)) for x in {c[0]: 0 for c in controls}}


def escaped(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """``text`` with a backslash more behind the first character of each control string.

    A control string in this sense may have backslashes there already, so the escape can be taken back exactly, and
    none of ``controls`` is left.
    """
    for first, tails in _tails(controls).items():
        text = F.regexp_replace(text, rf"{re.escape(first)}(\\*)({tails})", rf"{re.escape(first)}\\$1$2")
    return text


def unescaped(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """Takes ``escaped`` back."""
    for first, tails in _tails(controls).items():
        text = F.regexp_replace(text, rf"{re.escape(first)}\\(\\*)({tails})", rf"{re.escape(first)}$1$2")
    return text


def prefix_examples(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_role: str = "assistant",
) -> DataFrame:
    """One example for each reply (turn of ``trained_role``): all turns before it and, alone trainable, the reply.

    Returns the id, ``example`` (from 0), ``n_turns`` (turns in its text), ``text``, ``loss_begin`` (from 0) and
    ``loss_chars``, the span of the reply's text in ``text``, both in code points, and ``closes``: whether all turns of
    the conversation are in it. Turns behind the last reply stand in a closing example without a span (nulls).

    A text is ``<s>`` and its turns: ``[INST]role``, a line feed, the text and ``[/INST]``, or for a reply its
    text and ``</s>``. Control strings in texts are escaped, roles are URL-encoded, so that ``read_turns`` gives back what was formatted.

    Turns are put in order by ``turn_col`` (null last), then role, then text; repeated rows are turns of their own. A null text or
    role is empty. Rows without id are one conversation. Other columns are not read. An empty table gives no examples. Every example carries its
    whole context, so a conversation's examples grow with the square of its turns; they are written one after the other, and no
    task holds more than one conversation's turns and one example. A conversation must fit in one string.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    reply = role == trained_role
    body = escaped(F.coalesce(F.col(text_col), F.lit("")))
    piece = F.when(reply, F.concat(body, F.lit(END))).otherwise(F.concat(F.lit(ASK), F.url_encode(role), F.lit("\n"), body, F.lit(ASKED)))
    turn = F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), role.alias("role"), piece.alias("piece"), reply.alias("reply"))
    whole = turns.select(F.col(id_col).alias("own_id"), turn.alias("own_turn")).groupBy("own_id").agg(F.sort_array(F.collect_list("own_turn")).alias("t"))
    ends = F.expr("filter(sequence(1, size(t)), i -> i = size(t) or t[i - 1].reply)")
    each = whole.select("own_id", "t", F.posexplode_outer(ends).alias("example", "n_turns"))  # inner would repeat the filter's lambda
    last = F.expr("t[n_turns - 1]")
    text = F.concat(F.lit(BEGIN), F.array_join(F.slice(F.col("t.piece"), F.lit(1), F.col("n_turns")), ""))
    loss = F.when(last["reply"], F.length(last["piece"]) - len(END))
    out = each.select("own_id", "example", "n_turns", text.alias("text"), loss.alias("loss_chars"), (F.col("n_turns") == F.size("t")).alias("closes"))
    begin = (F.length("text") - len(END) - F.col("loss_chars")).alias("loss_begin")
    return out.select(F.col("own_id").alias(id_col), "example", "n_turns", "text", begin, "loss_chars", "closes")


def read_turns(text: Column, trained_role: str = "assistant") -> Column:
    """The turns in an example's text, as structs of ``role`` and ``text``."""
    ends = rf"(?<={re.escape(ASKED)}|{re.escape(END)})"
    pieces = F.filter(F.split(F.substr(text, F.lit(len(BEGIN) + 1)), ends), lambda x: x != "")

    def turn(piece: Column) -> Column:
        asked = F.substr(piece, F.lit(len(ASK) + 1), F.length(piece) - len(ASK) - len(ASKED))
        role = F.url_decode(F.substring_index(asked, "\n", 1))
        replied = F.substr(piece, F.lit(1), F.length(piece) - len(END))
        is_reply = F.endswith(piece, F.lit(END))
        body = F.when(is_reply, replied).otherwise(F.substr(asked, F.instr(asked, "\n") + 1))
        return F.struct(F.when(is_reply, F.lit(trained_role)).otherwise(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(examples: DataFrame) -> Column:
    """The text under an example's span, unescaped."""
    return unescaped(F.substr(examples["text"], examples["loss_begin"] + 1, examples["loss_chars"]))
