"""Chat formatting: fold an event log of conversations into messages, render them, read them back.

All steps are built-in functions.  A log row says what happened to one message of one conversation:

- ``message`` opens it with a role and a text, ``delta`` appends text to it,
- ``edit`` replaces its text, ``regenerate`` drops its draft and starts a new one (its text may be empty).

Rendering marks turns as ``<|im_start|>role\\n...<|im_end|>\\n``.  Control strings of this and of
other common templates cannot occur in a rendered text: ``\\`` becomes ``\\\\``, the ``<`` or ``[``
that opens a control string becomes ``\\l`` or ``\\b`` (and a line break in a role ``\\n``), which
reads back uniquely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Control strings of public chat templates, with the way each one is written inside a text.
CONTROLS = (
    ("<|", "\\l|"),
    ("<s>", "\\ls>"),
    ("</s>", "\\l/s>"),
    ("<<SYS>>", "\\l<SYS>>"),
    ("<</SYS>>", "\\l</SYS>>"),
    ("[INST]", "\\bINST]"),
    ("[/INST]", "\\b/INST]"),
)

RESETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, written in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(written))
    return out


def unescape(text: Column) -> Column:
    """Inverse of ``escape``: the double backslashes split the text, the rest is unambiguous in each part."""

    def part(p: Column) -> Column:
        for written, plain in (("\\l", "<"), ("\\b", "["), ("\\n", "\n")):
            p = F.replace(p, F.lit(written), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """One row per (conv_id, message): place, role, text.

    ``events``: conv_id, message, seq, kind, role, text (others are ignored).  ``seq`` and
    ``message`` may be of any type that sorts.  Events are folded per message, so that a
    conversation with a third of the log is still dealt over many tasks.  Equal ``seq``:
    by kind, role, text.  Null text appends nothing; the last role that is given holds;
    a message that only has deltas starts empty; an unknown kind counts as a delta.
    """
    logged = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text")))
    rows = events.groupBy("conv_id", "message").agg(logged.alias("e"), F.min("seq").alias("place"))
    last_reset = F.array_max(F.transform("e", lambda x, i: F.when(x["kind"].isin(*RESETS), i + 1).otherwise(1)))
    live = F.slice(F.col("e"), F.col("last"), F.size("e"))
    roles = F.filter(F.transform("e", lambda x: x["role"]), lambda r: r.isNotNull())
    return rows.withColumn("last", last_reset).select(
        "conv_id",
        "message",
        "place",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss_spans (start and length in code points), n_turns.

    ``messages``: conv_id, place, message, role, text.  Turns come by place, ties by message, role, text.
    The offsets are running sums over the turns; one conversation's string is the largest thing held.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    shown = messages.select(
        "conv_id", "place", "message", "role", "text", head.alias("_head"), escape(F.col("text")).alias("_body")
    ).withColumn("_turn", F.concat("_head", "_body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("place", "message", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.select(
        "conv_id",
        F.row_number().over(order).alias("_n"),
        "_turn",
        (F.coalesce(F.sum(F.length("_turn").cast("bigint")).over(before), F.lit(0)) + F.length("_head")).alias("_start"),
        F.length("_body").alias("_len"),
        (F.col("role") == loss_role).alias("_loss"),
    )
    turns = F.sort_array(F.collect_list(F.struct("_n", "_turn", "_start", "_len", "_loss")))
    spans = F.transform(
        F.filter("t", lambda x: x["_loss"]),
        lambda x: F.struct(x["_start"].cast("int").alias("start"), x["_len"].cast("int").alias("length")),
    )
    grouped = placed.groupBy("conv_id").agg(turns.alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["_turn"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a rendered conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    cut = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = unescape(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.struct(role.alias("role"), unescape(F.substr(piece, F.length(head) + 2)).alias("text"))

    return F.transform(cut, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, spans in order with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def row_events(rows: DataFrame, streamed: str = "assistant", piece: int = 256, pieces: int = 64) -> DataFrame:
    """Event log of a table that has whole messages (conv_id, turn, role, text).

    A message of the streamed role arrives as an opening and deltas (of ``piece`` code points, longer
    ones where that would make more than ``pieces``), any other in one event.  Rows with equal
    conversation and turn stay separate messages, by role and text; null text is empty, a null role too.
    """
    plain = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    size = F.greatest(F.lit(piece), F.ceil(F.length("text") / pieces)).cast("int")
    count = F.when(F.col("role") == streamed, F.greatest(F.lit(1), F.ceil(F.length("text") / F.col("_size")))).otherwise(1)
    cut = plain.withColumn("_tie", tie).withColumn("_size", size).withColumn("_parts", count.cast("int"))
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    text = F.when(F.col("_parts") == 1, F.col("text")).otherwise(
        F.substr(F.col("text"), F.col("_part") * F.col("_size") + 1, F.col("_size"))
    )
    return dealt.select(
        "conv_id",
        F.struct("turn", "_tie").alias("message"),
        F.struct("turn", "_tie", "_part").alias("seq"),
        F.when(F.col("_part") == 0, "message").otherwise("delta").alias("kind"),
        F.when(F.col("_part") == 0, F.col("role")).alias("role"),
        text.alias("text"),
    )
