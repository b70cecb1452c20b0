"""Chat formatting from event logs: fold each conversation's events into final messages, then render them.

A log has events (conv_id, seq, message_id, kind, role, text). Kinds: `open` begins a message and gives its role;
`delta` adds text to it; `edit` replaces what it has so far; `regenerate` empties it. A conversation's events are dealt
to one place by conv_id, sorted by seq and folded; messages stand in the order of their `open` events. Everything is
built of native functions, and the sort, the fold of messages and that of conversations share one shuffle. All steps
take time in proportion to a conversation's length: places come from running sums, and masked text is cut from a coding
of fixed width.

Template, for each message: `<s>[INST] role [/INST]text</s>`. Inside role and text a backslash is doubled, and a control
string gets a backslash after its first character, so no control string is left inside and the text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters in one streamed delta, where a log is made from whole turns.
DELTA_CHARS = 512
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]", "</s>"


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def log_of(turns: DataFrame, revised: bool = False) -> DataFrame:
    """An event log of whole turns (conv_id, turn, role, text): each is opened and streamed in deltas.

    Rows with the same turn are messages of their own, ordered by role and text; repeated rows are messages each. A null
    text is empty; other columns are ignored. revised: every message first streams a draft, which is then taken back, by
    a regeneration (assistant) or an edit (others), so that what is left is the turn as it stands.
    """
    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.floor((F.length("text") + DELTA_CHARS - 1) / DELTA_CHARS).cast("int")
    deltas = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.lit("delta").alias("kind"), F.substring(F.col("text"), k * DELTA_CHARS + 1, F.lit(DELTA_CHARS)).alias("text")))
    opened = F.array(F.struct(F.lit("open").alias("kind"), F.lit("").alias("text")))
    if revised:
        again = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
        opened = F.concat(opened, F.array(F.struct(F.lit("delta").alias("kind"), F.lit("draft </s>").alias("text")), F.struct(again.alias("kind"), F.lit("").alias("text"))))
    events = F.when(parts > 0, F.concat(opened, deltas)).otherwise(opened)
    number = F.expr("row_number() over (partition by conv_id order by turn nulls first, role nulls first, text)")
    rows = clean.withColumn("message_id", number).withColumn("event", F.explode(F.transform(events, lambda e, k: F.struct(k.alias("k"), e["kind"].alias("kind"), e["text"].alias("text")))))
    seq = F.struct(F.col("message_id").cast("long").alias("major"), F.col("event.k").cast("long").alias("minor"))
    return rows.select("conv_id", seq.alias("seq"), F.col("message_id").cast("long").alias("message_id"), "event.kind", "role", "event.text")


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, place, role, text) of a log, whose seq is of any type with an order.

    A message's text: what its last edit or regeneration left (nothing, for the latter), and all deltas after it. Null
    texts are empty. Equal seqs are ordered by kind and text. Events of a message that was never opened count as one
    without a role, placed at its first event.
    """
    own = F.array_sort(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")))
    rows = events.groupBy("conv_id", "message_id").agg(own.alias("own"))
    last = F.array_max(F.transform("own", lambda e, k: F.when(e["kind"].isin("edit", "regenerate"), k).otherwise(F.lit(-1))))
    rows = rows.withColumn("last", last)
    text = F.array_join(F.transform(F.filter("own", lambda e, k: (k >= F.col("last")) & e["kind"].isin("edit", "delta")), lambda e: e["text"]), "")
    first = F.filter("own", lambda e: e["kind"] == "open")
    place = F.coalesce(F.get(first, F.lit(0))["seq"], F.col("own")[0]["seq"])
    return rows.select("conv_id", "message_id", place.alias("place"), F.get(first, F.lit(0))["role"].alias("role"), text.alias("text"))


def render(final: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the rendered conversation, and the spans (start, length, in characters) of it that
    are under the loss mask, each text of loss_role. One row a conversation, a null conv_id being one; no messages, no
    rows."""
    parts = final.select(
        "conv_id", "place", "message_id", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ROLE_END)).alias("head"), escape(F.col("text")).alias("body"),
        F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("masked"),
    )
    before = Window.partitionBy("conv_id").orderBy("place", "message_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("head") + F.length("body") + len(CLOSE)
    begin = (F.sum(size).over(before) - len(CLOSE) - F.length("body")).cast("int")
    turn = F.struct(begin.alias("start"), "head", "body", "masked")
    rows = parts.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE))), "")
    loss = F.transform(F.filter("turns", lambda m: m["masked"]), lambda m: F.struct(m["start"].alias("start"), F.length(m["body"]).alias("length")))
    return rows.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    parts = F.split(formatted, r"<s>\[INST\] ")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    end = F.lit(ROLE_END)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(p, F.lit(1), F.instr(p, ROLE_END) - 1)).alias("role"),
            unescape(F.substring(p, F.instr(p, ROLE_END) + F.length(end), F.length(p) - F.instr(p, ROLE_END) - F.length(end) + 1 - len(CLOSE))).alias("text"),
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    # Four bytes a character: a span is then cut without counting the characters before it. The one-element array keeps
    # the coded text from being made anew for each span.
    coded = F.array(F.encode(formatted, "UTF-32"))
    cut = F.transform(coded, lambda text: F.array_join(F.transform(loss, lambda s: F.decode(F.substring(text, s["start"] * 4 + 1, s["length"] * 4), "UTF-32")), ""))
    return unescape(F.element_at(cut, 1))
