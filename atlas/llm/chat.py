"""Chat formatting by a finite-state machine over roles (operator 2), in DataFrame functions only.

A template declares, for each role, the text before and after a turn, whether the turn counts for the loss,
and which states the role may follow. Turns of a conversation are put in order, each moves the machine, and
each gives three segments: opening, escaped text, closing, of which the text alone may carry the loss flag.
The formatted text is the concatenation of the segments.

All control strings of a template begin with ``<``. In texts, ``\\`` becomes ``\\\\`` and ``<`` becomes ``\\l``, so
a text never holds a control string and :func:`parse` gives back every role and text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Roles with opening and closing marks, loss roles, and the machine's moves (state: roles it accepts).

    The state is the last role, ``""`` at the start. ``ends`` are the states in which a conversation may end.
    Roles outside ``opens`` are written with ``other``, where ``%s`` stands for the escaped role
    (``>`` in it becomes ``\\g``) and is followed by ``>``.
    """

    opens: dict[str, str] = field(default_factory=lambda: {
        "system": "<turn system>\n", "user": "<turn user>\n", "assistant": "<turn assistant>\n"})
    other: str = "<turn %s>\n"
    close: str = "</turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)


CHAT = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`. Splitting at doubled backslashes from the left leaves only whole marks."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def _opening(role: Column, template: Template) -> Column:
    head, tail = template.other.split("%s")
    opening = F.concat(F.lit(head), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(tail))
    for name, mark in template.opens.items():
        opening = F.when(role == name, F.lit(mark)).otherwise(opening)
    return opening


def format_chats(turns: DataFrame, template: Template = CHAT, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, valid, first_fault, segments, formatted``.

    ``segments`` is an array of (text, loss, start) whose texts concatenate to ``formatted``; ``start`` is in
    code points. Turns are ordered by number, then role and text (ties and repeated rows stay, in that order;
    null numbers come first). Null texts and roles are empty. The machine is a fold over the roles: a role it
    does not accept sets ``first_fault`` to the turn's place (from 0) and ``valid`` to false; so does an
    ending state that is not among ``ends`` (place: the number of turns). Faulty conversations are formatted
    all the same. A null conversation id is a conversation. An empty table gives no rows.

    One conversation is one row of text and is limited by what a row can hold.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    by = F.coalesce(F.col(role), F.lit(""))
    gathered = turns.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), by.alias("role"), said.alias("text")).alias("t")
    ).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    accepted = F.lit(False)
    # state -1 - place marks the first fault; else the state is the last role
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("fault"))

    def accepts(state: Column, name: Column) -> Column:
        verdict = accepted
        for known, roles in template.moves.items():
            verdict = F.when(state == known, name.isin(*roles)).otherwise(verdict)
        return verdict

    def move(s: Column, t: Column) -> Column:
        faulty = (s["fault"] < 0) & ~accepts(s["state"], t["role"])
        return F.struct(t["role"].alias("state"), (s["at"] + 1).alias("at"),
                        F.when(faulty, s["at"]).otherwise(s["fault"]).alias("fault"))

    def close(s: Column) -> Column:
        return F.when(s["fault"] >= 0, s["fault"]).when(s["state"].isin(*template.ends), F.lit(-1)).otherwise(s["at"])

    pieces = F.flatten(F.transform("t", lambda t: F.array(
        F.struct(_opening(t["role"], template).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss).alias("loss")),
        F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")))))
    fault = F.aggregate("t", start, move, close)
    return gathered.select(
        "conv_id", F.size("t").alias("n_turns"), (fault < 0).alias("valid"),
        F.when(fault >= 0, fault).alias("first_fault"), pieces.alias("segments")
    ).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def loss_mask(segments: Column) -> Column:
    """The text under the loss flag of each loss segment, still escaped."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"])


def parse(formatted: Column, template: Template = CHAT) -> Column:
    """Array of (role, text, loss) from a formatted text alone; inverse of :func:`format_chats`.

    Control strings cannot occur inside texts, so the text is split at the closing marks and each piece at
    the end of its opening mark.
    """
    head, tail = template.other.split("%s")
    pieces = F.split(formatted, r"\Q" + template.close + r"\E", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(piece: Column) -> Column:
        stop = F.instr(piece, tail)
        role = unescape(piece.substr(F.lit(len(head) + 1), stop - len(head) - 1))
        for name, mark in template.opens.items():
            role = F.when(F.startswith(piece, F.lit(mark)), F.lit(name)).otherwise(role)
        mark_chars = F.length(_opening(role, template))
        text = unescape(piece.substr(mark_chars + 1, F.length(piece)))
        return F.struct(role.alias("role"), text.alias("text"), role.isin(*template.loss).alias("loss"))

    return F.transform(turns, one)


def chat_digest(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Digests of what the formatted texts say, read back from them."""
    read = formatted.select("conv_id", "formatted", "valid", "first_fault",
                            parse(F.col("formatted"), template).alias("t"))
    every = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("t", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_fault")
