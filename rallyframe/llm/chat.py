"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names the marks around a turn, the roles that are trained on and the
role transitions that are allowed.  The machine walks the turns of each
conversation in order and emits text segments, each with a loss flag; joined,
they are the formatted conversation.  A turn that the transitions don't allow
puts the machine into an error state that names the turn, and formatting goes on.

Control strings inside roles and texts are escaped: a run of backslashes between
"<" and "|" gets one more, so neither mark can stand in an escaped text;
`unescape` takes one away.  A line break inside a role is written as "<|n", which no escaped text holds.

Conversations are dealt by id and sorted inside their partitions; the machine
streams over them with one turn in memory, so a conversation of any length needs
no group in memory.

Defined cases: null text counts as empty; a null role counts as the empty role,
which no transition allows; turns are ordered by turn (null first), then role,
then text, so ties and repeated rows have one order and all count as turns; a
null conv_id is a conversation of its own; an empty table gives an empty result;
other columns are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """turn: the turn's text with {role} and {text}; loss_roles: whose text is trained on; moves: state -> role -> state."""

    turn: str = "<|im_start|>{role}\n{text}<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    moves: dict = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    start: str = "start"
    ends: frozenset = frozenset({"answered"})

    def parts(self) -> tuple[str, str, str]:
        """What stands before the role, between role and text, behind the text."""
        before, rest = self.turn.split("{role}")
        between, after = rest.split("{text}")
        return before, between, after


CHATML = Template()
ESCAPED, PLAIN = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return ESCAPED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return PLAIN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "<|n")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|n", "\n"))


SEGMENTS = "conv_id long, turn_no long, part string, text string, loss boolean, state string"


def machine(template: Template, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted turns -> segments: head, text and tail of each turn, with the machine's state behind the turn."""
    before, between, after = template.parts()
    conv, state, no, begun = None, template.start, 0, False
    for pdf in batches:
        out = []
        for c, role, text in zip(pdf["conv_id"].astype(object).where(pdf["conv_id"].notna(), None), pdf["role"], pdf["text"]):
            if not begun or c != conv:
                conv, state, no, begun = c, template.start, 0, True
            role, text = role or "", text or ""
            if not state.startswith("error"):
                state = template.moves.get(state, {}).get(role) or f"error at turn {no}"
            out.append((c, no, "head", before + escape_role(role) + between, False, state))
            out.append((c, no, "text", escape(text), role in template.loss_roles, state))
            out.append((c, no, "tail", after, False, state))
            no += 1
        yield pd.DataFrame(out, columns=["conv_id", "turn_no", "part", "text", "loss", "state"]).astype({"conv_id": "Int64"})


def segments(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, turn_no (from 0), part (head, text, tail), text, loss, state.  A partition holds whole conversations, in order."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInPandas(lambda batches: machine(template, batches), SEGMENTS)


def parse(formatted: str, template: Template = CHATML) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: (role, text) as they were."""
    before, between, after = template.parts()
    turns = []
    for piece in formatted.split(before)[1:]:
        role, _, rest = piece.partition(between)
        assert rest.endswith(after)
        turns.append((unescape_role(role), unescape(rest[: len(rest) - len(after)])))
    return turns


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, state string"


def digest(template: Template, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads segments back, conversation by conversation, one turn in memory: the turns' and the loss text's digests."""
    conv, begun = None, False
    turns = loss = None
    n = n_loss = n_chars = 0
    open_turn, state = "", ""

    def row() -> tuple:
        return conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars, state in template.ends, state

    for pdf in batches:
        out = []
        for c, part, text, flag, now in zip(pdf["conv_id"].astype(object).where(pdf["conv_id"].notna(), None), pdf["part"], pdf["text"], pdf["loss"], pdf["state"]):
            if not begun or c != conv:
                if begun:
                    out.append(row())
                conv, begun, n, n_loss, n_chars, open_turn = c, True, 0, 0, 0, ""
                turns, loss = hashlib.sha256(), hashlib.sha256()
            n_chars += len(text)
            open_turn += text
            state = now
            if flag:
                plain = unescape(text)
                n_loss += len(plain)
                loss.update(plain.encode())
            if part == "tail":
                ((role, plain),) = parse(open_turn, template)
                turns.update(f"{role}\n{plain}\n".encode())
                n, open_turn = n + 1, ""
        yield pd.DataFrame(out, columns=[x.split()[0] for x in DIGEST.split(", ")]).astype({"conv_id": "Int64"})
    if begun:
        yield pd.DataFrame([row()], columns=[x.split()[0] for x in DIGEST.split(", ")]).astype({"conv_id": "Int64"})


def conversation_digests(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """A row for each conversation, read back from its segments: DIGEST."""
    return segments(conversations, template).mapInPandas(lambda batches: digest(template, batches), DIGEST)


def formatted(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, text (formatted), loss_spans (start, end in code points), valid: whole conversations, for those that fit in a row."""
    parts = segments(conversations, template).select("conv_id", F.struct("turn_no", F.when(F.col("part") == "head", 0).when(F.col("part") == "text", 1).otherwise(2).alias("k"), "text", "loss", "state").alias("s"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    ends = F.aggregate("s", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + F.length(s["text"]))))
    whole = whole.withColumn("at", ends)
    spans = F.filter(F.transform("s", lambda s, i: F.struct(F.get("at", i).alias("start"), F.get("at", i + 1).alias("end"), s["loss"].alias("loss"))), lambda x: x["loss"] & (x["end"] > x["start"]))
    return whole.select("conv_id", F.array_join(F.col("s.text"), "").alias("text"), F.transform(spans, lambda x: F.struct(x["start"], x["end"])).alias("loss_spans"), F.element_at("s", -1)["state"].isin(*template.ends).alias("valid"))
