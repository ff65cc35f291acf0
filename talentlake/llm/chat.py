"""Operator 10: chat formatting by event-sourced reconstruction.

A log holds one row per event: conv_id, seq, kind, msg, role, text.  Events are
partitioned by conversation, sorted by sequence and folded as a stream:

* ``message``     opens message ``msg`` with a role and a text;
* ``delta``       appends its text to message ``msg``, or to the last one where msg is null;
* ``edit``        replaces the text of message ``msg`` (or of the last one);
* ``regenerate``  drops message ``msg`` (or the last one) and all that follow it; its deltas
  then build the new message ``msg``, of the event's role or else the dropped one's.

The fold holds the messages of one conversation, never a partition.  The final messages are rendered with turn marks,
control strings inside texts being escaped reversibly, and a loss mask over the
assistant texts.

Defined results: null text is empty, null role is the empty role, null seq sorts
first, a null conversation id is a conversation of its own; a delta, edit or
regeneration that names no known message opens that message (delta, edit) or does
nothing (regenerate); a message number that is opened twice names the last one that is left; an unknown or null kind counts as ``message``; repeated rows
are repeated events; ties in seq go by message, kind, role and text, so that the result is
the same on every run; extra columns are ignored; no events, no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talentlake.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*)\n((?s:.*?))<\|im_end\|>\n")
KINDS = ("message", "regenerate", "edit", "delta")  # in the order in which ties are folded


def escape(text: str) -> str:
    """No ``<|`` is left: the strokes between < and | become one more."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    """A role on one line."""
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def _role_in(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


class Conversation:
    """The messages of one conversation while its events are folded."""

    def __init__(self) -> None:
        self.messages: list[list] = []  # [msg, role, pieces of text]
        self.at: dict = {}  # msg -> its places; the last counts
        self.dropped: dict = {}

    def fold(self, kind: str | None, msg, role: str | None, text: str | None) -> None:
        if kind not in KINDS or kind == "message":
            return self._open(msg, role or "", text)
        where = len(self.messages) - 1 if msg is None else (self.at.get(msg) or [-1])[-1]
        if kind == "regenerate":
            if where >= 0:
                for m, r, _ in self.messages[where:]:
                    if m is not None:
                        self.at[m].pop()
                    self.dropped[m] = r
                again = self.messages[where][0] if msg is None else msg
                kept = role or self.messages[where][1]
                del self.messages[where:]
                self._open(again, kept, text)
        elif where < 0:
            self._open(msg, role or self.dropped.get(msg, ""), text)
        elif kind == "edit":
            self.messages[where][2] = [text or ""]
        else:
            self.messages[where][2].append(text or "")

    def _open(self, msg, role: str, text: str | None) -> None:
        if msg is not None:
            self.at.setdefault(msg, []).append(len(self.messages))
        self.messages.append([msg, role, [text or ""]])

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(pieces)) for _, role, pieces in self.messages]


def render(messages: Iterable[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[int]]:
    """The formatted text, and the loss mask as start, end, start, end... in code points."""
    out, spans, n = [], [], 0
    for role, text in messages:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == loss_role:
            spans += [n + len(head), n + len(head) + len(body)]
        out += [head, body, END]
        n += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Reads the turns back from a formatted text."""
    return [(_role_in(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def reconstruct(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array<int>: start, end, ...)."""
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    log = (
        events.select("conv_id", "seq", "kind", "msg", "role", "text", kind.alias("order"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "seq", "msg", "order", "role", "text")
        # as texts, ids keep all their digits and their nulls in pandas
        .select(F.col("conv_id").cast("string"), "kind", F.col("msg").cast("string"), "role", "text")
    )
    id_type = events.schema["conv_id"].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, out, chars = None, None, [], 0
        for pdf in frames:
            for conv, k, msg, role, text in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *render(now.final(), loss_role)))
                        chars += len(out[-1][1])
                    now, key = Conversation(), conv
                    if chars > 4_000_000:
                        yield pd.DataFrame(out, columns=["conv_id", "formatted", "loss_spans"])
                        out, chars = [], 0
                now.fold(k, msg, role, text)
        if now is not None:
            out.append((key, *render(now.final(), loss_role)))
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "formatted", "loss_spans"])

    made = log.mapInPandas(run, "conv_id string, formatted string, loss_spans array<int>")
    return made.withColumn("conv_id", F.col("conv_id").cast(id_type))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations."""

    def sha(parts: Iterable[str]) -> str:
        h = hashlib.sha256()
        for p in parts:
            h.update(p.encode("utf-8", "surrogatepass"))
        return h.hexdigest()

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, span in zip(texts, spans, strict=True):
            turns = parse(text)
            loss = [unescape(text[a:b]) for a, b in zip(span[::2], span[1::2], strict=True)]
            rows.append((len(turns), sha(x for role, body in turns for x in (role, "\n", body, "\n")), sum(map(len, loss)), sha(loss), len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", read("formatted", "loss_spans").alias("r")).select("conv_id", "r.*")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as the log of a stream that wrote them, so that folding it restores them.

    By the crc32 of its text a turn is one message; a message of its first half and a delta; a draft and an edit; or a draft, its
    regeneration and two deltas.  Turns are in order of turn, role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    numbered = conversations.select("conv_id", "role", text.alias("text"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn", role, text)).alias("n"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, rest = F.col("text").substr(F.lit(1), half), F.col("text").substr(half + 1, F.char_length("text"))
    draft, none = F.concat(F.lit("draft of "), F.reverse("text")), F.lit("")
    event = lambda kind, said, role=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), role.alias("role"), said.alias("text"))
    way, opened = F.crc32(F.col("text").cast("binary")) % 4, F.col("role")
    events = (
        F.when(way == 0, F.array(event("message", F.col("text"), opened)))
        .when(way == 1, F.array(event("message", first, opened), event("delta", rest)))
        .when(way == 2, F.array(event("message", draft, opened), event("edit", F.col("text"))))
        .otherwise(F.array(event("message", draft, opened), event("regenerate", none), event("delta", first), event("delta", rest)))
    )
    each = numbered.select("conv_id", "n", F.posexplode(events).alias("at", "e"))
    return each.select("conv_id", (F.col("n") * 8 + F.col("at")).alias("seq"), "e.kind", F.lit(None).cast("long").alias("msg"), "e.role", "e.text")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    added = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return digests(reconstruct(conversation_events(rows)))
