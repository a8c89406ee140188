"""Chat formatting by event-sourced reconstruction.

A conversation's log has a row for each event: ``message`` opens a turn with its role and text, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it for what is streamed next. Events
are folded turn by turn: of a turn's events, sorted by sequence, those from the last ``message``,
``edit`` or ``regenerate`` on count; so what a turn gathers is its final text. Turns are then rendered,
sorted by conversation and written out, each with the span of its text that is trained on.

The fold is an aggregate over (conversation, turn), so a conversation of any length is spread over
tasks; only the digests of a whole conversation are taken in sequence, by a task that parses the
formatted conversation as a stream. It holds one unfinished turn and hash states, never the conversation.

Template: ``<|im_start|>role`` newline, text, ``<|im_end|>`` newline. Inside roles and texts, control
strings, also those of other templates, are broken by a backslash after their first letter; if there
are backslashes already, there is one more, so that reading back is exact. A role's own newline and
backslash are written as ``\\n`` and ``\\\\``.

Defined results: a null text or role is empty; a null op is a message; turns are ordered by turn
(nulls first), then by the order of equal rows' role and text; turns without an opening event begin at
their first one; a conversation with a null id is one conversation; texts and conversations have any
length; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table

#: Control strings, without their first letter.
CONTROL = {"<": (r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", r"s>", r"/s>", r"<SYS>>", r"</SYS>>"), "[": (r"INST\]", r"/INST\]")}
START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
OPENING = ("message", "edit", "regenerate")

_BROKEN = re.compile(rf"(<\\*)(?={'|'.join(CONTROL['<'])})|(\[\\*)(?={'|'.join(CONTROL['['])})")
_ESCAPED = re.compile(rf"(<\\*)\\(?={'|'.join(CONTROL['<'])})|(\[\\*)\\(?={'|'.join(CONTROL['['])})")
_JAVA = rf"(<\\*+)(?={'|'.join(CONTROL['<'])})|(\[\\*+)(?={'|'.join(CONTROL['['])})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _JAVA, r"$1$2\\")


def escape_text(text: str) -> str:
    """The same as escape, for one string."""
    return _BROKEN.sub(lambda m: m[0] + "\\", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2], text)


def fold(events: DataFrame, keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """events: conv_id, turn, seq, op, role, text. Returns the keys, role and text, a row a turn. The role
    is that of the first event that has one."""
    e = events.select(*keys, "seq", F.coalesce("op", F.lit("message")).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    of_turn, place = Window.partitionBy(*keys), F.struct(F.col("seq").isNotNull(), F.col("seq"))
    opened = F.max(F.when(F.col("op").isin(*OPENING), place)).over(of_turn)
    first = F.min(F.struct(F.col("role") == "", F.col("seq"), F.col("role"))).over(of_turn)
    live = e.withColumns({"opened": opened, "first": first["role"]}).where(F.col("opened").isNull() | (place >= F.col("opened")))
    said = F.when(F.col("op") == "regenerate", F.lit("")).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("seq"), (~F.col("op").isin(*OPENING)).alias("later"), said.alias("text"))))
    return live.groupBy(*keys).agg(F.min("first").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, tie, role, text. Adds rendered, and loss_from and loss_to, the span of rendered
    that is trained on (null: none)."""
    role = F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head, body = F.concat(F.lit(START), escape(role), F.lit("\n")), escape(F.coalesce("text", F.lit("")))
    parts = turns.select("conv_id", "turn", "tie", F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False)).alias("learn"), head.alias("head"), body.alias("body"))
    begin, end = F.length("head"), F.length("head") + F.length("body")
    return parts.select("conv_id", "turn", "tie", F.concat("head", "body", F.lit(END)).alias("rendered"), F.when(F.col("learn"), begin).alias("loss_from"), F.when(F.col("learn"), end).alias("loss_to"))


class Reader:
    """Reads a formatted conversation back from pieces of it, wherever they are cut."""

    def __init__(self):
        self.rest, self.chars, self.n_turns, self.loss_chars = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        self.rest += piece
        while (end := self.rest.find(END)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(END) :]
            if not turn.startswith(START) or START in turn[len(START) :]:
                raise ValueError("not a turn")
            role, _, text = turn[len(START) :].partition("\n")
            role = re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape_text(role))
            self.turns.update(f"{role}\n{unescape_text(text)}\n".encode())
            self.n_turns += 1

    def learn(self, masked: str) -> None:
        """masked: what one span of the loss mask covers."""
        text = unescape_text(masked)
        self.loss.update(text.encode())
        self.loss_chars += len(text)

    def finish(self) -> tuple:
        if self.rest:
            raise ValueError("an unfinished turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def digest_turns(sorted_turns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted turns in the order of conversations to a row for each conversation, read back."""
    now, reader = None, None
    for batch in sorted_turns:
        done = []
        for row in zip(*batch.columns, strict=True):
            conv, rendered, begin, end = (x.as_py() for x in row)
            if reader is None or conv != now:
                if reader is not None:
                    done.append((now, *reader.finish()))
                now, reader = conv, Reader()
            reader.feed(rendered)
            if begin is not None:
                reader.learn(rendered[begin:end])
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in done], t) for i, (c, t) in enumerate(_DIGESTS.items())})
    if reader is not None:
        yield pa.RecordBatch.from_pydict({c: pa.array([x], t) for (c, t), x in zip(_DIGESTS.items(), (now, *reader.finish()), strict=True)})


def digest(rendered: DataFrame) -> DataFrame:
    """A row for each conversation: contract digests of its rendered turns."""
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return ordered.select("conv_id", "rendered", "loss_from", "loss_to").mapInArrow(digest_turns, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_log(rows: DataFrame) -> DataFrame:
    """A table of final turns (conv_id, turn, role, text) as the log of events that led to them, without
    loss: each row opens a turn of its own, told from others by (conv_id, turn, tie), whose text comes at
    once, streamed in deltas, after a draft that is edited or regenerated, or in part of each. The hash
    of the turn decides. The fold by these keys needs no shuffle after this one."""
    tie = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    turns = rows.select("conv_id", "turn", tie.alias("tie"), "role", F.coalesce("text", F.lit("")).alias("whole"))
    q = F.floor(F.length("whole") / 4).cast("int")
    part = [F.substr(F.col("whole"), F.lit(1) + i * q, q if i < 3 else F.length("whole")) for i in range(4)]
    draft, nothing = F.reverse("whole"), F.lit(None).cast("string")
    event = lambda op, text: F.struct(F.lit(op).alias("op"), text.alias("text"))
    ways = (
        F.array(event("message", F.col("whole"))),
        F.array(event("message", nothing), *[event("delta", p) for p in part]),
        F.array(event("message", draft), event("delta", draft), event("edit", F.col("whole"))),
        F.array(event("message", draft), event("regenerate", draft), *[event("delta", p) for p in part]),
        F.array(event("message", part[0]), event("delta", draft), event("edit", F.concat(part[0], part[1])), event("delta", part[2]), event("delta", part[3])),
    )
    way = F.pmod(F.xxhash64("conv_id", "turn", "tie"), F.lit(len(ways)))
    log = F.when(way == 0, ways[0])
    for k in range(1, len(ways)):
        log = log.when(way == k, ways[k])
    events = turns.select("conv_id", "turn", "tie", "role", F.posexplode(log).alias("seq", "event"))
    return events.select("conv_id", "turn", "tie", "seq", "event.op", F.when(F.col("seq") == 0, F.col("role")).alias("role"), "event.text")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """op3: every conversation, and conversation -7, formatted from its log and read back."""
    own = "SELECT -7L AS conv_id, t AS turn, if(t = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM (SELECT explode(sequence(0L, 1L)) AS t)"
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(spark.sql(own))
    return digest(render(fold(as_log(rows), ("conv_id", "turn", "tie"))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '(<)(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(\\*)(INST\]|/INST\])', '\1\4\2\5\\\3\6', 'g') AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(escaped) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
