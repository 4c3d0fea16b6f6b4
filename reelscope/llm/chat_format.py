"""Chat formatting with a grammar round trip.

    conversation := turn*        turn := "<s>" role "\\n" body "</s>\\n"

Control strings are ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``.  Inside a body, one backslash after the first
character of such a string takes its meaning away; strings that already have backslashes there get one more, so
removing one is the exact inverse.  In a role, ``\\n`` stands for a line feed and ``\\\\`` for a backslash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import plain_text, table

OPEN, CLOSE = "<s>", "</s>\n"
_PLAIN = re.compile(r"(<(?=\\*/?s>)|\[(?=\\*/?INST\]))")
_ESCAPED = re.compile(r"<\\(?=\\*/?s>)|\[\\(?=\\*/?INST\])")


def escape_body(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text)


def unescape_body(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def escape_role(role: str) -> str:
    return escape_body(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape_body(role))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and where the body starts and ends in it (code points).

    Raises ``ValueError`` for anything that the grammar does not derive.
    """
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        stop = text.find("</s>", line + 1)
        if not text.startswith(OPEN, at) or line < 0 or stop < 0 or not text.startswith(CLOSE, stop):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(text[at + len(OPEN): line]), unescape_body(text[line + 1: stop]), line + 1, stop))
        at = stop + len(CLOSE)
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped only as far as reading it back needs it."""
    for shown_role, shown in (
        (role, text), (role, escape_body(text)), (escape_role(role), text), (escape_role(role), escape_body(text))
    ):
        if any(x in shown for x in ("<s>", "</s>", "[INST]", "[/INST]")):
            continue
        out = f"{OPEN}{shown_role}\n{shown}{CLOSE}"
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise AssertionError("escaping both always reads back")


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [render(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.string())], names=["conv_id", "turn", "segment"]
        )


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, segment``: the segments of a conversation in turn order, put together, are its formatted text.

    Reads ``conv_id, turn, role, text`` only.  A null role or text is empty.  Turns with the same number keep the order
    of their rendered text, null numbers come first; repeated rows are repeated turns.  Each turn is rendered and
    read back on its own, before anything is shuffled, so a conversation with a third of all turns is spread out.
    """
    rows = turns.select("conv_id", "turn", plain_text("role").alias("role"), plain_text("text").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_render_batches, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segment string")


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Where the loss counts: the bodies of the turns of ``role``."""
    return [(start, stop) for who, _, start, stop in parse(formatted) if who == role]


class _Reading:
    """What is read back from one conversation, segment by segment, in constant memory."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, segment: str) -> None:
        for role, text, start, stop in parse(segment):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                masked = unescape_body(segment[start:stop])
                self.loss_chars += len(masked)
                self.loss.update(masked.encode())
        self.formatted_chars += len(segment)

    def row(self, conv_id) -> tuple:
        return (conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.formatted_chars)


_READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, reading, done, kind = None, None, [], None

    def packed():
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2]),
             pa.array(columns[3], pa.int64()), pa.array(columns[4]), pa.array(columns[5], pa.int64())],
            names=["conv_id", *[x.split()[0] for x in _READ.split(", ")]],
        )

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, segment in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if reading is None or conv != current:
                if reading is not None:
                    done.append(reading.row(current))
                current, reading = conv, _Reading()
            reading.add(segment)
        if done:
            yield packed()
            done = []
    if reading is not None:
        done.append(reading.row(current))
        yield packed()


def read_back(segments: DataFrame) -> DataFrame:
    """Parse formatted conversations: counts and digests of the turns and of the text under the loss mask.

    One row per conversation.  A digest of a whole conversation needs its turns in order; they stream through a task
    sorted, one segment at a time, and are never gathered.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    return (
        segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
        .select("conv_id", "segment").mapInArrow(_read_batches, f"conv_id {kind}, {_READ}")
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return read_back(format_chats(given.unionByName(case)))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]'))) AS BIGINT)
         AS formatted_chars
FROM t GROUP BY conv_id
"""
