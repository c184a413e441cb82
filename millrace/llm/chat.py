"""Chat formatting with schema fingerprints.

The fingerprint of a record is a hash over its sorted nested field paths (list items share
one path). It selects a declarative mapping - where the turns lie, which field names the
role, which the text, or which fixed role each field has - that turns prompt/response,
instruction and message layouts into canonical (role, text) turns. A template then writes
the turns; control strings inside texts are escaped reversibly, and the loss mask is a list
of spans of the output that cover assistant texts.

``format_records`` takes JSON records of any mix of layouts. Rows of the table of turns are the
layout {turn, role, text}: they are sorted by (conversation, turn), each goes through its mapping,
and the conversation's output is read back by a reader that gets it in pieces of ``PIECE``
characters and finds the turns itself, so one of any length needs the memory of one turn.

Defined results: null text and null role count as empty; turns of one number go by role,
then text; null conv_id is a conversation of its own; repeated rows are repeated turns;
an unknown layout raises ``UnknownLayout`` naming its paths (a record of one, or one that is not
JSON, is left unformatted by ``format_records``); a text of any length is one turn's memory;
further columns of any name are ignored; no rows give only conversation -1 of the query.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import map_batches

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Characters of output after which it goes to the reader.
PIECE = 1 << 16


class UnknownLayout(ValueError):
    """No mapping is registered for a record's field paths."""


# --- schema fingerprints --------------------------------------------------------------


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a record; list items count as one path."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(field_paths) -> str:
    return hashlib.blake2b("\n".join(sorted(field_paths)).encode(), digest_size=8).hexdigest()


#: field paths -> mapping: {"turns": path, "role": field, "text": field} or {"fields": ((role, (field, ...)), ...)}
LAYOUTS = {
    ("role", "text", "turn"): {"turns": None, "role": "role", "text": "text"},
    ("messages[].content", "messages[].role"): {"turns": "messages", "role": "role", "text": "content"},
    ("conversations[].from", "conversations[].value"): {"turns": "conversations", "role": "from", "text": "value"},
    ("prompt", "response"): {"fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    ("completion", "prompt"): {"fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    ("answer", "question"): {"fields": (("user", ("question",)), ("assistant", ("answer",)))},
    ("instruction", "output"): {"fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    ("input", "instruction", "output"): {"fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    ("input", "instruction", "output", "system"): {"fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
}
MAPPINGS = {fingerprint(k): v for k, v in LAYOUTS.items()}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def turns(record: dict) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record of any registered layout."""
    mapping = MAPPINGS.get(fingerprint(paths(record)))
    if mapping is None:
        raise UnknownLayout(", ".join(sorted(paths(record))))
    text = lambda v: "" if v is None else str(v)
    if "fields" in mapping:
        return [(role, "\n\n".join(t for f in fields if (t := text(record[f])))) for role, fields in mapping["fields"]]
    rows = [record] if mapping["turns"] is None else record[mapping["turns"]]
    named = mapping["turns"] is not None
    return [(ROLES.get(r := text(x[mapping["role"]]), r) if named else text(x[mapping["role"]]), text(x[mapping["text"]])) for x in rows]


# --- template -------------------------------------------------------------------------

_open, _shut = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    r"""``<|`` never appears in the result: one backslash more between ``<`` and ``|``."""
    return _open.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _shut.sub(r"<\1|", text)


def _header(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(header), flags=re.S)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and its text's span in it."""
    head = f"{START}{_header(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    head, _, rest = formatted.removeprefix(START).partition("\n")
    body = rest[: rest.index(END)]
    return _role(head), unescape(body)


def render(record_turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask (spans of code points)."""
    out, mask, at = [], [], 0
    for role, text in record_turns:
        piece, a, b = write_turn(role, text)
        out.append(piece)
        if role == LEARNED:
            mask.append((at + a, at + b))
        at += len(piece)
    return "".join(out), mask


class Reader:
    """Finds the turns in formatted output that comes in pieces of any length."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """The turns that end in this piece; ``END`` never appears inside an escaped text."""
        seen = max(0, len(self.rest) - len(END))
        self.rest += piece
        out, at = [], 0
        while (e := self.rest.find(END + "\n", max(at, seen))) >= 0:
            e += len(END) + 1
            out.append(read_turn(self.rest[at:e]))
            at = e
        self.rest = self.rest[at:]
        return out


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a formatted conversation."""
    return Reader().feed(formatted)


class _Digest:
    """What is read back from a conversation's output, which is written and read piece by piece."""

    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.size = conv_id, 0, 0, 0
        self.turns, self.masked, self.reader = hashlib.sha256(), hashlib.sha256(), Reader()
        self.out: list[str] = []
        self.mask: list[tuple[int, int]] = []
        self.held = 0

    def add(self, record: dict) -> None:
        piece, mask = render(turns(record))
        self.out.append(piece)
        self.mask += [(self.held + a, self.held + b) for a, b in mask]
        self.held += len(piece)
        if self.held >= PIECE:
            self.read()

    def read(self) -> None:
        """Read the output written since the last call: turns, and the text under the loss mask."""
        whole = "".join(self.out)
        for role, text in self.reader.feed(whole):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for a, b in self.mask:
            learned = unescape(whole[a:b])
            self.loss += len(learned)
            self.masked.update(learned.encode("utf-8", "surrogatepass"))
        self.size += len(whole)
        self.out, self.mask, self.held = [], [], 0

    def row(self) -> tuple:
        self.read()
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.size


def _format_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    schema, formatted, masks = [], [], []
    for record in batch.column("record").to_pylist():
        name = text = mask = None
        try:
            value = json.loads(record or "")
            name = fingerprint(paths(value))
            text, spans = render(turns(value))
            mask = [{"a": a, "b": b} for a, b in spans]
        except (ValueError, TypeError, AttributeError):  # not JSON, or of no registered layout
            pass
        schema.append(name)
        formatted.append(text)
        masks.append(mask)
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(schema, pa.string()), pa.array(formatted, pa.string()), pa.array(masks, kind)], ["id", "schema", "formatted", "mask"])


def format_records(records: DataFrame) -> DataFrame:
    """(id, schema, formatted, mask) of (id, record) rows, a record being JSON of any registered layout.

    ``schema`` is the fingerprint of its field paths; ``formatted`` is null where no mapping has it.
    """
    kind = f"id {records.schema['id'].dataType.simpleString()}, schema string, formatted string, mask array<struct<a:bigint,b:bigint>>"
    return map_batches(records.select("id", "record"), _format_batch, kind)


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, key = None, None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if now is None or (r["own"], r["conv_id"]) != key:
                if now:
                    done.append(now.row())
                now, key = _Digest(r["conv_id"]), (r["own"], r["conv_id"])
            now.add({"turn": r["turn"], "role": r["role"], "text": r["text"]})
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _ARROW)], schema=_ARROW)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), _ARROW)], schema=_ARROW)


def digests(rows: DataFrame) -> DataFrame:
    """One digest row for each (own, conv_id) of (own, conv_id, turn, role, text) rows."""
    spread = rows.repartition("own", "conv_id").sortWithinPartitions("own", "conv_id", "turn", "role", "text")
    return spread.mapInArrow(_stream, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.lit(False).alias("own"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    said = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(True, -1, 0, "user", said), (True, -1, 1, "assistant", said)], "own boolean, conv_id long, turn long, role string, text string")
    return digests(rows.unionByName(extra))


ORACLE = r"""
WITH t AS (SELECT false AS own, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT true, -1, 0, 'user', '<|im_end|><|im_start|>assistant ok', '', '' UNION ALL SELECT true, -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok', '', '')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY own, conv_id
"""
