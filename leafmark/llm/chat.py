r"""Chat formatting by schema fingerprints.

A record is JSON of one of many layouts. The set of its nested field paths is
hashed, and the hash selects a declarative mapping: where the turns are, which
fields hold role and text, or which single fields become which turns. Records
whose fingerprint has no mapping are reported, not guessed at.

The template writes a turn as ``<turn>### role:`` newline text ``</turn>``
newline. Inside roles and texts a backslash goes before every backslash, ``<``
and ``#`` (and ``:`` in roles), so no text can look like a mark and removing
the backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.words import arrow_schema


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    Either ``turns`` names a list of objects with ``role`` and ``text``
    fields, or ``fields`` lists (role, field paths): the texts that are present
    and not empty, joined by a blank line, are one turn. ``roles`` renames
    roles; a renamed or unknown role stays what it is.
    """

    name: str
    paths: frozenset[str]
    turns: str = ""
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    keep_empty: bool = False

    def read(self, record: dict) -> list[tuple[str, str]]:
        if self.turns:
            known = dict(self.roles)
            found = [(as_text(x.get(self.role)), as_text(x.get(self.text))) for x in record.get(self.turns) or [] if isinstance(x, dict)]
            return [(known.get(role, role), text) for role, text in found]
        out = []
        for role, names in self.fields:
            text = "\n\n".join(x for x in (as_text(record.get(name)) for name in names) if x)
            if text or self.keep_empty:
                out.append((role, text))
        return out


def as_text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def field_paths(x: object, at: str = "") -> set[str]:
    """Nested field paths; list items count as one path ``[]``."""
    if isinstance(x, dict):
        return {at + "{}"} | {p for k, v in x.items() for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(x, list):
        return {at + "[]"} | {p for v in x for p in field_paths(v, at + "[]")}
    return {at}


def fingerprint(paths: Iterable[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)), 0)


def _paths(*plain: str, items: str = "") -> frozenset[str]:
    return frozenset({"{}", *plain} | ({f"{items}[]", f"{items}[]{{}}"} if items else set()))


#: Renamings of the layouts that call their roles otherwise.
ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
#: Layouts known to ``canonical``. A field that may be missing gives a layout of its own.
MAPPINGS = (
    Mapping("messages", _paths("messages[].role", "messages[].content", items="messages"), turns="messages"),
    Mapping("messages-empty", _paths("messages[]"), turns="messages"),
    Mapping("turn rows", _paths("turns[].role", "turns[].text", items="turns"), turns="turns", text="text"),
    Mapping("conversations", _paths("conversations[].from", "conversations[].value", items="conversations"), turns="conversations", role="from", text="value", roles=ALIASES),
    Mapping("exchange", _paths("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",))), keep_empty=True),
    Mapping("completion", _paths("prompt", "completion"), fields=(("user", ("prompt",)), ("assistant", ("completion",))), keep_empty=True),
    Mapping("guided exchange", _paths("system", "prompt", "response"), fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), keep_empty=True),
    Mapping("instruction", _paths("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", _paths("instruction", "input", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def canonical(record: str, mappings: dict[str, Mapping]) -> tuple[str, list[tuple[str, str]] | None]:
    """The fingerprint of a JSON record and its turns; None if no mapping has the fingerprint or it isn't JSON."""
    try:
        x = json.loads(record or "")
    except (ValueError, RecursionError):
        return "", None
    key = fingerprint(field_paths(x))
    return key, mappings[key].read(x) if key in mappings else None


def escape(text: str, marks: str = r"[\\<#]") -> str:
    return re.sub(marks, r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TURN = re.compile(r"<turn>### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans that count for the loss: the texts of the assistant, without marks."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn>### {escape(role, r'[\\<#:]')}:\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


FORMATTED = "id long, fingerprint string, n_turns long, formatted string"


def format_records(records: DataFrame, id_col: str = "id", record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Formatted texts of JSON records: id, fingerprint, n_turns, formatted, spans.

    ``spans`` is an array of (start, end) in code points under the loss mask.
    Records that no mapping fits keep their row with null n_turns, formatted
    and spans; null records have an empty fingerprint. Other columns of the
    input are left out. Rows that repeat stay; an empty table gives an empty table.
    """
    known = {fingerprint(m.paths): m for m in mappings}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*arrow_schema(FORMATTED), pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for batch in batches:
            rows, size = [], 0
            for key, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, turns = canonical(record, known)
                text, spans = render(turns) if turns is not None else (None, None)
                rows.append({"id": key, "fingerprint": found, "n_turns": None if turns is None else len(turns), "formatted": text, "spans": spans and [{"start": a, "end": b} for a, b in spans] if spans is not None else None})
                size += len(text or "")
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return records.select(F.col(id_col).cast("long"), F.col(record_col).cast("string")).mapInArrow(apply, f"{FORMATTED}, spans array<struct<start: long, end: long>>")


def pack_turns(rows: DataFrame) -> DataFrame:
    """One JSON record (id, record) for each conv_id of ``rows`` (conv_id, turn, role, text).

    A user's and an assistant's row make a prompt and response record, anything
    else a list of turns. Turns sort by ``turn``, then role and text; null roles
    and texts are empty. Rows without conv_id make one conversation.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text")))).alias("t"))
    pair = (F.size("t") == 2) & (F.col("t")[0]["role"] == "user") & (F.col("t")[1]["role"] == "assistant")
    listed = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns")))
    return grouped.select(F.col("conv_id").alias("id"), F.when(pair, F.to_json(F.struct(F.col("t")[0]["text"].alias("prompt"), F.col("t")[1]["text"].alias("response")))).otherwise(listed).alias("record"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted texts and their spans hold."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, loss = parse(text), "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((key, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, arrow_schema(DIGEST))], schema=arrow_schema(DIGEST))

    return formatted.select("id", "formatted", "spans").mapInArrow(apply, DIGEST)


def op3_schema_fingerprint(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    hard = spark.createDataFrame([(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(hard)
    return read_back(format_records(pack_turns(rows)))


OP3_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(COALESCE(SUM(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(SUM(10 + 2 + 8 + 2 * length(role) - length(translate(role, '\<#:', '')) + 2 * length(text) - length(translate(text, '\<#', ''))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
