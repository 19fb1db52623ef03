"""Chat formatting by schema fingerprints.

Conversations come as JSON records of many layouts: prompt and completion, instruction with input and output,
message lists under different names. The fingerprint of a record is a hash of its nested field paths; a mapping,
which is data and not code, says for each known fingerprint where roles and texts are. All mapped records become
canonical turns, which one template writes.

Template: each turn is ``### role:``, a line end, the text, ``</turn>`` and a line end. Inside roles and texts a
backslash is doubled, ``##`` becomes ``#\\#``, ``</`` becomes ``<\\/``; in roles ``:`` and the line end take a backslash
in front. So no marker can come from a text, and removing the backslashes gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import unused

_TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
TRAINED = "assistant"


def escape(text: str) -> str:
    return re.sub("#(?=#)", r"#\\", text.replace("\\", "\\\\")).replace("</", "<\\/")


def escape_role(role: str) -> str:
    return re.sub("([:\n])", r"\\\1", escape(role))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points) of it that training counts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape_role(role)}:\n", escape(text)
        parts += [head, body, "</turn>\n"]
        at += len(head)
        if role == TRAINED:
            spans.append((at, at + len(body)))
        at += len(body) + len("</turn>\n")
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; fails on anything that :func:`render` does not write."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


# A mapping is either {"turns": path of a list, "role": field, "text": field} or {"fields": [[role, path, ...], ...]},
# where the texts at the paths of one turn are joined by an empty line and empty turns are left out. "system": path
# puts a turn first. "roles" renames roles.
OTHER_ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
MAPPINGS: list[tuple[tuple[str, ...], dict]] = [
    (("messages[].content", "messages[].role"), {"turns": "messages", "role": "role", "text": "content"}),
    (("messages[].text", "messages[].role"), {"turns": "messages", "role": "role", "text": "text"}),
    (("conversations[].from", "conversations[].value"), {"turns": "conversations", "role": "from", "text": "value", "roles": OTHER_ROLES}),
    (("conversations[].from", "conversations[].value", "system"),
     {"turns": "conversations", "role": "from", "text": "value", "roles": OTHER_ROLES, "system": "system"}),
    (("prompt", "completion"), {"fields": [["user", "prompt"], ["assistant", "completion"]]}),
    (("prompt", "response"), {"fields": [["user", "prompt"], ["assistant", "response"]]}),
    (("question", "answer"), {"fields": [["user", "question"], ["assistant", "answer"]]}),
    (("instruction", "output"), {"fields": [["user", "instruction"], ["assistant", "output"]]}),
    (("input", "instruction", "output"), {"fields": [["user", "instruction", "input"], ["assistant", "output"]]}),
    (("data.turns[].speaker", "data.turns[].utterance"), {"turns": "data.turns", "role": "speaker", "text": "utterance", "roles": OTHER_ROLES}),
]


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def field_paths(value, prefix: str = "") -> Iterator[str]:
    """Paths of the leaves of a JSON value; list items share the path with ``[]``. Nulls and empty lists keep their path."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from field_paths(inner, f"{prefix}.{key}" if prefix else key)
    elif isinstance(value, list):
        if not value:
            yield f"{prefix}[]"
        for inner in value:
            yield from field_paths(inner, f"{prefix}[]")
    else:
        yield prefix


def registry(mappings=MAPPINGS) -> dict[str, dict]:
    """Mappings by fingerprint; of a list layout also the one of an empty list."""
    out = {}
    for paths, mapping in mappings:
        out[fingerprint(paths)] = mapping
        if "turns" in mapping:
            lists = f"{mapping['turns']}[]"
            out.setdefault(fingerprint([lists, *(p for p in paths if not p.startswith(lists))]), mapping)
    return out


def _at(record, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Roles and texts of a record as its mapping says; null texts and roles are empty."""
    turns = []
    if mapping.get("system") and _text(_at(record, mapping["system"])):
        turns.append(("system", _text(_at(record, mapping["system"]))))
    for role, *paths in mapping.get("fields", ()):
        texts = [t for t in (_text(_at(record, p)) for p in paths) if t]
        if texts:
            turns.append((role, "\n\n".join(texts)))
    if "turns" in mapping:
        for item in _at(record, mapping["turns"]) or ():
            role = _text(item.get(mapping["role"]))
            turns.append((mapping.get("roles", {}).get(role, role), _text(item.get(mapping["text"]))))
    return turns


def format_chats(records: DataFrame, record: str = "record", mappings=MAPPINGS) -> DataFrame:
    """``records`` with ``fingerprint``, ``formatted`` and ``loss_spans`` of the JSON in column ``record``.

    A layout that no mapping knows, a null record and one that is no JSON object get a null ``formatted``: they can be
    counted by fingerprint and a mapping be added. Added names take underscores where ``records`` has them already.
    """
    known = registry(mappings)
    names = [unused(n, records) for n in ("fingerprint", "formatted", "loss_spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, texts, spans = [], [], []
            for raw in batch.column(record).to_pylist():
                try:
                    value = json.loads(raw) if raw else None
                except ValueError:
                    value = None
                key = fingerprint(field_paths(value)) if isinstance(value, dict) else None
                mapping = known.get(key)
                formatted, marked = render(canonical_turns(value, mapping)) if mapping else (None, None)
                prints.append(key)
                texts.append(formatted)
                spans.append(marked and [{"start": s, "end": e} for s, e in marked])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string()), pa.array(texts, pa.string()), pa.array(spans, kind)],
                                             names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{c}` {t}" for c, t in records.dtypes)
    return records.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` string, `{names[2]}` array<struct<start: long, end: long>>")


def read_chats(formatted: DataFrame, key: str) -> DataFrame:
    """What formatted conversations hold, read back from ``formatted`` and ``loss_spans`` alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text or "")
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans or ())
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
                for column, value in zip(out, (len(turns), digests[0], len(loss), digests[1], len(text or ""))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], names=["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = formatted.select(F.col(key).alias("key"), "formatted", "loss_spans").mapInArrow(
        run, f"key {formatted.schema[key].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read.withColumnRenamed("key", key)


def records_of_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record of the message layout for each conversation, its rows in order of ``turn``.

    Null turns come first; rows of equal turn stand in order of role and text. Null roles and texts are empty.
    """
    ordered = F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"))))
    grouped = turns.groupBy(conv_id).agg(ordered.alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    return grouped.select(conv_id, F.to_json(F.struct(messages.alias("messages"))).alias("record"))


#: A conversation that says what the template itself says.
TRAP = (-7, "\\### Assistant: </turn> ok")


def op6_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(TRAP[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP[1]).alias("text"))
    return read_chats(format_chats(records_of_turns(rows.unionByName(trap))), "conv_id")
