"""Chat formatting by schema fingerprints.

The nested field paths of a record, sorted and hashed, are its layout's fingerprint; it selects a
declarative mapping that turns the record into canonical turns (conversation, place, role, text).
A table of typed columns has one layout; a column of JSON records may have another in each row.

The template marks turns with control strings. In roles and texts a control string gets a backslash
after its first character and each backslash is doubled, so no text can open or close a turn, and
texts are read back exactly.

Scale: each turn is formatted by itself into one segment. A conversation is its segments in order;
they are sorted by Spark (which spills) and read as a stream that holds one batch and a few
counters, so a conversation with a third of all rows needs no more memory than others.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import text_of

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that chat templates use: the first character, the rest. Java and Python read the pattern alike.
CONTROL = r"([<\[])(\|[^|<>\s]{1,32}\|>|/?s>|/?INST\]|</?SYS>>)"
_SEGMENT = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*){re.escape(CLOSE)}", re.DOTALL)

#: Layouts as (field paths, how to read them). A list layout: (path of the list, role, text, field of a system turn before it, if any). A row layout: (turn, role, text).
#: A flat layout: each field in order with the role it speaks as; fields that share a role and stand together are one turn.
LAYOUTS = [
    (["turn", "role", "text"], ("rows", "turn", "role", "text")),
    (["messages[].role", "messages[].content"], ("list", "messages", "role", "content")),
    (["system", "messages[].role", "messages[].content"], ("list", "messages", "role", "content", "system")),
    (["conversation[].role", "conversation[].content"], ("list", "conversation", "role", "content")),
    (["conversations[].from", "conversations[].value"], ("list", "conversations", "from", "value")),
    (["system", "conversations[].from", "conversations[].value"], ("list", "conversations", "from", "value", "system")),
    (["turns[].role", "turns[].text"], ("list", "turns", "role", "text")),
    (["prompt", "completion"], ("flat", ("prompt", "user"), ("completion", "assistant"))),
    (["prompt", "response"], ("flat", ("prompt", "user"), ("response", "assistant"))),
    (["system", "prompt", "response"], ("flat", ("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    (["question", "answer"], ("flat", ("question", "user"), ("answer", "assistant"))),
    (["instruction", "output"], ("flat", ("instruction", "user"), ("output", "assistant"))),
    (["instruction", "input", "output"], ("flat", ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    (["system", "instruction", "input", "output"], ("flat", ("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
]
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = frozenset(path for paths, _ in LAYOUTS for path in paths)
TURNS = "conv_id long, turn long, role string, text string"


def schema_fingerprint(paths: list[str] | set[str]) -> str:
    """Hex digest of the field paths that some layout knows; other fields don't change a layout."""
    return hashlib.sha256("\n".join(sorted(_KNOWN & set(paths))).encode()).hexdigest()


MAPPINGS = {schema_fingerprint(paths): how for paths, how in LAYOUTS}


def paths_of(value: object, at: str = "") -> set[str]:
    """Field paths of a parsed JSON record; [] stands for any place of a list."""
    if isinstance(value, dict):
        return set().union(*(paths_of(x, f"{at}.{k}" if at else k) for k, x in value.items()))
    if isinstance(value, list):
        return set().union(*(paths_of(x, f"{at}[]") for x in value))
    return {at}


def paths_of_schema(kind: T.DataType, at: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(*(paths_of_schema(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return paths_of_schema(kind.elementType, f"{at}[]")
    return {at}


def turns_of_record(record: object) -> list[tuple[str, str]] | None:
    """(role, text) of each turn of a parsed record; None if no mapping has its fingerprint, or an item of its list is no object."""
    how = MAPPINGS.get(schema_fingerprint(paths_of(record))) if isinstance(record, dict) else None
    if how is None or how[0] == "rows":
        return None
    as_text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if how[0] == "list":
        if not all(isinstance(x, dict) for x in record[how[1]]):
            return None
        first = [("system", as_text(record[how[4]]))] if len(how) > 4 and record[how[4]] else []
        return first + [(ROLES.get(r := as_text(x.get(how[2])), r), as_text(x.get(how[3]))) for x in record[how[1]]]
    turns: list[tuple[str, str]] = []
    for field, role in how[1:]:
        text = as_text(record.get(field))
        if turns and turns[-1][0] == role:
            turns[-1] = (role, turns[-1][1] + "\n\n" + text if text else turns[-1][1])
        elif text or role != "system":
            turns.append((role, text))
    return turns


def canonical_rows(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turns of a table of typed columns, by the fingerprint of its schema; ValueError if no mapping has it.

    Columns that no layout knows are ignored. A null role or text is empty; a null turn is kept.
    """
    paths = paths_of_schema(df.drop(key).schema)
    how = MAPPINGS.get(schema_fingerprint(paths))
    if how is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    rename = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role_of = lambda c: F.coalesce(F.try_element_at(rename, c.cast("string")), c.cast("string"), F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    conv = F.col(key).cast("long").alias("conv_id")
    if how[0] == "rows":
        return df.select(conv, F.col(how[1]).cast("long").alias("turn"), role_of(F.col(how[2])).alias("role"), text_of(how[3]).alias("text"))
    if how[0] == "list":
        items = F.transform(how[1], lambda x: F.struct(x[how[2]].cast("string").alias(how[2]), x[how[3]].cast("string").alias(how[3])))
        if len(how) > 4:
            first = F.array(F.struct(F.lit("system").alias(how[2]), F.col(how[4]).cast("string").alias(how[3])))
            items = F.concat(F.when(text_of(how[4]) != "", first).otherwise(F.slice(first, 1, 0)), items)
        rows = df.select(conv, F.posexplode(items).alias("turn", "x"))
        return rows.select("conv_id", F.col("turn").cast("long"), role_of(F.col(f"x.{how[2]}")).alias("role"), text(F.col(f"x.{how[3]}")).alias("text"))
    roles = list(dict.fromkeys(role for _, role in how[1:]))
    joined = {r: F.array_join(F.filter(F.array(*(text(F.col(c)) for c, x in how[1:] if x == r)), lambda v: v != ""), "\n\n") for r in roles}
    turns = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), joined[r].alias("text")) for r in roles)), lambda x: (x["role"] != "system") | (x["text"] != ""))
    return df.select(conv, F.posexplode(turns).alias("turn", "x")).select("conv_id", F.col("turn").cast("long"), "x.role", "x.text")


def _storable(text: str) -> bool:
    """Whether a string has no lone surrogate."""
    return text.isascii() or not re.search("[\ud800-\udfff]", text)


def canonical_json(df: DataFrame, key: str = "conv_id", record: str = "record") -> tuple[DataFrame, DataFrame]:
    """Turns of a column of JSON records, each by its own fingerprint, and the records that are rejected.

    The second table has conv_id, record and fingerprint. Rejected are records whose fingerprint has
    no mapping, whose list has an item that is no object, and whose texts are no Unicode (a lone
    half of a surrogate pair). Bad JSON (too deeply nested, too) and null have a null fingerprint.
    """
    kinds = "conv_id long, turns array<struct<role string, text string>>, record string, fingerprint string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, prints = [], []
            for raw in batch.column(1).to_pylist():
                try:
                    value = json.loads(raw)
                    found, mark = turns_of_record(value), schema_fingerprint(paths_of(value))
                except (TypeError, ValueError, RecursionError):
                    found, mark = None, None
                turns.append(None if found is None or not all(_storable(x) for turn in found for x in turn) else [{"role": r, "text": t} for r, t in found])
                prints.append(mark)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), batch.column(1), pa.array(prints, pa.string())], names=["conv_id", "turns", "record", "fingerprint"])

    read = df.select(F.col(key).cast("long").alias("conv_id"), F.col(record).cast("string").alias("record")).mapInArrow(run, kinds)
    good = read.select("conv_id", F.posexplode("turns").alias("turn", "x")).select("conv_id", F.col("turn").cast("long"), "x.role", "x.text")
    return good, read.where("turns IS NULL").select("conv_id", "record", "fingerprint")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def escape(text: str) -> str:
    return re.sub(CONTROL, r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {None: "", "n": "\n"}.get(m[1], "\\"), role)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, segment, loss_start, loss_end of each turn.

    segment: the formatted turn. loss_start, loss_end: the code points of it under the loss mask
    (the text of an assistant turn); null for other roles.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(_escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = _escaped(text)
    learned = role == "assistant"
    return turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(CLOSE)).alias("segment"),
        F.when(learned, F.length(head)).cast("long").alias("loss_start"), F.when(learned, F.length(head) + F.length(body)).cast("long").alias("loss_end"),
    )


def read_segment(segment: str) -> tuple[str, str]:
    """role, text of a formatted turn."""
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError(f"not a turn: {segment[:80]!r}")
    return unescape_role(m[1]), unescape(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """Of each conversation, read back from its segments: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns go by place (nulls first), then role, then text. A null conv_id is a conversation. Its
    digests run over the turns in order, so one task must read a conversation whole; it sorts by
    Spark, which spills, and holds one batch of turns, however many there are.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        now, begun = None, False
        turns = chars = loss_chars = 0
        all_turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append((now, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, begun, turns, chars, loss_chars = conv, True, 0, 0, 0
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                role, text = read_segment(segment)
                turns, chars = turns + 1, chars + len(segment)
                all_turns.update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(segment[start:end])
                    loss_chars += len(learned)
                    loss.update(learned.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if isinstance(x[0], str) else pa.int64()) for x in zip(*done, strict=True)], names=names)
        if begun:
            last = (now, turns, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in last], names=names)

    # Nothing follows that could part a conversation: the sort and the stream are in one stage.
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, schema)
