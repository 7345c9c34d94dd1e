"""Chat formatting: schema fingerprints select declarative mappings from any layout to canonical turns.

A mapping states the paths it reads. A layout (of a table, or of each JSON record) is told by the paths that it has: for each mapping, those
of the mapping's paths that are there are hashed, and the hash is looked up in the table of fingerprints, which names the mapping that
takes over; the first mapping found so counts. All other paths (extra fields and columns, at any depth) don't enter a hash.
Canonical turns are then written in a template that marks each turn and escapes control strings in the texts, and can
be read back without loss.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.llm.common import ship

#: Names under which data sets keep the three roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """How one family of layouts becomes turns.

    fields: (role, path) of single texts, in order; those of one role in a row are joined by an empty line. items: path of a
    list of messages with the names of its role and text fields; if both names are empty, the list holds texts of user and
    assistant in turn. row: the role and text columns of a table with one turn a row. optional: paths that may be missing.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    row: tuple[str, str] | None = None
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        out = {p for _, p in self.fields} | set(self.row or ())
        if self.items:
            at, role, text = self.items
            out |= {f"{at}[].{role}", f"{at}[].{text}"} if text else {f"{at}[]"}
        return out

    def fingerprints(self) -> list[str]:
        must = self.paths() - set(self.optional)
        return [fingerprint(must | set(extra)) for n in range(len(self.optional) + 1) for extra in combinations(self.optional, n)]


MAPPINGS = (
    Mapping("turn rows", row=("role", "text")),
    Mapping("content rows", row=("role", "content")),
    Mapping("messages", fields=(("system", "system"),), items=("messages", "role", "content"), optional=("system",)),
    Mapping("text messages", items=("messages", "role", "text")),
    Mapping("conversations", fields=(("system", "system"),), items=("conversations", "from", "value"), optional=("system",)),
    Mapping("dialog", items=("dialog", "", "")),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("prompt response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("question answer", fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "answer")), optional=("system_prompt",)),
)


#: What follows a path's name in a fingerprint if something other than a single value stands there.
ODD = "{}"


def fingerprint(paths: set[str]) -> str:
    """Hash of nested field paths such as ``messages[].role``: the first 16 hex digits of SHA-256 over the sorted paths, a line each."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def fingerprint_table(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, str]:
    """The mapping's name for the fingerprint of every layout that it reads."""
    return {f: m.name for m in mappings for f in m.fingerprints()}


def schema_paths(schema: T.DataType, at: str = "") -> set[str]:
    """Nested paths of a table's schema."""
    if isinstance(schema, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{f.name}".lstrip(".")) for f in schema.fields)) if schema.fields else set()
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, at + "[]")
    return {at} if at else set()


def _single(x: Column) -> Column:
    """Whether a variant is a single value or null; null if there is none."""
    return ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)<")


def _entry(record: Column, path: str) -> Column:
    """A path as it stands in a record's fingerprint: null if it isn't there, marked if what stands there is no single value.

    A field of a list's messages is there if all of them are objects and one has it, or if the list is empty.
    """
    at, listed, field = path.partition("[]")
    if not listed:
        fits = _single(F.try_variant_get(record, "$." + path, "variant"))
        return F.when(fits, path).when(~fits, path + ODD)
    items = F.try_variant_get(record, "$." + at, "array<variant>")
    if not field:
        fits = F.forall(items, lambda x: _single(x))
    else:
        value = lambda x: _single(F.try_variant_get(x, "$" + field, "variant"))
        objects = F.forall(items, lambda x: F.schema_of_variant(x).rlike("^(OBJECT<|VOID$)") & F.coalesce(value(x), F.lit(True)))
        some = (F.size(items) == 0) | F.exists(items, lambda x: F.coalesce(value(x), F.lit(False)))
        return F.when(~objects, path + ODD).when(some, path)
    return F.when(fits, path).when(~fits, path + ODD)


def record_layout(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS, table: dict[str, str] | None = None) -> Column:
    """The mapping's name for a JSON record (a variant column), by the fingerprint of the record's own paths; null if no fingerprint is known."""
    table = fingerprint_table(mappings) if table is None else table
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = []
    for m in mappings:
        if not m.row:
            own = F.array_join(F.array_compact(F.array(*[_entry(record, p) for p in sorted(m.paths())])), "\n")
            found.append(F.try_element_at(names, F.substring(F.sha2(own, 256), 1, 16)))
    return F.coalesce(*found)


TURNS = "array<struct<role:string,text:string>>"


def _turns(m: Mapping, text, items, said) -> Column:
    """A mapping's turns: text(path) is a single text, items(path) a list, said(item, field) a field's text of one of its members."""
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    turn = lambda role, body: F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.coalesce(body, F.lit("")).alias("text"))
    parts = []
    for role in dict.fromkeys(r for r, _ in m.fields):
        body = F.concat_ws("\n\n", *[F.when(text(p) != "", text(p)) for r, p in m.fields if r == role])
        parts.append(F.when((body != "") | F.lit(role != "system"), F.array(turn(role, body))).otherwise(F.array().cast(TURNS)))
    if m.items:
        at, role, body = m.items
        if body:
            listed = F.transform(items(at), lambda x: turn(F.coalesce(F.try_element_at(known, said(x, role)), said(x, role), F.lit("")), said(x, body)))
        else:
            listed = F.transform(items(at), lambda x, i: turn(F.when(i % 2 == 0, "user").otherwise("assistant"), said(x, "")))
        parts.append(F.coalesce(listed, F.array().cast(TURNS)))
    return F.concat(*parts)


def _plain(value) -> str | None:
    return None if value is None else json.dumps(value) if isinstance(value, (bool, list, dict)) else str(value)


def plain_turns(text: str | None, mappings: tuple[Mapping, ...] = MAPPINGS, table: dict[str, str] | None = None) -> list[tuple[str, str]] | None:
    """The turns of one JSON record, read by Python: for records that the JVM's reader refuses, as those with very long texts or repeated names, of which the last counts.

    None if the text is no JSON or its layout is unknown.
    """
    try:
        record = json.loads(text, parse_int=str, parse_float=str) if text else None
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    table = fingerprint_table(mappings) if table is None else table
    single = lambda x: not isinstance(x, (dict, list))

    def at(path: str):
        """(whether it is there, value)."""
        here = record
        for step in path.split("."):
            if not isinstance(here, dict) or step not in here:
                return False, None
            here = here[step]
        return True, here

    def entry(path: str) -> str | None:
        name, listed, field = path.partition("[]")
        there, value = at(name)
        if not there or listed and not isinstance(value, list):
            return None
        if not listed:
            return path if single(value) else path + ODD
        if not field:
            return path if all(map(single, value)) else path + ODD
        held = [x[field[1:]] for x in value if isinstance(x, dict) and field[1:] in x]
        if not all(x is None or isinstance(x, dict) for x in value) or not all(map(single, held)):
            return path + ODD
        return path if held or not value else None

    name = next((table[f] for m in mappings if not m.row and (f := fingerprint({e for p in m.paths() if (e := entry(p))})) in table), None)
    m = next((m for m in mappings if m.name == name), None)
    if m is None:
        return None
    out = []
    for role in dict.fromkeys(r for r, _ in m.fields):
        body = "\n\n".join(t for r, p in m.fields if r == role and (t := _plain(at(p)[1])))
        if body or role != "system":
            out.append((role, body))
    if m.items:
        listed, role, body = m.items
        for i, x in enumerate(at(listed)[1]):
            said = (lambda k, x=x: _plain((x or {}).get(k))) if body else None
            out.append((ROLES.get(said(role), said(role)) or "", said(body) or "") if body else (("user", "assistant")[i % 2], _plain(x) or ""))
    return out


def _record_turns(df: DataFrame, record_col: str, mappings: tuple[Mapping, ...], table: dict[str, str] | None) -> DataFrame:
    """``df`` with __turns, null for records of no known layout."""
    ship(df.sparkSession)
    rows = df.withColumn("__v", F.try_parse_json(F.col(record_col)))
    rows = rows.withColumn("__layout", record_layout(F.col("__v"), mappings, table))
    turns = F.lit(None).cast(TURNS)
    get = lambda x, path: F.try_variant_get(x, "$" + path, "string")
    for m in mappings:
        if not m.row:
            own = _turns(m, lambda p: get(F.col("__v"), "." + p), lambda p: F.try_variant_get(F.col("__v"), "$." + p, "array<variant>"), lambda x, f: get(x, "." + f if f else ""))
            turns = F.when(F.col("__layout") == m.name, own).otherwise(turns)

    @F.pandas_udf(TURNS)
    def refused(texts: pd.Series) -> pd.Series:
        read = (plain_turns(t, mappings, table) for t in texts)
        return pd.Series([x if x is None else [{"role": r, "text": t} for r, t in x] for x in read], dtype=object)

    left = F.when(F.col("__v").isNull(), F.col(record_col))
    return rows.withColumns({"__turns": turns, "__refused": refused(left)}).withColumn("__turns", F.coalesce("__turns", "__refused")).drop("__v", "__layout", "__refused")


def canonical_records(df: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, table: dict[str, str] | None = None) -> DataFrame:
    """(id, turn long, role, text) of JSON records (text) in any known layout, mixed freely in one table.

    table: the mapping's name by fingerprint, by default ``fingerprint_table``. A missing or null text is empty; a field text that
    is missing or empty gives no turn of its own. A list without messages is a known layout: a conversation without turns, so
    without rows. Unknown layouts, records that are not JSON and null records give no rows either (``unmapped_records`` returns them).
    Texts may be of any length, and of a name that a record repeats the last counts: such records, which the JVM's reader refuses, are
    read one at a time by ``plain_turns``. Repeated rows stay; columns other than the two are not carried, whatever their names, but the
    identifier's may not be that of another output column; an empty table gives an empty result.
    """
    if id_col in ("turn", "role", "text"):
        raise ValueError(f"an identifier column cannot be named {id_col}")
    rows = _record_turns(df.select(F.col(id_col), F.col(record_col).alias("__record")), "__record", mappings, table)
    return rows.select(id_col, F.posexplode("__turns").alias("turn", "t")).select(id_col, F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def unmapped_records(df: DataFrame, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, table: dict[str, str] | None = None) -> DataFrame:
    """Rows whose layout no mapping knows: null records and texts that are no JSON objects, too. Repeated rows and all columns stay; an empty table gives an empty result."""
    return _record_turns(df, record_col, mappings, table).where("__turns IS NULL").select(*df.columns)


def canonical_rows(df: DataFrame, id_col: str, order_col: str, mappings: tuple[Mapping, ...] = MAPPINGS, table: dict[str, str] | None = None) -> DataFrame:
    """(id, turn, role, text) of a table with one turn a row, or one record a row in nested columns, by the fingerprint of its schema's paths.

    Nested columns are read as they are, so texts may be of any length. Null roles and texts are empty, a null list has no turns; repeated rows
    stay; columns that the mapping doesn't name are not carried and don't count, nor do those of the identifier and order where
    they are named like a field; an empty table gives an empty result.
    """
    table = fingerprint_table(mappings) if table is None else table
    own = schema_paths(T.StructType([f for f in df.schema.fields if f.name not in (id_col, order_col)]))
    name = next((table[f] for m in mappings if (f := fingerprint(m.paths() & own)) in table), None)
    m = next((m for m in mappings if m.name == name), None)
    if m is None:
        raise ValueError(f"no mapping for the layout {', '.join(sorted(own))}")
    if m.row:
        return df.select(F.col(id_col), F.col(order_col).cast("long").alias("turn"), F.coalesce(F.col(m.row[0]), F.lit("")).alias("role"), F.coalesce(F.col(m.row[1]), F.lit("")).alias("text"))
    text = lambda p: F.col(p).cast("string") if p in own else F.lit(None).cast("string")
    turns = _turns(m, text, F.col, lambda x, f: (x[f] if f else x).cast("string"))
    return df.select(F.col(id_col), F.posexplode(turns).alias("turn", "t")).select(id_col, F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


# --- template ---

CLOSE = "</turn>\n"
_HEAD = re.compile(r'<turn role=("(?:[^"\\]|\\.)*")>\n')
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TRAINED = "assistant"


def escape(text: str) -> str:
    """Control strings get a backslash inside, backslashes are doubled; ``unescape`` undoes both."""
    return text.replace("\\", "\\\\").replace("</turn", "<\\/turn").replace("<turn", "<\\turn")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_turn(role: str, text: str) -> str:
    return f"<turn role={json.dumps(role, ensure_ascii=False).replace('<', chr(92) + 'u003c')}>\n{escape(text)}{CLOSE}"


class Reader:
    """Reads formatted text in pieces of any size; yields (role, text, whether the text is under the loss mask)."""

    def __init__(self):
        self.buffer = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str, bool]]:
        self.buffer += piece
        while (end := self.buffer.find(CLOSE)) >= 0:
            head = _HEAD.match(self.buffer)
            if not head:
                raise ValueError("not a formatted conversation")
            role = json.loads(head[1])
            yield role, unescape(self.buffer[head.end() : end]), role == TRAINED
            self.buffer = self.buffer[end + len(CLOSE) :]


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, segment): each turn in the template; a conversation's text is its segments in order.

    Conversations stand together, in order of turn, then role and text (ties, repeated rows stay). Turns are written as a stream, so
    that no task holds a conversation; null turns come first, a null identifier is a conversation of its own.
    """
    ship(turns.sparkSession)
    schema = T.StructType([turns.schema[id_col], T.StructField("turn", T.LongType()), T.StructField("segment", T.StringType())])
    dealt = turns.select(id_col, "turn", "role", "text").repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({id_col: f[id_col], "turn": f["turn"], "segment": [write_turn(r or "", t or "") for r, t in zip(f["role"], f["text"], strict=True)]})

    return dealt.mapInPandas(write, schema)


def conversation_digests(segments: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back, from segments in ``format_turns``'s order; one row a conversation.

    (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars); digests are taken over the stream, so that memory holds
    a turn, not a conversation. Null identifiers are one conversation; an empty table gives an empty result; a conversation
    that breaks off within a turn is an error. Columns other than the identifier and the segment don't count.
    """
    schema = T.StructType([segments.schema[id_col], *[T.StructField(n, k) for n, k in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = state = None

        def row():
            if state["reader"].buffer:
                raise ValueError("a conversation breaks off")
            return now[0], state["n"], state["turns"].hexdigest(), state["loss"], state["said"].hexdigest(), state["chars"]

        for f in frames:
            out = []
            for i, segment in zip(f[id_col].astype(object).where(f[id_col].notna(), None), f["segment"], strict=True):
                if now is None or now[0] != i:
                    if now is not None:
                        out.append(row())
                    now, state = (i,), {"reader": Reader(), "n": 0, "turns": hashlib.sha256(), "loss": 0, "said": hashlib.sha256(), "chars": 0}
                state["chars"] += len(segment)
                for role, text, trained in state["reader"].feed(segment):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if trained:
                        state["loss"] += len(text)
                        state["said"].update(text.encode())
            if out:
                yield pd.DataFrame(out, columns=schema.names)
        if now is not None:
            yield pd.DataFrame([row()], columns=schema.names)

    return segments.mapInPandas(read, schema)
