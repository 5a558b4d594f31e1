"""Chat formatting: records of any known layout to canonical turns, turns to marked and escaped text with a loss mask, and back."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Escape character of formatted text: with 0 behind it stands for itself, with 1 it breaks a control string, with 2 it stands for a line end in a role.
MARK = "␛"
TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that no text or role may bring into formatted text: the template's own and those of common chat templates.
CONTROL = (TURN, "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters after which a conversation's formatted text goes on in another row.
PIECE = 1_000_000


@dataclass(frozen=True)
class Layout:
    """How records with the field paths ``required``, and any of ``optional``, become turns.

    ``fields``: (role, paths of its text, joined by an empty line), in order; or ``each``: (path of a list, role field, text field); a text field ``a[].b``
    joins parts, an empty role field makes turns alternate. ``names`` renames roles. A layout with ``single`` is one turn a record, of which these fields give conversation and number.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    names: tuple[tuple[str, str], ...] = ()
    single: tuple[str, str] | None = None

    def turns(self, v: Column) -> Column:
        got = lambda path, kind="string": F.try_variant_get(v, f"$.{path}", kind)
        turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        if self.single:
            return F.array(turn(got("role"), got("text")))
        if self.fields:
            made = []
            for role, paths in self.fields:
                text = F.concat_ws("\n\n", *(F.nullif(got(p), F.lit("")) for p in paths)) if len(paths) > 1 else got(paths[0])
                made.append(F.when(F.coalesce(*(got(p) for p in paths)).isNotNull(), turn(F.lit(role), text)))
            return F.filter(F.array(*made), lambda t: t.isNotNull())
        path, role, text = self.each
        if not role:
            return F.transform(got(path, "array<string>"), lambda x, i: turn(F.when(i % 2 == 0, "user").otherwise("assistant"), x))
        outer, _, inner = text.partition("[].")
        rows = got(path, f"array<struct<`{role}`: string, `{outer}`: {f'array<struct<`{inner}`: string>>' if inner else 'string'}>>")
        whole = (lambda x: F.array_join(F.transform(x[outer], lambda y: y[inner]), "")) if inner else (lambda x: x[outer])
        return F.transform(rows, lambda x: turn(self.role(x[role]), whole(x)))

    def role(self, role: Column) -> Column:
        out = role
        for given, canonical in self.names:
            out = F.when(role == given, canonical).otherwise(out)
        return out


_SHARED = (("human", "user"), ("gpt", "assistant"), ("bing", "assistant"), ("bard", "assistant"), ("chatgpt", "assistant"))
LAYOUTS = (
    Layout("turn", ("role",), ("conv_id", "turn", "text"), single=("conv_id", "turn")),
    Layout("completion", ("prompt", "completion"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("answer", ("question", "answer"), ("system", "context"), (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("parts", ("messages[].role", "messages[].content[].text"), ("messages[].content[].type",), each=("messages", "role", "content[].text")),
    Layout("shared", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), names=_SHARED),
    Layout("dialog", ("dialog[]",), each=("dialog", "", "")),
)


_TOKEN = re.compile(r"(`(?:[^`]|``)*`|\w+): |(OBJECT|ARRAY)<|(>)|([A-Z_]+(?:\([^)]*\))?)")


def paths_of(schema: str) -> list[str]:
    """The paths of a variant's schema, as ``schema_of_variant`` writes it, down to scalars, lists as ``[]``.

    Fields that are null everywhere are left out; a path of mixed kinds ends in ``*``.
    """
    out, stack, prefix, name = [], [], "", ""
    for key, opened, closed, kind in _TOKEN.findall(schema):
        if key:
            name = ".".join(filter(None, (prefix, key.strip("`"))))
        elif opened:
            stack.append(prefix)
            prefix, name = (name, name) if opened == "OBJECT" else (prefix, name + "[]")
        elif closed:
            prefix = stack.pop()
        elif kind != "VOID":
            out.append(name + "*" * (kind == "VARIANT"))
    return out


def fingerprint(paths) -> int:
    """64-bit hash of a set of field paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths))) - (1 << 63)


def known_fingerprints(layouts: tuple[Layout, ...]) -> dict[int, int]:
    """The number of a layout by the fingerprints of its required paths with each choice of its optional ones; an earlier layout wins."""
    out: dict[int, int] = {}
    for k, layout in enumerate(layouts):
        for n in range(len(layout.optional) + 1):
            for more in combinations(layout.optional, n):
                out.setdefault(fingerprint((*layout.required, *more)), k)
    return out


def with_layout(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with ``_fingerprint`` of the field paths that any layout names, and ``_layout``, the number of the layout that has it, or null.

    ``record`` is a column of type variant, or of JSON text. Paths that no layout names do not count; nor do fields that are null. A record that is
    null, malformed or of no known layout has a null ``_layout``.
    """
    known, vocabulary = known_fingerprints(layouts), {p for layout in layouts for p in (*layout.required, *layout.optional)}

    @F.pandas_udf("bigint")
    def hashed(schemas: pd.Series) -> pd.Series:
        each = {s: None if s is None else fingerprint(p for p in paths_of(s) if p.rstrip("*") in vocabulary) for s in schemas.unique()}
        return schemas.map(each).astype("Int64")

    value = F.col(record) if records.schema[record].dataType.typeName() == "variant" else F.try_parse_json(record)
    numbers = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return records.withColumn("_value", value).withColumn("_fingerprint", hashed(F.schema_of_variant("_value"))).withColumn("_layout", F.try_element_at(numbers, F.col("_fingerprint")))


def canonical_turns(records: DataFrame, record: str = "record", id_col: str = "id", layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Records of known layouts as turns ``conv_id, turn, role, text, layout``, and the records of none, with their ``_fingerprint``.

    A record is a conversation, ``id_col`` its id and its turns numbered from 0; one of a ``single`` layout is one turn of the conversation that its own fields
    name. A null text or role is empty. Every turn is a row: no row gathers a conversation. A null conversation id stays null.
    """
    told = with_layout(records, record, layouts)
    v, turns, conv, number = F.col("_value"), None, None, None
    for k, layout in enumerate(layouts):
        here, own = F.col("_layout") == k, layout.single
        turns = F.when(here, layout.turns(v)) if turns is None else turns.when(here, layout.turns(v))
        ids = F.try_variant_get(v, f"$.{own[0]}", "bigint") if own else F.col(id_col).cast("bigint")
        place = F.try_variant_get(v, f"$.{own[1]}", "bigint") if own else F.col("_place").cast("bigint")
        conv = F.when(here, ids) if conv is None else conv.when(here, ids)
        number = F.when(here, place) if number is None else number.when(here, place)
    names = F.element_at(F.array(*(F.lit(x.name) for x in layouts)), F.col("_layout") + 1)
    rows = told.where("_layout is not null").select("_value", "_layout", conv.alias("conv_id"), F.posexplode(turns).alias("_place", "_turn"))
    return rows.select("conv_id", number.alias("turn"), "_turn.role", "_turn.text", names.alias("layout")), told.where("_layout is null").drop("_value", "_layout")


def escape(text: str, role: bool = False) -> str:
    """No control string is left in the result, and ``unescape`` gives the text back."""
    out = text.replace(MARK, MARK + "0")
    for c in CONTROL:
        out = out.replace(c, f"{c[0]}{MARK}1{c[1:]}")
    return out.replace("\n", MARK + "2") if role else out


def unescape(text: str) -> str:
    return text.replace(MARK + "1", "").replace(MARK + "2", "\n").replace(MARK + "0", MARK)


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.string(), span), strict=True)], names=["conv_id", "piece", "last", "formatted", "loss"])


def _formatted(size: int, learned: str):
    """Turns in order of conversation and number to pieces of formatted text."""

    def run(batches):
        conv, piece, parts, loss, n, any_ = None, 0, [], [], 0, False
        for batch in batches:
            out = []
            for now, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if any_ and (now != conv or n >= size):
                    out.append((conv, piece, now != conv, "".join(parts), loss))
                    piece, parts, loss, n = 0 if now != conv else piece + 1, [], [], 0
                conv, any_ = now, True
                head, body = f"{TURN}{escape(role or '', True)}\n", escape(text or "")
                parts += (head, body, END)
                if role == learned:
                    loss.append((n + len(head), n + len(head) + len(body)))
                n += len(head) + len(body) + len(END)
            yield _piece_rows(out)
        if any_:
            yield _piece_rows([(conv, piece, True, "".join(parts), loss)])

    return run


def format_chats(turns: DataFrame, size: int = PIECE, learned: str = "assistant") -> DataFrame:
    """Formatted conversations: ``conv_id, piece, last, formatted, loss`` from ``turns(conv_id, turn, role, text)``.

    A turn is ``<|turn|>``, its role, a line end, its text and ``<|end|>`` with a line end; control strings in roles and texts are broken by an escape
    character. ``loss`` are the ranges of code points that bear loss: the texts of the role ``learned``, nothing around them. A conversation's text is that of
    its pieces one after another; a new one begins between two turns after ``size`` characters, so memory holds one turn and a piece.

    Turns are sorted by number, then role and text, within their conversation; null numbers come first, null roles and texts are empty, and turns
    without a conversation id are one conversation. Equal rows stay. An empty table gives an empty table; other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_formatted(size, learned), "conv_id bigint, piece bigint, last boolean, formatted string, loss array<struct<start: bigint, end: bigint>>")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns ``(role, text)`` of a piece."""
    each = (turn[len(TURN) :].partition("\n") for turn in formatted.split(END)[:-1])
    return [(unescape(role), unescape(text)) for role, _, text in each]


def read_chats(pieces: DataFrame) -> DataFrame:
    """Turns back from what ``format_chats`` made: ``conv_id, piece, place, role, text``."""

    def run(batches):
        for batch in batches:
            rows = [(conv, piece, k, *t) for conv, piece, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for k, t in enumerate(turns_of(text))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "piece", "place", "role", "text"])

    return pieces.select("conv_id", "piece", "formatted").mapInArrow(run, "conv_id bigint, piece bigint, place bigint, role string, text string")


def _digests(batches):
    """Pieces in order to the counts and digests of each conversation; a hash's state goes on over its pieces."""
    conv, any_ = None, False
    n = lost = chars = 0
    said, learned = hashlib.sha256(), hashlib.sha256()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    for batch in batches:
        out = []
        for now, last, text, loss in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if not any_ or now != conv:
                conv, any_, n, lost, chars, said, learned = now, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, body in turns_of(text):
                n += 1
                said.update(f"{role}\n{body}\n".encode())
            for span in loss:
                body = unescape(text[span["start"] : span["end"]])
                lost += len(body)
                learned.update(body.encode())
            chars += len(text)
            if last:
                out.append((conv, n, said.hexdigest(), lost, learned.hexdigest(), chars))
                any_ = False
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its pieces: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Conversations of one piece are read where they lie; only those of several are brought together, one piece in memory at a time.
    """
    schema, cols = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", ("conv_id", "last", "formatted", "loss")
    whole = pieces.where("piece = 0 and last").select(*cols).mapInArrow(_digests, schema)
    several = pieces.where("not (piece = 0 and last)").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return whole.unionByName(several.select(*cols).mapInArrow(_digests, schema))


def op11_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are full of control strings, formatted, written, and read back.

    Each row of the table is a record of the layout ``turn``; null texts and roles are empty.
    """
    from tidemark.tables import table

    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    tough = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    records = rows.union(tough).select(F.expr("to_variant_object(struct(conv_id, turn, role, text))").alias("record"), F.lit(None).cast("bigint").alias("id"))
    turns, _ = canonical_turns(records)
    return chat_digests(cut(format_chats(turns)))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '{MARK}', '{MARK}0')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}{MARK}1{c[1:]}')"
    return out


OP11_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN) + len(END) + 1} + length(replace({_sql_escape("role")}, chr(10), '{MARK}2')) + length({_sql_escape("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
