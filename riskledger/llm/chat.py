"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its assistant
texts are intersected with the sorted token spans by binary search.  The template is
``<s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>...``; its control strings inside roles and texts
get a backslash after their first character and a backslash is doubled, so reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import tokens
from riskledger.llm.common import by_group, group_starts, query, table

BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
FRONT, BACK = "<s", ">"
_CONTROL = re.compile(r"\\|</?s>|\[/?INST\]")
_ESCAPED = re.compile(r"\\\\|\\")


@dataclass(frozen=True)
class Chat:
    """Production parameters; a conversation beyond ``turns`` or ``chars`` is formatted in segments."""

    loss_role: str = "assistant"
    turns: int = 5000
    chars: int = 16 << 20
    slice_rows: int = 1000


FORMATTED = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("ids", pa.binary()),
                       ("starts", pa.binary()), ("ends", pa.binary()), ("mask", pa.binary()),
                       ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
FORMATTED_DDL = ("conv_id long, segment long, formatted string, ids binary, starts binary, ends binary, mask binary, "
                 "loss_starts array<long>, loss_ends array<long>")
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:], text)


def render(turns: list[tuple[str, str]], loss_role: str, begin: bool = True) -> tuple[str, list[int], list[int]]:
    """The formatted text and the spans of the texts of ``loss_role``."""
    out, at, starts, ends = [BEGIN] if begin else [], len(BEGIN) if begin else 0, [], []
    for role, text in turns:
        head, body = ROLE + escape(role) + TEXT, escape(text)
        out += head, body, END
        at += len(head)
        if role == loss_role:
            starts.append(at)
            ends.append(at + len(body))
        at += len(body) + len(END)
    return "".join(out), starts, ends


def render_segment(turns: list[tuple[str, str]], loss_role: str) -> tuple[str, list[int], list[int]]:
    """Some turns of a longer conversation: from the last character of the control string before them to
    the last but one of that after them.

    The whole is ``FRONT``, its segments in order and ``BACK``.  A tokenizer that keeps letters and signs apart has
    a border between ``s`` and ``>`` whatever stands around, so ids of segments in order are those of the whole.
    """
    text, starts, ends = render(turns, loss_role, False)
    return BACK + text[:-len(BACK)], [s + len(BACK) for s in starts], [e + len(BACK) for e in ends]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, or of a segment of one."""
    if formatted.startswith(BACK):
        formatted = formatted[len(BACK):] + BACK
    at, out = len(BEGIN) if formatted.startswith(BEGIN) else 0, []
    while at < len(formatted):
        middle = formatted.index(TEXT, at)
        end = formatted.index(END, middle)
        out.append((unescape(formatted[at + len(ROLE):middle]), unescape(formatted[middle + len(TEXT):end])))
        at = end + len(END)
    return out


def loss_mask(token_starts: np.ndarray, token_ends: np.ndarray, starts: list[int], ends: list[int]):
    """(mask over tokens, covered starts, covered ends): spans met with tokens by binary search."""
    mask, covered = np.zeros(len(token_starts), bool), ([], [])
    first = np.searchsorted(token_ends, starts, side="right")
    last = np.searchsorted(token_starts, ends, side="left")
    for s, e, a, b in zip(starts, ends, first, last):
        if a < b and s < e:
            mask[a:b] = True
            covered[0].append(max(s, int(token_starts[a])))
            covered[1].append(min(e, int(token_ends[b - 1])))
    return mask, *covered


class Encoder:
    """Ids and offsets of texts; about ``CHARS`` characters are encoded at once, which bounds memory."""

    CHARS = 1 << 18

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True

    def __call__(self, texts: list[str]):
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= self.CHARS):
                size += len(texts[end])
                end += 1
            for found in self.tokenizer.encode_batch(texts[at:end], add_special_tokens=False):
                offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
                yield np.array(found.ids, "<u4"), offsets[:, 0], offsets[:, 1]
            at = end


def _format(encode: Encoder, p: Chat, conversations: list[tuple]) -> pa.RecordBatch | None:
    """Rows of FORMATTED for (conv_id, segment, turns, whether it begins a conversation)."""
    drawn = [(render if begin else render_segment)(turns, p.loss_role) for _, _, turns, begin in conversations]
    columns: dict[str, list] = {n: [] for n in FORMATTED.names}
    for (conv, segment, _, _), (text, starts, ends), (ids, a, b) in zip(conversations, drawn, encode([d[0] for d in drawn])):
        mask, s, e = loss_mask(a, b, starts, ends)
        for name, value in zip(FORMATTED.names, (conv, segment, text, ids.tobytes(), a.astype("<i4").tobytes(),
                                                 b.astype("<i4").tobytes(), mask.astype(np.uint8).tobytes(), s, e)):
            columns[name].append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in FORMATTED], schema=FORMATTED) if drawn else None


def _turns(rows: pa.Table, s: int, e: int) -> list[tuple[str, str]]:
    part = rows.slice(s, e - s)
    return [(r or "", t or "") for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]


def _key(rows: pa.Table, at: int) -> int | None:
    return None if rows.column("nameless")[at].as_py() else rows.column("key")[at].as_py()


def formatted(conversations: DataFrame, p: Chat | None = None, path: str = tokens.BYTE_BPE) -> tuple[DataFrame, DataFrame]:
    """Two frames of conv_id, segment, formatted, ids, starts, ends, mask, loss_starts, loss_ends.

    In the first a row is a whole conversation; the second holds conversations beyond the limits of
    ``p``, cut between turns: ``FRONT``, the segments in order and ``BACK`` make up the formatted text, and ids,
    offsets from the segment's place and masks are those of the whole, wherever it is cut.  ``starts``, ``ends``: the
    characters of each token; ``mask``: a byte a token, 1 if it has a character under the loss;
    ``loss_starts``, ``loss_ends``: the characters under the loss, one span for each non-empty text.

    Turns are ordered by turn (null first), then role and text.  Null roles and texts are empty.  Rows
    with a null conv_id are one conversation.  Repeated rows are repeated turns.  No rows, no result.
    """
    p = p or Chat()
    vocabulary = tokens.shipped(conversations.sparkSession, path)
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("key"), F.col("conv_id").isNull().cast("int").alias("nameless"),
                                "turn", "role", "text")
    order = ["key", "nameless", "turn", "role", "text"]
    sizes = rows.groupBy("key", "nameless").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long_ones = sizes.where((F.col("n") > p.turns) | (F.col("chars") > p.chars)).select("key", "nameless")

    def whole(rows: pa.Table):
        encode = tokens.loaded(Encoder, vocabulary.value)
        starts = group_starts(rows, ["key", "nameless"])
        return _format(encode, p, [(_key(rows, s), 0, _turns(rows, s, e), True) for s, e in zip(starts, [*starts[1:], rows.num_rows])])

    def segments(batches):
        from pyspark import TaskContext
        encode, number = tokens.loaded(Encoder, vocabulary.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, p.slice_rows):
                rows = pa.Table.from_batches([batch.slice(at, p.slice_rows)])
                if rows.num_rows:
                    starts = group_starts(rows, ["key", "nameless"])
                    parts = [(_key(rows, s), number + k, _turns(rows, s, e), False) for k, (s, e) in enumerate(zip(starts, [*starts[1:], rows.num_rows]))]
                    number += len(parts)
                    yield _format(encode, p, parts)
    short = rows.join(long_ones, ["key", "nameless"], "left_anti").repartition("key", "nameless").sortWithinPartitions(*order)
    hot = rows.join(long_ones, ["key", "nameless"], "left_semi").repartitionByRange(*order).sortWithinPartitions(*order)
    return short.mapInArrow(by_group(["key", "nameless"], whole), FORMATTED_DDL), hot.mapInArrow(segments, FORMATTED_DDL)


def digests(batches):
    """One row a conversation, read back from its formatted text and loss spans, segments in order."""
    now, state = None, None

    def row():
        turns, digest, loss, chars, size = state
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (now, turns, digest.hexdigest(), chars, loss.hexdigest(), size), DIGEST)], schema=DIGEST)
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "segment", "formatted", "loss_starts", "loss_ends")]
        for conv, _, text, starts, ends in zip(*columns):
            if state is None or conv != now:
                if state is not None:
                    yield row()
                now, state = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for s, e in zip(starts, ends):
                said = unescape(text[s:e])
                state[2].update(said.encode())
                state[3] += len(said)
            state[4] += len(text)
    if state is not None:
        yield row()


def digested(short: DataFrame, hot: DataFrame) -> DataFrame:
    """Digests of both frames of ``formatted``; those of the second are read segment by segment.

    The second frame leaves out ``FRONT`` and ``BACK``, which are counted here.
    """
    wanted = ["conv_id", "segment", "formatted", "loss_starts", "loss_ends"]
    later = hot.select(*wanted).repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(digests, DIGEST_DDL)
    later = later.withColumn("formatted_chars", F.col("formatted_chars") + len(FRONT) + len(BACK))
    return short.select(*wanted).mapInArrow(digests, DIGEST_DDL).union(later)


_SHA = "sha256(coalesce(string_agg({}, '' ORDER BY turn NULLS FIRST, role, text){}, ''))"
_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  c AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\\\|</?s>|\\[/?INST\\]')) AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, {_SHA.format("role || chr(10) || text || chr(10)", "")} AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  {_SHA.format("text", " FILTER (WHERE role = 'assistant')")} AS loss_sha256,
  CAST({len(BEGIN)} + sum(shown + {len(ROLE) + len(TEXT) + len(END)}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


@query("op3_chat_format", _SQL)
def op3(spark, sf_dir):
    """All conversations formatted and read back, with one that says nothing but control strings."""
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digested(*formatted(rows.union(own)))
