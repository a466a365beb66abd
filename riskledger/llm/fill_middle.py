"""Fill-in-the-middle documents by displacement.

A batch of texts is one byte array.  Two cuts part each text into prefix, middle and suffix; in the
output the parts change places and sentinels stand before them, so every byte of a part moves by the
same number of places.  The changes of that displacement from part to part go into a difference array,
its running sum is the displacement of every byte, and one scatter writes the output.  Restoring finds
the sentinels, builds the displacement the other way round and gathers.  No text is handled by itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskledger.llm.common import query, slices, table

PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = np.array([PLAIN, PSM, SPM], object)
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                 ("middle_chars", pa.int64()), ("output", pa.string())])
DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Fim:
    """Sentinels and rates.  ``rate`` of 100 documents are cut, ``spm`` of 100 of those begin with the suffix.

    The first character of the sentinels may occur in them only at their beginning, so that no text next
    to a sentinel can be taken for one.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    spm: int = 20
    seed: int = 1

    def __post_init__(self):
        marks = [self.prefix, self.suffix, self.middle]
        if not all(marks) or len(set(marks)) < 3 or any(m[0] != marks[0][0] or marks[0][0] in m[1:] for m in marks) \
                or any(a != b and a.startswith(b) for a in marks for b in marks):
            raise ValueError("sentinels must be three strings that begin with one mark and hold it nowhere else")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a document; a null doc_id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def found(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Where ``mark`` stands inside one of the texts."""
    at = np.flatnonzero(data[:max(0, len(data) - len(mark) + 1)] == mark[0])
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    return at[at + len(mark) <= offsets[np.searchsorted(offsets, at, side="right")]] if len(at) else at


def displacement(size: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Shift of each of ``size`` bytes, for parts in order with their first byte and their shift."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.cumsum(change[:size])


class Displacer:
    def __init__(self, fim: Fim):
        self.fim = fim
        self.marks = [m.encode() for m in (fim.prefix, fim.suffix, fim.middle)]

    def cut(self, data, offsets, h) -> dict:
        """Code points, form (0 plain, 1 psm, 2 spm) and the two cuts of every text, in characters and bytes."""
        begins = (data & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(begins)])
        place = np.append(np.flatnonzero(begins), len(data))
        first, n = before[offsets[:-1]], np.diff(before[offsets])
        marked = np.zeros(len(n), bool)
        for mark in self.marks:
            marked[np.searchsorted(offsets, found(data, offsets, mark), side="right") - 1] = True
        form = np.where((n == 0) | marked | (h[2] % 100 >= self.fim.rate), 0, np.where(h[3] % 100 < self.fim.spm, 2, 1))
        a, b = h[0] % (n + 1), h[1] % (n + 1)
        low, high = np.minimum(a, b), np.maximum(a, b)
        return {"n": n, "form": form, "low": low, "high": high, "p": place[first + low], "m": place[first + high]}

    def scatter(self, data, offsets, cuts) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the outputs."""
        form, begin, end = cuts["form"], offsets[:-1], offsets[1:]
        moved = form > 0
        p, m = np.where(moved, cuts["p"], begin), np.where(moved, cuts["m"], begin)
        lp, ls = p - begin, end - m
        size_p, size_s, size_m = (len(x) for x in self.marks)
        out_offsets = np.concatenate([[0], np.cumsum(end - begin + np.where(moved, size_p + size_s + size_m, 0))])
        base = out_offsets[:-1]
        at_p = np.where(form == 2, base + size_s + ls, base)
        at_s = np.where(form == 2, base, base + size_p + lp)
        at_m = base + size_p + lp + size_s + ls
        starts = np.column_stack([begin, p, m]).ravel()
        shifts = np.column_stack([np.where(moved, at_p + size_p, base) - begin,
                                  np.where(moved, at_m + size_m, base) - p,
                                  np.where(moved, at_s + size_s, base) - m]).ravel()
        out = np.empty(out_offsets[-1], np.uint8)
        out[np.arange(len(data)) + displacement(len(data), starts, shifts)] = data
        for at, mark in zip((at_p, at_s, at_m), self.marks):
            out[at[moved][:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
        return out, out_offsets

    def gather(self, data, offsets, form) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts that ``scatter`` got."""
        begin, end, moved = offsets[:-1], offsets[1:], form > 0
        at = []
        for mark in self.marks:
            here = found(data, offsets, mark)
            of = np.searchsorted(offsets, here, side="right") - 1
            here, of = here[moved[of]], of[moved[of]]
            if not np.array_equal(of, np.flatnonzero(moved)):
                raise ValueError("an output must hold each sentinel once")
            place = begin.copy()
            place[of] = here
            at.append(place)
        at_p, at_s, at_m = at
        size_p, size_s, size_m = (len(x) for x in self.marks)
        lp = np.where(moved, np.where(form == 2, at_m, at_s) - at_p - size_p, 0)
        ls = np.where(moved, np.where(form == 2, at_p, at_m) - at_s - size_s, 0)
        lm = np.where(moved, end - at_m - size_m, end - begin)
        if min(lp.min(initial=0), ls.min(initial=0), lm.min(initial=0)) < 0:
            raise ValueError("sentinels stand in another order than the form says")
        out_offsets = np.concatenate([[0], np.cumsum(lp + lm + ls)])
        base = out_offsets[:-1]
        starts = np.column_stack([base, base + lp, base + lp + lm]).ravel()
        sources = np.column_stack([np.where(moved, at_p + size_p, begin), np.where(moved, at_m + size_m, begin),
                                   np.where(moved, at_s + size_s, end)]).ravel()
        size = out_offsets[-1]
        return data[np.arange(size) + displacement(size, starts, sources - starts)], out_offsets


def transformed(docs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of ``docs``.

    A null or empty text, one that holds a sentinel, and those that the rate leaves out are ``plain``:
    the output is the text and the lengths are null.  A null doc_id draws as an empty one and stays null.
    Repeated rows give equal outputs; other columns are not read.
    """
    work = Displacer(fim)
    h = draws(F.col("doc_id"), fim.seed)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 10_000, "text"):
                data, offsets = flat(batch.column("text"))
                cuts = work.cut(data, offsets, [batch.column(f"h{k}").to_numpy() for k in range(4)])
                out, out_offsets = work.scatter(data, offsets, cuts)
                plain = cuts["form"] == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(cuts["n"]), pa.array(FORMS[cuts["form"]], pa.string()),
                    pa.array(cuts["low"], mask=plain), pa.array(cuts["high"] - cuts["low"], mask=plain),
                    strings(out, out_offsets)], schema=OUT)
    return docs.select(F.col("doc_id").cast("long"), "text", *(x.alias(f"h{k}") for k, x in enumerate(h))).mapInArrow(run, DDL)


def restored(outputs: DataFrame, fim: Fim = Fim()) -> DataFrame:
    """The rows of ``transformed`` with the exact text, rebuilt from output and form alone, as ``text``.

    A null output gives an empty text.  An output that does not hold each sentinel once, in the order of
    its form, is an error.
    """
    work = Displacer(fim)
    keep = [c for c in outputs.columns if c != "text"]
    rows = outputs.select(*keep)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 10_000, "output"):
                data, offsets = flat(batch.column("output"))
                form = np.array([0 if f == PLAIN else 2 if f == SPM else 1 for f in batch.column("form").to_pylist()])
                text = strings(*work.gather(data, offsets, form))
                yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
x AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
        ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
o AS (SELECT doc_id, t, n, form, p, q, substring(t, 1, p) AS a, substring(t, p + 1, q - p) AS m, substring(t, q + 1, n - q) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark, sf_dir):
    """Fill-in-the-middle outputs of all whole texts, and the texts restored from them."""
    rows = restored(transformed(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("text", 256).alias("restored_sha256"))
