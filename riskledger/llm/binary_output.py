"""Token-id matrices: best-fit-decreasing packing with a segment tree over capacities.

Texts become token ids; longer ones are split losslessly.  Pieces are dealt to shares of bounded size
by a hash; in a share the longest goes first, each into the open row with the least room that holds it,
found in a segment tree over room sizes.  A packed row carries its ids as little-endian unsigned
16-bit numbers, the cumulative lengths of its segments and positions that begin again at each segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import tokens
from riskledger.llm.common import query, slices, table


@dataclass(frozen=True)
class Matrices:
    """Production parameters; ``share_rows``: about so many rows of ``length`` ids are packed at once."""

    length: int = 2048
    end_id: int = 50256
    share_rows: int = 2048
    chars_a_token: float = 2.5


PIECE_DDL = "doc_id long, piece int, start long, ids binary"
ROW = pa.schema([("share", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()),
                 ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())),
                 ("starts", pa.list_(pa.int64()))])
ROW_DDL = ("share long, row long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, "
           "pieces array<int>, starts array<long>")


class RoomTree:
    """Open rows by room: a segment tree over room sizes counts them, leaves stack them."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _change(self, room: int, by: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of ``least`` or more."""
        i = self.size + least
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        self._change(room, -1)
        return room, row


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers; ``lengths`` must be in falling order."""
    tree, rows = RoomTree(capacity), []
    for k, n in enumerate(lengths):
        found = tree.take(n)
        if found is None:
            rows.append([])
            found = capacity, len(rows) - 1
        rows[found[1]].append(k)
        if found[0] > n:
            tree.add(found[0] - n, found[1])
    return rows


def token_pieces(docs: DataFrame, p: Matrices, path: str = tokens.BYTE_BPE) -> DataFrame:
    """doc_id, piece, start, ids of every text with its end id, cut to ``length`` ids."""
    vocabulary, most = tokens.shipped(docs.sparkSession, path), 2 * p.length
    tail = np.array([p.end_id], "<u2").tobytes()

    def run(batches):
        encode = tokens.loaded(tokens.PartIds, vocabulary.value, "run_parts", "H", True)
        for whole in batches:
            for batch in slices(whole, 2000, "text"):
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
                    ids += tail
                    rows += [(doc, k, at // 2, ids[at:at + most]) for k, at in enumerate(range(0, len(ids), most))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                                                 names=["doc_id", "piece", "start", "ids"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_DDL)


def matrices(docs: DataFrame, p: Matrices | None = None, path: str = tokens.BYTE_BPE) -> DataFrame:
    """share, row, n_tokens, ids, positions, cu_seqlens, doc_ids, pieces, starts of each packed row.

    ``ids`` and ``positions`` hold ``length`` numbers each; what a row has left is filled with the end
    id at position 0.  Segment k of a row is ids[cu_seqlens[k]:cu_seqlens[k + 1]], the tokens of piece
    pieces[k] of document doc_ids[k] from token starts[k] on.  A null or empty text is its end id alone; a null
    doc_id stays null; repeated rows are packed each; special strings in texts are ordinary text.  An
    empty table gives no rows.

    Pieces are dealt to shares by a hash and taken up in its order; a share of more tokens than its texts let
    expect is packed in several goes.  So rows depend on the documents alone, not on partitions or arrival.  The
    number of shares comes from the lengths of the texts, counted in a job while the frame is built.
    """
    p = p or Matrices()
    size = docs.select(F.sum(F.coalesce(F.length("text"), F.lit(0)) + p.chars_a_token).alias("n")).first()["n"] or 0
    shares = max(1, int(size / p.chars_a_token / p.length / p.share_rows) + 1)
    key = F.xxhash64("doc_id", "piece", "ids")
    dealt = token_pieces(docs, p, path).repartition(shares, key).sortWithinPartitions(key, "doc_id", "piece", "start", "ids")
    most = 4 * p.share_rows * p.length

    def packed(held: list[tuple], share: int, first: int):
        held.sort(key=lambda x: (-len(x[3]), x[0] is None, x[0] or 0, x[1]))
        found = best_fit([len(x[3]) // 2 for x in held], p.length)
        for at in range(0, len(found), 256):
            columns: dict[str, list] = {n: [] for n in ROW.names}
            for k, items in enumerate(found[at:at + 256], first + at):
                own = [held[i] for i in items]
                lengths = np.array([len(x[3]) // 2 for x in own])
                edges = np.concatenate(([0], np.cumsum(lengths)))
                n = int(edges[-1])
                ids, positions = np.full(p.length, p.end_id, "<u2"), np.zeros(p.length, "<u2")
                ids[:n] = np.frombuffer(b"".join(x[3] for x in own), "<u2")
                positions[:n] = np.arange(n) - np.repeat(edges[:-1], lengths)
                for name, value in zip(ROW.names, (share, k, n, ids.tobytes(), positions.tobytes(), edges.tolist(),
                                                   [x[0] for x in own], [x[1] for x in own], [x[2] for x in own])):
                    columns[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in ROW], schema=ROW)

    def run(batches):
        from pyspark import TaskContext
        share, held, size, first = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size >= most:
                    for out in packed(held, share, first):
                        first += out.num_rows
                        yield out
                    held, size = [], 0
        if held:
            yield from packed(held, share, first)
    return dealt.mapInArrow(run, ROW_DDL)


def write(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet, whose ``ids`` and ``positions`` are rows of the matrices."""
    rows.write.mode("overwrite").parquet(path)


def digested(rows: DataFrame) -> DataFrame:
    """Packed rows with checksums of the two matrix rows in their place."""
    names = [n for n in ROW.names if n not in ("ids", "positions")]
    return rows.select(*names, F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


@query("op8_token_matrices")
def op8(spark, sf_dir):
    """All documents as rows of 2048 token ids."""
    return digested(matrices(table(spark, sf_dir, "documents")))
