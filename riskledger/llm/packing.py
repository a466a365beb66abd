"""Best-fit packing of token sequences by linear grouping.

Documents become pieces of at most ``capacity`` tokens.  Everything that must be decided together is
decided on the histogram of piece lengths, which has at most ``capacity`` entries however many
documents there are: large lengths are sorted and cut into groups of equal cardinality, each group
counts as its longest length, a small linear programme over the groups picks bin configurations, the
configurations are filled with the real lengths, and small lengths go into the remaining room best
fit first.  The result is a table of rules (length, ranks) -> (sequence, offset); a piece finds its
place from its length and its rank among pieces of that length, which is counted in parallel.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskledger.llm import tokens
from riskledger.llm.common import Workspace, batch_of, query, slices, table


@dataclass(frozen=True)
class Packing:
    """Production parameters: lengths over ``capacity // large`` are large; the best of several numbers
    of groups is taken.  Pieces of a length are ranked in up to ``shares`` shares, of about ``share_rows``
    rows of the corpus."""

    capacity: int = 4096
    end_id: int = 1
    large: int = 6
    groups: tuple[int, ...] = (6, 10, 16, 24, 32)
    share_rows: int = 2048
    shares: int = 4096


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, p: Packing, path: str = tokens.WORD_BPE, with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: ids, then ``end_id``; a null text has no ids of its own."""
    vocabulary = tokens.shipped(docs.sparkSession, path)
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES
    most, tail = 4 * p.capacity, np.array([p.end_id], "<u4").tobytes()

    def run(batches):
        encode = tokens.loaded(tokens.PartIds, vocabulary.value, "word_parts")
        for whole in batches:
            for batch in slices(whole, 2000, "text"):
                rows: list[tuple] = []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), most)):
                        own = ids[at:at + most]
                        rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), own))
                columns = dict(zip(["doc_id", "piece", "start", "length", "ids_crc32", "ids"], zip(*rows)))
                yield batch_of(schema, **columns)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DDL + (", ids binary" if with_ids else ""))


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items of each size, times) covering ``demand`` with nearly as few bins as possible.

    Column generation: a basis of configurations, prices from it, the most valuable configuration by
    a knapsack over the capacity, one more item a round; then whole parts, and the small remainder best
    fit decreasing.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // int(sizes.min())):
            more, pick = best.copy(), np.full(capacity + 1, -1)
            for g, n in enumerate(sizes):
                value = best[:-n] + price[g]
                gain = value > more[n:] + 1e-12
                more[n:][gain] = value[gain]
                pick[n:][gain] = g
            best = more
            picks.append(pick)
        if best[capacity] <= 1 + 1e-6:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            g = pick[room]
            if g >= 0:
                column[g] += 1
                room -= int(sizes[g])
        amount, step = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amount = np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)
    times = np.floor(amount + 1e-9).astype(np.int64)
    chosen = [(basis[:, j].astype(np.int64), int(times[j])) for j in range(k) if times[j]]
    left = demand - sum((c * t for c, t in chosen), np.zeros(k, np.int64))
    bins: list[list] = []
    for g in np.argsort(-sizes, kind="stable"):
        for _ in range(max(0, int(left[g]))):
            room = [b for b in bins if b[0] >= sizes[g]]
            b = min(room, key=lambda b: b[0]) if room else [capacity, np.zeros(k, np.int64)]
            if not room:
                bins.append(b)
            b[0] -= int(sizes[g])
            b[1][g] += 1
    return chosen + [(b[1], 1) for b in bins]


class _Rules:
    """Rules in the making: pieces of a length, by rank, go to consecutive sequences."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.rank, self.rows = dict(counts), dict.fromkeys(counts, 0), []

    def put(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], count, each, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count


def plan(counts: dict[int, int], p: Packing) -> tuple[np.ndarray, int]:
    """Rules (length, first rank, count, pieces a sequence, first sequence, offset) and the sequences used.

    ``counts``: how many pieces have each length.  Work and result depend on the capacity alone.
    """
    return min((_plan(counts, p, groups) for groups in p.groups), key=lambda found: found[1])


def _plan(counts: dict[int, int], p: Packing, groups: int) -> tuple[np.ndarray, int]:
    rules, made = _Rules(counts), 0
    runs: list[tuple[int, int, int]] = []
    if counts.get(p.capacity):
        rules.put(p.capacity, counts[p.capacity], 1, 0, 0)
        made = counts[p.capacity]
    large = sorted((n for n in counts if p.capacity // p.large < n < p.capacity), reverse=True)
    total = sum(counts[n] for n in large)
    if total:
        queues, size = _groups(large, counts, -(-total // groups))
        demand = np.array([sum(c for _, c in q) for q in queues])
        for items, times in _configurations(np.array(size), demand, p.capacity):
            made = _fill(rules, runs, queues, items, times, made, p.capacity)
    made = _best_fit(rules, runs, sorted((n for n in counts if n <= p.capacity // p.large), reverse=True), made, p.capacity)
    return np.array(rules.rows, np.int64).reshape(-1, 6), made


def _groups(large: list[int], counts: dict[int, int], each: int) -> tuple[list, list[int]]:
    """Cut the lengths, longest first, into groups of ``each`` pieces; a group's size is its longest."""
    queues, size, room = [], [], 0
    for n in large:
        left = counts[n]
        while left:
            if not room:
                queues.append([])
                size.append(n)
                room = each
            took = min(left, room)
            queues[-1].append([n, took])
            left, room = left - took, room - took
    merged: dict[int, list] = {}
    for q, s in zip(queues, size):
        merged.setdefault(s, []).extend(q)
    return list(merged.values()), list(merged)


def _fill(rules: _Rules, runs: list, queues: list, items: np.ndarray, times: int, made: int, capacity: int) -> int:
    """Put real lengths into ``times`` bins of one configuration; equal bins in a row are one run."""
    slots = []
    for g in np.flatnonzero(items):
        for _ in range(int(items[g])):
            need, row = times, []
            while need and queues[g]:
                n, have = queues[g][0]
                took = min(need, have)
                row.append([n, took])
                need -= took
                queues[g][0][1] -= took
                if not queues[g][0][1]:
                    queues[g].pop(0)
            if row:
                slots.append(row)
    at = 0
    while slots:
        step, used = min(s[0][1] for s in slots), 0
        for s in slots:
            rules.put(s[0][0], step, 1, made + at, used)
            used += s[0][0]
            s[0][1] -= step
            if not s[0][1]:
                s.pop(0)
        runs.append((capacity - used, made + at, step))
        slots = [s for s in slots if s]
        at += step
    return made + at


def _best_fit(rules: _Rules, runs: list, small: list[int], made: int, capacity: int) -> int:
    """Small lengths, longest first, into the least room that holds them; ``runs``: (room, sequence, count)."""
    by_room: dict[int, list] = {}
    for room, sequence, count in runs:
        by_room.setdefault(room, []).append((sequence, count))
    for n in small:
        rooms = [r for r in by_room if r >= n]
        heapq.heapify(rooms)
        while rules.left[n]:
            left = rules.left[n]
            if not rooms:
                each = capacity // n
                count = -(-left // each)
                by_room.setdefault(capacity, []).append((made, count))
                rooms, made = [capacity], made + count
            room = rooms[0]
            sequence, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                heapq.heappop(rooms)
            each = room // n
            whole = min(count, left // each)
            if whole:
                rules.put(n, whole * each, each, sequence, capacity - room)
                by_room.setdefault(room - each * n, []).append((sequence, whole))
            if whole < count:
                rest = left - whole * each
                if 0 < rest < each:
                    rules.put(n, rest, rest, sequence + whole, capacity - room)
                    by_room.setdefault(room - rest * n, []).append((sequence + whole, 1))
                    whole += 1
                if whole < count:
                    by_room.setdefault(room, []).append((sequence + whole, count - whole))
    return made


def place(found: DataFrame, rules: np.ndarray, p: Packing) -> DataFrame:
    """Add sequence_id and offset to pieces that have ``rank``: a binary search in the rules."""
    order = np.lexsort((rules[:, 1], rules[:, 0]))
    sent = found.sparkSession.sparkContext.broadcast(rules[order])

    def run(batches):
        r = sent.value
        key = (r[:, 0] << 44) + r[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            k = rank - r[at, 1]
            sequence, offset = r[at, 4] + k // r[at, 3], r[at, 5] + k % r[at, 3] * length
            columns = [batch.column(n) for n in PIECES.names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*PIECES.names, "sequence_id", "offset"])
    return found.select(*PIECES.names, "rank").mapInArrow(run, DDL + ", sequence_id long, offset long")


def ranked(found: DataFrame, rows: int, p: Packing) -> DataFrame:
    """Exact ranks of pieces among those of equal length, without one task for a common length.

    Pieces are dealt to shares by a hash; shares of a length are counted, their offsets are sums over
    that small table, and ranks inside a share are added to them.
    """
    shares = max(1, min(p.shares, -(-rows // p.share_rows)))
    found = found.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    sums = found.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")
    sums = sums.select("length", "share", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32"))
    return found.withColumn("inside", inside).join(sums, ["length", "share"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def pack(docs: DataFrame, p: Packing | None = None, path: str = tokens.WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Each row of ``docs`` is packed once, so repeated rows are packed as often as they occur.  A null or
    empty text is one piece of the end id; a null doc_id stays null.  Ties are ordered by doc_id, piece
    and checksum.  An empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
    """
    p = p or Packing()
    work = Workspace(docs.sparkSession)
    found = work.keep(pieces(docs, p, path), "pieces")
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rules, _ = plan(counts, p)
    return place(ranked(found, sum(counts.values()), p), rules, p)


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    """All documents in as few sequences of at most 4096 tokens as the method finds."""
    return pack(table(spark, sf_dir, "documents"))
