"""Mixing sources to target weights by Pfair scheduling.

A source is cut into blocks of equal size; with weight w its i-th block is released at floor(i / w) and
due at ceil((i + 1) / w), in slots of one block.  Earliest deadline first meets every deadline, so at
any time each source is less than one block from its weight.  Weights are exact fractions, however long
the schedule.  One task goes through all slots with a block of each source in hand and writes the table of
slots, a row a block; places of rows are joined to it by share, before any text.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskledger.llm.common import Workspace, query, table


@dataclass(frozen=True)
class Mixing:
    """Production parameters.

    ``weights``: target share by source; None: shares of the sources' sizes to the power ``smooth``,
    which lifts small sources.  ``block_chars`` is the size of a block.  Up to ``sources`` sources are scheduled, more are an error.  Rows are counted in up to
    ``shares`` shares of a source, of about ``share_rows`` rows of the corpus.  No list holds the uses of more
    than ``part`` blocks in ``part`` epochs.
    """

    weights: tuple | None = None
    smooth: float = 0.7
    block_chars: int = 1 << 16
    sources: int = 200_000
    share_rows: int = 2048
    shares: int = 4096
    part: int = 256


def exact(weights: dict) -> tuple[dict, int]:
    """Weights as integers in exactly their ratio, and their sum."""
    fractions = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(x.denominator for x in fractions.values()))
    parts = {s: int(x * scale) for s, x in fractions.items()}
    common = math.gcd(*parts.values())
    return {s: n // common for s, n in parts.items()}, sum(parts.values()) // max(common, 1)


def window(j: int, parts: int, period: int) -> tuple[int, int]:
    """Release time and deadline of a source's j-th block."""
    return j * period // parts, -(-(j + 1) * period // parts)


def turns(parts: dict, period: int, first: dict | None = None, end: int | None = None) -> Iterator[tuple]:
    """Earliest deadline first: source, number, release and deadline of the block in each slot, without end.

    With ``first`` and ``end``, the first ``first[s]`` blocks of each source are due at ``end`` at the latest.
    The turns stop after the last of them, or with a None if one can't be in time.
    """
    left = sum(first.values()) if first else None
    waiting = [(0, s, 0) for s in parts]
    heapq.heapify(waiting)
    ready, slot = [], 0
    while left is None or left:
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            due = window(j, parts[s], period)[1]
            heapq.heappush(ready, (min(due, end) if first and j < first[s] else due, s, j, release, due))
        by, s, j, release, due = heapq.heappop(ready)
        if by <= slot:
            yield None
            return
        yield s, j, release, due
        left = left - (j < first[s]) if first else None
        heapq.heappush(waiting, (window(j + 1, parts[s], period)[0], s, j + 1))
        slot += 1


def horizon(parts: dict, period: int, first: dict) -> int:
    """A slot by which the first ``first[s]`` blocks of each source can be given within their windows.

    It is tried from the least slot that the releases allow, in growing steps, so a source with a small
    weight makes the schedule longer only where the weights leave no earlier slot to it.
    """
    windows = [window(n - 1, parts[s], period) for s, n in first.items()]
    least, most = max(r for r, _ in windows) + 1, max(d for _, d in windows)
    step, end = len(parts), least
    while end < most and any(turn is None for turn in turns(parts, period, first, end)):
        end, step = least + step, 2 * step
    return min(end, most)


TURNS = pa.schema([("_key", pa.string()), ("_block", pa.int64()), ("_epoch", pa.int64()), ("_slot", pa.int64()),
                   ("_release", pa.int64()), ("_deadline", pa.int64())])


def weights_of(totals: dict, p: Mixing) -> dict:
    """Target weights, not scaled, of the sources with these numbers of characters."""
    if p.weights is None:
        return {k: n ** p.smooth for k, n in totals.items()}
    return {k: float(w) for s, w in p.weights if (k := "" if s is None else f"s{s}") in totals}


def _slots(p: Mixing):
    """The whole schedule, from one partition of (_key, _total)."""
    def run(batches):
        totals = {}
        for batch in batches:
            totals.update(zip(batch.column("_key").to_pylist(), batch.column("_total").to_pylist()))
            if len(totals) > p.sources:
                raise ValueError(f"more than {p.sources} sources to mix")
        parts, period = exact(weights_of(totals, p))
        if not parts:
            return
        blocks = {k: (totals[k] - 1) // p.block_chars + 1 for k in parts}
        held = []
        for slot, (k, j, release, due) in enumerate(turns(parts, period, blocks, horizon(parts, period, blocks))):
            held.append((k, j % blocks[k], j // blocks[k], slot, release, due))
            if len(held) == 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), TURNS)], schema=TURNS)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), TURNS)], schema=TURNS)
    return run


def _rows(docs: DataFrame, p: Mixing) -> DataFrame:
    """Every use of every row: ``_row``, ``_id``, ``_start`` (characters before it in its source), ``_block``, ``_epoch``, ``_slot``, ``_release``, ``_deadline``."""
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_key"),
                       (F.coalesce(F.length("text"), F.lit(0)) + 1).cast("long").alias("_size"),
                       F.xxhash64("doc_id", F.lit(7)).alias("_h"), F.xxhash64("text").alias("_t"))
    sized = rows.select("_key", "_size", "_h")
    shares = max(1, min(p.shares, -(-sized.count() // p.share_rows)))
    share = F.pmod(F.xxhash64("_h", "_t"), F.lit(shares))
    sums = rows.select("_key", "_size", share.alias("_share")).groupBy("_key", "_share").agg(F.sum("_size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_share")) - F.col("_sum"))
    sums = work.keep(sums, "shares")
    slots = sums.groupBy("_key").agg(F.sum("_sum").alias("_total")).repartition(1).mapInArrow(
        _slots(p), "_key string, _block long, _epoch long, _slot long, _release long, _deadline long")
    slots = work.keep(slots, "slots")
    place = lambda c: F.floor(c / p.block_chars)
    blocks = sums.select("_key", "_share", "_before", F.explode(
        F.sequence(place(F.col("_before")), place(F.col("_before") + F.col("_sum") - 1))).alias("_block"))
    # a block of a small source can be used in every few slots: its uses come in parts, rows meet the parts in a join
    parts = slots.withColumn("_epoch_part", F.floor(F.col("_epoch") / p.part))
    last = parts.groupBy("_key").agg(F.max("_epoch_part").alias("_last"))
    listed = parts.groupBy("_key", "_block", "_epoch_part").agg(
        F.collect_list(F.struct("_epoch", "_slot", "_release", "_deadline")).alias("_uses"))
    blocks = blocks.join(last, "_key").withColumn("_epoch_part", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    uses = blocks.join(listed, ["_key", "_block", "_epoch_part"])
    uses = uses.groupBy("_key", "_share", "_before", F.floor(F.col("_block") / p.part).alias("_block_part"), "_epoch_part").agg(
        F.collect_list(F.struct("_block", "_uses")).alias("_blocks"))
    uses = work.keep(uses, "uses")
    inside = F.sum("_size").over(Window.partitionBy("_key", "_share").orderBy("_h", "_id", "_t", "_size")
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    placed = rows.withColumn("_share", share).withColumn("_inside", inside).alias("r")
    start = F.col("_inside") + F.col("_before")
    here = (start >= F.col("_block_part") * p.part * p.block_chars) & (start < (F.col("_block_part") + 1) * p.part * p.block_chars)
    on = (F.col("r._key") == F.col("u._key")) & (F.col("r._share") == F.col("u._share")) & here
    placed = placed.join(uses.alias("u"), on).select("_row", "_id", start.alias("_start"), "_blocks")
    mine = F.get(F.filter("_blocks", lambda b: b["_block"] == place(F.col("_start"))), F.lit(0))
    placed = placed.select("_row", "_id", "_start", mine.alias("_mine"))
    return placed.select("_row", "_id", "_start", F.col("_mine._block").alias("_block"), F.inline("_mine._uses"))


def schedule_of(docs: DataFrame, p: Mixing | None = None) -> DataFrame:
    """doc_id, source, epoch, block, slot, release, deadline, start for every use of every row.

    The schedule runs until each source with a weight has given all its rows once; a source that is
    done earlier begins again in its next epoch, so nothing is lost and the weights hold throughout.
    Rows without a source are a source of their own; sources without a weight are not used.  A null
    text counts as empty, and every row as one character more than its text.  The order inside a source
    comes from a hash of doc_id.  An empty table gives no rows.
    """
    p = p or Mixing()
    return _rows(docs.select("doc_id", "source", "text"), p).select(
        "_row.doc_id", "_row.source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_slot").alias("slot"),
        F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_start").alias("start"))


def mixed(docs: DataFrame, p: Mixing | None = None) -> DataFrame:
    """The rows of ``docs`` in the order of the schedule, as often as it uses them; all columns are kept."""
    ordered = _rows(docs, p or Mixing()).select("_row", "_slot", "_start", "_id")
    return ordered.repartitionByRange("_slot", "_start", "_id").sortWithinPartitions("_slot", "_start", "_id").select("_row.*")


@query("op4_source_mixing")
def op4(spark, sf_dir):
    """Slots of all documents, sources mixed to smoothed shares of their sizes."""
    return schedule_of(table(spark, sf_dir, "documents"))
