"""Encoding and decoding with a sentencepiece BPE model in vectorised merge rounds.

All words of a batch lie one behind the other in flat arrays: the symbol at each place, the word it
belongs to and the rank of the pair it begins.  One round takes the smallest rank of every word (a
segmented minimum), merges all its leftmost non-overlapping occurrences in all words at once, looks up
the pairs that changed and drops the words in which no pair is left.  Words come apart where two
neighbours stand side by side in no piece, also in later rounds, so a long run without a blank costs
few rounds.  A merge whose result can be part of a piece of better rank is done one at a time.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import tokens
from riskledger.llm.common import query, slices, table

MARK = "▁"
NONE, APART = np.int32(2**31 - 2), np.int32(2**31 - 1)
#: Texts on which a model must agree with its library before its tables are used.
PROBES = ["", " ", "a", "  two  words ", "x\ny\t<s>", "　Ａﬁ é ₂", "🙂中<0x0A>", "▁ ▁▁a▁", "aaaaaaa  1234567"]

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def spell(ids: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings ``data[begin[i]:begin[i] + size[i]]`` of all ids one after the other, and where each ends."""
    sizes = size[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(begin[ids] - (ends - sizes), sizes) + np.arange(total)], ends


def spelled(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(s) for s in strings], np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size


@dataclass
class Merges:
    """Pairs of symbols in order of their key: rank of the merge (NONE: side by side in a longer piece only) and result."""

    size: int
    key: np.ndarray
    rank: np.ndarray
    result: np.ndarray
    one_by_one: np.ndarray

    @classmethod
    def of(cls, ids: dict[str, int], score: dict[str, float], size: int) -> "Merges":
        order = sorted(set(score.values()), reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        pairs: dict[int, tuple[int, int]] = {}
        for piece, merged in ids.items():
            n = len(piece)
            here = [[ids.get(piece[i:j]) for j in range(i + 1, n + 1)] for i in range(n)]
            for i in range(n - 1):
                for j in range(i + 1, n):
                    a = here[i][j - i - 1]
                    if a is None:
                        continue
                    for k in range(j + 1, n + 1):
                        b = here[j][k - j - 1]
                        if b is None:
                            continue
                        if i == 0 and k == n:
                            pairs[a * size + b] = (rank_of[score[piece]], merged)
                        else:
                            pairs.setdefault(a * size + b, (int(NONE), -1))
        key = np.fromiter(pairs, np.int64, len(pairs))
        value = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        at = np.argsort(key)
        key, rank, result = key[at], value[at, 0], value[at, 1]
        merges = rank < NONE
        first = np.full(size, NONE, np.int32)
        for side in (key // size, key % size):
            np.minimum.at(first, side[merges], rank[merges])
        seen: dict[int, int] = {}
        one_by_one = np.zeros(len(order) + 1, bool)
        for r, out in zip(rank[merges].tolist(), result[merges].tolist()):
            one_by_one[r] |= first[out] < r or seen.setdefault(r, out) != out
        return cls(size, key, rank, result, one_by_one)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of pairs; APART if no piece holds them side by side.  A symbol of -1 is in no piece."""
        if not len(self.key):
            return np.full(len(left), APART, np.int32), np.full(len(left), -1, np.int32)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        there = (self.key[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(there, self.rank[at], APART), np.where(there, self.result[at], -1)

    def rounds(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no pair is left: symbols and the place of the first character of each.

        ``begins`` marks the first symbol of each word; words may come apart on the way.
        """
        symbols, place, begins = symbols.copy(), np.arange(len(symbols)), begins.copy()
        out_symbols, out_places = [], []
        n = len(symbols)
        rank, result = np.full(n, NONE, np.int32), np.full(n, -1, np.int32)
        changed = np.arange(n - 1)
        while len(symbols):
            n = len(symbols)
            rank[changed], result[changed] = self.find(symbols[changed], symbols[changed + 1])
            apart = changed[rank[changed] == APART]
            begins[apart + 1] = True
            rank[np.append(np.flatnonzero(begins)[1:] - 1, n - 1)] = NONE
            starts = np.flatnonzero(begins)
            sizes = np.diff(np.append(starts, n))
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                done = np.repeat(done, sizes)
                out_symbols.append(symbols[done])
                out_places.append(place[done])
                live = ~done
                symbols, place, begins, rank, result = symbols[live], place[live], begins[live], rank[live], result[live]
                if not len(symbols):
                    break
                n = len(symbols)
                starts = np.flatnonzero(begins)
                sizes = np.diff(np.append(starts, n))
                least = least[least < NONE]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            word = np.searchsorted(starts, at, side="right") - 1
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (word[1:] != word[:-1])])
            run_start = np.flatnonzero(run)
            offset = np.arange(len(at)) - np.repeat(run_start, np.diff(np.append(run_start, len(at))))
            first = np.concatenate([[True], word[1:] != word[:-1]])
            at = at[np.where(self.one_by_one[least[word]], first, offset % 2 == 0)]
            symbols[at] = result[at]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, place, begins, rank, result = symbols[keep], place[keep], begins[keep], rank[keep], result[keep]
            at = moved[at]
            left = at[~begins[at]] - 1
            right = at[at + 1 < len(symbols)]
            right = right[~begins[right + 1]]
            rank[at] = NONE
            changed = np.unique(np.concatenate([left, right]))
        if not out_symbols:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        places = np.concatenate(out_places)
        order = np.argsort(places, kind="stable")
        return np.concatenate(out_symbols)[order], places[order]


class PieceCodec:
    """A model's tables, with the ids of up to ``MOST`` short words kept.

    The model must be BPE with byte fallback and a dummy prefix, without normalisation and without
    pieces that the user defined; ``PROBES`` are compared with the library when it is loaded.
    """

    MOST, LONG = 400_000, 100

    def __init__(self, data: bytes):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        kind = ["control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else
                "unused" if model.is_unused(i) else "normal" for i in range(n)]
        self.size, self.end = n, model.eos_id()
        ids = {p: i for i, p in enumerate(pieces) if kind[i] == "normal"}
        self.bytes = np.full(256, -1, np.int32)
        for i, p in enumerate(pieces):
            if kind[i] == "byte":
                self.bytes[int(p[3:-1], 16)] = i
        self.merges = Merges.of(ids, {p: model.get_score(i) for p, i in ids.items()}, n)
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.points, self.point_ids = (np.array(x, np.int32) for x in zip(*single))
        crossing = any(a != MARK and b == MARK for p in ids for a, b in zip(p, p[1:])) or any("\n" in p for p in ids)
        self.words = (lambda s: [s]) if crossing else re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+").findall
        text = {"control": lambda p: b"", "unknown": lambda p: " ⁇ ".encode(), "byte": lambda p: bytes([int(p[3:-1], 16)]),
                "normal": lambda p: p.replace(MARK, " ").encode(), "unused": lambda p: p.replace(MARK, " ").encode()}
        self.text = spelled([text[k](p) for k, p in zip(kind, pieces)])
        self.marked = np.array([k == "normal" and p.startswith(MARK) for k, p in zip(kind, pieces)])
        self.known: dict[str, bytes] = {}
        for probe, got in zip(PROBES, self.encode(PROBES)):
            if got.tolist() != model.encode(probe) or self.decode([got])[0] != model.decode(got.tolist()):
                raise ValueError("this model needs more than its pair merges")

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, all merged together in rounds."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.point_ids[at], -1).astype(np.int32)
        begins = np.zeros(len(points), bool)
        starts = np.cumsum(sizes) - sizes
        begins[starts[sizes > 0]] = True
        symbols, places = self.merges.rounds(symbols, begins)
        odd = np.flatnonzero(symbols < 0)
        if len(odd):
            odd_points, which = np.unique(points[places[odd]], return_inverse=True)
            table = [self.bytes[np.frombuffer(chr(c).encode(), np.uint8)] for c in odd_points.tolist()]
            table = [ids if (ids >= 0).all() else np.array([0], np.int32) for ids in table]
            size = np.ones(len(symbols), np.int64)
            size[odd] = np.array([len(t) for t in table])[which]
            symbols, places = np.repeat(symbols, size), np.repeat(places, size)
            symbols[symbols < 0] = np.concatenate([table[k] for k in which])
        cut = np.searchsorted(places, np.append(starts, len(points)))
        return [symbols[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, without begin or end."""
        known = self.known
        cut = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = list(set().union(*cut).difference(known))
        for word, ids in zip(fresh, self.merged(fresh)):
            known[word] = ids.tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]
        for word in fresh:
            if len(word) > self.LONG:
                del known[word]
        while len(known) > self.MOST:
            known.popitem()
        return out

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The texts of id lists: one byte after the other, ill-formed bytes replaced one by one."""
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id outside the vocabulary")
        data, ends = spell(ids, *self.text)
        sizes = np.array([len(r) for r in rows], np.int64)
        last = np.cumsum(sizes)
        ends = np.concatenate([[0], ends])
        begin, end = ends[last - sizes], ends[last]
        visible = np.flatnonzero(self.text[2][ids] > 0)
        first = np.searchsorted(visible, last - sizes)
        there = first < len(visible)
        at = visible[np.minimum(first, len(visible) - 1)] if len(visible) else np.zeros(len(rows), np.int64)
        strip = np.zeros(len(rows), bool)
        strip[there] = (at[there] < last[there]) & self.marked[ids[at[there]]]
        # An id without text ends a run of byte tokens, so characters don't form across it.
        gaps = ends[1:][self.text[2][ids] == 0]
        begin = begin + strip
        low, high = np.searchsorted(gaps, begin, side="right"), np.searchsorted(gaps, end)
        whole = data.tobytes()
        return ["".join(whole[x:y].decode("utf-8", "each_byte") for x, y in pairwise([a, *gaps[i:j].tolist(), b]))
                for a, b, i, j in zip(begin.tolist(), end.tolist(), low.tolist(), high.tolist())]


def encoded(docs: DataFrame, path: str = tokens.PIECE_BPE, end: bool = True) -> DataFrame:
    """doc_id and the ids of every whole text, a row for a row, as the library gives them.

    A null text counts as empty: no ids but the end id.  Strings like ``<s>`` are ordinary text.  A null
    doc_id stays null, repeated rows are encoded each, other columns are not read.
    """
    vocabulary = tokens.shipped(docs.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        codec = tokens.loaded(PieceCodec, vocabulary.value)
        close = np.array([codec.end] if end else [], np.int32)
        for whole in batches:
            for batch in slices(whole, 2000, "text"):
                rows = [np.concatenate([ids, close]) for ids in codec.encode([t or "" for t in batch.column("text").to_pylist()])]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.cast(pa.list_(pa.int32()))], schema=schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str = tokens.PIECE_BPE) -> DataFrame:
    """The rows of ``encoded`` with the text of their ids as ``text``; null ids give a null text."""
    vocabulary = tokens.shipped(rows.sparkSession, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        codec = tokens.loaded(PieceCodec, vocabulary.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = batch.column("ids")
                lists = [np.zeros(0, np.int32) if not x.is_valid else x.values.to_numpy() for x in ids]
                text = pa.array(codec.decode(lists), pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, text], schema=schema)
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


@query("op11_piece_codec")
def op11(spark, sf_dir):
    """Ids with an end id of all whole texts, and the texts decoded from them, as digests."""
    rows = decoded(encoded(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))
