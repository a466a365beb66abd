"""Exact token counts at every prefix of a text, for a sentencepiece BPE model.

No piece of such a model holds a word mark after another character, and no piece holds a line feed, so
a text falls into parts that are encoded independently: a run of word marks with what follows up to
the next mark or line feed.  For each distinct part, dynamic programming over its prefixes finds the
last token and the token count of every prefix: the last token of a prefix is the longest piece that
ends there and that, next to the last token of what stands before it, stays as it is when both are
encoded together.  Counts of a whole text or of any prefix are sums over the parts, so truncation and
budget questions need no further encoding.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import tokens
from riskledger.llm.common import batch_of, query, slices, table

MARK = "▁"
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


class PrefixCounts:
    """Token counts of all prefixes of parts, kept for up to ``MOST`` distinct parts."""

    MOST, LONG = 400_000, 100

    def __init__(self, data: bytes):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not special[i]}
        if any(a != MARK and b == MARK for piece in self.score for a, b in zip(piece, piece[1:])) or any("\n" in x for x in self.score):
            raise ValueError("this model's pieces cross words; its texts can't be cut")
        import ahocorasick
        self.adjacent = {piece[i:i + 2] for piece in self.score for i in range(len(piece) - 1)}
        self.ending = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1 and self._encoded(piece) == [piece]:
                self.ending.add_word(piece, piece)
        self.ending.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes | tuple] = {}
        self.total: dict[str, int] = {}

    def _encoded(self, text: str) -> list[str]:
        """Merge the adjacent pair of best score, the leftmost first, until none is a piece."""
        symbols, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return symbols
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]

    def _beside(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._encoded(a + b) == [a, b]
        return found

    def prefixes(self, part: str) -> bytes | tuple:
        """Counts of the part's prefixes of 0, 1, ... characters."""
        found = self.known.get(part)
        if found is not None:
            return found
        count = [0]
        for sub in self._cut(part):
            count.extend(map(count[-1].__add__, self._walk(sub)))
        out = bytes(count) if count[-1] < 256 else tuple(count)
        if len(part) <= self.LONG and len(self.known) < self.MOST:
            self.known[part] = out
        return out

    def _cut(self, part: str) -> list[str]:
        """Cut between characters that are neighbours in no piece."""
        adjacent, out, at = self.adjacent, [], 0
        for i in range(1, len(part)):
            if part[i - 1:i + 1] not in adjacent:
                out.append(part[at:i])
                at = i
        out.append(part[at:])
        return out

    def _walk(self, part: str) -> list[int]:
        """The dynamic programme: counts of the prefixes of 1, 2, ... characters."""
        score, pairs = self.score, self.pairs
        last, count, done = [""], [0], 0
        for end, piece in self.ending.iter(part):
            while done < end:
                last.append(part[done])
                count.append(count[done] + (1 if part[done] in score else len(part[done].encode())))
                done += 1
            if done > end:
                continue
            j = end + 1 - len(piece)
            if j:
                ok = pairs.get((last[j], piece))
                if ok is None:
                    ok = self._beside(last[j], piece)
                if not ok:
                    continue
            last.append(piece)
            count.append(count[j] + 1)
            done += 1
        for c in part[done:]:
            count.append(count[-1] + (1 if c in score else len(c.encode())))
        return count[1:]

    def _tokens(self, word: str) -> int:
        """Tokens of a word between spaces; a leading line feed stands for the space before it."""
        if word[:1] == "\n":
            return 1 + (self.prefixes(word[1:])[-1] if len(word) > 1 else 0)
        return sum(self.prefixes(sub)[-1] for sub in self._cut(MARK + word))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts."""
        words = [self._words(t) for t in texts]
        total = self.total
        fresh = list(set().union(*(w for w in words if w is not None)).difference(total))
        for word in fresh:
            total[word] = self._tokens(word)
        out = [sum(1 if x == "\n" else self.prefixes(x)[-1] for x in self.parts(t)) if w is None else sum(map(total.__getitem__, w))
               for t, w in zip(texts, words)]
        for word in fresh:
            if len(word) > self.LONG:
                del total[word]
        while len(total) > self.MOST:
            total.popitem()
        return out

    @staticmethod
    def _words(text: str) -> list[str] | None:
        """The words between single spaces, or None for texts with empty words or word marks."""
        if not text:
            return []
        words = text.replace("\n", " \n").split(" ")
        return None if MARK in text or "" in words else words

    def parts(self, text: str) -> list[str]:
        """The independent parts of a text; a line feed is one of its own, of one byte token."""
        if not text:
            return []
        out: list[str] = []
        for k, line in enumerate((MARK + text.replace(" ", MARK)).split("\n")):
            if k:
                out.append("\n")
            at = 0
            while at < len(line):
                end = at
                while end < len(line) and line[end] == MARK:
                    end += 1
                stop = line.find(MARK, end)
                stop = len(line) if stop < 0 else stop
                out.append(line[at:stop])
                at = stop
        return out

    def table(self, text: str) -> tuple[list[int], list[int], list[str]]:
        """(characters before each part, tokens before each part, parts); the first mark is no character."""
        parts = self.parts(text)
        tokens_before = list(accumulate((1 if x == "\n" else self.prefixes(x)[-1] for x in parts), initial=0))
        chars = list(accumulate(map(len, parts), initial=-1))
        return [max(0, c) for c in chars], tokens_before, parts

    def at_prefix(self, text: str, chars: int) -> int:
        """Tokens of the prefix of ``chars`` characters, from the table of the whole text."""
        if chars <= 0:
            return 0
        starts, before, parts = self.table(text)
        chars = min(chars, starts[-1])
        k = min(bisect_right(starts, chars - 1), len(parts)) - 1
        inside = chars - starts[k] + (k == 0)
        return before[k] + (1 if parts[k] == "\n" else self.prefixes(parts[k])[inside])

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        if not text or budget <= 0:
            return 0
        starts, before, parts = self.table(text)
        if before[-1] <= budget:
            return starts[-1]
        for k in range(len(parts) - 1, -1, -1):
            if before[k] > budget:
                continue
            counts = (0, 1) if parts[k] == "\n" else self.prefixes(parts[k])
            inside = max((i for i in range(len(counts)) if before[k] + counts[i] <= budget), default=0)
            if inside or before[k] <= budget:
                return max(0, starts[k] + inside - (k == 0))
        return 0


def token_counts(docs: DataFrame, path: str = tokens.PIECE_BPE, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, a row for a row.

    A null or empty text has 0 bytes and 0 tokens.  Strings like ``<s>`` are ordinary text.  A null
    doc_id stays null and repeated rows are counted each; other columns are not read.
    """
    vocabulary = tokens.shipped(docs.sparkSession, path)

    def run(batches):
        counts = tokens.loaded(PrefixCounts, vocabulary.value)
        for whole in batches:
            for batch in slices(whole, 2000, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield batch_of(COUNTS, doc_id=batch.column("doc_id"), n_bytes=[len(t.encode()) for t in texts],
                               n_tokens=counts.counts(texts))
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def truncated(docs: DataFrame, budget: int, path: str = tokens.PIECE_BPE) -> DataFrame:
    """All columns of ``docs`` with each text cut to its longest prefix of at most ``budget`` tokens."""
    vocabulary = tokens.shipped(docs.sparkSession, path)
    at = docs.columns.index("text")

    def run(batches):
        counts = tokens.loaded(PrefixCounts, vocabulary.value)
        for whole in batches:
            for batch in slices(whole, 2000, "text"):
                cut = [t if t is None else t[:counts.fit(t, budget)] for t in batch.column("text").to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))
    return docs.mapInArrow(run, docs.schema)


@query("op5_token_counts")
def op5(spark, sf_dir):
    """Exact token counts of all whole texts."""
    return token_counts(table(spark, sf_dir, "documents"))
