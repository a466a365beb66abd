"""Language identification: known words first, then progressively shorter character n-grams.

The model is counted from labelled texts: how often each language uses each of its frequent words, and
each character n-gram inside its words.  A word of a text scores the log frequency it has in each
language; a word no language knows is scored by its longest n-grams that any language knows, then by
shorter ones.  A text goes to the language of the highest sum.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskledger.llm import tokens
from riskledger.llm.common import batch_of, query, slices, table

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageId:
    """Production parameters.

    The classifier is fitted on a bounded sample of labelled rows: about ``train_rows`` documents of
    each language, those of the smallest hashes of doc_id.  ``words`` and ``grams`` bound the model:
    so many words, and n-grams of each size, over all languages.  ``evidence``: a longer text counts as
    so many independent words in the score, because its words are not independent.
    """

    train_rows: int = 2000
    words: int = 100_000
    grams: int = 20_000
    longest: int = 4
    smoothing: float = 0.5
    evidence: float = 20.0


def grams_of(word: str, size: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i:i + size] for i in range(len(marked) - size + 1)]


def training_rows(docs: DataFrame, p: LanguageId) -> DataFrame:
    """Labelled rows of the bounded sample; rows whose crc32(doc_id) mod 4 is 2 are held out."""
    named = docs.where("lang is not null and doc_id is not null").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2)
    sizes = named.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(p.train_rows)) / F.col("n"))
    place = (F.xxhash64("doc_id").cast("double") / F.lit(2.0 ** 64)) + 0.5
    return named.join(F.broadcast(sizes), "lang").where(place <= share).select("lang", "text")


def counted(rows: DataFrame, p: LanguageId) -> DataFrame:
    """(size, unit, lang, n): words under size 0, n-grams inside words under their size."""
    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1000, "text"):
                words: Counter = Counter()
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                    words.update((lang, w) for w in WORD.findall((text or "").lower()))
                found: Counter = Counter()
                for (lang, word), n in words.items():
                    if len(word) <= tokens.PartIds.LONG:
                        found[0, word, lang] += n
                    for size in range(1, p.longest + 1):
                        for g in grams_of(word, size):
                            found[size, g, lang] += n
                keys = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
                                                  pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
                                                 names=["size", "unit", "lang", "n"])
    counts = rows.mapInArrow(run, "size int, unit string, lang string, n long")
    return counts.groupBy("size", "unit", "lang").agg(F.sum("n").alias("n"))


class Model:
    """Units of each size with a row of log frequencies by language."""

    def __init__(self, sizes: np.ndarray, units: list[str], langs: list[str], counts: np.ndarray, totals: dict, p: LanguageId):
        """Counts of units by language, column by column; ``totals``: all counts of (size, language)."""
        self.p, self.langs = p, sorted({lang for _, lang in totals})
        at = {lang: i for i, lang in enumerate(self.langs)}
        column = np.array([at[lang] for lang in langs], np.int64)
        self.units: list[dict[str, int]] = []
        self.logs: list[np.ndarray] = []
        for size in range(p.longest + 1):
            rows = np.flatnonzero(np.asarray(sizes) == size)
            known: dict[str, int] = {}
            place = np.array([known.setdefault(units[r], len(known)) for r in rows], np.int64)
            found = np.zeros((len(known), len(self.langs)))
            np.add.at(found, (place, column[rows]), np.asarray(counts)[rows])
            total = np.array([totals.get((size, lang), 0) for lang in self.langs], float)
            self.units.append(known)
            self.logs.append(np.log((found + p.smoothing) / (total + p.smoothing * (len(known) + 1))).astype(np.float32))

    def words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: its own, or the mean over its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known = self.units[0]
        place = np.array([known.get(w, -1) for w in words], np.int64)
        own = np.flatnonzero(place >= 0)
        out[own] = self.logs[0][place[own]]
        rest = np.flatnonzero(place < 0).tolist()
        for size in range(self.p.longest, 0, -1):
            grams, found, starts, left, rows = self.units[size], [], [], [], []
            for i in rest:
                hits = [r for g in grams_of(words[i], size) if (r := grams.get(g)) is not None]
                if hits:
                    found.append(i)
                    starts.append(len(rows))
                    rows += hits
                else:
                    left.append(i)
            if found:
                total = np.add.reduceat(self.logs[size][rows], starts, axis=0)
                out[found] = total / np.diff([*starts, len(rows)])[:, None]
            rest = left
        return out


class Scorer:
    """Predictions of a model; scores of words are kept for up to ``MOST`` distinct words."""

    MOST = 200_000

    def __init__(self, model: Model):
        self.model, self.row = model, {}
        room = min(self.MOST, 4 * self.MOST // max(1, len(model.langs)))
        self.scores = np.zeros((room, len(model.langs)), np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and score of each text."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        row = self.row
        fresh = list(set().union(*words).difference(row))
        first, room = len(row), len(self.scores)
        scores = self.model.words(fresh)
        for word in fresh:
            row[word] = len(row)
        kept = min(room, len(row)) - first
        self.scores[first:first + kept] = scores[:kept]
        table = self.scores if kept == len(fresh) else np.concatenate([self.scores, scores[kept:]])
        out = [self._judged(w, table) for w in words]
        while len(row) > room:
            row.popitem()
        return out

    def _judged(self, words: list[str], table: np.ndarray) -> tuple[str, float]:
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = table[list(map(self.row.__getitem__, words))].sum(axis=0, dtype=np.float64)
        best = int(np.argmax(total))
        scaled = (total - total[best]) * min(1.0, self.model.p.evidence / len(words))
        return self.model.langs[best], float(1 / np.exp(scaled).sum())


def fit(docs: DataFrame, p: LanguageId | None = None) -> Model:
    """Count the model; what comes to the driver is bounded by ``words`` and ``grams``."""
    p = p or LanguageId()
    found = counted(training_rows(docs, p), p).persist()
    try:
        totals = {(r["size"], r["lang"]): r["n"] for r in found.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
        langs = max(1, len({lang for _, lang in totals}))
        bound = F.when(F.col("size") == 0, p.words // langs).otherwise(p.grams // langs)
        rank = F.row_number().over(Window.partitionBy("size", "lang").orderBy(F.desc("n"), "unit"))
        rows = found.withColumn("rank", rank).where(F.col("rank") <= max(p.words, p.grams)).where(F.col("rank") <= bound)
        rows = rows.select("size", "unit", "lang", "n").toArrow().sort_by([("size", "ascending"), ("unit", "ascending"), ("lang", "ascending")])
    finally:
        found.unpersist()
    return Model(rows.column("size").to_numpy(), rows.column("unit").to_pylist(), rows.column("lang").to_pylist(), rows.column("n").to_numpy(), totals, p)


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns added, the language and its score; only the text decides.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there was no
    labelled row to learn from.  Ties go to the first language by name.  Columns of ``docs`` that are
    named like the new ones are replaced; repeated rows are judged each; whole texts are read.
    """
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        score = Scorer(sent.value)
        for whole in batches:
            for batch in slices(whole, 1000, "text"):
                found = score(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                                 names=[*batch.schema.names, *names])
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def language_ids(docs: DataFrame, p: LanguageId | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows not held out, applied to all rows.

    A row with a null doc_id is not learned from and not held out.  An empty table gives no rows.
    """
    found = identify(docs.select("doc_id", "text"), fit(docs, p))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op10_language_id")
def op10(spark, sf_dir):
    """The language of every whole text."""
    return language_ids(table(spark, sf_dir, "documents"))
