"""Spelling variants: words one edit apart, found by walking a distributed trie.

Each word goes into a forward trie and, reversed, into a backward one.  One edit leaves the first or the
second half of a word as it is, so both tries are searched only from the middle of a word on, where few
words share a node; a word shorter by a letter is searched from the longer one, and of two words that
differ in a letter from one of them.  Chains without a branch are one edge, so the number of levels is
that of branches, not of letters.

The frontier holds states (word, position, node, edits).  Those without an edit meet a table of the
letters that lead from a node to an edge with the letter after the edit; then a level joins the states
with the edge table on node and next letter, and those whose rest of the word fits the edge's label go
on at its child.  A state that has used up its word at a terminal node is a pair of neighbours.

The planner sizes a table by its packed file and knows nothing of the rows that a batch function or an explode
adds, so it would send large tables through the driver.  Joins here are merged, but for a frontier of a few rows,
which is measured before it is broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm.common import Workspace, query, slices, table

#: Latin-1 code points to those of words: A-Z lower-cased, a-z and À-ÿ as they are, a blank for all others.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
DROP_EVERY = 31
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words that pass a node beyond which its edges are kept several times, for as many shares of its states.
SHARE = 20_000
#: Bytes of states, as counted, up to which a frontier is broadcast instead of dealing out all edges.
SMALL_FRONTIER = 4 << 20
PATHS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("back", pa.bool_()), ("pos", pa.int32()),
                   ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32())])


def word_counts(docs: DataFrame, drop_every: int = DROP_EVERY) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, with their number in all texts.

    Where ``drop_every`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses the letter that the
    CRC-32 chooses.  Null texts have no runs; a null doc_id counts as an empty one.  A task adds up
    runs slice by slice before they are shuffled.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 5000, "text"):
                total: Counter = Counter()
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    if not text:
                        continue
                    base = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                    for word, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), base)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                        total[word] += n
                words = pa.array([w.decode("latin-1") for w in total], pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(total.values(), pa.int64())], schema=schema)
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''")


def mixed(values: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each 64-bit number."""
    x = values.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def numbered(words: DataFrame) -> DataFrame:
    """word, n with an ``id`` that is smaller for shorter words."""
    return words.orderBy(F.length("word"), "word").withColumn("id", F.monotonically_increasing_id())


def trie_paths(words: DataFrame) -> DataFrame:
    """id, n, back, pos, a, b, c: the nodes of each word from its middle on, with the two letters that follow.

    A node is a prefix (of the reversed word if ``back``), known by two 64-bit sums over its letters and
    their places.  Letters are code points below 256, so ``c`` holds two: 256 times the first and the second,
    0 for each that the word has no more; ``n`` is null but where it ends.
    """
    def run(batches):
        for whole in batches:
            for batch in slices(whole, 20_000, "word", 1 << 20):
                texts, ids, n = batch.column("word").to_pylist(), batch.column("id").to_numpy(), batch.column("n").to_numpy()
                for back in (False, True):
                    yield paths(texts, ids, n, back)
    return words.select("id", "word", "n").mapInArrow(run, "id long, n long, back boolean, pos int, a long, b long, c int")


def paths(texts: list[str], ids: np.ndarray, n: np.ndarray, back: bool) -> pa.RecordBatch:
    size = np.array([len(t) for t in texts], np.int64)
    joined = "".join(t[::-1] for t in texts) if back else "".join(texts)
    start = np.cumsum(size) - size
    place = np.arange(len(joined)) - np.repeat(start, size)
    letter = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(letter * np.uint64(2) + np.uint64(back) + np.uint64(seed)))])
            for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
    half = size // 2
    count = size - half + 1
    which = np.repeat(np.arange(len(texts)), count)
    pos = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + half[which]
    at = start[which] + pos
    a, b = (mixed(s[at] - s[start[which]] + pos.astype(np.uint64)).view(np.int64) for s in sums)
    points = np.append(np.frombuffer(joined.encode("utf-32-le"), np.int32), [0, 0])
    left = size[which] - pos
    following = np.where(left > 0, points[at], 0) * 256 + np.where(left > 1, points[at + 1], 0)
    return pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(n[which], mask=pos < size[which]), pa.array(np.full(len(which), back)),
                                       pa.array(pos.astype(np.int32)), pa.array(a), pa.array(b), pa.array(following.astype(np.int32))], schema=PATHS)


def trie(words: DataFrame, work: Workspace, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(steps, edges, wild) of the two tries, over the nodes where words part or end.

    steps: word, n, nodes: such nodes on the word's paths with direction, position, key and number of shares.
    edges: a, b, c, share -> label, child's key and shares, and the count of the word that ends at the child.
    wild: a, b, after, share -> the letters of the edges that go on with ``after``, whether ``after`` is itself
    an edge (an end of a word if 0), and that word's count.

    An edge is written by the shortest of the words that share it, so it is written once.
    """
    path = trie_paths(words)
    nodes = path.groupBy("a", "b").agg(F.sort_array(F.collect_set("c")).alias("next"), F.count("*").alias("through"),
                                       F.min("id").alias("first"), F.max("n").alias("end_n"))
    nodes = nodes.where("end_n is not null or next[0] div 256 <> element_at(next, -1) div 256")
    nodes = work.keep(nodes.withColumn("shares", (1 + F.floor(F.col("through") / share)).cast("int")).drop("through"), "nodes")

    known = nodes.select("a", "b", "first", "shares", "end_n")
    steps = path.select("id", "back", "pos", "a", "b").join(known.hint("merge"), ["a", "b"]).withColumn("own", F.col("first") == F.col("id"))
    steps = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("back", "pos", "a", "b", "shares", "own", "end_n"))).alias("nodes"))
    steps = work.keep(steps.join(words.hint("merge"), "id").drop("id"), "steps")

    pairs = steps.selectExpr("word", "explode(filter(transform(slice(nodes, 2, size(nodes)), (x, i) -> struct(nodes[i] as up, x as down)), "
                             "e -> e.down.own and e.up.back = e.down.back)) as e")
    edges = pairs.withColumn("text", F.when(F.col("e.up.back"), F.reverse("word")).otherwise(F.col("word"))).selectExpr(
        "e.up.a as a", "e.up.b as b", "ascii(substring(text, e.up.pos + 1, 1)) as c", "substring(text, e.up.pos + 1, e.down.pos - e.up.pos) as label",
        "e.down.a as child_a", "e.down.b as child_b", "e.down.shares as child_shares", "e.down.end_n as end_n",
        "explode(sequence(0, e.up.shares - 1)) as share")

    wild = nodes.selectExpr("a", "b", "next", "end_n", "shares", "explode(array_distinct(concat(transform(next, x -> x div 256), "
                            "transform(filter(next, x -> x > 0), x -> x % 256)))) as after")
    wild = wild.selectExpr(
        "a", "b", "cast(after as int) as after", "transform(filter(next, x -> x > 0 and x % 256 = after), x -> cast(x div 256 as int)) as letters",
        "exists(next, x -> x div 256 = after) as child", "case when after = 0 then end_n end as end_n", "explode(sequence(0, shares - 1)) as share")
    return steps, work.keep(edges, "edges"), wild


def first_states(steps: DataFrame, wild: DataFrame) -> DataFrame:
    """States just after their edit: text (in the trie's direction), n, back, found, pos, a, b, c, shares, found_n.

    ``found`` is the word they would meet.  A replaced letter is followed to greater letters only, a deleted
    one to shorter words only; the other direction is the same pair.
    """
    at = steps.selectExpr("word", "n", "explode(nodes) as s").withColumn("text", F.when(F.col("s.back"), F.reverse("word")).otherwise(F.col("word")))
    at = at.selectExpr("text", "n", "s.back as back", "s.pos as pos", "s.a as a", "s.b as b", "s.shares as shares",
                       "ascii(substring(text, s.pos + 1, 1)) as own_letter", "ascii(substring(text, s.pos + 2, 1)) as after").where("pos < length(text)")
    at = at.withColumn("share", F.pmod(F.xxhash64("text"), F.col("shares")).cast("int")).join(wild.hint("merge"), ["a", "b", "after", "share"])
    at = at.selectExpr(
        "text", "n", "back", "pos", "a", "b", "shares", "end_n", "explode(concat("
        "transform(filter(letters, x -> x > own_letter), x -> struct(x as c, false as shorter)), "
        "if(child and after <> own_letter, array(struct(after as c, true as shorter)), array()))) as e")
    found = "concat(substring(text, 1, pos), if(e.shorter, '', char(e.c)), substring(text, pos + 2))"
    return at.selectExpr("text", "n", "back", f"{found} as found", "pos", "a", "b", "e.c as c", "shares",
                         "case when e.shorter and e.c = 0 then end_n end as found_n")


def _size(frontier: DataFrame) -> int:
    """Bytes of the states, 100 a row besides their texts; 0 if there are none."""
    return frontier.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("found") + 100), F.lit(0)).alias("b")).first()["b"]


def neighbours(words: DataFrame, work: Workspace, share: int = SHARE) -> DataFrame:
    """word, n, near, near_n: all pairs of different words that one edit apart makes equal, both ways round.

    ``words``: id, word, n as :func:`numbered` gives them.
    """
    steps, edges, wild = trie(words, work, share)
    frontier = work.keep(first_states(steps, wild), "level0")
    work.drop("steps", "nodes")
    met, level = [], 0
    while size := _size(frontier):
        met.append(frontier.where("found_n is not null").select("text", "n", "back", "found", "found_n"))
        going = frontier.where("found_n is null").withColumn("share", F.pmod(F.xxhash64("text"), F.col("shares")).cast("int")).drop("shares", "found_n")
        going = (F.broadcast(going) if size <= SMALL_FRONTIER else going.hint("merge")).join(edges, ["a", "b", "c", "share"]).where("substring(found, pos + 1, length(label)) = label")
        going = going.withColumn("pos", F.expr("pos + length(label)"))
        ended = F.col("pos") == F.length("found")
        going = going.where(~ended | F.col("end_n").isNotNull()).select(
            "text", "n", "back", "found", "pos", F.col("child_a").alias("a"), F.col("child_b").alias("b"),
            F.expr("ascii(substring(found, pos + 1, 1))").alias("c"), F.col("child_shares").alias("shares"),
            F.when(ended, F.col("end_n")).alias("found_n"))
        level += 1
        frontier = work.keep(going, f"level{level}")
    pairs = frontier.select("text", "n", "back", "found", "found_n")
    for more in met:
        pairs = pairs.unionByName(more)
    turned = [F.when(F.col("back"), F.reverse(x)).otherwise(F.col(x)) for x in ("text", "found")]
    pairs = pairs.select(turned[0].alias("word"), "n", turned[1].alias("near"), F.col("found_n").alias("near_n"))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"),
                                          F.col("word").alias("near"), F.col("n").alias("near_n")))
    return both.distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent neighbour (ties: smallest word), if it is frequent enough."""
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left").withColumn("best_n", -F.col("best.k"))
    enough = F.col("best_n") >= ratio * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))


def rooted(found: DataFrame, work: Workspace) -> DataFrame:
    """``found`` with ``root``: the end of the chain of forms, by doubling; counts grow along it, so it ends."""
    jump = work.keep(found.where("form is not null").select("word", F.col("form").alias("root")), "jump0")
    step = 0
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = jump.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("_moved"))
        step += 1
        ahead = work.keep(ahead, f"jump{step}")
        jump = ahead.drop("_moved")
        if ahead.where("_moved").isEmpty():
            break
    return found.join(jump.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, drop_every: int = DROP_EVERY, length: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO,
             share: int = SHARE) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of ``docs`` with at least that length and count.

    Two words are near if one inserted, deleted or replaced letter makes them equal.  Null and empty
    texts have no words, repeated rows count each, an empty table has no words; only doc_id and text are
    read.  Jobs run while the frame is built: one for each level of the trie.
    """
    work = Workspace(docs.sparkSession, free_shuffles=True)
    words = work.keep(numbered(word_counts(docs, drop_every).where((F.length("word") >= length) & (F.col("n") >= count))), "words")
    found = work.keep(forms(words, neighbours(words, work, share), ratio), "forms")
    return rooted(found, work)


#: CRC-32 goes bit by bit over the text; neighbours meet on a word with one letter hidden or left out.
OP12_SQL = """
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY ALL),
bits AS (
  SELECT w, n, flatten(list_transform(regexp_extract_all(hex(doc_id || ':' || w), '..'), lambda x:
    list_transform(range(8), lambda k: (('0x' || x)::BIGINT >> k) & 1))) AS bit FROM runs),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, bit), lambda s, b:
    xor(xor(s, b) >> 1, 3988292384 * (xor(s, b) & 1)))) AS h FROM bits),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM hashed)
  GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
hidden AS (SELECT word, n, word[:i] || '_' || word[i + 2:] AS k FROM places),
shorter AS (SELECT DISTINCT p.word, p.n, q.word AS near, q.n AS near_n FROM places p JOIN words q ON p.word[:i] || p.word[i + 2:] = q.word),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM hidden a JOIN hidden b ON a.k = b.k AND a.word <> b.word
  UNION SELECT word, n, near, near_n FROM shorter UNION SELECT near, near_n, word, n FROM shorter),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
found AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form,
    CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
walk AS (
  SELECT word, word AS at FROM found
  UNION ALL SELECT walk.word, f.form FROM walk JOIN found f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM walk JOIN found f ON f.word = walk.word JOIN found l ON l.word = walk.at AND l.form IS NULL
"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark, sf_dir):
    """Spelling variants of all words of all whole texts."""
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
