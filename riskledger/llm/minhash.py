"""Near-duplicate documents by one-permutation MinHash.

One pass over the whole texts gives each document its number of distinct word shingles, a fingerprint
of the set, a one-permutation signature with optimal densification and its band keys.  Equal sets are
one class from there on.  Documents that share a band key meet in a bucket; in a bucket, those whose
signatures may reach the threshold are joined into groups, and a group of n gives n - 1 star-shaped
candidate edges, not n * n.  The connected groups of candidates are then verified on full shingle sets.
Buckets and groups of any size are cut into tiles of bounded size; every pair meets in one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskledger.llm import shingles as S
from riskledger.llm.common import Workspace, batch_of, by_group, group_starts, query, slices, table, tiles
from riskledger.llm.components import components


@dataclass(frozen=True)
class MinHash:
    """Production parameters.

    A pair at the threshold (Jaccard 0.8) misses all 40 bands of 5 rows with chance (1 - 0.8**5)**40,
    about 1e-7.  ``slack``: a pair leaves the candidates only if its signatures agree ``slack``
    standard deviations less than a pair at the threshold would.
    """

    words: int = 2
    percent: int = 80
    bands: int = 40
    rows: int = 5
    slack: float = 6.0
    tile_docs: int = 2048
    tile_shingles: int = 1 << 22


SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                    ("signature", pa.binary()), ("bands", pa.list_(pa.int64())), ("text_hash", pa.int64())])
SETS = pa.schema([("doc_id", pa.int64()), ("group_id", pa.int64()), ("tile", pa.int64()), ("hashes", pa.binary())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("tiled", pa.bool_())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string",
             pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def sketch(docs: DataFrame, p: MinHash) -> DataFrame:
    """doc_id, n_shingles, fingerprint, signature (a byte a bin), band keys and hash of every text."""
    def run(batches):
        shingler, permutation = S.Shingler(p.words), S.OnePermutation(p.bands, p.rows)
        for whole in batches:
            for batch in slices(whole, 1000, "text"):
                n = batch.num_rows
                owner, hashes = shingler(*S.text_buffers(batch.column("text")))
                sig, some = permutation.signatures(owner, hashes, n)
                keys = permutation.bands_of(sig).view(np.int64)
                prints = S.fingerprints(owner, hashes, n).view(np.int64)
                low = S.mix(sig).astype(np.uint8)
                keys_of = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(some * p.bands))).astype(np.int32), keys[some].ravel())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").cast(pa.int64()), pa.array(np.bincount(owner, minlength=n), pa.int64()),
                    pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                    pa.array([row.tobytes() for row in low], pa.binary()), keys_of, batch.column("text_hash")], schema=SKETCH)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, ddl(SKETCH))


def _spread(close, n: int) -> np.ndarray:
    """Labels (least row) of the connected parts of rows 0..n-1.

    ``close(i, rest)`` says which of ``rest`` are next to i.  A row that has been reached is compared
    only with rows not reached yet, so a dense group costs about n comparisons.
    """
    label = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            i = front.pop()
            near = close(i, rest)
            if near.any():
                found, rest = rest[near], rest[~near]
                label[found] = seed
                front.extend(found.tolist())
    return label


def bucket_edges(p: MinHash):
    """Star edges of the buckets in a table of (bucket, tile, doc_id, n_shingles, signature)."""
    limit, bins = p.percent / 100, p.bands * p.rows

    def work(rows: pa.Table):
        starts = group_starts(rows, ["bucket", "tile"])
        ends = np.append(starts[1:], rows.num_rows)
        ids, n = rows.column("doc_id").to_numpy(), rows.column("n_shingles").to_numpy()
        sigs = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, bins)
        need = limit - p.slack * np.sqrt(limit * (1 - limit) / np.minimum(n, bins))
        a, b = [], []
        for s, e in zip(starts, ends):
            if e - s < 2:
                continue
            own, own_n, own_need, own_id = sigs[s:e], n[s:e], need[s:e], ids[s:e]

            def close(i, rest):
                ok = (100 * np.minimum(own_n[i], own_n[rest]) >= p.percent * np.maximum(own_n[i], own_n[rest])) & (own_id[rest] != own_id[i])
                at = np.flatnonzero(ok)
                ok[at] = (own[rest[at]] == own[i]).mean(axis=1) >= np.minimum(own_need[i], own_need[rest[at]])
                return ok
            order = np.argsort(own_id, kind="stable")
            own, own_n, own_need, own_id = own[order], own_n[order], own_need[order], own_id[order]
            label = _spread(close, e - s)
            linked = label != np.arange(e - s)
            a.append(own_id[label[linked]])
            b.append(own_id[linked])
        if a:
            return batch_of(EDGES, a=np.concatenate(a), b=np.concatenate(b))
    return by_group(["bucket", "tile"], work)


def verified(p: MinHash):
    """Labels by exact links within the groups of a table of (group_id, tile, doc_id, hashes)."""
    def work(rows: pa.Table):
        starts = group_starts(rows, ["group_id", "tile"])
        ends = np.append(starts[1:], rows.num_rows)
        ids, sets, tiled = rows.column("doc_id").to_numpy(), rows.column("hashes"), rows.column("parts").to_numpy() > 1
        out_id, out_label = [], []
        for s, e in zip(starts, ends):
            own = ids[s:e]
            order = np.argsort(own, kind="stable")
            own = own[order]
            parts = [np.frombuffer(sets[int(s + i)].as_py(), np.uint64) for i in order]
            size = np.array([len(x) for x in parts])
            words, index = np.unique(np.concatenate(parts), return_inverse=True)
            at = np.concatenate(([0], np.cumsum(size)))
            mark = np.zeros(len(words), bool)

            def close(i, rest):
                fits = 100 * np.minimum(size[i], size[rest]) >= p.percent * np.maximum(size[i], size[rest])
                some = rest[fits]
                if not len(some):
                    return fits
                mark[index[at[i]:at[i + 1]]] = True
                which = np.repeat(at[some] - np.concatenate(([0], np.cumsum(size[some])[:-1])), size[some]) + np.arange(size[some].sum())
                both = np.add.reduceat(mark[index[which]].astype(np.int64), np.concatenate(([0], np.cumsum(size[some])[:-1])))
                mark[index[at[i]:at[i + 1]]] = False
                out = fits.copy()
                out[fits] = 100 * both >= p.percent * (size[i] + size[some] - both)
                return out
            label = _spread(close, e - s)
            out_id.append(own)
            out_label.append(own[label])
        return batch_of(LABELS, doc_id=np.concatenate(out_id), label=np.concatenate(out_label), tiled=tiled)
    return by_group(["group_id", "tile"], work)


def sets_of(p: MinHash):
    def run(batches):
        shingler = S.Shingler(p.words)
        for whole in batches:
            for batch in slices(whole, 1000, "text"):
                owner, hashes = shingler(*S.text_buffers(batch.column("text")))
                edge = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                values = [hashes[s:e].tobytes() for s, e in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("group_id"), batch.column("n_shingles"),
                                                  pa.array(values, pa.binary())],
                                                 names=["doc_id", "group_id", "n_shingles", "hashes"])
    return run


def near_duplicates(docs: DataFrame, p: MinHash | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each distinct doc_id of ``docs``; see ``judged``."""
    return judged(docs, p).drop("text_hash")


def judged(docs: DataFrame, p: MinHash | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for each distinct doc_id of ``docs``.

    Documents with ``percent`` per cent of common distinct ``words``-word shingles or more are linked;
    component_id is the smallest doc_id reachable by links, kept the document that bears it.  Texts
    that are null or have no word have no shingle and link with nothing.  Rows with a null doc_id link
    with nothing and come back with a null component.  Rows that repeat a doc_id count as one document:
    the one whose set comes first, by size and fingerprint; ``text_hash`` (xxhash64) is that of its text.
    Other columns are not read.  An empty table gives no rows.
    """
    p = p or MinHash()
    work = Workspace(docs.sparkSession)
    all_rows = work.keep(sketch(docs, p), "sketch")
    rows = all_rows.where("doc_id is not null")

    once = rows.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "f1", "f2", "text_hash")).alias("x")).select("doc_id", "x.*")
    once = work.keep(once, "once")
    classes = work.keep(once.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = once.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text_hash")
    reps = rows.join(chosen, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    reps = work.keep(reps, "reps")

    keyed = reps.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = (keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"))
               .where("n > 1").groupBy("n", "who").agg(F.min("bucket").alias("bucket")))
    buckets = work.keep(buckets.select("bucket", F.ceil(F.col("n") / p.tile_docs).alias("parts")), "buckets")
    members = keyed.join(buckets.select("bucket"), "bucket").join(
        reps.select("doc_id", "n_shingles", "signature"), "doc_id")
    members = tiles(members, buckets.where("parts > 1"), "bucket", "doc_id", p.tile_docs)
    members = members.select("bucket", "tile", "doc_id", "n_shingles", "signature")
    stars = (members.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")
             .mapInArrow(bucket_edges(p), ddl(EDGES)))
    groups = work.keep(components(stars, work, "groups").select(F.col("id").alias("doc_id"), F.col("component_id").alias("group_id")), "candidates")

    groups = groups.join(reps.select("doc_id", "n_shingles", "text_hash"), "doc_id")
    sized = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("mass"))
    sized = sized.select("group_id", F.ceil(F.greatest(F.col("n") / p.tile_docs, F.col("mass") / p.tile_shingles)).alias("parts"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(groups, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    sets = texts.drop("text_hash").mapInArrow(sets_of(p), "doc_id long, group_id long, n_shingles long, hashes binary")
    sets = tiles(sets, sized.where("parts > 1"), "group_id", "doc_id", p.tile_docs)
    labels = (sets.repartition("group_id", "tile").sortWithinPartitions("group_id", "tile")
              .mapInArrow(verified(p), ddl(LABELS)))
    labels = work.keep(labels, "labels")
    found = labels.where("not tiled and doc_id <> label").select(F.col("doc_id").alias("rep"), F.col("label").alias("component"))
    tiled = components(labels.where("tiled and doc_id <> label").select(F.col("doc_id").alias("a"), F.col("label").alias("b")), work, "tiled")
    found = found.union(tiled.where("id <> component_id").select("id", "component_id"))

    out = (once.join(classes, ["f1", "f2", "n_shingles"], "left").join(found, "rep", "left")
           .withColumn("component_id", F.coalesce("component", "rep", "doc_id")))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "text_hash")
    nameless = all_rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"), "text_hash")
    return out.union(nameless)


_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]) END) AS s FROM w),
  n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
  both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b
    ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
  half AS (SELECT a, b FROM both_ WHERE 100 * both_ >= 80 * (na + nb - both_)), links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
  reach AS (SELECT a AS x, b AS y FROM links UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
  parts AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(p.c, n.doc_id) AS component_id, coalesce(p.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN parts p ON p.x = n.doc_id"""


@query("op7_minhash_near_dedup", _SQL)
def op7(spark, sf_dir):
    """Near-duplicate documents: two-word shingles, Jaccard 0.8 or more, whole texts."""
    return near_duplicates(table(spark, sf_dir, "documents"))
