"""Near-duplicates, components, vectors, mixing, URLs, languages and the pipeline against plain versions."""

import itertools
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from riskledger.llm import language, minhash, mixing, neighbours, url_filter, vector_dedup
from riskledger.llm.common import Workspace
from riskledger.llm.components import components
from riskledger.llm.shingles import OnePermutation, Shingler, text_buffers

SF = "/root/testdata/sf0.001"


def leaders(items, linked):
    """Smallest item of each item's linked part."""
    lead = {x: x for x in items}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        lead[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def plain_set(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set()


def test_shingles_equal_plain_sets():
    import pyarrow as pa
    rng = random.Random(1)
    texts = [None, "", " ", "\n\t", "A", "a a a a", "ÀB àb", "x\x1cy \x85z", "🙂 🙂"] + [
        "".join(rng.choice("ab AB\n\t.é") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for words in (1, 2, 5):
        owner, hashes = Shingler(words)(*text_buffers(pa.chunked_array([pa.array(texts).slice(0, 50), pa.array(texts).slice(50)])))
        got = [set(hashes[owner == i].tolist()) for i in range(len(texts))]
        want = [plain_set(t, words) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        name = {}
        for g, w in zip(got, want):
            if len(w) == 1:
                assert name.setdefault(next(iter(w)), g) == g
        for i, j in itertools.combinations(range(60), 2):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_signature_agreement_estimates_jaccard():
    p = OnePermutation(40, 5)
    rng = np.random.default_rng(0)
    for size in (10, 100, 1000):
        agree = []
        for _ in range(40):
            both = rng.integers(0, 1 << 63, int(size * 10 / 9), dtype=np.uint64)
            a, b = both[:size], both[len(both) - size:]
            sig, _ = p.signatures(np.repeat([0, 1], size), np.concatenate([np.sort(a), np.sort(b)]), 2)
            agree.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(agree) - len(set(a.tolist()) & set(b.tolist())) / len(both)) < 0.06


def near_rows(spark, rows, p):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, component_id string")
    return minhash.near_duplicates(docs, p).collect()


def family_rows(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, ids = [], iter(rng.sample(range(10_000), 900))
    for size in (1, 2, 3, 8, 60):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 150]))]
            for _ in range(size):
                own = list(base)
                for _ in range(rng.randint(0, max(1, len(base) // 12))):
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
                rows.append((next(ids), " ".join(own), 1, "x"))
    rows += [(next(ids), "same text here", 1, "x") for _ in range(40)] + [(next(ids), t, 1, "x") for t in (None, "", " \n", "One", "one", "ONE\t")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("p", [minhash.MinHash(), minhash.MinHash(words=5), minhash.MinHash(tile_docs=10, tile_shingles=500)])
def test_near_duplicates_equal_all_pairs(spark, p):
    rows = family_rows()
    sets = {i: plain_set(t, p.words) for i, t, _, _ in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2)
              if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = leaders(sets, linked)
    got = near_rows(spark, rows, p)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_near_duplicates_edges(spark):
    got = near_rows(spark, [(1, "a b c", 0, ""), (1, "a b c", 0, ""), (None, "a b c", 0, ""), (3, None, 0, ""), (0, "A  b\nc", 0, "")], minhash.MinHash())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got) == [
        (False, 0, 2, 0, True), (False, 1, 2, 0, False), (False, 3, 0, 3, True), (True, 0, 2, None, True)]
    assert near_rows(spark, [], minhash.MinHash()) == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    edges += [(5, 5), (7, 6), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert {r.id: r.component_id for r in got.collect()} == leaders({x for e in real for x in e}, real)


def vector_rows(seed=2):
    rng = np.random.default_rng(seed)
    rows, ids = [], iter(rng.permutation(4000).tolist())
    for size in (1, 1, 2, 5, 40):
        for _ in range(6):
            base = rng.normal(size=24)
            rows += [(next(ids), (base + rng.normal(size=24) * rng.uniform(0, 0.35)).tolist()) for _ in range(size)]
    rows += [(next(ids), rows[0][1]) for _ in range(30)] + [(next(ids), [2 * x for x in rows[1][1]])]
    odd = [None, [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [], [1.0, 2.0], [2.0, 4.0]]
    return rows, [(next(ids), v) for v in odd]


SCHEMA = "vec_id long, embedding array<double>, n_links int, rank int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)


@pytest.mark.parametrize("p", [vector_dedup.Pigeonhole(), vector_dedup.Pigeonhole(block=5, cell=40, chunk=50)])
def test_near_vectors_equal_all_pairs(spark, p):
    rows, odd = vector_rows()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [i for i, _ in rows]
    near = (x @ x.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    want = leaders(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    got = {r.vec_id: r for r in vector_dedup.near_vectors(vector_frame(spark, rows + odd + rows[:2]), p).collect()}
    assert set(got) == {*ids, *(i for i, _ in odd)}
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), want[i], want[i] == i)
    pair = [odd[-2][0], odd[-1][0]]
    for i, _ in odd:
        linked = i in pair
        assert (got[i].n_links, got[i].component_id) == ((1, min(pair)) if linked else (0, i))
    assert vector_dedup.near_vectors(vector_frame(spark, [])).count() == 0


def plain_nearest(rows, query, k):
    q = np.array(query[1])
    scored = [(-float(np.dot(q, np.array(v))), i) for i, v in rows if i != query[0] and len(v) == len(q)]
    return [i for _, i in sorted((round(s, 9), i) for s, i in scored)[:k]]


def test_nearest_with_the_whole_forest_is_exact(spark):
    rows, odd = vector_rows(5)
    rows = [(i, v) for i, v in rows if len(v) == 24]
    p = neighbours.Forest(leaves=1000, least=20, share=1.0, chunk=30, neighbours=7, query_step=3)
    got = {}
    for r in neighbours.nearest(vector_frame(spark, rows + odd[:6] + rows[:3]), p).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    table = dict(rows)
    assert set(got) == {i for i in table if i % 3 == 0}
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 8))
        assert [i for _, i, _ in found] == plain_nearest(rows, (q, table[q]), 7)
        assert all(abs(s - np.dot(table[q], table[i])) < 1e-9 for _, i, s in found)
    assert neighbours.nearest(vector_frame(spark, [])).count() == 0
    assert neighbours.nearest(vector_frame(spark, [(20, [1.0, 2.0])])).count() == 0


def test_recall_with_production_parameters(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    table, x = dict(rows), np.array([v for _, v in rows])
    hits = total = 0
    got = {}
    for r in neighbours.op2(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    ids = np.array([i for i, _ in rows])
    for q in got:
        score = x @ np.array(table[q])
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits, total = hits + len(got[q] & set(best.tolist())), total + 20
    assert hits >= 0.9 * total


def test_groups_of_a_leaf_are_bounded(spark):
    rng = np.random.default_rng(3)
    single = spark.createDataFrame([(i, rng.normal(size=8).tolist(), int(i % 2 == 0)) for i in range(600)], "vec_id long, embedding array<double>, ask int")
    p = neighbours.Forest(trees=2, leaves=2, least=20, share=1.0, chunk=50)
    groups = {}
    for r in neighbours._meetings(Workspace(spark), single, 600, 8, p).collect():
        groups.setdefault((r.leaf, r.part, r.ask_part), ([], []))[r.ask].append(r.vec_id)
    assert max(len(rows) for both in groups.values() for rows in both) < 2 * p.chunk
    met = [(leaf, q, m) for (leaf, _, _), (members, queries) in groups.items() for q in queries for m in members]
    assert len(met) == len(set(met)) and len({(q, m) for _, q, m in met}) == 300 * 600


def test_turns_equal_a_plain_earliest_deadline_schedule():
    """Against a scan over all sources in every slot, with the windows worked out as fractions."""
    rng = random.Random(6)
    for _ in range(40):
        weights = {f"s{i}": rng.choice([1, 2, 5, 0.01, 30, 0.3]) for i in range(rng.randint(1, 12))}
        parts, period = mixing.exact(weights)
        share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
        assert {s: Fraction(n, period) for s, n in parts.items()} == share
        given, slots = dict.fromkeys(weights, 0), 300
        for slot, (s, j, release, due) in zip(range(slots), mixing.turns(parts, period)):
            windows = {k: (math.floor(n / share[k]), math.ceil((n + 1) / share[k])) for k, n in given.items()}
            want = min((d, k) for k, (r, d) in windows.items() if r <= slot)[1]
            assert (s, j, (release, due)) == (want, given[want], windows[want]) and release <= slot < due
            given[s] += 1
            assert all(abs(n - (slot + 1) * share[k]) < 1 for k, n in given.items())


MIX = "doc_id long, text string, lang string, source string, n_chars long, slot int, _key string"


def mix_frame(spark):
    rng = random.Random(8)
    sizes = {"a": 300, "b": 40, "c": 7, None: 12}
    rows = [(k, "x" * rng.randint(0, 400), "en", s, 0, 1, "k") for k, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows + [(900, None, None, "a", 0, 1, "k"), (900, None, None, "a", 0, 1, "k"), (901, "y" * 9000, "en", "b", 0, 1, "k")], MIX)


@pytest.mark.parametrize("weights", [None, (("a", 1), ("b", 1), (None, 2)), (("zz", 1),)])
def test_mix_gives_every_row_and_the_weights(spark, weights):
    docs = mix_frame(spark)
    p = mixing.Mixing(weights=weights, block_chars=500, share_rows=50)
    rows = mixing.schedule_of(docs, p).collect()
    if weights == (("zz", 1),):
        assert rows == []
        return
    named = {s for s, _ in weights} if weights else {"a", "b", "c", None}
    once = sorted(r.doc_id for r in rows if r.epoch == 0)
    assert once == sorted(r.doc_id for r in docs.collect() if r.source in named)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    owner = {}
    for r in rows:
        assert owner.setdefault(r.slot, r.source) == r.source
    spans = {}
    for r in rows:
        spans.setdefault((r.source, r.epoch), []).append(r.start)
    for starts in spans.values():
        assert len(set(starts)) == len(starts)
    mixed = mixing.mixed(docs, p)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(str(d) for r in rows for d in _rows_of(docs, r.doc_id))


_CACHE = {}


def _rows_of(docs, doc_id):
    if not _CACHE:
        for r in docs.collect():
            _CACHE[r.doc_id] = r
    return [_CACHE[doc_id]]


@pytest.mark.parametrize("weights", [None, (("a", 1000), ("b", 1000.5), ("c", 50))])
def test_mix_keeps_the_target_weights_over_many_periods(spark, weights):
    p = mixing.Mixing(weights=weights, block_chars=50, share_rows=50)
    docs = mix_frame(spark)
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(r.text or "") + 1
    target = dict(weights) if weights else {s: n ** 0.7 for s, n in size.items()}
    total, seen = sum(target.values()), set()
    for r in mixing.schedule_of(docs, p).collect():
        number, share = r.epoch * ((size[r.source] - 1) // 50 + 1) + r.block, target[r.source] / total
        assert r.block == r.start // 50
        assert abs(number - r.slot * share) < 1 and abs(number + 1 - (r.slot + 1) * share) < 1
        seen.add(r.slot)
    assert max(seen) > 320


def test_parts_of_uses_do_not_change_the_mix(spark):
    """One source of a single block that is used every other slot, and a row over many blocks."""
    docs = mix_frame(spark).where("source <> 'c' or doc_id % 7 = 0")
    plain, cut = (mixing.Mixing(weights=(("a", 1), ("b", 1), ("c", 3)), block_chars=40, share_rows=50, part=n) for n in (1 << 20, 3))
    want = sorted(map(str, mixing.schedule_of(docs, plain).collect()))
    assert sorted(map(str, mixing.schedule_of(docs, cut).collect())) == want and max(
        r.epoch for r in mixing.schedule_of(docs, cut).collect()) > 30
    assert [str(r) for r in mixing.mixed(docs, cut).collect()] == [str(r) for r in mixing.mixed(docs, plain).collect()]


def test_small_weights_do_not_stretch_the_mix(spark):
    parts, period = mixing.exact({"a": 0.1, "b": 0.2, "c": 1e-7})
    assert period == sum(parts.values()) and abs(parts["b"] / parts["a"] - 2) < 1e-12
    first = {"a": 100, "b": 200, "c": 1}
    end = mixing.horizon(parts, period, first)
    got = list(mixing.turns(parts, period, first, end))
    assert None not in got and len(got) <= end < 310
    count = dict.fromkeys(parts, 0)
    for slot, (s, j, release, due) in enumerate(got):
        assert j == count[s] and release <= slot < due and (release, due) == mixing.window(j, parts[s], period)
        count[s] += 1
    assert all(count[s] >= n for s, n in first.items())
    with pytest.raises(Exception, match="more than 2 sources"):
        mixing.schedule_of(mix_frame(spark), mixing.Mixing(sources=2)).count()


def test_mix_of_nothing(spark):
    assert mixing.schedule_of(mix_frame(spark).limit(0)).count() == 0 and mixing.mixed(mix_frame(spark).limit(0)).count() == 0


URLS = [(None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("no scheme/porn", ("", "", None, "block")),
        ("http://A.Example.NET/en/x?y#z", ("a.example.net", "/en/x", "example.net/en/", "allow")),
        ("http://example.net", ("example.net", "", None, "allow")), ("x://net/", ("net", "/", "net/", "block")),
        ("http://notexample.com/de/", ("notexample.com", "/de/", None, "allow")),
        ("http://b.example.com/de/?porn", ("b.example.com", "/de/", "example.com/de/", "block")),
        ("http://a.org/fr/porn", ("a.org", "/fr/porn", "org/fr/", "allow")),
        ("http://a.com/porn-1", ("a.com", "/porn-1", None, "block")), ("http://a.com/pornography", ("a.com", "/pornography", None, "allow")),
        ("http://a.com/sex", ("a.com", "/sex", None, "allow")), ("http://a.com/sex/sex", ("a.com", "/sex/sex", None, "allow")),
        ("http://sex.com/CASINO", ("sex.com", "/CASINO", None, "block")), ("http://éporn.com?porné", ("éporn.com", "", None, "allow")),
        ("a://b://c/d", ("b:", "//c/d", None, "allow")), ("http://h.com#/x?y", ("h.com", "", None, "allow"))]


def test_urls(spark):
    import pyarrow as pa
    frame = spark.createDataFrame([(i, u, None, "h") for i, (u, _) in enumerate(URLS)], "page_id long, url string, html string, host string")
    rows = url_filter.judged(frame).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [w for _, w in URLS]
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": list(range(len(URLS))), "url": [u for u, _ in URLS]}))
    sql = con.sql(url_filter._sql(url_filter.UrlFilter()) + " order by page_id").fetchall()
    assert [tuple(r) for r in rows] == sql
    assert url_filter.judged(frame.limit(0)).count() == 0
    nothing = url_filter.UrlFilter(rules=(), strict=(), soft=())
    assert {r.verdict for r in url_filter.judged(frame, nothing).collect()} == {"allow"}


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in language.op10(spark, sf).collect()]
    assert len(rows) == len(labels)
    held = [r for r in rows if r.held_out and labels[r.doc_id]]
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.97 * len(held) > 100
    assert all(0 <= r.score <= 1 for r in rows)


LANG = "doc_id long, text string, lang string, score string, held_out int"


def test_language_edges(spark):
    rows = [(i, "the cat and the dog", "en", "", 0) for i in range(20)] + [(i, "der hund und die katze", "de", "", 0) for i in range(20, 40)]
    odd = [(100, None, "en", "", 0), (101, "", None, "", 0), (102, "12 ² -- 😀", None, "", 0), (103, "THE DOG", None, "", 0), (104, "katzen hundes", None, "", 0),
           (104, "katzen hundes", None, "", 0), (None, "der", None, "", 0)]
    frame = spark.createDataFrame(rows + odd, LANG)
    got = {r.doc_id: r for r in language.language_ids(frame).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "en", "de", "de"]
    assert got[100].score == 0 and got[None].held_out is False and got[103].score > 0.5
    unlabelled = frame.withColumn("lang", frame.lang.substr(100, 1)).selectExpr("doc_id", "text", "nullif(lang, '') lang")
    assert {(r.lang_pred, r.score) for r in language.language_ids(unlabelled).collect()} == {("und", 0.0)}
    assert language.language_ids(frame.limit(0)).count() == 0


def test_backoff_equals_a_plain_one():
    p = language.LanguageId(longest=3)
    rows = [(0, "abc", "x", 4), (0, "abd", "y", 2), (3, "<ab", "x", 4), (3, "<ab", "y", 2), (2, "zz", "y", 1), (1, "q", "x", 1)]
    totals = {(s, lang): sum(n for a, _, b, n in rows if (a, b) == (s, lang)) for s, _, lang, _ in rows}
    model = language.Model(*zip(*((a, b, c, n) for a, b, c, n in rows)), totals, p)
    for word, size, units in (("abc", 0, ["abc"]), ("abx", 3, ["<ab"]), ("ozz", 2, ["zz"]), ("uq", 1, ["q"])):
        for k, lang in enumerate(model.langs):
            n = len({u for s, u, _, _ in rows if s == size})
            want = np.mean([np.log((sum(c for s, a, b, c in rows if (s, a, b) == (size, u, lang)) + 0.5) / (totals.get((size, lang), 0) + 0.5 * (n + 1)))
                            for u in units])
            assert abs(model.words([word])[0][k] - want) < 1e-5
    assert (model.words(["ö"]) == 0).all()
    scorer = language.Scorer(model)
    texts = ["abc abx", "ozz uq ö", None, "abd", "abc ozz abx uq"]
    want = language.Scorer(model)(texts)
    scorer.scores = scorer.scores[:2]
    assert [scorer([t])[0] for t in texts] == want and scorer(texts) == want and len(scorer.row) <= 2


@pytest.mark.parametrize("turned", [False, True])
def test_a_repeated_doc_id_is_one_text(spark, turned):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(60))
    z = " ".join(f"z{i}" for i in range(80))
    rows = [(5, x), (5, y), (5, z), (9, y), (11, y + " more"), (12, x + " more"), (13, z)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in (rows[::-1] if turned else rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs, minhash.MinHash(words=5)).collect()}
    assert got == {5: (5, True), 12: (5, False), 9: (9, True), 11: (9, False), 13: (13, True)}
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, x), (9, y), (13, z)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "mix_sources", "pack"] and corpus_pipeline.ORACLE_SQL is None
    work = Workspace(spark)
    kept = work.keep(corpus_pipeline.language_id(spark, docs, SF), "a")
    assert kept.columns == docs.columns
    judged = {r.doc_id: (r.lang_pred, r.score) for r in language.language_ids(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, (lang, s) in judged.items() if lang != "und" and s >= corpus_pipeline.LEAST_SCORE}
    single = work.keep(corpus_pipeline.near_dedup(spark, kept, SF), "b")
    sets = {r.doc_id: plain_set(r.text, 5) for r in kept.collect()}
    lead = leaders(sets, [(a, b) for a, b in itertools.combinations(sets, 2)
                          if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert sorted(r.doc_id for r in single.collect()) == sorted({*lead.values()})
    mixed = work.keep(corpus_pipeline.mix_sources(spark, single, SF), "c")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    packed = corpus_pipeline.pack(spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_pipeline_edges(spark):
    rows = [(1, "the cat sat", "en", "a", 0), (1, "the cat sat", "en", "a", 0), (None, "the dog", None, None, 0), (2, None, None, None, None), (3, "12", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    work = Workspace(spark)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = work.keep(stage(spark, docs, ""), f"edge-{name}")
    assert {r.doc_id for r in docs.collect()} == {1, None}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), "")
        assert out.count() == 0


def test_vectors_of_floats_stay_floats_and_blocks_take_turns(spark, monkeypatch):
    tables, keep = {}, Workspace.keep

    def kept(self, df, name):
        out = keep(self, df, name)
        tables[name] = out, self.free_shuffles
        return out
    monkeypatch.setattr(Workspace, "keep", kept)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 12))
    rows = [(i, (base[i % 20] + 0.05 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(80)]
    p = vector_dedup.Pigeonhole(block=4)
    one = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), p).collect()
    assert all(df.schema["embedding"].dataType.simpleString() == "array<float>" for name, (df, _) in tables.items() if name in ("vectors", "reps"))
    assert {n for n in tables if n.startswith("found")} == {"found0", "found1", "found2"} and all(free for _, free in tables.values())
    other = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), p).collect()
    assert sorted(one) == sorted(other) and sum(r.n_links for r in one) > 100
