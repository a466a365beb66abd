"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskledger.llm import spelling
from riskledger.llm.common import Workspace

DOCS = "doc_id long, text string, word string, n int, form string"


def plain_words(rows, drop_every=31):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            total[run[:at] + run[at + 1:] if h % drop_every == 0 else run] += 1
    return total


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(rows, drop_every=31, length=7, count=2, ratio=10):
    words = {w: n for w, n in plain_words(rows, drop_every).items() if len(w) >= length and n >= count}
    found = {}
    for w, n in words.items():
        close = sorted(((-m, x) for x, m in words.items() if near(w, x)))
        form = close[0][1] if close and -close[0][0] >= ratio * n else None
        found[w] = [n, len(close), form, words[form] if form else None]
    out = set()
    for w, (n, n_near, form, form_n) in found.items():
        root = w
        while found[root][2]:
            root = found[root][2]
        out.add((w, n, n_near, form, form_n, root))
    return out


def rows_of(df):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def random_docs(seed, letters, size, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(*size))) for _ in range(n)]
    weights = [10 ** rng.randint(0, 4) for _ in stems]
    docs = []
    for doc in range(120):
        picked = rng.choices(stems, weights, k=40)
        for k, w in enumerate(picked):
            if rng.random() < 0.3:
                i, c = rng.randrange(len(w)), rng.choice(letters)
                picked[k] = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]]) or c
        docs.append((doc if doc % 50 else None, " ".join(picked)))
    return docs


@pytest.mark.parametrize("letters, size, share, length", [("ab", (7, 12), 3, 7), ("abcé", (5, 10), 20_000, 7), ("aÿZÀ", (1, 6), 5, 1),
                                                          ("abcdefghij", (8, 30), 50, 7)])
def test_variants_as_all_pairs(spark, letters, size, share, length):
    docs = random_docs(len(letters), letters, size, 60)
    docs += [docs[3], docs[3], (7, None), (8, ""), (None, None), (9, "- 12 _")]
    frame = spark.createDataFrame([(*d, "x", 1, "f") for d in docs], DOCS).repartition(5)
    want = plain_variants(docs, length=length)
    assert len(want) > 30 and any(w[3] for w in want)
    got = rows_of(spelling.variants(frame, length=length, share=share))
    assert got == want


def test_long_runs_chains_and_nothing(spark):
    text = " ".join(["x" * 3000] * 30 + ["x" * 2999] * 2 + ["ab" * 900 + "c"] * 2 + ["ab" * 900] * 20
                    + [w * k for w, k in (("chainabc ", 2), ("chainabd ", 20), ("chainaed ", 200), ("chxinaed ", 2000))])
    docs = [(1, text), (2, "É" * 50 + "e " + "É" * 50 + "e")]
    frame = spark.createDataFrame([(*d, "x", 1, "f") for d in docs], DOCS)
    want = plain_variants(docs, drop_every=10**9)
    got = rows_of(spelling.variants(frame, drop_every=10**9))
    assert got == want and {w[5] for w in want if w[0].startswith("chainab")} == {"chxinaed"}
    assert spelling.variants(frame.limit(0)).collect() == []


def test_nodes_are_prefixes(spark):
    words = spelling.numbered(spark.createDataFrame([(w, 2) for w in ("éabcdefg", "abcdefg", "abcdefh", "gfedcba")], "word string, n long"))
    words = Workspace(spark).keep(words, "words")
    rows = spelling.trie_paths(words).collect()
    text = {r.id: r.word for r in words.collect()}
    assert [len(text[i]) for i in sorted(text)] == [7, 7, 7, 8]
    by_prefix = {}
    for r in rows:
        w = text[r.id][::-1] if r.back else text[r.id]
        by_prefix.setdefault((r.back, w[:r.pos]), set()).add((r.a, r.b))
        after = (w[r.pos:r.pos + 2] + "\0\0")[:2]
        assert r.c == ord(after[0]) * 256 + ord(after[1]) and len(w) // 2 <= r.pos <= len(w) and (r.n is None) == (r.pos < len(w))
    assert all(len(k) == 1 for k in by_prefix.values()) and len({next(iter(k)) for k in by_prefix.values()}) == len(by_prefix)
    _, edges, _ = spelling.trie(words, Workspace(spark))
    assert edges.select("a", "b", "c", "share").distinct().count() == edges.count()


def test_no_table_goes_through_the_driver_by_its_packed_size(spark, monkeypatch):
    plans, keep = {}, Workspace.keep

    def kept(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)
    monkeypatch.setattr(Workspace, "keep", kept)
    docs = random_docs(9, "ab", (7, 8), 12)
    frame = spark.createDataFrame([(*d, "x", 1, "f") for d in docs], DOCS)
    want = plain_variants(docs)
    for most in (0, 4 << 20):
        monkeypatch.setattr(spelling, "SMALL_FRONTIER", most, raising=False)
        plans.clear()
        assert rows_of(spelling.variants(frame)) == want
        assert {n for n, p in plans.items() if "BroadcastHashJoin" in p} == {n for n in plans if most and n.startswith("level") and n != "level0"}
