"""Piece codec against the sentencepiece library, fill-in-the-middle against a plain version."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from riskledger.llm import fill_middle, piece_codec, tokens
from test_text_operators import DOCS, ODD, frame, some_texts

SF = "/root/testdata/sf0.001"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"


@pytest.fixture(scope="module")
def codec():
    with open(tokens.PIECE_BPE, "rb") as f:
        data = f.read()
    return piece_codec.PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def strange_texts():
    rng = random.Random(5)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
            for letters in (ALPHABET, "aab", " ▁-=*.", "\n \t▁a", "ingering") for _ in range(100)]


def test_ids_and_texts_as_the_library(codec):
    ours, library = codec
    texts = [t or "" for t in ODD] + some_texts(1000) + strange_texts() + ["".join(random.Random(1).choices(ALPHABET, k=60_000))]
    ids = ours.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode(t) for t in texts]
    assert ours.decode(ids) == [library.decode(x.tolist()) for x in ids]


def test_any_ids_decode_as_the_library(codec):
    ours, library = codec
    rng = random.Random(9)
    rows = [[rng.choice([rng.randrange(300), rng.randrange(32_000), 35]) for _ in range(rng.randint(0, 20))] for _ in range(5000)]
    assert ours.decode([np.array(r, np.int32) for r in rows]) == [library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        ours.decode([np.array([32_000], np.int32)])


def test_equal_ranks_and_better_results_merge_one_at_a_time():
    ids = {p: i for i, p in enumerate(["a", "b", "ab", "aba", "ba"])}
    merges = piece_codec.Merges.of(ids, {"a": -9.0, "b": -9.0, "aba": -1.0, "ab": -2.0, "ba": -2.0}, len(ids))
    symbols = np.array([0, 1, 0, 1, 0, 1], np.int32)
    out, places = merges.rounds(symbols, np.array([True, False, False, False, False, False]))
    assert [["a", "b", "ab", "aba", "ba"][i] for i in out] == ["aba", "ba", "b"] and places.tolist() == [0, 3, 5]


def test_codec_frames(spark, codec):
    texts = ODD + strange_texts()[::20]
    docs = frame(spark, texts).withColumnRenamed("source", "ids").unionByName(
        spark.createDataFrame([(None, "twice", None, "s", 0, 7, 1)] * 2, DOCS).withColumnRenamed("source", "ids"))
    ids = piece_codec.encoded(docs)
    rows = piece_codec.decoded(ids).collect()
    want = {i: codec[1].encode(t or "") + [2] for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert {i: r.text for i, r in got.items()} == {i: codec[1].decode(x) for i, x in want.items()}
    assert [r.text for r in rows if r.doc_id is None] == ["twice"] * 2
    assert piece_codec.decoded(piece_codec.encoded(docs.limit(0))).collect() == []
    assert [r.text for r in piece_codec.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [None]


def test_op11_digests(spark, codec):
    rows = {r.doc_id: r for r in piece_codec.op11(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(docs) == len(rows)
    for d in docs:
        ids = codec[1].encode(d.text or "") + [2]
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec[1].decode(ids).encode()).hexdigest()


def plain_middle(doc_id, text, fim):
    text = text or ""
    digest = hashlib.sha256(f"{fim.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    p, q = sorted([h[0] % (len(text) + 1), h[1] % (len(text) + 1)])
    if not text or any(m in text for m in (fim.prefix, fim.suffix, fim.middle)) or h[2] % 100 >= fim.rate:
        return len(text), "plain", None, None, text
    parts = (p, q - p)
    if h[3] % 100 < fim.spm:
        return len(text), "spm", *parts, fim.suffix + text[q:] + fim.prefix + text[:p] + fim.middle + text[p:q]
    return len(text), "psm", *parts, fim.prefix + text[:p] + fim.suffix + text[q:] + fim.middle + text[p:q]


@pytest.mark.parametrize("fim", [fill_middle.Fim(), fill_middle.Fim("¤pre", "¤suf|", "¤m", 100, 50, 7)])
def test_middles_as_plain_and_back(spark, fim):
    near = ["<P", "<<P>", "<S", "x<M>y", "P><S", "<", ">", "<<<<", "¤p", "¤pr¤", "¤m", "mid¤suf|"]
    texts = ODD + near * 8 + some_texts(300) + ["🙂" * 50, "é" * 100, "long " * 100_000]
    docs = frame(spark, texts).withColumn("output", F.lit("x"))
    docs = docs.unionByName(spark.createDataFrame([(None, "same text", None, "s", 0, 7, 1, "x")] * 2, DOCS + ", output string"))
    out = fill_middle.transformed(docs, fim)
    rows = fill_middle.restored(out, fim).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "same text" if r.doc_id is None else texts[r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, text, fim)
        assert r.text == (text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.restored(fill_middle.transformed(docs.limit(0), fim), fim).collect() == []


def test_sentinels_are_checked(spark):
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("a", "b", "c"), ("<a", "<ab", "<c"), ("<<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.Fim(*marks)
    broken = fill_middle.Displacer(fill_middle.Fim())
    for output in (b"no sentinel", b"<S>a<P>b<M>c"):
        with pytest.raises(ValueError):
            broken.gather(np.frombuffer(output, np.uint8), np.array([0, len(output)]), np.array([1]))
