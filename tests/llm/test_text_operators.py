"""Token counts, packing, matrices and chat formatting against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskledger.llm import binary_output, chat, packing, token_counts, tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, rank int"
ODD = ["", None, " ", "\n", "a", "a  b", "  lead", "tail ", "\t tab\t x", "\u3000wide\u3000", "Ünï çødé \u0301x", "<|endoftext|> <s>[INST]</s>",
       "a\u2581b \u2581", "emoji 🙂🙂 中文", "\x1c.\x1cx", "don't we'll I'M", "x" * 3000, "1234 5,6.7", "line\nline\r\nline", "\x00 nul"]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, "s", 0, 7, 1) for i, t in enumerate(texts)], DOCS)


def some_texts(n, seed=3):
    rng = random.Random(seed)
    units = list("abcdethnioar .,  \n\t") + ["é", "ß", "ﬁ", "\u2581", "🙂", "中", "\r", "</s>", "<0x0A>", "1", "23", "the", "ing", " the", "The "]
    return ["".join(rng.choice(units) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def real_texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def counter():
    with open(tokens.PIECE_BPE, "rb") as f:
        return token_counts.PrefixCounts(f.read()), sentencepiece.SentencePieceProcessor(model_file=tokens.PIECE_BPE)


def test_counts_at_every_prefix(counter):
    ours, library = counter
    for text in some_texts(300) + [t for t in ODD if t]:
        text = text[:200]
        assert [ours.at_prefix(text, k) for k in range(len(text) + 1)] == [len(library.encode(text[:k])) for k in range(len(text) + 1)], text


def test_budget_gives_the_longest_prefix(counter):
    ours, library = counter
    for k, text in enumerate(some_texts(200, 9)):
        sizes = [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert ours.fit(text, k % 12) == max(i for i, n in enumerate(sizes) if n <= k % 12), text


def test_counts_of_texts(spark, counter, real_texts):
    texts = ODD + some_texts(50) + real_texts
    rows = token_counts.token_counts(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [len(counter[1].encode(t or "")) for t in texts]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 4096) for r in rows)
    assert token_counts.token_counts(frame(spark, [])).count() == 0


def test_truncated_keeps_columns(spark, counter):
    texts = ["one two three four", None, ""]
    rows = token_counts.truncated(frame(spark, texts), 3).orderBy("doc_id").collect()
    assert [r.source for r in rows] == ["s"] * 3 and rows[1].text is None and rows[2].text == ""
    assert len(counter[1].encode(rows[0].text)) <= 3 and texts[0].startswith(rows[0].text)


@pytest.mark.parametrize("path,parts,plain", [(tokens.WORD_BPE, "word_parts", False), (tokens.BYTE_BPE, "run_parts", True)])
def test_ids_through_parts(path, parts, plain, real_texts):
    with open(path, "rb") as f:
        ours = tokens.PartIds(f.read(), parts, "I", plain)
    ours.MOST = 50
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    texts = [t or "" for t in ODD] + some_texts(400) + real_texts[:60]
    for at in range(0, len(texts), 37):
        some = texts[at:at + 37]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def placed_whole(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_exact(spark, real_texts):
    texts = ODD + real_texts + ["word " * 9000, None]
    docs = frame(spark, texts)
    docs = docs.union(docs.where("doc_id < 3")).union(docs.where("doc_id = 4").selectExpr("null", "text", "lang", "source", "n_chars", "length", "rank"))
    rows = packing.pack(docs).collect()
    library = Tokenizer.from_file(tokens.WORD_BPE)
    want = []
    for doc, text in [*enumerate(texts), *((i, texts[i]) for i in range(3)), (None, texts[4])]:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(doc, k, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]

    def key(x):
        return (x[0] is None, x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None)) == sorted(w for w in want if w[0] is not None)
    assert sum(r.doc_id is None for r in rows) == 1
    used, total = placed_whole(rows, 4096), sum(r.length for r in rows)
    assert used <= -(-total // 4096) + 2
    assert packing.pack(frame(spark, [])).count() == 0


def test_rules_place_every_rank_once():
    rng = random.Random(5)
    for case in range(40):
        p = packing.Packing(capacity=rng.choice([16, 60, 256]), groups=rng.choice([(3,), (8,), (4, 20)]), large=rng.choice([4, 8]))
        lengths = rng.choices(range(1, p.capacity + 1), k=rng.randint(1, 12))
        counts = {n: rng.choice([1, 2, 7, 100, 12345]) for n in lengths}
        rules, made = packing.plan(counts, p)
        room, ranks = {}, {n: [] for n in counts}
        for length, rank, count, each, sequence, offset in rules.tolist():
            ranks[length].append((rank, count))
            whole, rest = divmod(count, each)
            for first, n, k in ((sequence, whole, each), (sequence + whole, 1 if rest else 0, rest)):
                if n:
                    room.setdefault(offset, []).append((first, n, offset + k * length))
        for n, spans in ranks.items():
            at = 0
            for rank, count in sorted(spans):
                assert rank == at
                at += count
            assert at == counts[n]
        if sum(counts.values()) < 30_000:
            bins = {}
            for length, rank, count, each, sequence, offset in rules.tolist():
                for k in range(count):
                    bins.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
            for spans in bins.values():
                at = 0
                for offset, length in sorted(spans):
                    assert offset == at
                    at += length
                assert at <= p.capacity
            assert len(bins) == made
            plain = len(binary_output.best_fit(sorted((n for n, c in counts.items() for _ in range(c)), reverse=True), p.capacity))
            large = sum(c for n, c in counts.items() if n > p.capacity // p.large)
            assert made <= 1.05 * plain + large / p.groups[-1] + p.groups[-1]


def test_matrices_do_not_depend_on_partitions(spark):
    """Texts of many tokens a character: shares hold far more than their characters let expect."""
    rng = random.Random(8)
    rows = [(i if i % 9 else None, rng.choice(["", None, "🙂", *("🙂🦜𝒳" * rng.randint(1, 60) for _ in range(9))])) for i in range(600)]
    rows += [(i, f"other text {i}") for i in range(40)] + [(3, "🙂" * 50)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = binary_output.Matrices(length=64, share_rows=16)
    first, second = (sorted(map(str, binary_output.matrices(d, p).collect())) for d in (
        docs.coalesce(1), spark.createDataFrame(rows[::-1], docs.schema).repartition(7)))
    assert first == second and len(first) > 16


def test_matrices_round_trip(spark, real_texts):
    texts = ODD + real_texts[:80]
    p = binary_output.Matrices(length=256, share_rows=16)
    rows = binary_output.matrices(frame(spark, texts), p).collect()
    library = Tokenizer.from_file(tokens.BYTE_BPE)
    library.encode_special_tokens = True
    found = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens:] == p.end_id).all()
        for doc, start, s, e in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            found.setdefault(doc, {})[start] = ids[s:e].tolist()
            assert positions[s:e].tolist() == list(range(e - s))
    for doc, text in enumerate(texts):
        assert sum((found[doc][s] for s in sorted(found[doc])), []) == library.encode(text or "", add_special_tokens=False).ids + [p.end_id]
    assert len({(r.share, r.row) for r in rows}) == len(rows)
    assert binary_output.digested(binary_output.matrices(frame(spark, []))).count() == 0


def test_best_fit_decreasing_equals_a_plain_one():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.randint(3, 60)
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 80))), reverse=True)
        room = []
        for n in lengths:
            fits = [r for r in room if r >= n]
            if not fits:
                room.append(capacity)
            room[room.index(min(fits)) if fits else -1] -= n
        assert sorted(capacity - sum(lengths[i] for i in row) for row in binary_output.best_fit(lengths, capacity)) == sorted(room)


UNITS = ["<", "s", ">", "/", "[", "]", "INST", "\\", "</s>", "[INST]", "[/INST]", "<s>", "a", "\n", "é"]


def test_template_reads_back():
    rng = random.Random(2)
    for _ in range(5000):
        role, text = ("".join(rng.choice(UNITS) for _ in range(rng.randint(0, 9))) for _ in range(2))
        formatted, starts, ends = chat.render([(role, text), ("assistant", text)], "assistant")
        assert chat.parse(formatted) == [(role, text), ("assistant", text)]
        assert chat.unescape(formatted[starts[-1]:ends[-1]]) == text


TURNS = "conv_id long, turn long, role string, text string, formatted string, segment int"


def want_digest(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    return len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()


@pytest.mark.parametrize("limits", [chat.Chat(), chat.Chat(turns=3, slice_rows=2)])
def test_conversations(spark, limits):
    rng = random.Random(4)
    talks = {c: [(rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice([None, "", "ok", "".join(rng.choice(UNITS) for _ in range(20)), "多字节 🙂."]))
                 for _ in range(rng.randint(1, 9))] for c in [None, -5, *range(30)]}
    rows = [(c, i, r, t, "x", 1) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    frame_ = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in chat.digested(*chat.formatted(frame_, limits)).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want_digest(turns), c
        assert got[c].formatted_chars == len(chat.render([(r or "", t or "") for r, t in turns], "assistant")[0])
    assert chat.digested(*chat.formatted(frame_.limit(0))).count() == 0


@pytest.mark.parametrize("path", ["BYTE_BPE", "WORD_BPE"])
def test_segments_have_the_ids_offsets_and_mask_of_the_whole(spark, path):
    rng = random.Random(5)
    said = ["", None, "ok", " lead", "trail ", "</s", ">", "s>", "</s>[INST]", "it's", "'s", "\u0338x", "x\n\n ", "多字节 🙂.", "<s", "[", "\\"]
    rows = [(c, i, rng.choice(["user", "assistant", "s", "", ">", None]), "".join(rng.choice(said) or "" for _ in range(rng.randint(0, 3))), "", 0)
            for c in range(6) for i in range(rng.randint(4, 60))]
    frame_ = spark.createDataFrame(rows, TURNS)
    file, numbers = getattr(chat.tokens, path), {"ids": "<u4", "starts": "<i4", "ends": "<i4", "mask": np.uint8}
    whole, none = chat.formatted(frame_, path=file)
    assert none.count() == 0
    want = {r.conv_id: r for r in whole.collect()}
    ends = list(chat.Encoder(open(file, "rb").read())([chat.FRONT, chat.BACK]))
    for parts, limits in ((1, chat.Chat(turns=3, slice_rows=7)), (5, chat.Chat(turns=3, slice_rows=2))):
        short, hot = chat.formatted(frame_.repartition(parts), limits, path=file)
        assert short.count() == 0
        cut = {}
        for r in hot.collect():
            cut.setdefault(r.conv_id, []).append(r)
        assert set(cut) == set(want) and all(len(v) > 1 for v in cut.values())
        for c, segments in cut.items():
            segments.sort(key=lambda r: r.segment)
            text, got = chat.FRONT, {"ids": [ends[0][0]], "starts": [ends[0][1]], "ends": [ends[0][2]], "mask": [np.zeros(len(ends[0][0]), np.uint8)]}
            spans = []
            for r in segments:
                for name, kind in numbers.items():
                    found = np.frombuffer(r[name], kind)
                    got[name].append(found + len(text) if name in ("starts", "ends") else found)
                spans += [(s + len(text), e + len(text)) for s, e in zip(r.loss_starts, r.loss_ends)]
                text += r.formatted
            for name, found in zip(("ids", "starts", "ends", "mask"), (*ends[1], np.zeros(len(ends[1][0]), np.uint8))):
                got[name].append(found + len(text) if name in ("starts", "ends") else found)
            assert text + chat.BACK == want[c].formatted
            assert spans == list(zip(want[c].loss_starts, want[c].loss_ends))
            for name, kind in numbers.items():
                assert np.concatenate(got[name]).tolist() == np.frombuffer(want[c][name], kind).tolist(), (c, name)


def test_mask_covers_the_loss_tokens(spark):
    rows = [(0, 0, "user", "hi", "", 0), (0, 1, "assistant", "...well, yes", "", 0)]
    row = chat.formatted(spark.createDataFrame(rows, TURNS))[0].first()
    starts, ends, mask = (np.frombuffer(row[n], t) for n, t in (("starts", "<i4"), ("ends", "<i4"), ("mask", np.uint8)))
    s, e = row.loss_starts[0], row.loss_ends[0]
    assert row.formatted[s:e] == "...well, yes"
    assert mask.astype(bool).tolist() == [bool(b > s and a < e) for a, b in zip(starts, ends)]
    assert len(row.ids) == 4 * len(mask)
