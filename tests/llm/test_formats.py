"""Chat formatting, token counts, packing, media."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayfold.llm import chat, common, media, packing, tokens, webp

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello, world's end! été Œuvre", None, "", "  a\tb\n\nc ", "x" * 5000, "Σας ΑΣ İ", "a<|endoftext|>b <|startoftext|>", "12 3a4 _x_ 你好\x1cz\xa0q", "the the the " * 900, "the the the " * 900]
DOCS = "doc_id long, text string, n_tokens string, key string"


def docs(spark, texts=TEXTS, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "clash", "clash") for k, t in enumerate(texts)], DOCS)


def test_chat_round_trip(spark):
    hard = ["\\", "<|turn|>", "a<|end|>b", "</s>[INST] x [/INST]", "\\<|body|>\\\\", "|><|", "été 😀", "", "<<SYS>>"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "sys<|tem"]), "".join(rng.choices(hard, k=3))) for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, "assistant", None), (100, 1, None, "x"), (None, 0, "user", "no id"), (101, None, "assistant", "null turn"), (102, 0, "user", "same"), (102, 0, "user", "same"), (103, 0, "assistant", "long " * 3000), (103, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, segment string")
    for size in (1 << 20, 4000):
        got = {r.conv_id: r for r in chat.digests(chat.format_chats(df, BYTES, segment_chars=size), BYTES).collect()}
        want = {}
        for c, t, role, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1], (r[2] or "").encode(), (r[3] or "").encode())):
            want.setdefault(c, []).append((role or "", text or ""))
        assert got.keys() == want.keys()
        for c, turns in want.items():
            loss = "".join(t for r, t in turns if r == "assistant")
            assert got[c].n_turns == len(turns)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0), BYTES).count() == 0


def test_masked_tokens_are_those_of_the_texts_alone():
    t = chat.ChatTemplate()
    formatted, spans = t.render([("user", "hi there"), ("assistant", "well <|end|> yes"), ("assistant", "")])
    e = chat.chat_tokenizer(BYTES, t).encode(formatted, add_special_tokens=False)
    mask = chat.loss_mask(spans, e.offsets)
    covered = "".join(formatted[a:b] for (a, b), m in zip(e.offsets, mask, strict=True) if m)
    assert t.unescaped(covered) == "well <|end|> yes"


def test_token_counts_are_the_library_s(spark):
    plain = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in tokens.count_tokens(docs(spark), WORDS, limit=100).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 100)
    assert tokens.count_tokens(docs(spark).limit(0), WORDS).count() == 0


def test_encoder_agrees_on_odd_texts():
    plain, own = Tokenizer.from_file(WORDS), tokens.encoder(WORDS)
    rng = random.Random(5)
    letters = list("abcEÉéßŸ ,.'!-_1\t\n<|>") + ["'s", "'re", "<|endoftext|>", "İ", "é", "你", "​", "\x85", "𝒜"]
    for _ in range(400):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        chunks = tokens.chunks_of(text)
        assert np.frombuffer(b"".join(own.encode(chunks)), own.unit).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_merges_equal_the_library():
    plain, own = Tokenizer.from_file(WORDS), tokens.Merges.of(tokens.tokenizer(WORDS))
    rng = random.Random(8)
    words = [c * n for c in "aeéßñ" for n in range(1, 40)] + ["".join(rng.choices("etaoinshréüñß", k=rng.randint(1, 30))) for _ in range(5000)]
    which, sizes, ids = own.ids(words)
    got = dict(zip(which.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
    assert [got[k].tolist() for k in range(len(words))] == [e.ids for e in plain.encode_batch(words, add_special_tokens=False)]
    assert tokens.Merges.of(Tokenizer.from_file(BYTES)) is None  # no word ends: the library is used


def test_words_are_learnt_again_after_the_table_was_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 3)
    own, plain = tokens.ChunkEncoder(WORDS), Tokenizer.from_file(WORDS)
    for chunks in (["one", "two"], ["two", "three", "four"], ["one", "five", "two", "six", "seven"]):
        assert [np.frombuffer(x, own.unit).tolist() for x in own.encode(chunks)] == [plain.encode(c, add_special_tokens=False).ids for c in chunks]


def test_packing(spark):
    plain = Tokenizer.from_file(WORDS)
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None]
    rows = packing.pack(docs(spark, ids=ids), WORDS, length=64).collect()
    want = {k: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for k, t in zip(ids, TEXTS, strict=True)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        own = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(own), zlib.crc32(own.tobytes()), r.doc_tokens) == (r.length, r.ids_crc32, len(want[r.doc_id]))
    for d, x in want.items():
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        assert sum(p.length for p in pieces) == len(x)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1]]
        assert sum(p.length for p in s) <= 64
    assert len(by_seq) == -(-sum(map(len, want.values())) // 64)
    assert packing.pack(docs(spark).limit(0), WORDS).count() == 0


def test_hilbert_curve_is_one_path():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_webp_tools_round_trip():
    rng = np.random.default_rng(1)
    for trial in range(40):
        w, h = int(rng.integers(1, 24)), int(rng.integers(1, 20))
        pal = rng.integers(0, 1 << 32, int(rng.choice([2, 3, 7, 16, 40])), dtype=np.uint64).astype(np.uint32)
        px = np.repeat(pal[rng.integers(0, len(pal), w * h)], 2)[: w * h]
        kinds = tuple(int(k) for k in rng.permutation(3)[: rng.integers(0, 4)])
        if rng.random() < 0.5:
            kinds = (webp.PALETTE, *kinds)
        f = webp.encode(px, w, kinds, cache_bits=int(rng.choice([0, 1, 4, 11])), references=bool(trial % 2), meta_bits=int(rng.choice([0, 2])), seed=trial)
        got = webp.decode(f)
        assert got[:2] == (w, h) and (got[2] == px).all()


def test_predictors_by_hand():
    left, top, right, corner = [[v] * 4 for v in (10, 20, 31, 40)]
    want = {1: 10, 2: 20, 3: 31, 4: 40, 5: (((10 + 31) >> 1) + 20) >> 1, 6: 25, 7: 15, 8: 30, 9: 25, 10: (25 + 25) >> 1, 12: 0, 13: 15 - 12}
    for mode, v in want.items():
        assert webp.predicted(mode, left, top, right, corner)[0] == v, mode
    assert webp.predicted(11, left, top, right, corner) == left  # left + top - corner is nearer to left


def test_damaged_files_are_refused():
    f = webp.encode_bytes(bytes(range(192)), 64)
    for bad in (b"", f[:30], b"RIFF" + f[4:40], f[:21] + b"\xff" * 30):
        assert media._decoded([bad])[2] is None and media._decoded([bad])[3]


def test_samples_are_stored_by_codes_of_their_own():
    rng = np.random.default_rng(4)
    few = bytes(rng.choice(np.frombuffer(b"QXZ\x07", np.uint8), 19_200))  # letters that are rare elsewhere
    line = bytes(rng.integers(0, 256, 576, dtype=np.uint8))
    grey = np.repeat(rng.integers(0, 256, 6400, dtype=np.uint8), 3).tobytes()
    words = " ".join(rng.choice(["ride", "группа", "über", "node"], 3000)).encode()
    words += b" " * (-len(words) % 192)
    for data, most in ((few, 0.30), (line * 40, 0.05), (grey, 0.40), (words, 0.35), (b"ab" * 96, 0.35), (bytes(192 * 700), 0.01)):
        stored = webp.encode_bytes(data, 64)
        assert len(stored) < most * len(data)
        assert media._decoded([stored])[2] == data
    for size in (1, 2, 3, 50):
        data = bytes(rng.integers(0, 256, 192 * size, dtype=np.uint8))
        assert media._decoded([webp.encode_bytes(data, 64)])[2] == data
        for kinds, cache, refs in ((), 0, False), ((2,), 5, True), ((0, 1), 11, True):
            px = np.frombuffer(data, np.uint8).astype(np.uint32)[: 64 * size] % 9
            assert (webp.decode(webp.encode(px, 64, kinds, cache, refs))[2] == px).all()


def test_media(spark):
    stored = media.store_bytes(media.text_of(docs(spark), "doc_id"))
    got = {r.doc_id: r for r in media.media_digests(media.decode_media(stored, ("doc_id", "n_bytes"))).collect()}
    for k, t in enumerate(TEXTS):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes > 0 and r.feature.startswith("64x")
    assert got[8].media_sha256 == got[9].media_sha256 and got[8].feature == got[9].feature
    assert media.store_bytes(media.text_of(docs(spark).limit(0), "doc_id")).count() == 0


def test_long_texts_take_several_frames(spark, monkeypatch):
    data = bytes(range(256)) * 60
    frames = [webp.encode_bytes(data[:9600], 64), webp.encode_bytes(data[9600:], 64)]
    assert media._decoded(frames)[:3] == (64, len(data) // 192, data)
    other = webp.encode(np.zeros(4, np.uint32), 2)
    assert media._decoded([frames[0], other])[3] == "frames differ in width"
    with pytest.raises(webp.WebpError):
        webp.encode_bytes(data[:100], 64)


def test_words_and_marks_are_told_apart_as_before():
    plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?%&$#*;:]*)")
    rng = random.Random(3)
    signs = "abZéßÿÀ×÷.,!?%&$#*;:'-_09ªµµĀж中\u0301\u200b\x0b\x1f"
    for c in ["", "a", ".", "Word", "Éa!?", "a.b", "don't", *("".join(rng.choices(signs, k=rng.randint(0, 5))) for _ in range(20_000))]:
        m = plain.fullmatch(c)
        assert tokens.word_and_marks(c) == ((m[1].lower(), m[2]) if m else None), c
    for text in ["", " ", "\n", "a\r\n\tb  c\x0bd\u2028e", "x\n"]:
        assert common.chunks_of(text) == re.sub(r"[\n\r\t]", " ", text).split(" ")


def test_a_batch_looks_up_its_own_chunks_only():
    class Table(common.ChunkTable):
        def __iter__(self):
            raise AssertionError("the whole table was read")

    table = Table(lambda new: map(len, new), {"": 0}, entries=5)
    table.learn([["a", "bb"], ["bb", ""]])
    table.learn([["ccc", "a"]])
    assert table["a"] == 1 and table["bb"] == 2 and table["ccc"] == 3
    table.learn([["dddd", "a", "e", "f"]])  # past its entries: down to the fixed part
    assert "bb" not in table and table[""] == 0 and table["dddd"] == 4 and table["a"] == 1
