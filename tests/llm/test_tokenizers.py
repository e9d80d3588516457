import hashlib
import random
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.llm import bpe, packing, token_counts

BPE, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "a", "The and attion to thanedble the, anea.", "it's we'll I'm they'd 12345 !!!&&&", "x\n\ny\t z\r\x0b\x0cq",
    "É è ñandú Straße İstanbul ſ ŉ", "日本語 тест ελληνικάς Σ", "a<|endoftext|>b<|startoftext|> c <|endof", "a\x1cb\x1fc\x85d\xa0e f",
    "é é ＡＢ ﬁ", "😀👍🏽 zero​width", "'s'S 's's ''", "x" * 3000, "ab" * 2000, "\x00\x01 nul", "▁▁a ▁b▁", "  two  spaces ", "end \n start", "\n", " \n ",
    "Orre " * 500, "<s> </s> <unk> <0x0A>", "tab\tinside　wide", "aaaa aaa aaaaa aaaaaaaa", "!!!!!!! ??? ...... ......",
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(1, "again", "x", 0), (1, "again", "x", 0), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids long").repartition(3)


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoder_equals_library_on_every_latin_letter():
    ours, own = bpe.TextEncoder(open(BPE, "rb").read()), library()
    for c in range(0x2000):
        if 0xD800 <= c < 0xE000:
            continue
        for text in (chr(c), f"a{chr(c)}b", f"1{chr(c)} {chr(c)}{chr(c)}'s"):
            assert np.frombuffer(ours(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdefghionrst '.,!"), st.characters(codec="utf-8")), max_size=60))
def test_encoder_equals_library(text):
    ours, own = bpe.encoder(open(BPE, "rb").read()), library()
    assert np.frombuffer(ours(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_prefixes_of_random_words():
    ours, own = bpe.encoder(open(BPE, "rb").read()), library()
    pick = random.Random(5)
    words = ["".join(pick.choice("aeinorstth") for _ in range(pick.randint(1, 40))) for _ in range(2000)]
    for word in words:
        assert ours.bpe.encode_piece(word) == own.encode(word, add_special_tokens=False).ids


def test_encode_and_decode(spark, frame):
    own = library()
    got = sorted(map(tuple, bpe.decode(bpe.encode(frame, BPE), BPE).select("doc_id", "n_tokens", "ids", "decoded").collect()), key=str)
    want = []
    for doc, text, *_ in frame.collect():
        ids = own.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), np.array(ids, "<u4").tobytes(), own.decode(ids, skip_special_tokens=False)))
    assert [(a, b, bytes(c), d) for a, b, c, d in got] == sorted(want, key=str)
    assert bpe.decode(bpe.encode(frame.limit(0), BPE), BPE).count() == 0


def test_token_counts(spark, frame):
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=PIECE)
    got = sorted(map(tuple, token_counts.count_tokens(frame, PIECE, limit=20).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(own.encode(t or "")), n > 20) for d, t, *_ in frame.collect()]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(frame.limit(0), PIECE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abe  \n▁.,"), st.characters(codec="utf-8")), max_size=60))
def test_counter_equals_library(text):
    from sentencepiece import SentencePieceProcessor

    ours = token_counts.counter(open(PIECE, "rb").read(), {"the": 1})
    assert ours(text) == len(SentencePieceProcessor(model_file=PIECE).encode(text))


@pytest.mark.parametrize("window", [7, 64, 4096])
def test_packing_is_a_partition_of_the_stream(spark, frame, window):
    own = library()
    pieces = packing.pack(frame, BPE, window=window).collect()
    rows = sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in rows:
        assert r["sequence_id"] * window + r["offset"] == at and 0 < r["length"] <= window - r["offset"]
        at += r["length"]
    unused = [own.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in frame.collect()]
    assert sum(map(len, unused)) == at
    ids: list[int] = []
    for r in rows:
        assert (r["start"] == 0) == (not ids)
        assert r["start"] == len(ids)
        ids += np.frombuffer(r["ids"], "<u4").tolist()
        if len(ids) == r["doc_tokens"]:
            unused.remove(ids)
            ids = []
    assert not unused and not ids
    sums = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packing.checksums(packing.pack(frame, BPE, window=window)).collect()}
    assert sums == {(r["sequence_id"], r["offset"]): crc32(r["ids"]) for r in rows}
    assert packing.pack(frame.limit(0), BPE).count() == 0


def test_shas_of_ids_are_those_of_little_endian_integers():
    ours = bpe.encoder(open(BPE, "rb").read())
    assert hashlib.sha256(ours("the the")).hexdigest() == hashlib.sha256(np.array(library().encode("the the", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def test_packing_odd_rows(spark):
    rows = [(None, None, 1), (3, "", 2), (3, "same text", 3), (3, "same text", 4), (4, "long word " * 9000, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, DOC_ID int")
    pieces = packing.pack(frame, P.path("word_bpe_49k.json")).collect()
    assert sum(r["length"] for r in pieces) == sum({(r["doc_id"], r["sequence_id"], r["offset"]): r["length"] for r in pieces}.values())
    assert {r["doc_id"] for r in pieces} == {None, 3, 4} and sum(r["start"] == 0 for r in pieces) == 5
    assert packing.pack(frame.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_texts_encoded_together_equal_the_library():
    data = open(BPE, "rb").read()
    own, pick = library(), random.Random(41)
    letters = "abcXYZ' \n\t.,;!?0123\x1c\x1f\x00\x85\xa0²½éÀßŉſİı<|>é日😀ªº-_'s"
    texts = ["", " ", "a <|ENDOFTEXT|> b", "<|EndOfText|>", "<|endoftext|>x", "<| endoftext |>", "x" * 100 + " Y", "It'S 'Re 'll"]
    texts += ["".join(pick.choice(letters[: pick.choice([24, 40, len(letters)])]) for _ in range(pick.randint(0, 80))) for _ in range(1500)]
    coder = bpe.TextEncoder(data, by_library=True)
    coder.chunks.limit = 300  # generations come and go
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], coder.all(texts[at : at + 500]), strict=True):
            assert ids.tolist() == own.encode(text, add_special_tokens=False).ids, text
    assert np.frombuffer(coder("a <|ENDOFTEXT|> b"), "<u4").tolist() == own.encode("a <|ENDOFTEXT|> b", add_special_tokens=False).ids


def test_unknown_chunks_are_encoded_in_few_calls():
    data = open(BPE, "rb").read()
    coder = bpe.TextEncoder(data, by_library=True)
    calls, held = [], coder.library

    class Counted:
        def encode(self, text, **more):
            calls.append(text)
            return held.encode(text, **more)

    coder.library = Counted()
    coder.all([" ".join(f"word{'abcdefghij'[i % 10]}{i}." for i in range(j, j + 400)) for j in range(0, 4000, 400)])
    assert len(calls) <= 20


def test_packing_with_a_small_cache_gives_the_same(spark, frame):
    data = open(BPE, "rb").read()
    coder, own = bpe.encoder(data, by_library=True, held=50), library()
    texts = [f"words {'abcdefghij'[i % 10] * (i % 37)} and number{i} of many" for i in range(600)]
    assert [x.tolist() for at in range(0, 600, 100) for x in coder.all(texts[at : at + 100])] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(coder.chunks) <= 50 and 0 < len(coder.chunks.older) <= 50
    assert coder is not bpe.encoder(data, by_library=True)
    assert sorted(map(tuple, packing.pack(frame, BPE, held=3, at_once=2).collect()), key=str) == sorted(map(tuple, packing.pack(frame, BPE).collect()), key=str)
