"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can be the last of the
prefix's encoding. An automaton over the vocabulary gives the tokens that
end at each place, longest first; a candidate is the one if it is
compatible with the last token of the prefix before it: encoding the two
tokens' joined text would give the same two tokens. Back-pointers from the
end of the word then give the exact ids, with no merge loop.

Words come from the tokenizer's own normaliser and pre-tokenizer. For texts
of Latin letters (FAST) an equal rule in Python stands in for them, and the
ids of each white-space separated chunk are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, pick, slices

#: Stands for the end of a word inside the automaton.
END = "\ue000"
#: Chunks in each of a cache's two generations; some 0.2 KB each.
CACHE_WORDS = 400_000
#: The same beside the encoder of this module, which holds tables of its own.
OWN_CACHE_WORDS = 200_000
CACHE_PAIRS = 500_000
#: Unknown chunks that the library gets in one text; it is slower on long ones.
CHUNKS_AT_ONCE = 256
LATIN = range(0x180)
#: Texts without these are split by Python's rules, else by the tokenizer's.
NOT_FAST = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in LATIN if unicodedata.category(chr(c))[0] == kind)


_LETTER, _NUMBER = _latin("L"), _latin("N")
#: The pre-tokenizer's pattern, for lower-cased Latin texts.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: the
    printable bytes of Latin-1 stand for themselves, others for the letters
    from U+0100 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    other = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + other.index(b)) for b in range(256)]


class Bpe:
    """The vocabulary and the per-prefix encoder of one tokenizer file."""

    def __init__(self, data: bytes):
        model = json.loads(data)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.added: dict[str, int] = {t["content"]: t["id"] for t in json.loads(data)["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token = [""] * size
        for text, i in [*vocab.items(), *self.added.items()]:
            self.token[i] = text
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[int, int] = {}
        self.size = size
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pair[i * size + j] = rank
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = rank, i, j
        self.known: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if not self._reachable(i):
                continue
            word_end = suffix and text.endswith(suffix)
            spelt = text[: -len(suffix)] + END if word_end else text
            self.automaton.add_word(spelt, (i, len(spelt)))
        self.automaton.make_automaton()
        self.end = END if suffix else ""
        self.letters = byte_letters()
        self.bytes_to_letters = {b: c for b, c in enumerate(self.letters)}

    def _reachable(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        if self.rank[token] < 0:
            return True
        a, b = self.left[token], self.right[token]
        return self._holds(a, b, self.rank[token]) and self._reachable(a) and self._reachable(b)

    def _holds(self, a: int, b: int, until: int) -> bool:
        """Whether no merge before rank ``until`` crosses from a to b: the later
        of the two tokens' merges is undone again and again, and each pair that
        met at the border must not have had an earlier merge of its own."""
        rank, pair, size = self.rank, self.pair, self.size
        while True:
            crossing = pair.get(a * size + b)
            if crossing is not None and crossing < until:
                return False
            if rank[a] > rank[b]:
                until, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                until, b = rank[b] + 1, self.left[b]  # of equal merges the left one goes first
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= CACHE_PAIRS:
                self.known.clear()
            found = self.known[key] = self._holds(a, b, 1 << 60)
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, spelt in byte letters."""
        if not word:
            return []
        spelt = word + self.end
        last = [-1] * (len(spelt) + 1)
        start = [0] * (len(spelt) + 1)
        compatible = self.compatible
        for at, (token, length) in self.automaton.iter(spelt):
            if last[at + 1] >= 0:
                continue
            before = at + 1 - length
            if not before or last[before] >= 0 and compatible(last[before], token):
                last[at + 1], start[at + 1] = token, before
        ids = []
        at = len(spelt)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary can't spell {word!r}")
            ids.append(last[at])
            at = start[at]
        return ids[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        return self.encode_word(piece.encode().decode("latin-1").translate(self.bytes_to_letters))


class ChunkCache(dict):
    """Chunk of text -> its ids as bytes.

    When it is full, what it holds becomes the older generation and the one
    before is dropped; a chunk that is met again moves to the younger one. So
    frequent chunks stay and at most twice ``limit`` are held.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self.hold(chunk, ids)
        return ids

    def hold(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class TextEncoder:
    """Whole texts to ids (bytes of little-endian unsigned 32-bit integers)."""

    def __init__(self, data: bytes, by_library: bool = False, held: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted((t["content"] for t in json.loads(data)["added_tokens"]), key=len, reverse=True)
        # By the library, the lower-cased chunk of an added token in capitals would be that token.
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")", re.IGNORECASE if by_library else 0) if added else None
        self.by_library = by_library
        if by_library:
            suffix = json.loads(data)["model"].get("end_of_word_suffix")
            self.model = None
            if suffix:
                # The library's model alone, for words that are split and spelt in byte letters.
                self.model = Tokenizer.from_str(json.dumps(json.loads(data) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}))
                vocab = self.library.get_vocab()
                self.closes = np.zeros(max(vocab.values()) + 1, bool)
                self.closes[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
                self.to_letters = {b: c for b, c in enumerate(byte_letters()) if b != 32}
            self.chunks = ChunkCache(lambda chunk: packed(self.library.encode(chunk, add_special_tokens=False).ids), held)
        else:
            self.bpe = Bpe(data)
            self.chunks = ChunkCache(lambda chunk: packed([i for piece in PIECES.findall(chunk) for i in self.bpe.encode_piece(piece)]), OWN_CACHE_WORDS)
            self.words = ChunkCache(lambda word: packed(self.bpe.encode_word(word)), OWN_CACHE_WORDS)

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if _fast(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        if self.by_library:
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        normal = self.library.normalizer.normalize_str(text)
        return b"".join(self.words[word] for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))

    def __call__(self, text: str) -> bytes:
        if "<|" in text and self.special is not None and self.special.search(text):
            if self.by_library:
                return packed(self.library.encode(text, add_special_tokens=False).ids)
            return b"".join(packed([self.bpe.added[part]]) if part in self.bpe.added else self.plain(part) for part in self.special.split(text))
        return self.plain(text)


    def _new(self, chunks: list[str]) -> list[bytes]:
        """Ids of each of these few chunks, by one call of the library's model: their
        words are joined, and a chunk's ids are told by the number of its words, as
        each word has one closing token."""
        words = [[c] if c.isalpha() else PIECES.findall(c) for c in map(str.lower, chunks)]
        joined = " ".join(chain.from_iterable(words))
        if not joined.isascii() or not joined.isprintable():
            joined = joined.encode().decode("latin-1").translate(self.to_letters)
        ids = np.array(self.model.encode(joined, add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        number = np.cumsum([0, *map(len, words)])
        if len(ends) != number[-1] or len(ids) and ends[-1] != len(ids):
            return list(map(self.chunks.encode, chunks))
        at, blob = (4 * np.concatenate([[0], ends])[number]).tolist(), ids.tobytes()
        return [blob[a:b] for a, b in pairwise(at)]

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks: held ones, else found together and held."""
        found = list(map(self.chunks.get, chunks))
        new, plain = [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.chunks.older.get(chunks[i])
            if found[i] is None and (self.model is None or len(chunks[i]) > 64 or "<|" in chunks[i]):
                found[i] = self.chunks.encode(chunks[i])
            elif found[i] is None:
                plain.append(i)
            new.append(i)
        for at in range(0, len(plain), CHUNKS_AT_ONCE):
            some = plain[at : at + CHUNKS_AT_ONCE]
            for i, ids in zip(some, self._new([chunks[i] for i in some]), strict=True):
                found[i] = ids
        for i in new:
            self.chunks.hold(chunks[i], found[i])
        return found

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers, by the library. Each
        different chunk of the texts is looked up once; unknown ones are encoded together."""
        whole = ["<|" in x and self.special is not None and self.special.search(x) is not None or not _fast(x) for x in texts]
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(["" if w else x for x, w in zip(texts, whole, strict=True)], pa.string())))
        coded = split.flatten().dictionary_encode()
        blobs = self._ids_of(coded.dictionary.to_pylist())
        n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        own, count = np.frombuffer(b"".join(blobs), "<u4"), n[coded.indices.to_numpy()]
        ends = np.cumsum(count)
        ids = own[np.arange(count.sum()) + np.repeat((np.cumsum(n) - n)[coded.indices.to_numpy()] - (ends - count), count)]
        last = np.concatenate([[0], ends])[np.cumsum(split.value_lengths().to_numpy())].tolist()
        return [np.frombuffer(self(x), "<u4") if w else ids[a:b] for x, w, a, b in zip(texts, whole, [0, *last], last)]


def _fast(text: str) -> bool:
    return text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") or not NOT_FAST.search(text)


_kept: dict[tuple[str, bool, int], TextEncoder] = {}


def encoder(data: bytes, by_library: bool = False, held: int = CACHE_WORDS) -> TextEncoder:
    """The worker's encoder of this tokenizer, made once in its life. By the library,
    each generation of its cache holds ``held`` chunks."""
    key = (hashlib.sha256(data).hexdigest(), by_library, held)
    if key not in _kept:
        _kept[key] = TextEncoder(data, by_library, held)
    return _kept[key]


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ``ids`` is binary, little-endian
    unsigned 32-bit integers. ``tokenizer`` is the path of a byte-level BPE file.

    A null text counts as empty and has no ids. Every row gives a row, repeated
    or not, whatever its doc_id. The work is map-side and takes no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(model.value)
        for part in slices(batches):
            ids = [to_ids(x or "") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = pick(docs, doc_id="doc_id", text=text)
    return arrow_map(rows, run, f"doc_id {rows.dtypes[0][1]}, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of the rows that ``encode`` gives.

    The tokenizer files in use name no decoder; their library then joins the
    tokens' texts with blanks, special ones included. Null ids decode to an
    empty text.
    """
    data = open(tokenizer, "rb").read()
    if json.loads(data).get("decoder") is not None:
        raise ValueError("only tokenizers without a decoder are supported")
    model = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = encoder(model.value).bpe.token
        for part in slices(batches):
            texts = [" ".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = pick(encoded, doc_id="doc_id", n_tokens="n_tokens", ids="ids")
    return arrow_map(rows, run, f"doc_id {rows.dtypes[0][1]}, n_tokens long, ids binary, decoded string")
