"""Token counts by a two-tier lookup of pre-token lengths, map-side.

No piece of the vocabulary goes on from another letter into a blank, and none
holds a line break, so merges never cross from one pre-token (blanks and what
follows up to the next blank or line break) to the next: a text's count is
the sum of its pre-tokens' counts. The first tier is a broadcast table of
frequent pre-tokens; misses are encoded by the library and kept in the
worker's bounded cache. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, slices

#: Bounds of the first tier: entries, and documents looked at for them with
#: their length. They change the speed only; a pre-token that the table lacks is encoded exactly.
TABLE_WORDS = 50_000
TABLE_DOCS = 2_000
TABLE_DOC_CHARS = 20_000
CACHE_WORDS = 500_000
BLANK = "▁"
RUNS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Lengths(dict):
    """Pre-token -> tokens; a miss is encoded, and kept while there is room."""

    def __init__(self, count, table: dict[str, int]):
        super().__init__(table)
        self.count, self.table, self.limit = count, table, len(table) + CACHE_WORDS

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.table)
        n = self.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


class Counter_:
    """Counts tokens of texts with one model."""

    def __init__(self, model: bytes, table: dict[str, int]):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        #: The shortcut needs what the module's text says of the vocabulary.
        self.split = not any(BLANK in x.lstrip(BLANK) or "\n" in x for x in pieces) and self.library.encode(" a", out_type=str)[0].startswith(BLANK)
        self.after_blank = Lengths(lambda word: len(self.library.encode(word)) if word else 1, table)
        self.bare = Lengths(self._bare, {"": 0})

    def _bare(self, word: str) -> int:
        """Tokens of what stands at the start of a line, with no blank before it."""
        return len(self.library.encode("\n" + word)) - 2

    def _runs(self, line: str, first: bool) -> int:
        """Tokens of a line with runs of blanks."""
        runs = RUNS.findall((BLANK if first else "") + line.replace(" ", BLANK))
        return sum(self._bare(x) if x[0] == BLANK and len(x) > 1 and x[1] == BLANK else self.after_blank[x[1:]] if x[0] == BLANK else self.bare[x] for x in runs)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.library.encode(text))
        if BLANK in text:
            text = text.replace(BLANK, " ")
        lines = text.split("\n")
        total = len(lines) - 1
        for i, line in enumerate(lines):
            if "  " in line or not i and line[:1] == " ":
                total += self._runs(line, not i)
            else:
                words = line.split(" ")
                head = words.pop(0)
                total += (self.bare if i else self.after_blank)[head] + sum(map(self.after_blank.__getitem__, words))
        return total


_kept: dict[str, Counter_] = {}


def counter(model: bytes, table: dict[str, int]) -> Counter_:
    key = hashlib.sha256(model).hexdigest() + str(hash(frozenset(table.items())))
    if key not in _kept:
        _kept.clear()
        _kept[key] = Counter_(model, table)
    return _kept[key]


def frequent(rows: DataFrame, model: bytes, words: int = TABLE_WORDS, docs: int = TABLE_DOCS) -> dict[str, int]:
    """The most frequent pre-tokens in at most ``docs`` texts, with lengths."""
    seen: Counter[str] = Counter()
    for row in rows.where(F.length("text") <= TABLE_DOC_CHARS).select("text").take(docs):
        seen.update(w for line in row["text"].split("\n") for w in line.split(" ")[1:] if w and BLANK not in w and len(w) <= 64)
    count = Counter_(model, {}).after_blank.count
    return {word: count(word) for word, _ in seen.most_common(words)}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, without special tokens.

    A null or empty text has no bytes and no tokens. Every row gives a row. No
    shuffle: one map over the texts.
    """
    rows = pick(docs, doc_id="doc_id", text=text)
    context = docs.sparkSession.sparkContext
    model = open(model_path, "rb").read()
    shared = context.broadcast((model, frequent(rows, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(*shared.value)
        for part in slices(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            counts = [tokens(x) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(rows, run, f"doc_id {rows.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean")
