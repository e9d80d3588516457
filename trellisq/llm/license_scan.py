"""License scans: an exact set-similarity join of text blocks and templates.

A block is a line's set of words; a line of more than BLOCK_WORDS words
counts as overlapping windows of that many, half a window apart, so that
every passage of half a window lies whole in one. Spans don't stop at line
ends: every passage of a template's window counts, BLOCK_WORDS words or twice
the template's, so a statement or a whole license body that is wrapped over
lines is found, at any alignment. A block meets a template
if it holds at least THRESHOLD of the template's words. Words are put in the
order of their document frequency in the whole corpus, rarest first. A block
that meets a template has one of the template's first words (prefix filter),
enough words (length filter), and after the first common word enough words
are left on both sides (position filter); what passes is verified, so every
meeting block is found and no other. Templates are a fixed list; only their
index is sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pick, slices

# Phrases that are looked for word by word, with their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Template statements and texts of well-known licenses, with labels.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
    " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties"
    " or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-body": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain"
    " the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied"
    " warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be"
    " liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or"
    " business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this"
    " software even if advised of the possibility of such damage",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
    " of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"
    " or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice"
    " appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no"
    " event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract"
    " negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-body": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is"
    " without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors"
    " or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or"
    " other dealings in the software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

THRESHOLD = 0.85
BLOCK_WORDS = 64
#: Lower-cases A-Z and makes a blank of each byte that no word holds.
WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def window_of(template: str) -> int:
    """Words of a passage that can meet the template: a template of more than half
    a block has a window of twice its length."""
    return max(BLOCK_WORDS, 2 * len(words_of(template)))


@dataclass
class Index:
    """Templates in frequency order, and the inverted index of their prefixes."""

    templates: dict[str, str]
    frequency: dict[bytes, int]
    threshold: float = THRESHOLD
    order: dict[bytes, int] = field(default_factory=dict)
    ranked: list[tuple[str, list[int], int, int]] = field(default_factory=list)
    prefix: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        sets = {label: set(words_of(text)) for label, text in self.templates.items()}
        if not all(sets.values()):
            raise ValueError("a template has a word at least")
        every = sorted(set().union(*sets.values()), key=lambda w: (self.frequency.get(w, 0), w))
        self.order = {word: i for i, word in enumerate(every)}
        for label, words in sorted(sets.items()):
            ranks = sorted(self.order[w] for w in words)
            need = ceil(self.threshold * len(ranks) - 1e-9)
            for at, rank in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(every[rank], []).append((len(self.ranked), at))
            self.ranked.append((label, ranks, need, window_of(self.templates[label])))

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """Labels of the templates that the block meets, with the containment."""
        ranks = sorted(self.order[w] for w in block if w in self.order)
        place = {rank: i for i, rank in enumerate(ranks)}
        tried = set()
        for word in block & self.prefix.keys():
            for template, at in self.prefix[word]:
                label, wanted, need, window = self.ranked[template]
                if template in tried or len(ranks) < need or window > BLOCK_WORDS:  # a longer one is left to the spans
                    continue
                first = next(i for i, rank in enumerate(wanted) if rank in place)
                tried.add(template)
                if 1 + min(len(wanted) - first, len(ranks) - place[wanted[first]]) - 1 < need:
                    continue
                common = sum(rank in place for rank in wanted)
                if common >= need:
                    yield label, common / len(wanted)

    def spans(self, words: list[bytes]) -> Iterator[tuple[str, int, int, float]]:
        """(label, place of the first word, number of words, containment) of each
        run of overlapping passages that meet a template; the best containment."""
        spots: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if word in self.order:
                spots.setdefault(self.order[word], []).append(at)
        for label, wanted, need, window in self.ranked:
            if sum(rank in spots for rank in wanted) < need:
                continue
            every = sorted((at, rank) for rank in wanted for at in spots.get(rank, ()))
            held: Counter[int] = Counter()
            low, run = 0, None
            for at, rank in every:
                held[rank] += 1
                while at - every[low][0] >= window:
                    gone = every[low][1]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    low += 1
                if len(held) < need:
                    continue
                first, best = every[low][0], len(held) / len(wanted)
                if run is not None and first <= run[1]:
                    run = run[0], at, max(run[2], best)
                    continue
                if run is not None:
                    yield label, run[0], run[1] - run[0] + 1, run[2]
                run = first, at, best
            if run is not None:
                yield label, run[0], run[1] - run[0] + 1, run[2]


def frequencies(rows: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """In how many of all documents each template word stands (a bounded list)."""
    wanted = frozenset().union(*(words_of(t) for t in templates.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for part in slices(batches):
            for text in part.column(1).to_pylist():
                if text:
                    seen.update(wanted.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return {bytes(r["word"]): r["n"] for r in arrow_map(rows, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def places(words: list[bytes], held: set[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively, overlapping ones too."""
    if not held.issuperset(phrase):
        return []
    text, wanted, found = b" " + b" ".join(words) + b" ", b" " + b" ".join(phrase) + b" ", []
    at, word, seen = text.find(wanted), 0, 0
    while at >= 0:
        word += text.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = text.find(wanted, at + 1)
    return found


def blocks(text: str) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of each block."""
    start = 0
    for line in text.split("\n"):
        words = words_of(line)
        for at in range(0, max(1, len(words) - BLOCK_WORDS // 2), BLOCK_WORDS // 2):
            yield start + at, words[at : at + BLOCK_WORDS]
        start += len(words)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word,
    base_labels and labels (sorted arrays), score, and blocks (label, start
    word, number of words, containment) of every block that meets a template;
    spans (the same for passages that may cross line ends) and all_labels, the
    labels of phrases, blocks and spans together.

    The score is 1 with a phrase, else the best block's containment, else 0. A
    null or empty text has no words and no labels. Every row gives a row, repeated
    rows too; a row without doc_id keeps null. Texts are read whole, of any length;
    other columns may have any names; an empty table gives no rows.
    """
    rows = pick(docs, doc_id="doc_id", text=text)
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, frequencies(rows, templates), threshold))
    phrases = [(phrase.encode().split(), label) for phrase, label in PHRASES.items()]

    def one(value: str) -> tuple:
        index = shared.value
        words = words_of(value)
        held = set(words)
        found = [(at, label) for phrase, label in phrases for at in places(words, held, phrase)]
        met, spans = [], []
        if not held.isdisjoint(index.prefix):
            met = [{"label": label, "start": start, "words": len(block), "containment": c} for start, block in blocks(value) for label, c in index.matches(set(block))]
            spans = [dict(zip(("label", "start", "words", "containment"), x, strict=True)) for x in index.spans(words)]
        base = {label for _, label in found}
        spots = [at for at, _ in found]
        score = 1.0 if found else max((b["containment"] for b in met), default=0.0)
        labels = base | {b["label"] for b in met}
        return len(words), len(found), min(spots, default=None), max(spots, default=None), sorted(base), sorted(labels), score, met, spans, sorted(labels | {x["label"] for x in spans})

    met_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), met_type, met_type, pa.list_(pa.string())]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks", "spans", "all_labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = zip(*(one(x or "") for x in part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names)

    return arrow_map(
        rows,
        run,
        f"doc_id {rows.dtypes[0][1]}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double,"
        " blocks array<struct<label:string,start:bigint,words:bigint,containment:double>>, spans array<struct<label:string,start:bigint,words:bigint,containment:double>>,"
        " all_labels array<string>",
    )
