import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.llm import suffix_dedup as S
from trellisq.llm.suffix_array import rising, shared_with_previous, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300) | st.lists(st.sampled_from([b"a", b"ab", b"\0", b"\xff", b"aaaa"]), max_size=200).map(b"".join), st.sampled_from([8, 16, 50]))
def test_suffix_array(data, depth):
    text = np.frombuffer(data, np.uint8)
    array = suffix_array(text, depth)
    assert sorted(array.tolist()) == list(range(len(data)))
    cut = [data[i : i + depth] for i in array]
    assert all(a[:depth] <= b for a, b in zip(cut, cut[1:]))
    if data:
        assert rising(text).tolist() == [data[i:] < data[i + 1 :] for i in range(len(data))]
    equal = shared_with_previous(text, array, depth)
    assert equal[1:].tolist() == [a == b and len(a) == depth for a, b in zip(cut, cut[1:])]


def brute(rows, span=50):
    first: dict[bytes, int] = {}
    for d, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - span + 1):
            w = data[i : i + span]
            first[w] = min(first.get(w, S.NO_ID), S.NO_ID if d is None else d)
    out = []
    for d, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if first[data[i : i + span]] < (S.NO_ID if d is None else d):
                gone[i : i + span] = b"\1" * span
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        out.append((d, len(data), sum(gone), runs, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=str)


def table(seed):
    pick = random.Random(seed)
    syllables = ["th", "er", "on", "an", "é", "ß", " ", " ", ". ", "\n"]

    def prose(n):
        return "".join(pick.choice(syllables) for _ in range(n))

    passages = [prose(pick.randint(20, 120)) for _ in range(8)] + ["x" * 70, "ab" * 60, "\0" * 55]
    rows = []
    for d in range(60):
        text = prose(pick.randint(0, 60)).join([pick.choice(passages) if pick.random() < 0.5 else prose(30) for _ in range(pick.randint(0, 6))])
        rows.append((pick.randint(0, 10**6) * 100 + d, text))
    rows += [(d + 10**9, text[: pick.randint(0, len(text))] + pick.choice(["", "Q"]) + text[pick.randint(0, len(text)) :]) for d, text in rows[:20]]
    rows += [(10**10 + i, rows[0][1]) for i in range(4)] + [(5, None), (6, ""), (7, "y" * 400), (8, "y" * 49), (9, "y" * 50), (None, rows[3][1]), (None, "z" * 80), (None, "z" * 80)]
    rows += [(-4, rows[5][1]), (777, prose(50)), (777, prose(50)), (778, passages[0] + passages[1]), (778, passages[1] + passages[0])]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("cut", [1 << 22, 60, 300])
def test_every_window_lies_in_one_stretch_and_equal_ones_share_an_anchor(monkeypatch, cut):
    monkeypatch.setattr(S, "CUT_BYTES", cut)
    texts = [(t or "").encode() for _, t in table(7)]
    doc, start, end, key = S.stretches(texts)
    seen: dict[bytes, int] = {}
    windows = set()
    for i, a, b, k in zip(doc.tolist(), start.tolist(), end.tolist(), key.tolist(), strict=True):
        for at in range(a, b):
            assert (i, at) not in windows
            windows.add((i, at))
            assert seen.setdefault(texts[i][at : at + 50], k) == k
    assert windows == {(i, at) for i, x in enumerate(texts) for at in range(len(x) - 49)}


@pytest.mark.parametrize("seed,unit", [(4, 256 << 10), (2, 200), (3, 700)])
def test_dedup(spark, monkeypatch, seed, unit):
    monkeypatch.setattr(S, "LEAST_UNIT_BYTES", unit)
    rows = table(seed)
    frame = spark.createDataFrame([(1, d, t, "x") for d, t in rows], "t int, doc_id long, text string, row string").repartition(4)
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in S.dedup(frame).collect()]
    assert sorted(got, key=str) == brute(rows)
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in S.dedup(frame, hot=3).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert S.dedup(frame.limit(0)).count() == 0


def test_documents_without_text_stay(spark):
    """Partitions and ends of slices that hold only null and empty texts."""
    rows = [(i, (None, "")[i % 2]) for i in range(300)] + [(1000, "z" * (300 << 10))] + [(1001 + i, ("", None)[i % 2]) for i in range(3)] + [(2000, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for some in (frame, frame.limit(2), frame.where("doc_id = 2000"), frame.repartition(40)):
        got = [(r["doc_id"], r["n_bytes"]) for r in S.dedup(some).collect()]
        assert sorted(got) == sorted((r["doc_id"], len(r["text"] or "")) for r in some.collect())


@pytest.mark.parametrize("hot", [S.HOT, 200])
def test_one_passage_in_very_many_texts(spark, hot):
    """One anchor in thousands of different stretches, runs and periods of any length."""
    pick = random.Random(11)
    noise = lambda n: "".join(pick.choice("abcdefgh ") for _ in range(n))
    passage = "of the common passage that stands in every one of these texts, whole"
    rows = [(d, noise(30) + passage[pick.randint(0, 12) :] + noise(30)) for d in range(3000)]
    rows += [(5000 + d, "=" * pick.randint(40, 300) + noise(5) + "-." * pick.randint(20, 90)) for d in range(300)] + [(6000, noise(80))] * 2 + [(6001, rows[5][1])] * 3
    pick.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in S.dedup(frame, hot=hot).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_a_run_or_a_period_is_one_stretch():
    doc, start, end, _ = S.stretches([b"=" * 5000, b"-." * 3000, b"0123456789" * 400])
    assert doc.tolist() == [0, 1, 2] and start.tolist() == [0, 0, 0] and end.tolist() == [4951, 5951, 3951]
