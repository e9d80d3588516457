import random
import struct
from collections import Counter
from math import isclose, log

from xxhash import xxh64_intdigest

from trellisq.llm import quality as Q

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def base(text):
    text = text or ""
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words_of(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def buckets(text, size):
    def signed(x):
        return struct.unpack("<q", struct.pack("<Q", x))[0]

    h = [signed(xxh64_intdigest(w.encode(), 42)) for w in words_of(text or "")]

    def both(a, b):
        first = xxh64_intdigest(struct.pack("<q", a), 42)
        return signed(xxh64_intdigest(struct.pack("<q", b), first))

    return [x % size for x in h] + [both(a, b) % size for a, b in zip(h, h[1:])]


def texts():
    pick = random.Random(9)
    good = ["the", "of", "and", "river", "stone", "é", "walk"]
    bad = ["###", "buy$", "<b>", "win!!", "%%%"]
    out = [None, "", " \n\t", "one", "a b", "a b c a b c", "a b c d\na b c d\n\na b c d", "x " * 70, "w\x0bx\x0cy\rz\xa0q é|<>"]
    out += [" ".join(pick.choice(good) + str(pick.randint(0, 8)) for _ in range(pick.randint(40, 120))) for _ in range(60)]
    out += [" ".join(pick.choice(bad) + str(pick.randint(0, 8)) for _ in range(pick.randint(40, 120))) for _ in range(30)]
    out += [" ".join(pick.choice("ab") for _ in range(pick.randint(1, 90))) for _ in range(20)]
    out += ["long " + " ".join(f"w{i % 9000}" for i in range(20000))]
    return out


def test_judge_equals_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "no id " * 30), (10, "again")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, words string, kept int").repartition(3)
    labels = spark.createDataFrame([(d, 1, 0) for d in range(9, 40)] + [(70, 1, 1), (80, 0, 0), (None, 1, 0), (12, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    size = 512
    model = Q.fit(docs, Q.trusted_ids(labels), buckets=size)
    target, raw = Counter(), Counter()
    for d, t in rows:
        raw.update(buckets(t, size))
        if d is not None and 9 <= d < 40:
            target.update(buckets(t, size))
    t, r = target.total(), raw.total()
    want = [log(target[b] + 10) - log(t / r * raw[b] + 10) for b in range(size)]
    assert all(isclose(a, b, abs_tol=1e-6) for a, b in zip(model, want, strict=True))
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows)
    expected = {}
    for d, text in rows:
        b = buckets(text, size)
        expected.setdefault((d, *base(text)), []).append(sum(model[x] for x in b) / len(b) if b else None)
    for g in got:
        mean = expected[tuple(g[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))].pop()
        assert g["score"] is None if mean is None else isclose(g["score"], mean, abs_tol=1e-9)
        assert g["kept"] == (not g["base_failed"] and mean is not None and mean >= Q.THRESHOLD)
    assert any(g["kept"] for g in got) and any(not g["kept"] and not g["base_failed"] for g in got)


def test_no_trusted_documents_and_shuffled_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, "short")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["score"], r["kept"]) for r in Q.judge(docs, none).collect()}
    assert got == {1: (None, True), 2: (None, False)}
    assert Q.judge(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    want = Q.fit(docs, Q.trusted_ids(one), buckets=16)
    monkeypatch.setattr(Q, "BROADCAST_IDS", -1)
    assert Q.fit(docs, Q.trusted_ids(one), buckets=16) == want


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = Q.judge(docs, fitted).join(held, "doc_id").where("not base_failed").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] and not r["toxic"]], [r["kept"] for r in rows if not r["quality"]]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.2 * len(junk)
