import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from trellisq.llm import simhash
from trellisq.llm.components import components


def brute_fingerprint(text, words=3):
    parts, word = [], bytearray()
    for c in (text or "").encode() + b" ":
        if c in b" \t\n\x0b\x0c\r":
            if word:
                parts.append(bytes(word))
            word = bytearray()
        else:
            word.append(c + 32 if 65 <= c <= 90 else c)
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or [b" ".join(parts)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=3):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprints():
    pick = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "a\tb\x0bc\x1cd", "É é A a\xa0b", "x " * 5000]
    texts += [" ".join(pick.choice(["A", "b", "cc", "é"]) for _ in range(pick.randint(1, 60))) for _ in range(100)]
    for text in texts:
        for words in (3, 5):
            assert simhash.fingerprint(text or "", words) == brute_fingerprint(text, words)


def test_shards_bring_all_pairs_in_reach_together(spark):
    pick = random.Random(2)
    pairs = []
    for _ in range(300):
        a = pick.getrandbits(64)
        b = a
        for bit in pick.sample(range(64), 3):
            b ^= 1 << bit
        pairs.append(tuple(int(np.uint64(x).view(np.int64)) for x in (a, b)))
    frame = spark.createDataFrame(pairs, "a long, b long")
    keys = frame.select(F.arrays_overlap(simhash._shards(F.col("a")), simhash._shards(F.col("b"))).alias("meet"))
    assert keys.where("meet").count() == len(pairs)


@pytest.mark.parametrize("spread", [2, 12, 64])
def test_forest_equals_brute_force(spread):
    pick = random.Random(spread)
    base = pick.getrandbits(64)
    fp = np.array(sorted({base ^ pick.getrandbits(spread) for _ in range(400)}), np.uint64)
    shard = np.sort(np.array([pick.randint(0, 2) for _ in fp]))
    got = {(int(a), int(b)) for x, y in simhash.Forest(shard, fp).links(3) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(i) if shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert got == want


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    test_forest_equals_brute_force(12)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 105), (105, 150)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 105, 105: 105, 150: 105}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    pick = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        body = [pick.choice(words) for _ in range(300)]
        texts += [" ".join(body)] * 2
        for _ in range(6):
            edited = list(body)
            edited[pick.randrange(300)] = "new"
            texts.append(" ".join(edited))
    texts += [None, "", "  ", "solo"]
    pick.shuffle(texts)
    rows = [(3 * i, t, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(frame).collect()}
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    assert got == {d: (f, c) for (d, _, _), f, c in zip(rows, fps, brute_components(fps, [d for d, *_ in rows]), strict=True)}
    assert len({c for _, c in got.values()}) < len(rows) / 2


def test_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == [(0, None), (2, 2), (5, 2), (5, 2)]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def sets_of(texts):
    return {d: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for d, t in texts}


def alike_components(sets):
    """Brute force: components over all pairs of similarity 0.8."""
    ids = sorted(sets)
    label = dict(zip(ids, ids))
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if label[a] != label[b] and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("block,neighbours", [(2048, 256), (40, 3)])
def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch, block, neighbours):
    """Most pairs of the group are below the bound; no link of different texts is lost."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "NEIGHBOURS", neighbours)
    monkeypatch.setattr(simhash, "FIRST_BLOCK", block)
    pick = random.Random(21)
    body = [f"w{i}" for i in range(150)]
    texts = []
    for d in range(250):
        edited = list(body)
        for _ in range(pick.randint(1, 5)):
            edited[pick.randrange(150)] = f"e{pick.randrange(10**9)}"
        texts.append((d, " ".join(edited)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    want = alike_components(sets_of(texts))
    assert sum(got[d] == want[d] for d in want) >= 0.98 * len(want) and len(set(want.values())) > 1


def shingle_words(texts):
    """(set key, first SimHash word as a signed long, set of hashes) of each text."""
    hashes = {d: np.unique(simhash._hashes(t, 5)) for d, t in texts}
    return {d: (simhash.set_key(h), int(np.uint64(simhash.wide_fingerprint(h, 1)[0]).view(np.int64)), set(h.tolist())) for d, h in hashes.items()}


def bits_apart(a, b):
    return ((a ^ b) % 2**64).bit_count()


def test_tree_pairs_are_in_reach_and_span(spark):
    pick = random.Random(31)
    fps = set()
    for _ in range(12):
        base = pick.getrandbits(64)
        fps |= {base} | {base ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for _ in range(40)}
    rows = [(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(sorted(fps))]
    fp = {i: x for x, i in rows}
    pairs = [(r["a"], r["b"]) for r in simhash.edges(spark.createDataFrame(rows, "fp long, rep long").repartition(3), pairs=True).collect()]
    assert pairs and all(bits_apart(fp[a], fp[b]) <= 3 for a, b in pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == brute_components([x % 2**64 for x, _ in rows], list(range(len(rows))))


def test_the_pipelines_stage_goes_by_the_trees(spark, monkeypatch):
    """Pairs in reach are verified first; the completion gets only what they leave apart."""
    pick = random.Random(32)
    texts = []
    for g in range(40):
        body = [f"g{g}w{pick.randrange(10**9)}" for _ in range(274)]
        for copy in range(4):
            edited = list(body)
            for e in range((0, 1, 1, 6)[copy]):
                edited[20 + 36 * e + copy] = f"edit{copy}"
            texts.append((len(texts), " ".join(edited)))
    known = shingle_words(texts)
    doc = {key: d for d, (key, _, _) in known.items()}
    given, verify = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda pairs, sets, similarity: given.append([(doc[r["a"]], doc[r["b"]]) for r in pairs.collect()]) or verify(pairs, sets, similarity))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(3), "")
    assert {r["doc_id"] for r in kept.collect()} == {4 * g for g in range(40)}
    trees, rest = given
    in_reach = {(a, b) for a, (_, x, _) in known.items() for b, (_, y, _) in known.items() if a < b and bits_apart(x, y) <= 3}
    assert len(in_reach) > 40 and {(min(p), max(p)) for p in trees} <= in_reach
    by_trees = brute_components([known[d][1] % 2**64 for d, _ in texts], [d for d, _ in texts])
    assert rest and all(by_trees[a] != by_trees[b] for a, b in rest)


def test_tree_links_are_verified(spark):
    """Fingerprints of unlike sets may be in reach too."""
    pick = random.Random(33)
    texts = []
    for g in range(3000):
        body = [f"g{g}w{pick.randrange(10**9)}" for _ in range(64)]
        edited = list(body)
        edited[20] = edited[40] = "edit"  # 60 shingles, of which 50 stay: 0.714
        pair = [(len(texts), " ".join(body)), (len(texts) + 1, " ".join(edited))]
        (_, x, s), (_, y, t) = shingle_words(pair).values()
        if bits_apart(x, y) <= 3:
            assert len(s & t) < 0.8 * len(s | t)
            texts += pair
    assert len(texts) >= 4
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in texts}


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    pick = random.Random(34)
    pairs = [(pick.randrange(-400, 400), pick.randrange(-400, 400)) for _ in range(350)] + [(1000 + i, 1001 + i) for i in range(60)]
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    one = {tuple(r) for r in simhash._settled(frame.where("a <> b")).collect()}
    monkeypatch.setattr(simhash, "TASK_LINKS", 100)
    assert one == {tuple(r) for r in simhash._settled(frame.where("a <> b")).collect()}
    assert simhash._settled(frame.limit(0)).count() == 0
