from collections import Counter

import pytest

from trellisq.llm import sharding


def brute(names, size):
    """Turn-taking over explicit preference lists."""
    lists = []
    for name in names:
        start, step = sharding._digest(f"start:{name}") % size, sharding._digest(f"step:{name}") % (size - 1) + 1
        lists.append([(start + i * step) % size for i in range(size)])
    table: dict[int, int] = {}
    while len(table) < size:
        for i, order in enumerate(lists):
            if len(table) < size:
                table[next(s for s in order if s not in table)] = i
    return [table[s] for s in range(size)]


@pytest.mark.parametrize("count,size", [(1, 2), (3, 7), (5, 101), (8, 257)])
def test_table_equals_brute_force(count, size):
    names = sharding.shard_names(count)
    table = sharding.lookup_table(names, size)
    assert table == brute(names, size)
    held = Counter(table)
    assert max(held.values()) - min(held.values()) <= 1


def test_losing_a_shard_moves_few_slots():
    names = sharding.shard_names(20)
    before, after = sharding.lookup_table(names, 4093), sharding.lookup_table(names[:-1], 4093)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.1 * 4093


@pytest.mark.parametrize("names,size", [([], 7), (["a", "a"], 7), (["a", "b"], 8), (["a", "b", "c"], 3)])
def test_bad_tables(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_shard(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (None, None, 5), (2, "", 7)], "doc_id long, text string, shard int")
    names = sharding.shard_names(4)
    got = sharding.shard(docs, names, size=101).collect()
    table = sharding.lookup_table(names, 101)
    assert len(got) == 4 and all(table[r["slot"]] == r["shard"] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.shard(docs.limit(0), names).count() == 0
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "out"), names, size=101)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_write_with_clashing_columns(spark, tmp_path):
    rows = [(i if i % 7 else None, f"t{i}", i, "mine") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, DOC_ID int, shard string")
    sharding.write_shards(frame, str(tmp_path / "out"), sharding.shard_names())
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((tuple(r[c] for c in ("doc_id", "text", "DOC_ID_2", "shard_2")) for r in back.collect()), key=str) == sorted(rows, key=str)
