import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sieveline.llm import mixing, sharding

DOCS = "doc_id long, text string, source string, lang string, bucket int, e int"


def docs(spark, rows):
    """Rows with two extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "en", 1, 2) for i, t, s in rows], DOCS)


def corpus():
    rows = [(i, "w " * (i % 17 + 1), f"s{i % 5}") for i in range(300)]
    rows += [(1000 + i, "hot word " * 4, "hot") for i in range(200)]
    rows += [(None, "no id", "s1"), (7, None, "s2"), (8, "", None), (9, " \t\n", None), (10, "a b", None), (5000, "x " * 9000, "s3")]
    rows += [(77, "same row", "s4")] * 40
    return rows


def water(sizes):
    """Targets by repeated dealing: the plain version of the closed form."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("per_bucket", [16, 4096])
def test_mix(spark, per_bucket):
    rows = corpus()
    got = mixing.mix(docs(spark, rows), rows_per_bucket=per_bucket).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    most = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= most for s in want)
    assert sum(taken.values()) == sum(sizes.values())
    again = mixing.mix(docs(spark, rows).repartition(7), rows_per_bucket=per_bucket).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b c", "x")], [(1, "", "x"), (2, "", "y")]])
def test_mix_of_little(spark, rows):
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(r.size for r in got)


def test_the_weights_and_shares_are_parameters(spark):
    got = mixing.mix(docs(spark, corpus()), size=F.lit(10), max_epochs=1, weight_cycle=1, share=0.5).collect()
    assert sum(r.taken for r in got) == 10 * len(corpus()) // 2 and all(r.taken <= 10 for r in got)


@pytest.mark.parametrize("per_bucket, n_shards", [(2000, 8), (8 << 20, 8), (5000, 3)])
def test_shards(spark, per_bucket, n_shards):
    rows = corpus()
    got = sharding.shard(docs(spark, rows), n_shards, bucket_bytes=per_bucket).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(n_shards)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(docs(spark, rows).repartition(5), n_shards, bucket_bytes=per_bucket).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    other = sharding.shard(docs(spark, rows), n_shards, seed=1, bucket_bytes=per_bucket).collect()
    assert sorted(map(repr, got)) != sorted(map(repr, other))


def test_shards_are_shuffled(spark):
    got = sharding.shard(docs(spark, [(i, f"t{i}", "s") for i in range(2000)]), 4, bucket_bytes=14_000).collect()
    ids = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.45 < rising < 0.55 and sorted(ids) == list(range(2000))
    means = [sum(ids[i : i + 500]) / 500 for i in range(0, 2000, 500)]
    assert all(850 < m < 1150 for m in means)


def test_no_rows(spark):
    assert sharding.shard(docs(spark, [])).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(*r, "x", 7, {"a": 1}) for r in corpus()] + [(5, "same", "a", "x", 7, None), (5, "same", "b", "x", 7, None), (5, "same", "b", "x", 7, {})]
    rows += [(None, "plumless", "s", None, None, None), (None, "buckeroo", "s", None, None, None)]  # one crc32
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, k1 int, m map<string,int>")
    sharding.write_shards(df, str(tmp_path / "out"), 3, bucket_bytes=3000)
    back = spark.read.parquet(str(tmp_path / "out")).cache()
    assert back.columns == ["doc_id", "text", "source", "slot_", "k1", "m", "slot", "shard"]
    assert sorted(map(repr, (tuple(r[:6]) for r in back.collect()))) == sorted(map(repr, rows))
    counts = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(counts) == 3 and max(counts) - min(counts) <= 1
    assert back.groupBy("shard", "slot").count().where("count > 1").isEmpty()


def test_the_mix_is_one_order(spark):
    rows = corpus() + [(None, "plumless", "s4"), (None, "buckeroo", "s4")]
    df = docs(spark, rows)
    every, entries = mixing.mix_entries(df, rows_per_bucket=16)
    assert every.count() == len(rows)
    place = 0
    for e in entries.orderBy("begin").collect():
        assert e.begin == place and 0 < e.taken <= e.size
        place += e.size
    finish = [e.finish for e in entries.orderBy("begin").collect()]
    assert finish == sorted(finish)
    got = mixing.mix(df, rows_per_bucket=16).collect()
    assert sorted(b for r in got for b in r.begins) == sorted(e.begin for e in entries.collect())
    assert sum(r.taken for r in got) == sum(e.taken for e in entries.collect())
