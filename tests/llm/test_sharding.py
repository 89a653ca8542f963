import zlib
from collections import Counter, defaultdict

import pytest

from fraglake.llm import _store, sharding
from fraglake.llm.queries import op5_external_shuffle


def check(rows, n, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == n
    assert set(by) <= set(range(shards))
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


@pytest.mark.parametrize(("n", "bucket_bytes"), [(0, 100), (1, 100), (39, 100), (40, 1000), (203, 1500), (203, 1 << 22)])
def test_counts_differ_by_one_at_most(spark, n, bucket_bytes):
    rows = [(None if i % 3 == 0 else i % 50, None if i % 7 == 0 else "copy" * (i % 4), i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = sharding.external_shuffle(docs, _store.fresh_path(spark, "test"), bucket_bytes=bucket_bytes).collect()
    check(got, n, 40)
    assert Counter((r["doc_id"], r["text"], r["extra"]) for r in got) == Counter(rows)


def test_order_is_random_and_follows_the_seed(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'t' as text").coalesce(1)

    def order(seed):
        rows = sharding.external_shuffle(docs, _store.fresh_path(spark, "test"), n_shards=1, seed=seed, bucket_bytes=4000).collect()
        return [r["doc_id"] for r in sorted(rows, key=lambda r: r["slot"])]

    first = order(1)
    assert first == order(1) != order(2)
    assert first != sorted(first)
    # Near neighbours in the input aren't near in the output.
    assert sum(abs(a - b) == 1 for a, b in zip(first, first[1:], strict=False)) < 20


def test_hot_ids_spread_over_buckets(spark):
    docs = spark.range(3000).selectExpr("7L as doc_id", "'same text' as text")
    sizes = [r["count"] for r in sharding.scatter(docs, n_buckets=10).groupBy("bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 450


def test_clashing_names_are_kept_under_others(spark):
    rows = [(i, f"t{i}", i, i, i, i, i) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int, bucket int, place int, slot_input int")
    got = sharding.external_shuffle(docs, _store.fresh_path(spark, "test"))
    assert got.columns == ["doc_id", "text", "shard_input", "_slot_input", "bucket", "place", "slot_input", "shard", "slot"]
    assert sorted(tuple(r)[:7] for r in got.collect()) == rows
    check(got.collect(), 50, 40)


def test_shuffled_input_and_wide_records(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('t', 20) as text", "array(id, id) as list", "repeat('w', 2000) as wide").repartition(3)
    got = sharding.external_shuffle(docs, _store.fresh_path(spark, "test"), bucket_bytes=20_000).collect()
    check(got, 300, 40)
    assert docs.agg({"doc_id": "sum"}).first()[0] == sum(r["doc_id"] for r in got)
    assert spark.createDataFrame([(1, "x" * 5000, [1])], "doc_id long, text string, list array<int>").select(sharding.record_bytes(spark.createDataFrame([], "doc_id long, text string, list array<int>")).alias("n")).first()["n"] > 5000


def test_starts_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP", 8)
    counts = spark.createDataFrame([(b, b % 5 + 1) for b in range(3, 60, 2)], "bucket int, n long")
    before, expected = 0, []
    for b in range(3, 60, 2):
        expected.append((b, before, sum(x % 5 + 1 for x in range(3, 60, 2))))
        before += b % 5 + 1
    assert sorted(map(tuple, sharding.bucket_starts(counts).collect())) == expected


def test_query(spark, sf):
    docs = [(r["doc_id"], len(r["text"].encode()) + 16, zlib.crc32(r["text"].encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op5_external_shuffle(spark, sf).collect()
    check(rows, len(docs), 40)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(docs)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
