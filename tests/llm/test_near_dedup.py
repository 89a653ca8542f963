import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fraglake.llm import _store, _text, near_dedup


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def expected(rows, similarity=0.8):
    """Smallest ids of the components, by trying all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(k)
    return sorted(min(g) for g in groups.values())


def corpus(seed, crowd):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    texts = [rng.choices(words, k=rng.randint(3, 200)) for _ in range(60)]
    for _ in range(crowd):
        near = list(texts[0])
        near = near if len(near) > 100 else rng.choices(words, k=150)
        texts[0] = near
        copy = list(near)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    for t in texts[1:40]:
        copy = list(t)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("crowd", "options"), [(10, {}), (120, {}), (120, {"block_texts": 25})])
def test_kept_against_all_pairs(spark, crowd, options):
    rows = corpus(crowd, crowd)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs, **options).collect()) == expected(rows)


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    rows = []
    for k in range(20):
        text = rng.choices(words, k=120)
        near = list(text)
        near[60] = "changed"
        near[61] = "twice"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * k for k in range(20)]


def test_rows_of_all_kinds(spark):
    rows = [(4, "Same text here now"), (2, "same text  here now"), (None, "same text here now"), (7, None), (9, ""), (5, "other words stand here"), (5, "other words stand here")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, __row int, __sig int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 7]
    assert near_dedup.keep_one(docs.limit(0)).collect() == []


def prints_of(texts, blocks, bits):
    return np.concatenate([near_dedup.fingerprints(*near_dedup.shingles(w.data, w.offsets), blocks, bits) for w in _text.windows(pa.array(texts))])


def test_candidates_are_those_whose_simhash_blocks_agree_outside_the_wild_bits(spark):
    rows = corpus(3, 20)
    blocks, bits = near_dedup.shape(len(rows))
    prints = prints_of([t for _, t in rows], blocks, bits)
    value = prints[:, near_dedup.CHECK_BITS // 64 :] & 0xFFFFFFFF
    wild = sum(1 << (prints[:, near_dedup.CHECK_BITS // 64 :] >> (32 + 5 * k) & 31) for k in range(near_dedup.WILD))
    points = near_dedup._points(spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(prints)], "row long, print array<long>"))
    met = {}
    for r in points.collect():
        met.setdefault(r["key"], []).append(r["row"])
    met = {(a, b, key >> 32) for key, found in met.items() for a in found for b in found if a < b}
    agree = ((value[:, None] ^ value[None]) & ~(wild[:, None] | wild[None])) == 0
    assert met == {(a, b, k) for a, b, k in zip(*(x.tolist() for x in np.nonzero(agree)), strict=True) if a < b}


def test_pairs_of_just_four_fifths_meet_as_often_as_said_and_are_near():
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(184)]
        texts += [" ".join(words), " ".join(words[20:] + [f"v{rng.randrange(10**9)}" for _ in range(20)])]  # 160 of 200 shingles
    for bits in (16, 23, 30):
        prints = prints_of(texts, 40, bits)
        a, b = prints[::2], prints[1::2]
        assert (np.bitwise_count((a[:, :2] ^ b[:, :2]).view(np.uint64)).sum(axis=1) <= near_dedup.CHECK_DISTANCE).all()
        places = lambda x: sum(1 << (x[:, 2:] >> (32 + 5 * k) & 31) for k in range(3))
        meet = ((((a ^ b)[:, 2:] & 0xFFFFFFFF) & ~(places(a) | places(b))) == 0).mean()
        assert meet >= 0.37 * 0.886 ** (bits - 20) * 0.9
        # Strangers: each text against the pair after it.
        far = np.bitwise_count((a[1:, :2] ^ b[:-1, :2]).view(np.uint64)).sum(axis=1)
        assert (far > near_dedup.CHECK_DISTANCE).mean() > 0.98


def test_blocks_in_several_rounds_leave_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCKS_AT_ONCE", 5)
    rows = corpus(4, 20)
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == expected(rows)


def test_written_tables_leave_no_shuffle_files(spark):
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    out = _store.materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 77).alias("k")).count(), "test")
    assert len(out.collect()) == 77
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert tracker.shuffleStatuses().size() <= before


def test_parts_hold_the_points_of_a_block_once_and_few_bytes_a_text(spark):
    rows = corpus(6, 30)
    blocks, bits = near_dedup.shape(len(rows))
    frame = spark.createDataFrame([(k << 33, p.tolist()) for k, p in enumerate(prints_of([t for _, t in rows], blocks, bits))], "row long, print array<long>")
    points = lambda **x: sorted(tuple(r) for r in near_dedup._points(frame, **x).collect())
    assert len(points()) == len(rows) * blocks * 8 and points(parts=4) == points() == sorted(points(most=5) + points(first=5))
    dealt = near_dedup._dealt(frame, 0, blocks, 4).selectExpr("sum(length(entries))").first()[0]
    assert dealt <= 32 * len(rows) * blocks * 1.5


@pytest.mark.parametrize("pairs_up_to", [0, 4, 1000])
def test_links_hold_together_just_the_texts_that_meet_and_are_near(pairs_up_to):
    rng = np.random.default_rng(pairs_up_to)
    centres = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    m = 400
    flips = [sum(1 << int(x) for x in rng.choice(64, rng.integers(2, 16), replace=False)) for _ in range(2 * m)]
    check = centres[rng.integers(0, 6, m)] ^ np.array(flips, dtype=np.uint64).reshape(m, 2)
    wild = np.stack([rng.choice(9, 3, replace=False) for _ in range(m)])
    code = rng.integers(0, 512, m) & ~(1 << wild).sum(axis=1) | (wild << (32 + 5 * np.arange(3))).sum(axis=1)
    sets = [set(x) for x in near_dedup._corners(code).tolist()]
    for part in range(2):
        meet = np.array([[any(v & 1 == part for v in a & b) for b in sets] for a in sets])
        near = np.bitwise_count(check[:, None] ^ check[None]).sum(axis=2) <= near_dedup.CHECK_DISTANCE
        links = near_dedup._meetings(check, code, part, 2, pairs_up_to)
        linked = np.zeros((m, m), dtype=bool)
        linked[links[:, 0], links[:, 1]] = linked[links[:, 1], links[:, 0]] = True
        assert 0 < len(links) <= 2 * m and (links[:, 0] < links[:, 1]).all() and not (linked & ~(meet & near)).any()
        assert sorted(near_dedup._forest(linked)) == sorted(near_dedup._forest(meet & near))


def group_below_the_threshold(n):
    """Texts that share two thirds of one text, at several places: near by their bits, but few pairs are at 0.8."""
    rng = random.Random(n)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for _ in range(n):
        at = rng.randrange(160)
        rows.append([*base[:at], *(f"v{rng.randrange(10**9)}" for _ in range(rng.choice([4, 25]))), *base[at + 30 :]])
    return [(k, " ".join(x)) for k, x in enumerate(rows)]


@pytest.mark.parametrize("options", [{}, {"block_texts": 40}, {"block_texts": 40, "part_texts": 30, "pairs_up_to": 4}])
def test_a_large_group_is_not_joined_pair_by_pair(spark, monkeypatch, options):
    rows = group_below_the_threshold(150)
    seen, verified = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    assert sorted(r["doc_id"] for r in kept.collect()) == expected(rows)
    assert sum(seen) <= len(rows)


def test_little_is_shuffled_a_text(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(3000)]
    docs = _store.materialize(spark.createDataFrame(rows, "doc_id long, text string"), "test")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert near_dedup.keep_one(docs).count() == len(rows)
    assert written() - before <= 60 * near_dedup.shape(len(rows))[0] * len(rows)
