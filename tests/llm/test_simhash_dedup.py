import random
import re

import pytest
from xxhash import xxh64_intdigest

from fraglake.llm import _store, simhash_dedup


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, distance=2):
    """Smallest id reachable, by trying all pairs of fingerprints."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    low = {}
    for k, f in rows:
        if k is not None:
            low[find(f)] = min(k, low.get(find(f), k))
    return {f: low.get(find(f)) for f in prints}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", "One", "One two", "a b  c\nD É é", "x " * 70_000, "  \x1c a b c d e f"])
def test_fingerprint(text):
    assert simhash_dedup.simhash(text.encode()) == fingerprint(text)


@pytest.mark.parametrize(("pairs_up_to", "distance", "blocks"), [(1, 2, 4), (16, 2, 4), (1, 0, 1), (1, 1, 3), (1, 3, 5), (1, 4, 6), (16, 4, 6)])
def test_components_against_all_pairs(spark, pairs_up_to, distance, blocks):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for f in list(prints[12:18]):  # just near enough, just too far
        for n in (1, 2, 3, 4, 5):
            prints.append(f ^ sum(1 << b for b in rng.sample(range(64), n)))
    for f in list(prints[:12]):  # chains and crowds of near fingerprints
        for _ in range(12):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.append(f)
        prints += [f ^ (1 << b) for b in range(0, 64, 3)]
    rows = [(rng.randrange(10_000), f) for f in prints for _ in range(rng.choice((1, 1, 3)))] + [(None, prints[0]), (None, 12345)]
    table = _store.materialize(spark.createDataFrame([(k, signed(f)) for k, f in rows], "doc_id long, fp long"), "test")
    got = {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_dedup.assign(table, pairs_up_to=pairs_up_to, distance=distance, blocks=blocks).collect()}
    expected = components(rows, distance)
    assert got == {(k, f, expected[f]) for k, f in rows}


def test_distances_beyond_the_points(spark):
    with pytest.raises(ValueError, match="points"):
        simhash_dedup.links(spark.createDataFrame([(1,)], "fp long"), distance=5, blocks=7)


def test_a_crowd_isnt_expanded_into_pairs(spark):
    base = 0x0123456789ABCDEF
    rng = random.Random(5)
    crowd = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    crowd = rng.sample(sorted(crowd), 900)
    table = _store.materialize(spark.createDataFrame([(signed(f),) for f in crowd], "fp long"), "test")
    assert simhash_dedup.links(table).count() <= 65 * len(crowd)


def test_rows_of_all_kinds(spark):
    rows = [(4, "same text here now"), (2, "same text here now"), (None, "same text here now"), (7, None), (9, ""), (5, "other words stand here"), (5, "other words stand here")]
    docs = spark.createDataFrame([(*r, "x", 0, 1) for r in rows], "doc_id long, text string, fp string, __row int, __fp int")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect())
    assert got == [(-1, 2), (2, 2), (4, 2), (5, 5), (5, 5), (7, 7), (9, 7)]
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 5, 7]


def test_null_ids_alone_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash_dedup.near_duplicates(docs).collect()[0]["component_id"] is None
    assert simhash_dedup.keep_one(docs).count() == 1
    assert simhash_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, sf):
    from fraglake.llm.queries import op9_simhash_blocks

    docs = [(r["doc_id"], fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = components(docs)
    got = sorted(map(tuple, op9_simhash_blocks(spark, sf).collect()))
    assert got == sorted((k, f"{f:016x}", expected[f]) for k, f in docs)
