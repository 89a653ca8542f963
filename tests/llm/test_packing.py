import random
import zlib
from collections import Counter, defaultdict
from itertools import count

from hypothesis import given, settings
from hypothesis import strategies as st

from fraglake.llm import _tokens, packing


def least_bins(items, capacity):
    """Brute force over all assignments, largest first."""
    items = sorted(items, reverse=True)

    def fits(bins):
        def go(i, room):
            if i == len(items):
                return True
            tried = set()
            for b in range(len(room)):
                if room[b] >= items[i] and room[b] not in tried:
                    tried.add(room[b])
                    room[b] -= items[i]
                    if go(i + 1, room):
                        return True
                    room[b] += items[i]
            return False

        return go(0, [capacity] * bins)

    return next(n for n in count(0) if fits(n))


def valid(packing_, items, capacity):
    used = Counter()
    for p in packing_.patterns:
        assert p.used <= capacity
        for x, n in p.items:
            used[x] += n * p.repeat
    assert used == Counter(items)
    assert sum(p.repeat for p in packing_.patterns) == packing_.bins >= packing_.bound
    return packing_.bins


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_least_number_of_bins_on_small_cases(items):
    found = packing.bin_completion(Counter(items), 12)
    assert found.proven and valid(found, items, 12) == least_bins(items, 12)


def test_ten_thousand_random_cases():
    rng, searched = random.Random(11), 0
    for _ in range(10_000):
        capacity = rng.choice((20, 30, 60, 100, 150))
        items = [rng.randint(1, capacity * rng.choice((2, 3, 6)) // 6 + 1) for _ in range(rng.randint(1, 13))]
        counts = Counter(min(x, capacity) for x in items)
        found = packing.bin_completion(counts, capacity)
        assert found.proven
        bins = valid(found, list(counts.elements()), capacity)
        if bins > found.bound:  # else it can't be fewer
            searched += 1
            assert bins == least_bins(list(counts.elements()), capacity)
    assert searched > 50


def test_case_that_needs_more_than_the_first_fillings():
    items = [18, 25, 28, 31, 34, 36, 37, 46, 60, 67, 67, 68, 73, 77, 79]
    found = packing.bin_completion(Counter(items), 150)
    assert found.proven and valid(found, items, 150) == 5


def test_search_beats_best_fit_decreasing():
    counts = {44: 2, 24: 2, 22: 2, 21: 2, 17: 3, 8: 2, 6: 2}
    bfd = sum(p.repeat for p in packing.best_fit_decreasing(counts, 61))
    assert packing.bin_completion(counts, 61).bins <= bfd


def test_bounds():
    assert packing.lower_bound({6: 3}, 10) == 3
    assert packing.lower_bound({5: 4}, 10) == 2
    assert packing.bin_completion({}, 10) == packing.Packing([], 0, 0, True)


def test_a_search_that_is_cut_short_says_so():
    rng = random.Random(2)
    items = [rng.randint(200, 500) for _ in range(400)]
    found = packing.bin_completion(Counter(items), 1000, max_steps=50)
    valid(found, items, 1000)
    assert not found.proven or found.bins == found.bound


def test_large_counts_take_little_time():
    counts = {k: 1_000_000 + k for k in range(1, 1025)}
    found = packing.bin_completion(counts, 1024, max_steps=20_000)
    total = sum(k * n for k, n in counts.items())
    assert found.bins <= 1.001 * -(-total // 1024) + 1


def check(rows, docs, length, end):
    """Rows against texts cut anew."""
    encode = _tokens.encoder(_tokens.vocabulary_path())
    expected = Counter()
    for k, t in docs:
        raw = encode._raw([t or ""])[0].tobytes() + end.to_bytes(4, "little")
        n = len(raw) // 4
        edges = [0, *range(n % length or length, n + 1, length)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            expected[k, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(bins)


def test_pieces_and_sequences(spark):
    rows = [(1, "a b c d e f g h i j k"), (1, "a b c d e f g h i j k"), (None, None), (2, ""), (3, "x " * 50), *((k, "same text") for k in range(10, 50))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int")
    packed = packing.pack(docs, length=16)
    got = [r.asDict() | {"crc": zlib.crc32(bytes(r["ids"]))} for r in packed.collect()]
    check(got, rows, 16, 2)
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in got:
        assert joined[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark, sf):
    from fraglake.llm.queries import op3_bin_completion

    docs = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = [r.asDict() | {"crc": r["ids_crc32"]} for r in op3_bin_completion(spark, sf).collect()]
    bins = check(got, docs, 1024, 2)
    counts = Counter(r["length"] for r in got)
    assert bins <= packing.lower_bound(counts, 1024) * 1.005 + 1
