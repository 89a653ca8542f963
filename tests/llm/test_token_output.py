import heapq
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fraglake.llm import _store, _tokens, token_output


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300))
def test_grammar_round_trip_and_random_access(ids):
    ids = np.array(ids, dtype=np.uint32)
    payload = token_output.pack_shard(ids, np.zeros(0), np.zeros(0), np.zeros(0), 5, min_count=2)
    shard = token_output.Shard(payload)
    assert shard.ids().tolist() == ids.tolist()
    for start in range(0, len(ids), 37):
        count = min(23, len(ids) - start)
        assert shard.range(start, count).tolist() == ids[start : start + count].tolist()
    assert len(shard.seq) <= len(ids)


def test_rules_are_used_and_lengths_add_up():
    ids = np.array([1, 2, 3, 4] * 200, dtype=np.uint32)
    rules, seq = token_output.compress(ids, 10)
    assert len(seq) < 30 and len(rules) >= 5
    lengths = token_output.expansion_lengths(rules, 10)
    assert int(lengths[seq[seq >= 10] - 10].sum()) + int((seq < 10).sum()) == len(ids)
    for i in range(len(rules)):
        assert len(token_output.expand(np.array([10 + i]), rules, 10)) == lengths[i]


def stored_words_of_exact_grammar(ids, first, min_count=4):
    """Re-Pair one pair at a time, the most frequent first: words for rules, lengths and the sequence."""
    seq, n = [int(x) for x in ids], len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places = defaultdict(set)
    for i in range(n - 1):
        places[seq[i], seq[i + 1]].add(i)
    heap = [(-len(v), k) for k, v in places.items() if len(v) >= min_count]
    heapq.heapify(heap)
    rules, length = 0, n
    while heap:
        c, pair = heapq.heappop(heap)
        have = len(places.get(pair, ()))
        if have < min_count:
            continue
        if have != -c:
            heapq.heappush(heap, (-have, pair))
            continue
        symbol, touched = first + rules, set()
        rules += 1
        for i in sorted(places.pop(pair)):
            j = after[i]
            if seq[i] != pair[0] or j >= n or seq[j] != pair[1]:
                continue
            p, q = before[i], after[j]
            if p >= 0:
                places[seq[p], seq[i]].discard(p)
            if q < n:
                places[seq[j], seq[q]].discard(j)
                before[q] = i
            seq[i], seq[j], after[i] = symbol, -1, q
            length -= 1
            if p >= 0:
                places[seq[p], symbol].add(p)
                touched.add((seq[p], symbol))
            if q < n:
                places[symbol, seq[q]].add(i)
                touched.add((symbol, seq[q]))
        for t in touched:
            if len(places[t]) >= min_count:
                heapq.heappush(heap, (-len(places[t]), t))
    return 3 * rules + length


def test_size_is_within_a_hundredth_of_exact_grammars(sf):
    import pyarrow.parquet as pq

    column = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].combine_chunks()
    ids = np.concatenate(list(_tokens.encode_column(column, _tokens.vocabulary_path())))
    rules, seq = token_output.compress(ids, 50257)
    assert token_output.expand(seq, rules, 50257).tolist() == ids.tolist()
    assert 3 * len(rules) + len(seq) <= 1.01 * stored_words_of_exact_grammar(ids, 50257)


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.5, 20_000).clip(0, 400).astype(np.uint32)
    _, seq = token_output.compress(ids, 500)
    pairs, counts = np.unique((seq[:-1].astype(np.int64) << 32) | seq[1:], return_counts=True)
    # What is left overlaps itself or others too often to be replaced four times.
    assert counts.max() < 8 and (counts >= 4).sum() <= 0.001 * len(pairs) + 2


def test_damage_is_noticed():
    payload = bytearray(token_output.pack_shard(np.arange(9, dtype=np.uint32), np.array([0]), np.array([1]), np.array([False]), 50))
    payload[-2] ^= 1
    with pytest.raises(ValueError):
        token_output.Shard(bytes(payload)).ids()


def test_files_hold_all_documents_in_order(spark):
    rows = [(5, "five six"), (1, None), (None, "no id"), (3, ""), (3, "same id"), (3, "same id"), (9, "long " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    path = _store.fresh_path(spark, "test")
    token_output.write(docs, path, shard_tokens=50)
    got = sorted(token_output.read(spark, path).collect(), key=lambda r: r["start"])
    encode = _tokens.encoder(_tokens.vocabulary_path())
    expected = sorted(((k, encode._raw([t or ""])[0].tobytes() + b"\0\0\0\0") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [k for k, _ in expected]
    assert sorted(bytes(r["ids"]) for r in got) == sorted(b for _, b in expected)
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]


def test_empty_table(spark):
    path = _store.fresh_path(spark, "test")
    token_output.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_output.read(spark, path).collect() == []


def test_query_against_brute_force(spark, sf):
    from fraglake.llm.queries import op1_repair_tokens

    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    encode, at, expected = _tokens.encoder(_tokens.vocabulary_path()), 0, []
    for k, text in docs:
        raw = encode._raw([text])[0].tobytes() + b"\0\0\0\0"
        expected.append((k, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert sorted(map(tuple, op1_repair_tokens(spark, sf).collect())) == expected
