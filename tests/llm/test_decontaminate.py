import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from fraglake.llm import _text, decontaminate
from fraglake.llm.queries import op4_spaced_seeds


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text)


def overlaps(doc, item, window=13, similarity=0.8):
    """Brute force: every stretch of the window at every shift."""
    d, b = words(doc), words(item)
    w = min(window, len(b))
    if not w:
        return False
    need = -(-similarity * w // 1)
    return any(sum(d[i + k] == b[j + k] for k in range(w)) >= need for i in range(len(d) - w + 1) for j in range(len(b) - w + 1))


def test_masks_find_every_stretch_with_two_changes():
    for changed in combinations(range(13), 2):
        same = [k not in changed for k in range(13)]
        assert any(all(same[o + i] for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for o in range(13 - len(m) + 1))


@pytest.mark.parametrize("n", range(1, 14))
def test_items_of_few_words_are_found_whatever_changes(n):
    """All places of as many changed words as may be, at all lengths; one more isn't an overlap."""
    item = [f"w{i}" for i in range(n)]
    hashes = decontaminate._words(" ".join(item))
    most = n - decontaminate.needed(n)[1]
    for c in range(most + 2):
        for changed in combinations(range(n), min(c, n)):
            text = ["before", *(f"x{i}" if i in changed else w for i, w in enumerate(item)), "after"]
            hit = decontaminate.longest_overlap(decontaminate._words(" ".join(text)), hashes)
            assert (hit is not None) == (len(changed) <= most and len(changed) < n)
            if hit:
                assert hit[3] == n - len(changed)


def pairs_found(docs, items):
    """By the filter and the join of seeds, without Spark."""
    hashes = [decontaminate._words(b) for b in items]
    seeds = [decontaminate.item_seeds(h) for h in hashes]
    masks = decontaminate.masks_for([len(h) for h in hashes])
    bits = np.zeros(1 << 16, dtype=np.uint64)
    for k in range(decontaminate.FILTER_PROBES):
        at = decontaminate.SeedFilter.places(np.concatenate(seeds), np.uint64(64 * len(bits) - 1), k)
        np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    known, at, got = decontaminate.SeedFilter(bits), 0, set()
    for w in _text.windows(pa.array(docs), 3000):
        for mine in decontaminate.shared_seeds(*decontaminate.words_of(w.data, w.offsets), known, masks):
            for j, theirs in enumerate(seeds):
                if np.isin(mine, theirs).any() and decontaminate.longest_overlap(decontaminate._words(docs[at]), hashes[j]):
                    got.add((at, j))
            at += 1
    return got


def test_against_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "é漢"]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 3, 5, 6, 8, 9, 10, 11, 12, 13, 30)))) for _ in range(40)]
    docs = []
    for i in range(150):
        body = rng.choices(vocabulary, k=rng.randrange(60))
        if i % 2:
            part = items[rng.randrange(40)].split()
            for _ in range(rng.randrange(5)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append(", ".join(body).upper() if i % 5 == 0 else "\n ".join(body))
    expected = {(i, j) for i, d in enumerate(docs) for j, b in enumerate(items) if overlaps(d, b)}
    assert len(expected) > 60 and pairs_found(docs, items) == expected


def test_repeated_words_take_little_time():
    doc, item = np.full(20_000, 7, dtype=np.uint64), np.full(500, 7, dtype=np.uint64)
    began = time.perf_counter()
    assert decontaminate.longest_overlap(doc, item) == (0, 499, 0, 500, 500)
    assert time.perf_counter() - began < 2
    again = np.tile(np.array([1, 2], dtype=np.uint64), 10_000)
    assert decontaminate.longest_overlap(again, again[:300])[4] == 300


def test_rows_of_all_kinds(spark, monkeypatch):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, f"x {passage} y", 0, "r"), (1, f"x {passage} y", 0, "r"), (2, None, 0, None), (3, "", 0, "r"), (None, passage.upper(), 0, "r"), (4, "one two three four five", 0, "r")], "doc_id long, text string, item_id int, row string")
    items = spark.createDataFrame([(7, passage), (None, passage), (8, None), (9, ""), (10, "nine two")], "item_id long, text string")
    expected = [(0, 0, 0, 13, 14), (0, 7, 0, 13, 14), *[(1, 0, 1, 14, 14)] * 2, *[(1, 7, 1, 14, 14)] * 2]
    for limit in (decontaminate.BROADCAST_SEEDS, 0):  # broadcast and shuffled
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
        found = decontaminate.overlaps(docs, items).collect()
        assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["doc_first"], r["doc_last"], r["n_equal"]) for r in found) == expected
        kept = decontaminate.without_leaks(docs, items)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontaminate.overlaps(docs.limit(0), items).collect() == []
    assert decontaminate.overlaps(docs, items.where("false")).collect() == []
    assert decontaminate.overlaps(docs, items).count() == 1


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in op4_spaced_seeds(spark, sf).collect()}
    whole = {(d["doc_id"], b["item_id"]) for d in docs for b in items if " ".join(words(b["text"])) in " ".join(words(d["text"]))}
    assert whole <= got
    texts, benchmark = {d["doc_id"]: d["text"] for d in docs}, {b["item_id"]: b["text"] for b in items}
    assert all(overlaps(texts[d], benchmark[b]) for d, b in got)
