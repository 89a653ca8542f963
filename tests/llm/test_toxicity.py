import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fraglake.llm import _text, toxicity


def corpus(n=3000, seed=1):
    """Texts of made-up words; toxic ones hold words of one stem or one of three words."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeilmnorstu", k=rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 80))
        toxic = i % 8 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            text[rng.randrange(len(text))] = rng.choice(["vrkz" + rng.choice(words), "fjord", "gnash", "Klutz!"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, y) for k, _, y in rows if k % 2 == 0], "doc_id long, toxic int, text int")
    return docs, labels, toxicity.train(docs, labels), {k: y for k, _, y in rows}


def test_held_out_accuracy(learned):
    docs, _, model, truth = learned
    rows = toxicity.scores(docs, model).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97


def test_held_out_labels_are_never_read(learned, spark):
    docs, labels, model, _ = learned
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.train(docs, flipped).weights, model.weights)


def test_risk_stays_non_negative_in_effect():
    """All positives alike and unlabelled alike: the score of the positives rises, that of the rest doesn't."""
    model = toxicity.fit([np.array([1, 2])] * 50, [np.array([2, 3])] * 450 + [np.array([1, 2])] * 50, 0.1)
    assert model.weights[1] > 1 > model.weights[2]


def test_scores_dont_depend_on_windows(learned):
    model = learned[2]
    texts = [t for _, t, _ in corpus(60, 5)] + ["", "a" * 5000]
    one = [model.score(w.data, w.offsets) for w in _text.windows(pa.array(texts), 1 << 20)]
    many = [model.score(w.data, w.offsets) for w in _text.windows(pa.array(texts), 100)]
    assert np.allclose(np.concatenate(one), np.concatenate(many))


def test_features_are_words_and_stems():
    text = "Straße x straßen"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found, owner = toxicity.features(data, np.array([0, len(data)]))
    words = re.findall(r"\w+", text)
    assert len(found) == len(words) + 2 * len(toxicity.STEMS)
    assert set(owner) == {0}


def test_rows_of_all_kinds(spark, learned):
    model = learned[2]
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "gnash fjord gnash klutz", 0), (2, "gnash fjord gnash klutz", 0)], "doc_id long, text string, score int")
    got = toxicity.scores(docs, model).collect()
    assert len(got) == 4 and len({r["score"] for r in got}) == 2
    assert toxicity.scores(docs.limit(0), model).collect() == []
    assert sorted(r["doc_id"] or 0 for r in toxicity.clean(docs, model).collect()) == [0, 1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = toxicity.train(docs, labels)
        assert {r["score"] for r in toxicity.scores(docs, model).collect()} == {0.0}


def score_by_hand(model, text):
    """The score of one text, word by word, with Python's own integers."""

    def feature(piece, factor=1):
        total = 0
        for i, b in enumerate(piece):
            total += int(_text._TABLE[b]) * pow(_text._BASE, i, 1 << 64)
        h = total % (1 << 64)
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 % (1 << 64)
        h ^= h >> 29
        return (h * factor % (1 << 64)) >> (64 - toxicity.FEATURE_BITS)

    found = set()
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        found.add(feature(word))
        found |= {feature(word[:n], 2 * n + 1) for n in toxicity.STEMS if len(word) >= n}
    z = model.bias + sum(float(model.weights[f]) for f in found)
    return 1 / (1 + np.exp(-z)) if z > -700 else 0.0


def test_query_against_brute_force(spark, sf, monkeypatch):
    from fraglake.llm import queries

    kept = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    rows = {r["doc_id"]: r for r in queries.op8_nnpu_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs) and kept[0].weights.any()
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["score"] == pytest.approx(score_by_hand(kept[0], d["text"]), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0)


def test_held_out_labels_of_the_tables(spark):
    from fraglake.llm.queries import op8_nnpu_toxicity

    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["toxic"] is not None}
    out = [(r["predicted"], truth[r["doc_id"]]) for r in op8_nnpu_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 50 and np.mean([p == y for p, y in out]) > 0.95


def test_the_sample_is_bounded_in_features(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(50 * k))) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(20)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior: seen.extend(len(x) for x in (*positive, *unlabelled)))
    toxicity.train(docs, labels, max_features=30)
    assert max(seen) == 30


def test_repeated_ids_take_one_place_in_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200) for _ in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior: seen.append((len(positive), len(unlabelled))))
    toxicity.train(docs, labels, max_positive=20, max_unlabelled=50)
    assert seen == [(20, 50)]
