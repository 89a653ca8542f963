import random

import pytest

import corpus_pipeline
from fraglake.llm import _store, near_dedup, packing, quality, toxicity

from test_decontaminate import overlaps
from test_near_dedup import expected as smallest_of_each_group
from test_quality import kept_by_hand
from test_toxicity import score_by_hand

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_brute_force(spark, sf, monkeypatch):
    """Each stage, on what the one before kept, against plain Python."""
    monkeypatch.setattr(quality, "RISK", 0.03)
    models, real = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: models.append(real(*a, **k)) or models[-1])
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r["doc_id"]: r for r in docs.collect()}
        docs = _store.materialize(stage(spark, docs, sf), f"test-{name}")
        if name == "toxicity":
            wanted = {k for k, r in rows.items() if score_by_hand(models[0], r["text"]) < 0.5}
        elif name == "quality_rules":
            verdicts, _ = kept_by_hand([(k, r["text"], r["lang"]) for k, r in rows.items()], labels)
            wanted = {k for k, kept in verdicts.items() if kept}
        elif name == "simhash_dedup":
            wanted = set(smallest_of_each_group([(k, r["text"]) for k, r in rows.items()]))
        elif name == "decontamination":
            wanted = {k for k, r in rows.items() if not any(overlaps(r["text"], b) for b in items)}
        else:
            wanted = set(rows)
        got = docs.collect()
        assert {r["doc_id"] for r in got} == wanted
        if name != "packing":
            assert docs.columns == columns and len(got) == len(wanted)
            sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 1024
    counts = {}
    for r in got:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert len(used) <= packing.lower_bound(counts, 1024) * 1.005 + 1


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with labels and a benchmark that hold nulls and repeats."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 1), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_rows_of_all_kinds(spark, small, name, stage):
    rng = random.Random(1)
    prose = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    rows = [(1, prose, "en", "s", 1), (1, prose, "en", "s", 1), (None, prose + " more", None, None, None), (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, "long " * 200_000, "en", "s", 5), (6, "one two three four five six seven eight nine ten eleven twelve thirteen " + prose, "en", "s", 2)]
    # Columns of names that the operators use for themselves.
    docs = spark.createDataFrame([(*r, 7, 7, 7) for r in rows], SCHEMA + ", __row int, row int, good int").select("doc_id", "text", "lang", "source", "n_chars", "__row", "row", "good")
    got = stage(spark, docs, small)
    found = got.collect()
    if name == "packing":
        assert {r["doc_id"] for r in found} == {r[0] for r in rows}
    else:
        assert tuple(got.columns) == corpus_pipeline.COLUMNS and 0 < len(found) <= len(rows)
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
        if name == "simhash_dedup":
            assert ids == [(False, k) for k in (1, 3, 5, 6)] or ids == [(False, k) for k in (1, 3, 5)]
        if name == "decontamination":
            assert 6 not in {r["doc_id"] for r in found} and len(found) == 6
    assert stage(spark, docs.limit(0), small).collect() == []


def test_empty_labels_and_benchmark(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(1, text, "en", "s", 1), (2, "short", "en", "s", 1)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1}


def test_near_copies_have_a_similarity_of_four_fifths():
    assert (near_dedup.SHINGLE_WORDS, near_dedup.SIMILARITY) == (5, 0.8)


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_dedup", "decontamination", "packing"]
