import random
import re

import pytest

from fraglake.llm import license_scan
from fraglake.llm.queries import op7_fuzzy_notices


def base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def run(text):
    import pyarrow as pa

    return list(license_scan.scan(pa.array([text], type=pa.string())))[0]


@pytest.mark.parametrize("text", [None, "", "cc by", "CC-BY cc\nby CC BY-NC", "All rights reserved. all rights  reserved", "x GNU General Public License é", "all rights", "ccc by cc", "by cc by cc", "é" * 10])
def test_base_places(text):
    got = run(text)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == base(text)
    assert 0 <= got["score"] <= 1


def test_notices_with_errors_and_line_breaks():
    got = run("Foo bar.\nReleesed under,\nthe MIT  licence. Then more words\nLicensed under the Apach License; Version 2.0!")
    assert got["labels"] == "apache-2.0,mit"
    assert [(s["label"], s["first_word"], s["last_word"], s["errors"]) for s in got["spans"]] == [("mit", 2, 6, 2), ("apache-2.0", 10, 17, 1)]
    assert 0.9 < got["score"] < 1
    assert run("Released upon a mat of lichens")["labels"] == ""


def test_edits_within_the_bound_are_always_found():
    rng = random.Random(2)
    for notice in license_scan.NOTICES:
        for _ in range(25):
            text = list(notice.text)
            for _ in range(notice.errors):
                # Inside words: a word that vanishes takes its space along, which is one more edit.
                k = rng.choice([k for k in range(1, len(text) - 1) if " " not in text[k - 1 : k + 2]])
                kind = rng.randrange(3)
                text[k : k + 1] = [[], ["q"], [text[k], "q"]][kind]
            found = run("before that " + "".join(text) + " and after")
            assert notice.label in found["labels"].split(","), "".join(text)


@pytest.mark.parametrize("notice", license_scan.NOTICES, ids=lambda n: n.text)
def test_notices_are_found_at_every_place_of_a_batch(notice):
    import pyarrow as pa

    def spans(texts):
        return [[(s["first_word"], s["errors"]) for s in g["spans"] if s["label"] == notice.label] for g in license_scan.scan(pa.array(texts))]

    assert spans([notice.text]) == [[(0, 0)]]
    for before in range(9):
        assert spans(["x" * before + " " + notice.text + " and more"]) == [[(int(before > 0), 0)]]
    for place in range(3):
        texts = ["other"] * 3
        texts[place] = notice.text
        assert spans(texts) == [[(0, 0)] if k == place else [] for k in range(3)]


def test_matches_stay_in_their_text():
    import pyarrow as pa

    got = list(license_scan.scan(pa.array(["released under", "the mit license", "all rights", "reserved"])))
    assert all(g["labels"] == "" for g in got)


def test_rows_of_all_kinds(spark):
    docs = spark.createDataFrame([(1, "cc by", 1.0), (1, "cc by", 1.0), (None, None, 1.0), (2, "x " * 50_000 + "all rights reserved", 1.0)], "doc_id long, text string, score double")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["labels"]) for r in license_scan.scan_documents(docs).collect()), key=str)
    assert got == sorted([(0, 0, 0, None, ""), (1, 2, 1, 0, "cc-by"), (1, 2, 1, 0, "cc-by"), (2, 50_003, 1, 50_000, "reserved,reserved-notice")], key=str)
    assert license_scan.scan_documents(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_fuzzy_notices(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
