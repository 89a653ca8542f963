import random
import re
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fraglake.llm import _text, quality
from fraglake.llm.queries import op10_risk_thresholds


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\té#%漢"), max_size=120), max_size=5), st.integers(1, 200))
def test_counts_against_brute_force(texts, limit):
    got = []
    for w in _text.windows(pa.array(texts, type=pa.string()), limit):
        m = quality.measure(w.data, w.offsets)
        got += list(zip(*(m[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
    assert got == [brute(t) for t in texts]


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 40, 0.2), (0, 500, 0.01), (60, 60, 0.5), (7, 9, 0.999)])
def test_binomial_tail(k, n, p):
    assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_keep_the_risk():
    """Rejection rates known in advance: over many draws, a cutoff that breaks the risk is hardly ever chosen."""
    rng = np.random.default_rng(1)
    rule = (quality.Rule("r", "n_symbols", (0.9, 0.5, 0.1)),)
    true = (0.001, 0.02, 0.3)
    broken = 0
    for _ in range(300):
        good = np.minimum.accumulate(rng.binomial(2000, true)[::-1])[::-1].tolist()
        chosen = quality.choose({("en", "r"): quality.Tally(2000, 100, good, [20, 60, 90])}, rule, risk=0.01, delta=0.05)
        broken += chosen.get("en", {}).get("r", 0.9) < 0.9
    assert broken / 300 <= 0.05


def test_few_labels_give_no_cutoff():
    rule = (quality.Rule("r", "n_symbols", (0.9,)),)
    assert quality.choose({("en", "r"): quality.Tally(20, 20, [0], [20])}, rule) == {}
    assert quality.choose({("en", "r"): quality.Tally(5000, 20, [0], [20])}, rule) == {"en": {"r": 0.9}}
    assert quality.choose({("en", "r"): quality.Tally(5000, 20, [0], [0])}, rule) == {}


def test_learning_over_tables(spark, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(4000):
        bad = i % 4 == 0
        text = " ".join(w + "%" * (bad and rng.random() < 0.7) for w in rng.choices(words, k=30))
        rows.append((i, text, ("en", "de", None)[i % 3], int(not bad)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    measured = quality.measured(docs, labels)
    cutoffs = {r["stratum"]: r for r in quality.learn(measured, risk=0.1).collect()}
    assert set(cutoffs) == {"en", "de", None} and all(c["symbols"] is not None for c in cutoffs.values())
    good = {r[0] for r in rows if r[3]}
    for limit in (quality.BROADCAST_STRATA, 0):  # broadcast, and joined by parts of strata
        monkeypatch.setattr(quality, "BROADCAST_STRATA", limit)
        kept = {r["doc_id"] for r in quality.keep(docs, labels, risk=0.1).collect()}
        assert len(good - kept) <= 0.1 * len(good)
        assert len(kept - good) < 0.1 * (len(rows) - len(good))


def test_many_strata_each_get_cutoffs(spark):
    """More strata than any list could hold in a plan, one of them with a third of all rows."""
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).alias("lang"), ((F.col("id") / 20).cast("long") % 4 > 0).alias("good"))
    zero = {c: F.lit(0).cast("long") for c in quality.COUNTS}
    counted = rows.withColumns(zero | {"word_chars": F.lit(100).cast("long"), "n_words": F.lit(30).cast("long"), "n_symbols": F.when(F.col("good"), 0).otherwise(70).cast("long")})
    cutoffs = quality.learn(counted, risk=0.06)
    assert {r["stratum"] for r in cutoffs.collect()} == {"hot", *(f"s{i}" for i in range(20))}
    got = quality.judged(counted, cutoffs).groupBy("good", "rejected").count().collect()
    assert {(r["good"], r["rejected"]) for r in got} == {(True, False), (False, True)}


def test_least_number_of_labels():
    n = quality.least_good(4)
    assert n == 1232
    rule, tests = quality.RULES, 4 * len(quality.RULES)
    assert quality.binomial_tail(0, n, quality.RISK / len(rule)) <= quality.DELTA / tests < quality.binomial_tail(0, n - 1, quality.RISK / len(rule))


def kept_by_hand(docs, labels):
    """The verdicts of the query, from plain Python: counts by text, cutoffs by walking each grid."""
    good = {}
    for k, q in labels:
        if q is not None:
            good[k] = max(good.get(k, 0), q)
    measures = {}
    for k, text, lang in docs:
        m = quality.measure(np.frombuffer((text or "").encode(), dtype=np.uint8), np.array([0, len((text or "").encode())]))
        c = {x: int(m[x][0]) for x in quality.COUNTS}
        safe = max(c["word_chars"], 1), max(c["n_words"], 1), max(c["n_lines"], 1)
        measures[k] = (lang, c, {"symbols": c["n_symbols"] / safe[0], "upper": c["n_upper"] / safe[0], "marks": c["n_marks"] / safe[1], "dup_lines": c["n_dup_lines"] / safe[2], "repeats": c["n_repeat_words"] / safe[1], "same_words": c["n_same_words"] / safe[1]})
    strata = {measures[k][0] for k in good if k in measures}
    cutoffs = {}
    for lang in strata:
        of = {y: [measures[k][2] for k, q in good.items() if k in measures and measures[k][0] == lang and q == y] for y in (0, 1)}
        for rule in quality.RULES:
            limit, best = quality.RISK / len(quality.RULES), 0.0
            for cutoff in rule.grid:
                lost, hit = (sum(m[rule.name] >= cutoff for m in of[y]) for y in (1, 0))
                n = len(of[1])
                tail = sum(comb(n, i) * limit**i * (1 - limit) ** (n - i) for i in range(lost + 1))
                if lost > n * limit or tail > quality.DELTA / (len(strata) * len(quality.RULES)):
                    break
                gain = hit / max(1, len(of[0])) - quality.GOOD_COSTS * lost / max(1, n)
                if gain > best:
                    best, cutoffs[lang, rule.name] = gain, cutoff
    out = {}
    for k, (lang, c, m) in measures.items():
        base = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        out[k] = not base and not any((lang, r) in cutoffs and v >= cutoffs[lang, r] for r, v in m.items())
    return out, cutoffs


def test_kept_against_brute_force(spark):
    """Verdicts on the tables of sf0.01, with an error level at which its few labels give cutoffs."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    expected, _ = kept_by_hand([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()])
    assert {r["doc_id"]: r["kept"] for r in op10_risk_thresholds(spark, sf).collect()} == expected
    assert sorted(r["doc_id"] for r in quality.keep(docs, labels).collect()) == sorted(k for k, kept in expected.items() if kept)


def test_rows_of_all_kinds(spark):
    docs = spark.createDataFrame([(1, None, None, 0, 0), (1, "", "en", 0, 0), (None, "w " * 40, "en", 0, 0), (2, " ".join(f"w{i}" for i in range(30)), "en", 0, 0)], "doc_id long, text string, lang string, n_words int, __counts int")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = {(r["doc_id"], r["n_words"], r["good"]) for r in quality.measured(docs, labels).collect()}
    assert got == {(1, 0, None), (None, 40, None), (2, 30, True)}
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert quality.keep(docs.limit(0), labels).collect() == []
    assert quality.learn(quality.measured(docs.limit(0), labels)).collect() == []


def test_a_long_text_is_measured_whole():
    text = " ".join(f"w{i}" for i in range(300_000)) + " w0 w1 w2 w3 w4 w5 w6 w7\n" + "#" * 2_000_000
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    m = quality.measure(data, np.array([0, len(data)]))
    assert (m["n_words"][0], m["n_symbols"][0], m["n_repeat_words"][0]) == (300_009, 2_000_000, 16)


def test_query_against_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_risk_thresholds(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["base_failed"] and r["kept"])
