"""Operators against definitions and hand-made cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraglake import schema as S
from fraglake.functions import sequence as seq
from fraglake.operators import aneuploidy, bins, dense, explore, filters, gc, infer, models, motifs, overlap, peaks, reads, sizes, spectrum, store, sweep, tiles

PAIR = S.PAIRED | S.PROPER
READ = "sample_id string, qname string, chrom string, reference_start long, reference_end long, template_length long, flag int, mapq int, query_length int, query_sequence string"


def make(spark, rows):
    """Rows of (start, tlen, flag, mapq) and, optionally, a sequence and sample."""
    full = [((r[5] if len(r) > 5 else "a"), f"q{i}", "c", r[0], r[0] + 50, r[1], r[2], r[3], 50, r[4] if len(r) > 4 else "ACGTACGTACGT") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, READ)


def python_kmers(k, letters="ACGT", canonical=False):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGTRY", "TGCAYR"))
    return [s for s in map("".join, itertools.product(letters, repeat=k)) if not canonical or s <= rc(s)]


@pytest.mark.parametrize(("k", "letters", "canonical", "n"), [(4, "ACGT", False, 256), (4, "ACGT", True, 136), (4, "RY", True, 10), (3, "ACGT", True, 32), (1, "ACGT", False, 4)])
def test_vocabularies(spark, k, letters, canonical, n):
    got = spark.range(1).select(seq.kmers(k, letters, canonical)).first()[0]
    assert got == python_kmers(k, letters, canonical) and len(got) == n


def test_sequence_functions(spark):
    row = spark.createDataFrame([("ACGTNRYacgt",)], "s string").select(seq.revcomp("s"), seq.purine_pyrimidine("s"), seq.canonical(F.lit("TTTT")), seq.canonical(F.lit("ACGT")), seq.count_letters("s", "GC")).first()
    assert tuple(row) == ("acgtRYNACGT", "RYRYNRYacgt", "AAAA", "ACGT", 2)


def test_flags(spark):
    df = make(spark, [(0, 100, PAIR, 60), (0, 100, PAIR | S.DUPLICATE, 60), (0, 100, S.UNMAPPED, 60), (0, 100, PAIR, 59)])
    assert df.where(reads.kept()).count() == 1
    assert df.where(reads.kept(exclude=0)).count() == 3
    assert df.where(reads.kept(require=PAIR, exclude=0, mapq=0)).count() == 3
    assert reads.mapped_counts(df).first()["mapped"] == 3


def test_subsample_is_by_sample_and_stable(spark):
    df = make(spark, [(i, 100, PAIR, 60, "ACGT", "ab"[i % 4 == 0]) for i in range(2000)])
    first = sorted(r["qname"] for r in reads.subsample(df, 200).collect())
    assert first == sorted(r["qname"] for r in reads.subsample(df.repartition(7), 200).collect())
    assert 300 < len(first) < 500
    assert reads.subsample(df, 10_000).count() == 2000


def test_fragments_keep_the_quirk_unless_corrected(spark):
    df = make(spark, [(100, 150, PAIR | S.READ1, 0), (300, -150, PAIR | S.READ1, 0), (100, 150, PAIR | S.READ2, 0), (100, 119, PAIR | S.READ1, 0), (100, 180, S.PAIRED | S.READ1, 0)])
    assert sorted((r["frag_start"], r["frag_end"]) for r in reads.fragments(df).collect()) == [(100, 250), (150, 300)]
    assert sorted((r["frag_start"], r["frag_end"]) for r in reads.fragments(df, corrected=True).collect()) == [(100, 250), (200, 350)]


def test_bins_at_contig_ends(spark):
    rows = spark.range(1).select(F.inline(bins.vocabulary([("x", 20), ("y", 25)], 10))).collect()
    assert [r["label"] for r in rows] == ["x_0_10", "x_10_20", "x_20_20", "y_0_10", "y_10_20", "y_20_25"]
    assert [r["ord"] for r in rows] == [0, 0, 0, 1, 1, 1]


def test_labels(spark):
    df = spark.createDataFrame([("chr1_0_10",), ("chrUn_K1_5_9",), ("a_b",), ("chr1_x_9",), (None,)], "l string")
    got = [r[0] and tuple(r[0]) for r in df.select(bins.parse_label("l")).collect()]
    assert got == [("chr1", 0, 10), ("chrUn_K1", 5, 9), None, None, None]


def test_short_and_long_limits_are_exclusive(spark):
    df = make(spark, [(1, t, PAIR | S.READ2, 60) for t in (100, 101, 149, 150, 151, 199, 200, -120)])
    row = bins.short_long(df, [("c", 10)], 100).first()
    assert (row["n_short"], row["n_long"], row["ratio"]) == (3, 2, 4 / 3)
    assert bins.short_long(df, [("c", 10)], 100, use_insert=False).first()["n_short"] == 0


def test_norms(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("b", 1, 0)], "sample_id string, key int, n long")
    filled = dense.fill(df, df, F.array(*map(F.lit, (1, 2, 3))), "key")
    assert filled.count() == 6
    freq = {(r["sample_id"], r["key"]): r["n"] for r in dense.normalise(filled, "freq").collect()}
    assert freq["a", 1] == 0.75 and freq["a", 3] == 0 and freq["b", 1] is None
    rpx = {(r["sample_id"], r["key"]): r["n"] for r in dense.normalise(filled, "rpx", per=10).collect()}
    assert rpx["a", 1] == 7 and rpx["b", 1] == 0
    assert {r["sample_id"]: r["shallow"] for r in dense.depth_flag(df, 4).collect()} == {"a": False, "b": True}
    assert dense.widen(df, "key", [1, 2]).columns == ["sample_id", "1", "2"]
    with pytest.raises(ValueError):
        dense.normalise(df, "other")


def test_sizes_need_facing_pairs(spark):
    facing, same = S.READ2 | S.REVERSE | PAIR, S.READ2 | PAIR
    df = make(spark, [(1, 100, facing, 60), (1, -100, facing, 60), (1, 100, same, 60), (1, 59, facing, 60), (1, 60, facing, 60), (1, 70, facing | S.DUPLICATE, 60)])
    assert {(r["size"], r["n"]) for r in sizes.histogram(df, 60, 100 + 1).collect()} == {(100, 2), (60, 1)}
    assert sizes.zero_filled(df, 60, 101, "freq").count() == 41


def test_five_prime_motifs(spark):
    df = make(spark, [(1, 1, PAIR, 60, "AACCGGTTA"), (1, 1, PAIR | S.REVERSE, 60, "AACCGGTTA"), (1, 1, PAIR, 60, "NACCGGTTA"), (1, 1, PAIR, 60, "AACCGGTT"), (1, 1, PAIR, 60, "ttttgggga")])
    assert {(r["motif"], r["n"]) for r in motifs.five_prime(df).collect()} == {("AACC", 1), ("TAAC", 1), ("TTTT", 1)}
    assert {(r["motif"], r["n"]) for r in motifs.five_prime(df, canonical=True).collect()} == {("AACC", 1), ("GTTA", 1), ("AAAA", 1)}
    assert motifs.zero_filled(motifs.five_prime(df, canonical=True), df).count() == 136


def test_cut_sites_over_tile_borders(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("ACGTacgtN", [9, 9, 9, 9, 3, 3, 3, 3, 1], k=200))
    tiled = spark.createDataFrame([("c", i, text[8 * i : 8 * i + 8]) for i in range(25)], "chrom string, tile long, seq string")
    df = make(spark, [(p, 1, PAIR | (S.REVERSE if p % 2 else 0), 60) for p in range(0, 150)])
    got = {r["motif"]: r["n"] for r in motifs.cut_site(df, tiled, spark.createDataFrame([("c", 200)], "chrom string, length long"), tile_size=8).collect()}
    expected = {}
    for p in range(150):
        start, end = p, p + 50
        if start > 2 and end < 198:
            m = (text[end - 2 : end + 2] if p % 2 else text[start - 2 : start + 2]).upper()
            if "N" not in m:
                m = min(m, m[::-1].translate(str.maketrans("ACGT", "TGCA")))
                expected[m] = expected.get(m, 0) + 1
    assert got == expected


def test_composition(spark):
    tiled = spark.createDataFrame([("c", 0, "GGCCA"), ("c", 1, "NNgAC"), ("c", 2, "T")], "chrom string, tile long, seq string")
    table = spark.createDataFrame([("c", 0, 0, 4), ("c", 1, 4, 8), ("c", 2, 8, 11), ("c", 3, 11, 11)], "chrom string, bin long, bin_start long, bin_end long")
    got = {r["bin"]: r["gc"] for r in tiles.composition(tiled, table, 5).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: pytest.approx(1 / 3), 3: None}
    assert tiles.contigs_of(tiled).first()["length"] == 11


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_protection_score_against_its_definition(spark, block):
    rng = random.Random(2)
    frags = [("s", "c", a, a + rng.randint(1, 40)) for a in (rng.randint(100, 200) for _ in range(30))] + [("s", "d", 100, 101)]
    df = spark.createDataFrame(frags, "sample_id string, chrom string, frag_start long, frag_end long")
    k = 12
    h = k // 2
    got = {}
    for r in sweep.densify(sweep.runs(sweep.steps(df, k), block)).collect():
        got[r["chrom"], r["pos"]] = r["wps"]
    for chrom, g in itertools.product("cd", range(60, 280)):
        mine = [(a, b) for _, c, a, b in frags if c == chrom]
        spanning = sum(a <= g - h and b >= g + h for a, b in mine)
        ends = sum(g - h <= e < g + h for a, b in mine for e in {a, b - 1})
        assert got.get((chrom, g), 0) == spanning - ends


def test_overlap_join_reports_each_pair_once(spark):
    rng = random.Random(3)
    a = [("k", i, s, s + rng.randint(0, 300)) for i, s in enumerate(rng.randrange(1000) for _ in range(40))]
    b = [("k", i, s, s + rng.randint(0, 300)) for i, s in enumerate(rng.randrange(1000) for _ in range(40))]
    left, right = spark.createDataFrame(a, "key string, i long, a0 long, a1 long"), spark.createDataFrame(b, "key string, j long, b0 long, b1 long")
    got = sorted((r["i"], r["j"]) for r in overlap.join(left, right, ("a0", "a1"), ("b0", "b1"), ["key"], 64).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])


def test_gene_windows_and_contig_names(spark):
    genes = spark.createDataFrame([("g", "1", 5000, 20000, "+"), ("h", "chr1", 5000, 20000, "-"), ("i", "zz", 1, 2, "+")], "gene string, chrom string, start long, end long, strand string")
    named = overlap.reconcile_contigs(genes, spark.createDataFrame([("chr1",)], "chrom string"))
    assert sorted((r["gene"], r["chrom"], r["w_start"], r["w_end"]) for r in overlap.gene_windows(named).collect()) == [("g", "chr1", 5000, 15000), ("h", "chr1", 10000, 20000)]


def test_spectrum_against_fft(spark):
    rng = np.random.default_rng(4)
    edges = np.sort(rng.choice(np.arange(1, 10_000), 300, replace=False))
    edges = np.concatenate([[0], edges, [10_000]])
    scores = rng.integers(-5, 9, len(edges) - 1)
    runs = [("s", "c", int(a) + 70, int(b) + 70, int(v)) for a, b, v in zip(edges, edges[1:], scores, strict=False)]
    signal = spark.createDataFrame(runs, "sample_id string, chrom string, p long, p_end long, wps long")
    windows = spark.createDataFrame([("g", "c", 70, 10_070)], "gene string, chrom string, w_start long, w_end long")
    x = np.repeat(scores, np.diff(edges)).astype(float)
    power = 2 * np.abs(np.fft.rfft(x - x.mean())) ** 2 / len(x) ** 2
    periods = len(x) / np.arange(1, len(power))
    keep = (periods >= 120) & (periods <= 280)
    expected = np.interp(np.linspace(193, 199, 100), periods[keep][::-1], power[1:][keep][::-1]).mean()
    assert spectrum.gene_scores(signal, windows).first()["intensity"] == pytest.approx(expected)
    with pytest.raises(ValueError):
        spectrum.needed(10_000, 193, 290)


def brute_peaks(x, distance, prominence):
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    keep = dict.fromkeys(found, True)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if keep[p]:
            for q in found:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    out = []
    for p in (p for p in found if keep[p]):
        low = []
        for side in (range(p, -1, -1), range(p, n)):
            least = x[p]
            for q in side:
                if x[q] > x[p]:
                    break
                least = min(least, x[q])
            low.append(least)
        if x[p] - max(low) >= prominence:
            out.append((p, x[p]))
    return out


def test_peaks_against_a_scan_of_all_bases(spark):
    rng = random.Random(6)
    for _ in range(30):
        runs, at = [], 0
        for _ in range(60):
            size = rng.randint(1, 6)
            runs.append((at, at + size, rng.randint(-3, 6)))
            at += size
        x = [v for a, b, v in runs for _ in range(a, b)]
        merged = [(len(list(g)), v) for v, g in itertools.groupby(x)]
        ends = np.cumsum([n for n, _ in merged])
        starts = ends - [n for n, _ in merged]
        got = peaks.pick(starts, ends, np.array([float(v) for _, v in merged]), 9, 3)
        assert list(zip(got[0].tolist(), got[1].tolist(), strict=True)) == brute_peaks(x, 9, 3)
    signal = spark.createDataFrame([("s", "c", 0, 5, 1), ("s", "c", 5, 10, 9), ("s", "c", 10, 20, 2), ("s", "c", 40, 50, 7), ("s", "c", 50, 60, -1)], "sample_id string, chrom string, p long, p_end long, wps long")
    called = peaks.call(signal, distance=10, prominence=5)
    assert [(r["start"], r["score"]) for r in called.orderBy("start").collect()] == [(7, 9.0), (44, 7.0)]
    assert sorted(r["value"] for r in peaks.bed_lines(called).collect())[0] == "c\t44\t45\tnucleosome_c_2\t7.00\t."
    assert peaks.check_region(None, None, 9) == (0, 9)
    with pytest.raises(ValueError):
        peaks.check_region(5, 5, 9)


def test_lowess():
    x = np.linspace(0, 1, 40)
    assert np.allclose(gc.lowess(3 * x + 1, x, 0.3), 3 * x + 1)  # a line stays a line
    y = 3 * x + 1 + np.random.default_rng(5).normal(0, 0.2, 40)
    y[7] += 2
    line = 3 * x[7] + 1
    assert abs(gc.lowess(y, x, 0.4)[7] - line) < 0.7 * abs(gc.lowess(y, x, 0.4, rounds=0)[7] - line)  # an outlier is weighted down
    # Without robustness: weighted least squares at one point.
    rng = np.random.default_rng(1)
    y = rng.normal(size=40)
    i, near = 13, int(0.3 * 40 + 1e-10)
    d = np.abs(x - x[i])
    reach = np.sort(d)[near - 1]
    w = np.where(d < reach, (1 - (d / reach) ** 3) ** 3, 0)
    fit = np.polyfit(x, y, 1, w=np.sqrt(w))
    assert gc.lowess(y, x, 0.3, rounds=0)[i] == pytest.approx(np.polyval(fit, x[i]), abs=1e-6)


def test_gc_correction_rules(spark):
    rows = [("a", i, float(10 + i), i / 20) for i in range(20)] + [("a", 20, 5.0, None)] + [("b", i, 1.0, 0.5) for i in range(5)] + [("z", i, 0.0, i / 20) for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id string, bin int, n double, gc double")
    got = {(r["sample_id"], r["bin"]): r["n"] for r in gc.correct(df, frac=0.5).collect()}
    assert got["a", 3] == pytest.approx(19.5) and got["a", 20] is None
    assert got["b", 0] == 1.0 and got["z", 3] == 0.0


def test_trisomy_ratio(spark):
    rng = np.random.default_rng(2)
    m = {("chr21", i): 0.05 for i in range(4)} | {("chr1", i): 0.08 for i in range(10)}
    sd = 0.001
    panel = spark.createDataFrame([(*k, v, sd) for k, v in m.items()], "chrom string, bin long, m double, sd double")
    raised = {k: v * (1.06 if k[0] == "chr21" else 1) for k, v in m.items()}
    total = sum(raised.values())
    xs = {"up": {k: v / total for k, v in raised.items()}, "flat": {k: v + rng.normal(0, 1e-4) for k, v in m.items()}}
    shares = spark.createDataFrame([(s, *k, v) for s, x in xs.items() for k, v in x.items()], "sample_id string, chrom string, bin long, x double")
    got = {r["sample_id"]: r for r in aneuploidy.trisomy_ratio(shares, panel, ff=0.1).collect()}

    def ratio(x, ff):
        alt = {k: v * (1 + ff / 2 if k[0] == "chr21" else 1) for k, v in m.items()}
        t = sum(alt.values())
        return 2 * sum(-0.5 * ((x[k] - alt[k] / t) / sd) ** 2 + 0.5 * ((x[k] - m[k]) / sd) ** 2 for k in m)

    assert got["up"]["llr"] == pytest.approx(ratio(xs["up"], 0.1))
    ff = np.mean([2 * np.mean([xs["up"][k] - m[k] for k in m if k[0] == "chr21"]) / m[k] for k in m if k[0] == "chr21"])
    assert got["up"]["ff_inferred"] == pytest.approx(ff) and got["up"]["llr_updated"] == pytest.approx(ratio(xs["up"], ff))
    assert got["flat"]["llr"] < 0 and got["flat"]["llr_updated"] is None and got["flat"]["ratio"] is None


def test_filters(spark):
    df = spark.createDataFrame([(1, "5", "ab"), (2, "x", None), (3, "7.5", "cb")], "k int, v string, t string")
    run = lambda *specs: sorted(r["k"] for r in filters.apply(df, list(specs)).collect())
    assert run({"column": "v", "op": "range", "lo": 5, "hi": 7}) == [1]
    assert run({"column": "v", "op": "range", "lo": 6}) == [3]
    assert run({"column": "t", "op": "==", "expr": "^a|^c"}) == [1, 3]
    assert run({"column": "t", "op": "!=", "expr": "a"}) == [3]  # missing is the text nan, which has an a
    assert run({"column": "t", "op": "!=", "expr": "b"}) == [2]
    for bad in ({"column": "t", "op": "==", "expr": " "}, {"column": "t", "op": "!=", "expr": "("}, {"column": "no", "op": "==", "expr": "a"}, {"column": "t", "op": "<", "expr": "a"}, {"column": "t", "op": "==", "expr": "(?P<x>a)"}):
        assert run(bad) == []
    assert run() == [1, 2, 3]
    assert len(filters.complete([{"column": "v", "op": "range", "lo": 1, "hi": None}, {"column": "v", "op": "==", "expr": "a"}, {"op": "=="}])) == 1


def test_inference(spark):
    cases = {
        "UInt8": ["0", "1", "255"], "UInt16": ["0", "256"], "UInt32": ["65536"], "Int64": ["4294967296"], "Int8": ["-1", "5"], "Int16": ["-129"], "Int32": ["-32769"], "Float32": ["0.5", "1.25"], "Float64": ["1e300", "0.5"],
        "Bool": ["true", "0", "Yes"], "Date": ["2024-01-02", "2024-03-04"], "DateTime": ["2024-01-02", "2024-01-02 03:04:05"], "String": ["a", "1"],
    }
    for kind, values in cases.items():
        df = spark.createDataFrame([(v,) for v in [*values, None, " ", "NaN"]], "v string")
        assert infer.types(df, ["v"]) == {"v": kind}, values
    nine = spark.createDataFrame([(str(i),) for i in range(9)] + [("x",)], "v string")
    assert infer.types(nine, ["v"])["v"] == "UInt8"
    assert infer.types(nine.where("v <> '3'"), ["v"])["v"] == "String"
    assert infer.types(nine.where("v is null"), ["v"])["v"] == "String"
    assert infer.examples(nine, "v", 3) == (["0", "1", "2"], True)


def test_encoding_rejects_instead_of_wrapping(spark):
    df = spark.createDataFrame([("300",), ("2.5",), ("3.5",), ("-1",), ("x",), ("7",)], "v string")
    assert [r[0] for r in df.select(store.encode(F.col("v"), "UInt8")).collect()] == [None, 2, 4, None, None, 7]
    assert [r[0] for r in df.select(store.encode(F.lit(" Yes "), "Bool")).limit(1).collect()] == [True]


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    wide = spark.createDataFrame([("a", "1", "x", "300"), ("b", "2", None, "7"), ("c", "nan", "z", "8")], "id string, `1` string, name string, u string")
    assert s.ingest(wide, "id", {"1": "Float64", "name": "String", "u": "UInt8"}, 1) == {"u": 1}
    s.append("Float64", spark.createDataFrame([("a", "1", 9.0, 2, 0), ("a", "1", 8.0, 2, 1)], "sample_id string, feature_name string, value double, version long, ingest_seq long"))
    newest = {(r["sample_id"], r["feature_name"]): r["value"] for r in store.latest(s.read("Float64")).collect()}
    assert newest == {("a", "1"): 8.0, ("b", "1"): 2.0}
    s.compact("Float64")
    assert s.read("Float64").count() == 2
    s.refresh_catalog("custom", "given", imported=["name"])
    rows = {r["feature_name"]: r for r in s.catalog().collect()}
    assert rows["1"]["mean"] == 5.0 and rows["name"]["feature_type"] == "custom" and rows["name"]["std"] is None
    assert {r["feature_name"] for r in s.latest_text().collect()} == {"1", "name", "u"}
    assert s.drop(["u", "none"]) == 2 and s.read("UInt8").count() == 0 and s.catalog().count() == 2
    s.clear()
    assert s.catalog().count() == 0


@pytest.mark.parametrize("stop", ["before", "between", "after"])
def test_a_swap_that_is_cut_off_loses_nothing(spark, tmp_path, stop):
    s = store.Store(spark, str(tmp_path / "store"))
    s.append("Float64", spark.createDataFrame([("a", "f", float(v), v, 0) for v in range(5)], "sample_id string, feature_name string, value double, version long, ingest_seq long"))
    path, new, old = s._values("Float64"), *s._beside(s._values("Float64"))
    store.latest(s.read("Float64")).write.parquet(new)
    fs, (target, fresh, aside) = s._files(path, new, old)
    if stop != "before":
        fs.rename(target, aside)
    if stop == "after":
        fs.rename(fresh, target)
    assert s.read("Float64").count() == (5 if stop == "before" else 1)
    s.compact("Float64")
    assert [r["value"] for r in s.read("Float64").collect()] == [4.0]
    assert set(spark.read.parquet(f"{s.path}/values").columns) >= {"data_type", "value"}


def test_an_old_folder_left_aside_is_put_back(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.append("Int8", spark.createDataFrame([("a", "f", 3, 1, 0)], "sample_id string, feature_name string, value int, version long, ingest_seq long"))
    fs, (target, aside) = s._files(s._values("Int8"), s._beside(s._values("Int8"))[1])
    fs.mkdirs(aside.getParent())
    fs.rename(target, aside)
    s.compact("Int8")
    assert s.read("Int8").count() == 1


def test_a_later_ingest_of_one_version_counts(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    s.ingest(spark.createDataFrame([(str(i), "1.5") for i in range(50)], "id string, f string").repartition(4), "id", {"f": "Float64"}, 1)
    s.ingest(spark.createDataFrame([("7", "2.5"), ("7", "3.5")], "id string, f string").coalesce(1), "id", {"f": "Float64"}, 1)
    newest = {r["sample_id"]: r["value"] for r in store.latest(s.read("Float64")).collect()}
    assert newest["7"] == 3.5 and len(newest) == 50 and newest["8"] == 1.5


def test_upload_and_selection(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    wide = spark.createDataFrame([("a", "1", "x", "3", "u"), ("b", "2.5", "y", "4", "v")], "id string, n string, t string, w string, left string")
    assert s.upload(wide, 1, col_types={"w": "String"}, include=["n", "t", "w"], rename={"n": "number"}, feature_type="meta", description="d") == {}
    assert s.feature_types(["number", "t", "w", "none"]) == {"number": "Float32", "t": "String", "w": "String", "none": "String"}
    assert {r["data_type"]: (r["n_rows"], r["n_features"]) for r in s.tables().collect()} == {"Float32": (2, 1), "String": (4, 2)}
    chosen = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    got = s.selection(["number", "t"], chosen, [{"column": "number", "op": "range", "lo": 2}]).collect()
    assert [tuple(r) for r in got] == [("b", "2.5", "y")]
    with pytest.raises(ValueError, match="names"):
        s.upload(wide, 2, rename={"n": "t"})
    with pytest.raises(ValueError, match="types"):
        s.upload(wide, 2, data_type="Number")
    assert store.column_types(wide, ["n", "t"], {"t": "Date"}, "Bool") == {"n": "Bool", "t": "Date"}


def test_files_without_newer_columns_are_read(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([("a", "f", 1.0, 1, 0)], "sample_id string, feature_name string, value double, version long, ingest_seq long").write.parquet(s._values("Float64"))
    spark.createDataFrame([("f", "Float64")], "feature_name string, data_type string").write.parquet(f"{s.path}/catalog")
    assert s.read("Float64").first()["row_seq"] is None and s.catalog().first()["description"] is None
    assert store.latest(s.read("Float64")).first()["value"] == 1.0


@pytest.mark.parametrize("k", [3, 5])
def test_cut_sites_of_odd_length(spark, k):
    text = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(64))
    tiled = spark.createDataFrame([("c", i, text[8 * i : 8 * i + 8]) for i in range(8)], "chrom string, tile long, seq string")
    reads_ = [("s", "q", 0, "c", a, a + 20, 60, "20M", 40, 20, "A" * 20) for a in (5, 13, 17)] + [("s", "q", 16, "c", a, a + 20, 60, "20M", -40, 20, "A" * 20) for a in (6, 21)]
    df = spark.createDataFrame(reads_, S.READS)
    cuts = [5, 13, 17, 26, 41]
    expected = {}
    for c in cuts:
        m = text[c - (k + 1) // 2 : c + k // 2]
        m = min(m, m[::-1].translate(str.maketrans("ACGT", "TGCA")))
        expected[m] = expected.get(m, 0) + 1
    got = motifs.cut_site(df, tiled, spark.createDataFrame([("c", 64)], "chrom string, length long"), k, 8)
    assert {r["motif"]: r["n"] for r in got.collect()} == expected


@pytest.mark.parametrize("most", [2, 1])
def test_cut_sites_by_contig_however_many_are_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(motifs, "BROADCAST_CONTIGS", most)
    text = {"c": "ACGGTCAATTGCCGAT" * 4, "d": "GGATCCTTAACGTAGC" * 2}
    tiled = spark.createDataFrame([(c, i, t[8 * i : 8 * i + 8]) for c, t in text.items() for i in range(len(t) // 8)], "chrom string, tile long, seq string")
    starts = [("c", 3), ("c", 21), ("c", 43), ("d", 3), ("d", 9), ("d", 10), ("e", 9)]
    df = spark.createDataFrame([("s", "q", 0, c, a, a + 20, 60, "20M", 40, 20, "A" * 20) for c, a in starts], S.READS)
    lengths = spark.createDataFrame([(c, len(t)) for c, t in text.items()], "chrom string, length long")
    expected = {}
    for c, a in starts:
        if a + 20 < len(text.get(c, "")) - 2:
            m = text[c][a - 2 : a + 2]
            m = min(m, m[::-1].translate(str.maketrans("ACGT", "TGCA")))
            expected[m] = expected.get(m, 0) + 1
    assert sum(expected.values()) == 4
    found = motifs.cut_site(df, tiled, lengths, tile_size=8)
    assert ("BroadcastHashJoin [chrom#" in found._jdf.queryExecution().executedPlan().toString()) == (most == 2)
    assert {r["motif"]: r["n"] for r in found.collect()} == expected


def test_genes_of_one_name_and_windows_without_runs(spark):
    signal = spark.createDataFrame([("s", "1", 0, 5000, 3), ("s", "1", 5000, 9000, 1)], "sample_id string, chrom string, p long, p_end long, wps long")
    genes = spark.createDataFrame([("g1", "N", "1", "+", 0, 10, 0), ("g2", "N", "1", "+", 4000, 4010, 1), ("g3", "far", "2", "+", 0, 10, 2)], "gene_id string, gene string, chrom string, strand string, start long, end long, ord long")
    windows = overlap.gene_windows(genes)
    scores = {r["gene_id"]: r["intensity"] for r in spectrum.gene_scores(signal, windows).collect()}
    alone = {g: spectrum.gene_scores(signal, windows.where(f"gene_id = '{g}'")).first()["intensity"] for g in ("g1", "g2")}
    assert scores == {"g1": pytest.approx(alone["g1"]), "g2": pytest.approx(alone["g2"]), "g3": 0.0}
    named = {r["gene"]: r["intensity"] for r in spectrum.by_name(spectrum.gene_scores(signal, windows)).collect()}
    assert named == {"N": pytest.approx(alone["g2"]), "far": 0.0}


def test_missing_bins_stop_a_ratio(spark):
    shares = spark.createDataFrame([("a", "chr1", 0, 0.5), ("a", "chr21", 0, 0.5), ("b", "chr1", 0, 1.0)], "sample_id string, chrom string, bin long, x double")
    panel = spark.createDataFrame([("chr1", 0, 0.5, 0.1), ("chr21", 0, 0.5, 0.1)], "chrom string, bin long, m double, sd double")
    assert {r["sample_id"]: r["n_missing"] for r in aneuploidy.missing_bins(shares, panel).collect()} == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="sample b lacks 1 bins"):
        aneuploidy.trisomy_ratio(shares, panel).collect()
    assert aneuploidy.trisomy_ratio(shares.where("sample_id = 'a'"), panel).count() == 1
    weights = panel.selectExpr("chrom", "bin", "1.0D as coef")
    with pytest.raises(Exception, match="lacks"):
        aneuploidy.fetal_fraction(shares, weights).collect()


def test_catalog_rules(spark):
    fresh = spark.createDataFrame([("5", "Float64", 1.0, None), ("5", "String", None, None), ("AA-csm", "UInt8", 2.0, 1.0), ("odd", "UInt8", 3.0, None)], "feature_name string, data_type string, mean double, std double")
    existing = spark.createDataFrame([("5", "meta", "kept"), ("odd", "mine", None)], "feature_name string, feature_type string, description string")
    got = {r["feature_name"]: tuple(r)[1:] for r in store.merge_catalog(fresh, existing).collect()}
    assert got == {"5": ("String", None, None, "core", "kept"), "AA-csm": ("UInt8", 2.0, 1.0, "core", ""), "odd": ("UInt8", 3.0, None, "mine", "")}
    given = {r["feature_name"]: (r["feature_type"], r["description"]) for r in store.merge_catalog(fresh, existing, "new", "text", ["odd"]).collect()}
    assert given == {"5": ("core", "kept"), "AA-csm": ("new", "text"), "odd": ("new", "text")}


def test_explorer_helpers(spark):
    df = spark.createDataFrame([(i, float(i % 5), "xy"[i % 2]) for i in range(20)], "k int, v double, c string")
    assert explore.colour_kind(df, "c") == "categorical" and explore.colour_kind(df, "v") == "categorical"
    assert explore.colour_kind(df.withColumn("w", F.col("k") + 0.5), "w") == "continuous" and explore.colour_kind(df.where("k < 0"), "v") == "none"
    edges = explore.quantile_edges(df, "k", 4)
    assert edges == [0.0, 4.75, 9.5, 14.25, 19.0]
    assert explore.quantile_bin(df.withColumn("v", F.lit(1.0)), "v", 4).first()["qbin"] is None
    with pytest.raises(ValueError):
        explore.quantile_edges(df, "k", 11)
    assert explore.detail_columns(None, "a", "b", "a") == ["a", "b"] and explore.detail_columns(["z", "z"], "a", "b", None) == ["z"]
    values = df.selectExpr("cast(k as string) sample_id", "'f' feature_name", "v value")
    few = explore.selection_band(values, values.where("sample_id in ('1', '2', '3')")).collect()
    assert sorted((r["sample_id"], r["mean"], r["sd"], r["n"]) for r in few) == [("1", 1.0, None, 1), ("2", 2.0, None, 1), ("3", 3.0, None, 1)]
    band = explore.selection_band(values, values).first()
    assert band["n"] == 20 and band["sample_id"] is None
    assert [r["k"] for r in explore.page(df, 1, 6, ["k"]).collect()] == list(range(6, 12))
    sizes = spark.createDataFrame([("chr21", 5), ("odd", 70), ("odd", 30)], "chrom string, bin_end int")
    assert sorted(map(tuple, explore.with_sizes(sizes).collect())) == [("chr21", 46709983), ("odd", 70)]
    text = spark.createDataFrame([("5d",), ("6",), (" 7.5 ",), ("1e3",), ("8f",), ("x",)], "t string")
    assert explore.colour_kind(text, "t") == "categorical"
    assert [r["t"] for r in filters.apply(text, [{"column": "t", "op": "range", "lo": 5}]).collect()] == ["6", " 7.5 ", "1e3"]
    assert infer.types(spark.createDataFrame([("5d",), ("6d",), ("7d",)], "t string"), ["t"]) == {"t": "String"}


def test_models(spark):
    rows = spark.createDataFrame([("a.bam", [1.0, 2.0]), ("d/b.bam", [3.0, -1.0])], "sample_id string, features array<double>")
    assert [r["p"] for r in models.linear(rows, [2, 1], 0.5, "p").orderBy("sample_id").collect()] == [4.5, 5.5]
    assert models.logistic(rows, [0, 0]).first()["probability"] == 0.5
    picked = {r["sample_id"]: (r["label"], r["probability"]) for r in models.multinomial(rows, {"x": ([1, 0], 0), "y": ([0, 1], 0)}).collect()}
    assert picked["a.bam"][0] == "y" and picked["d/b.bam"][0] == "x" and picked["a.bam"][1] == pytest.approx(1 / (1 + math.exp(-1)))
    import pandas as pd

    moved = models.project_with(rows, lambda v: pd.DataFrame([[x[0], x[1]] for x in v]))
    stored = models.store_rows(moved, ["f1", "f2"]).collect()
    assert {r["feature_name"] for r in stored} == {"f1", "f2", "umap1", "umap2"}
    assert all(len(r["sample_id"]) == 10 and r["sample_id"][:2] in ("a_", "b_") for r in stored)
    fitted = models.project(rows, models.fit_pca(rows, 1), ("pc1",))
    assert fitted.columns == ["sample_id", "features", "pc1"]
