"""Sources against files written here."""

import base64
import gzip
import random
import struct
import zlib

import numpy as np
import pytest

from fraglake.operators import bins
from fraglake.operators.store import Store
from fraglake.sources import bam, fasta, gff, plink, sam, sinks, tsv
from fraglake.streaming import landing

CONTIGS = [("chr1", 100_000), ("chrM", 16_000)]
COLUMNS = ("qname", "flag", "chrom", "reference_start", "reference_end", "mapq", "cigar", "template_length", "query_length", "query_sequence")


def some_reads(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice((1, 30, 31, 75))))
        size = len(seq)
        cigar, span = rng.choice((((size, "M"),), ((size - 1, "M"), (1, "S")) if size > 1 else ((size, "M"),), ((size, "M"), (7, "D")))), 0
        span = sum(k for k, op in cigar if op in "MDN=X")
        pos = rng.randrange(90_000)
        out.append((f"read{i}/{rng.randrange(99)}", rng.randrange(4096), rng.choice(CONTIGS)[0], pos, pos + span, rng.randrange(61), "".join(f"{k}{op}" for k, op in cigar), rng.randrange(-500, 500), size, seq))
    out.append(("lost", 4, None, -1, -1, 0, "*", 0, 0, None))
    return out


def write_sam(path, reads):
    lines = ["@HD\tVN:1.6", *(f"@SQ\tSN:{c}\tLN:{n}" for c, n in CONTIGS)]
    for q, f, c, a, _, m, g, t, _, s in reads:
        lines.append("\t".join(map(str, (q, f, c or "*", a + 1, m, g, "*", 0, t, s or "*", "*", "NM:i:0"))))
    path.write_text("\n".join(lines) + "\n")


def write_bam(path, reads, block=3000):
    names = {c: i for i, (c, _) in enumerate(CONTIGS)}
    raw = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(CONTIGS))
    for c, n in CONTIGS:
        raw += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
    for q, f, c, a, _, m, g, t, size, s in reads:
        ops = [(int(k), op) for k, op in __import__("re").findall(r"(\d+)([MIDNSHP=X])", g)]
        codes = [bam.BASES.index(x) for x in (s or "")]
        codes += [0] * (len(codes) % 2)
        body = struct.pack("<iiBBHHHiiii", names.get(c, -1), a, len(q) + 1, m, 0, len(ops), f, size, -1, -1, t) + q.encode() + b"\0"
        body += b"".join(struct.pack("<I", k << 4 | bam.CIGAR_LETTERS.index(op)) for k, op in ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + b"\xff" * size
        raw += struct.pack("<i", len(body)) + body
    with open(path, "wb") as out:
        for i in [*range(0, len(raw), block), len(raw)]:
            part = raw[i : i + block]
            squeezed = zlib.compressobj(6, zlib.DEFLATED, -15)
            data = squeezed.compress(part) + squeezed.flush()
            out.write(b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(part), len(part)))


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_sam(spark, tmp_path):
    reads = some_reads(50)
    write_sam(tmp_path / "a.sam", reads)
    df = sam.read(spark, str(tmp_path / "a.sam"))
    assert rows(df) == sorted(reads, key=str)
    assert df.first()["sample_id"].endswith("a.sam")
    assert sam.contigs(spark, str(tmp_path / "a.sam")) == CONTIGS
    assert bins.dense_counts(df, CONTIGS, 1000, mapq=0, exclude=0).count() == 101 + 17
    (tmp_path / "list").write_text("x.sam\n\ny.sam \n")
    assert sorted(sam.path_list(spark, str(tmp_path / "list"))) == ["x.sam", "y.sam"]


@pytest.mark.parametrize("range_bytes", [1 << 26, 9000])
def test_bam_in_ranges(spark, tmp_path, range_bytes):
    reads = some_reads(800, 2)
    path = str(tmp_path / "a.bam")
    write_bam(path, reads)
    df = bam.read(spark, path, range_bytes)
    assert rows(df) == sorted(reads, key=str)
    assert bam.contigs(path) == CONTIGS
    if range_bytes < 1 << 20:
        assert df.rdd.getNumPartitions() > 2
    (tmp_path / "b.bam").write_bytes(gzip.compress(b"no"))
    with pytest.raises(ValueError):
        bam.header(str(tmp_path / "b.bam"))


def test_fasta(spark, tmp_path):
    rng = random.Random(3)
    seqs = {"chr1": "".join(rng.choices("ACGTNacgt", k=1003)), "x": "", "chr2": "".join(rng.choices("ACGT", k=60))}
    path = tmp_path / "r.fa"
    path.write_text("".join(f">{c} text\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for c, s in seqs.items()))
    assert fasta.contigs(str(path)) == [(c, len(s)) for c, s in seqs.items()]
    got = {}
    for r in fasta.read(spark, str(path), tile_size=100, tiles_per_partition=3).orderBy("chrom", "tile").collect():
        got[r["chrom"]] = got.get(r["chrom"], "") + r["seq"]
    assert got == {c: s for c, s in seqs.items() if s}
    found = fasta.index(str(path))
    (tmp_path / "r.fa.fai").write_text("".join(f"{c.name}\t{c.length}\t{c.offset}\t{c.line_bases}\t{c.line_bytes}\n" for c in found))
    assert fasta.index(str(path)) == found
    assert fasta.fetch(str(path), fasta.index(str(path))[0], 55, 130) == seqs["chr1"][55:130]


def test_annotation(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\n1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "G1"; gene_name "N1";\n1\ts\texon\t11\t12\t.\t+\t.\tgene_id "G1";\n1\ts\tgene\t5\t15\t.\t+\t.\tgene_id "G1"; gene_name "N1";\n2\ts\tgene\t1\t2\t.\t-\t.\tgene_id "G2";\n')
    (tmp_path / "a.gff3").write_text("1\ts\tgene\t11\t20\t.\t+\t.\tID=g1;Name=N1;note=a b\n")
    assert sorted(tuple(r)[:6] for r in gff.genes(spark, str(tmp_path / "a.gtf")).collect()) == [("G1", "N1", "1", "+", 5, 20), ("G2", "G2", "2", "-", 1, 2)]
    assert [tuple(r)[:6] for r in gff.genes(spark, str(tmp_path / "a.gff3")).collect()] == [("g1", "N1", "1", "+", 11, 20)]
    assert gff.read(spark, str(tmp_path / "a.gff3")).first()["attributes"]["note"] == "a b"


@pytest.mark.parametrize("n", [1, 4, 7])
def test_genotypes(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    calls = rng.integers(0, 4, (11, n))  # 3: missing
    code = {0: 0, 3: 1, 1: 2, 2: 3}
    prefix = str(tmp_path / "g")
    packed = b"".join(bytes(sum(code[int(row[j])] << 2 * (j - i) for j in range(i, min(i + 4, n))) for i in range(0, n, 4)) for row in calls)
    (tmp_path / "g.bed").write_bytes(plink.MAGIC + packed)
    (tmp_path / "g.fam").write_text("".join(f"f i{j} 0 0 1 -9\n" for j in range(n)))
    (tmp_path / "g.bim").write_text("".join(f"1\t{'.' if v % 2 else f'rs{v}'}\t0\t{100 + v}\tA\tC\n" for v in range(11)))
    got = {(r["sample_id"], r["feature_name"]): r["value"] for r in plink.read(spark, prefix, 4).collect()}
    names = [f"1:{100 + v}" if v % 2 else f"rs{v}" for v in range(11)]
    assert got == {(f"i{j}", names[v]): int(calls[v, j]) for v in range(11) for j in range(n) if calls[v, j] != 3}
    width = -(-n // 4)
    columns = spark.createDataFrame([(packed[v * width : (v + 1) * width],) for v in range(11)], "p binary")
    assert [r[0] for r in columns.select(plink.decode_column("p", n)).collect()] == [[None if c == 3 else int(c) for c in row] for row in calls]
    (tmp_path / "g.bed").write_bytes(plink.MAGIC + packed[: -width - (width > 1)])
    assert plink.read(spark, prefix, 4).where("feature_name = 'rs10'").count() == 0
    (tmp_path / "g.bed").write_bytes(b"xxx" + packed)
    with pytest.raises(Exception, match="variant-major"):
        plink.read(spark, prefix).collect()


def test_text_tables(spark, tmp_path):
    text = "id\ta\tb\nx\t1\tNA\ny\t\tq r\n"
    (tmp_path / "t.tsv").write_text(text)
    (tmp_path / "t.tsv.gz").write_bytes(gzip.compress(text.encode()))
    for name in ("t.tsv", "t.tsv.gz"):
        assert [tuple(r) for r in tsv.read(spark, str(tmp_path / name)).orderBy("id").collect()] == [("x", "1", None), ("y", None, "q r")]
    assert tsv.count_lines(spark, str(tmp_path / "t.tsv")) == 2
    encoded = base64.b64encode(gzip.compress(b"abc")).decode()
    assert tsv.decode_data_url("data:x;base64," + encoded[:5] + "\n " + encoded[5:].rstrip("=")) == b"abc"
    (tmp_path / "p.tsv").write_text("s\tchr1_0_10\tchr1_10_20\tother\nA\t1\t2\t3\n")
    assert sorted(map(tuple, tsv.panel(spark, str(tmp_path / "p.tsv")).collect())) == [("A", "chr1", 0, 10, 1.0), ("A", "chr1", 10, 20, 2.0)]


def test_sinks(spark, tmp_path):
    counts = spark.createDataFrame([("a", "m", 5, 2), ("a", "k", 6, 1)], "sample_id string, motif string, size int, n long")
    assert sinks.size_matrix(counts, 5, 7).columns == ["sample_id", "motif", "5", "6"]
    wide = sinks.wide_rows(counts, "motif", ["k", "m"])
    sinks.write_tsv(wide, str(tmp_path / "out"))
    assert [tuple(r) for r in tsv.read(spark, str(tmp_path / "out")).collect()] == [("a", "1", "2")]
    assert sinks.wide_rows(counts, "motif", ["k", "m"], name=False).columns == ["k", "m"]


def test_landing_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for version, value in ((1, 5.0), (3, 7.0), (2, 6.0)):
        spark.createDataFrame([("s", "f", value, version)], "sample_id string, feature_name string, value double, version long").write.mode("append").parquet(str(tmp_path / "in"))
        query = landing.append_to(landing.values_stream(spark, str(tmp_path / "in")), store, "Float64", str(tmp_path / "state"))
        query.awaitTermination()
    from fraglake.operators.store import latest

    assert [tuple(r)[2:4] for r in latest(store.read("Float64")).collect()] == [(7.0, 3)]
    assert store.read("Float64").count() == 3
