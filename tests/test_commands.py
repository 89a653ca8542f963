import json

import pytest

from fraglake import __main__ as commands
from fraglake.sources import tsv

from test_sources import CONTIGS, write_sam


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("commands")
    reads = []
    for i in range(400):
        first = i % 2 == 0
        flag = 1 + 2 + (64 + 32 if first else 128 + 16)
        a = 1000 + 37 * i
        reads.append((f"q{i}", flag, "chr1", a, a + 50, 60, "50M", 130 + i % 40 if first else -(130 + i % 40), 50, "ACGTTGCAAC" * 5))
    write_sam(folder / "a.sam", reads)
    (folder / "r.fa").write_text("".join(f">{c}\n" + "ACGGTCATTG" * (n // 10) + "\n" for c, n in CONTIGS))
    (folder / "g.gtf").write_text('1\ts\tgene\t1001\t30000\t.\t+\t.\tgene_id "G1"; gene_name "N1";\n')
    (folder / "ff.tsv").write_text("intercept\t0.5\nchr1_0_50000\t2\n")
    cells = {f"chr1_{10_000 * i}_{10_000 * (i + 1)}": 0 for i in range(10)}
    (folder / "panel.tsv").write_text("s\t" + "\t".join(cells) + "\n" + "".join(f"p{j}\t" + "\t".join(str(900_000 + 1000 * ((i * j) % 7)) for i in range(10)) + "\n" for j in range(1, 5)))
    spec = {"mean": [0.0] * 136, "components": [[1.0] * 136, [0.0] * 136], "binary": [[0.0, 1.0], 0.0], "regressor": [[0.5, 0.0], 1.0], "classes": {"a": [[0.0, 0.0], 0.0], "b": [[0.0, 0.0], 1.0], "c": [[0.0, 0.0], 0.0]}}
    (folder / "model.json").write_text(json.dumps(spec))
    write_sam(folder / "b.sam", reads[::3])
    (folder / "list").write_text(f"{folder}/b.sam\n")
    return folder


CASES = {
    "csm": ("-r", "{f}/r.fa", "--norm", "freq"), "csmbsz": ("-r", "{f}/r.fa", "--pp"), "5pends": ("--uselexsmallest",), "5pendsbsz": ("--useref", "-r", "{f}/r.fa"), "bincounts": ("-b", "10000", "--norm", "rpx"),
    "fszd": ("--norm", "freq", "--noname"), "delfi": ("-b", "10000"), "nucs": ("--prominence", "1", "--chrom", "chr1"), "fourier": ("--gff", "{f}/g.gtf"), "ff": ("--predictor", "{f}/ff.tsv"),
    "dnase1l3": ("-r", "{f}/r.fa", "--model", "{f}/model.json"), "embed": ("-r", "{f}/r.fa", "--bamlist", "{f}/list"),
    "nipt": ("--panel", "{f}/panel.tsv", "-r", "{f}/r.fa", "-b", "10000"),
}


@pytest.mark.parametrize("command", sorted(CASES))
def test_command_writes_a_table(spark, files, tmp_path, command):
    out = str(tmp_path / "out")
    commands.main([command, str(files / "a.sam"), "--out", out, "--header", *(a.format(f=files) for a in CASES[command])])
    got = tsv.read(spark, out)
    assert got.count() > 0
    if command == "ff":
        assert abs(float(got.first()["ff"]) - 2.5) < 1e-9
    if command == "dnase1l3":
        row = got.first()
        assert row["label"] == "b" and float(row["probability"]) == 0.5 and abs(float(row["prediction"]) - 500_001) < 100
    if command == "bincounts":
        assert got.count() == 1 and len(got.columns) == 14 and got.columns[0] == "filename"
        assert sum(float(x) for x in got.first()[1:]) == pytest.approx(1e6, rel=1e-4)
    if command == "delfi":
        assert got.count() == 1 and got.columns[1] == "chr1_delfi_0" and len(got.columns) == 14
    if command == "fourier":
        assert got.columns == ["filename", "N1"] and got.count() == 1
    if command == "csmbsz":
        assert got.count() == 10  # every motif in purines and pyrimidines, seen or not
    if command == "nucs":
        line = spark.read.text(out).first()["value"].split("\t")
        assert len(line) == 6 and line[0] == "chr1" and line[3].endswith("a.sam") and line[5] == "."
