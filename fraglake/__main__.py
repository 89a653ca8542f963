"""Commands over SAM, BAM or Parquet reads: ``python -m fraglake COMMAND ... --out FOLDER``.

Each command plans one job over all files and writes one TSV folder.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions import sequence
from .operators import aneuploidy, bins, gc, models, motifs, overlap, peaks, reads, sizes, spectrum, sweep, tiles
from .sources import bam, fasta, gff, sam, sinks, tsv

TILE = 4096


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fraglake", description="Features of cell-free DNA fragments.")
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("files", nargs="*")
    common.add_argument("--bamlist", help="a text file of more paths, one a line")
    common.add_argument("-f", "--reqflag", type=int)
    common.add_argument("-F", "--exclflag", type=int, default=S.EXCLUDED)
    common.add_argument("-q", "--mapqual", type=int, default=60)
    common.add_argument("-o", "--maxo", type=int, help="about so many reads of each sample")
    common.add_argument("-x", type=float, default=1e6, help="the unit of rpx")
    common.add_argument("--norm", choices=("counts", "freq", "rpx"), default="counts")
    common.add_argument("-r", "--reference", help="FASTA")
    common.add_argument("--header", action="store_true")
    common.add_argument("--noname", action="store_true")
    common.add_argument("--seed", type=int, default=42)
    common.add_argument("--out", required=True)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name, parents=[common])
        for flags, settings in options:
            sub.add_argument(*flags, **settings)

    def number(name: str, default, kind=int) -> tuple:
        return (f"--{name}",), {"type": kind, "default": default}

    def switch(name: str) -> tuple:
        return (f"--{name}",), {"action": "store_true"}

    k = (("-k",), {"type": int, "default": 4})
    window = (("-b", "--binsize"), {"type": int, "default": 1_000_000})
    by_size = ((("-l", "--lower"), {"type": int, "default": 60}), (("-u", "--upper"), {"type": int, "default": 600}), switch("noinsert"))
    add("csm", k, switch("pp"))
    add("csmbsz", k, switch("pp"), *by_size)
    add("5pends", k, switch("useref"), switch("uselexsmallest"))
    add("5pendsbsz", k, switch("useref"), switch("uselexsmallest"), switch("pp"), *by_size)
    add("bincounts", window, switch("gccorrect"), number("frac", 0.5, float))
    add("fszd", (("-l", "--lower"), {"type": int, "default": 60}), (("-u", "--upper"), {"type": int, "default": 1000}), switch("noinsert"))
    add("delfi", window, number("short-low", 100), number("short-up", 150), number("long-low", 150), number("long-up", 200), switch("noinsert"))
    add("nucs", number("chrom", None, str), number("start", None), number("end", None), (("-k",), {"type": int, "default": 120}), number("min-size", 120), number("max-size", 180), number("prominence", 5, float), number("distance", 147))
    add("fourier", (("--gff",), {"required": True}), (("-w", "--width"), {"type": int, "default": 10_000}), number("amplitude-min", 193, float), number("amplitude-max", 199, float))
    add("ff", (("--predictor",), {"required": True, "help": "a TSV of bin labels and coefficients; a row named intercept"}))
    add("dnase1l3", (("--model",), {"required": True, "help": "JSON: mean, components, binary, regressor, classes"}), k)
    add("embed", k)
    add("nipt", (("--panel",), {"required": True}), number("ff", 0.10, float), window, switch("gccorrect"), number("frac", 0.1, float))
    return top


def load(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, bins.Contigs]:
    """Reads of all files, and the contigs of the reference, else of the first file's header."""
    paths = [*args.files, *(sam.path_list(spark, args.bamlist) if args.bamlist else [])]
    if not paths:
        raise SystemExit("no files")
    parts = []
    for ending, source in ((".bam", bam.read), (".sam", sam.read)):
        if mine := [p for p in paths if p.endswith(ending)]:
            parts.append(source(spark, mine))
    if mine := [p for p in paths if p.rstrip("/").endswith(".parquet")]:
        parts.append(spark.read.schema(S.READS).parquet(*mine))
    if not parts:
        raise SystemExit("files must end in .bam, .sam or .parquet")
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    if args.reference:
        contigs = fasta.contigs(args.reference)
    else:
        contigs = bam.contigs(paths[0]) if paths[0].endswith(".bam") else sam.contigs(spark, paths[0]) if paths[0].endswith(".sam") else []
    return (reads.subsample(df, args.maxo, seed=args.seed) if args.maxo else df), contigs


def _gc(spark: SparkSession, args: argparse.Namespace, contigs: bins.Contigs, size: int) -> DataFrame:
    table = spark.range(1).select(F.inline(bins.vocabulary(contigs, size)))
    return tiles.composition(fasta.read(spark, args.reference, TILE), table, TILE)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    df, contigs = load(spark, args)
    keep = {"require": args.reqflag, "exclude": args.exclflag, "mapq": args.mapqual}
    name, c = not args.noname, args.command
    if c in ("csm", "csmbsz", "5pends", "5pendsbsz"):
        size = (args.lower, args.upper) if c.endswith("bsz") else None
        more = {"by_size": size, "use_insert": not getattr(args, "noinsert", False), "purpyr": getattr(args, "pp", False), **keep}
        tiled = fasta.read(spark, args.reference, TILE) if args.reference else None
        if c.startswith("csm"):
            if tiled is None:
                raise SystemExit("cut-site motifs need --reference")
            lengths = spark.createDataFrame(contigs, "chrom string, length long")
            found, canonical = motifs.cut_site(df, tiled, lengths, args.k, TILE, **more), True
        else:
            canonical = args.uselexsmallest
            found = motifs.five_prime(df, args.k, canonical, tiled=tiled if args.useref else None, tile_size=TILE, **more)
        if size:
            return sinks.size_matrix(found, *size, motifs=sequence.kmer_list(args.k, "RY" if more["purpyr"] else "ACGT", canonical or more["purpyr"]))
        filled = motifs.zero_filled(found, df, args.k, canonical, more["purpyr"], args.norm, args.x)
        keys = sequence.kmer_list(args.k, "RY" if more["purpyr"] else "ACGT", canonical or more["purpyr"])
        return sinks.wide_rows(filled, "motif", keys, name=name)
    if c == "fszd":
        filled = sizes.zero_filled(df, args.lower, args.upper, args.norm, args.x, use_insert=not args.noinsert, **keep)
        return sinks.wide_rows(filled, "size", list(range(args.lower, args.upper)), name=name)
    if c == "delfi":
        found = bins.short_long(df, contigs, args.binsize, (args.short_low, args.short_up), (args.long_low, args.long_up), not args.noinsert, args.mapqual)
        keys = [f"{chrom}_delfi_{b}" for chrom, n in contigs for b in range(n // args.binsize + 1)]
        return sinks.wide_rows(found.withColumn("key", F.concat_ws("_delfi_", "chrom", "bin")), "key", keys, "ratio", name)
    if c == "bincounts":
        counted = bins.dense_counts(df, contigs, args.binsize, **keep)
        if args.gccorrect:
            joined = counted.withColumn("n", F.col("n").cast("double")).join(_gc(spark, args, contigs, args.binsize), ["chrom", "bin"])
            counted = gc.correct(joined, args.frac, clamp=True).drop("gc")
        return sinks.wide_rows(bins.dense.normalise(counted, args.norm, per=args.x), "label", bins.labels(contigs, args.binsize), name=name)
    signal = lambda k=120, low=120, high=180: sweep.runs(sweep.steps(reads.fragments(df, low, high), k))
    if c == "nucs":
        found = signal(args.k, args.min_size, args.max_size)
        if args.chrom:
            start, end = peaks.check_region(args.start, args.end, dict(contigs)[args.chrom])
            found = sweep.clip(found.where(F.col("chrom") == args.chrom), start, end)
        return peaks.bed_lines(peaks.call(found, args.distance, args.prominence), "sample_id")
    if c == "fourier":
        genes = overlap.reconcile_contigs(gff.genes(spark, args.gff), spark.createDataFrame(contigs, "chrom string, length long"))
        found = spectrum.by_name(spectrum.gene_scores(signal(), overlap.gene_windows(genes, args.width), args.width, args.amplitude_min, args.amplitude_max))
        keys = [r["gene"] for r in genes.groupBy("gene").agg(F.max("ord").alias("ord")).orderBy("ord").collect()]  # the annotation's genes
        return sinks.wide_rows(found, "gene", keys, "intensity", name)
    if c in ("dnase1l3", "embed"):
        if not args.reference:
            raise SystemExit("cut-site motifs need --reference")
        sites = motifs.cut_site(df, fasta.read(spark, args.reference, TILE), spark.createDataFrame(contigs, "chrom string, length long"), args.k, TILE, **keep)
        if c == "dnase1l3":
            with open(args.model) as f:
                return models.genotype(models.vectors([(motifs.zero_filled(sites, df, args.k, how="rpx", per=args.x), "motif")]), json.load(f))
        ends = motifs.five_prime(df, args.k, **keep)
        rows = models.vectors([(sizes.zero_filled(df, 0, 1000, "freq", **keep), "size"), (motifs.zero_filled(sites, df, args.k, how="freq"), "motif"), (motifs.zero_filled(ends, df, args.k, False, how="freq"), "motif")])
        return models.project(rows, models.fit_pca(rows)).drop("features")
    if c == "ff":
        table = spark.read.option("sep", "\t").schema("label string, coef double").csv(args.predictor)
        weights = table.withColumn("b", bins.parse_label("label")).where("b is not null").select("b.chrom", F.floor(F.col("b.bin_start") / 50_000).alias("bin"), "coef")
        offset = table.where("label = 'intercept'").agg(F.coalesce(F.sum("coef"), F.lit(0.0)).alias("i")).first()["i"]
        return aneuploidy.fetal_fraction(aneuploidy.shares(bins.dense_counts(df, contigs, 50_000, exclude=S.DUPLICATE, mapq=1)), weights, offset)
    if c == "nipt":
        size = args.binsize
        with_bin = tsv.panel(spark, args.panel).withColumn("bin", F.floor(F.col("bin_start") / size).cast("long"))
        table = spark.range(1).select(F.inline(bins.vocabulary(contigs, size)))
        clean = tiles.composition(fasta.read(spark, args.reference, TILE), table, TILE, "N", "n_share").where("n_share < 0.01").select("chrom", "bin")
        panel = aneuploidy.depth_filter(aneuploidy.full_bins(with_bin, size).join(clean, ["chrom", "bin"], "left_semi"))
        counted = bins.dense_counts(df, contigs, size, **keep).withColumn("n", F.col("n").cast("double"))
        if args.gccorrect:
            shares = _gc(spark, args, contigs, size)
            panel = gc.correct(panel.join(shares, ["chrom", "bin"]), args.frac)
            counted = gc.correct(counted.join(shares, ["chrom", "bin"]), args.frac)
        known = aneuploidy.panel_statistics(aneuploidy.shares(panel))
        return aneuploidy.trisomy_ratio(aneuploidy.shares(counted.join(known.select("chrom", "bin"), ["chrom", "bin"], "left_semi")), known, args.ff)
    raise SystemExit(f"unknown command {c}")


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fraglake").getOrCreate()
    table = run(spark, args)
    if args.command == "nucs":  # BED lines have no header
        table.write.mode("overwrite").text(args.out)
    else:
        sinks.write_tsv(table, args.out, args.header)


if __name__ == "__main__":
    main()
