"""Queries over the standard tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as seq
from ..operators import aneuploidy, bins, explore, filters, gc, infer, models, motifs, overlap, peaks, reads, sizes, spectrum, store, sweep, tiles
from . import pseudo

BIN, WIDE_BIN = 10_000, 50_000
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces --------------------------------------------------------------

_READS = f"reads as ({pseudo.READS_SQL})"
_KEPT = "kept as (select * from reads where mapq >= 60 and flag & 3852 = 0)"
_SAMPLES = "samples as (select distinct sample_id from reads)"
_REV = "(flag & 16 = 16)"
_CONTIGS = "contigs(ord, chrom, length) as (values " + ", ".join(f"({i}, '{c}', {n})" for i, (c, n) in enumerate(pseudo.CONTIGS)) + ")"


def _vocabulary_sql(size: int) -> str:
    return f"""vocabulary as (
        select ord, chrom, bin, bin * {size} as bin_start, least((bin + 1) * {size}, length) as bin_end,
               chrom || '_' || cast(bin * {size} as varchar) || '_' || cast(least((bin + 1) * {size}, length) as varchar) as label
        from contigs, unnest(range(length // {size} + 1)) t(bin))"""


def _dense_sql(size: int) -> str:
    return f"""{_READS}, {_KEPT}, {_SAMPLES}, {_CONTIGS}, {_vocabulary_sql(size)},
        counted as (select sample_id, chrom, cast(floor(reference_start / {size}.0) as bigint) as bin, count(*) as n from kept group by all),
        filled as (select sample_id, ord, chrom, bin, bin_start, bin_end, label, coalesce(n, 0) as n from samples cross join vocabulary left join counted using (sample_id, chrom, bin))"""


def _rc(s: str) -> str:
    return f"translate(reverse({s}), 'ACGTRY', 'TGCAYR')"


_KMERS = "letters(l, i) as (values ('A', 0), ('C', 1), ('G', 2), ('T', 3)), kmers as (select a.l || b.l || c.l || d.l as motif from letters a, letters b, letters c, letters d)"
_TILES = f"tiles as ({pseudo.TILES_SQL}), doubled as (select t.chrom, t.tile, t.seq || coalesce(u.seq, '') as seq2 from tiles t left join tiles u on u.chrom = t.chrom and u.tile = t.tile + 1)"
_CUT = f"""placed as (select *, case when {_REV} then reference_end else reference_start end - 2 as spot from kept where reference_start > 2 and reference_end < 200000 - 2),
    cut as (select placed.*, upper(substr(seq2, cast(spot % 32 + 1 as int), 4)) as m from placed join doubled on doubled.chrom = placed.chrom and doubled.tile = spot // 32),
    concrete as (select * from cut where length(translate(m, 'ACGT', '')) = 0)"""


# Counts over bins, sizes and motifs --------------------------------------


@query(f"with {_READS}, {_KEPT} select sample_id, chrom, cast(floor(reference_start / {BIN}.0) as bigint) as bin, count(*) as n from kept group by all")
def bincounts(spark, sf_dir):
    return bins.counts(pseudo.reads(spark, sf_dir), BIN)


@query(f"with {_dense_sql(BIN)} select sample_id, ord, chrom, bin, bin_start, bin_end, label, cast(floor(n / (sum(n) over (partition by sample_id) / 1e6)) as bigint) as n from filled")
def bincounts_dense_rpx(spark, sf_dir):
    return bins.dense_counts(pseudo.reads(spark, sf_dir), pseudo.CONTIGS, BIN, "rpx")


@query(f"with {_READS} select sample_id, count(*) filter (where flag & 4 = 0) as mapped from reads group by 1")
def mapped_counts(spark, sf_dir):
    return reads.mapped_counts(pseudo.reads(spark, sf_dir))


@query(
    f"""with {_READS}, {_KEPT}, {_SAMPLES},
    counted as (select sample_id, abs(template_length) as size, count(*) as n from kept where flag & 128 = 128 and (flag & 16 = 16) <> (flag & 32 = 32) and abs(template_length) >= 60 and abs(template_length) < 600 group by all)
    select sample_id, size, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by sample_id), 6) as n from samples cross join (select range as size from range(60, 600)) left join counted using (sample_id, size)"""
)
def fszd_freq(spark, sf_dir):
    return _round(sizes.zero_filled(pseudo.reads(spark, sf_dir), 60, 600, "freq"), "n")


@query(f"with {_READS}, {_KEPT} select sample_id, cast(query_length as bigint) as size, count(*) as n from kept where query_length >= 60 and query_length < 140 group by all")
def fszd_read_length(spark, sf_dir):
    return sizes.histogram(pseudo.reads(spark, sf_dir), 60, 140, use_insert=False)


@query(
    f"""with {_READS}, {_SAMPLES}, {_CONTIGS}, {_vocabulary_sql(BIN)},
    counted as (select sample_id, chrom, cast(floor(reference_start / {BIN}.0) as bigint) as bin,
        count(*) filter (where abs(template_length) > 100 and abs(template_length) < 150) as n_short, count(*) filter (where abs(template_length) > 150 and abs(template_length) < 200) as n_long
        from reads where mapq >= 60 and flag & 1028 = 0 and flag & 128 = 128 group by all)
    select sample_id, ord, chrom, bin, bin_start, bin_end, label, coalesce(n_short, 0) as n_short, coalesce(n_long, 0) as n_long, round((coalesce(n_short, 0) + 1) / (coalesce(n_long, 0) + 1), 6) as ratio
    from samples cross join vocabulary left join counted using (sample_id, chrom, bin)"""
)
def delfi_ratio(spark, sf_dir):
    return _round(bins.short_long(pseudo.reads(spark, sf_dir), pseudo.CONTIGS, BIN), "ratio")


_FIVE = f"five as (select *, case when {_REV} then {_rc('right(query_sequence, 4)')} else left(query_sequence, 4) end as m from kept)"


@query(f"with {_READS}, {_KEPT}, {_SAMPLES}, {_FIVE}, {_KMERS}, counted as (select sample_id, m as motif, count(*) as n from five group by all) select sample_id, motif, coalesce(n, 0) as n from samples cross join kmers left join counted using (sample_id, motif)")
def fivep_kmers(spark, sf_dir):
    df = pseudo.reads(spark, sf_dir)
    return motifs.zero_filled(motifs.five_prime(df), df, canonical=False)


@query(
    f"""with {_READS}, {_KEPT}, {_SAMPLES}, {_FIVE}, {_KMERS}, counted as (select sample_id, least(m, {_rc("m")}) as motif, count(*) as n from five group by all)
    select sample_id, motif, round(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by sample_id), 6) as n from samples cross join (select * from kmers where motif <= {_rc("motif")}) left join counted using (sample_id, motif)"""
)
def fivep_kmers_canonical(spark, sf_dir):
    df = pseudo.reads(spark, sf_dir)
    return _round(motifs.zero_filled(motifs.five_prime(df, canonical=True), df, how="freq"), "n")


@query(
    f"""with {_READS}, {_KEPT}, {_FIVE}, py as (select *, translate(m, 'AGCT', 'RRYY') as p from five)
    select sample_id, least(p, {_rc("p")}) as motif, abs(template_length) as size, count(*) as n from py where abs(template_length) >= 60 and abs(template_length) < 160 group by all"""
)
def fivep_by_size(spark, sf_dir):
    return motifs.five_prime(pseudo.reads(spark, sf_dir), purpyr=True, by_size=(60, 160))


@query(
    f"""with {_READS}, {_KEPT}, {_TILES},
    placed as (select *, case when {_REV} then reference_end - 4 else reference_start end as spot from kept),
    cut as (select placed.*, substr(seq2, cast(spot % 32 + 1 as int), 4) as raw from placed join doubled on doubled.chrom = placed.chrom and doubled.tile = spot // 32),
    named as (select *, upper(case when {_REV} then translate(reverse(raw), 'acgtACGT', 'tgcaTGCA') else raw end) as motif from cut)
    select sample_id, motif, count(*) as n from named where length(translate(motif, 'ACGT', '')) = 0 and length(motif) = 4 group by all"""
)
def fivep_from_reference(spark, sf_dir):
    df = motifs.five_prime(pseudo.reads(spark, sf_dir), tiled=pseudo.tiles(spark), tile_size=pseudo.TILE)
    return df.where("length(motif) = 4")


@query(f"with {_READS}, {_KEPT}, {_TILES}, {_CUT} select sample_id, least(m, {_rc('m')}) as motif, count(*) as n from concrete group by all")
def csm_motifs(spark, sf_dir):
    return motifs.cut_site(pseudo.reads(spark, sf_dir), pseudo.tiles(spark), pseudo.contigs(spark), tile_size=pseudo.TILE)


@query(
    f"""with {_READS}, {_KEPT}, {_TILES}, {_CUT.replace(" - 2 as spot", " - 3 as spot").replace("as int), 4)) as m", "as int), 5)) as m")}
    select sample_id, least(m, {_rc("m")}) as motif, count(*) as n from concrete group by all"""
)
def csm_k5(spark, sf_dir):
    """For odd k the extra base stands on the left of the cut."""
    return motifs.cut_site(pseudo.reads(spark, sf_dir), pseudo.tiles(spark), pseudo.contigs(spark), k=5, tile_size=pseudo.TILE)


@query(f"with {_READS}, {_KEPT}, {_TILES}, {_CUT}, py as (select *, translate(m, 'AGCT', 'RRYY') as p from concrete) select sample_id, least(p, {_rc('p')}) as motif, count(*) as n from py group by all")
def csm_purpyr(spark, sf_dir):
    return motifs.cut_site(pseudo.reads(spark, sf_dir), pseudo.tiles(spark), pseudo.contigs(spark), tile_size=pseudo.TILE, purpyr=True)


@query(f"with {_READS}, {_KEPT}, {_TILES}, {_CUT} select sample_id, least(m, {_rc('m')}) as motif, abs(template_length) as size, count(*) as n from concrete where abs(template_length) >= 60 and abs(template_length) < 160 group by all")
def csm_by_size(spark, sf_dir):
    return motifs.cut_site(pseudo.reads(spark, sf_dir), pseudo.tiles(spark), pseudo.contigs(spark), tile_size=pseudo.TILE, by_size=(60, 160))


@query(
    f"""with {_READS}, mapped as (select sample_id, count(*) filter (where flag & 4 = 0) as mapped from reads group by 1)
    select sample_id, qname, reference_start, flag from reads join mapped using (sample_id)
    where cast('0x' || substr(md5(qname), 1, 7) as bigint) / 268435456.0 <= least(1.0, 100.0 / greatest(mapped, 1))"""
)
def subsample_hash(spark, sf_dir):
    return reads.subsample_by_digest(pseudo.reads(spark, sf_dir), 100, F.col("qname")).select("sample_id", "qname", "reference_start", "flag")


def _composition_sql(letters: str, name: str, size: int) -> str:
    return f"""with {_CONTIGS}, {_vocabulary_sql(size)}, tiles as ({pseudo.TILES_SQL}),
    bases as (select chrom, tile * 32 + i as pos, substr(seq, cast(i + 1 as int), 1) as b from tiles, unnest(range(32)) t(i)),
    shares as (select chrom, pos // {size} as bin, count(*) filter (where b in ({letters})) / count(*) as {name} from bases group by all)
    select chrom, bin, round({name}, 6) as {name} from vocabulary left join shares using (chrom, bin)"""


def _bin_table(spark: SparkSession, size: int) -> DataFrame:
    return spark.range(1).select(F.inline(bins.vocabulary(pseudo.CONTIGS, size)))


@query(_composition_sql("'G', 'C'", "gc", 777))
def gc_content_bins(spark, sf_dir):
    return _round(tiles.composition(pseudo.tiles(spark), _bin_table(spark, 777), pseudo.TILE), "gc")


@query(_composition_sql("'N'", "n_share", 1000))
def n_content_bins(spark, sf_dir):
    return _round(tiles.composition(pseudo.tiles(spark), _bin_table(spark, 1000), pseudo.TILE, "N", "n_share"), "n_share")


@query()
def gc_corrected_bins(spark, sf_dir):
    counted = bins.dense_counts(pseudo.reads(spark, sf_dir), pseudo.CONTIGS, BIN)
    shares = tiles.composition(pseudo.tiles(spark), _bin_table(spark, BIN), pseudo.TILE)
    joined = counted.join(shares, ["chrom", "bin"]).select("sample_id", "chrom", "bin", F.col("n").cast("double").alias("n"), "gc")
    return _round(gc.correct(joined, frac=0.5, clamp=True), "n", "gc")


# Signals -----------------------------------------------------------------

_RUNS = f"""{_READS},
    frags as (select sample_id, chrom, case when template_length > 0 then reference_start else reference_start + template_length end as fs, abs(template_length) as size from reads where flag & 67 = 67 and abs(template_length) between 120 and 180),
    frag as (select sample_id, chrom, fs, fs + size as fe from frags),
    steps as (
        select sample_id, chrom, fs + 60 as p, 1 as d from frag where fe - 60 >= fs + 60 union all select sample_id, chrom, fe - 59, -1 from frag where fe - 60 >= fs + 60
        union all select sample_id, chrom, fs - 59, -1 from frag union all select sample_id, chrom, fs + 61, 1 from frag
        union all select sample_id, chrom, fe - 60, -1 from frag where fe - 1 <> fs union all select sample_id, chrom, fe + 60, 1 from frag where fe - 1 <> fs),
    changes as (select sample_id, chrom, p, sum(d) as d from steps group by all having sum(d) <> 0),
    signal as (select sample_id, chrom, p, lead(p) over w as p_end, cast(sum(d) over w as bigint) as wps from changes window w as (partition by sample_id, chrom order by p)),
    runs as (select * from signal where p_end is not null)"""


def _signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.runs(sweep.steps(reads.fragments(pseudo.reads(spark, sf_dir))), block=1 << 14)


@query(f"with {_RUNS} select sample_id, chrom, p, p_end, wps from runs")
def wps_runs(spark, sf_dir):
    return _signal(spark, sf_dir)


@query(f"with {_RUNS} select sample_id, chrom, greatest(p, 50000) as p, least(p_end, 60000) as p_end, wps from runs where p_end > 50000 and p < 60000")
def wps_region_clip(spark, sf_dir):
    return sweep.clip(_signal(spark, sf_dir), 50_000, 60_000)


_WINDOWS = f"""genes as ({pseudo.GENES_SQL}), windows as (select gene, chrom, case when strand = '+' then "start" else "end" - 10000 end as w_start, case when strand = '+' then "start" + 10000 else "end" end as w_end from genes)"""


@query(
    f"""with {_RUNS}, {_WINDOWS} select sample_id, gene, cast(sum(least(p_end, w_end) - greatest(p, w_start)) as bigint) as bases, cast(sum((least(p_end, w_end) - greatest(p, w_start)) * wps) as bigint) as total
    from runs join windows on runs.chrom = windows.chrom and p < w_end and w_start < p_end group by all"""
)
def gene_window_wps(spark, sf_dir):
    windows = overlap.gene_windows(pseudo.genes(spark), 10_000)
    both = overlap.join(_signal(spark, sf_dir), windows, ("p", "p_end"), ("w_start", "w_end"), ["chrom"])
    width = F.least("p_end", "w_end") - F.greatest("p", "w_start")
    return both.groupBy("sample_id", "gene").agg(F.sum(width).alias("bases"), F.sum(width * F.col("wps")).alias("total"))


def _wave(k: int) -> str:
    return ", ".join(f"sum(wps * {f}(2 * pi() * {k} * (pos - w_start) / 10000.0)) as {f}{k}" for f in ("cos", "sin"))


@query(
    f"""with {_RUNS}, {_WINDOWS},
    dense as (select sample_id, gene, w_start, wps, unnest(range(greatest(p, w_start), least(p_end, w_end))) as pos from runs join windows on runs.chrom = windows.chrom and p < w_end and w_start < p_end),
    waves as (select sample_id, gene, {_wave(50)}, {_wave(51)}, {_wave(52)} from dense group by all),
    powers as (select sample_id, gene, {", ".join(f"2 * (cos{k} * cos{k} + sin{k} * sin{k}) / 1e8 as p{k}" for k in (50, 51, 52))} from waves),
    grid as (select 193 + 6.0 * range / 99 as period from range(100)),
    scores as (select sample_id, gene, avg(case when period <= 10000 / 51.0 then p52 + (p51 - p52) * (period - 10000 / 52.0) / (10000 / 51.0 - 10000 / 52.0) else p51 + (p50 - p51) * (period - 10000 / 51.0) / (10000 / 50.0 - 10000 / 51.0) end) as intensity
    from powers cross join grid group by all)
    select s.sample_id, w.gene, round(coalesce(intensity, 0), 6) as intensity from (select distinct sample_id from runs) s cross join windows w left join scores on scores.sample_id = s.sample_id and scores.gene = w.gene"""
)
def gene_spectrum(spark, sf_dir):
    return _round(spectrum.gene_scores(_signal(spark, sf_dir), overlap.gene_windows(pseudo.genes(spark), 10_000)), "intensity")


@query(
    f"""with {_RUNS}, ahead as (select *, lead(p) over (partition by sample_id, chrom order by p) as q from runs),
    whole as (select sample_id, chrom, p, p_end, wps from runs union all select sample_id, chrom, p_end, q, 0 from ahead where q > p_end),
    marked as (select *, case when lag(wps) over w = wps then 0 else 1 end as fresh from whole window w as (partition by sample_id, chrom order by p)),
    numbered as (select *, sum(fresh) over (partition by sample_id, chrom order by p) as run from marked),
    merged as (select sample_id, chrom, run, min(p) as p, max(p_end) as p_end, min(wps) as wps from numbered group by all),
    seen as (select *, lag(wps) over w as l, lead(wps) over w as r from merged window w as (partition by sample_id, chrom order by p))
    select sample_id, chrom, cast(floor((p + p_end - 1) / 2.0) as bigint) as center, wps as score from seen where l < wps and r < wps"""
)
def nucleosome_candidates(spark, sf_dir):
    return peaks.candidates(_signal(spark, sf_dir))


@query()
def nucleosome_calls(spark, sf_dir):
    return peaks.call(_signal(spark, sf_dir))


# Aneuploidy --------------------------------------------------------------

_SHARES = f"{_dense_sql(WIDE_BIN)}, shares as (select sample_id, chrom, bin, n / sum(n) over (partition by sample_id) as x from filled where bin_end > bin_start), panel as (select chrom, bin, avg(x) as m, stddev_samp(x) as sd from shares group by all)"
_DENSITY = "-0.5 * pow((x - {m}) / sd, 2) - ln(sd) - 0.5 * ln(2 * pi())"


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aneuploidy.shares(bins.dense_counts(pseudo.reads(spark, sf_dir), pseudo.CONTIGS, WIDE_BIN).where("bin_end > bin_start"))


@query(
    f"""with {_SHARES}, joined as (select * from shares join panel using (chrom, bin)),
    inferred as (select *, avg(x - m) filter (where starts_with(chrom, 'chr21')) over w * 2 * avg(1 / m) filter (where starts_with(chrom, 'chr21')) over w as f from joined window w as (partition by sample_id)),
    grown as (select *, case when starts_with(chrom, 'chr21') then m * 1.05 else m end as g1, case when starts_with(chrom, 'chr21') then m * (1 + f / 2) else m end as g2 from inferred),
    scaled as (select *, g1 / sum(g1) over w as a1, g2 / sum(g2) over w as a2 from grown window w as (partition by sample_id)),
    sums as (select sample_id, 2 * sum({_DENSITY.format(m="a1")} - ({_DENSITY.format(m="m")})) as llr, 2 * sum({_DENSITY.format(m="a2")} - ({_DENSITY.format(m="m")})) as again, any_value(f) as f from scaled group by 1)
    select sample_id, round(llr, 5) as llr, cast(0.1 as double) as ff, round(case when llr > 0 then again end, 5) as llr_updated, round(case when llr > 0 then f end, 5) as ff_inferred, round(case when llr > 0 then f / 0.1 end, 5) as ratio from sums"""
)
def llr_t21(spark, sf_dir):
    shares = _shares(spark, sf_dir)
    found = aneuploidy.trisomy_ratio(shares, aneuploidy.panel_statistics(shares), ff=0.1)
    return _round(found, "llr", "llr_updated", "ff_inferred", "ratio", places=5)


@query(f"with {_SHARES} select sample_id, (select count(*) from panel) - count(*) filter (where (bin * 31 + ord) % 4 <> cast(right(sample_id, 1) as int) % 4) as n_missing from (select shares.*, filled.ord from shares join filled using (sample_id, chrom, bin)) group by 1")
def panel_missing_bins(spark, sf_dir):
    """Samples without some bins, as a check before a ratio."""
    shares = _shares(spark, sf_dir)
    order = F.right("chrom", F.lit(2)).cast("int") - 20
    some = shares.where((F.col("bin") * 31 + order) % 4 != F.right("sample_id", F.lit(1)).cast("int") % 4)
    return aneuploidy.missing_bins(some, aneuploidy.panel_statistics(shares))


@query(f"with {_SHARES} select sample_id, round(sum(x * ((bin * 7 + cast(right(chrom, 1) as int)) % 13 - 6) / 10.0) + 0.05, 6) as ff from shares group by 1")
def ff_linear(spark, sf_dir):
    weights = _bin_table(spark, WIDE_BIN).where("bin_end > bin_start").select("chrom", "bin", (((F.col("bin") * 7 + F.right("chrom", F.lit(1)).cast("int")) % 13 - 6) / F.lit(10.0)).alias("coef"))
    return _round(aneuploidy.fetal_fraction(_shares(spark, sf_dir), weights, 0.05), "ff")


@query(
    f"""with {_dense_sql(WIDE_BIN)}, whole as (select *, sum(n) over (partition by sample_id) as total from filled where bin_end % {WIDE_BIN} = 0 and not regexp_matches(chrom, '^chr[MXY]'))
    select sample_id, chrom, bin, n from whole where total > 100 and total < 1e6"""
)
def panel_filter(spark, sf_dir):
    counted = bins.dense_counts(pseudo.reads(spark, sf_dir), pseudo.CONTIGS, WIDE_BIN)
    return aneuploidy.depth_filter(aneuploidy.full_bins(counted, WIDE_BIN), 100, 1e6).select("sample_id", "chrom", "bin", "n")


# The store ---------------------------------------------------------------

_VALUES = f"vals as ({pseudo.VALUES_SQL}), latest as (select sample_id, feature_name, arg_max(value, version) as value, max(version) as version from vals group by all)"
_STATS = "stats as (select feature_name, avg(value) as mean, stddev_samp(value) as std from latest group by 1)"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(pseudo.values(spark, sf_dir))


@query(f"with {_VALUES} select sample_id, feature_name, value, version from latest")
def store_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


@query("with ingests as (select cast(c_custkey as varchar) as sample_id, c_acctbal as v, 1 as ingest, c_custkey as r from customer union all select cast(c_custkey as varchar), -c_acctbal, 2, c_custkey from customer where c_custkey % 5 = 0) select sample_id, arg_max(v, ingest) as value from ingests group by 1")
def store_ties(spark, sf_dir):
    """Two ingests under one version: the later one counts, wherever its rows stand."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    first = store.split_rejected(store.melt(customer, "c_custkey", {"c_acctbal": "Float64"}, 1)["Float64"])[0]
    again = customer.where("c_custkey % 5 = 0").withColumn("c_acctbal", -F.col("c_acctbal"))
    second = store.split_rejected(store.melt(again, "c_custkey", {"c_acctbal": "Float64"}, 1)["Float64"])[0]
    return store.latest(second.unionByName(first)).select("sample_id", "value")


@query(f"with {_VALUES}, {_STATS} select feature_name, round(mean, 6) as mean, round(std, 6) as std from stats")
def store_feature_stats(spark, sf_dir):
    return _round(store.feature_statistics(_latest(spark, sf_dir)), "mean", "std")


@query("select count(distinct s) as n_samples from (select cast(user_id as varchar) as s from events union all select cast(c_custkey as varchar) from customer)")
def store_sample_count(spark, sf_dir):
    return store.sample_count(pseudo.values(spark, sf_dir), _table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as sample_id"))


@query(f"with {_VALUES} select sample_id, {', '.join(f"max(value) filter (where feature_name = '{t}') as {t}" for t in EVENT_TYPES)} from latest group by 1")
def store_wide_pivot(spark, sf_dir):
    return store.widen(_latest(spark, sf_dir), EVENT_TYPES)


@query(
    """select cast(c_custkey as varchar) as sample_id, 'balance' as feature_name, c_acctbal as value from customer where c_acctbal is not null
    union all select cast(c_custkey as varchar), 'c_nationkey', cast(c_nationkey as double) from customer where c_nationkey is not null"""
)
def store_melt(spark, sf_dir):
    melted = store.melt(_table(spark, sf_dir, "customer"), "c_custkey", {"c_acctbal": "Float64", "c_nationkey": "Float64"}, 1, {"c_acctbal": "balance"})
    good, _ = store.split_rejected(melted["Float64"])
    return good.select("sample_id", "feature_name", "value")


@query("select 'p_brand' as feature_name, count(*) as n_rejected from part where p_brand is not null union all select 'p_size', count(*) from part where p_size > 20")
def store_rejected(spark, sf_dir):
    part = _table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_size") > 20, F.col("p_size") + 300).otherwise(F.col("p_size")))
    return store.split_rejected(store.melt(part, "p_partkey", {"p_brand": "UInt8", "p_size": "UInt8"}, 1)["UInt8"])[1]


@query(f"with {_VALUES} select sample_id, feature_name, value, version from latest where feature_name not in ('view', 'error')")
def store_drop_features(spark, sf_dir):
    return store.drop_features(_latest(spark, sf_dir), spark.createDataFrame([("view",), ("error",)], "feature_name string"))


_GROUP_NAMES = "names as (select case when p_size % 5 = 0 then cast(p_partkey as varchar) when p_size % 5 = 1 then p_brand || '-csm' when p_size % 5 = 2 then 'x-5p' when p_size % 5 = 3 then 'chr' || cast(p_size as varchar) || '_0_' || cast(p_partkey as varchar) else p_name end as feature_name from part)"
_IS_CORE = "((regexp_matches(feature_name, '^[0-9]+$') and try_cast(feature_name as bigint) between 0 and 999) or ends_with(feature_name, '-csm') or ends_with(feature_name, '-5p') or regexp_matches(feature_name, '^(chr)?[0-9XYMT]+_[0-9]+_[0-9]+$', 'i'))"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.selectExpr("case when p_size % 5 = 0 then cast(p_partkey as string) when p_size % 5 = 1 then p_brand || '-csm' when p_size % 5 = 2 then 'x-5p' when p_size % 5 = 3 then 'chr' || cast(p_size as string) || '_0_' || cast(p_partkey as string) else p_name end as feature_name")


@query(
    f"""with {_GROUP_NAMES} select feature_name, {_IS_CORE} as is_core,
    case when regexp_matches(feature_name, '^[0-9]+$') and try_cast(feature_name as bigint) between 1 and 1000 then 'fszd' when ends_with(feature_name, '-csm') then 'csm' when ends_with(feature_name, '-5p') then '5p' when regexp_matches(feature_name, '^(chr)?[0-9XYMT]+_[0-9]+_[0-9]+$', 'i') then 'bincount' end as grp
    from (select distinct feature_name from names)"""
)
def feature_groups(spark, sf_dir):
    name = F.col("feature_name")
    return _names(spark, sf_dir).distinct().select(name, store.is_core(name).alias("is_core"), store.group_of(name).alias("grp"))


@query(
    f"""with {_GROUP_NAMES}, one as (select distinct feature_name from names)
    select feature_name, 'Float64' as data_type, cast(length(feature_name) as double) as mean, cast(null as double) as std,
        case when length(feature_name) % 3 = 0 then (case when length(feature_name) % 2 = 0 then 'meta2' when {_IS_CORE} then 'core' else 'meta' end) when {_IS_CORE} then 'core' else 'meta' end as feature_type,
        case when length(feature_name) % 3 = 0 then 'old' else 'new' end as description from one"""
)
def catalog_merge(spark, sf_dir):
    one = _names(spark, sf_dir).distinct()
    fresh = one.select("feature_name", F.lit("Float64").alias("data_type"), F.length("feature_name").cast("double").alias("mean"), F.lit(None).cast("double").alias("std"))
    typed = fresh.unionByName(fresh.withColumns({"data_type": F.lit("UInt8"), "mean": F.lit(0.0)}))  # the same names in two types
    existing = one.where("length(feature_name) % 3 = 0").selectExpr("feature_name", "case when length(feature_name) % 2 = 0 then 'meta2' else 'meta' end as feature_type", "'old' as description")
    return store.merge_catalog(typed, existing, description="new")


def _integer_sql(table: str, column: str) -> str:
    return f"select '{column}' as column_name, case when min({column}) >= 0 then (case when max({column}) < 256 then 'UInt8' when max({column}) < 65536 then 'UInt16' when max({column}) < 4294967296 then 'UInt32' else 'Int64' end) when min({column}) >= -128 and max({column}) < 128 then 'Int8' when min({column}) >= -32768 and max({column}) < 32768 then 'Int16' else 'Int32' end as data_type from {table}"


@query(
    f"""{_integer_sql("customer", "c_custkey")} union all {_integer_sql("customer", "c_nationkey")} union all
    select 'c_acctbal', case when count(*) filter (where abs(c_acctbal - cast(cast(c_acctbal as float) as double)) > 1e-9 + 1e-6 * abs(c_acctbal)) = 0 then 'Float32' else 'Float64' end from customer
    union all select 'c_mktsegment', 'String' union all select 'c_name', 'String'"""
)
def infer_types(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    found = infer.types(customer, ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "c_name"])
    return spark.createDataFrame(list(found.items()), "column_name string, data_type string")


# The explorer ------------------------------------------------------------


@query("select c_custkey, c_acctbal, c_mktsegment from customer where c_acctbal between -100 and 2500 and c_custkey >= 10")
def filter_range(spark, sf_dir):
    specs = [{"column": "c_acctbal", "op": "range", "lo": -100, "hi": 2500}, {"column": "c_custkey", "op": "range", "lo": 10}]
    return filters.apply(_table(spark, sf_dir, "customer"), specs).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("select c_custkey from customer where c_custkey % 3 <> 0 and c_acctbal between 0 and 3000")
def filter_range_text(spark, sf_dir):
    """Numbers in text; with a type letter after them, as in 12d, they are none."""
    text = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat(cast(c_acctbal as string), case when c_custkey % 3 = 0 then 'd' else '' end) as balance")
    return filters.apply(text, [{"column": "balance", "op": "range", "lo": 0, "hi": 3000}]).select("c_custkey")


@query("select c_custkey, c_mktsegment from customer where regexp_matches(c_mktsegment, 'U[IR]|^MACH')")
def filter_regex(spark, sf_dir):
    return filters.apply(_table(spark, sf_dir, "customer"), [{"column": "c_mktsegment", "op": "==", "expr": "U[IR]|^MACH"}]).select("c_custkey", "c_mktsegment")


@query("select c_custkey, seg from (select c_custkey, case when c_custkey % 3 <> 0 then c_mktsegment end as seg from customer) where not regexp_matches(coalesce(seg, 'nan'), 'U[IR]')")
def filter_not_regex(spark, sf_dir):
    holes = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"))
    return filters.apply(holes, [{"column": "seg", "op": "!=", "expr": "U[IR]"}])


def _bucket_sql(v: str) -> str:
    return f"cast(case when {v} < 0 then 0 when {v} >= 8000 then 21 else floor({v} * 20 / 8000.0) + 1 end as bigint)"


@query(f"select {_bucket_sql('c_acctbal')} as bucket, count(*) as n from customer where c_acctbal is not null group by all")
def hist_counts(spark, sf_dir):
    return explore.histogram(_table(spark, sf_dir, "customer"), "c_acctbal", 0, 8000, 20)


@query(f"with h as (select c_mktsegment as colour, {_bucket_sql('c_acctbal')} as bucket, count(*) as n from customer group by all) select colour, bucket, round(n / sum(n) over (partition by colour), 6) as share from h")
def hist_probability_by_color(spark, sf_dir):
    return _round(explore.histogram_by_colour(_table(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment", 0, 8000, 20), "share")


@query("with e as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as e from customer) select c_custkey, cast((c_acctbal > e[1])::int + (c_acctbal > e[2])::int + (c_acctbal > e[3])::int as int) as qbin from customer, e")
def qcut_bins(spark, sf_dir):
    return explore.quantile_bin(_table(spark, sf_dir, "customer"), "c_acctbal", 4).select("c_custkey", "qbin")


@query("select c_mktsegment as value, count(*) as n, cast(row_number() over (order by count(*) desc, c_mktsegment) as int) as rank from customer group by 1")
def category_order(spark, sf_dir):
    return explore.category_order(_table(spark, sf_dir, "customer"), "c_mktsegment")


@query(
    f"""with {_VALUES}, chosen as (select * from latest where cast(sample_id as bigint) % 7 = 0), size as (select count(distinct sample_id) as k from chosen)
    select cast(null as varchar) as sample_id, feature_name, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as sd, count(value) as n from chosen where (select k from size) >= 6 group by 2
    union all select sample_id, feature_name, round(value, 6), null, 1 from chosen where (select k from size) < 6"""
)
def selection_band(spark, sf_dir):
    values = _latest(spark, sf_dir)
    return _round(explore.selection_band(values, values.where(F.col("sample_id").cast("long") % 7 == 0)), "mean", "sd")


@query(f"with {_VALUES} select sample_id, feature_name, round(value, 6) as mean, cast(null as double) as sd, cast(1 as bigint) as n from latest where sample_id in ('1', '2', '3')")
def selection_of_few(spark, sf_dir):
    """A comparison of five samples at most shows each of them."""
    values = _latest(spark, sf_dir)
    return _round(explore.selection_band(values, values.where(F.col("sample_id").isin("1", "2", "3"))), "mean")


@query(f"with {_VALUES}, {_STATS} select feature_name, round(mean, 6) as mean, round(mean - coalesce(std, 0), 6) as low, round(mean + coalesce(std, 0), 6) as high from stats where feature_name in ('click', 'view')")
def population_band(spark, sf_dir):
    wanted = spark.createDataFrame([("click",), ("view",)], "feature_name string")
    return _round(explore.population_band(wanted, store.feature_statistics(_latest(spark, sf_dir))), "mean", "low", "high")


@query(f"with {_VALUES}, {_STATS} select feature_name, round(value, 6) as value, round(mean, 6) as mean, round(abs(value - mean), 6) as off from latest join stats using (feature_name) where sample_id = '7' order by abs(value - mean) desc, feature_name limit 3")
def deviation_topk(spark, sf_dir):
    values = _latest(spark, sf_dir)
    return _round(explore.deviations(values, store.feature_statistics(values), "7", 3), "value", "mean", "off")


_Z = f"{_SHARES}, scored as (select sample_id, chrom, bin, x as value, m as mean, sd as std, (x - m) / sd as z from shares join panel using (chrom, bin) where sd <> 0)"


def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _shares(spark, sf_dir)
    panel = aneuploidy.panel_statistics(shares).withColumnsRenamed({"m": "mean", "sd": "std"})
    return explore.z_scores(shares.withColumnRenamed("x", "value"), panel, ["chrom", "bin"])


@query(f"with {_Z} select sample_id, chrom, bin, round(value, 6) as value, round(mean, 6) as mean, round(std, 6) as std, round(z, 5) as z from scored")
def bincount_zscore(spark, sf_dir):
    return _round(_round(_z(spark, sf_dir), "value", "mean", "std"), "z", places=5).select("sample_id", "chrom", "bin", "value", "mean", "std", "z")


@query(f"with {_Z} select sample_id, chrom, round(sum(z) / sqrt(count(*)), 5) as stouffer_z, count(*) as n, abs(sum(z) / sqrt(count(*))) >= 1.5 as is_outlier from scored group by all")
def stouffer_by_chrom(spark, sf_dir):
    return _round(explore.stouffer(_z(spark, sf_dir), ["sample_id", "chrom"], 1.5), "stouffer_z", places=5)


@query(f"with {_Z} select sample_id, chrom, bin, abs(z) >= 1.2 as is_outlier from scored")
def bin_outliers(spark, sf_dir):
    return explore.flag_outliers(_z(spark, sf_dir), 1.2).select("sample_id", "chrom", "bin", "is_outlier")


@query("select c_custkey, c_name from customer order by c_custkey offset 40 limit 20")
def table_page(spark, sf_dir):
    """The third page of a table; the limit is the feature."""
    return explore.page(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 2, 20, ["c_custkey"])


_SIZES = ", ".join(f"({i}, '{c}', {n})" for i, (c, n) in enumerate(explore.CHROMOSOMES.items()))


@query(f"select ord, chrom, cast(size as bigint) as size, cast(sum(size) over (order by ord) - size as bigint) as \"offset\" from (values {_SIZES}) t(ord, chrom, size)")
def genome_offsets(spark, sf_dir):
    rows = [(i, c, n) for i, (c, n) in enumerate(explore.CHROMOSOMES.items())]
    return explore.offsets(spark.createDataFrame(rows, "ord int, chrom string, size long"))


@query("select c_custkey, c_acctbal from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def selection_semi_join(spark, sf_dir):
    chosen = _table(spark, sf_dir, "orders").where("o_totalprice > 300000").selectExpr("o_custkey as c_custkey")
    return _table(spark, sf_dir, "customer").join(chosen, "c_custkey", "left_semi").select("c_custkey", "c_acctbal")


@query(f"with {_VALUES}, wide as (select sample_id, max(value) filter (where feature_name = 'click') as x, max(value) filter (where feature_name = 'view') as y, max(value) filter (where feature_name = 'error') as c from latest group by 1) select sample_id as _sample_id, round(log10(x), 6) as x, y, c as colour from wide where x > 0 and y is not null")
def scatter_points(spark, sf_dir):
    return _round(explore.scatter(store.widen(_latest(spark, sf_dir), EVENT_TYPES), "click", "view", "error", log_x=True), "x")


@query()
def embedding_pca(spark, sf_dir):
    """Sizes, cut-site motifs and 5' motifs of each sample as one vector, projected on two components."""
    df = pseudo.reads(spark, sf_dir)
    motif = motifs.cut_site(df, pseudo.tiles(spark), pseudo.contigs(spark), tile_size=pseudo.TILE)
    parts = [
        (sizes.zero_filled(df, 0, 1000, "freq"), "size"),
        (motifs.zero_filled(motif, df, how="freq"), "motif"),
        (motifs.zero_filled(motifs.five_prime(df), df, canonical=False, how="freq"), "motif"),
    ]
    rows = models.vectors(parts)
    return _round(models.project(rows, models.fit_pca(rows)), "umap1", "umap2").select("sample_id", F.size("features").alias("n_features"), F.abs("umap1").alias("umap1"), F.abs("umap2").alias("umap2"))


@query(f"with {_KMERS} select motif, {_rc('motif')} as rc, least(motif, {_rc('motif')}) as canonical, translate(motif, 'AGCT', 'RRYY') as purpyr from kmers")
def kmer_vocabulary(spark, sf_dir):
    rows = spark.range(1).select(F.explode(seq.kmers(4)).alias("motif"))
    return rows.select("motif", seq.revcomp("motif").alias("rc"), seq.canonical("motif").alias("canonical"), seq.purine_pyrimidine("motif").alias("purpyr"))


