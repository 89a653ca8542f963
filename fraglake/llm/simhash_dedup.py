"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``blocks`` pieces.  Two that differ in at most
``distance`` bits agree on at least ``blocks - distance`` pieces, so they share one
of the keys made of that many pieces; fingerprints are joined on those keys and
verified by Hamming distance.  With 4 blocks and 2 bits a key has 32 bits.

Copies are collapsed first: only distinct fingerprints are joined, each with the
smallest id that has it.  A key that many different fingerprints share isn't
expanded into pairs: there, each fingerprint is put at all points within
``distance`` / 2 bits (65 of them for 2 bits; for an odd distance there are outer points,
one bit farther), and those that meet at a point are linked to the smallest that has it
as an inner one.  Two fingerprints meet so exactly when they differ in at most
``distance`` bits, so the components are the same, from a number of rows that is in
proportion to the fingerprints.

Components come from alternating large-star and small-star steps over the links
(Kiverias et al., "Connected Components in MapReduce and Beyond"), each step
written to the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any
other; null ids are kept and take part, without being the smallest id of anything
(a component of null ids alone has a null component id); repeated rows are kept;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store

SHINGLE_WORDS = 3
DISTANCE = 2
BLOCKS = 4
#: Fingerprints under one key above which they are linked through points instead of pairs.
PAIRS_UP_TO = 16
#: Beyond this distance the points around a fingerprint are too many.
MAX_DISTANCE = 4


def simhash(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one text: XXH64 (seed 42) of each shingle, then the majority of each bit."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle_words + 1)
    stops = ends[min(shingle_words, len(words)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 15):
        hashes = [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[lo : min(n, lo + (1 << 15))].tolist(), stops[lo : lo + (1 << 15)].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column | str, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a long (the same 64 bits, signed)."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        found = [simhash((t.as_py() or "").encode(), shingle_words) for t in column]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    return of(text)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _keys(fp: str, blocks: int, distance: int) -> Column:
    """An array of (key number, key), one for each choice of blocks - distance blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(k).alias("number"), F.col(fp).bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*keys)


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Links (a, b), a < b, between the distinct longs in ``prints.fp``.

    Any two within ``distance`` bits end up in one component; every link stands for
    two that are within ``distance`` bits.
    """
    if distance >= blocks:
        raise ValueError("blocks must be more than distance")
    keyed = prints.select("fp", F.explode(_keys("fp", blocks, distance)).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("number", "key").agg(F.count("*").alias("n"), F.min("fp").alias("low"))
    shared = keyed.join(sizes.where("n > 1"), ["number", "key"])
    few, many = shared.where(F.col("n") <= pairs_up_to), shared.where(F.col("n") > pairs_up_to)
    left, right = few.select("number", "key", F.col("fp").alias("a")), few.select("number", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["number", "key"]).where("a < b").where(_distance("a", "b") <= distance).select("a", "b")
    if distance > MAX_DISTANCE:
        raise ValueError(f"links through points are for up to {MAX_DISTANCE} bits: {sum(comb(64, r) for r in range(-(-distance // 2) + 1))} points a fingerprint are too many")
    flips = [sum(1 << i for i in chosen) for r in range(-(-distance // 2) + 1) for chosen in combinations(range(64), r)]
    crowd = many.select("fp").distinct()
    table = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in flips])
    points = crowd.select("fp", F.explode(table).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.bit_count("flip") <= distance // 2).alias("inner"))
    hubs = points.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.count("*").alias("n")).where("n > 1 and a is not null")
    near = points.join(hubs.select("point", "a"), "point").where("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    return pairs.union(near).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on links (a, b), a < b; after a large star links may repeat."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node is either a root or linked to one root only: then nothing changes any more."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("a").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return seen.where("up > 1 or (up = 1 and least = 0)").limit(1).count() == 0


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node but the roots of links (a, b), a < b; root is the smallest node that can be reached."""
    edges = _store.materialize(edges.distinct(), "links", narrow=True)
    for _ in range(max_rounds):
        if _settled(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = _store.materialize(_star(_star(edges, True), False), "links", narrow=True)
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, distance: int = DISTANCE, blocks: int = BLOCKS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """One row a document: doc_id, fp (long), component_id."""
    prints = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(text_col, shingle_words).alias("fp"))
    return assign(_store.materialize(prints, "prints"), distance=distance, blocks=blocks, pairs_up_to=pairs_up_to)


def assign(prints: DataFrame, *, distance: int = DISTANCE, blocks: int = BLOCKS, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """``prints`` (columns doc_id and fp, read more than once) with root, the class, and component_id, its smallest doc_id."""
    distinct = _store.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct.select("fp"), distance, blocks, pairs_up_to))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select(*prints.columns, "root", "component_id")


def fingerprint_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, **options) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id (a null id counts as the largest).

    Rows are numbered in a written copy, so rows that repeat are told apart.  Texts
    pass through no join but the last, against the numbers of the rows to leave out.
    """
    row, fp = _store.free_name(docs, "__row"), _store.free_name(docs, "__fp")
    numbered = docs.withColumns({row: F.monotonically_increasing_id(), fp: fingerprint(F.col(f"`{text_col}`"), shingle_words)})
    staged = _store.materialize(numbered, "numbered")
    found = assign(staged.select(F.col(row).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(fp).alias("fp")), **options)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kept = found.groupBy("root").agg(F.min_by("row", order).alias("row")).select(F.col("row").alias(row))
    dropped = _store.few(staged.select(row).join(kept, row, "left_anti"), staged.count())
    return staged.join(dropped, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
