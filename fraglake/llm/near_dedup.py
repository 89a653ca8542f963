"""Near-duplicates by SimHash blocks, checked on the word shingles.

Two texts are near-duplicates if their sets of ``SHINGLE_WORDS``-word shingles have a
Jaccard similarity of at least ``SIMILARITY``.  Their SimHash fingerprints, over the
distinct shingles, then differ in at most 15 % of the bits on average, which is too many
for the few blocks of ``simhash_dedup``.  So the fingerprint is longer: ``blocks`` pieces
of ``bits`` bits each, and ``CHECK_BITS`` more that the candidates are compared by.  Bits
that differ are mostly those whose sums are near zero; in each block the ``WILD`` bits
with the smallest sums may have any value, so a text stands at 2^WILD points of each
block, and two texts meet in a block exactly if they agree on all bits that are wild in
neither.  Pairs that meet differ in at most ``CHECK_DISTANCE`` of the other bits, or are
left out; the rest are checked on the whole sets.  With more texts the blocks have more
bits, so that few strangers meet, and there are more blocks: at 0.8 about one pair in a
million meets nowhere (``MISSED``), and far fewer above.

Exact copies are collapsed first.  A text goes to the parts of a block that its points
are in, once for all of them, and each part is searched for itself: of the pairs there
that meet and are near, as many are linked as hold their texts together.  Components of
these links are groups: every pair that meets and is near is in one group.  In a group
of at most ``BLOCK_TEXTS`` texts all pairs are checked at once by matrix products.  In
a larger one each text is first checked against the nearest one that it is linked to;
the largest component that this leaves is the core, the others are stragglers.  Core and
stragglers are dealt into blocks of bounded size, and each pair of blocks, one of
stragglers at least, compares all its texts.  So every pair that meets and is near is
checked, or known to be in one component; no pairs are joined but one a text.

Words are what stands between ASCII white space, with A-Z lower-cased.  Defined
results: a text of fewer words than a shingle is one shingle; null and empty texts
are copies of each other; null ids are kept and count as the largest; repeated rows
are copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from .simhash_dedup import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits of a block that may have any value.
WILD = 3
#: The chance that a pair of just ``SIMILARITY`` meets in no block.
MISSED = 1e-6
#: Bits by which candidates are compared, and how many may differ: 6 standard deviations over the mean at ``SIMILARITY``.
CHECK_BITS, CHECK_DISTANCE = 128, 44
#: Numbers that a text's shingles are summed into, of which each bit of the fingerprint is a weighted sum.
SKETCH = 1024
#: Blocks whose points are shuffled at a time, to bound the disk that they take.
BLOCKS_AT_ONCE = 16
#: Texts of one part of a block, about, and texts that are dealt to the parts at a time.
PART_TEXTS, DEAL_TEXTS = 1 << 17, 1 << 14
#: Texts at one point up to which all pairs are compared; above it, only those that aren't linked yet.
PAIRS_UP_TO = 16
#: Texts and shingles up to which all pairs of a group are checked at once, and of one block of a larger one, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 1000, 1_000_000

def shingles(data: np.ndarray, offsets: np.ndarray, shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For a window of texts: hashes of all shingles, and where each text's begin; a shingle may repeat."""
    data = _text.lower(data)
    starts, ends, first = _text.spans(_text.NOT_SPACE[data], offsets)
    words = _text.SpanHash(data)(starts, ends)
    n = np.diff(first)
    many = np.where(n > 0, np.maximum(n - shingle_words + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(many)])
    at = np.repeat(first[:-1] - begin[:-1], many) + np.arange(begin[-1])
    last = np.repeat(first[1:], many)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(shingle_words):
        inside = at + k < last
        out = np.where(inside, _text.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(at + k, max(len(words) - 1, 0))] + np.uint64(1)), out)
    return out, begin


def shape(n_texts: int) -> tuple[int, int]:
    """Blocks and bits of a block for so many texts: strangers that meet at a point number about a quarter of its texts at most."""
    bits = min(32, max(16, n_texts.bit_length() + 5))
    # The chance to meet in one block at SIMILARITY, from 100,000 simulated pairs: 0.375, 0.240, 0.149 and 0.087 for 20, 24, 28 and 32 bits.
    meet = 0.37 * 0.886 ** (bits - 20)
    return ceil(log(MISSED) / log1p(-meet)), bits


@lru_cache(maxsize=2)
def _weights(n_bits: int) -> np.ndarray:
    """Whole numbers, so that sums are exact in any order."""
    normal = np.random.default_rng(20240517).standard_normal((SKETCH, n_bits), dtype=np.float32)
    return np.clip(np.rint(16 * normal), -64, 64)


def fingerprints(hashes: np.ndarray, begin: np.ndarray, blocks: int, bits: int) -> np.ndarray:
    """A row a text: ``CHECK_BITS`` / 64 longs to compare, then a long a block: its bits with the wild ones as 0, and from bit 32 on 5 bits for each wild bit's place."""
    m = len(begin) - 1
    out = np.zeros((m, CHECK_BITS // 64 + blocks), dtype=np.int64)
    weights = _weights(blocks * bits + CHECK_BITS)
    for lo in range(0, m, 512):
        n = min(512, m - lo)
        owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(begin[lo : lo + n + 1]))
        distinct = np.unique(owner << np.uint64(44) | hashes[begin[lo] : begin[lo + n]] >> np.uint64(20))
        at = (distinct >> np.uint64(44)).astype(np.int64) * SKETCH + (distinct & np.uint64(SKETCH - 1)).astype(np.int64)
        sketch = np.bincount(at, np.where(distinct & np.uint64(SKETCH), 1.0, -1.0), n * SKETCH).reshape(n, SKETCH)
        sums = sketch.astype(np.float32) @ weights
        out[lo : lo + n, : CHECK_BITS // 64] = np.packbits(sums[:, :CHECK_BITS] > 0, axis=1, bitorder="little").view("<i8")
        parts = sums[:, CHECK_BITS:].reshape(n, blocks, bits)
        wild = np.argpartition(np.abs(parts), WILD - 1, axis=2)[:, :, :WILD].astype(np.int64)
        value = (parts > 0) @ (np.int64(1) << np.arange(bits))
        value &= ~(np.int64(1) << wild).sum(axis=2)
        out[lo : lo + n, CHECK_BITS // 64 :] = value | (wild << (32 + 5 * np.arange(WILD))).sum(axis=2)
    return out


def signature(text: Column | str, blocks: int, bits: int) -> Column:
    """Of a text: a 128-bit digest of its words, and its fingerprint."""

    @F.arrow_udf("struct<digest: binary, print: array<long>>")
    def of(column: pa.Array) -> pa.Array:
        from xxhash import xxh3_128_digest

        digests = [xxh3_128_digest(b" ".join((t.as_py() or "").encode().lower().split())) for t in column]
        wide = CHECK_BITS // 64 + blocks
        parts = [fingerprints(*shingles(w.data, w.offsets), blocks, bits) for w in _text.windows(column)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0, dtype=np.int64)
        prints = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, wide, dtype=np.int32)), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(digests, type=pa.binary()), prints], names=["digest", "print"])

    return of(text)


def _wild_bits(code: np.ndarray) -> list[np.ndarray]:
    return [np.int64(1) << (code >> (32 + 5 * k) & 31) for k in range(WILD)]


def _corners(code: np.ndarray) -> np.ndarray:
    """The 2^WILD values that each code stands for, a row a code."""
    base, wild = code & 0xFFFFFFFF, _wild_bits(code)
    return np.stack([base + sum(wild[k] for k in range(WILD) if x >> k & 1) for x in range(1 << WILD)], axis=1)


def _dealt(rows: DataFrame, first: int, most: int, parts: int) -> DataFrame:
    """``rows`` (row, print) dealt to the parts of ``most`` blocks from ``first`` on: (number, part, entries), of longs: all rows, their bits to compare, word by word, and their codes.

    A part has the points with the same lowest bits; ``parts`` is a power of two.
    """
    n_check = CHECK_BITS // 64

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        row, prints = (np.concatenate(x) for x in zip(*held, strict=True))
        numbers, places, entries = [], [], []
        for number in range(first, min(first + most, prints.shape[1] - n_check)):
            code = prints[:, n_check + number]
            fixed = ~sum(_wild_bits(code)) & (parts - 1)
            for part in range(parts):
                at = np.flatnonzero((code ^ part) & fixed == 0)
                if len(at):
                    numbers.append(number)
                    places.append(part)
                    entries.append(np.concatenate([row[at], *prints[at, :n_check].T, code[at]]).tobytes())
        return pa.record_batch([pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), pa.array(entries, pa.binary())], ["number", "part", "entries"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch["row"].to_numpy(), batch["print"].flatten().to_numpy().reshape(batch.num_rows, -1)))
                n += batch.num_rows
            if n >= DEAL_TEXTS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return rows.select("row", "print").mapInArrow(deal, "number int, part int, entries binary")


def _entries(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, bits to compare and codes of one part, by row."""
    wide = CHECK_BITS // 64 + 2
    all_ = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64).reshape(wide, -1) for x in column], axis=1)
    all_ = all_[:, np.argsort(all_[0])]
    return all_[0], all_[1:-1].T.copy().view(np.uint64), all_[-1]


def _points(rows: DataFrame, first: int = 0, most: int = 1 << 20, parts: int = 1) -> DataFrame:
    """(row, key) for each point of ``most`` blocks of ``rows`` (row, print), from block ``first`` on, one by one."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, part, entries in zip(*(batch[k] for k in ("number", "part", "entries")), strict=True):
                row, _, code = _entries([entries])
                keys = _corners(code)
                here = keys & (parts - 1) == part.as_py()
                yield pa.record_batch([pa.array(np.repeat(row, here.sum(axis=1))), pa.array(keys[here] | number.as_py() << 32)], ["row", "key"])

    return _dealt(rows, first, most, parts).mapInArrow(listed, "row long, key long")


def _meetings(check: np.ndarray, code: np.ndarray, part: int, parts: int, pairs_up_to: int) -> np.ndarray:
    """Links (i, j, bits that differ), i < j, between texts of one part that meet and are near: any two such texts are held together by them, with at most two links a text."""
    m = len(code)
    keys = _corners(code).astype(np.uint64)
    points = (keys << np.uint64(32) | np.arange(m, dtype=np.uint64)[:, None])[keys & np.uint64(parts - 1) == part]
    points.sort()
    begin = np.flatnonzero(np.concatenate([[True], points[1:] >> np.uint64(32) != points[:-1] >> np.uint64(32)])) if len(points) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(points)]]))
    text = (points & np.uint64(0xFFFFFFFF)).astype(np.int64)
    parent, links = np.arange(m), []

    def root(x: np.ndarray) -> np.ndarray:
        up = parent[x]
        while (parent[up] != up).any():
            up = parent[up]
        parent[x] = up
        return up

    def differ(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(check[i] ^ check[j]).sum(axis=-1, dtype=np.int64)

    def connect(i: np.ndarray, j: np.ndarray, bits: np.ndarray) -> None:
        """Keep one link a component to a lower one until none is left, those of few bits first."""
        order = np.argsort(bits, kind="stable")
        i, j, bits = i[order], j[order], bits[order]
        while len(i):
            r, s = root(i), root(j)
            apart = r != s
            i, j, bits, r, s = (x[apart] for x in (i, j, bits, r, s))
            high, at = np.unique(np.maximum(r, s), return_index=True)
            parent[high] = np.minimum(r, s)[at]
            links.append(np.stack([i[at], j[at], bits[at]], axis=1))

    # Points of few texts: all pairs.
    few = (size > 1) & (size <= pairs_up_to)
    own = np.repeat(np.flatnonzero(few), size[few])
    at = np.arange(len(own)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + begin[own]
    members, pairs = text[at], []
    for step in range(1, int(size[few].max(initial=1))):
        same = np.flatnonzero(own[:-step] == own[step:])
        i, j = members[same], members[same + step]
        bits = differ(i, j)
        near = bits <= CHECK_DISTANCE
        pairs.append((i[near], j[near], bits[near]))
    if pairs:
        i, j, bits = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((i, bits, j))
        i, j, bits = i[order], j[order], bits[order]
        # Each text's nearest one before it, then what else holds components together.
        _, nearest = np.unique(j, return_index=True)
        parent[j[nearest]] = i[nearest]
        links.append(np.stack([i[nearest], j[nearest], bits[nearest]], axis=1))
        connect(i, j, bits)
    # Points of many: the first against all, then those that it isn't linked to against all.
    for k in np.flatnonzero(size > pairs_up_to):
        members = text[begin[k] : begin[k] + size[k]]
        others = members[root(members) != root(members[:1])]
        bits = differ(np.broadcast_to(members[:1], others.shape), others)
        near = bits <= CHECK_DISTANCE
        connect(np.full(near.sum(), members[0]), others[near], bits[near])
        others = members[root(members) != root(members[:1])]
        for lo in range(0, len(others), width := max(1, (1 << 20) // len(members))):
            some = others[lo : lo + width]
            bits = differ(some[:, None], members[None])
            x, y = np.nonzero((bits <= CHECK_DISTANCE) & (root(some)[:, None] != root(members)[None]))
            connect(np.minimum(some[x], members[y]), np.maximum(some[x], members[y]), bits[x, y])
    return np.concatenate(links) if links else np.zeros((0, 3), dtype=np.int64)


def _met(rows: DataFrame, first: int, parts: int, pairs_up_to: int) -> DataFrame:
    """Links (a, b, differ) of ``BLOCKS_AT_ONCE`` blocks from ``first`` on."""

    def meet(table: pa.Table) -> pa.Table:
        row, check, code = _entries(table["entries"])
        found = _meetings(check, code, table["part"][0].as_py(), parts, pairs_up_to)
        return pa.table({"a": row[found[:, 0]], "b": row[found[:, 1]], "differ": found[:, 2].astype(np.int32)})

    return _dealt(rows, first, BLOCKS_AT_ONCE, parts).groupBy("number", "part").applyInArrow(meet, "a long, b long, differ int")


def shingle_set(text: Column | str) -> Column:
    """The distinct shingles of a text, sorted."""

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for w in _text.windows(column):
            hashes, begin = shingles(w.data, w.offsets)
            out += [np.unique(hashes[a:b].view(np.int64)) for a, b in zip(begin[:-1], begin[1:], strict=True)]
        return pa.array(out, type=pa.list_(pa.int64()))

    return of(text)


def _similar(values: np.ndarray, ends: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets are similar enough; set i is values[ends[i]:ends[i + 1]]."""
    sizes = np.diff(ends)
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.zeros((m, m), dtype=np.float32)
    # Shingles of few texts pair by pair, the others as columns of a matrix, some at a time.
    few = count[number] <= 8
    rare, of = owner[few], number[few]
    for step in range(1, 8):
        same = np.flatnonzero(of[:-step] == of[step:])
        np.add.at(shared, (rare[same], rare[same + step]), 1)
        np.add.at(shared, (rare[same + step], rare[same]), 1)
    column = (np.cumsum(count > 8) - 1)[number[~few]]
    often = owner[~few]
    for lo in range(0, int((count > 8).sum()), 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        part = np.zeros((m, 2048), dtype=np.float32)
        part[often[a:b], column[a:b] - lo] = 1
        shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    return shared >= similarity * union - 1e-3 * (union > 0)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(lowest member, other member) for each component."""
    left, out = np.ones(len(near), dtype=bool), []
    for k in range(len(near)):
        if not left[k]:
            continue
        left[k] = False
        edge = np.array([k])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & left)
            left[edge] = False
            out += [(k, x) for x in edge.tolist()]
    return out


def _linked(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b) that hold the texts of ``table`` (row, shingles) together, by comparing all its pairs."""
    rows, lists = table["row"].to_numpy(), table["shingles"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    values = lists.flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    found = np.array(_forest(_similar(values, ends, similarity)), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": rows[found[:, 0]], "b": rows[found[:, 1]]})


def _group_links(members: DataFrame, bins: int, similarity: float) -> DataFrame:
    """Links in each group; ``members`` has crowd, row and the set, and several groups are compared in one bin."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("crowd", "ascending"), ("row", "ascending")])
        crowds = table["crowd"].to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], crowds[1:] != crowds[:-1]]))
        return pa.concat_tables([_linked(table.slice(a, b - a), similarity) for a, b in zip(begin, [*begin[1:], len(crowds)], strict=True)])

    return members.groupBy(F.pmod(F.xxhash64("crowd"), F.lit(bins)).alias("bin")).applyInArrow(compare, "a long, b long")


def _crowd_links(members: DataFrame, n_members: int, similarity: float, block_texts: int, block_shingles: int) -> DataFrame:
    """Links of stragglers, among themselves and to the core; ``members`` has crowd, row, core and the set."""
    blocks = F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum(F.size("shingles")) / block_shingles), F.lit(1)).cast("int")
    parts = members.groupBy("crowd", "core").agg(blocks.alias("n"))
    sizes = parts.groupBy("crowd").agg(F.coalesce(F.max(F.when(~F.col("core"), F.col("n"))), F.lit(0)).alias("outer"), F.coalesce(F.max(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("inner"))
    # A row a crowd.
    placed = members.join(_store.few(sizes.where("outer > 0"), n_members), "crowd")
    # Stragglers have the blocks from 0 on, the core those after them.
    own = F.when(F.col("core"), F.col("outer") + F.pmod(F.xxhash64("row"), F.col("inner")).cast("int")).otherwise(F.pmod(F.xxhash64("row"), F.col("outer")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("core"), F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1)
    pairs = placed.select("crowd", "row", "shingles", own.alias("b"), F.explode(others).alias("o"))
    grouped = pairs.select("crowd", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "row", "shingles").groupBy("crowd", "i", "j")

    return grouped.applyInArrow(lambda table: _linked(table.sort_by("row"), similarity), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, n_sets: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets are similar enough; only pairs whose sizes allow it are joined with their sets."""
    sizes = _store.few(sets.select("row", "n"), n_sets)
    m, n = sizes.select(F.col("row").alias("a"), F.col("n").alias("m")), sizes.select(F.col("row").alias("b"), "n")
    sized = pairs.join(m, "a").join(n, "b").where(F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n") - 1e-3)
    first, second = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    near = shared >= F.lit(similarity) * (F.col("m") + F.col("n") - shared) - 1e-3
    return sized.join(first, "a").join(second, "b").where(near).select("a", "b")


def _sets(texts: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(row, shingles, n) of the texts in ``wanted``."""
    sets = texts.join(_store.few(wanted, n_wanted), "row", "left_semi").select("row", shingle_set("text").alias("shingles"))
    return _store.materialize(sets.withColumn("n", F.size("shingles")), "sets")


def _joined(roots: DataFrame, links: DataFrame, n_rows: int) -> DataFrame:
    """(node, root) of the components of ``roots`` (node, root), settled, and ``links`` (a, b): only links between two of them are looked at."""
    known = _store.few(roots, n_rows)
    r, s = known.select(F.col("node").alias("a"), F.col("root").alias("r")), known.select(F.col("node").alias("b"), F.col("root").alias("s"))
    ends = links.distinct().join(r, "a", "left").join(s, "b", "left").select(F.coalesce("r", "a").alias("r"), F.coalesce("s", "b").alias("s"))
    between = ends.where("r <> s").select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct()
    return components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(between))


def classes(rows: DataFrame, texts: DataFrame, n_rows: int, *, similarity: float = SIMILARITY, pairs_up_to: int = PAIRS_UP_TO, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES, part_texts: int = PART_TEXTS) -> DataFrame:
    """(node, root) of the components of ``rows`` (row, print), at most ``n_rows``; ``texts`` (row, text) has their texts."""
    rows = _store.materialize(rows, "prints", narrow=True)
    parts = 1 << (max(1, -(-n_rows // part_texts)) - 1).bit_length()
    met = _store.materialize_parts([_met(rows, first, parts, pairs_up_to) for first in range(0, shape(n_rows)[0], BLOCKS_AT_ONCE)], "met", narrow=True)
    # First each text's nearest one, so that few links are left for the rounds of the others.
    best = _store.materialize(met.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")).select("a", "b"), "best", narrow=True)
    groups = _joined(components(best), met.select("a", "b"), n_rows)
    members = _store.materialize(groups.select(F.col("root").alias("crowd"), F.col("node").alias("row")).union(groups.select("root", "root").distinct()), "members", narrow=True)
    sets = _sets(texts, members.select("row"), n_rows)
    sized = members.join(_store.few(sets.select("row", "n"), n_rows), "row")
    large = sized.groupBy("crowd").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).where((F.col("texts") > block_texts) | (F.col("n") > block_shingles)).select("crowd")
    large = _store.materialize(large, "large", narrow=True)
    small = members.join(_store.few(large, n_rows), "crowd", "left_anti")
    links = _group_links(sets.select("row", "shingles").join(_store.few(small, n_rows), "row"), 4 * _store.shuffle_partitions(rows.sparkSession), similarity)
    if large.limit(1).count() == 0:
        return components(links)
    members = _store.materialize(members.join(_store.few(large, n_rows), "crowd", "left_semi"), "crowds", narrow=True)
    inside = _store.few(members.select("row"), n_rows)
    sets = _store.materialize(sets.join(inside, "row", "left_semi"), "crowd-sets")
    roots = components(_verified(best.join(inside.withColumnRenamed("row", "b"), "b", "left_semi"), sets, n_rows, similarity))
    named = members.join(_store.few(roots, n_rows), F.col("row") == F.col("node"), "left").select("crowd", "row", F.coalesce("root", "row").alias("root"))
    core = named.groupBy("crowd", "root").agg(F.count("*").alias("texts")).groupBy("crowd").agg(F.max_by("root", F.struct("texts", -F.col("root"))).alias("core"))
    placed = named.join(_store.few(core, n_rows), "crowd").select("crowd", "row", (F.col("root") == F.col("core")).alias("core"))
    placed = _store.materialize(placed, "placed", narrow=True)
    crowds = _crowd_links(sets.select("row", "shingles").join(_store.few(placed, n_rows), "row"), n_rows, similarity, block_texts, block_shingles)
    return components(_store.materialize_parts([links, crowds, roots.select(F.col("root").alias("a"), F.col("node").alias("b"))], "linked", narrow=True))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest id (a null id counts as the largest)."""
    row, sig = _store.free_name(docs, "__row"), _store.free_name(docs, "__sig")
    n_rows = docs.count()
    staged = _store.materialize(docs.withColumns({row: F.monotonically_increasing_id(), sig: signature(F.col(f"`{text_col}`"), *shape(n_rows))}), "numbered")
    order = F.struct(F.col(f"`{id_col}`").isNull().alias("last"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(row).alias("row"))
    distinct = _store.materialize(staged.groupBy(F.col(f"{sig}.digest").alias("digest")).agg(F.min(order).alias("first")).select("first"), "distinct", narrow=True)
    chosen = distinct.select(F.col("first.row").alias("row"))
    rows = staged.select(F.col(row).alias("row"), F.col(f"{sig}.print").alias("print")).join(chosen, "row", "left_semi")
    texts = staged.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    roots = classes(rows, texts, n_rows, **options)
    named = distinct.join(roots, F.col("first.row") == F.col("node"), "left").select("first", F.coalesce("root", "first.row").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    dropped = _store.few(staged.select(row).join(kept, row, "left_anti"), n_rows)
    return staged.join(dropped, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
