"""Token-ID output as Re-Pair grammars with random access.

Documents are encoded, put into ascending id order by a range partitioning and
cut into shards of whole documents.  In each shard, frequent adjacent pairs of
symbols are replaced by new symbols, again and again.  The shard stores the
rules, what each symbol expands to in length, and the remaining sequence; from
these any range of ids is decoded without decoding what stands before it.

The file format is a Parquet dataset with one row a shard; its ``payload`` is
described at :func:`pack_shard`.  Spark's commit protocol writes it, so a lost
executor leaves no half-written shard.

Defined results: a null text is empty (its ids are the end id alone); null ids
sort first; rows that repeat, or share an id, are kept, in any order among
themselves; an empty table gives an empty dataset; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _store, _tokens

#: Ids in a shard; a longer document is a shard by itself.
SHARD_TOKENS = 1 << 20
#: A pair that occurs less often gets no rule: a rule takes three words, a place that it replaces gives one.
MIN_COUNT = 4
#: A round takes the pairs that occur at least 1 / STEP as often as its most frequent one.
STEP = 4
#: Pieces that the encoder remembers here, where nothing else holds memory: about 90 MB.
CACHE_PIECES = 1_500_000
BROADCAST_SHARDS = 1_000_000
_MAGIC = b"RPSHARD1"


def compress(ids: np.ndarray, first_symbol: int, min_count: int = MIN_COUNT, step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: the rules (left, right; rule i defines symbol first_symbol + i) and the sequence left.

    Frequent pairs are replaced together: a round takes those that occur at least
    1 / ``step`` as often as the most frequent one, and where they overlap replaces the
    more frequent one.  Where pairs are in each other's way, the most frequent one goes
    alone.  It ends when no pair can be replaced ``min_count`` times.

    The sequence is a linked list in arrays.  Pairs are first counted by a short hash,
    which bounds their counts from above; the exact counts are taken of those that may
    be frequent enough.  A pair that is rare stays rare, so its places are left alone
    until a neighbour is replaced.
    """
    n, end = len(ids), np.uint32(0xFFFFFFFF)
    seq = np.full(n + 2, end, dtype=np.uint32)  # with a stop on each side
    seq[1:-1] = ids
    following, before = np.arange(1, n + 3, dtype=np.int32), np.arange(-1, n + 1, dtype=np.int32)
    alive = np.zeros(n + 2, dtype=bool)  # where a pair begins that may be frequent
    alive[1:n] = True
    weight = np.zeros(n + 2, dtype=np.int32)
    pair = np.zeros(n + 2, dtype=np.uint64)  # left << 32 | right, by where it begins
    pair[:-1] = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
    rules, symbol, rounds, ceiling, alone = [np.zeros((0, 2), dtype=np.uint32)], first_symbol, 0, n, False
    at, floor = np.arange(1, n), n
    while len(at) >= min_count:
        rounds += 1
        # A small table is quick, and bounds the counts well enough while only very frequent pairs are looked for.
        bits = min(18 if floor > 32 else 20, max(10, len(at).bit_length()))
        factor = np.uint64((0x9E3779B97F4A7C15 + rounds * 0xA24BAED4963EE406) % (1 << 64) | 1)  # another each round, so that pairs that met part
        pairs = pair.take(at)
        slot = ((pairs * factor) >> np.uint64(64 - bits)).view(np.int64)
        most = np.bincount(slot, minlength=1 << bits)
        top = int(most.max())
        if top < min_count:
            break
        floor = max(min_count, min(int(top / step), ceiling))
        kind = ((most >= min_count).view(np.uint8) + (most >= floor).view(np.uint8)).take(slot, mode="clip")
        alive[at.take(np.flatnonzero(kind == 0))] = False
        some = np.flatnonzero(kind == 2)
        pairs = pairs.take(some)
        keys = np.sort(pairs)
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        counts = np.diff(starts, append=len(keys))
        enough = np.flatnonzero(counts >= floor)
        order = enough[np.argsort(counts[enough], kind="stable")]  # of those that meet in a slot, the most frequent stays
        order = order[-1:] if alone else order
        keys, counts = keys[starts[order]], counts[order].astype(np.int32)
        number = np.full(1 << bits, -1, dtype=np.int32)
        number[((keys * factor) >> np.uint64(64 - bits)).view(np.int64)] = np.arange(len(keys), dtype=np.int32)
        mine = number.take(slot.take(some))
        hit = np.flatnonzero(mine >= 0)
        hit = hit[keys[mine[hit]] == pairs[hit]]
        mine = mine[hit]
        place, mine_weight = at[some[hit]], counts[mine]
        second_at = following[place]
        weight[place] = mine_weight
        best = np.flatnonzero((mine_weight >= weight[before[place]]) & (mine_weight >= weight[second_at]))
        weight[place] = 0
        place, second_at, mine = place[best], second_at[best], mine[best]
        run = np.concatenate([[True], place[1:] != second_at[:-1]])[: len(place)]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
        other = np.flatnonzero((np.arange(len(place)) - begin & 1) == 0)  # of neighbours in a run, every other one
        place, second_at, mine = place[other], second_at[other], mine[other]
        used = np.bincount(mine, minlength=len(keys)) >= min_count
        chosen = np.flatnonzero(used[mine])
        place, second_at, mine = place[chosen], second_at[chosen], mine[chosen]
        if not len(place):
            if floor == min_count and not len(keys):
                break
            if alone:
                alive[at[some[hit]]] = False
            alone = floor == min_count
            ceiling = max(min_count, int(floor / step))
            at = at[np.flatnonzero(alive[at])]
            continue
        alone = False
        ceiling = n
        rules.append(np.stack([keys[used] >> np.uint64(32), keys[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        seq[place] = (symbol + np.cumsum(used) - 1)[mine].astype(np.uint32)
        symbol += len(rules[-1])
        after = following[second_at]
        following[place], before[after] = after, place
        seq[second_at] = end
        alive[second_at] = False
        for changed in (place, before[place]):
            alive[changed] = True
            pair[changed] = seq[changed].astype(np.uint64) << np.uint64(32) | seq[following[changed]]
        alive[0] = False
        alive[place[after == n + 1]] = False
        if 64 * len(at) > n:
            at = np.flatnonzero(alive)
        else:  # not worth a look at all places
            at = np.unique(np.concatenate([at, before[place]]))
            at = at[np.flatnonzero(alive[at])]
    left = seq[1:-1]
    return np.concatenate(rules), left[left != end]


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """How many ids each rule's symbol stands for, as unsigned 32-bit integers."""
    lengths = np.zeros(len(rules), dtype=np.uint32)
    known = np.zeros(len(rules), dtype=bool)
    while not known.all():
        ready = ~known
        size = np.zeros(len(rules), dtype=np.uint32)
        for side in (0, 1):
            symbols = rules[:, side].astype(np.int64) - first_symbol
            inner = symbols >= 0
            ready &= ~inner | known[np.maximum(symbols, 0)]
            size += np.where(inner, lengths[np.maximum(symbols, 0)], 1).astype(np.uint32)
        lengths[ready] = size[ready]
        known |= ready
    return lengths


def expand(seq: np.ndarray, rules: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    seq = seq.astype(np.uint32)
    while len(seq) and (inner := seq >= first_symbol).any():
        out = np.repeat(seq, 1 + inner)
        left = np.flatnonzero(inner) + np.arange(int(inner.sum()))
        rule = rules[seq[inner].astype(np.int64) - first_symbol]
        out[left], out[left + 1] = rule[:, 0], rule[:, 1]
        seq = out
    return seq


def pack_shard(ids: np.ndarray, doc_starts: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray, first_symbol: int, **options: int) -> bytes:
    """A shard as bytes, all little-endian.

    Magic (8 bytes); six unsigned 32-bit integers (first symbol, documents, ids,
    rules, symbols in the sequence, CRC-32 of the ids); then document ids (signed
    64 bits), document starts (unsigned 32), null flags (8), rules (2 x 32),
    expansion lengths (32) and the sequence (32).
    """
    rules, seq = compress(ids, first_symbol, **options)
    head = np.array([first_symbol, len(doc_ids), len(ids), len(rules), len(seq), zlib.crc32(ids.astype("<u4").tobytes())], dtype="<u4")
    parts = [head, doc_ids.astype("<i8"), doc_starts.astype("<u4"), null_ids.astype("u1"), rules.astype("<u4"), expansion_lengths(rules, first_symbol).astype("<u4"), seq.astype("<u4")]
    return _MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, payload: bytes) -> None:
        if payload[:8] != _MAGIC:
            raise ValueError("not a shard")
        self.first_symbol, docs, self.n_ids, n_rules, n_seq, self.crc = (int(x) for x in np.frombuffer(payload, "<u4", 6, 8))
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.doc_starts, self.null_ids = take("<i8", docs), take("<u4", docs), take("u1", docs).astype(bool)
        self.rules, self.lengths, self.seq = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules), take("<u4", n_seq)

    def _sizes(self, seq: np.ndarray) -> np.ndarray:
        inner = seq >= self.first_symbol
        sizes = np.ones(len(seq), dtype=np.int64)
        sizes[inner] = self.lengths[seq[inner].astype(np.int64) - self.first_symbol]
        return sizes

    @cached_property
    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """What every symbol stands for, one after another, and where each begins."""
        whole = expand(np.arange(self.first_symbol, self.first_symbol + len(self.rules)), self.rules, self.first_symbol)
        starts = np.arange(self.first_symbol + len(self.rules), dtype=np.int64)
        starts[self.first_symbol :] = self.first_symbol + np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        return np.concatenate([np.arange(self.first_symbol, dtype=np.uint32), whole]), starts

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        flat, starts = self._flat
        sizes = self._sizes(seq)
        ends = np.cumsum(sizes)
        shift = np.repeat(starts[seq] - (ends - sizes), sizes)
        return flat[shift + np.arange(len(shift))]

    def ids(self) -> np.ndarray:
        """All ids; raises where they aren't those that were written."""
        known = not len(self.seq) or int(self.seq.max()) < self.first_symbol + len(self.rules)
        ids = self._expand(self.seq) if known else self.seq
        if not known or len(ids) != self.n_ids or zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a shard is damaged")
        return ids

    def range(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on, expanding only the symbols that cover them."""
        if start < 0 or count < 0 or start + count > self.n_ids:
            raise IndexError("beyond the shard")
        ends = np.cumsum(self._sizes(self.seq))
        lo, hi = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + count, side="left") + 1
        before = int(ends[lo - 1]) if lo else 0
        return expand(self.seq[lo:hi], self.rules, self.first_symbol)[start - before : start - before + count]

    def document(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document."""
        stop = int(self.doc_starts[k + 1]) if k + 1 < len(self.doc_starts) else self.n_ids
        return self.range(int(self.doc_starts[k]), stop - int(self.doc_starts[k]))


_SHARDS = "part int, shard int, n_docs long, n_ids long, payload binary"


def write(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0, first_symbol: int = 50257, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of ``docs`` in ascending id order to ``path``.

    The partitions are ranges of (id, text hash, salt): equal ids, even a third
    of all rows, spread over several, and stay together only in the order.
    """
    spark, vocabulary = docs.sparkSession, vocabulary or _tokens.vocabulary_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype=np.uint32)
        ids, keys, sizes, total, shard = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            payload = pack_shard(flat, starts, np.array([k or 0 for k in keys], dtype=np.int64), np.array([k is None for k in keys]), first_symbol)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_docs": len(keys), "n_ids": len(flat), "payload": payload}], schema=schema)

        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), _tokens.encode_column(batch.column(1), vocabulary, CACHE_PIECES), strict=True):
                size = len(found) + 1
                if keys and total + size > shard_tokens:
                    yield flush()
                    ids, keys, sizes, total, shard = [], [], [], 0, shard + 1
                ids += [found, end]
                keys.append(key)
                sizes.append(size)
                total += size
        if keys:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "salt": F.rand(11)})
    ordered = rows.repartitionByRange(_store.shuffle_partitions(spark), F.asc_nulls_first("key"), "tie", "salt").sortWithinPartitions(F.asc_nulls_first("key"), "tie")
    ordered.select("key", "text").mapInArrow(shards, _SHARDS).write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """One row a document, in any order: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    shards = spark.read.schema(_SHARDS).parquet(path)
    # One row a part (as many as partitions wrote), then one a shard within its part.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    parts = parts.select("part", (F.sum("in_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("in_part")).alias("part_start"))
    within = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    starts = shards.select("part", "shard", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("shard_start"))
    starts = starts.join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    if shards.count() <= BROADCAST_SHARDS:  # of 16 bytes each; beyond that the payloads are shuffled to them
        starts = F.broadcast(starts)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                shard = Shard(payload.as_py())
                raw, sizes = shard.ids().astype("<u4").tobytes(), np.diff(np.append(shard.doc_starts, shard.n_ids)).astype(np.int64)
                first = shard.doc_starts.astype(np.int64)
                ends = np.append(4 * first, len(raw))
                if len(raw) < 1 << 31:  # documents follow one another: one buffer, no copies
                    ids = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
                else:
                    ids = pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], type=pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, mask=shard.null_ids), pa.array(base + first), pa.array(sizes), ids],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return shards.join(starts, ["part", "shard"]).select("payload", "base").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
