"""Best-fit packing of token pieces into fixed-length sequences by bin completion.

How pieces go together depends on their lengths alone.  The lengths are counted
(at most ``length`` distinct ones, however many pieces there are), the counts are
packed on the driver, and each piece finds its place from its rank among the
pieces of its length.  The tasks that cut the pieces number those of each length; what
the tasks before them have is added from the counts by task and length.  So pieces
aren't moved, and a length that a third of them have is dealt with by all tasks.

Bin completion: around the largest piece left, enumerate the fillings that no
other filling dominates, the first ones found by least waste; give up a branch whose
waste, added up, shows that it can't beat the best packing known, which best-fit
decreasing provides first.  All undominated fillings are enumerated, lazily, with all
numbers of bins that they can be used for, so a search that comes to its end proves
the number of bins least.  Its steps are bounded by ``max_steps``; beyond that the
best packing found is returned, and :class:`Packing` says whether it is proven.

Defined results: a null text is empty and has its end id alone; null or repeated
document ids and repeated rows are packed like all others; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _store, _tokens

#: Steps of the search (a piece length tried in a filling, or a branch) before it returns the best packing found.
MAX_STEPS = 1_000_000
#: Steps at a branch, and fillings without waste, after which those found so far are tried, least waste first.
FIRST_STEPS, FIRST_FILLINGS = 300, 3


@dataclass(frozen=True)
class Pattern:
    """``repeat`` bins that hold ``items``: pairs of a length and how many pieces have it."""

    items: tuple[tuple[int, int], ...]
    repeat: int

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.items)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: at least so many bins are needed."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    for small in [0, *(x for x in lengths if 2 * x <= capacity)]:
        huge = sum(n for x, n in counts.items() if x > capacity - small)
        half = [(x, n) for x, n in counts.items() if capacity - small >= x and 2 * x > capacity]
        rest = sum(x * n for x, n in counts.items() if 2 * x <= capacity and x >= small)
        room = sum((capacity - x) * n for x, n in half)
        best = max(best, huge + sum(n for _, n in half) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The incumbent.  Largest first; each bin is filled with the largest piece that fits, again and again."""
    left, patterns = dict(counts), []
    lengths = sorted((k for k, n in left.items() if n), reverse=True)
    while lengths:
        room, items, k = capacity, [], 0
        while k < len(lengths) and room:
            if lengths[k] <= room and (n := min(left[lengths[k]], room // lengths[k])):
                items.append((lengths[k], n))
                room -= n * lengths[k]
            k += 1
        repeat = min(left[x] // n for x, n in items)
        patterns.append(Pattern(tuple(items), repeat))
        for x, n in items:
            left[x] -= n * repeat
        lengths = [x for x in lengths if left[x]]
    return patterns


def _dominated(items: dict[int, int], waste: int, left: dict[int, int], lengths: list[int]) -> bool:
    """Whether a larger free piece could take the place of one of the filling, within its waste, or one more fits."""
    for small in [0, *items]:
        k = bisect_right(lengths, small + waste) - 1
        while k >= 0 and lengths[k] > small:
            if left[lengths[k]] > items.get(lengths[k], 0):
                return True
            k -= 1
    return False


class Budget:
    """Steps that may still be taken."""

    def __init__(self, steps: int) -> None:
        self.left = steps

    @property
    def spent(self) -> bool:
        return self.left <= 0


Filling = tuple[tuple[int, int], ...]


def fillings(left: dict[int, int], room: int, budget: Budget) -> Iterator[tuple[Filling, int] | None]:
    """All undominated fillings of ``room`` with their waste, larger pieces first; None at each step that gives none."""
    lengths = sorted(x for x, n in left.items() if n and x <= room)

    def go(room: int, top: int, items: Filling) -> Iterator[tuple[Filling, int] | None]:
        budget.left -= 1
        yield None
        k = min(top, bisect_right(lengths, room))
        if not room or not k:
            if not _dominated(dict(items), room, left, lengths):
                yield items, room
            return
        for j in range(k - 1, -1, -1):
            for n in range(min(left[lengths[j]], room // lengths[j]), 0, -1):
                yield from go(room - n * lengths[j], j, (*items, (lengths[j], n)))
                if budget.spent:
                    return

    yield from go(room, len(lengths), ())


def _in_order(found: Iterator[tuple[Filling, int] | None]) -> Iterator[tuple[Filling, int]]:
    """The first fillings by waste, then all others as they come."""
    first: list[tuple[Filling, int]] = []
    steps = whole = 0
    for f in found:
        if f is None:
            steps += 1
        else:
            first.append(f)
            whole += f[1] == 0
        if first and (steps >= FIRST_STEPS or whole >= FIRST_FILLINGS):
            break
    yield from sorted(first, key=lambda f: (f[1], len(f[0])))
    yield from (f for f in found if f is not None)


@dataclass(frozen=True)
class Packing:
    """Patterns, how many bins they are, the lower bound, and whether no packing has fewer bins."""

    patterns: list[Pattern]
    bins: int
    bound: int
    proven: bool


def bin_completion(counts: dict[int, int], capacity: int, max_steps: int = MAX_STEPS) -> Packing:
    """As few bins as possible for pieces of the given lengths; never more than best-fit decreasing needs."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    best = best_fit_decreasing(counts, capacity)
    best_bins, floor = sum(p.repeat for p in best), lower_bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())
    start = np.zeros(capacity + 1, dtype=np.int64)
    start[list(counts)] = list(counts.values())
    budget = Budget(max_steps)
    #: By digest of the counts left: the fewest bins that led there.
    seen: dict[bytes, int] = {}

    def branches(state: np.ndarray) -> Iterator[Pattern]:
        lengths = np.flatnonzero(state)
        left = dict(zip(lengths.tolist(), state[lengths].tolist(), strict=True))
        largest = int(lengths[-1])
        for filling, _ in _in_order(fillings({**left, largest: left[largest] - 1}, capacity - largest, budget)):
            items = dict(filling)
            items[largest] = items.get(largest, 0) + 1
            pieces = tuple(sorted(items.items(), reverse=True))
            for repeat in range(min(left[x] // n for x, n in pieces), 0, -1):
                yield Pattern(pieces, repeat)

    # Depth first; the stack holds a branch's state, bins, what leads to it and what is left to try there.
    stack: list[tuple[np.ndarray, int, Pattern | None, Iterator[Pattern]]] = []

    def enter(state: np.ndarray, bins: int, pattern: Pattern | None) -> None:
        nonlocal best, best_bins
        budget.left -= 1
        left = int(state @ sizes)
        # Bins so far, and what the rest needs if nothing more is wasted.
        if bins + -(-left // capacity) >= best_bins:
            return
        if not left:
            best_bins = bins
            best = [p for _, _, p, _ in stack if p is not None] + ([pattern] if pattern else [])
            return
        digest = hashlib.blake2b(state.tobytes(), digest_size=16).digest()
        if seen.get(digest, bins + 1) <= bins:
            return
        seen[digest] = bins
        stack.append((state, bins, pattern, branches(state)))

    sizes = np.arange(capacity + 1)
    if total:
        enter(start, 0, None)
    while stack and best_bins > floor and not budget.spent:
        state, bins, _, rest = stack[-1]
        pattern = next(rest, None)
        if pattern is None:
            stack.pop()
            continue
        after = state.copy()
        for x, n in pattern.items:
            after[x] -= n * pattern.repeat
        enter(after, bins + pattern.repeat, pattern)
    return Packing(best, best_bins, floor, best_bins == floor or not (stack or budget.spent))


@dataclass(frozen=True)
class Segments:
    """Where pieces of one length go, by rank: from ``first[i]`` on, ``per_bin[i]`` to each bin from ``bin[i]`` on, at ``offset[i]``."""

    first: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray


def segments(patterns: list[Pattern]) -> dict[int, Segments]:
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    bins = 0
    for p in patterns:
        at = 0
        for length, n in p.items:
            rows.setdefault(length, []).append((rank.get(length, 0), bins, n, at))
            rank[length] = rank.get(length, 0) + n * p.repeat
            at += length * n
        bins += p.repeat
    return {k: Segments(*(np.array(x, dtype=np.int64) for x in zip(*v, strict=True))) for k, v in rows.items()}


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, piece, start, length, ids, part (a number of the task) and rank (among the task's pieces of that length).

    Of a longer document only the first piece may be shorter.
    """
    vocabulary = vocabulary or _tokens.vocabulary_path()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end, part, ranks = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), [0] * (length + 1)
        for batch in batches:
            ids = _tokens.encode_column(batch.column(1), vocabulary)
            rows, held = tuple([] for _ in schema), 0
            for key, found in zip(batch.column(0).to_pylist(), ids, strict=True):
                raw = found.astype("<u4", copy=False).tobytes() + end
                n = len(raw) // 4
                edges = [0, *range(n % length or length, n + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(rows, (key, k, a, b - a, raw[4 * a : 4 * b], part, ranks[b - a]), strict=True):
                        column.append(value)
                    ranks[b - a] += 1
                held += n
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows, held = tuple([] for _ in schema), 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("rank", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids binary, part int, rank long")


def place(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset; they are read twice, so write them first.  Needs the columns length, part and rank."""
    counted = _store.materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts", narrow=True)  # at most `length` rows a task
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    table = segments(bin_completion(counts, length).patterns)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def where(size: pa.Array, rank: pa.Array) -> pa.Array:
        sizes, ranks = size.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        lengths, first = np.unique(sizes[order], return_index=True)
        for x, mine in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
            s = table[x]
            k = np.searchsorted(s.first, ranks[mine], side="right") - 1
            j = ranks[mine] - s.first[k]
            bins[mine] = s.bin[k] + j // s.per_bin[k]
            offsets[mine] = s.offset[k] + j % s.per_bin[k] * x
        return pa.StructArray.from_arrays([pa.array(bins), pa.array(offsets)], names=["sequence_id", "offset"])

    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    before = counted.select("length", "part", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    ranked = pieces.join(_store.few(before, counted.count()), ["length", "part"])
    placed = ranked.withColumn("placed", where("length", F.col("rank") + F.col("before")))
    return placed.select(*(c for c in pieces.columns if c not in ("part", "rank")), "placed.*")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their ids, sequence and place in it; gapless from 0 in each sequence."""
    pieces = cut(docs, id_col=id_col, text_col=text_col, length=length, end_id=end_id, vocabulary=vocabulary)
    return place(_store.materialize(pieces, "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, joined in order; a sequence has at most ``length`` ids, so its group is small."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
