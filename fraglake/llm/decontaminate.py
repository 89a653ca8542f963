"""Benchmark decontamination with spaced seeds.

A spaced seed is a fixed mask over consecutive words: some positions count, the
others are ignored.  The words at the counted positions are hashed for every place of
the training texts and of the benchmark items, and the two are joined; a changed word
costs only the seeds that count it.  A text and an item that share a seed are laid side
by side at the shifts that their seeds suggest, and overlap if some ``window`` words
(the whole item, if it has fewer) agree in at least ``similarity`` of them.

The masks below find every stretch of 13 words with up to 2 changed ones.  An item of
fewer words is cut into one segment more than it may have changed words, so one of
them stands unharmed (``tests/llm`` tries all changes of both).

The join: a Bloom filter of the items' seeds, of bounded size, is sent to the tasks
that read the texts, and only seeds that pass it, each once a text, go into an equi-join
with the items' seeds.  That side is broadcast where its counted rows are few, and
shuffled otherwise.  Texts are then verified against the items they share a seed with;
only texts with a hit are moved.  Along one shift all windows come from one running
sum, and there are no more shifts than words, so repeated words cost no more than the
product of both lengths.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z, so
case, punctuation and white space don't matter.

Defined results: null and empty texts and items match nothing; an item id that is null
or repeats is reported as it is, once for each such row; equal documents each get their
own rows; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store, _text

#: Fixed masks for items of at least a window; 1: the word counts.
MASKS = ("11111", "1101011", "1110011")
WINDOW = 13
SIMILARITY = 0.8
#: Bits of the filter for each seed, and at most in all (32 MB).
FILTER_BITS, MAX_FILTER_BITS = 64, 1 << 28
FILTER_PROBES = 6
#: Seeds and items of the benchmark that may be broadcast, of about 32 bytes and of so many bytes of text.
BROADCAST_SEEDS, BROADCAST_BYTES = 1_000_000, 32 << 20
_CELLS = 1 << 20

FOUND = "struct<doc_first: int, doc_last: int, item_first: int, n_equal: int, n_words: int>"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a window of texts, and where each text's words begin."""
    data = _text.lower(data)
    starts, ends, first = _text.spans(_text.ALNUM[data], offsets)
    return _text.SpanHash(data)(starts, ends), first


def _words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return words_of(raw, np.array([0, len(raw)]))[0]


def needed(n_words: int, window: int = WINDOW, similarity: float = SIMILARITY) -> tuple[int, int]:
    """How many words are laid side by side for an item of ``n_words``, and how many of them have to agree."""
    size = min(window, n_words)
    return size, max(1, int(np.ceil(similarity * size - 1e-9)))


def segments(n_words: int, window: int = WINDOW, similarity: float = SIMILARITY) -> list[int]:
    """Lengths of the parts of an item shorter than the window, one more than words of it may differ."""
    size, equal = needed(n_words, window, similarity)
    parts = size - equal + 1
    edges = [size * i // parts for i in range(parts + 1)]
    return [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _seed(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each place that has len(mask) words from there on; of different masks they are different."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, int(mask, 2) + (len(mask) << 32), dtype=np.uint64)
    for i, counted in enumerate(mask):
        if counted == "1":
            out = (out ^ hashes[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
    return out


def item_seeds(words: np.ndarray, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> np.ndarray:
    """The distinct seeds by which an item is found."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    if len(words) >= window:
        return np.unique(np.concatenate([_seed(words, m) for m in masks]))
    at, out = 0, []
    for n in segments(len(words), window, similarity):
        out.append(_seed(words[at : at + n], "1" * n))
        at += n
    return np.unique(np.concatenate(out))


def masks_for(sizes: list[int], masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> tuple[str, ...]:
    """The masks that texts have to be read with, for items of the given numbers of words (at least ``window``: as ``window``)."""
    wanted = {m for n in sizes if n >= window for m in masks}
    wanted |= {"1" * k for n in sizes if 0 < n < window for k in segments(n, window, similarity)}
    return tuple(sorted(wanted))


class SeedFilter:
    """A Bloom filter over seeds, as bytes of a bit array."""

    def __init__(self, words: np.ndarray) -> None:
        self.bits = words.view(np.uint8)
        self._mask = np.uint64(8 * len(self.bits) - 1)

    @staticmethod
    def places(seeds: np.ndarray, mask: np.uint64, k: int) -> np.ndarray:
        return ((_text.mix(seeds + np.uint64(k)) if k else seeds) & mask).view(np.int64)

    def passing(self, seeds: np.ndarray) -> np.ndarray:
        """Which seeds may be in the filter."""
        left = np.arange(len(seeds))
        for k in range(FILTER_PROBES):
            at = self.places(seeds[left] if k else seeds, self._mask, k)
            left = left[np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)]
        return left


def shared_seeds(hashes: np.ndarray, first: np.ndarray, known: SeedFilter, masks: tuple[str, ...]) -> list[np.ndarray]:
    """For each text, its distinct seeds that pass the filter."""
    found, owner = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for mask in masks:
        seeds = _seed(hashes, mask)
        at = known.passing(seeds)
        text = np.searchsorted(first, at, side="right") - 1
        inside = at + len(mask) <= first[text + 1]
        found.append(seeds[at[inside]])
        owner.append(text[inside])
    seeds, texts = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((seeds, texts))
    seeds, texts = seeds[order], texts[order]
    keep = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (texts[1:] != texts[:-1])])[: len(seeds)])
    return np.split(seeds[keep], np.searchsorted(texts[keep], np.arange(1, len(first) - 1)))


def shifts(doc: np.ndarray, item: np.ndarray, masks: tuple[str, ...], window: int, similarity: float) -> np.ndarray:
    """The shifts (place in the text less place in the item) that shared seeds suggest; all, if seeds repeat so much that there are fewer shifts than pairs of places."""
    pairs = [np.zeros(0, dtype=np.int64)]
    if len(item) >= window:
        sides = [(_seed(doc, m), _seed(item, m), 0) for m in masks]
    else:
        at = np.concatenate([[0], np.cumsum(segments(len(item), window, similarity))])
        sides = [(_seed(doc, "1" * int(b - a)), _seed(item[a:b], "1" * int(b - a)), int(a)) for a, b in zip(at[:-1], at[1:], strict=True)]
    total = 0
    for mine, theirs, begin in sides:
        order = np.argsort(theirs, kind="stable")
        known = theirs[order]
        lo, hi = np.searchsorted(known, mine, side="left"), np.searchsorted(known, mine, side="right")
        n = hi - lo
        total += int(n.sum())
        if total > len(doc) + len(item):
            return np.arange(-len(item) + 1, len(doc))
        at = np.flatnonzero(n)
        place = order[np.repeat(lo[at], n[at]) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n[at]) - n[at], n[at])]
        pairs.append(np.repeat(at, n[at]) - place - begin)
    return np.unique(np.concatenate(pairs))


def longest_overlap(doc: np.ndarray, item: np.ndarray, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> tuple[int, int, int, int, int] | None:
    """The longest run of confirmed windows, the first of equals: first and last word in the text, first in the item, equal words, words."""
    if not len(doc) or not len(item):
        return None
    size, equal_words = needed(len(item), window, similarity)
    found, best = shifts(doc, item, masks, window, similarity), None
    reach, step = np.arange(len(item)), max(1, _CELLS // len(item))
    for lo in range(0, len(found), step):
        shift = found[lo : lo + step]
        at = shift[:, None] + reach
        same = (doc.take(at, mode="clip") == item) & (at >= 0) & (at < len(doc))
        sums = np.zeros((len(shift), len(item) + 1), dtype=np.int32)
        np.cumsum(same, axis=1, dtype=np.int32, out=sums[:, 1:])
        good = sums[:, size:] - sums[:, :-size] >= equal_words  # a window of the item, by where it begins
        begins = np.arange(good.shape[1])
        good &= (shift[:, None] + begins >= 0) & (shift[:, None] + begins + size <= len(doc))
        row, begin = np.nonzero(good)
        if not len(row):
            continue
        # Windows that overlap or touch make a run.
        fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] > begin[:-1] + size)]))
        last = np.append(fresh[1:], len(row)) - 1
        r, a, b = row[fresh], begin[fresh], begin[last] + size
        k = np.lexsort((a + shift[r], a - b))[0]
        mine = (int(b[k] - a[k]), -int(a[k] + shift[r[k]]), int(a[k]), int(sums[r[k], b[k]] - sums[r[k], a[k]]))
        best = mine if best is None or mine[:2] > best[:2] else best
    if best is None:
        return None
    n, doc_first, item_first, equal = best[0], -best[1], best[2], best[3]
    return doc_first, doc_first + n - 1, item_first, equal, n


def _seeds_of_items(text: str, options: dict) -> Column:
    @F.arrow_udf("struct<n: int, seeds: array<long>>")
    def of(column: pa.Array) -> pa.Array:
        words = [_words(t.as_py()) for t in column]
        seeds = [item_seeds(w, **options).view(np.int64) for w in words]
        return pa.StructArray.from_arrays([pa.array([len(w) for w in words], type=pa.int32()), pa.array(seeds, type=pa.list_(pa.int64()))], names=["n", "seeds"])

    return of(text)


def _hits_of_texts(text: Column, bits: np.ndarray, masks: tuple[str, ...]) -> Column:
    known = SeedFilter(bits)

    @F.arrow_udf("array<long>")
    def of(column: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for w in _text.windows(column):
            out += [s.view(np.int64) for s in shared_seeds(*words_of(w.data, w.offsets), known, masks)]
        return pa.array(out, type=pa.list_(pa.int64()))

    return of(text)


def _overlap(text: str, item: str, options: dict) -> Column:
    kind = pa.struct([(n, pa.int32()) for n in ("doc_first", "doc_last", "item_first", "n_equal", "n_words")])

    @F.arrow_udf(FOUND)
    def of(texts: pa.Array, items: pa.Array) -> pa.Array:
        out, before, words = [], None, np.zeros(0, dtype=np.uint64)
        for text, item in zip(texts, items, strict=True):
            text = text.as_py()
            if text != before:
                before, words = text, _words(text)
            hit = longest_overlap(words, _words(item.as_py()), **options)
            out.append(None if hit is None else dict(zip(("doc_first", "doc_last", "item_first", "n_equal", "n_words"), hit, strict=True)))
        return pa.array(out, type=kind)

    return of(text, item)


class Benchmark:
    """A benchmark's items and seeds, written to the shared folder, and the filter over its seeds."""

    def __init__(self, benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> None:
        self.options = {"masks": masks, "window": window, "similarity": similarity}
        rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("item_text"))
        self.items = _store.materialize(rows.withColumn("s", _seeds_of_items("item_text", self.options)).where("s.n > 0").select("item", "item_id", "item_text", "s.*"), "items")
        sizes = self.items.groupBy(F.least("n", F.lit(window)).alias("n")).agg(F.sum(F.size("seeds")).alias("seeds"), F.sum(F.octet_length("item_text")).alias("bytes")).collect()  # at most `window` rows
        self.masks = masks_for([r["n"] for r in sizes], masks, window, similarity)
        self.n_seeds, self.n_bytes = sum(r["seeds"] for r in sizes), sum(r["bytes"] for r in sizes)

    def seeds(self) -> DataFrame:
        """item, seed; a third of the items may share a seed, so nothing is gathered by it."""
        rows = self.items.select("item", F.explode("seeds").alias("seed"))
        return F.broadcast(rows) if self.n_seeds <= BROADCAST_SEEDS else rows

    def texts(self) -> DataFrame:
        rows = self.items.select("item", "item_id", "item_text")
        return F.broadcast(rows) if self.n_bytes <= BROADCAST_BYTES else rows

    def filter_bits(self) -> np.ndarray:
        """The filter; built by aggregation, at most MAX_FILTER_BITS bits come to the driver."""
        n_bits = 64
        while n_bits < min(FILTER_BITS * self.n_seeds, MAX_FILTER_BITS):
            n_bits *= 2
        mask = np.uint64(n_bits - 1)

        @F.arrow_udf("array<long>")
        def places(column: pa.Array) -> pa.Array:
            seeds = column.to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.stack([SeedFilter.places(seeds, mask, k) for k in range(FILTER_PROBES)], axis=1)
            return pa.array(list(at), type=pa.list_(pa.int64()))

        at = self.items.select(F.explode("seeds").alias("seed")).select(F.explode(places("seed")).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(n_bits // 64, dtype=np.int64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        return words

    def confirm(self, suspects: DataFrame) -> DataFrame:
        """row, item_id and where they overlap, for ``suspects`` (row, text, hits) that are written already."""
        pairs = suspects.select("row", F.explode("hits").alias("seed")).join(self.seeds(), "seed").select("row", "item").distinct()
        laid = suspects.select("row", "text").join(pairs, "row").join(self.texts(), "item")
        return laid.withColumn("found", _overlap("text", "item_text", self.options)).where("found is not null").select("row", "item_id", "found.*")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id and where."""
    known = Benchmark(benchmark, id_col=item_col, text_col=item_text_col, **options)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hit = rows.withColumn("hits", _hits_of_texts(F.col("text"), known.filter_bits(), known.masks)).where(F.size("hits") > 0)
    suspects = _store.materialize(hit, "suspects")
    return known.confirm(suspects).join(suspects.select("row", "doc_id"), "row").select("doc_id", "item_id", "doc_first", "doc_last", "item_first", "n_equal", "n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that overlap any item.

    Each row is written once with its hits; rows without any pass untouched.
    """
    known = Benchmark(benchmark, id_col=item_col, text_col=item_text_col, **options)
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), record, F.col(f"`{text_col}`").alias("text"))
    staged = rows.withColumn("hits", _hits_of_texts(F.col("text"), known.filter_bits(), known.masks))
    staged = _store.materialize(staged.select("row", "record", F.when(F.size("hits") > 0, F.col("text")).alias("text"), "hits"), "scanned")
    suspects = staged.where(F.size("hits") > 0)
    leaks = known.confirm(suspects.select("row", "text", "hits")).select("row").distinct()
    return staged.where(F.size("hits") <= 0).select("record.*").union(suspects.join(leaks, "row", "left_anti").select("record.*"))
