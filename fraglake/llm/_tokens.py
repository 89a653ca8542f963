"""Whole texts to token ids with the tokenizers library.

The byte-level pattern of the vocabulary always begins a new pre-token at a space
that a non-space follows, and at a mark after a letter.  A text can thus be cut there,
each piece encoded by itself, and the ids of short pieces remembered; the result
equals encoding the whole text.  Pieces are cut, looked up and put together again by array operations: a short
piece is compared as the three integers that its bytes are, so lookups are exact.
Pieces that aren't known go to the library, joined by their spaces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import _text

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Pieces that are remembered; when there are more, remembering begins anew.
CACHE_PIECES = 750_000
#: Longer pieces, in bytes, are encoded each time.
CACHE_BYTES = 24
#: Unknown pieces that go to the library as one text.
JOINED = 256

_LETTER, _MARK, _SPACE, _FOLLOWS = 1, 2, 4, 8
#: Of each byte: whether it is an ASCII letter, a mark (other ASCII but digits and white space), a space, and may follow a space without being white
#: space.  Lead bytes under which Unicode has white space are left out of the last: not cutting is always right.
_KINDS = np.full(256, _FOLLOWS, dtype=np.uint8)
_KINDS[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = 0
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_KINDS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] |= _MARK
_KINDS[0x20] |= _SPACE
#: 1 where a byte may be white space, or begin it.
_ODD = (_KINDS & _FOLLOWS == 0).astype(np.uint8).tobytes()
#: What of an integer belongs to a piece with so many bytes in it.
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Ids of short byte strings: a hash table in arrays, with linear probing."""

    def __init__(self, limit: int) -> None:
        self.limit, self._slots = limit, 1 << max(4, (4 * limit // 3).bit_length())
        self.clear()

    def clear(self) -> None:
        self.size, self._used = 0, 0
        #: A row a slot: three integers of bytes, then where its ids begin << 16 | how many there are << 8 | bytes of the string (0: an empty slot).
        self._rows = np.zeros((self._slots, 4), dtype=np.uint64)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (self.hashed(keys) >> np.uint64(65 - self._slots.bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each string, where its ids begin << 16 | how many there are << 8 | its bytes; 0: not known."""
        slot = self._home(keys)
        out = np.zeros(len(slot), dtype=np.uint64)
        rest, wanted = np.arange(len(slot)), sizes.astype(np.uint64)
        while len(rest):
            rows = self._rows.take(slot, axis=0)
            have = rows[:, 3]
            same = ((have & np.uint64(255)) == wanted) & (rows[:, 0] == keys[0]) & (rows[:, 1] == keys[1]) & (rows[:, 2] == keys[2])
            hit = np.flatnonzero(same)
            out[rest[hit]] = have[hit]
            more = np.flatnonzero(~same & (have != 0))
            rest, keys, wanted = rest[more], keys[:, more], wanted[more]
            slot = (slot[more] + 1) & (self._slots - 1)
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """Strings of different hashes that aren't in the table, and their ids one after another."""
        if self._used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), dtype=np.uint32)])
        self.ids[self._used : self._used + len(flat)] = flat
        first = self._used + np.cumsum(counts) - counts
        self._used += len(flat)
        self.size += len(counts)
        slot, rest = self._home(keys), np.arange(len(counts))
        meta = first.astype(np.uint64) << np.uint64(16) | counts.astype(np.uint64) << np.uint64(8) | sizes.astype(np.uint64)
        while len(rest):
            at = slot[rest]
            free = np.flatnonzero(self._rows[at, 3] == 0)
            to, who = at[free], rest[free]
            self._rows[to, 3] = meta[who]  # of those that want one slot, the last has it: first << 16 is different for each
            won = np.flatnonzero(self._rows[to, 3] == meta[who])
            self._rows[to[won], :3] = keys[:, who[won]].T
            rest = np.delete(rest, free[won])
            slot[rest] = (slot[rest] + 1) & (self._slots - 1)


class PieceEncoder:
    """Encodes texts piece by piece."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Python worker has one core; the library's threads would only spin
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._leads[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self._table = PieceTable(cache_pieces)
        self._kinds = _KINDS.copy()
        for token in self._tokenizer.get_added_tokens_decoder().values():  # matched as they are: no cuts inside
            inner = np.frombuffer(token.content.encode(), dtype=np.uint8)
            if 32 in inner:
                raise ValueError("a vocabulary whose added tokens hold spaces can't be encoded by pieces")
            self._kinds[inner[1:][_KINDS[inner[:-1]] & _LETTER > 0]] &= ~np.uint8(_MARK)
        self._table_of_kinds = self._kinds.tobytes()

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has.

        Plain pieces, a space and what surely has no white space, are joined; of the
        ids, those that begin with a space begin a piece.
        """
        joined = [pieces[i] for i in np.flatnonzero(plain).tolist()]
        parts = self._raw([b"".join(joined[i : i + JOINED]).decode() for i in range(0, len(joined), JOINED)])
        flat = np.concatenate([*parts, np.zeros(0, dtype=np.uint32)])
        cuts = np.flatnonzero(self._leads[flat])
        if len(cuts) != len(joined):
            raise RuntimeError("a piece was not encoded by itself")
        counts = np.zeros(len(pieces), dtype=np.int64)
        counts[plain] = np.diff(cuts, append=len(flat))
        if plain.all():
            return flat, counts
        rest = self._raw([pieces[i].decode() for i in np.flatnonzero(~plain).tolist()])
        counts[~plain] = [len(ids) for ids in rest]
        here = np.repeat(plain, counts)
        out = np.empty(len(here), dtype=np.uint32)
        out[here], out[~here] = flat, np.concatenate(rest)
        return out, counts

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin; each text begins one."""
        kinds = np.frombuffer(data.tobytes().translate(self._table_of_kinds), dtype=np.uint8)
        begins = np.zeros(len(data) + 1, dtype=np.uint8)
        begins[:-2] = (kinds[:-1] & _SPACE) & (kinds[1:] >> 1)  # _FOLLOWS >> 1 is _SPACE
        begins[offsets[1:] - 1] = 0  # a space that ends its text
        begins[1:-1] |= (kinds[1:] >> 1) & kinds[:-1] & _LETTER  # _MARK >> 1 is _LETTER
        begins[offsets] = 1
        return np.flatnonzero(begins[:-1])

    def _flat(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and where each piece's begin."""
        table, n = self._table, len(data)
        if len(starts) > table.limit:
            half = len(starts) // 2
            cut = starts[half]
            (left, begin), (right, after) = self._flat(data[:cut], starts[:half]), self._flat(data[cut:], starts[half:] - cut)
            return np.concatenate([left, right]), np.concatenate([begin, begin[-1] + after[1:]])
        sizes = np.diff(starts, append=n)
        padded = np.zeros(n + CACHE_BYTES + 8, dtype=np.uint8)
        padded[:n] = data
        whole = np.ndarray((n + CACHE_BYTES,), dtype="<u8", buffer=padded.data, strides=(1,))
        keys = np.zeros((3, len(starts)), dtype=np.uint64)
        keys[0] = whole.take(starts) & _LOW_BYTES.take(sizes, mode="clip")
        for k in (1, 2):
            at = np.flatnonzero(sizes > 8 * k)
            keys[k, at] = whole.take(starts[at] + 8 * k) & _LOW_BYTES.take(sizes[at] - 8 * k, mode="clip")
        short = sizes <= CACHE_BYTES
        found = table.find(keys, sizes)  # never a long piece
        raw = odd = None

        def learn(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nonlocal raw, odd
            if raw is None:
                raw = data.tobytes()
                odd = np.zeros(n + 1, dtype=np.int32)
                np.cumsum(np.frombuffer(raw.translate(_ODD), dtype=np.uint8), dtype=np.int32, out=odd[1:])
            first, end = starts[at], starts[at] + sizes[at]
            plain = (data[first] == 32) & (sizes[at] > 1) & (odd[end] - odd[first] == 1)
            return self._learn([raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], plain)

        while len(missing := np.flatnonzero((found == 0) & short)):  # strings of equal hashes are learnt one after another
            fresh = missing[np.unique(table.hashed(keys[:, missing]), return_index=True)[1]]
            if table.size + len(fresh) > table.limit:
                table.clear()
                found[:] = 0
                continue
            table.add(keys[:, fresh], sizes[fresh], *learn(fresh))
            found[missing] = table.find(keys[:, missing], sizes[missing])
        first, count = (found >> np.uint64(16)).astype(np.int64), (found >> np.uint64(8) & np.uint64(255)).astype(np.int64)
        long = np.flatnonzero(~short)
        ids = np.zeros(0, dtype=np.uint32)
        if len(long):
            ids, count[long] = learn(long)
        begin = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(count, out=begin[1:])
        here = np.repeat(first - begin[:-1], count) + np.arange(begin[-1])
        if len(long):
            own = np.repeat(begin[long] - np.cumsum(count[long]) + count[long], count[long]) + np.arange(len(ids))
            here[own] = 0
        out = table.ids.take(here)
        if len(long):
            out[own] = ids
        return out, begin

    def encode_window(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a window; a very long text is taken in parts of whole pieces."""
        if not len(data):
            return [np.zeros(0, dtype=np.uint32)] * (len(offsets) - 1)
        starts = self._pieces(data, offsets)
        if len(data) <= 2 * _text.WINDOW_BYTES:
            ids, begin = self._flat(data, starts)
            edges = begin[np.searchsorted(starts, offsets)]
            return [ids[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        later = np.unique(np.searchsorted(starts, np.arange(_text.WINDOW_BYTES, len(data), _text.WINDOW_BYTES)))
        bounds = [0, *starts[later[later < len(starts)]].tolist(), len(data)]
        parts = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            lo, hi = np.searchsorted(starts, [a, b])
            parts.append(self._flat(data[a:b], starts[lo:hi] - a)[0])
        return [np.concatenate(parts)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        return [ids for w in _text.windows(pa.array(texts, type=pa.string())) for ids in self.encode_window(w.data, w.offsets)]


@lru_cache(maxsize=2)
def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """One encoder, with its table, for the life of a Python worker."""
    return PieceEncoder(path, cache_pieces)


def encode_column(texts: pa.Array, path: str, cache_pieces: int = CACHE_PIECES) -> Iterator[np.ndarray]:
    """The ids of each text of a string column, as unsigned 32-bit integers; null: none."""
    known = encoder(path, cache_pieces)
    for w in _text.windows(texts):
        yield from known.encode_window(w.data, w.offsets)


def token_ids(text: Column | str, path: str | None = None) -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers; null: none."""
    path = path or vocabulary_path()

    @F.arrow_udf("binary")
    def ids(column: pa.Array) -> pa.Array:
        return pa.array([x.astype("<u4").tobytes() for x in encode_column(column, path)], type=pa.binary())

    return ids(text)
