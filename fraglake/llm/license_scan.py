"""License notices in text: exact phrases, and short notices with a few errors.

Base phrases are sequences of words, looked up exactly.  The notices of ``NOTICES``
may have up to ``errors`` inserted, deleted or changed characters.  A notice is split
into errors + 1 fragments: whatever the errors hit, one fragment stands in the text
unharmed (pigeonhole), so exact searches for the fragments give all candidates.
Around each candidate the ``regex`` library's bounded-error matching verifies the
notice and gives its span and errors.

Both work on the words of a text, lower-cased (A-Z) and joined by single spaces:
line breaks and punctuation don't matter.

Defined results: null and empty texts have no words, places or labels, and score 0;
null and repeated ids are kept as they are; repeated rows are scanned alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text

#: Exact phrases and their labels: fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int

    def fragments(self) -> list[tuple[int, bytes]]:
        """errors + 1 parts of about equal length, and where each begins."""
        raw, n = self.text.encode(), self.errors + 1
        edges = [round(len(raw) * i / n) for i in range(n + 1)]
        return [(a, raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


#: Notices as words joined by spaces; about one error for ten characters.
NOTICES = (
    Notice("licensed under the apache license version 2 0", "apache-2.0", 4),
    Notice("released under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("subject to the terms of the mozilla public license", "mpl", 4),
    Notice("licensed under the gnu general public license", "gpl-notice", 4),
    Notice("licensed under cc by nc 4 0", "cc-by-nc", 1),
    Notice("licensed under cc by sa 4 0", "cc-by-sa", 1),
    Notice("creative commons attribution", "cc-notice", 2),
    Notice("all rights reserved", "reserved-notice", 1),
)

SPANS = "array<struct<label: string, first_word: int, last_word: int, errors: int>>"
SCAN = f"struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: string, labels: string, score: double, spans: {SPANS}>"


@lru_cache(maxsize=256)
def _pattern(text: str, errors: int):
    import regex

    return regex.compile(rf"(?b)(?:{regex.escape(text)}){{e<={errors}}}")


def _all(hay: bytes, needle: bytes) -> Iterator[int]:
    at = hay.find(needle)
    while at >= 0:
        yield at
        at = hay.find(needle, at + 1)


class Words:
    """The words of a window of texts joined by single spaces, texts by a line break."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = _text.lower(data)
        word = _text.ALNUM[data]
        starts, ends, self.first = _text.spans(word, offsets)
        self.hashes = _text.SpanHash(data)(starts, ends)
        # Words that abut across texts keep a separator too: each word is followed by one byte.
        sizes = ends - starts
        out_end = np.cumsum(sizes + 1)
        self.starts = out_end - sizes - 1
        joined = np.full(int(out_end[-1]) if len(out_end) else 0, 32, dtype=np.uint8)
        shift = np.repeat(self.starts - starts, sizes)
        source = np.flatnonzero(word)
        joined[source + shift] = data[source]
        last = self.first[1:][np.diff(self.first) > 0] - 1
        joined[out_end[last] - 1] = 10
        self.joined, self.lo = joined.tobytes(), self.starts
        self.size = len(self.joined)

    def word_at(self, byte: np.ndarray | int) -> np.ndarray:
        return np.searchsorted(self.starts, byte, side="right") - 1


def exact(words: Words, phrases: tuple[tuple[str, str], ...]) -> list[tuple[np.ndarray, str]]:
    """For each phrase, the words at which it begins, all within one text."""
    owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out = []
    for phrase, label in phrases:
        wanted = _text.hash_words([w.encode() for w in phrase.split(" ")])
        n = len(words.hashes) - len(wanted) + 1
        if n <= 0:
            out.append((np.zeros(0, dtype=np.int64), label))
            continue
        hit = owner[:n] == owner[len(wanted) - 1 :]
        for k, h in enumerate(wanted):
            hit &= words.hashes[k : k + n] == h
        out.append((np.flatnonzero(hit), label))
    return out


def fuzzy(words: Words, notices: tuple[Notice, ...]) -> dict[int, list[tuple[str, int, int, int, float]]]:
    """By text: (label, first word, last word, errors, similarity) for each verified notice."""
    hay, found = words.joined, {}
    for notice in notices:
        size, slack = len(notice.text), notice.errors
        done = -size - slack  # below any place where a candidate could begin
        # Where the notice could begin at the earliest, and the fragment that says so.
        candidates = sorted({(at - offset - slack, at) for offset, part in notice.fragments() for at in _all(hay, part)})
        for lo, at in candidates:
            if lo < done:
                continue
            stop = min(len(hay), lo + size + 3 * slack + 1)
            cut = hay.rfind(b"\n", max(lo, 0), at)
            left = cut + 1 if cut >= 0 else max(lo, 0)
            cut = hay.find(b"\n", at, stop)
            right = cut if cut >= 0 else stop
            while left < right and hay[left] & 0xC0 == 0x80:
                left += 1
            piece = hay[left:right].decode("utf-8", "ignore")
            match = _pattern(notice.text, notice.errors).search(piece)
            if match is None:
                continue
            a = left + len(piece[: match.start()].encode())
            b = left + len(piece[: match.end()].rstrip().encode())
            if b <= a:
                continue
            w, v = int(words.word_at(a)), int(words.word_at(b - 1))
            text = int(np.searchsorted(words.first, w, side="right")) - 1
            base = int(words.first[text])
            wrong = sum(match.fuzzy_counts)
            found.setdefault(text, []).append((notice.label, w - base, v - base, wrong, 1 - wrong / size))
            done = b - slack
    return found


def scan(column: pa.Array, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[Notice, ...] = NOTICES) -> Iterator[dict]:
    """One row a text."""
    for w in _text.windows(column):
        words = Words(w.data, w.offsets)
        places: dict[int, list[tuple[int, str]]] = {}
        for starts, label in exact(words, base):
            texts = np.searchsorted(words.first, starts, side="right") - 1
            for t, at in zip(texts.tolist(), (starts - words.first[texts]).tolist(), strict=True):
                places.setdefault(t, []).append((at, label))
        near = fuzzy(words, notices)
        for t, n_words in enumerate(np.diff(words.first).tolist()):
            mine, spans = places.get(t, []), near.get(t, [])
            labels = {x for _, x in mine}
            yield {
                "n_words": n_words,
                "n_base": len(mine),
                "first_word": min((a for a, _ in mine), default=None),
                "last_word": max((a for a, _ in mine), default=None),
                "base_labels": ",".join(sorted(labels)),
                "labels": ",".join(sorted(labels | {s[0] for s in spans})),
                "score": 1.0 if mine else max((s[4] for s in spans), default=0.0),
                "spans": [{"label": s[0], "first_word": s[1], "last_word": s[2], "errors": s[3]} for s in sorted(spans, key=lambda s: (s[1], s[2], s[0]))],
            }


def licenses(text: Column | str, base: tuple[tuple[str, str], ...] = BASE, notices: tuple[Notice, ...] = NOTICES) -> Column:
    """The scan of a text as a struct."""
    span = pa.struct([("label", pa.string()), *((n, pa.int32()) for n in ("first_word", "last_word", "errors"))])
    kind = pa.struct([*((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    @F.arrow_udf(SCAN)
    def of(column: pa.Array) -> pa.Array:
        return pa.array(list(scan(column, base, notices)), type=kind)

    return of(text)


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: doc_id and the columns of the scan."""
    return docs.select(F.col(id_col).alias("doc_id"), licenses(text_col, **options).alias("scan")).select("doc_id", "scan.*")
