"""BAM as a Spark data source.

A file is cut into byte ranges, one partition each.  A partition looks for the first
compressed block and, in it, the first record that starts at or after its range's
begin, by checking that a chain of plausible records follows; it reads until the
first record of the next range.  Files must be on a path that all executors mount.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S

CIGAR_LETTERS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
RANGE_BYTES = 64 << 20
_MAGIC = b"\x1f\x8b\x08\x04"
#: Consecutive plausible records that show where records begin.
CHAIN = 5


class Blocks:
    """Inflated blocks of a file from an offset on."""

    def __init__(self, path: str, offset: int = 0) -> None:
        self._file = open(path, "rb")  # noqa: SIM115
        self._file.seek(offset)
        self.offset = offset

    def next(self) -> tuple[int, bytes] | None:
        """Where the next block begins, and its content; None at the end."""
        at, head = self.offset, self._file.read(18)
        if len(head) < 18 or head[:4] != _MAGIC:
            return None
        extra = struct.unpack_from("<H", head, 10)[0]
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = self._file.read(size - 18)
        self.offset = at + size
        return at, zlib.decompress(body[extra - 6 : -8], -15)

    def close(self) -> None:
        self._file.close()


def header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Contigs, and the block and place in it where records begin."""
    blocks, data, starts = Blocks(path), b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            got = blocks.next()
            if got is None:
                raise ValueError(f"{path} ends within its header")
            starts.append((len(data), got[0]))
            data += got[1]

    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError(f"{path} isn't a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    need(at + 4)
    n, at, contigs = struct.unpack_from("<i", data, at)[0], at + 4, []
    for _ in range(n):
        need(at + 4)
        size = struct.unpack_from("<i", data, at)[0]
        need(at + 8 + size)
        contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
        at += 8 + size
    begin, block = max((s for s in starts if s[0] <= at), default=(0, 0))
    if at == len(data):
        begin, block = at, blocks.offset
    blocks.close()
    return contigs, block, at - begin


def _plausible(data: bytes, at: int, n_contigs: int) -> int | None:
    """Where the next record would begin if one begins here; None if none can."""
    if at + 36 > len(data):
        return None
    size, ref, pos, name, _, _, n_cigar, _, length, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 <= size < 1 << 28 and -1 <= ref < n_contigs and -1 <= next_ref < n_contigs and pos >= -1 and next_pos >= -1 and name >= 1 and length >= 0):
        return None
    if size < 32 + name + 4 * n_cigar + (length + 1) // 2 + length:
        return None
    end = at + 36 + name
    if end <= len(data) and (data[end - 1] != 0 or not all(33 <= c < 127 for c in data[at + 36 : end - 1])):
        return None
    return at + 4 + size


def find_record(path: str, start: int, n_contigs: int) -> tuple[int, int] | None:
    """The block, and the place in it, of a record in the first block at or after byte ``start``."""
    with open(path, "rb") as f:
        f.seek(start)
        window = f.read(1 << 17)
    at = window.find(_MAGIC)
    while at >= 0:
        try:
            blocks = Blocks(path, start + at)
            data, first = b"", None
            while len(data) < 1 << 18 and (got := blocks.next()) is not None:
                first = len(got[1]) if first is None else first
                data += got[1]
            blocks.close()
        except (zlib.error, struct.error):
            data, first = b"", None
        for place in range(first or 0):
            here, seen = place, 0
            while here is not None and here < len(data) and seen < CHAIN:
                here = _plausible(data, here, n_contigs)
                seen += here is not None
            if seen and (seen == CHAIN or here == len(data)):
                return start + at, place
        if data:
            return None
        at = window.find(_MAGIC, at + 1)
    return None


def decode(data: bytes, at: int, size: int, contigs: list[tuple[str, int]]) -> tuple:
    """One record's (qname, flag, chrom, start, end, mapq, cigar, tlen, query length, sequence)."""
    ref, pos, name, mapq, _, n_cigar, flag, length, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", data, at)
    p = at + 32
    qname = data[p : p + name - 1].decode()
    p += name
    ops = struct.unpack_from(f"<{n_cigar}I", data, p)
    p += 4 * n_cigar
    packed = data[p : p + (length + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:length]
    span = sum(o >> 4 for o in ops if CIGAR_LETTERS[o & 15] in "MDN=X")
    cigar = "".join(f"{o >> 4}{CIGAR_LETTERS[o & 15]}" for o in ops) or "*"
    return qname, flag, contigs[ref][0] if ref >= 0 else None, pos, pos + span, mapq, cigar, tlen, length, seq or None


def records(path: str, contigs: list[tuple[str, int]], begin: tuple[int, int], end: tuple[int, int] | None) -> Iterator[tuple]:
    """Records from one place up to another (block, place in it)."""
    blocks = Blocks(path, begin[0])
    data, at, places = b"", begin[1], []  # places: where in data each block begins
    try:
        while True:
            while len(data) < at + 4 or len(data) < at + 4 + struct.unpack_from("<i", data, at)[0]:
                got = blocks.next()
                if got is None:
                    return
                if at > 1 << 20:
                    places = [(p - at, o) for p, o in places if p >= at - (1 << 17)]
                    data, at = data[at:], 0
                places.append((len(data), got[0]))
                data += got[1]
            if end is not None:
                block = max((o for p, o in places if p <= at), default=begin[0])
                inside = at - max((p for p, o in places if p <= at), default=0)
                if (block, inside) >= end:
                    return
            size = struct.unpack_from("<i", data, at)[0]
            yield decode(data, at + 4, size, contigs)
            at += 4 + size
    finally:
        blocks.close()


@dataclass
class Range(InputPartition):
    path: str
    contigs: list[tuple[str, int]]
    begin: tuple[int, int]
    end: tuple[int, int] | None


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._paths = options["paths"].split("\n")
        self._bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in self._paths:
            contigs, block, place = header(path)
            starts = [(block, place)]
            for at in range(self._bytes, os.path.getsize(path), self._bytes):
                if at > block and (found := find_record(path, at, len(contigs))) is not None and found > starts[-1]:
                    starts.append(found)
            out += [Range(path, contigs, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        for r in records(partition.path, partition.contigs, partition.begin, partition.end):
            yield (partition.path, *r)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fraglake_bam"

    def schema(self):
        return S.READS

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))


def read(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Reads of BAM files in the library's schema."""
    paths = [paths] if isinstance(paths, str) else paths
    spark.dataSource.register(BamSource)
    return spark.read.format("fraglake_bam").option("paths", "\n".join(paths)).option("rangebytes", str(range_bytes)).load()


def contigs(path: str) -> list[tuple[str, int]]:
    """Names and lengths of the header's contigs."""
    return header(path)[0]
