"""FASTA as tiles, read by ranges.

A line index (the .fai file beside it, or one pass over the text) says where each
contig's bases lie; each partition then reads a range of one contig.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Contig:
    name: str
    length: int
    offset: int
    line_bases: int
    line_bytes: int


def index(path: str) -> list[Contig]:
    """Contigs in file order."""
    if os.path.exists(path + ".fai"):
        with open(path + ".fai") as f:
            return [Contig(n, int(a), int(b), int(c), int(d)) for n, a, b, c, d in (line.rstrip("\n").split("\t")[:5] for line in f if line.strip())]
    out: list[Contig] = []
    name, length, start, bases, width, at = None, 0, 0, 0, 0, 0
    with open(path, "rb") as f:
        for line in f:
            if line.startswith(b">"):
                if name is not None:
                    out.append(Contig(name, length, start, bases or 1, width or 1))
                name, length, bases, width = line[1:].split()[0].decode() if line[1:].split() else "", 0, 0, 0
                start = at + len(line)
            elif name is not None:
                n = len(line.rstrip(b"\r\n"))
                if not bases:
                    bases, width = n, len(line)
                length += n
            at += len(line)
    if name is not None:
        out.append(Contig(name, length, start, bases or 1, width or 1))
    return out


def contigs(path: str) -> list[tuple[str, int]]:
    return [(c.name, c.length) for c in index(path)]


def fetch(path: str, contig: Contig, start: int, end: int) -> str:
    """Bases [start, end) of a contig, cut at its ends."""
    start, end = max(0, start), min(end, contig.length)
    if end <= start:
        return ""
    place = lambda p: contig.offset + p // contig.line_bases * contig.line_bytes + p % contig.line_bases
    with open(path, "rb") as f:
        f.seek(place(start))
        raw = f.read(place(end - 1) + 1 - place(start))
    return raw.replace(b"\n", b"").replace(b"\r", b"").decode()


@dataclass
class Range(InputPartition):
    path: str
    contig: Contig
    first: int
    last: int
    size: int


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._path, self._size, self._tiles = options["path"], int(options["tilesize"]), int(options["tilesperpartition"])

    def partitions(self) -> list[Range]:
        out = []
        for c in index(self._path):
            n = -(-c.length // self._size)
            out += [Range(self._path, c, a, min(n, a + self._tiles), self._size) for a in range(0, n, self._tiles)]
        return out or [Range(self._path, Contig("", 0, 0, 1, 1), 0, 0, self._size)]

    def read(self, p: Range) -> Iterator[tuple]:
        seq = fetch(p.path, p.contig, p.first * p.size, p.last * p.size)
        for tile in range(p.first, p.last):
            yield p.contig.name, tile, seq[(tile - p.first) * p.size : (tile - p.first + 1) * p.size]


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fraglake_fasta"

    def schema(self) -> str:
        return "chrom string, tile long, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(dict(self.options))


def read(spark: SparkSession, path: str, tile_size: int = 4096, tiles_per_partition: int = 4096) -> DataFrame:
    """chrom, tile, seq."""
    spark.dataSource.register(FastaSource)
    return spark.read.format("fraglake_fasta").option("tilesize", str(tile_size)).option("tilesperpartition", str(tiles_per_partition)).load(path)
