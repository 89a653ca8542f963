"""PLINK genotypes: FAM and BIM text, and the packed BED file as a data source over variant ranges."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"\x6c\x1b\x01"
#: Two bits, low first: allele counts; 1 is missing.
CODES = np.array([0, 255, 1, 2], dtype=np.uint8)
VARIANTS = 5000


def _lines(path: str) -> list[str]:
    with open(path) as f:
        return [line.rstrip("\n") for line in f if line.strip()]


def samples(path: str) -> list[str]:
    """Individual ids of a FAM file, in order."""
    return [line.split()[1] for line in _lines(path)]


def variants(path: str) -> list[str]:
    """Variant ids of a BIM file, in order; unnamed ones are chrom:pos."""
    out = []
    for line in _lines(path):
        chrom, name, _, pos = line.split("\t")[:4] if "\t" in line else line.split()[:4]
        out.append(f"{chrom}:{pos}" if name.strip() in (".", "") else name)
    return out


def unpack(raw: bytes, n_samples: int) -> np.ndarray:
    """Allele counts (255: missing) of whole variants, a row each."""
    packed = np.frombuffer(raw, dtype=np.uint8).reshape(-1, -(-n_samples // 4))
    bits = np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(packed), -1)
    return CODES[bits[:, :n_samples]]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    names: list[str]
    samples: list[str]


class BedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._prefix, self._step = options["prefix"], int(options.get("variants", VARIANTS))

    def partitions(self) -> list[Range]:
        bed = f"{self._prefix}.bed"
        with open(bed, "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{bed} isn't a variant-major PLINK file")
        people, names = samples(f"{self._prefix}.fam"), variants(f"{self._prefix}.bim")
        width = -(-len(people) // 4)
        whole = min(len(names), (os.path.getsize(bed) - 3) // width) if width else 0  # a cut-off file ends earlier
        return [Range(bed, a, names[a : min(a + self._step, whole)], people) for a in range(0, whole, self._step)] or [Range(bed, 0, [], people)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        width = -(-len(p.samples) // 4)
        ids = np.array(p.samples, dtype=object)
        with open(p.path, "rb") as f:
            f.seek(3 + p.first * width)
            for name in p.names:
                calls = unpack(f.read(width), len(p.samples))[0]
                known = calls != 255
                n = int(known.sum())
                yield pa.RecordBatch.from_arrays([pa.array(ids[known], type=pa.string()), pa.array([name] * n, type=pa.string()), pa.array(calls[known].astype(np.int16))], names=["sample_id", "feature_name", "value"])


class BedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fraglake_plink"

    def schema(self) -> str:
        return "sample_id string, feature_name string, value short"

    def reader(self, schema) -> BedReader:
        return BedReader(dict(self.options))


def read(spark: SparkSession, prefix: str, variants_per_partition: int = VARIANTS) -> DataFrame:
    """sample_id, feature_name, value (0, 1 or 2) from prefix.bed, .bim and .fam; missing genotypes are left out."""
    spark.dataSource.register(BedSource)
    return spark.read.format("fraglake_plink").option("prefix", prefix).option("variants", str(variants_per_partition)).load()


def decode_column(packed, n_samples: int):
    """The same decoding as an expression, for packed variants in a binary column: an array of counts, null where missing."""
    code = lambda i: F.shiftright(F.conv(F.substring(F.hex(packed), 2 * (i // 4) + 1, 2), 16, 10).cast("int"), 2 * (i % 4)).bitwiseAND(F.lit(3))
    return F.array(*(F.when(code(i) == 0, 0).when(code(i) == 2, 1).when(code(i) == 3, 2) for i in range(n_samples)))
