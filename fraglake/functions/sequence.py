"""Nucleotide strings as Spark expressions; everything stays in generated code."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(s: Column | str) -> Column:
    """Reverse complement; R and Y swap, other letters stay."""
    return F.translate(F.reverse(s), "acgtACGTRY", "tgcaTGCAYR")


def purine_pyrimidine(s: Column | str) -> Column:
    """A and G become R, C and T become Y."""
    return F.translate(s, "AGCT", "RRYY")


def canonical(s: Column | str) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    s = F.col(s) if isinstance(s, str) else s
    return F.least(s, revcomp(s))


def is_concrete(s: Column | str) -> Column:
    """No letter but A, C, G and T."""
    s = F.col(s) if isinstance(s, str) else s
    return F.length(F.translate(s, "ACGT", "")) == 0


def kmers(k: int, letters: str = "ACGT", only_canonical: bool = False) -> Column:
    """All k-mers in the order of ``letters``, as an array expression (no table is read)."""
    base = len(letters)

    def spelled(x: Column) -> Column:
        places = (F.floor(x / base ** (k - 1 - i)) % base + 1 for i in range(k))
        return F.concat(*(F.substring(F.lit(letters), p.cast("int"), F.lit(1)) for p in places))

    whole = F.transform(F.sequence(F.lit(0), F.lit(base**k - 1)), spelled)
    return F.filter(whole, lambda s: s <= revcomp(s)) if only_canonical else whole


def kmer_list(k: int, letters: str = "ACGT", only_canonical: bool = False) -> list[str]:
    """The same k-mers as Python strings, for column names."""
    swap = str.maketrans("ACGTRY", "TGCAYR")
    whole = ("".join(p) for p in product(letters, repeat=k))
    return [s for s in whole if not only_canonical or s <= s[::-1].translate(swap)]


def count_letters(s: Column | str, letters: str) -> Column:
    """How many characters of ``s`` are among ``letters``."""
    return F.length(s) - F.length(F.translate(s, letters, ""))
