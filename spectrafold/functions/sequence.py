"""Column functions on sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(sequence: Column) -> Column:
    """Upper case, without white space."""
    return F.upper(F.regexp_replace(sequence, r"\s+", ""))


def blocks(sequence: Column, k: int, size: int = 256) -> Column:
    """Array of (at, block): pieces of `size` windows each, overlapping by k - 1; none if the sequence is shorter than k.

    A window is cut from a short block, as cutting it from a long string scans the string from its start.
    """
    windows = F.length(sequence) - (k - 1)
    at = F.sequence(F.lit(0), F.floor((windows - 1) / size).cast("int"))
    cut = F.transform(at, lambda j: F.struct((j * size).alias("at"), F.substring(sequence, j * size + 1, F.lit(size + k - 1)).alias("block")))
    return F.when(windows >= 1, cut)


def windows(block: Column, k: int) -> Column:
    """Array of all substrings of length k; null if there is none."""
    at = F.sequence(F.lit(1), F.length(block) - (k - 1))
    return F.when(F.length(block) >= k, F.transform(at, lambda i: F.substring(block, i, F.lit(k))))


def only_of(value: Column, letters: str) -> Column:
    """Whether the value holds no other letters."""
    return F.length(F.translate(value, letters, "")) == 0


def without_n(value: Column) -> Column:
    return ~F.contains(value, F.lit("N"))


def valid(value: Column, validity: str) -> Column:
    return only_of(value, "ACGT") if validity == "acgt" else without_n(value)


def reverse_complement(value: Column) -> Column:
    return F.reverse(F.translate(value, "ACGT", "TGCA"))


def canonical(value: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(value, reverse_complement(value))


def two_bit(value: Column) -> Column:
    """A k-mer of A, C, G, T as an integer, two bits a base (A 0, C 1, G 2, T 3); -1 with any other letter; k up to 31."""
    digits = F.translate(value, "ACGT", "0123")
    code = F.aggregate(F.split(digits, ""), F.lit(0).cast("long"), lambda a, d: a * 4 + d.cast("long"))
    return F.when(only_of(value, "ACGT"), code).otherwise(F.lit(-1).cast("long"))


def natural_key(name: Column) -> list[Column]:
    """Sort keys under which the digit runs of names count as numbers, however many and long they are."""
    number = lambda digits: F.when(digits != "", F.concat(F.lpad(F.length(F.regexp_replace(digits, "^0+", "")).cast("string"), 9, "0"), F.regexp_replace(digits, "^0+", ""))).otherwise("")
    parts = F.regexp_extract_all(name, F.lit(r"[^0-9]*[0-9]*"), F.lit(0))
    return [F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^[^0-9]*", 0).alias("text"), number(F.regexp_extract(p, r"[0-9]*$", 0)).alias("number")))]


def sample_name(file: Column) -> Column:
    """A file's name without folder and sequence suffix."""
    return F.regexp_replace(F.regexp_extract(file, r"([^/]*)$", 1), r"(?i)\.(fasta|fna|fas|fa)(\.gz)?$", "")


def tag(value: float) -> str:
    """A number as part of a file name: p for the point, m for the minus sign."""
    return str(value).replace(".", "p").replace("-", "m")
