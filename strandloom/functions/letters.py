"""Letters of a sequence: Column expressions and the same rules for Arrow batches.

The letters of a sequence are A-Z after upper-casing, with U read as T; all
else (blanks, digits, gaps) is layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The IUPAC nucleotide codes and their complements.
IUPAC = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def letters(seq: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(seq), "[^A-Z]", ""), "U", "T")


def reverse_complement(seq: Column) -> Column:
    """IUPAC-aware, case kept; U is read as T."""
    return F.translate(F.reverse(F.translate(seq, "Uu", "Tt")), IUPAC, IUPAC_COMPLEMENT)


def is_circular(topology: Column) -> Column:
    return F.coalesce(F.lower(F.trim(topology)) == "circular", F.lit(False))


_UPPER = bytes(84 if chr(i).upper() == "U" else ord(chr(i).upper()) if chr(i).isascii() else i for i in range(256))
_LAYOUT = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalpha())


def letters_bytes(seq: str | None) -> bytes:
    """``letters`` of one value inside a task."""
    if not seq:
        return b""
    if not seq.isascii():
        seq = seq.upper()
    return seq.encode("utf-8").translate(_UPPER, _LAYOUT)


def letter_blocks(values: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut one batch into runs of records of about ``most`` letters.

    Yields (number of the first record, lengths, concatenated letters). A
    record is never cut here, so a block is larger than ``most`` only if a
    single record is.
    """
    first, held, total = 0, [], 0
    for i, value in enumerate(values):
        b = letters_bytes(value)
        if held and total + len(b) > most:
            yield first, np.array([len(x) for x in held], dtype=np.int64), np.frombuffer(b"".join(held), dtype=np.uint8)
            first, held, total = i, [], 0
        held.append(b)
        total += len(b)
    if held:
        yield first, np.array([len(x) for x in held], dtype=np.int64), np.frombuffer(b"".join(held), dtype=np.uint8)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LETTER_VALUE = mix64(np.arange(256, dtype=np.uint64) * _MIX + np.uint64(1))


def window_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """64-bit polynomial hash of every run of ``width`` letters, by doubling.

    A run of 2n letters hashes to hash(left n) * B**n + hash(right n), so all
    windows need about log2(width) vector passes.
    """
    n = len(text) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    part, length, power = LETTER_VALUE[text], 1, np.uint64(0xD6E8FEB86659FD93)
    out, done = None, 0
    rest = width
    with np.errstate(over="ignore"):
        while True:
            if rest & 1:
                piece = part[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += length
            rest >>= 1
            if not rest:
                return mix64(out)
            part = part[:-length] * power + part[length:]
            power = power * power
            length *= 2
