"""Frequency of every distinct term over the whole collection (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.kmers import window_codes
from strandloom.functions.letters import letter_blocks

DENSE = 12  # up to this width a task keeps its partial counts in an array of 4**width cells
FLUSH = 4_000_000  # wider terms: distinct terms held by a task before it hands them on

def _partial_counts(width: int):
    schema = pa.schema([("code", pa.int64()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def out(codes: np.ndarray, occurrences: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(codes), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[part].astype(np.int64)) for x in (codes, occurrences, records)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = width <= DENSE
        occurrences = np.zeros(4**width, dtype=np.int64) if dense else None
        records = np.zeros(4**width, dtype=np.int64) if dense else None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0
        for batch in batches:
            for _, lengths, text in letter_blocks(batch.column(0).to_pylist()):
                codes, clean = window_codes(text, width)
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)[: len(codes)]
                clean &= np.arange(width, len(text) + 1) <= ends[owner]  # not across two records
                codes, owner = codes[clean].astype(np.int64), owner[clean]
                if not len(codes):
                    continue
                # each record's own counts first, then the task's
                if 2 * width + int(len(lengths)).bit_length() <= 62:
                    per, times = np.unique((owner << (2 * width)) | codes, return_counts=True)
                    term = per & ((1 << (2 * width)) - 1)
                else:
                    order = np.lexsort((codes, owner))
                    c, o = codes[order], owner[order]
                    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (o[1:] != o[:-1]))))
                    term, times = c[first], np.diff(np.concatenate((first, [len(c)])))
                if dense:
                    occurrences += np.bincount(term, weights=times, minlength=4**width).astype(np.int64)
                    records += np.bincount(term, minlength=4**width)
                    continue
                held.append((term, times, np.ones(len(term), dtype=np.int64)))
                total += len(term)
                if total >= FLUSH:
                    yield from out(*_combined(held))
                    held, total = [], 0
        if dense:
            codes = np.flatnonzero(records)
            yield from out(codes, occurrences[codes], records[codes])
        elif held:
            yield from out(*_combined(held))

    return run


def _combined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    term, times, recs = (np.concatenate(x) for x in zip(*held))
    codes, at = np.unique(term, return_inverse=True)
    return codes, np.bincount(at, weights=times).astype(np.int64), np.bincount(at, weights=recs).astype(np.int64)


def term_text(code, width: int):
    """The letters of a base-4 code."""
    digits = F.lpad(F.conv(code.cast("string"), 10, 4), width, "0")
    return F.translate(digits, "0123", "ACGT")


def term_frequencies(df: DataFrame, text: str = "seq", width: int = 10, rare: int = 1, common: float = 1 / 20) -> DataFrame:
    """Occurrences and record counts of every term, with marks.

    A term is ``width`` consecutive letters of one record, all A, C, G or T,
    forward strand. Result: ``term``, ``occurrences``, ``records``, ``mark``:
    'rare' if at most ``rare`` rows hold the term, else 'common' if the rows
    holding it are at least the share ``common`` of all rows, else null.

    Null, empty and too short texts hold no term but count as rows; repeated
    rows count each; a term met twice in one row counts once in ``records``.
    Other columns are ignored, whatever their names. An empty input gives an
    empty result. ``width`` is 1 to 31.

    Each task counts per record, combines its counts by term, and only then
    the sums are shuffled: at most one row per distinct term and task for
    widths up to 12, else per 4 million counted terms.
    """
    if not 1 <= width <= 31:
        raise ValueError("width must be between 1 and 31")
    counted = (
        df.select(F.col(f"`{text}`").cast("string").alias("t"))
        .mapInArrow(_partial_counts(width), "code long, occurrences long, records long")
        .groupBy("code")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )
    rows = df.count()
    share = Fraction(str(common))  # in whole numbers, so that the bound itself is met exactly
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records").cast("decimal(38,0)") * share.denominator >= F.lit(rows * share.numerator).cast("decimal(38,0)"), "common")
    return counted.select(term_text(F.col("code"), width).alias("term"), "occurrences", "records", mark.alias("mark"))
