"""Splitting oversized records at natural boundaries (problem 4)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.letters import letters, letters_bytes


def boundaries(text: bytes, motif: bytes) -> list[int]:
    """Sorted starts > 0 of the motif, overlapping ones too."""
    out: list[int] = []
    if motif:
        at = text.find(motif, 1)
        while at >= 0:
            out.append(at)
            at = text.find(motif, at + 1)
    return out


def cut(length: int, bounds: list[int], most: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, begun at a boundary) of pieces of at most ``most`` letters that overlap by ``overlap``.

    The next piece begins at the last boundary from which the overlap still
    fits into the current piece; without one it begins where the full piece
    less the overlap ends. The overlap must be less than ``most``.
    """
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be less than the size limit and not negative")
    out, start, natural = [], 0, False
    while length - start > most:
        last = start + most - overlap
        i = bisect_right(bounds, last) - 1
        if i >= 0 and bounds[i] > start:
            nxt, at_bound = bounds[i], True
        else:
            nxt, at_bound = last, False
        out.append((start, nxt + overlap, natural))
        start, natural = nxt, at_bound
    out.append((start, length, natural))
    return out


def split_oversized(records: DataFrame, requests: DataFrame, config: DataFrame) -> DataFrame:
    """Cut every record that is longer than the ``max_size`` of a configuration it is requested under.

    Result: one row per distinct (``rec_id``, ``config_id``) of the requests
    whose configuration exists and whose record has more than ``max_size``
    letters, with ``boundaries`` (sorted positions > 0 at which the
    upper-cased motif begins) and ``pieces`` (array of start, end, natural).

    Null ids, unknown configurations or records, null ``max_size`` or one
    below 1, and null or empty ``seq`` give no row. A null or empty motif has
    no boundaries: pieces are then hard cuts. A null overlap is 0; pieces that
    would have to overlap by ``max_size`` or more, or by less than nothing,
    cannot be cut and are null. Repeated
    requests count once; of a configuration listed twice the row with the
    smallest ``max_size`` holds, then the first motif in order. A record id
    listed twice is cut once per row. Other columns are ignored, whatever
    their names. Empty tables give an empty result.

    Requests are reduced to the distinct configurations of each record before
    the join (as many as there are configurations at most), and only records
    longer than the smallest ``max_size`` are shuffled, with their letters.
    """
    known = config.where("config_id is not null and max_size >= 1").groupBy("config_id").agg(
        F.min(F.struct("max_size", F.coalesce("min_overlap", F.lit(0)).alias("min_overlap"), F.coalesce(F.upper("motif"), F.lit("")).alias("motif"))).alias("c")
    )
    least = known.agg(F.min("c.max_size")).first()[0]
    wanted = (
        requests.select("rec_id", "config_id").where("rec_id is not null and config_id is not null").distinct()
        .join(known, "config_id")
        .groupBy("rec_id")
        .agg(F.collect_list(F.struct("config_id", "c.max_size", "c.min_overlap", "c.motif")).alias("wanted"))
    )
    long = records.select("rec_id", letters(F.col("seq")).alias("text")).where(F.length("text") > F.lit(least if least is not None else 2**31 - 1))
    schema = "rec_id long, config_id int, letters long, boundaries array<long>, pieces array<struct<start: long, end: long, natural: boolean>>"
    return long.join(wanted, "rec_id").mapInArrow(_split, schema)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("natural", pa.bool_())])
    schema = pa.schema([("rec_id", pa.int64()), ("config_id", pa.int32()), ("letters", pa.int64()), ("boundaries", pa.list_(pa.int64())), ("pieces", pa.list_(piece))])
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for rec, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "text", "wanted"))):
            b, found = letters_bytes(text), {}
            for c in wanted:
                if len(b) <= c["max_size"]:
                    continue
                motif = c["motif"].encode()
                if motif not in found:
                    found[motif] = boundaries(b, motif)
                at = found[motif]
                pieces = None
                if 0 <= c["min_overlap"] < c["max_size"]:
                    pieces = [dict(zip(("start", "end", "natural"), p)) for p in cut(len(b), at, c["max_size"], c["min_overlap"])]
                for x, v in zip(out, (rec, c["config_id"], len(b), at, pieces)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, schema)], schema=schema)
