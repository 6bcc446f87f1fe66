"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SETTING = "spark.strandloom.vocabulary"  # where the session names another file
CELL = 1_000_000  # pieces ranked together
# Fixed value: the published split pattern of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken
    from pyspark import SparkFiles

    if not os.path.exists(path):  # sent along with the job
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, type=pa.int64())], schema=schema)

    return run


def token_counts(df: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, tokens) of every row; a null or empty text has none.

    ``vocabulary`` is a path that every executor can read, else the one the
    session names in ``spark.strandloom.vocabulary``; a file sent along with
    ``SparkContext.addFile`` is found by its name.
    """
    vocabulary = vocabulary or df.sparkSession.conf.get(SETTING, VOCABULARY)
    return df.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(_count(vocabulary), "id long, tokens long")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, number of containers filled by it): shortest pack first.

    Lengths are placed longest first. Every item goes onto the pattern with
    the most room, if that takes it, else it opens a new container.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted rooms with patterns

    def add(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        by_room[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:
                # as many as fit stand in one new container
                fit = capacity // length
                whole, rest = divmod(left, fit)
                if whole:
                    add(capacity - fit * length, (length,) * fit, whole)
                if rest:
                    add(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[-1]
            pattern, count = by_room[room].pop()
            below = room if by_room[room] else rooms[-2] if len(rooms) > 1 else 0
            if not by_room[room]:
                del by_room[room]
                rooms.pop()
            used = min(count, left)
            # more than one at once only while these stay the ones with the most room
            fit = max(1, min((room - below) // length, left // used))
            if used < count:
                fit = 1
                add(room, pattern, count - used)
            add(room - fit * length, pattern + (length,) * fit, used)
            left -= fit * used
    return [x for room in rooms for x in by_room[room]]


def _layout(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Per pattern and length in it: (length, first rank of that length, first container, items of it per container), sorted by length and rank."""
    rows: list[tuple[int, int, int, int]] = []
    ranks: dict[int, int] = {}
    container = 0
    for pattern, count in patterns:
        for length, times in Counter(pattern).items():
            first = ranks.get(length, 0)
            rows.append((length, first, container, times))
            ranks[length] = first + times * count
        container += count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return tuple(table.T.copy())


def _assign(layout):
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int64()), ("size", pa.int64()), ("container", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, starts, per = layout.value
        for batch in batches:
            size, rank = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            container, held = np.zeros(len(size), dtype=np.int64), size > 0
            for length in np.unique(size[held]):
                own = np.flatnonzero(size == length)
                a, b = np.searchsorted(lengths, [length, length + 1])
                row = a + np.searchsorted(firsts[a:b], rank[own], side="right") - 1
                container[own] = starts[row] + (rank[own] - firsts[row]) // per[row]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("piece"), batch.column("size"), pa.array(container, mask=~held)], schema=schema)

    return run


def pack(items: DataFrame, capacity: int, cell: int = CELL) -> DataFrame:
    """Assign items (``id``, ``tokens``) to containers of one capacity.

    Result: ``id``, ``piece``, ``size``, ``container``. An item is divided
    only if it alone is larger than the capacity: into full pieces and a rest.
    Containers are numbered from 0 and never hold more than ``capacity``.

    A null or zero size needs no room: one row with size 0 and a null
    container. A negative size counts as 0. Ties and repeated ids are items of
    their own. Other columns are ignored, whatever their names. An empty input
    gives an empty result.

    The driver sees only the histogram of lengths, at most ``capacity`` rows,
    and lays out the patterns from it. Pieces get their rank within their
    length from the counts of the cells before theirs and a running number
    within it; a length has a cell for about every ``cell`` of its pieces, so
    one that a third of the pieces share is ranked by as many tasks as it
    fills. The pieces meet the patterns by rank. ``items`` is read several
    times: cut its lineage if it is dear.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sizes = items.select("id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("n"))
    full = F.expr(f"cast((n - 1) div {capacity} as int)")
    pieces = sizes.select("id", "n", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > 0, full).otherwise(0))).alias("piece"))
    pieces = pieces.select("id", F.col("piece").cast("long").alias("piece"), F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).alias("size"))
    counts = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}
    salts = 1 + max(counts.values(), default=0) // cell
    counts.pop(0, None)
    layout = items.sparkSession.sparkContext.broadcast(_layout(pack_histogram(counts, capacity)))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    own = Window.partitionBy("size", "salt")
    if salts == 1:
        ranked = pieces.withColumn("rank", F.row_number().over(own.orderBy("id", "piece")) - 1)
    else:
        cells = pieces.where("size > 0").groupBy("size", "salt").count()
        base = F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        bases = cells.select("size", "salt", F.coalesce(base, F.lit(0)).alias("base"))
        ranked = pieces.withColumn("local", F.row_number().over(own.orderBy("id", "piece")) - 1).join(bases, ["size", "salt"], "left")
        ranked = ranked.withColumn("rank", F.coalesce("base", F.lit(0)) + F.col("local"))
    return ranked.select("id", "piece", "size", F.col("rank").cast("long").alias("rank")).mapInArrow(_assign(layout), "id long, piece long, size long, container long")


def counted(df: DataFrame, **options) -> DataFrame:
    """``token_counts``, written once."""
    return cut_lineage(token_counts(df, **options))
