"""Has this key been seen before? (problem 5)

Keys are spread by hash, and each task takes its keys in order of arrival. It
decides the keys of the batch being filled exactly, and seals a full batch
into an immutable filter of fingerprints: a table of 1.23 cells a key in which
the fingerprint of every key is the xor of three cells. The table is solved by
peeling: cells met by one remaining key are taken off round by round and
assigned in reverse. Later keys probe the sealed filters, which never miss a
key and are wrong about a new one with probability 2**-bits each.

Filters form generations: a batch is full when it holds a fixed share of all
keys sealed before it, so the generations grow geometrically and their number,
and with it the compounded error, only with the logarithm of the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.letters import letters, mix64, reverse_complement


BATCH = 512  # keys of the first generations
GROWTH = 0.25  # later ones hold this share of all keys sealed before
HOT = 8  # rows of one key in one Arrow batch of the scan from which only the earliest goes to the key's task


class Filter:
    """An immutable set of 64-bit keys, kept as fingerprints of ``bits`` bits."""

    def __init__(self, keys: np.ndarray, bits: int = 32):
        self.kind = {8: np.uint8, 16: np.uint16, 32: np.uint32}[bits]
        self.third = int(0.41 * len(keys)) + 11
        for seed in range(1, 200):
            self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
            if self._solve(keys):
                return
        raise ValueError("keys must be distinct")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = mix64(keys + self.seed)
        again = mix64(h)
        n, low, half = np.uint64(self.third), np.uint64(2**32 - 1), np.uint64(32)
        parts = (h >> half, h & low, again >> half)
        cells = np.stack([(part * n >> half) + np.uint64(i) * n for i, part in enumerate(parts)]).astype(np.int64)
        return cells, again.astype(self.kind)

    def _solve(self, keys: np.ndarray) -> bool:
        cells, mark = self._places(keys)
        size = 3 * self.third
        count = np.bincount(cells.ravel(), minlength=size)
        # the xor of the numbers of the keys in a cell names the last one left
        who = np.zeros(size, dtype=np.int64)
        for i in range(3):
            np.bitwise_xor.at(who, cells[i], np.arange(len(keys)))
        rounds, left = [], len(keys)
        ready = np.flatnonzero(count == 1)
        while len(ready):
            key, first = np.unique(who[ready], return_index=True)
            rounds.append((key, ready[first]))
            left -= len(key)
            for i in range(3):
                np.subtract.at(count, cells[i][key], 1)
                np.bitwise_xor.at(who, cells[i][key], key)
            touched = np.unique(cells[:, key])
            ready = touched[count[touched] == 1]
        if left:
            return False
        self.table = np.zeros(size, dtype=self.kind)
        for key, cell in reversed(rounds):
            value = mark[key].copy()
            for i in range(3):
                value ^= self.table[cells[i][key]]
            self.table[cell] = value  # the cell itself was still empty
        return True

    def holds(self, keys: np.ndarray) -> np.ndarray:
        cells, mark = self._places(keys)
        return (self.table[cells[0]] ^ self.table[cells[1]] ^ self.table[cells[2]]) == mark


_OUT = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("seen", pa.bool_()), ("how", pa.string()), ("filters", pa.int32())])


def _repeats_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the later rows of keys that have ``HOT`` rows or more in one Arrow batch of the scan: of a key that much of the input shares, one row a batch is left."""
    for batch in batches:
        number, earlier = _groups(*(batch.column(c).to_numpy() for c in ("h1", "h2", "at")))
        hot = np.bincount(number)[number] >= HOT if len(number) else earlier
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(earlier & hot)], names=[*batch.schema.names, "repeat"])


def _groups(h1: np.ndarray, h2: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each row's key, whether the same key came strictly earlier)."""
    if not len(h1):
        return np.empty(0, np.int64), np.empty(0, bool)
    order = np.lexsort((at, h2, h1))
    a, b, t = h1[order], h2[order], at[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    number = np.cumsum(new) - 1
    earlier = t > t[np.flatnonzero(new)][number]
    n, e = np.empty_like(number), np.empty(len(at), bool)
    n[order], e[order] = number, earlier
    return n, e


def _stream(batch_keys: int, growth: float, bits: int):
    def decide(rows: pa.Table, sealed: list[Filter]) -> tuple[pa.RecordBatch, np.ndarray]:
        ids, h1, h2, at = (rows.column(c).to_numpy() for c in ("id", "h1", "h2", "at"))
        number, exact = _groups(h1, h2, at)
        first = np.unique(number, return_index=True)[1]
        keys = (h1[first] ^ (h2[first] << 1)).view(np.uint64)
        hit = np.zeros(len(keys), dtype=bool)
        for f in sealed:
            todo = np.flatnonzero(~hit)
            hit[todo] = f.holds(keys[todo])
        probed = hit[number] if len(number) else np.empty(0, bool)
        how = np.where(exact, "batch", np.where(probed, "filter", "none")).astype(object)
        out = [ids, at, h1, h2, exact | probed, how, np.full(len(ids), len(sealed), dtype=np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, _OUT)], schema=_OUT), keys[~hit]

    def repeats(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        out = [*(batch.column(c) for c in ("id", "at", "h1", "h2")), np.full(n, True), ["scan"] * n, np.zeros(n, dtype=np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, _OUT)], schema=_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sealed: list[Filter] = []
        keys = 0  # held by the sealed filters
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            repeat = batch.column("repeat")
            yield repeats(batch.filter(repeat))
            held.append(batch.filter(pc.invert(repeat)))
            waiting += held[-1].num_rows
            if waiting < max(batch_keys, int(growth * keys)):
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            at = rows.column("at").to_numpy()
            done = 0
            while len(at) - done >= (full := max(batch_keys, int(growth * keys))):
                # rows of one moment stay in one batch
                edge = int(np.searchsorted(at, at[done + full - 1]))
                if edge <= done:
                    edge = int(np.searchsorted(at, at[done], side="right"))
                if edge == len(at):
                    break
                out, new = decide(rows.slice(done, edge - done), sealed)
                yield out
                if len(new):
                    sealed.append(Filter(np.unique(new), bits))
                    keys += len(new)
                done = edge
            held = rows.slice(done).combine_chunks().to_batches()
            waiting = len(at) - done
        if held:
            yield decide(pa.Table.from_batches(held).combine_chunks(), sealed)[0]

    return run


def seen_before(df: DataFrame, key: list[Column], ident: str, order: str, batch_keys: int = BATCH, growth: float = GROWTH, bits: int = 32) -> DataFrame:
    """For every row with a key: whether its key came in earlier, in order of ``order``.

    Result: ``id``, ``at``, ``h1`` and ``h2`` (128 bits of the key), ``seen``,
    ``how`` ('scan': a hot key's repeat within one Arrow batch of the scan,
    'batch': repeated within the batch being filled, both exact; 'filter': a sealed filter
    claims the key, 'none': not seen) and ``filters`` (number of filters
    probed, 0 for 'scan'). A row that was seen is always found; a new one is
    called seen with probability 1 - (1 - 2**-bits)**filters, with the
    defaults at most 1.5e-8 below 64 filters, which hold a billion keys a task.

    Rows of which any part of the key is null have no key and no row in the
    result. Rows with the same order value are not earlier than each other; a
    null order value counts as the smallest. Repeated rows are decided each.
    Other columns are ignored, whatever their names. An empty input gives an
    empty result.

    Rows are shuffled once, by key; of a key with ``HOT`` rows or more in
    a batch of the scan only the earliest goes to the key's task, the others
    anywhere, so a key held by a third of all rows loads no task. A task holds 1.23 * bits
    bits for each earlier distinct key, and the rows of the batch being filled,
    at most ``batch_keys`` or the share ``growth`` of those keys.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & k.isNotNull()
    rows = df.select(
        F.col(f"`{ident}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{order}`").cast("long"), F.lit(-(2**63))).alias("at"),
        F.when(whole, F.xxhash64(*key)).alias("h1"),
        F.when(whole, F.xxhash64(F.lit("second"), *key)).alias("h2"),
    ).where("h1 is not null")
    rows = rows.mapInArrow(_repeats_of_batch, "id long, at long, h1 long, h2 long, repeat boolean")
    rows = rows.repartition(F.when(F.col("repeat"), F.xxhash64("id", "at")).otherwise(F.col("h1"))).sortWithinPartitions("at")
    return rows.mapInArrow(_stream(batch_keys, growth, bits), "id long, at long, h1 long, h2 long, seen boolean, how string, filters int")


def checked(decided: DataFrame) -> DataFrame:
    """The same rows with ``claimed`` (the filters' answer) and ``seen`` corrected, to measure the rate of wrong answers.

    Only keys that a filter has claimed are looked up: the rows that may be
    their first arrivals are kept by a semi join with the claimed keys before
    they are grouped.
    """
    claimed = decided.where("how = 'filter'")
    keys = claimed.select(F.col("h1").alias("k1"), F.col("h2").alias("k2")).distinct()
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    first = decided.join(keys, same, "left_semi").groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.min("at").alias("first"))
    columns = ("id", "at", "h1", "h2", "how", "filters")
    looked_up = claimed.join(first, same).select(*columns, F.lit(True).alias("claimed"), (F.col("first") < F.col("at")).alias("seen"))
    return decided.where("how <> 'filter'").select(*columns, F.col("seen").alias("claimed"), "seen").unionByName(looked_up)


def probe_keys(probes: DataFrame, manifest: DataFrame) -> DataFrame:
    """probes with ``key``: the strand-neutral head of the letters, as long as the background's k-mer size; null where there is none.

    Of a manifest id listed twice, the largest k-mer size holds.
    """
    sizes = manifest.where("id is not null").groupBy(F.col("id").alias("background_id")).agg(F.max("kmer_size").alias("k"))
    head = F.expr("left(text, k)")
    rows = probes.select("probe_id", "arrival_no", "background_id", letters(F.col("seq")).alias("text")).join(sizes, "background_id")
    rows = rows.withColumn("head", F.when((F.col("k") > 0) & (F.length("text") >= F.col("k")) & ~head.rlike("[^ACGT]"), head))
    return rows.select("probe_id", "arrival_no", "background_id", F.least("head", reverse_complement(F.col("head"))).alias("key"))
