"""Long exact spans shared between records (problem 3).

A record's sentences are the stretches between content-defined cuts: the word
with the smallest hash in each window of consecutive words begins a sentence.
Words and windows are so short that every run of ``span`` letters begins
several sentences, whatever stands around it. Runs of two sentences are
hashed; of those that a run of ``span`` letters holds, the one with the
smallest hash is its name. Names are joined over all records, and only where
two records share one, the runs of ``span`` letters themselves are hashed and
joined. Equal runs have equal names, so they always meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.letters import LETTER_VALUE, letters_bytes, mix64, window_hashes
from strandloom.operators.intervals import periods
from strandloom.session import cut_lineage

WORD = 12
HOT = 20_000  # runs of span letters of one name, over all records, from which they are joined one by one
CHUNK = 500_000  # letters of a record handled at once, and moved in one row
BLOCK = 1_000_000  # letters of several records handled at once
PLACES = np.uint64(22)  # bits of a place within a block

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best(x[i:i+width]) for every i, by doubling."""
    if len(x) < width:
        return x[:0]
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def _span_hashes(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of text[first:last] of any length, from running sums of letters times falling powers."""
    if len(_powers[0]) <= len(text):
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * len(text) + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    rising, falling = _powers
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTER_VALUE[text] * falling[: len(text)])))
    return mix64((sums[last] - sums[first]) * rising[first])


def _least_within(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(x[first:last + 1]) for many short ranges, from tables of doubled widths."""
    width = last - first + 1
    level = np.frexp(width)[1] - 1
    out = np.empty(len(first), dtype=x.dtype)
    table = x
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[first[own]], table[last[own] - 2**k + 1])
        table = np.minimum(table[: -(2**k)], table[2**k :]) if len(table) > 2**k else table
    return out


def names(text: np.ndarray, lengths: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, name) of every run of ``span`` letters within one of the concatenated records; names are even."""
    n = len(text)
    if n < span:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = max(1, min(WORD, span // 4))
    window = max(1, (span - word + 1) // 6)  # a run holds six windows side by side, so it begins six sentences
    ends = np.repeat(np.cumsum(lengths), lengths)
    low = (np.uint64(1) << PLACES) - np.uint64(1)
    h = window_hashes(text, word)
    least = _slide((h & ~low) | np.arange(len(h), dtype=np.uint64), window, np.minimum)
    windows = np.flatnonzero(np.arange(len(least)) + (window - 1 + word) <= ends[: len(least)])
    place, owner = (least[windows] & low).astype(np.int64), ends[windows]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))[: len(place)]
    sentence = np.full(len(least), -1)
    sentence[windows] = np.cumsum(new) - 1
    begins, owner = place[new], owner[new]
    pairs = _span_hashes(text, begins[:-2], np.minimum(begins[2:] + word, n))
    start = np.flatnonzero(np.arange(n - span + 1) + span <= ends[: n - span + 1])
    least = _least_within(pairs, sentence[start], sentence[start + (span - word + 1 - window)] - 2)
    return start, (least & ~np.uint64(1)).view(np.int64)


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the rows at which any column changes."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _rows(schema: pa.Schema, columns: list) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 20_000):
        parts = [c[a : a + 20_000] for c in columns]
        yield pa.RecordBatch.from_arrays([p if isinstance(p, pa.Array) else pa.array(p, type=f.type) for p, f in zip(parts, schema)], schema=schema)


def _blocks(pieces: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(record, chunk, length of each piece, concatenated letters) of about ``BLOCK`` letters."""
    held: list[tuple[int, int, np.ndarray]] = []
    total = 0
    for piece in pieces:
        held.append(piece)
        total += len(piece[2])
        if total >= BLOCK:
            yield _joined(held)
            held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    return np.array([p[0] for p in held]), np.array([p[1] for p in held]), np.array([len(p[2]) for p in held]), np.concatenate([p[2] for p in held])


def _pieces(batch: pa.RecordBatch, span: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Records in chunks that overlap by span - 1 letters, so that each run begins in one chunk."""
    for rec, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        text = np.frombuffer(letters_bytes(seq), dtype=np.uint8)
        for chunk in range(-(-max(0, len(text) - span + 1) // CHUNK)):
            yield rec, chunk, text[chunk * CHUNK : (chunk + 1) * CHUNK + span - 1]


def _name_rows(span: int):
    """(h, rec, chunk, n): distinct names of each chunk and how many runs have them. An even h is to be compared, an odd one
    is known to be shared: of a name that several records of the block hold, two rows are compared, the others only passed on."""
    schema = pa.schema([("h", pa.int64()), ("rec", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for recs, chunks, lengths, text in _blocks(_pieces(batch, span)):
                start, h = names(text, lengths, span)
                piece = np.repeat(np.arange(len(lengths)), lengths)[start]
                at = _edges(h, piece)  # runs in a row mostly have the same name
                times = np.diff(np.concatenate((at, [len(h)])))
                h, piece = h[at], piece[at]
                order = np.lexsort((chunks[piece], recs[piece], h))
                h, piece, times = h[order], piece[order], times[order]
                at = _edges(h, piece)
                if not len(at):
                    continue
                h, piece, times = h[at], piece[at], np.add.reduceat(times, at)
                group = _edges(h)
                last = np.concatenate((group[1:], [len(h)])) - 1
                known = np.repeat(recs[piece[group]] != recs[piece[last]], last - group + 1)
                known[group] = known[last] = False
                yield from _rows(schema, [np.where(known, h | 1, h), recs[piece], chunks[piece], times])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, rec): those whose h has at least two values of rec, or is known to be shared.

    A stream: between batches only the rows of a name that has had a single
    record so far are kept back, a row for each of its chunks.
    """
    held: list[pa.RecordBatch] = []
    open_h = open_rec = None
    open_shared = False
    for batch in batches:
        if not batch.num_rows:
            continue
        h, rec = batch.column("h").to_numpy(), batch.column("rec").to_numpy()
        group = _edges(h)
        last = np.concatenate((group[1:], [len(h)])) - 1
        hit = (rec[group] != rec[last]) | (h[group] & 1 == 1)
        if h[0] == open_h:
            hit[0] |= open_shared or rec[0] != open_rec
            if hit[0]:
                yield from held
        if h[0] != open_h or hit[0] or len(group) > 1:
            held = []
        rows = np.repeat(hit, last - group + 1)
        if rows.any():
            yield batch.filter(pa.array(rows))
        open_h, open_rec, open_shared = h[-1], rec[-1], bool(hit[-1])
        if not open_shared:
            held.append(batch.slice(int(group[-1])))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of every value, all bytes) of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.diff(offsets), np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)


def _cut(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """text[first:first + size] of every row as one binary column."""
    ends = np.cumsum(size)
    data = text[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _own(h: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A name as known to one piece."""
    return mix64(h.view(np.uint64) + mix64(piece.astype(np.uint64) + np.uint64(1)))


def _contexts(span: int):
    """Around the shared names of a chunk: the letters of the runs that have them, or, for a hot one, each run's hash and places.

    A hot name's equal runs in a row at most ``span`` letters apart, as in
    periodic stretches, are one row: their letters are one stretch.
    """
    schema = pa.schema([("h", pa.int64()), ("rec", pa.int64()), ("pos", pa.int64()), ("last", pa.int64()), ("ctx", pa.binary())])

    def solve(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        recs, chunks, lengths, text = _joined(held)
        wanted = np.concatenate([p[3] for p in held])
        known = _own(wanted & ~np.int64(1), np.repeat(np.arange(len(held)), [len(p[3]) for p in held]))
        order = np.argsort(known)
        known, hot = known[order], (wanted & 1 == 1)[order]
        start, h = names(text, lengths, span)
        piece = np.repeat(np.arange(len(lengths)), lengths)[start]
        a = _edges(h, piece, start - np.arange(len(start)))
        b = np.concatenate((a[1:], [len(h)])) - 1
        key = _own(h[a], piece[a])
        cell = np.minimum(np.searchsorted(known, key), len(known) - 1)
        mine = known[cell] == key
        a, b, hot = a[mine], b[mine], hot[cell[mine]]
        shift = chunks.astype(np.int64) * CHUNK - (np.cumsum(lengths) - lengths)  # from block to record
        x, y = a[~hot], b[~hot]
        p = piece[x]
        yield from _rows(schema, [h[x], recs[p], start[x] + shift[p], start[y] + shift[p], _cut(text, start[x], start[y] - start[x] + span)])
        if hot.any():
            x, size = a[hot], (b - a)[hot] + 1
            at = np.repeat(x - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            s, p = start[at], piece[at]
            runs = window_hashes(text, span)[s].view(np.int64)
            order = np.lexsort((s, runs, p))
            s, p, runs = s[order], p[order], runs[order]
            gap = np.concatenate(([0], np.cumsum(s[1:] - s[:-1] > span)))
            x = _edges(p, runs, gap)
            y = np.concatenate((x[1:], [len(s)])) - 1
            yield from _rows(schema, [runs[x], recs[p[x]], s[x] + shift[p[x]], s[y] + shift[p[x]], pa.nulls(len(x), pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, total = [], 0
            lists = batch.column("hs")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            rows = zip(batch.column("rec").to_pylist(), batch.column("chunk").to_pylist(), batch.column("packed").to_pylist())
            for i, (rec, chunk, packed) in enumerate(rows):
                held.append((rec, chunk, unpack(packed), values[ends[i] : ends[i + 1]]))
                total += len(held[-1][2])
                if total >= BLOCK:
                    yield from solve(held)
                    held, total = [], 0
            if held:
                yield from solve(held)

    return run


def _match(span: int, repeats: bool, most: int = 40_000):
    """Rows sorted by h: the stretches of each record whose runs also stand in another record of the group (``repeats``: in one with a smaller key)."""
    schema = pa.schema([("rec_id", pa.int64()), ("s", pa.int64()), ("t", pa.int64())])

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        rec, pos = t.column("rec").to_numpy(), t.column("pos").to_numpy()
        size, text = _flat(t.column("ctx").chunk(0))
        key = window_hashes(text, span)
        row = np.repeat(np.arange(len(size)), size)[: len(key)]
        base = np.cumsum(size) - size
        at = np.flatnonzero(np.arange(len(key)) + span <= (base + size)[row])
        key, row = key[at], row[at]
        order = np.lexsort((rec[row], key))
        k, r = key[order], rec[row][order]
        start = _edges(k)
        last = np.concatenate((start[1:], [len(k)])) - 1
        group = np.repeat(np.arange(len(start)), last - start + 1)
        hit = np.zeros(len(k), dtype=bool)
        hit[order] = r > r[start][group] if repeats else (r[start] != r[last])[group]
        row, at = row[hit], at[hit]
        if not len(row):
            return
        first = pos[row] + at - base[row]
        a = _edges(row, first - np.arange(len(first)))
        b = np.concatenate((a[1:], [len(row)])) - 1
        yield from _rows(schema, [rec[row[a]], first[a], first[b] + span])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
            t = pa.Table.from_batches(kept)
            h = t.column("h").to_numpy()
            edge = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if edge:
                yield from solve(t.slice(0, edge))
            kept, rows = t.slice(edge).to_batches(), len(h) - edge
        if rows:
            yield from solve(pa.Table.from_batches(kept))

    return run


_TO2 = np.full(256, 255, dtype=np.uint8)
_TO2[np.frombuffer(b"ACGT", dtype=np.uint8)] = np.arange(4)
_FROM2 = np.frombuffer(b"ACGT", dtype=np.uint8)


def pack(letters: bytes) -> bytes:
    """Two bits a letter where all are A, C, G or T, else as they are."""
    code = _TO2[np.frombuffer(letters, dtype=np.uint8)]
    if len(code) == 0 or code.max() > 3:
        return b"\x04" + letters
    rest = -len(code) % 4
    c = np.concatenate((code, np.zeros(rest, np.uint8))).reshape(-1, 4)
    return bytes([rest]) + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    b = np.frombuffer(packed, dtype=np.uint8)
    if b[0] == 4:
        return b[1:]
    c = b[1:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3
    return _FROM2[c.reshape(-1)[: len(c) * 4 - int(b[0])]]


def _packed(span: int):
    schema = pa.schema([("rec", pa.int64()), ("chunk", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(rec, chunk, pack(text.tobytes())) for rec, chunk, text in _pieces(batch, span)]
            yield from _rows(schema, [list(c) for c in zip(*rows)] if rows else [[], [], []])

    return run


def shared_spans(df: DataFrame, key: str = "rec_id", text: str = "seq", span: int = 50, repeats: bool = False) -> DataFrame:
    """Maximal stretches of each record whose letters lie in a run of ``span`` letters that another record also holds.

    Result: ``rec_id``, ``span_start``, ``span_end`` (0-based, half-open,
    counted in letters). Same strand; adjacent stretches are one. Letters
    outside A, C, G and T equal only themselves. With ``repeats`` only what a
    record with a smaller key also holds: without these stretches every run
    of ``span`` letters is left in the first record that holds it.

    Null keys and null, empty or too short texts take part in nothing. Two
    rows with the same key are the same record: what only they share is not
    shared. Repeats within one record alone are not shared. Other columns are
    ignored, whatever their names. An empty input gives an empty result. Runs
    are compared by 64-bit hashes.

    Shuffled are the distinct names of each record's runs, about one in 16
    letters, the letters once at two bits each, and the surroundings of shared
    names. Long records are cut into chunks. Names held by many records of a
    task go past the comparison. From ``HOT`` runs on, counted over all
    records, a name's runs are joined one by one by their own hashes, with
    those of a periodic stretch as one row each, so no task holds a hot group.
    The records are read twice and must come in the same order each time, as
    from a table; cut the lineage of anything else.
    """
    if span < 3:
        raise ValueError("span must be at least 3")
    records = df.select(F.col(f"`{key}`").cast("long").alias("rec"), F.col(f"`{text}`").cast("string").alias("seq")).where("rec is not null and seq is not null")
    spread = F.when(F.col("h").bitwiseAND(1) == 1, F.xxhash64("rec", "h")).otherwise(F.col("h"))
    schema = "h long, rec long, chunk int, n int"
    found = records.mapInArrow(_name_rows(span), schema).repartition(spread).sortWithinPartitions("h", "rec").mapInArrow(_shared, schema)
    found = cut_lineage(found.withColumn("h", F.col("h").bitwiseAND(F.lit(-2))))
    hot = found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("h", F.lit(1).cast("long").alias("hot"))
    marked = found.join(hot, "h", "left").select("rec", "chunk", F.col("h").bitwiseOR(F.coalesce("hot", F.lit(0))).alias("h"))
    wanted = marked.groupBy("rec", "chunk").agg(F.collect_list("h").alias("hs"))
    packed = records.mapInArrow(_packed(span), "rec long, chunk int, packed binary")
    around = packed.join(wanted, ["rec", "chunk"]).select("rec", "chunk", "packed", "hs").mapInArrow(_contexts(span), "h long, rec long, pos long, last long, ctx binary")
    around = cut_lineage(around)
    by_name = around.where("ctx is not null").select("h", "rec", "pos", "ctx").repartition("h").sortWithinPartitions("h").mapInArrow(_match(span, repeats), "rec_id long, s long, t long")
    runs = around.where("ctx is null").select("h", "rec", F.col("pos").alias("s"), (F.col("last") + span).alias("t"))
    twice = runs.groupBy("h").agg(F.min("rec").alias("first"), F.max("rec").alias("other")).where("first < other")
    by_run = runs.join(twice, "h").where("rec > first" if repeats else "true").select(F.col("rec").alias("rec_id"), "s", "t")
    merged = periods(by_name.unionByName(by_run), ["rec_id"], "s", "t", block=1 << 16)  # letters
    return merged.where("kind = 'covered'").select("rec_id", F.col("seg_start").alias("span_start"), F.col("seg_end").alias("span_end"))
