"""Homology-free regions: stretches whose k-mers are in no background and occur once in their record."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.kmers import block_windows, canonical_kmers, distinct
from strandloom.functions.letters import mix64
from strandloom.operators.kmers import _extended, own_weight, prepared

CHUNK = 1_000_000  # windows of a record handled at once
BLOCK = 2_000_000  # letters of records whose k-mers are looked up together
BUCKETS = 256  # parts the k-mers are looked up in, at least


def runs(free: DataFrame, k: int, threshold: int, key: str = "rec_id") -> DataFrame:
    """Maximal runs of consecutive free positions, as regions (key, start, end) of at least ``threshold`` letters.

    Gaps and islands: the position less its row number is the same within a
    run. Repeated (key, pos) rows count once; null positions in nothing.
    """
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    rows = free.where("pos is not null").select(key, "pos").distinct().withColumn("_island", island)
    found = rows.groupBy(key, "_island").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("end"))
    return found.where(F.col("end") - F.col("start") >= threshold).select(key, "start", "end")


def homology_free_regions(
    queries: DataFrame, background: DataFrame | None, k: int = 20, threshold: int = 60, key: str = "rec_id", fold: bool = True, chunk: int = CHUNK, block: int = BLOCK
) -> DataFrame:
    """(key, start, end) of the maximal homology-free regions of every query record.

    A region is a run of windows none of which occurs in ``background``
    (column ``kmer``, which may repeat k-mers) or twice in the record, on
    either strand; it is reported from the first window's start to the last window's end if at
    least ``threshold`` letters long. Regions of circular records may end past
    the record. Regions may overlap by fewer than k letters.

    ``key`` must be unique. Null keys, null sequences and ones shorter than k
    have no regions. Without a background only repeats count.

    Records are cut into chunks of ``chunk`` windows that overlap by k - 1
    letters, and chunks are gathered in blocks of about ``block`` letters by
    their hash. A block's distinct k-mers are shuffled once, as packed sorted
    arrays of one bucket each, to meet the background's; a bit for each comes
    back. What a chunk repeats of itself is found with its block, and the
    k-mers of records of several chunks also meet each other. A task holds no
    more than a block, or a bucket of the background. Runs that reach a
    chunk's edge are joined with those of the next; where no record has
    several chunks there are none, and runs are not shuffled.
    """
    df = prepared(queries, key, fold)
    kind, spark = df.schema[key].dataType, df.sparkSession
    size = F.length("seq") * F.when(F.octet_length("seq") > F.length("seq"), 3).otherwise(1)  # upper-casing can make three letters of one
    total, longest = queries.agg(F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    blocks = max(1, -(-total // block), min(4 * spark.sparkContext.defaultParallelism, total // 250_000))
    pieces = df.mapInArrow(_pieces(k, key, chunk), T.StructType([df.schema[key], T.StructField("tag", T.LongType()), T.StructField("packed", T.BinaryType())]))
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64(key, "tag"), F.lit(blocks)).cast("int"))
    found = T.StructType([*(T.StructField(n, T.IntegerType()) for n in ("block", "bucket")), T.StructField("bits", T.BinaryType()), T.StructField(key, kind), T.StructField("tag", T.LongType()), T.StructField("again", T.ArrayType(T.LongType()))])
    hits = []
    if background is not None:
        buckets, packed = max(BUCKETS, -(-total // 4_000_000)), "block int, bucket int, keys binary"
        asked = pieces.groupBy("block").applyInArrow(_block_kmers(k, buckets), packed)
        known = background.select(F.col("kmer").cast("long").alias("kmer")).where("kmer is not null").mapInArrow(_packed_set(k, buckets), packed)
        matched = asked.unionByName(known).groupBy("bucket").applyInArrow(_match, "block int, bucket int, bits binary")
        hits.append(matched.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in found.fields[3:])))
    several = longest + k > chunk
    if several:  # a record of several chunks may repeat k-mers of another of its chunks
        kmers = df.where(F.length("text") + k > chunk).mapInArrow(_piece_kmers(k, key, chunk), T.StructType([df.schema[key], T.StructField("tag", T.LongType()), T.StructField("kmer", T.LongType())]))
        # a chunk names a k-mer it repeats itself twice
        again = kmers.groupBy("kmer", key).agg(F.count("*").alias("n"), F.collect_set("tag").alias("tags")).where("n > 1")
        again = again.select(key, F.explode("tags").alias("tag"), "kmer").groupBy(key, "tag").agg(F.collect_list("kmer").alias("again"))
        number = F.pmod(F.xxhash64(key, "tag"), F.lit(blocks)).cast("int").alias("block")
        hits.append(again.select(number, F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("bits"), key, "tag", "again"))
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, T.LongType()) for n in ("first", "last")), T.StructField("edge", T.BooleanType())])
    run = _regions(k, threshold, key, chunk, buckets if background is not None else 1)
    if hits:
        marks = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        runs = pieces.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, schema)
    else:
        runs = pieces.groupBy("block").applyInArrow(lambda table: run(table, None), schema)
    if not several:
        return runs.select(key, F.col("first").alias("start"), (F.col("last") + k).alias("end"))
    # runs of window starts; those at edges go on where the next begins right behind
    order = Window.partitionBy(key).orderBy("first")
    goes_on = F.col("edge") & F.lag("edge").over(order) & (F.lag("last").over(order) == F.col("first") - 1)
    runs = runs.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    found = runs.groupBy(key, "run").agg(F.min("first").alias("start"), (F.max("last") + k).alias("end"))
    return found.where(F.col("end") - F.col("start") >= threshold).select(key, "start", "end")


def _cut(batch: pa.RecordBatch, k: int, chunk: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, tag, letters) of each chunk; the tag is twice the chunk's number, odd if the record has several."""
    for i, (text, circular) in enumerate(zip(batch.column("text").to_pylist(), batch.column("circular").to_pylist())):
        whole = _extended(text, circular, k)
        count = -(-max(0, len(whole) - k + 1) // chunk)
        for c in range(count):
            yield i, 2 * c + (count > 1), whole[c * chunk : (c + 1) * chunk + k - 1]


def _pieces(k: int, key: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _grouped(_cut(batch, k, chunk)):
                owner, tags, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), pa.array(tags, pa.int64()), pa.array([zlib.compress(t, 1) for t in texts], pa.binary())], names=[key, "tag", "packed"])

    return run


def _grouped(rows: Iterator[tuple[int, int, bytes]], most: int = 4_000_000) -> Iterator[list[tuple[int, int, bytes]]]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[2])
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def _piece_kmers(k: int, key: str, chunk: int):
    """Each chunk's k-mers of the records that have several, twice if repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _grouped(((i, tag, text) for i, tag, text in _cut(batch, k, chunk) if tag % 2), 500_000):
                owners, tags, found = [], [], []
                for i, tag, text in rows:
                    keys, both = canonical_kmers(text, k)
                    own, first = np.unique(keys, return_index=True)
                    own = np.repeat(own, np.minimum(own_weight(keys, both)[first], 2))
                    owners.append(np.full(len(own), i)), tags.append(np.full(len(own), tag)), found.append(own)
                owner, tag, kmer = (np.concatenate(x) for x in (owners, tags, found))
                for a in range(0, len(owner), 50_000):
                    part = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner[part])), pa.array(tag[part]), pa.array(kmer[part])], names=[key, "tag", "kmer"])

    return run


def _unpacked(pieces: pa.Table) -> list[bytes]:
    return [zlib.decompress(p) for p in pieces["packed"].to_pylist()]


def _by_bucket(keys: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted keys by bucket, where each bucket begins in it). Keys of a short range share a bucket, so that gaps stay small."""
    bucket = mix64((keys >> min(13, max(0, 2 * k - 17))).view(np.uint64)) % np.uint64(buckets)
    if buckets <= 1 << 16:
        bucket = bucket.astype(np.uint16)  # which are sorted by their digits
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets))))


def _coded(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the number of hashes and these as they are, then the first code and the bytes of the gaps by place, as far as any gap has them."""
    hashes = int(np.searchsorted(keys, 0))
    head = np.array([hashes, *keys[:hashes]], dtype="<i8").tobytes()
    codes = keys[hashes:]
    if not len(codes):
        return head
    gaps = np.diff(codes)
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    planes = gaps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
    packer = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_RLE)
    return head + codes[:1].astype("<i8").tobytes() + bytes([width]) + packer.compress(planes.tobytes()) + packer.flush()


def _decoded(code: bytes) -> np.ndarray:
    at = 8 + 8 * int(np.frombuffer(code[:8], dtype="<i8")[0])
    hashes = np.frombuffer(code[8:at], dtype="<i8").astype(np.int64)
    if at == len(code):
        return hashes
    width, planes = code[at + 8], np.frombuffer(zlib.decompress(code[at + 9 :]), dtype=np.uint8)
    count = len(planes) // width if width else 0
    out = np.zeros((count + 1, 8), dtype=np.uint8)
    out[0] = np.frombuffer(code[at : at + 8], dtype=np.uint8)
    if width:
        out[1:, :width] = planes.reshape(width, count).T
    return np.concatenate((hashes, np.cumsum(out.view("<i8").reshape(-1), dtype=np.int64)))


def _bucket_rows(keys: np.ndarray, k: int, buckets: int, block: int | None) -> list[pa.Array]:
    """(block, bucket, keys) of sorted distinct keys, a row for each bucket that holds any."""
    order, begins = _by_bucket(keys, k, buckets)
    keys, filled = keys[order], np.flatnonzero(np.diff(begins))
    codes = [_coded(keys[begins[b] : begins[b + 1]]) for b in filled.tolist()]
    return [pa.array([block] * len(filled), pa.int32()), pa.array(filled, pa.int32()), pa.array(codes, pa.binary())]


def _block_kmers(k: int, buckets: int):
    """The distinct k-mers of a block."""

    def run(table: pa.Table) -> pa.Table:
        keys = distinct(block_windows(_unpacked(table), k)[0])
        return pa.Table.from_arrays(_bucket_rows(keys, k, buckets, table["block"][0].as_py()), names=["block", "bucket", "keys"])

    return run


def _packed_set(k: int, buckets: int, most: int = 4_000_000):
    """The background's k-mers of a task, distinct as far as they are held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            total += batch.num_rows
            if total >= most:
                yield flush(held)
                held, total = [], 0
        if total:
            yield flush(held)

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_bucket_rows(distinct(np.concatenate(held)), k, buckets, None), names=["block", "bucket", "keys"])

    return run


def _match(table: pa.Table) -> pa.Table:
    """Of one bucket, a bit for each key of each block: whether the background has it. Blocks without a hit have no row."""
    owners, codes = table["block"].to_pylist(), table["keys"]
    known, held, total = np.empty(0, dtype=np.int64), [], 0
    for i, owner in enumerate(owners):
        if owner is None:
            held.append(_decoded(codes[i].as_py()))
            total += len(held[-1])
            if total > len(known) + 1_000_000:  # repeats of the background are not gathered
                known, held, total = distinct(np.concatenate([known, *held])), [], 0
    known = distinct(np.concatenate([known, *held]))
    blocks, bits = [], []
    for i, owner in enumerate(owners):
        if owner is not None and len(known):
            keys = _decoded(codes[i].as_py())
            there = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
            if there.any():
                blocks.append(owner), bits.append(np.packbits(there).tobytes())
    return pa.Table.from_arrays([pa.array(blocks, pa.int32()), pa.array([table["bucket"][0].as_py()] * len(blocks), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])


def _regions(k: int, threshold: int, key: str, chunk: int, buckets: int):
    """(key, first, last, edge): runs of free windows of a block by their starts; those inside a chunk only if they are long enough."""

    def run(pieces: pa.Table, marks: pa.Table | None) -> pa.Table:
        tags, ids = pieces["tag"].to_numpy(), pieces[key].combine_chunks()
        keys, both, owner, sizes = block_windows(_unpacked(pieces), k)
        count = sizes - k + 1
        order = np.argsort(keys)
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        # of equal keys those of one piece must be neighbours; two are
        three = np.flatnonzero(same[1:] & same[:-1])
        if len(three):
            at = np.zeros(len(keys), dtype=bool)
            at[three] = at[three + 1] = at[three + 2] = True
            order[at] = order[at][np.lexsort((owner[order[at]], ordered[at]))]
        whose = owner[order]
        taken = np.zeros(len(keys), dtype=bool)
        repeated = same & (whose[1:] == whose[:-1])
        taken[1:] |= repeated
        taken[:-1] |= repeated
        if marks is not None and marks.num_rows:
            new = np.concatenate(([True], ~same))
            by, begins = _by_bucket(ordered[new], k, buckets)
            known = np.zeros(len(by), dtype=bool)
            for bucket, bits in zip(marks["bucket"].to_pylist(), marks["bits"].to_pylist()):
                if bucket is not None:
                    at = by[begins[bucket] : begins[bucket + 1]]
                    known[at] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=len(at))
            taken |= known[np.cumsum(new) - 1]
        free = np.empty(len(keys), dtype=bool)
        free[order] = ~taken
        free &= ~both
        begins = np.cumsum(count) - count
        if marks is not None and (marks["bucket"].null_count):
            piece = {x: i for i, x in enumerate(zip(ids.to_pylist(), tags.tolist()))}
            for bucket, ident, tag, again in zip(*(marks[c].to_pylist() for c in ("bucket", key, "tag", "again"))):
                if bucket is None:
                    i = piece[ident, tag]
                    part = slice(begins[i], begins[i] + count[i])
                    free[part] &= ~np.isin(keys[part], np.array(again, dtype=np.int64))
        starts, stops = free.copy(), free.copy()
        starts[1:] &= ~free[:-1]
        stops[:-1] &= ~free[1:]
        starts[begins], stops[begins + count - 1] = free[begins], free[begins + count - 1]
        starts, stops = np.flatnonzero(starts), np.flatnonzero(stops)
        own = owner[starts]
        first, last = starts - begins[own], stops - begins[own]
        tag = tags[own]
        edge = (tag % 2 == 1) & (((first == 0) & (tag > 1)) | (last == chunk - 1))
        kept = edge | (last - first + k >= threshold)
        own, first, last, edge, offset = own[kept], first[kept], last[kept], edge[kept], tag[kept] // 2 * chunk
        return pa.Table.from_arrays([ids.take(pa.array(own)), pa.array(first + offset), pa.array(last + offset), pa.array(edge)], names=[key, "first", "last", "edge"])

    return run


def numbered(regions: DataFrame, key: str = "rec_id") -> DataFrame:
    """Regions with ``region_no`` from 1 by position, and the note an annotated record carries."""
    no = F.row_number().over(Window.partitionBy(key).orderBy("start", "end"))
    return regions.withColumn("region_no", no).withColumn("note", F.format_string("Non-homologous region %d", "region_no"))


def feature_regions(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, regions): each record's homology-free entries, sorted by start and end; an empty list where there are none."""
    wanted = F.filter(
        F.coalesce("features", F.array().cast(records.schema["features"].dataType)),
        lambda f: (f["type"] == "misc_feature") & F.coalesce(F.try_element_at(f["qualifiers"], F.lit("label")) == F.array(F.lit("homology_free")), F.lit(False)),
    )
    return records.select(key, F.array_sort(F.transform(wanted, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))).alias("regions"))
