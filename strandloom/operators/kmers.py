"""k-mer sets: background sets, repeats within a record, merged and stored indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.kmers import block_windows, canonical_kmers, distinct, reverse_complement_bytes
from strandloom.functions.letters import is_circular, letters


def _check(k: int) -> None:
    if k < 1:
        raise ValueError("k must be positive")


def prepared(records: DataFrame, key: str = "rec_id", fold: bool = True) -> DataFrame:
    """(key, text, circular): letters folded to upper case with U as T, or the sequence as it stands."""
    text = letters(F.col("seq")) if fold else F.col("seq")
    circular = is_circular(F.col("topology")) if "topology" in records.columns else F.lit(False)
    return records.select(F.col(key), text.alias("text"), circular.alias("circular")).where(f"`{key}` is not null and text is not null")


def _extended(text: str, circular: bool, k: int) -> bytes:
    return (text + text[: k - 1] if circular else text).encode("ascii", "replace")


def own_weight(keys: np.ndarray, both: np.ndarray) -> np.ndarray:
    """How often each window's k-mer occurs in its record on either strand; its own reverse complement counts twice."""
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[at] * np.where(both, 2, 1)


def _words(text: bytes, keys: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The strand-neutral letters of the windows at ``at`` that have a digest as key; null for all others."""
    out = np.full(len(at), None, dtype=object)
    for i in np.flatnonzero(keys[at] < 0).tolist():
        w = text[at[i] : at[i] + k]
        out[i] = min(w, reverse_complement_bytes(w)).decode("ascii")
    return out


def _rows(k: int, key: str, pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]], names: list[str], spelled: bool = False):
    """A task that turns every record into rows (key, columns picked from its canonical k-mers).

    ``spelled``: the last column picked is a window of the row, and gives ``word``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, columns, held = [], [[] for _ in names], 0
            ids = batch.column(key)
            for i, (text, circular) in enumerate(zip(batch.column("text").to_pylist(), batch.column("circular").to_pylist())):
                extended = _extended(text, circular, k)
                keys, both = canonical_kmers(extended, k)
                if not len(keys):
                    continue
                picked = pick(keys, both)
                if spelled:
                    picked = (*picked[:-1], _words(extended, keys, picked[-1], k))
                owners.append(np.full(len(picked[0]), i))
                for column, values in zip(columns, picked):
                    column.append(values)
                held += len(picked[0])
                if held > 200_000:
                    yield from flush(ids, owners, columns)
                    owners, columns, held = [], [[] for _ in names], 0
            yield from flush(ids, owners, columns)

    def flush(ids, owners, columns) -> Iterator[pa.RecordBatch]:
        if not owners:
            return
        owner = np.concatenate(owners)
        arrays = [np.concatenate(c) for c in columns]
        for a in range(0, len(owner), 50_000):
            part = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[part])), *(pa.array(x[part], pa.string()) if x.dtype == object else pa.array(x[part].astype(np.int64)) for x in arrays)], names=[key, *names])

    return run


def _schema(df: DataFrame, key: str, names: list[str]) -> T.StructType:
    return T.StructType([df.schema[key], *(T.StructField(n, T.StringType() if n == "word" else T.LongType()) for n in names)])


def kmer_windows(records: DataFrame, k: int, key: str = "rec_id", fold: bool = True) -> DataFrame:
    """(key, pos, kmer): every window of every record, circular ones past the end by k - 1 letters; none if shorter than k.

    ``kmer`` is the strand-neutral key. Null keys and null or empty sequences
    give no row.
    """
    _check(k)
    df = prepared(records, key, fold)
    return df.mapInArrow(_rows(k, key, lambda keys, both: (np.arange(len(keys)), keys), ["pos", "kmer"]), _schema(df, key, ["pos", "kmer"]))


def record_kmers(records: DataFrame, k: int, key: str = "rec_id", fold: bool = True, spelled: bool = False) -> DataFrame:
    """(key, kmer, times): distinct strand-neutral k-mers of each record and their occurrences on both strands.

    ``times`` counts a k-mer that is its own reverse complement twice per
    site; ``times`` >= 2 means repeated within the record. ``spelled`` adds
    ``word``, the letters of k-mers with other letters than A, C, G and T.
    """
    _check(k)
    names = ["kmer", "times", *(["word"] if spelled else [])]

    def pick(keys: np.ndarray, both: np.ndarray):
        weight = own_weight(keys, both)
        _, first = np.unique(keys, return_index=True)
        return (keys[first], weight[first], *([first] if spelled else []))

    df = prepared(records, key, fold)
    return df.mapInArrow(_rows(k, key, pick, names, spelled), _schema(df, key, names))


def free_in_record(records: DataFrame, k: int, key: str = "rec_id", fold: bool = True) -> DataFrame:
    """(key, pos, kmer) of the windows whose k-mer occurs once in their record, on either strand."""
    _check(k)

    def pick(keys: np.ndarray, both: np.ndarray):
        pos = np.flatnonzero(own_weight(keys, both) == 1)
        return pos, keys[pos]

    df = prepared(records, key, fold)
    return df.mapInArrow(_rows(k, key, pick, ["pos", "kmer"]), _schema(df, key, ["pos", "kmer"]))


def background_set(records: DataFrame, k: int, key: str = "rec_id", fold: bool = True, merge: bool = True, spelled: bool = False) -> DataFrame:
    """The distinct k-mers of the background on both strands: (kmer), or (key, kmer) unmerged; with ``word`` if ``spelled``.

    A k-mer is in the both-strand set if and only if its strand-neutral key is
    among the keys of the forward windows, so one strand is enough. An empty
    background gives an empty set.
    """
    columns = ["kmer", *(["word"] if spelled else [])]
    rows = record_kmers(records, k, key, fold, spelled).select(key, *columns)
    return rows.select(*columns).distinct() if merge else rows


def window_set(records: DataFrame, k: int, key: str = "rec_id", fold: bool = True, most: int = 2_000_000) -> DataFrame:
    """(kmer): the set of ``background_set``, distinct only within about ``most`` letters of a task, so that nothing is shuffled."""
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for text, circular in zip(batch.column("text").to_pylist(), batch.column("circular").to_pylist()):
                held.append(_extended(text, circular, k))
                total += len(held[-1])
                if total >= most:
                    yield from flush(held)
                    held, total = [], 0
        yield from flush(held)

    def flush(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys = distinct(block_windows(held, k)[0])
        for a in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000])], names=["kmer"])

    return prepared(records, key, fold).mapInArrow(run, "kmer long")


def both_strands(kmers: DataFrame, k: int) -> DataFrame:
    """Number of k-mers on both strands that a set of strand-neutral keys stands for (``kmers``: one row)."""
    own = is_palindrome(F.col("kmer"), k)
    return kmers.agg(F.coalesce(F.sum(F.when(own, 1).otherwise(2)), F.lit(0)).alias("kmers"))


def kmer_text(kmer, k: int, word=None):
    """The letters of a key; of windows that have a hash as key ``word``, null if it is not given."""
    text = F.when(kmer >= 0, F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT"))
    return text if word is None else text.otherwise(word)


def is_palindrome(kmer, k: int):
    """Whether the k-mer is its own reverse complement; a hash says so in its last bit."""
    text = kmer_text(kmer, k)
    return F.when(kmer < 0, (-1 - kmer) % 2 == 1).otherwise(F.coalesce(text == F.translate(F.reverse(text), "ACGT", "TGCA"), F.lit(False)))


def merge_sets(sets: list[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """The union of k-mer sets; no set at all is the empty set."""
    if not sets:
        return (spark or SparkSession.active()).createDataFrame([], "kmer long")
    out = sets[0].select("kmer")
    for other in sets[1:]:
        out = out.unionByName(other.select("kmer"))
    return out.distinct() if len(sets) > 1 else out


def save_index(kmers: DataFrame, path: str, background_id: str, k: int) -> None:
    """Add a set to the index store, a Parquet table split by background and k."""
    _check(k)
    kmers.select("kmer").withColumn("background_id", F.lit(background_id)).withColumn("k", F.lit(k)).write.mode("append").partitionBy("background_id", "k").parquet(path)


def load_index(spark: SparkSession, path: str, background_ids: list[str] | None = None) -> tuple[DataFrame, int]:
    """(kmer set, k) of the chosen backgrounds; unknown ids are ignored, different k are refused."""
    stored = spark.read.schema("kmer long, background_id string, k int").parquet(path)
    if background_ids is not None:
        stored = stored.where(F.col("background_id").isin([*background_ids]))
    ks = [r["k"] for r in stored.select("k").distinct().limit(2).collect()]
    if len(ks) > 1:
        raise ValueError("the chosen backgrounds have different k")
    if not ks:
        raise ValueError("none of the chosen backgrounds is stored")
    return stored.select("kmer").distinct(), ks[0]
