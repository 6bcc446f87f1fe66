import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.kmers import block_windows, canonical_kmers, distinct, reverse_complement_bytes
from strandloom.operators import kmers, regions
from strandloom.plans import queries

SCHEMA = "rec_id long, seq string, topology string, pos int"


def records(spark, *rows):
    return spark.createDataFrame([(i, s, t, 0) for i, (s, t) in enumerate(rows)], SCHEMA)


A, B = "ATCGA", "ATGCATGCAAGGCCTT"
# Sequences and results that any implementation of these definitions gives.
LONG, ONE = "ATATAACCCCCTTTTTGGGGCCCGCG", "TATAACCCCCTTTTTGGGG"


def test_counts_of_background_sets(spark):
    def count(*rows):
        return kmers.both_strands(kmers.background_set(records(spark, *rows), 4), 4).first()[0]

    assert count((A, "circular")) == 9
    assert count((B, "linear")) == 13
    assert count((A, "circular"), (B, None)) == 22
    assert kmers.both_strands(kmers.background_set(records(spark), 4), 4).first()[0] == 0
    merged = kmers.merge_sets([kmers.background_set(records(spark, (A, "CIRCULAR")), 4), kmers.background_set(records(spark, (B, "linear")), 4)])
    assert kmers.both_strands(merged, 4).first()[0] == 22
    assert kmers.merge_sets([], spark).count() == 0


def test_repeated_kmers_count_both_strands(spark):
    rows = kmers.record_kmers(records(spark, (A, "circular"), (B, "linear")), 4).where("times >= 2")
    by = {r["rec_id"]: kmers.both_strands(rows.where(F.col("rec_id") == r["rec_id"]), 4).first()[0] for r in rows.select("rec_id").distinct().collect()}
    assert by == {0: 1, 1: 9}


def found(spark, seq, background, k, threshold, topology=None):
    known = kmers.background_set(records(spark, *((b, None) for b in background)), k) if background else None
    return sorted((r["start"], r["end"]) for r in regions.homology_free_regions(records(spark, (seq, topology)), known, k, threshold).collect())


def test_regions(spark):
    assert found(spark, B, [], 4, 5) == [(6, 11)]
    assert found(spark, LONG, [ONE], 5, 5) == [(0, 5), (16, 21), (19, 26)]
    assert found(spark, LONG, [ONE], 5, 6) == [(19, 26)]
    assert found(spark, LONG, ["TATAACCCCCTTTTT", "GGGGCCCC"], 5, 5) == [(0, 5), (12, 20), (19, 26)]
    assert found(spark, A, [], 4, 4, "circular") == [(0, 4), (2, 8)]


def brute_regions(seq, circular, background, k, threshold):
    comp = str.maketrans("ACGTRYN", "TGCAYRN")
    t = seq + seq[: k - 1] if circular else seq
    w = [t[i : i + k] for i in range(len(t) - k + 1)]
    both = w + [x[::-1].translate(comp) for x in w]
    known = set()
    for s, c in background:
        u = s + s[: k - 1] if c else s
        for i in range(len(u) - k + 1):
            known |= {u[i : i + k], u[i : i + k][::-1].translate(comp)}
    free = [x not in known and both.count(x) == 1 for x in w] + [False]
    out, start = [], None
    for i, f in enumerate(free):
        if f and start is None:
            start = i
        if not f and start is not None:
            if i - 1 + k - start >= threshold:
                out.append((start, i - 1 + k))
            start = None
    return out


@pytest.mark.parametrize("k", [3, 4, 7])
def test_regions_against_brute_force(spark, k):
    rng = random.Random(k)

    def make(n):
        return ["".join(rng.choice("ACGTACGTACGTACGTRYN") for _ in range(rng.randrange(0, 70))) for _ in range(n)]

    queries = [(s, rng.choice(["circular", "Linear", None])) for s in make(40)] + [("", None), (None, None)]
    back = [(s, rng.choice(["circular", "linear"])) for s in make(2 if k < 7 else 20)]
    known = kmers.background_set(records(spark, *back), k)
    df = records(spark, *queries)
    got = {(r["rec_id"], r["start"], r["end"]) for r in regions.homology_free_regions(df, known, k, k + 1).collect()}
    want = {(i, a, b) for i, (s, t) in enumerate(queries) if s for a, b in brute_regions(s, t == "circular", [(x, c == "circular") for x, c in back], k, k + 1)}
    assert got == want
    free = kmers.free_in_record(df, k).join(known, "kmer", "left_anti")
    assert {(r["rec_id"], r["start"], r["end"]) for r in regions.runs(free, k, k + 1).collect()} == want
    numbers = regions.numbered(regions.homology_free_regions(df, known, k, k + 1)).where("rec_id = 0").orderBy("region_no").collect()
    assert [r["region_no"] for r in numbers] == list(range(1, len(numbers) + 1))


def test_index_store(spark, tmp_path):
    path = str(tmp_path / "index")
    kmers.save_index(kmers.background_set(records(spark, (B, None)), 4), path, "b", 4)
    kmers.save_index(kmers.background_set(records(spark, (A, "circular")), 4), path, "a", 4)
    kmers.save_index(kmers.background_set(records(spark, (A, "circular")), 5), path, "five", 5)
    known, k = kmers.load_index(spark, path, ["a", "b", "nobody"])
    assert k == 4 and kmers.both_strands(known, 4).first()[0] == 22
    with pytest.raises(ValueError):
        kmers.load_index(spark, path)
    with pytest.raises(ValueError):
        kmers.load_index(spark, path, ["nobody"])


def test_bad_k(spark):
    for k in (0, -1):
        with pytest.raises(ValueError):
            kmers.kmer_windows(records(spark, (A, None)), k)


def test_kmer_windows_guard_short_sequences(spark):
    rows = kmers.kmer_windows(records(spark, ("ACG", None), ("ACGT", None), (None, None), ("", "circular"), ("ACGT", "circular")), 4).collect()
    assert sorted((r["rec_id"], r["pos"]) for r in rows) == [(1, 0), (4, 0), (4, 1), (4, 2), (4, 3)]


def test_queries_give_kmers_with_ambiguous_letters(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGTACGTACGTACGTRYN") for _ in range(60)) for _ in range(12)] + ["ACGTN" * 8, "RAAAAAAAAAAAAAAT" * 2, "N" * 40, None]
    rows = [(i, t, rng.choice(["circular", None]), "background" if i % 2 == 0 else "query") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "rec_id long, seq string, topology string, role string").write.parquet(str(tmp_path / "sequences.parquet"))
    comp = str.maketrans("ACGTRYN", "TGCAYRN")

    def windows(text, topology, k):
        t = text + text[: k - 1] if topology else text
        pairs = [(t[i : i + k], t[i : i + k][::-1].translate(comp)) for i in range(len(t) - k + 1)]
        return [min(p) for p in pairs for _ in range(1 + (p[0] == p[1]))]

    want = {w for _, s, t, role in rows if s and role == "background" for w in windows(s, t, queries.K)}
    got = [r["kmer"] for r in queries.background_kmers(spark, str(tmp_path)).collect()]
    assert any(set(w) - set("ACGT") for w in want) and len(got) == len(set(got)) and set(got) == want
    want = {(i, w, n) for i, s, t, _ in rows if s for c in [windows(s, t, queries.EVEN_K)] for w in set(c) for n in [c.count(w)] if n >= 2}
    assert any(set(w) - set("ACGT") for _, w, _ in want)
    assert sorted((r["rec_id"], r["kmer"], r["times"]) for r in queries.repeated_kmers(spark, str(tmp_path)).collect()) == sorted(want)


def _free_runs(text, circular, background, k, threshold):
    """Brute force on letters."""
    flip = str.maketrans("ACGTacgtRYry", "TGCAtgcaYRyr")
    rc = lambda w: w[::-1].translate(flip)
    whole = text + text[: k - 1] if circular else text
    windows = [whole[i : i + k] for i in range(len(whole) - k + 1)]
    own = Counter()
    for w in windows:
        own[min(w, rc(w))] += 2 if w == rc(w) else 1
    known = {min(b[i : i + k], rc(b[i : i + k])) for b in background for i in range(len(b) - k + 1)}
    out, start = [], None
    for i in range(len(windows) + 1):
        free = i < len(windows) and own[min(windows[i], rc(windows[i]))] == 1 and min(windows[i], rc(windows[i])) not in known
        if free and start is None:
            start = i
        if not free and start is not None:
            if i - 1 + k - start >= threshold:
                out.append((start, i - 1 + k))
            start = None
    return out


@pytest.mark.parametrize("chunk", [7, 50, 1000])
@pytest.mark.parametrize("k", [4, 9, 33])
def test_regions_in_chunks_against_brute_force(spark, k, chunk):
    rng = random.Random(k * 100 + chunk)
    pool = ["".join(rng.choices("ACGT", k=70)) for _ in range(6)]
    rows = []
    for i in range(12):
        text = "".join(rng.choice([rng.choice(pool), "".join(rng.choices("ACGTR", k=rng.randrange(5, 90))), "AT" * 12]) for _ in range(rng.randrange(1, 7)))
        rows.append((i, text if i % 3 else text.lower(), "circular" if i % 4 == 0 else "linear"))
    background = ["".join(rng.choices("ACGT", k=60)), pool[0][10:60], pool[1]]
    known = kmers.background_set(spark.createDataFrame(list(enumerate(background)), "rec_id long, seq string"), k, fold=False)
    df = spark.createDataFrame(rows, "rec_id long, seq string, topology string")
    for bg, texts in ((known, background), (None, [])):
        got = sorted(tuple(r) for r in regions.homology_free_regions(df, bg, k, k + 3, fold=False, chunk=chunk).collect())
        want = sorted((i, a, b) for i, t, c in rows for a, b in _free_runs(t, c == "circular", texts, k, k + 3))
        assert got == want


def test_hashed_windows_are_strand_neutral_and_know_palindromes():
    text = b"acgtNNACGTnacgtACGTNNACGT"
    flipped = reverse_complement_bytes(text)
    for k in (5, 40):
        long = text * 4 if k == 40 else text
        back = flipped * 4 if k == 40 else flipped
        keys, both = canonical_kmers(long, k)
        other, also = canonical_kmers(back, k)
        assert keys.tolist() == other[::-1].tolist() and both.tolist() == also[::-1].tolist()
        for i, key in enumerate(keys.tolist()):
            w = long[i : i + k]
            assert both[i] == (w == reverse_complement_bytes(w))
            assert key >= 0 or (-1 - key) % 2 == both[i]


def test_lower_case_is_no_slow_path():
    text = bytes(random.Random(1).choices(b"ACGT", k=300_000))
    began = time.perf_counter()
    canonical_kmers(text, 20)
    upper = time.perf_counter() - began
    began = time.perf_counter()
    canonical_kmers(text.lower(), 20)
    assert time.perf_counter() - began < 10 * upper + 0.2


def test_blocks_of_texts_have_the_windows_of_each():
    rng = random.Random(1)
    for k in (1, 2, 5, 15, 33):
        texts = ["".join(rng.choices("ACGTNR", weights=[9, 9, 9, 9, 1, 1], k=rng.randrange(0, 60))).encode() for _ in range(300)]
        keys, both, owner, _ = block_windows(texts, k)
        for i, text in enumerate(texts):
            own, palindromes = canonical_kmers(text, k)
            assert keys[owner == i].tolist() == own.tolist() and both[owner == i].tolist() == palindromes.tolist()
    assert [len(x) for x in block_windows([], 5)] == [0, 0, 0, 0]


def test_packed_keys_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 300):
        for low, high in ((0, 2**30), (-(2**62), 2**62), (-(2**62), 0), (0, 2 * n)):
            keys = distinct(rng.integers(low, high, n))
            assert regions._decoded(regions._coded(keys)).tolist() == keys.tolist()


@pytest.mark.parametrize("k, block", [(4, 30), (9, 200), (33, 1000)])
def test_regions_in_blocks_against_brute_force(spark, k, block):
    rng = random.Random(k)
    pool = ["".join(rng.choices("ACGT", k=70)) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(pool), "".join(rng.choices("ACGTN", k=rng.randrange(5, 90))), "AT" * 12, "A" * 9]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    background = [pool[0][10:60], pool[1], pool[1][:40], "".join(rng.choices("ACGTN", k=200))]
    back = spark.createDataFrame(list(enumerate(background)), "rec_id long, seq string")
    df = spark.createDataFrame([(f"r{i}", t, "linear") for i, t in enumerate(texts)], "rec_id string, seq string, topology string").repartition(3)
    want = sorted((f"r{i}", a, b) for i, t in enumerate(texts) for a, b in _free_runs(t, False, background, k, k + 2))
    known = kmers.window_set(back, k, fold=False, most=100)
    for chunk in (60, 10_000):
        got = sorted(tuple(r) for r in regions.homology_free_regions(df, known, k, k + 2, fold=False, chunk=chunk, block=block).collect())
        assert got == want
    nothing = back.select(F.lit(None).cast("long").alias("kmer"))
    assert regions.homology_free_regions(df.limit(0), known, k, k + 2).collect() == []
    assert regions.homology_free_regions(df, nothing, k, k + 2, block=block).count() == regions.homology_free_regions(df, None, k, k + 2).count()


def test_no_row_of_the_lookup_is_a_single_k_mer(spark):
    df = records(spark, *(("".join(random.Random(i).choices("ACGT", k=500)), None) for i in range(40)))
    plan = regions.homology_free_regions(df, kmers.window_set(df, 15), 15, 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("FlatMapGroupsInArrow") == 2
