import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import queries, seen


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000])
@pytest.mark.parametrize("bits", [8, 16, 32])
def test_filter_holds_all_its_keys(n, bits):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    f = seen.Filter(keys, bits)
    assert f.holds(keys).all()
    others = np.random.default_rng(n + 1).integers(2**63, 2**64 - 1, 200_000, dtype=np.uint64)
    assert f.holds(others).mean() < 3 * 2**-bits + 1e-4


def brute(rows):
    first = {}
    for _, key, at in rows:
        if key is not None:
            at = -(2**63) if at is None else at
            first[key] = min(first.get(key, at), at)
    return {i for i, key, at in rows if key is not None and first[key] < (-(2**63) if at is None else at)}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        key = "hot" if rng.random() < 0.33 else None if rng.random() < 0.05 else f"k{rng.randrange(2500)}"
        rows.append((i, key, None if rng.random() < 0.01 else rng.randrange(3000)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, True) for r in rows], "probe long, key string, at long, seen boolean")
    decided = seen.seen_before(df, [F.col("key")], "probe", "at", batch_keys=200, bits=8).cache()
    out = seen.checked(decided).collect()
    assert len(out) == sum(k is not None for _, k, _ in rows)
    want = brute(rows)
    assert {r["id"] for r in out if r["seen"]} == want
    assert {r["id"] for r in out if r["claimed"]} >= want  # the filters miss nothing
    assert max(r["filters"] for r in out) > 3
    wrong = sum(r["claimed"] and not r["seen"] for r in out)
    assert wrong <= 40
    exact = seen.seen_before(df, [F.col("key")], "probe", "at", batch_keys=100).where("seen").collect()
    assert {r["id"] for r in exact} == want  # 32 bits


def test_a_hot_key_is_left_once_a_batch(spark):
    rows = [(i, "hot", i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "probe long, key string, at long").coalesce(1)
    out = seen.seen_before(df, [F.col("key")], "probe", "at", batch_keys=2).collect()
    assert {r["id"] for r in out if r["seen"]} == set(range(1, 30_000))
    assert sum(r["how"] != "scan" for r in out) <= 10


def test_generations_grow_with_the_keys(spark):
    df = spark.range(40_000).selectExpr("id probe", "concat('k', id % 30000) key", "id at").coalesce(1)
    out = seen.seen_before(df, [F.col("key")], "probe", "at", batch_keys=100)
    assert 10 < out.agg(F.max("filters")).first()[0] <= 40  # 300 filters if all were of one size
    assert out.where("seen").count() == 10_000 and out.where("how = 'filter'").count() > 5_000


def test_rates_and_totals(spark, tmp_path):
    letters = ["".join("ACGT"[i // 4**j % 4] for j in range(6)) + "AAAAAA" for i in range(4000)]
    probes = spark.createDataFrame([(i, i, "b", letters[i % 4000]) for i in range(9000)], "probe_id long, arrival_no long, background_id string, seq string")
    probes.write.parquet(str(tmp_path / "probes.parquet"))
    spark.createDataFrame([("b", 12)], "id string, kmer_size int").write.parquet(str(tmp_path / "manifest.parquet"))
    rates = queries.p5_rates(spark, str(tmp_path)).collect()
    keys, found, wrong = queries.p5_totals(spark, str(tmp_path)).first()
    assert keys == 9000 == sum(r["keys"] for r in rates) and wrong == 0
    assert found == 9000 - len(set(letters))
    assert max(r["filters"] for r in rates) > 2 and any(r["how"] == "filter" for r in rates)
    assert 0 < sum(r["expected_wrong"] for r in rates) < 1e-4


def test_empty(spark):
    df = spark.createDataFrame([], "probe long, key string, at long")
    assert seen.checked(seen.seen_before(df, [F.col("key")], "probe", "at")).collect() == []


def test_probe_keys(spark):
    probes = spark.createDataFrame(
        [(1, 1, "b", "acgu AA"), (2, 2, "b", "TTACGT"), (3, 3, "b", "ACGN"), (4, 4, "b", "AC"), (5, 5, "x", "ACGT"), (6, 6, None, "ACGT"), (7, 7, "n", "ACGT"), (8, 8, "b", None)],
        "probe_id long, arrival_no long, background_id string, seq string",
    )
    manifest = spark.createDataFrame([("b", 4, 1), ("b", 4, 2), ("n", None, 3)], "id string, kmer_size int, species int")
    got = {r["probe_id"]: r["key"] for r in seen.probe_keys(probes, manifest).collect()}
    assert {k: v for k, v in got.items() if v} == {1: "ACGT", 2: "CGTAA"[0:0] or "GTAA"}
