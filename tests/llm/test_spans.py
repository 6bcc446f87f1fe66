import random
from collections import defaultdict

import numpy as np
import pytest

from strandloom.llm import queries, spans


def brute(rows, span):
    where = defaultdict(set)
    texts = []
    for rec, s in rows:
        s = "".join(c for c in (s or "").upper() if "A" <= c <= "Z").replace("U", "T")
        if rec is not None:
            texts.append((rec, s))
            for i in range(len(s) - span + 1):
                where[s[i : i + span]].add(rec)
    cover = defaultdict(set)
    for rec, s in texts:
        for i in range(len(s) - span + 1):
            if len(where[s[i : i + span]]) > 1:
                cover[rec] |= set(range(i, i + span))
    out = set()
    for rec, c in cover.items():
        for p in sorted(c):
            if p - 1 not in c:
                a = p
            if p + 1 not in c:
                out.add((rec, a, p + 1))
    return out


def got(spark, rows, span):
    df = spark.createDataFrame([(r, s, 1) for r, s in rows], "rec_id long, seq string, h int")
    res = [tuple(r) for r in spans.shared_spans(df, span=span).collect()]
    assert len(res) == len(set(res))
    return set(res)


def make(seed, alphabet="ACGT", n=60, unit=120):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(alphabet) for _ in range(unit)) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.5:
                p = rng.choice(pool)
                a = rng.randrange(unit - 20)
                parts.append(p[a : a + rng.randrange(20, unit)])
            else:
                parts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 80))))
        rows.append((i, "".join(parts)))
    return rows + [(1000, None), (1001, ""), (1002, "ACG"), (None, rows[0][1])]


@pytest.mark.parametrize("span", [8, 24, 50])
def test_against_brute_force(spark, span):
    rows = make(span)
    assert got(spark, rows, span) == brute(rows, span)


def test_other_letters_layout_and_low_complexity(spark):
    rows = make(3, "ACGTN", 30) + [(200, "A" * 300), (201, "a" * 120 + "C"), (202, ("AT" * 80).lower()), (203, "C" + "AT" * 40)]
    rows += [(300, "acgu\n" * 30), (301, "ACGT" * 30)]
    assert got(spark, rows, 50) == brute(rows, 50)


def test_hot_anchors_go_by_their_runs(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 3)
    rows = make(5, n=80)
    assert got(spark, rows, 30) == brute(rows, 30)


def test_repeated_keys_and_empty(spark):
    text = "ACGGTTACCA" * 12
    assert got(spark, [(1, text), (1, text)], 50) == set()
    assert got(spark, [], 50) == set()


def test_pack_round_trip():
    for s in (b"A", b"ACGT", b"ACGTA", b"ACGTNA", b"ACGTACG"):
        assert spans.unpack(spans.pack(s)).tobytes() == s


def test_share_has_every_record(spark, tmp_path):
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("ACGT") for _ in range(60)) for _ in range(3))
    rows = [(1, a + b), (2, "acg " + a.lower()), (3, c), (4, "ACGU"), (5, ""), (6, None), (7, " 12 ")]
    spark.createDataFrame(rows, "rec_id long, seq string").write.parquet(str(tmp_path / "sequences.parquet"))
    got = {tuple(r) for r in queries.p3_share(spark, str(tmp_path)).select("rec_id", "stretches", "shared_letters", "n_letters", "share").collect()}
    assert got == {(1, 1, 60, 120, 0.5), (2, 1, 60, 63, 60 / 63), (3, 0, 0, 60, 0.0), (4, 0, 0, 4, 0.0)}


def test_long_records_are_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 60)
    rows = make(9, n=50)
    assert got(spark, rows, 30) == brute(rows, 30)
    monkeypatch.setattr(spans, "HOT", 3)
    assert got(spark, rows, 30) == brute(rows, 30)


def test_first_records_keep_what_others_repeat(spark):
    rows = make(12, n=60) + [(400, "A" * 200), (401, "A" * 90), (2, "ACCTGA" * 20), (402, "ACCTGA" * 20)]
    texts = [(r, "".join(c for c in (s or "").upper() if "A" <= c <= "Z").replace("U", "T")) for r, s in rows if r is not None]
    first = {}
    for r, s in texts:
        for i in range(len(s) - 29):
            first[s[i : i + 30]] = min(first.get(s[i : i + 30], r), r)
    for hot in (spans.HOT, 3):
        old, spans.HOT = spans.HOT, hot
        try:
            df = spark.createDataFrame(rows, "rec_id long, seq string")
            found = spans.shared_spans(df, span=30, repeats=True).collect()
        finally:
            spans.HOT = old
        cover = defaultdict(set)
        for r in found:
            cover[r["rec_id"]] |= set(range(r["span_start"], r["span_end"]))
        want = defaultdict(set)
        for r, s in texts:
            for i in range(len(s) - 29):
                if first[s[i : i + 30]] < r:
                    want[r] |= set(range(i, i + 30))
        for r, s in texts:
            # two rows of one key are told apart by their letters only where both are covered
            assert cover[r] == want[r]


def test_names_are_those_of_the_run_alone():
    rng = random.Random(2)
    for span in (8, 30, 50):
        run = "".join(rng.choice("ACGT") for _ in range(span))
        seen = set()
        for n in range(20):
            text = "".join(rng.choice("AC") for _ in range(n)) + run + "".join(rng.choice("GT") for _ in range(20 - n))
            start, name = spans.names(np.frombuffer(text.encode(), dtype=np.uint8), np.array([len(text)]), span)
            seen.add(int(name[start.tolist().index(n)]))
        assert len(seen) == 1


def test_low_complexity_becomes_few_rows(spark):
    rng = random.Random(4)
    records = [(i, "A" * 30_000 + "".join(rng.choice("CG") for _ in range(50)) + "AT" * 15_000) for i in range(6)]
    df = spark.createDataFrame(records, "rec_id long, seq string")
    rows = df.selectExpr("rec_id rec", "seq").mapInArrow(spans._name_rows(50), "h long, rec long, chunk int, n int").collect()
    assert len(rows) < 6 * 60 and sum(r["n"] for r in rows) == 6 * (60_050 - 49)
    got = {tuple(r) for r in spans.shared_spans(df).collect()}
    # beside the stretches only letters that happen to agree
    assert sorted((r, a == 0) for r, a, _ in got) == [(i, x) for i in range(6) for x in (False, True)]
    assert all(30_000 <= b <= 30_025 if a == 0 else 30_025 <= a <= 30_050 and b == 60_050 for _, a, b in got)
