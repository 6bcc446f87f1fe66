import random

import pytest

from strandloom.llm.split import boundaries, cut, split_oversized

REC = "rec_id long, seq string, text string"
REQ = "request_id long, rec_id long, config_id int"
CFG = "config_id int, max_size int, min_overlap int, motif string"


def test_pieces_cover_and_overlap():
    rng = random.Random(1)
    for _ in range(300):
        n, most = rng.randrange(1, 400), rng.randrange(1, 90)
        overlap = rng.randrange(0, min(40, most))
        text = "".join(rng.choice("ACGT") for _ in range(n)).encode()
        bounds = boundaries(text, b"GC")
        assert bounds == [i for i in range(1, n - 1) if text[i : i + 2] == b"GC"]
        pieces = cut(n, bounds, most, overlap)
        used = overlap
        assert pieces[0][0] == 0 and pieces[-1][1] == n
        for (a, b, _), (c, d, natural) in zip(pieces, pieces[1:]):
            assert 0 < b - a <= most and c > a and b - c == used
            assert not natural or c in bounds
            if not natural:
                assert not [x for x in bounds if a < x <= a + most - used]
        assert pieces[-1][1] - pieces[-1][0] <= most


def test_cases(spark):
    rec = spark.createDataFrame([(1, "acgu " * 10, "x"), (2, "AAA", "x"), (3, None, "x"), (4, "", "x"), (5, "GCGCGCGCGC", "x"), (5, "AAAAAAAAAA", "y")], REC)
    req = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 2, 1), (5, 5, 1), (6, 1, None), (7, 1, 99), (8, None, 1), (9, 3, 1), (10, 4, 1), (11, 77, 1), (12, 1, 3)], REQ)
    cfg = spark.createDataFrame([(1, 8, 2, "gcg"), (2, 39, 0, None), (3, None, 1, "A"), (None, 3, 1, "A")], CFG)
    got = {(r["rec_id"], r["config_id"], tuple(r["boundaries"]), len(r["pieces"])) for r in split_oversized(rec, req, cfg).collect()}
    assert got == {(1, 1, (), 7), (1, 2, (), 2), (5, 1, (2, 4, 6), 2), (5, 1, (), 2)}


def test_overlaps_that_cannot_be_are_refused(spark):
    for overlap in (-1, 8, 9):
        with pytest.raises(ValueError):
            cut(100, [], 8, overlap)
    rec, req = spark.createDataFrame([(1, "ACGT" * 10, "x")], REC), spark.createDataFrame([(1, 1, 1)], REQ)
    row = split_oversized(rec, req, spark.createDataFrame([(1, 8, 8, "GT")], CFG)).first()
    assert row["boundaries"][0] == 2 and row["pieces"] is None


def test_empty_tables(spark):
    rec, req, cfg = spark.createDataFrame([], REC), spark.createDataFrame([], REQ), spark.createDataFrame([], CFG)
    assert split_oversized(rec, req, cfg).collect() == []
