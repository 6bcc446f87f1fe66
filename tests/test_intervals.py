import random

from strandloom.operators import intervals
from strandloom.operators.intervals import homology_free_ranges, periods


def brute(rows):
    by = {}
    for e, s, t in rows:
        if s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    out = set()
    for e, spans in by.items():
        merged = []
        for s, t in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out |= {(e, "covered", s, t) for s, t in merged}
        out |= {(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows, block):
    df = spark.createDataFrame(rows, "e string, s long, t long")
    got = [tuple(r) for r in periods(df, ["e"], "s", "t", block).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    for block in (4, 16, 1 << 16):
        rows = []
        for _ in range(400):
            s = rng.randrange(-50, 300)
            rows.append((rng.choice(["a", "b", "c", None]), s, s + rng.choice([0, 1, 2, 3, 5, 30, -4])))
        rows += [("a", None, 5), ("a", 5, None)] + rows[:50]
        assert run(spark, rows, block) == brute(rows)


def test_hot_entity_over_many_blocks(spark):
    rows = [("hot", i * 3, i * 3 + (2 if i % 7 else 4)) for i in range(2000)] + [("long", 0, 100_000)] + [("long", i * 10, i * 10 + 1) for i in range(500)]
    assert run(spark, rows, 64) == brute(rows)


def test_empty_and_clashing_names(spark):
    assert run(spark, [], 8) == set()
    df = spark.createDataFrame([("x", 1, 3, "q", 9), ("x", 3, 4, "r", 9), ("x", 8, 9, "r", 9)], "kind string, `_s` long, `_t` long, seg_start string, `_b` long")
    got = {tuple(r) for r in periods(df, ["kind"], "_s", "_t").toDF("e", "k", "s", "t").collect()}
    assert got == {("x", "covered", 1, 4), ("x", "gap", 4, 8), ("x", "covered", 8, 9)}


def test_homology_free_ranges(spark):
    schema = "rec_id long, features array<struct<type string, start long, end long, qualifiers map<string, array<string>>>>"
    ok = {"label": ["homology_free"]}
    rows = [
        (1, [("misc_feature", 1, 5, ok), ("misc_feature", 5, 5, ok), ("misc_feature", 9, 7, ok), ("misc_feature", None, 7, ok)]),
        (2, [("Misc_Feature", 1, 5, ok), ("misc_feature", 1, 5, {"label": ["homology_free", "x"]}), ("misc_feature", 1, 5, None), ("misc_feature", 1, 5, {})]),
        (3, None),
        (4, []),
    ]
    assert [tuple(r) for r in homology_free_ranges(spark.createDataFrame(rows, schema)).collect()] == [(1, 1, 5)]


def test_blocks_follow_the_data_whatever_the_unit(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROWS", 40)
    rng = random.Random(9)
    for unit in (1, 10**9):
        rows = [("hot", rng.randrange(3000) * unit) for _ in range(900)] + [(f"e{i % 7}", rng.randrange(3000) * unit) for i in range(60)]
        rows = [(e, s, s + rng.randrange(1, 9) * unit) for e, s in rows]
        df = spark.createDataFrame(rows, "e string, s long, t long")
        got = sorted(tuple(r) for r in intervals.periods(df, ["e"], "s", "t").collect())
        assert got == sorted(tuple(r) for r in intervals.periods(df, ["e"], "s", "t", block=10**15).collect())
        assert len(got) > 200
    assert intervals.periods(df.limit(0), ["e"], "s", "t").collect() == []
