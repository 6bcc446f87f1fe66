import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import graph, overlaps
from strandloom.operators.graph import tile
from strandloom.operators.overlaps import CONFIG_SCHEMA, FragmentConfig

G = "GAATTC"


def case(seq, regions, *sizes, step=10, motif=None):
    return seq, regions, FragmentConfig(*sizes, motif, step)


class Cases:
    """Several jobs at once: record i under configuration i."""

    def __init__(self, spark, *cases):
        self.n = len(cases)
        rows = range(self.n)
        config = spark.createDataFrame([c.row(i) for i, (_, _, c) in enumerate(cases)], CONFIG_SCHEMA)
        self.work = overlaps.jobs(spark.createDataFrame([(i, i) for i in rows], "rec_id long, config_id int"), config)
        spans = [(i, a, len(seq) if b is None else b) for i, (seq, regions, _) in enumerate(cases) for a, b in regions]
        self.regions = spark.createDataFrame(spans, "rec_id long, start long, end long")
        self.texts = spark.createDataFrame([(i, seq) for i, (seq, _, _) in enumerate(cases)], "rec_id long, text string")

    def _by_case(self, df):
        out = [[] for _ in range(self.n)]
        for r in df.collect():
            out[r["rec_id"]].append((r["start"], r["end"]))
        return [sorted(x) for x in out]

    def free(self):
        return self._by_case(overlaps.free_overlaps(self.work, self.regions))

    def motif(self):
        return self._by_case(overlaps.motif_overlaps(overlaps.motif_hits(self.work, self.regions, self.texts)))

    def nodes(self):
        return overlaps.candidates(self.work, self.regions, self.texts)

    def tile(self):
        rows = graph.tilings(self.nodes(), self.regions, self.work).collect()
        return [(r["status"], r["cost"], [tuple(s) for s in r["steps"]]) for r in sorted(rows, key=lambda r: r["rec_id"])]


def test_free_overlaps(spark):
    cases = [
        case("A" * 200, [(50, 100)], 100, 500, 20, 50), case("A" * 300, [(50, 80), (150, 180)], 100, 500, 21, 50),
        case("A" * 200, [(50, 65)], 100, 500, 20, 50), case("A" * 200, [(50, 75)], 100, 500, 20, 50),
    ]
    assert Cases(spark, *cases).free() == [[(50, 70), (60, 80), (70, 90), (80, 100)], [(50, 71), (150, 171)], [], [(50, 70)]]


def test_motif_overlaps(spark):
    whole, sizes = [(0, None)], (100, 500, 20, 40)
    seqs = ["ATGC" + G + "ATGC" * 5 + G + "ATGC" * 5 + G + "ATGC", "ATGC" * 4, "ATGC" + G + "ATGC" + G + "ATGC", "ATGC" + G + "A" * 60 + G + "ATGC"]
    cases = [case(s, whole, *sizes, motif=G.lower()) for s in seqs]
    cases.append(case(G + "A" * 20 + G + "T" * 20 + G + "A" * 20 + G, [(0, 40), (50, None)], *sizes, motif=G))
    cases.append(case(G + "A" * 8 + G + "A" * 7 + G + "A" * 28 + G + "A" * 29 + G, whole, *sizes, motif=G))
    got = Cases(spark, *cases).motif()
    assert len(got[0]) == 2 and got[1:4] == [[], [], []] and got[4] == [(0, 32), (52, 84)]
    assert {(0, 20), (27, 67)} <= set(got[5]) and all(20 <= b - a <= 40 for a, b in got[5])


def test_hits_do_not_overlap(spark):
    c = Cases(spark, case("AAAAAAA.", [(0, 8)], 100, 500, 1, 9, motif="aaa"))
    assert sorted(r["pos"] for r in overlaps.motif_hits(c.work, c.regions, c.texts).collect()) == [0, 3]


def test_candidates_stand_between_sentinels(spark):
    seq = "ATGC" + G + "ATGC" * 8 + G + "ATGC"
    c = Cases(spark, case("A" * 200, [(50, 100), (50, 100), (60, 100)], 100, 500, 20, 50), case(seq, [(0, None)], 100, 500, 20, 50, motif=G))
    rows = sorted((r["rec_id"], r["ord"], r["start"], r["end"]) for r in c.nodes().collect())
    assert [r[2:] for r in rows if r[0] == 0] == [(0, 0), (50, 70), (60, 80), (70, 90), (80, 100), (200, 200)]
    assert [r[1] for r in rows if r[0] == 1] == [0, 1, 2]


def test_edges_and_components(spark):
    rng = random.Random(4)
    spans = [(50, 110), (99, 130), (159, 250), (200, 300)]
    c = Cases(spark, case("A" * 500, spans, 100, 300, 20, 50))
    nodes = c.nodes()
    edges = graph.overlap_edges(nodes, c.work)
    pairs = {((e["u_start"], e["u_end"]), (e["v_start"], e["v_end"])) for e in edges.collect()}
    assert ((0, 0), (80, 100)) in pairs and ((200, 220), (500, 500)) in pairs
    for _ in range(2):
        places = sorted({(s, s + rng.randrange(1, 40)) for s in (rng.randrange(2000) for _ in range(60))})
        places = [(0, 0), *places, (2000, 2000)]
        df = spark.createDataFrame([(0, 0, a, b, i) for i, (a, b) in enumerate(places)], "rec_id long, config_id int, start long, end long, ord int")
        work = c.work.withColumn("min_size", F.lit(90)).withColumn("max_size", F.lit(150))
        edges = graph.overlap_edges(df, work)
        want = {(i, j) for i in range(len(places)) for j in range(i + 1, len(places)) if 90 <= places[j][1] - places[i][0] <= 150}
        index = {p: i for i, p in enumerate(places)}
        assert {(index[e["u_start"], e["u_end"]], index[e["v_start"], e["v_end"]]) for e in edges.collect()} == want
        label = list(range(len(places)))
        for _ in places:
            for i, j in want:
                label[i] = label[j] = min(label[i], label[j])
        kept = {x for e in want for x in e} | {0, len(places) - 1}
        got = {r["ord"]: r["component"] for r in graph.components(df, work).collect()}
        assert got == {i: label[i] for i in kept}


def check_tiling(steps, length, low, high):
    assert steps[0][0] == 0 and steps[-1][1] == length
    for a, b in zip(steps, steps[1:]):
        assert b[0] == a[2] and a[1] == a[3]
    assert all(low <= s[1] - s[0] <= high for s in steps)


def test_paths(spark):
    motifs = "ATGC" + G + "ATGC" * 30 + G + "ATGC" * 30 + G + "ATGC"
    gapped = "A" * 100 + G + "A" * 20 + G + "A" * 400 + G + "A" * 20 + G + "A" * 100
    got = Cases(
        spark,
        case("A" * 500, [(50, 150), (250, 350)], 100, 300, 20, 50, step=30),
        case("A" * 1000, [(50, 100), (800, 850)], 100, 500, 20, 50),
        case("A" * 300, [], 100, 250, 20, 50),
        case("A" * 150, [(30, 120)], 100, 200, 20, 50),
        case("A" * 80, [(10, 60)], 100, 200, 20, 50),
        case(motifs, [(0, None)], 100, 300, 20, 50, step=20, motif=G),
        case(gapped, [(90, 150), (200, 400), (500, None)], 100, 250, 20, 50, step=20, motif=G),
        case(gapped, [(90, 150), (500, None)], 100, 250, 20, 50, step=20, motif=G),
    ).tile()
    assert got[0][:2] == ("ok", 2) and len(got[0][2]) == 2
    assert got[1][0] == "repaired" and len(got[1][2]) == 3 and [s[4] for s in got[1][2]].count("none") == 2
    check_tiling(got[1][2], 1000, 100, 500)
    assert got[2][0] == "repaired" and len(got[2][2]) == 2
    assert got[3] == ("ok", 1, [(0, 150, 150, 150, "all")])
    assert got[4][0] == "infeasible" and got[4][2] == []
    check_tiling(got[5][2], len(motifs), 100, 300)
    # a repair keeps to the regions where it can
    assert got[6][0] == got[7][0] == "repaired"
    assert {s[4] for s in got[6][2]} <= {"all", "homology"} and "none" in {s[4] for s in got[7][2]}
    for i in (6, 7):
        check_tiling(got[i][2], len(gapped), 100, 250)


def model(places, regions, job):
    """The same graph with all its nodes and edges in plain dicts: (components before repair, cost, has a path)."""
    length, low, high = places[-1][1], job["min_size"], job["max_size"]
    nodes, edges = {places[0]: 0, places[-1]: 0}, {}
    for i, u in enumerate(places):
        for v in places[i + 1 :]:
            if low <= v[1] - u[0] <= high:
                nodes.setdefault(u), nodes.setdefault(v)
                edges[u, v] = 1

    def parts():
        label = {n: i for i, n in enumerate(nodes)}
        for _ in nodes:
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        out = {}
        for n in nodes:
            out.setdefault(label[n], []).append(n)
        return list(out.values())

    def add(extras, weight):
        for v in extras:
            nodes.setdefault(v)
            for u in list(nodes):
                for a, b in ((u, v), (v, u)):
                    if a[1] < b[0] and low <= b[1] - a[0] <= high:
                        edges[a, b] = weight

    before = len(parts())
    if before > 1 and job["motif"]:
        extras = []
        comps = sorted(parts(), key=lambda p: min(p))
        for a, b in zip(comps, comps[1:]):
            lo = max(max(a, key=lambda n: (n[1], -n[0]))[0] - low, 0)
            hi = min(min(b)[1] + low, length)
            for s, e in regions:
                if s < hi and e > lo:
                    x = max(lo, s)
                    while x + job["min_overlap"] <= min(e, hi):
                        extras.append((x, x + job["min_overlap"]))
                        x += job["min_step"]
        add(extras, 10)
    comps = parts()
    if len(comps) > 1:
        extras = []
        for a, b in zip(comps, comps[1:]):
            lo, hi = max(a, key=lambda n: (n[1], -n[0]))[0], min(b)[1]
            if hi - lo < low:
                lo, hi = max(lo - low, 0), min(hi + low, length)
            while lo + job["min_overlap"] <= hi:
                extras.append((lo, lo + job["min_overlap"]))
                lo += (high - job["min_overlap"]) // 5
        add(extras, 100)
    cost = {(0, 0): 0}
    for _ in nodes:
        for (u, v), w in edges.items():
            if u in cost:
                cost[v] = min(cost.get(v, 10**9), cost[u] + w)
    return before, cost.get((length, length)), edges


def test_tilings_against_a_plain_model():
    rng = random.Random(9)
    seen = set()
    for _ in range(1500):
        length = rng.randrange(15, 160)
        late = 20 if rng.random() < 0.2 else -15
        places = sorted({(s, s + rng.randrange(5, 15)) for s in (rng.randrange(max(1, length + late)) for _ in range(rng.randrange(0, 11)))})
        places = [(0, 0), *places, (length, length)]
        job = {"min_size": 20, "max_size": rng.randrange(30, 60), "min_overlap": 8, "min_step": 5, "motif": rng.choice([None, "GC"])}
        regions = [(5, 30), (50, 90), (95, 120)]
        status, parts, path = tile(places, regions, job)
        before, cost, edges = model(places, regions, job)
        assert parts == before and (status == "infeasible") == (cost is None)
        seen.add((status, job["motif"]))
        if cost is not None:
            assert sum(x[-1] for x in path) == cost
            assert path[0][:2] == (0, 0) and path[-1][2:4] == (length, length)
            assert all(a[2:4] == b[:2] for a, b in zip(path, path[1:]))
            assert all(edges[x[:2], x[2:4]] == x[-1] for x in path)
    assert len(seen) == 6


def test_gaps(spark):
    c = Cases(spark, case("A" * 1000, [(50, 100), (800, 850)], 100, 200, 20, 50, step=30))
    nodes = c.nodes()
    gaps = graph.component_gaps(graph.components(nodes, c.work), nodes, c.work, spark.createDataFrame([(0, 1000)], "rec_id long, L long"))
    rows = graph.gap_regions(gaps, c.regions).collect()
    assert rows and all(r["clip_start"] < r["clip_end"] and (50 <= r["clip_start"] and r["clip_end"] <= 100 or 800 <= r["clip_start"] and r["clip_end"] <= 850) for r in rows)


def test_config_is_checked():
    for bad in ((500, 100, 20, 50), (100, 500, 50, 20), (100, 500, 20, 50, None, 0)):
        with pytest.raises(ValueError):
            FragmentConfig(*bad)


def test_jobs_skip_unusable_rows(spark):
    config = spark.createDataFrame([(1, 10, 50, 5, 9, "", 5), (2, 50, 10, 5, 9, None, 5), (3, 10, 50, 5, 9, "gc", 0), (4, None, 50, 5, 9, "gc", 1), (5, 10, 50, 5, 9, "gc", 1)], CONFIG_SCHEMA)
    requests = spark.createDataFrame([(1, c) for c in (1, 1, 2, 3, 4, 5, 9, None)] + [(None, 1)], "rec_id long, config_id int")
    assert sorted((r["rec_id"], r["config_id"], r["motif"]) for r in overlaps.jobs(requests, config).collect()) == [(1, 1, None), (1, 5, "GC")]


def test_a_small_spread_fails_only_where_free_overlaps_are_needed(spark):
    config = FragmentConfig(20, 40, 36, 40, None, 5)
    assert overlaps.jobs(spark.createDataFrame([(1, 0)], "rec_id long, config_id int"), spark.createDataFrame([config.row()], overlaps.CONFIG_SCHEMA)).count() == 1
    job = {"min_size": 20, "max_size": 40, "min_overlap": 36, "max_overlap": 40, "motif": None, "min_step": 5}
    assert graph.tile([(0, 0), (0, 36), (30, 30)], [], job)[0] == "ok"
    assert graph.tile([(0, 0), (500, 500)], [], job) == ("infeasible", 2, [])


def test_configurations_and_backgrounds_listed_twice(spark):
    config = spark.createDataFrame([(1, 5, 50, 1, 2, "GC", 1), (1, 4, 60, 1, 2, None, 1), (1, 9, 3, 1, 2, None, 1)], overlaps.CONFIG_SCHEMA)
    rows = overlaps.jobs(spark.createDataFrame([(7, 1), (7, 1), (None, 1)], "rec_id long, config_id int"), config).collect()
    assert [tuple(r) for r in rows] == [(7, 1, 4, 60, 1, 2, None, 1)]


def test_motifs_as_patterns(spark):
    work = spark.createDataFrame([(1, 0, 5, 500, 3, 12, "G[AT]C", 1)], "rec_id long, config_id int, min_size int, max_size int, min_overlap int, max_overlap int, motif string, min_step int")
    regions = spark.createDataFrame([(1, 2, 20)], "rec_id long, start long, end long")
    texts = spark.createDataFrame([(1, "GACAGTCAAGACAAGGCTTGACGTC")], "rec_id long, text string")
    hits = overlaps.motif_hits(work, regions, texts, patterns=True).collect()
    assert sorted((r["pos"], r["width"]) for r in hits) == [(4, 6), (9, 6)]
    assert overlaps.motif_hits(work, regions, texts).collect() == []
