"""The overlap graph of each job: edges, components, gaps, repair and the cheapest tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.overlaps import JOB, clean_regions


def overlap_edges(nodes: DataFrame, work: DataFrame) -> DataFrame:
    """Edges u -> v of each job with v after u in order and a fragment from u's start to v's end of allowed size.

    A range join on bins of max_size letters: an end lies in its start's bin
    or in one of the two after it.
    """
    sized = nodes.join(work.select(*JOB, "min_size", "max_size"), JOB)
    u = sized.select(*JOB, "min_size", "max_size", F.col("start").alias("u_start"), F.col("end").alias("u_end"), F.col("ord").alias("u_ord"))
    low, high = F.col("u_start") + F.col("min_size"), F.col("u_start") + F.col("max_size")
    u = u.withColumn("bin", F.explode(F.sequence(F.floor(low / F.col("max_size")), F.floor(high / F.col("max_size")))))
    v = sized.select(*JOB, F.floor(F.col("end") / F.col("max_size")).alias("bin"), F.col("start").alias("v_start"), F.col("end").alias("v_end"), F.col("ord").alias("v_ord"))
    pairs = u.join(v, [*JOB, "bin"]).where("v_ord > u_ord and v_end - u_start between min_size and max_size")
    return pairs.select(*JOB, "u_start", "u_end", "v_start", "v_end", F.lit(1).cast("long").alias("weight"), F.lit("all").alias("constraints"))


def components(nodes: DataFrame, work: DataFrame) -> DataFrame:
    """(rec_id, config_id, ord, component): weakly connected components by smallest order of a member.

    Nodes without an edge are left out, but for the sentinels. A job's nodes
    are gathered into one row; they are bounded by its record.
    """
    rows = _by_job(nodes).join(work.select(*JOB, "min_size", "max_size"), JOB).mapInArrow(_component_batches, "rec_id long, config_id int, parts array<struct<ord: int, component: int>>")
    return rows.select(*JOB, F.inline("parts"))


def _by_job(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*JOB).agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("nodes"))


def _component_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.struct([("ord", pa.int32()), ("component", pa.int32())])
    schema = pa.schema([("rec_id", pa.int64()), ("config_id", pa.int32()), ("parts", pa.list_(part))])
    for batch in batches:
        rows = []
        for job in batch.to_pylist():
            g = _first_graph([(n["start"], n["end"]) for n in job["nodes"]], job)
            least = {}
            for group in g.parts():
                least |= dict.fromkeys(g.order[group].tolist(), int(g.order[group].min()))
            rows.append((job["rec_id"], job["config_id"], [{"ord": o, "component": c} for o, c in sorted(least.items())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)


def component_gaps(parts: DataFrame, nodes: DataFrame, work: DataFrame, lengths: DataFrame) -> DataFrame:
    """(rec_id, config_id, gap_no, gap_start, gap_end): between consecutive components, widened by min_size on both sides.

    The gap opens at the start of the component's node that ends last and
    closes at the end of the next component's node that starts first; ties go
    to the earlier node in order. Components are taken by smallest start.
    """
    rows = nodes.join(parts, [*JOB, "ord"]).groupBy(*JOB, "component").agg(
        F.max(F.struct("end", (-F.col("ord")).alias("o"), "start")).alias("last"), F.min(F.struct("start", "ord", "end")).alias("first")
    )
    order = Window.partitionBy(*JOB).orderBy("first.start", "first.ord")
    rows = rows.withColumn("next", F.lead("first").over(order)).withColumn("gap_no", F.row_number().over(order)).where("next is not null")
    rows = rows.join(work.select(*JOB, "min_size"), JOB).join(lengths, "rec_id")
    low = F.greatest(F.col("last.start") - F.col("min_size"), F.lit(0))
    high = F.least(F.col("next.end") + F.col("min_size"), F.col("L"))
    return rows.select(*JOB, "gap_no", low.alias("gap_start"), high.alias("gap_end"))


def gap_regions(gaps: DataFrame, regions: DataFrame) -> DataFrame:
    """Each gap with the parts of its record's regions inside it."""
    rows = gaps.join(clean_regions(regions), "rec_id").where("start < gap_end and end > gap_start")
    return rows.select(*JOB, "gap_no", F.greatest("start", "gap_start").alias("clip_start"), F.least("end", "gap_end").alias("clip_end"))


# --- one job's graph, inside a task ---------------------------------------


WEIGHTS = np.array([1, 10, 100, 0])  # by round; the last is for no edge
CONSTRAINTS = ("all", "homology", "none")
_NONE, _FAR, _STEP = 3, 2**61, 2**31  # a cost is the weights times _STEP plus the fragments


class _Graph:
    """Nodes by start, each with the stretch of nodes that can stand before it.

    What can come before a node starts between its end less max_size and its
    end less min_size, a stretch of neighbours in this order; so edges are
    never listed. ``order`` is a candidate's place (extra nodes come after
    all), ``round`` the last repair that named the node (0: none).
    """

    def __init__(self, start: np.ndarray, end: np.ndarray, order: np.ndarray, rounds: np.ndarray, candidates: int, low: int, high: int):
        by = np.lexsort((order, start))
        self.start, self.end, self.order, self.round = start[by], end[by], order[by], rounds[by]
        self.candidates, self.repaired = candidates, bool(rounds.any())
        self.in_order = not self.repaired and bool((self.order[1:] > self.order[:-1]).all())
        own = np.arange(len(by))
        self.first = np.searchsorted(self.start, self.end - high, side="left").tolist()
        self.last = np.minimum(np.searchsorted(self.start, self.end - low, side="right"), own).tolist()
        self._prepare()
        if self.in_order:
            self._solve_plain()
        else:
            self._solve()

    def _prepare(self) -> None:
        n = len(self.start)
        self.label, self.active = np.arange(n), self.order >= self.candidates
        self.came = np.where(self.order >= self.candidates, 2**62 + self.order, self.order << 31)
        self.cost, self.before, self.kind = np.full(n, _FAR), np.full(n, -1), np.full(n, _NONE)
        ends = (self.order == 0) | (self.order == self.candidates - 1)
        self.active |= ends
        self.came[ends] = np.where(self.order[ends] == 0, -2, -1)
        self.cost[self.order == 0] = 0

    def _solve_plain(self) -> None:
        """``_solve`` for the first graph of candidates that begin in order: all that can stand before a node does, at weight 1.

        A node joins a stretch of neighbours, so components are kept by
        joining neighbours once each, and costs by the least of a stretch.
        """
        n, order = len(self.start), self.order.tolist()
        cost, before, came = self.cost.tolist(), self.before.tolist(), self.came.tolist()
        root, right, marks = list(range(n)), list(range(n)), [0] * (n + 1)

        def find(links: list[int], i: int) -> int:
            top = i
            while links[top] != top:
                top = links[top]
            while links[i] != top:
                links[i], i = top, links[i]
            return top

        for v, (lo, hi) in enumerate(zip(self.first, self.last)):
            if hi <= lo:
                continue
            marks[lo] += 1
            marks[hi] -= 1
            marks[v] += 1
            marks[v + 1] -= 1
            if came[v] >= 0:
                came[v] = (order[lo] << 31) + order[v] + 1
            at = find(right, lo)  # the last of the neighbours that lo is joined with in a row
            own = find(root, lo)
            while at < hi - 1:
                other = find(root, at + 1)
                own, other = min(own, other), max(own, other)
                root[other] = own
                right[at] = at + 1
                at = find(right, at + 1)
            mine = find(root, v)
            root[max(own, mine)] = min(own, mine)
            least = min(cost[lo:hi])
            if least + _STEP + 1 < cost[v] and least < _FAR:
                cost[v], before[v] = least + _STEP + 1, cost.index(least, lo, hi)
        self.label = np.array([find(root, i) for i in range(n)], dtype=np.int64)
        self.active |= np.cumsum(marks[:n]) > 0
        self.cost, self.before, self.came = (np.array(x, dtype=np.int64) for x in (cost, before, came))
        self.kind[self.before >= 0] = 0

    def _solve(self) -> None:
        """In one pass: labels of components, when each node came in, and the cheapest way to it.

        The kind of an edge is the round that made it: 0 for the first
        graph's, which joins candidates in their order; a repair joins what it
        names with everything strictly before or after it, anew if an edge was
        there; ``_NONE`` where there is no edge.
        """
        start, end, order, rounds, extra = self.start, self.end, self.order, self.round, self.order >= self.candidates
        label, active, dearer = self.label, self.active, np.append(WEIGHTS[:_NONE] * _STEP + 1, _FAR)
        for v, (lo, hi) in enumerate(zip(self.first, self.last)):
            if hi <= lo:
                continue
            u = slice(lo, hi)
            named, own = rounds[u], rounds[v]
            anew = end[u] < start[v]
            if own:
                named = np.maximum(named, own)
            elif self.repaired:
                anew &= named > 0
            if not self.repaired:
                kinds = np.where(order[u] < order[v], 0, _NONE)
            elif extra[v]:
                kinds = np.where(anew, named, _NONE)
            else:
                kinds = np.where(anew, named, np.where((order[u] < order[v]) & ~extra[u], 0, _NONE))
            joined = kinds < _NONE
            labels = label[u][joined]
            if not len(labels):
                continue
            active[v] = True
            active[u] |= joined
            if self.came[v] >= 0 and not extra[v]:
                self.came[v] = (order[u][joined].min() << 31) + order[v] + 1
            least = labels[0]
            if label[least] != least or (labels != least).any():
                labels = self._roots(labels)
                least = labels.min()
                label[labels] = least
            label[v] = least
            cost = self.cost[u] + dearer[kinds]
            i = int(cost.argmin())  # the first of the cheapest
            if cost[i] < self.cost[v] and cost[i] < _FAR:
                self.cost[v], self.before[v], self.kind[v] = cost[i], lo + i, kinds[i]
        self.label = self._roots(np.arange(len(start)))

    def _roots(self, nodes: np.ndarray) -> np.ndarray:
        """The label that each node's label leads to."""
        labels = self.label[nodes]
        while ((further := self.label[labels]) != labels).any():
            labels = further
        return labels

    def parts(self) -> list[np.ndarray]:
        """Nodes of each component, components in order of the node that came in first."""
        nodes = np.flatnonzero(self.active)
        groups = [nodes[self.label[nodes] == x] for x in np.unique(self.label[nodes])]
        return sorted(groups, key=lambda g: self.came[g].min())

    def last_ending(self, part: np.ndarray) -> int:
        return int(part[np.lexsort((self.start[part], -self.end[part]))[0]])

    def repair(self, extras: list[tuple[int, int]], number: int, low: int, high: int) -> _Graph:
        """The graph with the extra nodes joined; candidates without an edge are no longer part of it."""
        keep = np.flatnonzero(self.active)
        start, end, order, rounds = (list(x[keep].tolist()) for x in (self.start, self.end, self.order, self.round))
        at = {p: i for i, p in reversed(list(enumerate(zip(start, end))))}
        following = max(self.candidates - 1, max(order)) + 1
        for p in extras:
            if p in at:
                rounds[at[p]] = number
                continue
            at[p] = len(start)
            start.append(p[0]), end.append(p[1]), order.append(following), rounds.append(number)
            following += 1
        arrays = (np.array(x, dtype=np.int64) for x in (start, end, order, rounds))
        return _Graph(*arrays, self.candidates, low, high)

    def path(self) -> list[tuple[int, int, int, int, str, int]] | None:
        """Steps (start and end of both nodes, constraints, weight) of the cheapest way from one sentinel to the other."""
        goal = int(np.flatnonzero(self.order == self.candidates - 1)[0])
        if self.cost[goal] >= _FAR:
            return None
        out = []
        while self.before[goal] >= 0:
            u, kind = int(self.before[goal]), int(self.kind[goal])
            out.append((int(self.start[u]), int(self.end[u]), int(self.start[goal]), int(self.end[goal]), CONSTRAINTS[kind], int(WEIGHTS[kind])))
            goal = u
        return out[::-1]


def _homology_extras(graph: _Graph, regions, job, length: int) -> list[tuple[int, int]]:
    parts = sorted(graph.parts(), key=lambda p: int(p[0]))
    out = []
    for a, b in zip(parts, parts[1:]):
        low = max(int(graph.start[graph.last_ending(a)]) - job["min_size"], 0)
        high = min(int(graph.end[b[0]]) + job["min_size"], length)
        for s, e in regions:
            if s < high and e > low:
                out += [(p, p + job["min_overlap"]) for p in range(max(low, s), min(e, high) - job["min_overlap"] + 1, job["min_step"])]
    return out


def _free_extras(graph: _Graph, job, length: int) -> list[tuple[int, int]]:
    out, step, parts = [], (job["max_size"] - job["min_overlap"]) // 5, graph.parts()
    for a, b in zip(parts, parts[1:]):
        low, high = int(graph.start[graph.last_ending(a)]), int(graph.end[b[0]])
        if high - low < job["min_size"]:
            low, high = max(low - job["min_size"], 0), min(high + job["min_size"], length)
        out += [(p, p + job["min_overlap"]) for p in range(low, high - job["min_overlap"] + 1, step)]
    return out


def _first_graph(places: list[tuple[int, int]], job: dict) -> _Graph:
    both, n = np.array(places, dtype=np.int64), len(places)
    return _Graph(both[:, 0], both[:, 1], np.arange(n), np.zeros(n, dtype=np.int64), n, job["min_size"], job["max_size"])


def without_graph(length: int, reach: int, low: int, high: int) -> tuple[str, int, list] | None:
    """What can be said of a job from its length and the furthest end of a candidate."""
    if length == 0:
        return "ok", 1, []
    if reach < low:  # too short for any fragment, repaired or not
        return "infeasible", 2, []
    if low <= length and reach <= high:  # one fragment; whatever has an edge has one from the start or to what has
        return "ok", 1, [(0, 0, length, length, CONSTRAINTS[0], int(WEIGHTS[0]))]
    return None


def tile(places: list[tuple[int, int]], regions: list[tuple[int, int]], job: dict) -> tuple[str, int, list[tuple[int, int, int, int, str, int]]]:
    """(status, components before repair, steps of the cheapest path) of one job.

    A graph in several components is repaired: with a motif, by overlaps
    without the motif inside the regions around the gaps (weight 10,
    'homology'); if it still falls apart, by overlaps anywhere in the gaps
    (weight 100, 'none'). status: 'ok', 'repaired' or 'infeasible'. A record
    without letters is covered by nothing at no cost.
    """
    length, sizes = places[-1][1], (job["min_size"], job["max_size"])
    if plain := without_graph(length, max(e for _, e in places), *sizes):
        return plain
    graph = _first_graph(places, job)
    before = count = len(graph.parts())
    if count > 1:
        if job["motif"]:
            graph = graph.repair(_homology_extras(graph, regions, job, length), 1, *sizes)
            count = len(graph.parts())
        if count > 1:
            if job["max_size"] - job["min_overlap"] < 5:  # the free overlaps would not advance
                return "infeasible", before, []
            graph = graph.repair(_free_extras(graph, job, length), 2, *sizes)
    path = graph.path()
    return ("infeasible" if path is None else "ok" if before == 1 else "repaired"), before, path or []


TILING = (
    "rec_id long, config_id int, status string, components int, cost long, "
    "steps array<struct<frag_start: long, frag_end: long, overlap_start: long, overlap_end: long, constraints: string>>"
)


def tilings(nodes: DataFrame, regions: DataFrame, work: DataFrame) -> DataFrame:
    """The cheapest tiling of every job, with its repair where the overlap graph falls apart.

    Result: ``status`` ('ok', 'repaired', 'infeasible'), ``components`` of the
    graph before repair, ``cost`` (sum of weights, null if infeasible) and
    ``steps``: the fragments in order. Among equally cheap tilings the one with
    the fewest fragments holds, then the first in order.

    A job's nodes and regions are gathered into one row; they are bounded by
    its record.
    """
    by_record = clean_regions(regions).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("regions"))
    rows = _by_job(nodes).withColumn("length", F.element_at("nodes", -1)["end"]).withColumn("reach", F.array_max(F.col("nodes")["end"]))
    rows = rows.join(work, JOB).join(by_record, "rec_id", "left")
    # jobs that need no graph send none to Python
    needed = (F.col("reach") >= F.col("min_size")) & ((F.col("length") < F.col("min_size")) | (F.col("reach") > F.col("max_size"))) & (F.col("length") > 0)
    rows = rows.withColumn("nodes", F.when(needed, F.col("nodes"))).withColumn("regions", F.when(needed & F.col("motif").isNotNull(), F.col("regions")))
    return rows.mapInArrow(_tile_batches, TILING)


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = pa.struct([("frag_start", pa.int64()), ("frag_end", pa.int64()), ("overlap_start", pa.int64()), ("overlap_end", pa.int64()), ("constraints", pa.string())])
    schema = pa.schema([("rec_id", pa.int64()), ("config_id", pa.int32()), ("status", pa.string()), ("components", pa.int32()), ("cost", pa.int64()), ("steps", pa.list_(step))])
    for batch in batches:
        rows = []
        for job in batch.to_pylist():
            if job["nodes"] is None:
                status, parts, path = without_graph(job["length"], job["reach"], job["min_size"], job["max_size"])
            else:
                places = [(n["start"], n["end"]) for n in job["nodes"]]
                status, parts, path = tile(places, [(r["start"], r["end"]) for r in job["regions"] or []], job)
            steps = [dict(frag_start=a, frag_end=e, overlap_start=s, overlap_end=e, constraints=c) for a, _, s, e, c, _ in path]
            rows.append((job["rec_id"], job["config_id"], status, parts, None if status == "infeasible" else sum(x[-1] for x in path), steps))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)
