"""Candidate overlaps between fragments, inside homology-free regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

JOB = ["rec_id", "config_id"]


@dataclass(frozen=True)
class FragmentConfig:
    """Sizes of fragments and of their overlaps, in letters; checked when made."""

    min_size: int
    max_size: int
    min_overlap: int
    max_overlap: int
    motif: str | None = None
    min_step: int = 10

    def __post_init__(self) -> None:
        if self.min_size > self.max_size:
            raise ValueError("min_size must not be larger than max_size")
        if self.min_overlap > self.max_overlap:
            raise ValueError("min_overlap must not be larger than max_overlap")
        if self.min_overlap < 0 or self.min_step < 1:
            raise ValueError("min_overlap must not be negative and min_step must be positive")

    def row(self, config_id: int = 0) -> tuple:
        return (config_id, self.min_size, self.max_size, self.min_overlap, self.max_overlap, self.motif or None, self.min_step)


CONFIG_SCHEMA = "config_id int, min_size int, max_size int, min_overlap int, max_overlap int, motif string, min_step int"


def jobs(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Distinct (rec_id, config_id) with the configuration; requests for unknown ones are left out.

    A motif is upper-cased; an empty one is none. Configurations that cannot
    be used (null or non-positive sizes or steps, bounds in reverse) give no
    job. Of a configuration listed twice the first usable row in order of its
    values holds.
    """
    usable = config.where("min_size <= max_size and max_size >= 1 and min_overlap <= max_overlap and min_overlap >= 0 and min_step >= 1")
    usable = usable.withColumn("motif", F.nullif(F.upper("motif"), F.lit("")))
    fields = ["min_size", "max_size", "min_overlap", "max_overlap", "motif", "min_step"]
    usable = usable.groupBy("config_id").agg(F.min(F.struct(*fields)).alias("c"))
    pairs = requests.select(*JOB).where("rec_id is not null and config_id is not null").distinct()
    return pairs.join(usable, "config_id").select(*JOB, *(F.col(f"c.{f}").alias(f) for f in fields))


def clean_regions(regions: DataFrame) -> DataFrame:
    """(rec_id, start, end): distinct regions with both ends known and a positive length."""
    return regions.select("rec_id", "start", "end").where("rec_id is not null and start >= 0 and end > start").distinct()


def free_overlaps(work: DataFrame, regions: DataFrame) -> DataFrame:
    """(rec_id, config_id, start, end): min_overlap letters every min_step letters of each region, for jobs without a motif."""
    rows = work.where("motif is null").join(clean_regions(regions), "rec_id").where(F.col("end") - F.col("start") >= F.col("min_overlap"))
    starts = F.sequence("start", F.col("end") - F.col("min_overlap"), F.col("min_step").cast("long"))
    out = rows.select(*JOB, "min_overlap", F.explode(starts).alias("start"))
    return out.select(*JOB, "start", (F.col("start") + F.col("min_overlap")).alias("end")).distinct()


def motif_hits(work: DataFrame, regions: DataFrame, texts: DataFrame, patterns: bool = False) -> DataFrame:
    """Non-overlapping occurrences of each job's motif, from left to right within each region.

    ``texts``: (rec_id, text). The motif is taken literally: cutting the
    region at it leaves pieces, and their running length gives the places.
    With ``patterns`` it is a regular expression, searched in a task; its
    ``width`` is then the length of the expression, which stands for the motif
    when distances are measured.
    """
    # regions of a record in one row, so that its letters are moved once per record and not once per region
    by_record = clean_regions(regions).groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("regions"))
    rows = work.where("motif is not null").join(by_record, "rec_id").join(texts, "rec_id")
    rows = rows.select(*JOB, "motif", "min_overlap", "max_overlap", "text", F.posexplode("regions").alias("region_no", "r"))
    part = F.expr("substring(text, cast(r.start + 1 as int), cast(r.end - r.start as int))")
    if patterns:
        rows = rows.select(*JOB, "region_no", "min_overlap", "max_overlap", "motif", F.col("r.start").alias("first"), part.alias("part"))
        return rows.mapInArrow(_pattern_hits, "rec_id long, config_id int, region_no int, min_overlap int, max_overlap int, width int, pos long")
    pieces = F.split(part, F.concat(F.lit("\\Q"), "motif", F.lit("\\E")), -1)
    rows = rows.select(*JOB, "region_no", "min_overlap", "max_overlap", F.length("motif").alias("width"), F.col("r.start").alias("first"), F.transform(pieces, F.length).alias("sizes"))
    # the last piece has no motif behind it
    places = F.expr(
        "aggregate(slice(sizes, 1, size(sizes) - 1), struct(first as at, cast(array() as array<bigint>) as found), "
        "(a, n) -> struct(a.at + n + width as at, array_append(a.found, a.at + n) as found), a -> a.found)"
    )
    return rows.where(F.size("sizes") > 1).select(*JOB, "region_no", "min_overlap", "max_overlap", "width", F.explode(places).alias("pos"))


def _pattern_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, pos = [], []
        for i, (motif, first, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("motif", "first", "part")))):
            found = [first + m.start() for m in re.finditer(motif, part)]
            row += [i] * len(found)
            pos += found
        kept = batch.take(pa.array(row, pa.int64()))
        width = pa.array([len(m) for m in kept.column("motif").to_pylist()], pa.int32())
        names = ["rec_id", "config_id", "region_no", "min_overlap", "max_overlap"]
        yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), width, pa.array(pos, pa.int64())], names=[*names, "width", "pos"])


def motif_overlaps(hits: DataFrame) -> DataFrame:
    """(rec_id, config_id, start, end): each hit up to the end of the nearest hit of its region at an allowed distance.

    A range join on bins of max_overlap letters: a hit's partners lie in two
    bins at most.
    """
    low = F.col("pos") + F.col("min_overlap") - F.col("width")
    high = F.col("pos") + F.col("max_overlap") - F.col("width")
    width = F.greatest(F.col("max_overlap"), F.lit(1))
    left = hits.withColumn("low", low).withColumn("high", high).withColumn("bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    right = hits.select(*JOB, "region_no", F.floor(F.col("pos") / width).alias("bin"), F.col("pos").alias("partner"))
    pairs = left.join(right, [*JOB, "region_no", "bin"]).where("partner between low and high")
    found = pairs.groupBy(*JOB, "region_no", "pos").agg((F.min("partner") + F.first("width")).alias("end"))
    return found.select(*JOB, F.col("pos").alias("start"), "end").distinct()


def candidates(work: DataFrame, regions: DataFrame, texts: DataFrame) -> DataFrame:
    """All candidate overlaps of each job in order (``ord`` from 0), between the sentinels (0, 0) and (L, L).

    Candidates are sorted by start, then end. Jobs whose record has no
    sequence are left out.
    """
    lengths = work.join(texts.select("rec_id", F.length("text").cast("long").alias("L")), "rec_id").select(*JOB, "L")
    inner = free_overlaps(work, regions).unionByName(motif_overlaps(motif_hits(work, regions, texts)))
    inner = inner.join(lengths.select(*JOB), JOB, "left_semi")
    ends = lengths.select(*JOB, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("p")), F.struct(F.lit(2).alias("kind"), F.col("L").alias("p")))).alias("s"))
    rows = inner.select(*JOB, F.lit(1).alias("kind"), "start", "end").unionByName(ends.select(*JOB, F.col("s.kind").alias("kind"), F.col("s.p").alias("start"), F.col("s.p").alias("end")))
    order = Window.partitionBy(*JOB).orderBy("kind", "start", "end")
    return rows.select(*JOB, "start", "end", (F.row_number().over(order) - 1).alias("ord"))
