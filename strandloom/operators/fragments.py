"""Fragments of a tiling, their records, and the features they leave on the source record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.overlaps import JOB
from strandloom.operators.regions import numbered


def fragments(tilings: DataFrame) -> DataFrame:
    """One row per fragment, numbered from 1 (``idx``) along the record."""
    rows = tilings.select(*JOB, "status", F.posexplode("steps").alias("n", "s"))
    return rows.select(*JOB, (F.col("n") + 1).alias("idx"), "s.frag_start", "s.frag_end", "s.overlap_start", "s.overlap_end", "s.constraints")


def fragment_records(frags: DataFrame, texts: DataFrame) -> DataFrame:
    """Fragments with their id, description and letters (``texts``: rec_id, seq_id, text)."""
    rows = frags.join(texts, "rec_id")
    part = F.expr("substring(text, cast(frag_start + 1 as int), cast(frag_end - frag_start as int))")
    title = F.format_string("Fragment %d: %d-%d, overlap: %d-%d, constraints: %s", "idx", "frag_start", "frag_end", "overlap_start", "overlap_end", "constraints")
    return rows.select(*frags.columns, F.format_string("%s_fragment_%d", "seq_id", "idx").alias("fragment_id"), title.alias("description"), part.alias("sequence"))


def _feature(kind: str, start, end, qualifiers):
    return F.struct(
        F.lit(kind).alias("type"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(1).alias("strand"),
        F.lit(False).alias("start_fuzzy"), F.lit(False).alias("end_fuzzy"), qualifiers.alias("qualifiers"),
    )


def _region_feature(r):
    return _feature("misc_feature", r["start"], r["end"], F.create_map(F.lit("note"), F.array(r["note"]), F.lit("label"), F.array(F.lit("homology_free"))))


def _fragment_feature(r):
    note = F.create_map(
        F.lit("note"), F.array(F.concat(F.lit("Fragment_"), r["idx"].cast("string"))),
        F.lit("overlap_region"), F.array(F.concat_ws("-", r["overlap_start"].cast("string"), r["overlap_end"].cast("string"))),
        F.lit("constraints"), F.array(r["constraints"]),
    )
    return _feature("fragment", r["frag_start"], r["frag_end"], note)


def _append(records: DataFrame, new: DataFrame, key: str) -> DataFrame:
    kind = records.schema["features"].dataType
    joined = records.join(new.withColumnRenamed(key, "_key").hint("merge"), F.col(key) == F.col("_key"), "left").drop("_key")
    added = F.coalesce(F.col("_new"), F.array()).cast(kind)
    return joined.withColumn("features", F.concat(F.coalesce("features", F.array().cast(kind)), added)).drop("_new")


def annotate_regions(records: DataFrame, regions: DataFrame, key: str = "rec_id") -> DataFrame:
    """Records with one misc_feature appended per homology-free region, in order; the features they had stay in front.

    The id gets the suffix ``_annotated`` and the topology is dropped, so the
    next stage reads the molecule as linear.
    """
    listed = F.sort_array(F.collect_list(F.struct("region_no", "start", "end", "note")))
    new = numbered(regions, key).groupBy(key).agg(listed.alias("_l")).select(key, F.transform("_l", _region_feature).alias("_new"))
    out = _append(records, new, key)
    return out.withColumns({
        "seq_id": F.concat("seq_id", F.lit("_annotated")), "description": F.lit("Sequence annotated with non-homologous regions"),
        "topology": F.lit(None).cast("string"), "molecule_type": F.lit("DNA"),
    })


def annotate_fragments(records: DataFrame, frags: DataFrame, key: str = "rec_id") -> DataFrame:
    """Records with one ``fragment`` feature appended per fragment; of a single configuration."""
    listed = F.sort_array(F.collect_list(F.struct("idx", "frag_start", "frag_end", "overlap_start", "overlap_end", "constraints")))
    new = frags.groupBy(key).agg(listed.alias("_l")).select(key, F.transform("_l", _fragment_feature).alias("_new"))
    return _append(records, new, key)
