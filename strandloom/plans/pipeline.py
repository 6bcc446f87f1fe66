"""The two stages end to end: annotate homology-free regions, and fragment records along them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import fragments as fr
from strandloom.operators import graph, kmers, overlaps
from strandloom.operators.intervals import homology_free_ranges
from strandloom.operators.overlaps import CONFIG_SCHEMA, FragmentConfig
from strandloom.operators.regions import homology_free_regions
from strandloom.sources import sequence_files as sf
from strandloom.sources import writers


def with_key(records: DataFrame) -> DataFrame:
    """Records with ``rec_id``, made of their file and place where they have none; ids of records may repeat, keys do not."""
    return records if "rec_id" in records.columns else records.withColumn("rec_id", F.xxhash64("source_path", "ord"))


def annotate_homology(queries: DataFrame, background: DataFrame | None, k: int = 20, threshold: int = 60) -> DataFrame:
    """Query records with their homology-free regions as features; ``background`` holds records."""
    queries = with_key(queries)
    known = kmers.background_set(with_key(background), k, fold=False) if background is not None else None
    return fr.annotate_regions(queries, homology_free_regions(queries, known, k, threshold, fold=False))


def annotate_with_index(queries: DataFrame, index: DataFrame, k: int, threshold: int = 60) -> DataFrame:
    """The same against a stored k-mer set."""
    queries = with_key(queries)
    return fr.annotate_regions(queries, homology_free_regions(queries, index, k, threshold, fold=False))


def file_process_homology(spark: SparkSession, query: str | list[str], background: str | list[str] | None, output: str, k: int = 20, threshold: int = 60) -> DataFrame:
    """Files to one file, in order of the given files; returns the annotated records. The output's suffix chooses GenBank or FASTA."""
    known = sf.read_sequences(spark, background) if background else None
    out = annotate_homology(sf.read_sequences(spark, query), known, k, threshold)
    writers.write_records(out, output, one_file=True)
    return out


def store_index(spark: SparkSession, records: DataFrame | str | list[str], index: str, background_id: str, k: int = 20) -> None:
    """Build the merged k-mer set of records, or of files, and add it to the index store."""
    if not isinstance(records, DataFrame):
        records = sf.read_sequences(spark, records)
    kmers.save_index(kmers.background_set(with_key(records), k, fold=False), index, background_id, k)


@dataclass
class Fragmented:
    tilings: DataFrame
    fragments: DataFrame  # with id, description and sequence
    records: DataFrame  # with fragment features


def fragment_records(records: DataFrame, config: FragmentConfig, regions: DataFrame | None = None) -> Fragmented:
    """Fragment all records along their homology-free features, or along given ``regions`` (rec_id, start, end).

    Regions are cut off at the end of the record, as the molecule is read as
    linear here.
    """
    spark, records = records.sparkSession, with_key(records)
    work = overlaps.jobs(records.select("rec_id", F.lit(0).alias("config_id")), spark.createDataFrame([config.row()], CONFIG_SCHEMA))
    texts = records.where("seq is not null").select("rec_id", "seq_id", F.upper("seq").alias("text"), "seq")
    found = homology_free_ranges(records) if regions is None else regions.select("rec_id", "start", "end")
    found = found.join(texts.select("rec_id", F.length("text").alias("_l")), "rec_id").select("rec_id", "start", F.least("end", "_l").cast("long").alias("end"))
    nodes = overlaps.candidates(work, found, texts)
    tilings = graph.tilings(nodes, found, work)
    frags = fr.fragments(tilings)
    out = fr.fragment_records(frags, texts.select("rec_id", "seq_id", F.col("seq").alias("text")))
    return Fragmented(tilings, out, fr.annotate_fragments(records, frags))


def fragment_from_file(spark: SparkSession, path: str, output_gb: str, output_fasta: str, config: FragmentConfig) -> Fragmented:
    """One annotated GenBank record to a GenBank file with its fragments and a FASTA file of them."""
    record = with_key(sf.read_one(spark, path))
    if homology_free_ranges(record).isEmpty():
        raise RuntimeError("no homology-free regions found in the input's annotation")
    out = fragment_records(record, config)
    writers.write_records(out.records, output_gb, one_file=True)
    writers.write_fragments(out.fragments, output_fasta, one_file=True)
    return out


def process_and_fragment(queries: DataFrame, background: DataFrame | None, config: FragmentConfig, k: int = 15, index: DataFrame | None = None) -> DataFrame:
    """Annotate and fragment every query in one go: one row per record with both texts in base64.

    The region threshold is ``min_overlap``; a stored k-mer set and background
    records are combined. A motif of other letters than A, C, G and T is refused. Result: rec_id, seq_id, status, regions, fragments,
    genbank, fasta.
    """
    if not re.fullmatch("[ACGTacgt]*", config.motif or ""):
        raise ValueError("only the letters A, T, C and G are allowed in a motif")
    queries = with_key(queries)
    sets = [s for s in (index, kmers.background_set(with_key(background), k, fold=False) if background is not None else None) if s is not None]
    regions = homology_free_regions(queries, kmers.merge_sets(sets) if sets else None, k, config.min_overlap, fold=False)
    done = fragment_records(fr.annotate_regions(queries, regions), config)
    text = writers.fasta_text(F.col("fragment_id"), F.col("description"), F.col("sequence"))
    fasta = done.fragments.select("rec_id", F.struct("idx", text.alias("t")).alias("x")).groupBy("rec_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("_fasta"), F.count("*").alias("fragments")
    )
    counts = regions.groupBy("rec_id").agg(F.count("*").alias("regions"))
    rows = done.records.join(done.tilings.select("rec_id", "status"), "rec_id", "left").join(fasta, "rec_id", "left").join(counts, "rec_id", "left")
    return rows.select(
        "rec_id", "seq_id", F.coalesce("status", F.lit("no sequence")).alias("status"), F.coalesce("regions", F.lit(0)).alias("regions"), F.coalesce("fragments", F.lit(0)).alias("fragments"),
        F.base64(F.encode(writers.genbank_text(done.records), "UTF-8")).alias("genbank"), F.base64(F.encode(F.coalesce("_fasta", F.lit("")), "UTF-8")).alias("fasta"),
    )


def as_json() -> Column:
    """A row of ``process_and_fragment`` as the answer a server would send."""
    message = F.when(F.col("status").isin("ok", "repaired"), "Processing complete!").otherwise(F.concat(F.lit("No fragments: "), "status"))
    return F.to_json(F.struct(
        F.when(F.col("status").isin("ok", "repaired"), "success").otherwise("error").alias("status"), F.col("genbank").alias("annotated_file"), F.lit("annotated_sequences.gb").alias("annotated_filename"),
        F.col("fasta").alias("fragments_file"), F.lit("fragments.fasta").alias("fragments_filename"), message.alias("message"),
    ))
