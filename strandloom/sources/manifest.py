"""The list of known backgrounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "species string, assembly string, file_name string, kmer_size int, id string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True)


def first_of_each(manifest: DataFrame) -> DataFrame:
    """One row per id: of an id listed twice the first row in order of its values, nulls first. Rows without an id are left out."""
    fields = ["species", "assembly", "file_name", "kmer_size"]
    rows = manifest.where("id is not null").groupBy("id").agg(F.min(F.struct(*fields)).alias("m"))
    return rows.select(*(F.col(f"m.{f}").alias(f) for f in fields), "id")


def chosen(manifest: DataFrame, ids: str) -> DataFrame:
    """The manifest rows named in a comma-separated list; unknown ids are ignored, repeated rows count once."""
    wanted = manifest.sparkSession.createDataFrame([(i.strip(),) for i in ids.split(",") if i.strip()], "id string")
    return first_of_each(manifest.join(wanted.distinct(), "id", "left_semi"))


def kmer_size(selected: DataFrame, default: int = 15) -> int:
    """The k-mer size the chosen backgrounds share; mixing sizes is refused."""
    sizes = [r[0] for r in selected.where("kmer_size is not null").select("kmer_size").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("the chosen backgrounds have different k-mer sizes")
    return sizes[0] if sizes else default


def display(manifest: DataFrame) -> DataFrame:
    """What a front page lists: one line per background."""
    return first_of_each(manifest).select("id", F.concat_ws(" ", "species", "assembly").alias("label"), "kmer_size")


def available(manifest: DataFrame, index_path: str) -> DataFrame:
    """The manifest rows whose k-mer set is in the index store; the others are skipped without a word."""
    stored = manifest.sparkSession.read.schema("kmer long, background_id string, k int").parquet(index_path)
    return first_of_each(manifest.join(stored.select(F.col("background_id").alias("id")).distinct(), "id", "left_semi"))
