"""Records that keep arriving in a folder, annotated batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.regions import homology_free_regions


def annotate_arrivals(
    spark: SparkSession, folder: str, schema, index: DataFrame | None, output: str, checkpoint: str, k: int = 20, threshold: int = 60, most_files: int = 100, once: bool = False
) -> StreamingQuery:
    """Write the homology-free regions of every Parquet file of records that arrives in ``folder``.

    Each batch runs the batch plan and writes its own folder below ``output``,
    so a batch that is run again after a failure overwrites itself. ``once``
    ends when what is there now is done.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        homology_free_regions(batch, index, k, threshold).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
