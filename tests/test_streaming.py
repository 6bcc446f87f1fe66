from strandloom.operators import kmers
from strandloom.operators.regions import homology_free_regions
from strandloom.streaming.intake import annotate_arrivals


def test_arrivals_give_what_one_batch_gives(spark, tmp_path):
    rows = [(i, "ACGTTGCAAC" * i + "GATTACAGGC", None) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "rec_id long, seq string, topology string")
    index = kmers.background_set(spark.createDataFrame([(1, "ACGTTGCA")], "rec_id long, seq string"), 5)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df.where("rec_id < 5").write.parquet(folder)
    annotate_arrivals(spark, folder, df.schema, index, out, state, 5, 6, once=True).awaitTermination()
    df.where("rec_id >= 5").write.mode("append").parquet(folder)
    annotate_arrivals(spark, folder, df.schema, index, out, state, 5, 6, once=True).awaitTermination()
    got = sorted((r["rec_id"], r["start"], r["end"]) for r in spark.read.parquet(out).collect())
    assert got == sorted((r["rec_id"], r["start"], r["end"]) for r in homology_free_regions(df, index, 5, 6).collect())
    assert got
