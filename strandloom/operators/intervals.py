"""Continuous periods and gaps of overlapping intervals per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 50_000  # rows of one entity sorted together


def periods(df: DataFrame, entity: list[str], start: str, end: str, block: int | None = None) -> DataFrame:
    """Merge the intervals of each entity into maximal continuous periods and list the gaps.

    Result: the entity columns, ``kind`` ('covered' or 'gap'), ``seg_start``,
    ``seg_end``. Intervals are half-open; intervals that overlap, nest or
    touch are one period; a gap lies between consecutive periods.

    Rows with null start or end, and empty or reversed ones, take part in
    nothing. A null entity value is an entity of its own. Repeated rows and
    ties change nothing. Other columns are ignored, whatever their names. An
    empty input gives an empty result.

    Entities are cut into blocks of ``block`` units by interval start, so a
    single entity with most of the rows is sorted by many tasks. By default
    the width is taken from the data, whatever their unit: one pass finds the
    range of starts and the rows of the largest entity, and the range is cut
    into as many blocks as this entity fills with ``ROWS`` rows each. Within a
    block each start is compared with the running maximum of the earlier ends,
    and one row per block carries that maximum, and the start of the period
    still open, into the later blocks.
    """
    ids = [f"_e{i}" for i in range(len(entity))]
    rows = df.select(
        *(F.col(f"`{c}`").alias(i) for c, i in zip(entity, ids)),
        F.col(f"`{start}`").cast("long").alias("_s"),
        F.col(f"`{end}`").cast("long").alias("_t"),
    ).where("_t > _s")
    if block is None:
        most, low, high = rows.groupBy(*ids).agg(F.count("*").alias("n"), F.min("_s").alias("a"), F.max("_s").alias("b")).agg(F.max("n"), F.min("a"), F.max("b")).first()
        block = min((high - low) // -(-most // ROWS) + 1, 2**62) if most else 1
    # intervals of the same start: only the longest matters (combined before the shuffle)
    rows = rows.withColumn("_b", F.floor(F.col("_s") / block)).groupBy(*ids, "_b", "_s").agg(F.max("_t").alias("_t"))

    in_block = Window.partitionBy(*ids, "_b").orderBy("_s")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_reach", F.max("_t").over(before))
    # islands of the block alone; they are far fewer than the rows
    rows = rows.withColumn("_island", F.max(F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach")), F.col("_s"))).over(upto))
    islands = rows.groupBy(*ids, "_b", "_island").agg(F.max("_t").alias("_t"))

    # per block: where its cover ends; carried into the later blocks of the entity
    blocks = islands.groupBy(*ids, "_b").agg(F.max("_t").alias("_bt"))
    earlier = Window.partitionBy(*ids).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carry", F.max("_bt").over(earlier)).select(*(F.col(i).alias(f"{i}_") for i in ids), F.col("_b").alias("_b_"), "_carry")
    same = F.lit(True)
    for i in ids:
        same = same & F.col(i).eqNullSafe(F.col(f"{i}_"))
    islands = islands.join(blocks, same & (F.col("_b") == F.col("_b_"))).select(*ids, "_b", "_island", "_t", "_carry")

    # an island of a block opens a period if no earlier block reaches it
    by_island = Window.partitionBy(*ids, "_b").orderBy("_island")
    islands = islands.withColumn("_open", F.when(F.col("_carry").isNull() | (F.col("_island") > F.col("_carry")), F.col("_island")))
    islands = islands.withColumn("_first", F.max("_open").over(by_island.rowsBetween(Window.unboundedPreceding, 0)))
    parts = islands.groupBy(*ids, "_b", "_first").agg(F.max("_t").alias("_t"))
    # at most one part per block has no opening of its own: it goes on with the last one opened before
    heads = parts.groupBy(*ids, "_b").agg(
        F.max("_first").alias("_last"),
        F.min("_first").alias("_head"),
        F.max(F.when(F.col("_first").isNull(), F.col("_t"))).alias("_tail"),
    )
    over_blocks = Window.partitionBy(*ids).orderBy("_b")
    heads = heads.withColumn("_from", F.last("_last", ignorenulls=True).over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)))
    heads = heads.withColumn("_next", F.first("_head", ignorenulls=True).over(over_blocks.rowsBetween(1, Window.unboundedFollowing)))
    tails = heads.where("_tail is not null").groupBy(*ids, "_from").agg(F.max("_tail").alias("_tail"))

    own = parts.where("_first is not null")
    next_block = heads.select(*(F.col(i).alias(f"{i}_") for i in ids), F.col("_b").alias("_b_"), "_next")
    own = own.join(next_block, same & (F.col("_b") == F.col("_b_"))).select(*ids, "_b", "_first", "_t", "_next")
    in_order = Window.partitionBy(*ids, "_b").orderBy("_first")
    own = own.withColumn("_next", F.coalesce(F.lead("_first").over(in_order), "_next"))
    tails = tails.select(*(F.col(i).alias(f"{i}_") for i in ids), F.col("_from").alias("_from_"), "_tail")
    own = own.join(tails, same & (F.col("_first") == F.col("_from_")), "left")
    own = own.withColumn("_t", F.greatest("_t", "_tail"))
    found = own.select(
        *ids,
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.lit("covered").alias("kind"), F.col("_first").alias("s"), F.col("_t").alias("t")),
                    F.when(F.col("_next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("_t").alias("s"), F.col("_next").alias("t"))),
                )
            )
        ).alias("_x"),
    )
    return found.select(*(F.col(i).alias(c) for c, i in zip(entity, ids)), F.col("_x.kind").alias("kind"), F.col("_x.s").alias("seg_start"), F.col("_x.t").alias("seg_end"))


def homology_free_ranges(sequences: DataFrame) -> DataFrame:
    """(rec_id, start, end) of the entries marked homology-free, as they stand.

    An entry counts if its type is exactly 'misc_feature', its qualifier
    ``label`` exactly the list ['homology_free'] and its range not null and
    not empty. A null list or null qualifiers have none.
    """
    wanted = F.filter(
        "features",
        lambda f: (f["type"] == "misc_feature")
        & F.coalesce(F.try_element_at(f["qualifiers"], F.lit("label")) == F.array(F.lit("homology_free")), F.lit(False))
        & (f["end"] > f["start"]),
    )
    return sequences.select("rec_id", F.explode(F.transform(wanted, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end")))).alias("f")).select("rec_id", "f.start", "f.end")
