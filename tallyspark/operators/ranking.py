"""Places of rows without one task that sees them all: along chains of values, and in one global order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.lineage import checkpoint


def join_same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner", *also: Column) -> DataFrame:
    """left joined with right where the columns are the same, null like null, and ``also`` holds; the columns are left's."""
    own = right.withColumnsRenamed({c: f"_of_{c}" for c in columns})
    return left.join(own, [*(F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns), *also], how).drop(*(f"_of_{c}" for c in columns))


def chain_places(rows: DataFrame, group: list[str], node: str, start: str, before: str, after: str) -> DataFrame:
    """group, node, place of each row: the place along the chain of its group, or null if the rows are no single chain.

    A chain begins at the row whose ``before`` is the group's ``start``, and each row is followed by the
    one whose ``before`` is its ``after``. It must be clear (no ``before`` twice, none null) and take in
    every row. ``node`` tells a group's rows apart; values are numbers, and a chain's end is the start
    with all changes.

    Where a chain passes its end value before, the last row seems to lead back to a row that is already
    placed. So the row there begins a part of its own, and parts are put one after the other.

    Links are found by one equi-join; places by pointer doubling, in as many rounds as the logarithm
    of the largest group, each cut off by a checkpoint. Rows are shuffled by group and value, so a
    large group is spread over tasks.
    """
    known = rows.select(*group, F.col(node).alias("_node"), F.col(start).alias("_start"), F.col(before).alias("_before"), F.col(after).alias("_after"))
    sizes = known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_distinct("_before").alias("_values"), F.sum((F.col("_before") == F.col("_start")).cast("int")).alias("_starts"),
        (F.max("_start") + F.sum(F.col("_after") - F.col("_before"))).alias("_end"),
    )
    sizes = checkpoint(sizes)
    clear = sizes.where("_rows = _values AND _starts = 1")
    most = clear.agg(F.max("_rows")).first()[0] or 1
    own = join_same(known, clear.select(*group, "_end"), group)
    part = F.when(F.col("_before") == F.col("_start"), 1).when(F.col("_before") == F.col("_end"), 2)
    follow = own.where(part.isNull()).select(*group, F.col("_before").alias("_value"), F.col("_node").alias("_next"))
    linked = join_same(own, follow, group, "left", F.col("_after") == F.col("_value"))
    # _stop: the furthest row that is reached; with the next one gone it is the part's last.
    links = checkpoint(linked.select(*group, "_node", part.alias("_part"), "_end", "_next", F.col("_next").isNotNull().cast("long").alias("_left"), F.struct("_node", "_after").alias("_stop")))
    for _ in range(math.ceil(math.log2(most)) + 1 if most > 1 else 0):
        ahead = links.select(*group, F.col("_node").alias("_at"), F.col("_next").alias("_beyond"), F.col("_left").alias("_more"), F.col("_stop").alias("_further"))
        joined = join_same(links, ahead, group, "left", F.col("_next") == F.col("_at"))
        links = checkpoint(joined.select(*group, "_node", "_part", "_end", F.col("_beyond").alias("_next"), (F.col("_left") + F.coalesce("_more", F.lit(0))).alias("_left"), F.coalesce("_further", "_stop").alias("_stop")))
    # Parts that come to a stop must be as long as the group; a row that still has a next one is on a circle.
    heads = links.where("_part IS NOT NULL AND _next IS NULL").groupBy(*group).agg(
        *(F.max(F.when(F.col("_part") == n, F.col(c))).alias(f"{c}_{n}") for n in (1, 2) for c in ("_left", "_stop")), F.max("_end").alias("_end"), F.sum(F.col("_left") + 1).alias("_sum"),
    )
    one = F.col("_stop_2").isNull() | ((F.col("_stop_1._node") != F.col("_stop_2._node")) & (F.col("_stop_1._after") == F.col("_end")))
    whole = join_same(heads, clear.select(*group, "_rows"), group, "inner", F.col("_sum") == F.col("_rows")).where(F.col("_stop_1").isNotNull() & one)
    first = F.col("_stop._node") == F.col("_stop_1._node")
    place = F.when(first, F.col("_left_1") + 1 - F.col("_left")).otherwise(F.col("_left_1") + F.col("_left_2") + 2 - F.col("_left"))
    placed = join_same(links, whole.select(*group, "_left_1", "_left_2", "_stop_1"), group).select(*group, F.col("_node").alias("_n"), place.cast("int").alias("place"))
    return join_same(known.select(*group, "_node"), placed, group, "left", F.col("_node") == F.col("_n")).select(*group, F.col("_node").alias(node), "place")


#: Ranges that rows are ordered in, at least.
RANGES = 16


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank", within: list[str] | None = None, dense: bool = False) -> DataFrame:
    """rows with their place in one order, from 1: distinct places (ties in any order), or, if dense, equal for equal rows and without gaps.

    within: columns by which places begin anew; they come first in the order. Rows are dealt by range
    of the order, so few large groups, or none at all, still are spread over tasks; a range is numbered
    by itself, and what stands before it is a sum over one small row per range (and group). The input is
    written once to the shared folder, as its ranges are sampled before it is dealt.
    """
    within = within or []
    # Where equal rows get places of their own, they may be in several ranges.
    keys = [F.col(c) for c in within] + order + ([] if dense else [F.xxhash64(*rows.columns)])
    parts = max(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpoint(checkpoint(rows).repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *within).orderBy(*(order if dense else keys[len(within) :]))
    number = F.dense_rank() if dense else F.row_number()
    placed = dealt.withColumn("_place", number.over(inside))
    # Rows of equal keys are in one range, so a range's last place is how many it adds.
    sizes = placed.groupBy("_range", *within).agg(F.max("_place").alias("_size"))
    upto = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = sizes.withColumn("_before", F.sum("_size").over(upto.orderBy("_range")) - F.col("_size")).drop("_size")
    return join_same(placed, before, ["_range", *within]).select(*rows.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))
