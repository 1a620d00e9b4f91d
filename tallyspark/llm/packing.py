"""Packing into optimal length buckets.

A dynamic programme over the global histogram of lengths picks the bucket boundaries that minimise
padding. Each bucket is then cut into batches of at most ``token_budget`` padded tokens.

Scale: the driver gets one histogram with a row for each distinct length. d distinct lengths take at
least d^2 / 2 words, so 5e9 words have at most 100,000 of them. A document's place
in its bucket is a prefix sum over groups of (length, salt) plus its rank in the group. A length that
many documents share gets more salts, and rows are dealt to them by their place in the scan, so no
group has much over ``GROUP_ROWS`` rows, however many copies, repeated ids or null ids there are.
Texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, checkpoint, text_of

GROUP_ROWS = 2_000


def optimal_bounds(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """The boundaries (each the largest length of its bucket) with the least padding.

    lengths ascend and are distinct. With no lengths there are no bounds. Among equal costs the
    leftmost cut wins, so the result doesn't depend on the order of rows.

    A bucket of lengths i..j-1 costs L[j-1] * rows - tokens, which is a Monge cost. So the best cut
    moves right with j, and each layer is solved by divide and conquer.
    """
    d = len(lengths)
    if not d:
        return []
    n_buckets = max(1, min(n_buckets, d))
    top = np.asarray(lengths, dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    tokens = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64) * top)])

    best = np.full(d + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(n_buckets):
        after, cut = np.full(d + 1, np.inf), np.zeros(d + 1, dtype=np.int64)
        todo = [(1, d, 0, d - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            cost = best[i] + top[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
            k = int(np.argmin(cost))
            after[j], cut[j] = cost[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        after[0] = 0.0
        best = after
        cuts.append(cut)
    bounds, j = [], d
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(top[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def pack(docs: DataFrame, token_budget: int = 16_384, n_buckets: int = 16, id_col: str = "doc_id", length: Column | None = None) -> DataFrame:
    """One row per row of docs: its id, n_tokens, bucket, bucket_len, batch, slot.

    n_tokens: ``length``, by default the count of white-space words; null counts as 0.
    bucket: from 0, by length. bucket_len: what its rows are padded to. batch: from 0 in each
    bucket; it holds max(1, token_budget // bucket_len) rows, so a document longer than the budget
    gets a batch of its own and nothing is cut or dropped. slot: from 0 in each batch. In a bucket,
    rows go by length, then in an order that follows from their place in the scan.

    Rows with the same id each keep a slot. An empty table gives an empty table. Only the id and
    the length are read, so other columns may have any names.
    """
    # The texts are read once; ids and lengths are kept in the shared folder for the passes that follow.
    lens = checkpoint(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(length if length is not None else word_count(), F.lit(0)).cast("long").alias("_n")))
    histogram = sorted(lens.groupBy("_n").count().collect())
    bounds = optimal_bounds([g for g, _ in histogram], [n for _, n in histogram], n_buckets)
    of = np.searchsorted(bounds, [g for g, _ in histogram]) if bounds else []
    plan = [(int(g), int(b), int(bounds[b]), n // GROUP_ROWS + 1) for (g, n), b in zip(histogram, of, strict=True)]
    buckets = docs.sparkSession.createDataFrame(plan, "_n long, bucket int, bucket_len long, _salts long")  # one row for each distinct length

    rows = lens.join(F.broadcast(buckets), "_n").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_salts")))
    groups = rows.groupBy("bucket", "_n", "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("bucket").orderBy("_n", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("_n", "_salt", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_n", "_salt").orderBy("_row")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["_n", "_salt"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    place = F.col("_start") + F.col("_rank")
    return ranked.select(F.col("_id").alias(id_col), F.col("_n").alias("n_tokens"), "bucket", "bucket_len", F.floor(place / capacity).cast("long").alias("batch"), (place % capacity).cast("long").alias("slot"))
