"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit of a fingerprint gets a nonzero vector of GF(2)^(r+1); a table belongs to each nonzero v
and keeps the bits whose vector has an odd product with v. Two fingerprints that differ in at most
r bits differ in at most r vectors, so some nonzero v is orthogonal to all of these: in that table
the two agree on every kept bit. No pair within the radius is missed, whatever the data.

Scale: pairs inside a bucket are never listed. A bucket of two is checked from its smallest and
largest member, which one aggregate finds. The members of a larger bucket meet at hubs instead: two
fingerprints differ in at most two bits exactly if flipping at most one bit of each can make them
equal, and inside a bucket only the bits that the table doesn't keep can differ. So a fingerprint
makes at most 65 rows, however large its buckets are, and each hub is linked to its smallest member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpoint, text_of
from tallyspark.llm.components import connected

RADIUS = 2
#: A fingerprint with over one in so many of all rows isn't shuffled.
HOT_SHARE = 5_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of UTF-8 text; 0 if it has no word."""
    words = text.translate(_LOWER).split()  # at space and \t to \r, as WORD
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, "_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits; see the module's text."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << bit for bit in range(64) if (v & (bit % n + 1)).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lit(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (a < b): links between distinct fingerprints whose classes are those of the radius.

    Each is a true link or joins two fingerprints through a hub that is within one bit of both.
    Every pair within the radius is joined by one link or by two that share an end.
    """
    if radius != 2:
        raise ValueError("hubs of one bit serve a radius of 2")
    masks = covering_masks(radius)
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(_lit(m)).alias("key")) for i, m in enumerate(masks)))
    rows = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key")
    buckets = checkpoint(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    large = rows.join(buckets.where("n > 2").select("t", "key"), ["t", "key"], "left_semi")
    # A fingerprint may be in large buckets of several tables; each of its free bits makes one hub all the same.
    free = F.element_at(F.array(*(_lit(~m & (1 << 64) - 1) for m in masks)), F.col("t") + 1)
    flips = large.groupBy("fp").agg(F.bit_or(free).alias("free"))
    flip = F.explode(F.array_compact(F.array(_lit(0), *(F.when(F.col("free").bitwiseAND(_lit(1 << bit)) != 0, _lit(1 << bit)) for bit in range(64)))))
    hubs = flips.select("fp", flip.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("hub", "a")
    stars = hubs.join(least, "hub").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    component_id: the smallest id reachable over links (at most RADIUS differing bits), its own
    included. Rows with equal texts, or equal ids, are in one class as their fingerprints are.
    A null or empty text has fingerprint zero and is linked like any other. A null id is never
    smallest; a class with null ids only has a null component_id. An empty table gives an empty
    table. Other columns are not read.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col))
    classes = checkpoint(prints.groupBy("fp").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = connected(links(classes.select("fp")))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = checkpoint(linked.join(by_root, "root").select("fp", "component_id"))
    found = classes.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    # Fingerprints that many rows share are looked up where the rows are; by their share there are fewer than HOT_SHARE of them.
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = checkpoint(found.where(F.col("n") * HOT_SHARE > total))
    common = prints.join(F.broadcast(hot.drop("n")), "fp")
    rare = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(found.drop("n"), "fp")
    return common.unionByName(rare).select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
