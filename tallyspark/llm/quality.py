"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of words of every text are hashed into buckets. Two multinomials over the buckets,
of the trusted texts and of all texts, give each bucket a log-likelihood ratio; a text's score is
the mean ratio of its n-grams. Texts whose score is under a fixed threshold, or that fail the base
rules, are rejected; the verdict on a text depends on nothing but the text and these counts.

Only DataFrame functions are used. Scale: counting and scoring each read the texts once and explode
them inside a stage; what is shuffled is one row per bucket and task, then one row per document. The
number of buckets grows without a cap as the root of the corpus, as the number of distinct n-grams
does by Heaps' law. Their ratios are packed, PACK in a row and four bytes each, and broadcast in parts
of at most PART buckets (256 MB). One part does up to about 280 TB of text; each further one reads the
texts again, adding to the same sums. The trusted ids are broadcast only if they are few.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import broadcast_if_small, checkpoint, text_of

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A document is kept if the mean log-likelihood ratio of its n-grams is at least this.
THRESHOLD = -0.07
#: Buckets are so many times the root of the texts' bytes, up to the next power of two.
BUCKETS_PER_ROOT = 4
MIN_BUCKETS = 1 << 14
#: Ratios in a row of the packed table, and buckets whose ratios are broadcast at once.
PACK = 1 << 10
PART = 1 << 26
#: Pseudo-count of each bucket, in n-grams of trusted texts.
SMOOTHING = 4.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once; a lambda would compute an outer expression anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _repeated(words: Column) -> Column:
    """Words that stand in a window of three that occurs twice or more; words: their hashes.

    Windows are told apart by 64-bit hashes. A text without repeats ends after one sort of numbers.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    hashes = F.when(F.size(words) >= 3, windows).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column, twice: Column) -> Column:
        # Few repeated windows: look each window up among them. Many: sort the windows with their places.
        looked_up = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        by_place = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda z, x, i: F.coalesce((x["h"] == F.get(z, i - 1)["h"]) | (x["h"] == F.get(z, i + 1)["h"]), F.when(i == 0, x["h"] == F.get(z, i + 1)["h"]), x["h"] == F.get(z, i - 1)["h"], F.lit(False))
        sorted_up = let(by_place, lambda z: F.sort_array(F.transform(F.filter(z, lambda x, i: same(z, x, i)), lambda x: x["i"])))
        places = F.when(F.size(twice) <= 24, looked_up).otherwise(sorted_up)
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    repeated = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
    found = lambda h: let(let(F.sort_array(h), repeated), lambda twice: F.when(F.size(twice) == 0, F.lit(0)).otherwise(covered(h, twice)))
    return let(hashes, found).cast("long")


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with _hashes (of its words) and the base measures; text_col is not null."""
    text = F.col(text_col)
    # A text is split once; its words are needed for these two only.
    read = lambda w: F.struct(hashed(w).alias("hashes"), F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"))
    lines = lambda x: F.size(x) - F.size(F.array_distinct(x))
    rows = docs.withColumn("_read", let(words_of(text), read)).withColumns({"_hashes": F.col("_read.hashes"), "word_chars": F.col("_read.chars")}).drop("_read")
    return rows.withColumns(
        {
            "n_words": F.size("_hashes").cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long"),
            "n_dup_lines": let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).cast("long"),
            "n_repeat_words": let(F.col("_hashes"), _repeated),
        }
    )


def grams(hashes: Column, buckets: int) -> Column:
    """The bucket of each word and of each pair of words that follow one another, from the words' hashes."""
    single = lambda h: F.transform(h, lambda x: F.pmod(x, F.lit(buckets)))
    pair = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(buckets)))
    return let(hashes, lambda h: F.when(F.size(h) < 2, single(h)).otherwise(F.concat(single(h), pair(h))))


def buckets_for(n_bytes: int) -> int:
    return max(MIN_BUCKETS, 1 << math.ceil(math.log2(max(1, BUCKETS_PER_ROOT * math.sqrt(n_bytes)))))


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, ratio for all buckets that occur; trusted: one column of ids. One row per bucket."""
    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    n_bytes = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = buckets_for(n_bytes)
    ids = trusted.select(trusted[trusted.columns[0]].alias("_id")).where("_id IS NOT NULL").distinct().withColumn("_trusted", F.lit(1))
    marked = source.join(broadcast_if_small(ids), "_id", "left")
    each = marked.select(F.coalesce("_trusted", F.lit(0)).alias("t"), F.explode(grams(hashed(words_of(F.col("_text"))), buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    got = checkpoint(counts)
    totals = got.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))
    all_raw, all_target = totals.first()
    # Against what the raw counts let expect, without the n-gram that is scored; both are shrunk, so n-grams seen a few times say little.
    expected = (F.col("raw") - 1) * (all_target / max(1, all_raw))
    # Without trusted text nothing is known, and every ratio is 0.
    ratio = F.log((F.col("target") + SMOOTHING) / (expected + SMOOTHING)) if all_target else F.lit(0.0)
    return got.select("bucket", ratio.cast("double").alias("ratio"), F.lit(buckets).alias("buckets"))


def packed(table: DataFrame, buckets: int) -> DataFrame:
    """pack, ratios (PACK of them, 0 for buckets without n-grams) of a table of ratios()."""
    every = table.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0.0).alias("ratio"))
    dense = table.select("bucket", "ratio").unionByName(every).groupBy("bucket").agg(F.sum("ratio").cast("float").alias("ratio"))
    rows = dense.groupBy(F.floor(F.col("bucket") / PACK).alias("pack")).agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("all"))
    return rows.select("pack", F.col("all.ratio").alias("ratios"))


def verdicts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    trusted: a table whose first column has the ids of trusted texts. score: the mean ratio, 0 for
    a text without words. base_failed: under MIN_WORDS words, or over MAX_REPEATED_PERCENT of the
    words in repeated windows of three. kept: not base_failed and score >= threshold. also: columns
    of docs to carry along; numbers, as other types would need a sort to be aggregated.

    A null text has no words. Rows are numbered by the scan, so null and repeated ids don't matter;
    a null id is never trusted. Without trusted texts all scores are 0. An empty table gives an
    empty table. Other columns are not read. As the counts are those of docs, equal texts may score
    otherwise in another corpus, by other neighbours and another number of buckets.
    """
    table = ratios(docs, trusted, id_col, text_col)
    known = table.select("buckets").first()
    source = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), *also)
    names = [*also, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    buckets = known[0] if known else MIN_BUCKETS
    packs = checkpoint(packed(table, buckets))
    each = measured(source, "_text").select("_row", "_id", *names, F.explode_outer(grams(F.col("_hashes"), buckets)).alias("bucket"))
    each = each.withColumn("pack", F.floor(F.col("bucket") / PACK))

    def summed(rows: DataFrame, *sums: Column) -> DataFrame:
        return rows.groupBy("_row").agg(*(F.first(x).alias(x) for x in ("_id", *names)), *sums)

    def part(first: int) -> DataFrame:
        """Of each text the sum of its ratios in a part of the buckets, and the number of its n-grams."""
        known = F.broadcast(packs.where(F.col("pack").between(first // PACK, (first + PART - 1) // PACK)))
        found = each.join(known, "pack", "left").withColumn("ratio", F.get("ratios", F.pmod("bucket", F.lit(PACK)).cast("int")).cast("double"))
        return summed(found, F.sum("ratio").alias("ratio"), F.count("bucket").alias("n"))

    parts = [part(first) for first in range(0, buckets, PART)]
    total = parts[0] if len(parts) == 1 else summed(reduce(DataFrame.unionByName, parts), F.sum("ratio").alias("ratio"), F.first("n").alias("n"))
    score = F.round(F.coalesce(F.try_divide("ratio", "n"), F.lit(0.0)), 9)
    judged = total.select(F.col("_id").alias(id_col), *names, score.alias("score"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def text_key(text_col: str = "text") -> list[Column]:
    """128 bits that stand for a text."""
    text = text_of(text_col)
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit("key"), text).alias("_k2")]


def kept_rows(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text verdicts() keeps, with all columns of docs.

    A verdict depends on the text alone, so rejected texts are found again by a key of the text;
    null and repeated ids don't matter. The keys are broadcast only if they are few.
    """
    keyed = docs.select(*text_key(text_col), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    judged = verdicts(keyed, trusted, "_id", "_text", threshold, also=("_k1", "_k2"))
    rejected = checkpoint(judged.where("NOT kept").select("_k1", "_k2").distinct())
    # The caller's columns travel in one struct, so no name of theirs meets one of ours.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *text_key(text_col))
    return own.join(broadcast_if_small(rejected), ["_k1", "_k2"], "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
