"""Ranked lexical search by block-max pruning.

Documents are laid out in blocks, ranges of BLOCK documents in the order of the scan. A block has a
forward index (the terms of each document with their impacts) and the largest impact of each term in
it. The sum of a query's weights times these maxima bounds the score of every document of the block.
For a query, blocks are taken in falling order of their bounds, and scored from the forward index
until a bound is under the score of the query's 50th best document so far.

That score is made known to all tasks in advance: the FIRST blocks with the highest bounds of all are
scored first, whatever task they are in, and the query's 50th best score in these is a threshold from
which every task starts. So tasks that hold nothing of a query's best documents send nothing.

Scale: texts are read once, inside their rows, and never shuffled. Of terms the index has those of
the queries, which are taken in sets of about TERMS terms; weights and thresholds of a set are sent
to the workers. What is shuffled is a count per term and task, and at most ``limit`` rows per query
and task. The index is a table in the shared folder, removed at the end.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpoint, checkpoint_dir, remove, text_of

LIMIT = 50
BLOCK = 64
#: A block ends early when it has so many entries, so its row stays small.
ENTRIES = 1 << 16
#: Blocks that a task holds at once.
HELD = 256
#: Blocks of each query that give its first threshold.
FIRST = 4
#: Terms of a set of queries, repeats of other queries included.
TERMS = 1_000_000
SALTS = 32
PIECE = 1 << 22

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def terms_in(text: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 text in order; of a long text in pieces that part no term."""
    text, a = text.translate(_LOWERED), 0
    while a < len(text):
        gap = _GAP.search(text, a + PIECE)
        b = gap.start() if gap else len(text)
        yield _TERM.findall(text, a, b)
        a = b


@dataclass
class Queries:
    """A set of queries: their ids; their terms, numbered; and term numbers, weights and start of each."""

    ids: list
    number: dict[bytes, int]
    terms: np.ndarray
    starts: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # of all terms by number

    @staticmethod
    def of(rows: list) -> Queries:
        """rows: (id, list of distinct terms, one at least)."""
        number: dict[bytes, int] = {}
        terms = [number.setdefault(t.encode("utf-8", "surrogatepass"), len(number)) for _, own in rows for t in own]
        sizes = [len(own) for _, own in rows]
        return Queries([x for x, _ in rows], number, np.array(terms, dtype=np.int64), np.cumsum([0, *sizes[:-1]]))

    def own(self, q: int) -> np.ndarray:
        return self.terms[self.starts[q] : self.starts[q + 1] if q + 1 < len(self.starts) else None]

    def bounds(self, terms: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """The bound of each query in a block."""
        most = np.zeros(len(self.number), dtype=np.int64)
        most[terms] = maxima
        return np.add.reduceat(most[self.terms] * self.weights[self.terms], self.starts)

    def scores(self, q: int, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """The score of each document of a block; mine: an array of zeros, by term, that is given back as such."""
        own = self.own(q)
        mine[own] = self.weights[own]
        totals = np.concatenate([[0], np.cumsum(mine[terms] * impacts)])
        mine[own] = 0
        ends = np.cumsum(sizes)
        return totals[ends] - totals[ends - sizes]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id, term: the distinct terms of all rows of an id."""
    lowered = F.translate(text_of(text_col), _UPPER, _LOWER)
    return items.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1))).alias("term")).distinct()


_FORWARD = "ids array<long>, lengths array<long>, sizes array<int>, terms array<int>, counts array<int>, n_docs long, n_terms long"


def forward_index(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per block: ids, lengths (in terms) and sizes of its documents that hold a numbered term; the numbers of these terms and their counts, one document after another; n_docs, n_terms: of all the documents that it was made from."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value
        ids, lengths, sizes, terms, counts, n_docs, n_terms = [], [], [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            columns = [pa.array([x], pa.list_(kind)) for x, kind in zip((ids, lengths, sizes, terms, counts), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["ids", "lengths", "sizes", "terms", "counts", "n_docs", "n_terms"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                length, held = 0, Counter()
                for found in terms_in(text):
                    length += len(found)
                    all_counts = Counter(found)
                    for t in all_counts.keys() & find.keys():
                        held[find[t]] += all_counts[t]
                n_docs, n_terms = n_docs + bool(length), n_terms + length
                if held:
                    ids.append(doc_id)
                    lengths.append(length)
                    sizes.append(len(held))
                    terms += held.keys()
                    counts += held.values()
                if len(ids) == BLOCK or len(terms) >= ENTRIES:
                    yield block()
                    ids, lengths, sizes, terms, counts, n_docs, n_terms = [], [], [], [], [], 0, 0
        if n_docs:
            yield block()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, _FORWARD)


def with_maxima(forward: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """block, ids, sizes, terms, impacts, max_terms, max_impacts of each block that has terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, sizes, terms, counts = (np.asarray(batch.column(c)[k].values, dtype=np.int64) for c in (2, 3, 4, 5))
                impacts = impact(counts, np.repeat(lengths, sizes), n_docs, n_terms)
                order = np.argsort(terms, kind="stable")
                first = np.flatnonzero(np.diff(terms[order], prepend=-1))
                arrays = (sizes, terms, impacts, terms[order][first], np.maximum.reduceat(impacts[order], first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *(pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in arrays)], names=["block", "ids", "sizes", "terms", "impacts", "max_terms", "max_impacts"])

    rows = forward.where(F.size("ids") > 0).select(F.monotonically_increasing_id().alias("block"), "ids", "lengths", "sizes", "terms", "counts")
    return rows.mapInArrow(run, "block long, ids array<long>, sizes array<int>, terms array<int>, impacts array<int>, max_terms array<int>, max_impacts array<int>")


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score, without its weight."""
    m = 100 - 50 + (50 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _array(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name))[k].values)


class _Best:
    """The best documents of a query so far."""

    def __init__(self, limit: int, least: int) -> None:
        self.limit, self.least = limit, max(1, least)  # no lower score is wanted
        self.ids, self.null, self.scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    def add(self, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        wanted = scores >= self.least
        if wanted.any():
            ids, null, scores = (np.concatenate([a, b[wanted]]) for a, b in ((self.ids, ids), (self.null, null), (self.scores, scores)))
            order = np.lexsort((ids, null, -scores))[: self.limit]
            self.ids, self.null, self.scores = ids[order], null[order], scores[order]
            if len(order) == self.limit:
                self.least = max(self.least, int(self.scores[-1]))


def _top(index: DataFrame, queries: Queries, thresholds: np.ndarray, limit: int) -> DataFrame:
    """q, doc_id, score: of each task, a query's best documents from its threshold on."""
    known = index.sparkSession.sparkContext.broadcast((queries, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = known.value
        best = [_Best(limit, int(x)) for x in least]
        mine = np.zeros(len(own.number), dtype=np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, HELD):
                batch = whole.slice(a, HELD)
                bounds = np.stack([own.bounds(_array(batch, "max_terms", k), _array(batch, "max_impacts", k)) for k in range(batch.num_rows)])
                held: dict[int, tuple] = {}
                for q in np.flatnonzero((bounds >= [x.least for x in best]).any(axis=0)).tolist():
                    for k in np.argsort(-bounds[:, q], kind="stable").tolist():
                        if bounds[k, q] < best[q].least:
                            break
                        if k not in held:
                            ids = batch.column(batch.schema.get_field_index("ids"))[k].values
                            held[k] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), [_array(batch, x, k).astype(np.int64) for x in ("sizes", "terms", "impacts")]
                        ids, null, arrays = held[k]
                        best[q].add(ids, null, own.scores(q, *arrays, mine))
        for q, x in enumerate(best):
            if len(x.ids):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(x.ids), pa.int32()), pa.array(x.ids, mask=x.null), pa.array(x.scores)], names=["q", "doc_id", "score"])

    return index.select("ids", "sizes", "terms", "impacts", "max_terms", "max_impacts").mapInArrow(run, "q int, doc_id long, score long")


def _first_blocks(index: DataFrame, queries: Queries) -> DataFrame:
    """block: those with the FIRST highest bounds of each query."""
    known = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        blocks, most = np.zeros((0, len(own.ids)), dtype=np.int64), np.zeros((0, len(own.ids)), dtype=np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, HELD):
                batch = whole.slice(a, HELD)
                bounds = np.stack([own.bounds(_array(batch, "max_terms", k), _array(batch, "max_impacts", k)) for k in range(batch.num_rows)])
                blocks = np.concatenate([blocks, np.repeat(np.asarray(batch.column(0))[:, None], len(own.ids), axis=1)])
                most = np.concatenate([most, bounds])
                order = np.argsort(-most, axis=0, kind="stable")[:FIRST]
                blocks, most = np.take_along_axis(blocks, order, axis=0), np.take_along_axis(most, order, axis=0)
        q = np.tile(np.arange(len(own.ids), dtype=np.int32), len(blocks))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(blocks.ravel()), pa.array(most.ravel())], names=["q", "block", "bound"])

    each = index.select("block", "max_terms", "max_impacts").mapInArrow(run, "q int, block long, bound long").where("bound > 0")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))
    return each.withColumn("place", place).where(F.col("place") <= FIRST).select("block").distinct()


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    """q, rank, doc_id, score: the best of all tasks; a query's rows meet in SALTS groups first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("rank") <= limit)
    return some.drop("salt", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= limit)


def _search_set(docs: DataFrame, queries: Queries, limit: int, id_col: str, text_col: str) -> DataFrame:
    spark, folder = docs.sparkSession, f"{checkpoint_dir(docs.sparkSession)}/index-{uuid.uuid4().hex}"
    forward_index(docs, queries.number, id_col, text_col).write.parquet(f"{folder}/forward")
    forward = spark.read.parquet(f"{folder}/forward")
    n_docs, n_terms = forward.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    queries.weights = np.zeros(len(queries.number), dtype=np.int64)
    for term, df in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # of one set's terms
        queries.weights[term] = weight(n_docs, df)
    with_maxima(forward, n_docs, n_terms).write.parquet(f"{folder}/blocks")
    index = spark.read.parquet(f"{folder}/blocks")
    # At most FIRST blocks of each query of the set.
    first = _top(index.join(F.broadcast(_first_blocks(index, queries)), "block", "left_semi"), queries, np.zeros(len(queries.ids)), limit)
    thresholds = np.zeros(len(queries.ids))
    for q, score in _ranked(first, limit).where(F.col("rank") == limit).select("q", "score").collect():
        thresholds[q] = score
    ids = spark.createDataFrame(list(enumerate(queries.ids)), "q int, id long")
    found = checkpoint(_ranked(_top(index, queries, thresholds, limit), limit).join(F.broadcast(ids), "q").select("id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    remove(spark, folder)
    return found


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item id, rank, doc id, score: of each item the ``limit`` best rows of docs with a score above 0.

    Equal scores are ranked by ascending doc id, a null one last. Null texts have no terms. Rows of
    items with the same id, a null one too, are one query with the terms of all; items without terms,
    and those whose terms are nowhere, give no rows. Each row of docs is a document, whatever its id.
    An empty table of either kind gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    terms = checkpoint(item_terms(items, item_col, item_text_col).withColumn("id", F.col("id").cast("long")))
    sets = max(1, -(-terms.count() // TERMS))
    found = spark.createDataFrame([], "id long, rank int, doc_id long, score long")
    for k in range(sets):
        rows = terms.where(F.pmod(F.xxhash64("id"), F.lit(sets)) == k).groupBy("id").agg(F.collect_list("term").alias("terms")).collect()
        if rows:
            found = found.unionByName(_search_set(docs, Queries.of(rows), limit, id_col, text_col))
    return found.select(F.col("id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
