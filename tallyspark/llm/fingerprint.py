"""Document fingerprints from content-defined chunks.

A gear hash of the last WINDOW bytes proposes boundaries. They are normalised: a strict test before
the target length and a loose one after it, between a least and a greatest length. So an edit moves
only the boundaries near it. A fingerprint is the set of chunk digests with their lengths; the
likeness of one to another is the share of its length whose chunks the other has too.

Scale: a text needs the text that follows it in the order of ids. Documents go to ranges of ids and
are sorted inside these; the first document of each range also goes to the range before it, so each
text is shuffled once and read as a stream. Only the ranges' boundaries reach the driver.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import text_of

WINDOW, LEAST, TARGET, GREATEST = 16, 16, 64, 255
#: Top bits of the hash that are zero at a boundary, before and after TARGET.
STRICT, LOOSE = 8, 4
RANGE_BYTES = 1 << 20
MAX_RANGES = 1 << 15
CHUNK = 1 << 20
_FIRST = -(1 << 63)

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([x]), 7) for x in range(256)], dtype=np.uint32)


def chunk_sets(texts: list[bytes]) -> list[frozenset[int]]:
    """Of each text the set of its chunks; a chunk is 40 bits of digest and 8 of length."""
    out: list[frozenset[int]] = []
    a, digest = 0, xxhash.xxh3_64_intdigest
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
            size += len(texts[b])
            b += 1
        data = b"".join(texts[a:b])
        h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
        for step in (1, 2, 4, 8):  # sums of 2, 4, 8, 16 shifted bytes
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h = longer
        loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
        strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0].tolist()
        loose = loose.tolist()
        strict.append(len(data) + GREATEST)
        loose.append(len(data) + GREATEST)
        end = 0
        for text in texts[a:b]:
            # A window that reaches into the text before ends within LEAST bytes, where no cut is made.
            start, end, found = end, end + len(text), set()
            while start < end:
                cut = strict[bisect_left(strict, start + LEAST - 1)] + 1
                if cut > start + TARGET:
                    cut = min(loose[bisect_left(loose, start + TARGET)] + 1, start + GREATEST)
                cut = min(cut, end)
                found.add(digest(data[start:cut]) >> 24 << 8 | cut - start)
                start = cut
            out.append(frozenset(found))
        a = b
    return out


def written(chunks: frozenset[int]) -> str:
    """12 hex digits a chunk, in ascending order."""
    return "".join(["%012x" % x for x in sorted(chunks)])


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """The share of a's length that b contains; 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(len(a) == len(b))
    return sum([x & 255 for x in a & b]) / sum([x & 255 for x in a])


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame) -> list[int]:
    """Ids that begin a range, ascending; the smallest id is the first."""
    n_bytes, least = docs.agg(F.sum(F.octet_length("_text")), F.min("_key")).first()
    if least is None:
        return []
    n = min(MAX_RANGES, int((n_bytes or 0) // RANGE_BYTES) + 1)
    if n == 1:
        return [least]
    cuts = docs.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted({least, *cuts})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 2 code points replaced by as many first ones (or all)
    of the next document. Documents go by id, nulls first, equal ids by text; the first follows the
    last, and a lone document follows itself. Of several first documents of a range with one id,
    the one with the least text (by bytes) is the next of the range before.

    A null text is empty. An empty text has the empty fingerprint, which is like the empty one only
    (1.0). Equal texts have equal fingerprints. An empty table gives an empty table. Other columns
    are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("_key"), text_of(text_col).cast("binary").alias("_text"))
    starts = _ranges(source)
    cuts = np.array(starts, dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, firsts = ["range", "tail", "_id", "_key", "_text"], {}
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(cuts, keys, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(len(keys), dtype=bool)), batch.column(0), batch.column(1), batch.column(2)], names=names)
            for i in np.flatnonzero(cuts[np.maximum(at, 0)] == keys).tolist():
                text = batch.column(2)[i].as_py()
                if at[i] not in firsts or text < firsts[at[i]]:
                    firsts[at[i]] = text
        for i, text in firsts.items():  # at most one for each range
            before = np.int32((int(i) - 1) % len(cuts))
            yield pa.RecordBatch.from_arrays([pa.array([before], pa.int32()), pa.array([True]), pa.array([None], pa.int64()), pa.array([starts[int(i)]]), pa.array([text], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, id, text, chunks) that waits for what follows it
        for batch in batches:
            # In pieces, so that little is held however large a batch is.
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ranges, tails, ids, raw = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                rows = [last] if last else []
                rows += [(r, tail, i, x.decode(), c) for r, tail, i, x, c in zip(ranges, tails, ids, raw, chunk_sets(raw), strict=True)]
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
                last = rows[-1]
                if not pairs:
                    continue
                texts = [edited(x[3], y[3]).encode() for x, y in pairs]
                sets = chunk_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([written(x[4]) for x, _ in pairs]), pa.array([written(s) for s in sets]),
                        pa.array([likeness(x[4], s) for (x, _), s in zip(pairs, sets, strict=True)]), pa.array([likeness(x[4], y[4]) for x, y in pairs]),
                    ],
                    names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    dealt = source.mapInArrow(deal, "range int, tail boolean, _id long, _key long, _text binary")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "tail", "_key", "_text").drop("_key")
    schema = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
