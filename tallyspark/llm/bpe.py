"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

A text is split by the vocabulary's pattern. The pieces that a worker hasn't met are laid out as
rows (fragment, position, token); a recursive query joins neighbouring rows to the merge table and
contracts the leftmost pair of least rank until none is left. Decoding joins the tokens of each text
to the vocabulary and concatenates them in an ordered aggregate.

Two facts about merges keep that cheap for pieces of any length, without changing a token:
no merge spans two bytes that stand side by side in no token, so pieces are cut there into
fragments first; and whether a pair is merged next depends on its neighbourhood alone. A pair can
only be touched by a token that ends beside it, so if no pair within a longest token's length before
it and two after it is to come first, it may be contracted at once. A long fragment therefore has
many contractions a step, one in each three blocks at most. A short one is a single block.

Scale: documents are independent, so there is no shuffle and a lost task is simply run again. A
worker holds a slice of about SLICE characters and about CACHE pieces with their tokens; it
forgets them all when they are more, which changes nothing but speed. A longer text is read in runs
of PIECES pieces, and tokens are decoded in runs of TOKENS, one after another, so no query grows with
a text. A query's recursion keeps about STATES rows, whatever the lengths: short fragments are dealt
out by the square of their lengths, long ones by segments and steps.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import text_of

SLICE = 4 << 20
CACHE = 1_500_000
PIECES = 1 << 19
TOKENS = 1 << 19
#: Rows of all steps that one recursive query may keep.
STATES = 4 << 20
#: Fragments of up to so many bytes are one block; longer ones are laid out in segments of blocks.
SHORT = 128
SEGMENT = 1 << 16

_CONTRACT = """
WITH RECURSIVE state(step, fragment, pos, token, block, free, merged, safe, key) AS (
    SELECT 0, fragment, pos, token, block, free, m.merged, m.safe, m.merged::BIGINT * 4294967296 + pos
    FROM (SELECT *, lead(token) OVER (PARTITION BY fragment ORDER BY pos) AS after FROM start) s
    LEFT JOIN {merges} m ON m.l = s.token AND m.r = s.after
  UNION ALL
    SELECT step, fragment, pos, token, block, free, m.merged, m.safe, m.merged::BIGINT * 4294967296 + pos
    FROM (
        SELECT step + 1 AS step, fragment, pos, token, block, free, lead(token) OVER (PARTITION BY fragment ORDER BY pos) AS after
        FROM (
            SELECT step, fragment, pos, block, free, CASE WHEN hit THEN merged ELSE token END AS token, alive, lag(hit, 1, false) OVER (PARTITION BY fragment ORDER BY pos) AS gone
            FROM ({hits})
        )
        WHERE alive AND NOT gone
    ) s
    LEFT JOIN {merges} m ON m.l = s.token AND m.r = s.after
)
SELECT fragment, pos, token FROM state JOIN (SELECT fragment, max(step) AS step FROM state GROUP BY fragment) USING (fragment, step) ORDER BY fragment, pos
"""
#: The leftmost pair of least rank of each fragment; a fragment without one ends.
_FIRST = "SELECT state.*, coalesce(key = best, false) AS hit, true AS alive FROM state JOIN (SELECT fragment, min(key) AS best FROM state WHERE step < {steps} GROUP BY fragment HAVING min(key) IS NOT NULL) USING (fragment)"
#: Of a block and the ones before and after it: blocks are grouped by three in three ways, and each is the middle of one group.
_AROUND = "CASE block % 3 " + " ".join(f"WHEN {m} THEN min(key) OVER (PARTITION BY fragment, (block + {s}) // 3)" for m, s in ((1, 0), (0, 1), (2, 2))) + " END"
#: The leftmost pair of least rank around each place; of a merge after which none of a lower rank can follow also each later one,
#: in a run of overlapping ones every second from its beginning, if that is in sight and of least rank as well.
_FIRST_AROUND = f"""
SELECT *, max(hit) OVER (PARTITION BY fragment) AS alive FROM (SELECT *, coalesce(free AND (key = best OR safe AND least AND n % 2 = run % 2 AND first_value(least AND (run > 1 OR pos = 0)) OVER (PARTITION BY fragment, run ORDER BY n)), false) AS hit
FROM (
    SELECT *, merged = best // 4294967296 AS least, max(CASE WHEN merged IS DISTINCT FROM prior THEN n END) OVER (PARTITION BY fragment ORDER BY n ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT *, {_AROUND} AS best, lag(merged) OVER o AS prior, row_number() OVER o AS n FROM state WHERE step < {{steps}} WINDOW o AS (PARTITION BY fragment ORDER BY pos))
))
"""
_DECODE = "SELECT text, array_to_string(list(chars ORDER BY pos), '') AS chars FROM tokens JOIN vocabulary USING (id) GROUP BY text"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def unicode_pattern(pattern: str) -> str:
    """The pattern with white space as Unicode's property, as tiktoken reads it; \\s of ``regex`` has \\x1c-\\x1f besides."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class _Pieces(dict):
    """Numbers pieces from 0 as they are met."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


def _gathered(which: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of entries ``which`` of a table (sizes, and all tokens one after another), and where each ends."""
    each = sizes[which]
    ends = np.cumsum(each)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[which] - (ends - each), each)
    return tokens[at], ends


class Codec:
    """A vocabulary in an own DuckDB database, with the pieces met so far."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.pattern = read_ranks(path), regex.compile(unicode_pattern(pattern))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.merges = np.array(merges, dtype=np.int32)
        self._load("merges", self._table(self.merges))
        # A byte is the character of its number, so any bytes make a string.
        self._load("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "chars": [t.decode("latin-1") for t in self.ranks]}))
        self.of_byte = np.array([self.ranks[bytes([x])] for x in range(256)], dtype=np.int32)
        self.adjacent = np.zeros((256, 256), dtype=bool)  # bytes that stand side by side in a token
        for token in self.ranks:
            self.adjacent[tuple(np.frombuffer(token, dtype=np.uint8)[k:][: len(token) - 1] for k in (0, 1))] = True
        self.forget()

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.db.unregister("rows")

    @staticmethod
    def _table(merges: np.ndarray) -> pa.Table:
        """Rows for the recursive query; safe: no merge of the result has a lower rank than the result."""
        unsafe = merges[:, :2][merges[:, :2] > merges[:, 2:]]
        return pa.table([*(pa.array(x) for x in merges.T), pa.array(~np.isin(merges[:, 2], unsafe))], names=["l", "r", "merged", "safe"])

    def forget(self) -> None:
        self.pieces = _Pieces()
        self.tokens = np.zeros(0, dtype=np.int32)  # of all pieces, one after another
        self.sizes = np.zeros(0, dtype=np.int64)

    def _contracted(self, fragment: np.ndarray, pos: np.ndarray, token: np.ndarray, steps: int, block: np.ndarray | None = None, free: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """fragment, pos, token after so many steps of the recursive query, or fewer if nothing is left to do."""
        rows = {"fragment": fragment.astype(np.int32), "pos": pos.astype(np.int32), "token": token, "block": np.zeros(len(pos), dtype=np.int32) if block is None else block.astype(np.int32), "free": np.ones(len(pos), dtype=bool) if free is None else free}
        self.db.register("start", pa.table(rows))
        found = self.db.execute(_CONTRACT.format(merges="merges" if block is None else "own", hits=(_FIRST if block is None else _FIRST_AROUND).format(steps=steps))).fetchnumpy()
        self.db.unregister("start")
        return tuple(np.asarray(found[x], dtype=np.int32) for x in ("fragment", "pos", "token"))

    def _short(self, fragments: list[bytes]) -> list[np.ndarray]:
        """The tokens of fragments of up to SHORT bytes."""
        sizes = np.array([len(x) for x in fragments])
        number = np.repeat(np.arange(len(fragments)), sizes)
        position = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found, _, tokens = self._contracted(number, position, self.of_byte[np.frombuffer(b"".join(fragments), dtype=np.uint8)], SHORT)
        return np.split(tokens, np.flatnonzero(np.diff(found)) + 1)

    def _long(self, fragment: bytes) -> np.ndarray:
        """The tokens of a longer fragment.

        It is laid out in segments that are parted elsewhere every second time. Pairs near a
        segment's edge aren't free, as the pairs that may come before them aren't all in sight. The
        first pair of the whole fragment is free in one of the two layouts, so it is done when
        neither changes anything.
        """
        letters = set(fragment)
        inside = {n: len(x) for x, n in self.ranks.items() if letters.issuperset(x)}
        block = max(SHORT // 4, 2 * max(inside.values()))
        self.db.register("own", self._table(self.merges[np.isin(self.merges[:, 2], list(inside))]))
        token, pos = self.of_byte[np.frombuffer(fragment, dtype=np.uint8)], np.arange(len(fragment))
        edge, half, end = 2 * block, SEGMENT // 2, len(fragment) - 1
        changed = np.zeros(end // half + 2, dtype=np.int64)  # by half segments: the round after the last one that changed it
        for k in itertools.count(1):
            shift = k % 2
            segment, inside = np.divmod(pos + shift * half, SEGMENT)
            halves = 2 * segment - shift
            todo = (np.maximum(changed[halves.clip(0)], changed[(halves + 1).clip(max=len(changed) - 1)]) >= k - 2)
            if not todo.any():
                if changed.max() < k - 2:
                    self.db.unregister("own")
                    return token
                continue
            free = ((inside >= edge) | (pos < edge)) & ((inside < SEGMENT - edge) | (segment == (end + shift * half) // SEGMENT))
            parts, cuts = [], np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(pos)]])
            a = 0
            while a < len(cuts) - 1:
                b = a + 1
                if todo[cuts[a]]:
                    while b < len(cuts) - 1 and todo[cuts[b]] and cuts[b + 1] - cuts[a] <= STATES // 16:
                        b += 1
                    rows = slice(cuts[a], cuts[b])
                    _, at, got = self._contracted(segment[rows] - segment[rows][0], pos[rows], token[rows], 16, pos[rows] // block, free[rows])
                    gone = np.setdiff1d(pos[rows], at, assume_unique=True)
                    changed[gone // half] = k
                    parts.append((at, got))
                else:
                    parts.append((pos[cuts[a] : cuts[b]], token[cuts[a] : cuts[b]]))
                a = b
            pos, token = (np.concatenate(x) for x in zip(*parts, strict=True))
        raise AssertionError

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces one after another, and how many each has; no piece is empty."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in pieces])
        cut = ~self.adjacent[data[:-1], data[1:]]
        cut[ends[:-1] - 1] = True
        bounds = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(data)]])
        raw, known = data.tobytes(), _Pieces({bytes([x]): x for x in range(256)})
        which = np.fromiter((known[raw[i:j]] for i, j in itertools.pairwise(bounds.tolist())), dtype=np.int64, count=len(bounds) - 1)
        fragments = list(known)[256:]
        tokens: list[np.ndarray] = [*self.of_byte.reshape(-1, 1), *[self.of_byte[:0]] * len(fragments)]
        short = [i for i, x in enumerate(fragments) if len(x) <= SHORT]
        work = np.cumsum([len(fragments[i]) ** 2 for i in short])
        for own in np.split(np.array(short, dtype=np.int64), np.flatnonzero(np.diff(work // STATES)) + 1) if short else []:
            for i, found in zip(own, self._short([fragments[i] for i in own]), strict=True):
                tokens[256 + i] = found
        for i, x in enumerate(fragments):
            if len(x) > SHORT:
                tokens[256 + i] = self._long(x)
        flat, upto = _gathered(which, np.array([len(x) for x in tokens], dtype=np.int64), np.concatenate(tokens))
        return flat, np.diff(upto[np.searchsorted(bounds, ends) - 1], prepend=0)

    def learn(self) -> None:
        """Finds the tokens of the pieces that were numbered since."""
        raw = [x.encode("utf-8", "surrogatepass") for x in itertools.islice(self.pieces, len(self.sizes), None)]
        whole = np.array([self.ranks.get(x, -1) for x in raw], dtype=np.int32)
        sizes = np.ones(len(raw), dtype=np.int64)
        if (whole < 0).any():
            flat, sizes[whole < 0] = self.merge([x for x, n in zip(raw, whole, strict=True) if n < 0])
        tokens = np.repeat(whole, sizes)
        tokens[tokens < 0] = flat if (whole < 0).any() else 0
        self.sizes = np.concatenate([self.sizes, sizes])
        self.tokens = np.concatenate([self.tokens, tokens])

    def _encoded(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), of texts that are split into pieces."""
        if len(self.pieces) > CACHE:
            self.forget()
        pieces = [list(map(self.pieces.__getitem__, x)) for x in texts]
        if len(self.pieces) > len(self.sizes):
            self.learn()
        each = np.array([len(x) for x in pieces], dtype=np.int64)
        flat = np.fromiter((i for x in pieces for i in x), dtype=np.int64, count=int(each.sum()))
        tokens, ends = _gathered(flat, self.sizes, self.tokens)
        return tokens, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after another; offsets of the texts in them."""
        if len(texts) > 1 or not texts or len(texts[0]) <= SLICE:
            return self._encoded([self.pattern.findall(x) for x in texts])
        found, runs = self.pattern.finditer(texts[0]), []
        while run := [m[0] for m in itertools.islice(found, PIECES)]:
            runs.append(self._encoded([run])[0])
        tokens = np.concatenate(runs)
        return tokens, np.array([0, len(tokens)])

    def decode(self, tokens: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text of tokens."""
        sizes, tokens = np.diff(offsets), np.asarray(tokens, dtype=np.int32)
        out: list[list[bytes]] = [[] for _ in sizes]
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for a in range(0, len(tokens), TOKENS):
            ids = tokens[a : a + TOKENS]
            self.db.register("tokens", pa.table({"text": text[a : a + TOKENS], "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
            for n, chars in self.db.execute(_DECODE).fetchall():
                out[n].append(chars.encode("latin-1"))
            self.db.unregister("tokens")
        return [b"".join(x) for x in out]


_CODECS: dict[tuple[str | None, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """This process's codec of a rank file; by default the public 50k byte-level vocabulary."""
    import public_tokenizers

    key = (path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= SLICE:
            size += len(texts[b])
            b += 1
        yield a, b
        a = b


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: id, ids (array of int). A null text is empty and has no ids; null ids and repeated rows are kept; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                tokens, offsets = own.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens))], names=["_id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(run, "_id long, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of encoded: id, bytes (binary). Null ids are none; they and empty ones give empty bytes. An id outside the vocabulary gives no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = [x or [] for x in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                raw = own.decode(np.array([i for x in ids for i in x], dtype=np.int32), offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["_id", "bytes"])

    rows = encoded.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "_id long, bytes binary").withColumnRenamed("_id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of the bytes that the ids give back).

    What encode() and decode() do, without the ids leaving the worker in between. A null text is an
    empty one; null ids and repeated rows are kept; an empty table gives an empty table. Other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(path, pattern), lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                tokens, offsets = own.encode(texts[a:b])
                raw, little = own.decode(tokens, offsets), tokens.astype("<u4")
                ids = [sha(little[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets), pa.int64()), pa.array(ids), pa.array([sha(x) for x in raw])], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _source(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
