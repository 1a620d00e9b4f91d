"""Spelling variants by two minimal acyclic automata, one of the words and one of the words backward.

A word that is one error away from another shares its first or its second half with it. So a word is
looked up twice: its first half must match the forward automaton exactly, and the rest is completed
with one error; its second half, read backward, must match the backward automaton, and the rest is
completed with one error. An automaton's word numbers (the rank of a word, from counts on its edges:
a perfect hash) stand for the words that are found; what is found by several alignments is one number,
and what the forward lookup has found is left out of the backward one.

Scale: the vocabulary is the only thing that is shuffled, never texts. Words sorted (forward, and
backward) are dealt by range, so every range is an automaton of about SHARD words whatever prefixes
are frequent, and words are looked up in the ranges that their half reaches. Where more than QUERIES
words look into a range, they are split over copies of it, so no task holds more than about both
bounds. The driver gets the first and last word of each range only.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpoint, text_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
MIN_LENGTH = 5
MIN_COUNT = 3
#: A word's form must be at least so many times as frequent as the word.
RATIO = 2
SHARD = 1 << 16
QUERIES = 1 << 17
#: Words that are looked up at once; words that a task counts before it sends them on; code points that are split at once.
BATCH = 4096
HELD = 200_000
PIECE = 1 << 20

_BITS = 21  # of a code point
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def runs_of(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters, A-Z in lower case; a long text in pieces that part no run."""
    text, a = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"), 0
    while a < len(text):
        gap = GAP.search(text, a + PIECE)
        b = gap.start() if gap else len(text)
        yield RUN.findall(text, a, b)
        a = b


def altered(doc_id: str, runs: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Each run, and what it becomes in this document: where 97 divides the checksum of both, it loses the letter that the checksum points at."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run in runs:
        h = zlib.crc32(run.encode(), start)
        yield run, run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def unaltered(doc_id: str, runs: Iterable[str]) -> Iterator[tuple[str, str]]:
    for run in runs:
        yield run, run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, alter: Callable[[str, Iterable[str]], Iterator[tuple[str, str]]] = unaltered) -> DataFrame:
    """word, n of all words of at least min_length code points and min_count occurrences; alter may change a document's words.

    A null text has no words, a null id is an empty one; repeated rows count as often as they stand.
    Other columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for runs in runs_of(text):
                    counts = Counter(runs)
                    for run, word in alter(doc_id, counts):
                        if len(word) >= min_length:
                            held[word] += counts[run]
                    if len(held) > HELD:
                        yield sent()
        yield sent()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, as arrays; a word's number is its rank among them."""

    def __init__(self, words: list[str]) -> None:
        states: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]  # states that may still grow
        before: list[int] = []

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                path[-1][1].append((before[len(path) - 1], states.setdefault((final[0], tuple(edges)), len(states))))

        for word in words:
            codes = [ord(c) for c in word]
            common = 0
            for a, b in zip(before, codes, strict=False):
                if a != b:
                    break
                common += 1
            close(common)
            path.extend(([False], []) for _ in codes[common:])
            path[-1][0][0] = True
            before = codes
        close(0)
        self.root = len(states)
        made = [*states, (path[0][0][0], tuple(path[0][1]))]
        self.final = np.array([final for final, _ in made])
        degrees = np.array([len(edges) for _, edges in made])
        self.start = np.concatenate([[0], np.cumsum(degrees)])
        flat = np.array([e for _, edges in made for e in edges], dtype=np.int64).reshape(-1, 2)
        self.letter, self.target = flat[:, 0], flat[:, 1]
        self.keys = (np.repeat(np.arange(len(made)), degrees) << _BITS) | self.letter  # in order, as states and letters are
        below, self.skip = [0] * len(made), np.zeros(len(flat), dtype=np.int64)
        for s, (final, edges) in enumerate(made):  # targets come before their sources
            n, e = int(final), int(self.start[s])
            for k, (_, t) in enumerate(edges):
                self.skip[e + k] = n
                n += below[t]
            below[s] = n
        self.size = max(1, below[-1])

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states have an edge of the letter, and the edges of those."""
        keys = (state << _BITS) | letter
        at = np.searchsorted(self.keys, keys)
        there = np.flatnonzero(at < len(self.keys))
        there = there[self.keys[at[there]] == keys[there]]
        return there, at[there]

    def near(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a word, number): the automaton's words at one error from a word, with its first ``half`` code points."""
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        q = np.arange(len(words))
        state, number = np.full(len(words), self.root), np.zeros(len(words), dtype=np.int64)
        for k in range(int(halves.max(initial=0))):
            walking = halves[q] > k
            there, edge = self.step(state[walking], codes[begin[q[walking]] + k])
            stay, moved = ~walking, np.flatnonzero(walking)[there]
            q = np.concatenate([q[stay], q[moved]])
            state, number = np.concatenate([state[stay], self.target[edge]]), np.concatenate([number[stay], number[moved] + self.skip[edge]])
        exact, erring = (q, state, number), (q[:0], state[:0], number[:0])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        level = 0
        join = lambda *parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        def letters(q: np.ndarray) -> np.ndarray:
            """The next letter of each word; -1 at its end."""
            at = halves[q] + level
            return np.where(at < sizes[q], codes[np.minimum(begin[q] + at, len(codes) - 1)], -1)

        while len(exact[0]) or len(erring[0]):
            q, state, number = exact
            degree = self.start[state + 1] - self.start[state]
            of = np.repeat(np.arange(len(q)), degree)
            edge = np.arange(len(of)) - np.repeat(np.cumsum(degree) - degree, degree) + self.start[state][of]
            own = letters(q)
            reached = (q[of], self.target[edge], number[of] + self.skip[edge])
            erring = join(erring, reached)  # one letter more
            more = own >= 0
            other = more[of] & (self.letter[edge] != own[of])
            late = join(tuple(x[other] for x in reached), tuple(x[more] for x in exact))  # another letter, one letter less
            same = more[of] & ~other
            exact = tuple(x[same] for x in reached)
            if len(erring[0]) > len(words):  # what several alignments have reached is one
                _, first = np.unique((erring[0] * len(self.final) + erring[1]) * self.size + erring[2], return_index=True)
                erring = tuple(x[first] for x in erring)
            q, state, number = erring
            own = letters(q)
            done = (own < 0) & self.final[state]
            found.append((q[done], number[done]))
            on = np.flatnonzero(own >= 0)
            there, edge = self.step(state[on], own[on])
            erring = join((q[on][there], self.target[edge], number[on][there] + self.skip[edge]), late)
            level += 1
        q, number = join(*found) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        both = np.unique((q << 32) | number)
        return both >> 32, both & 0xFFFFFFFF


def _looked_up(words: DataFrame, backward: bool) -> DataFrame:
    """word, n_near, best (-n, word): what a direction finds in each range for each word; words: word, n."""
    size = words.count()
    key = F.reverse("word") if backward else F.col("word")
    ranged = checkpoint(words.select("word", "n", key.alias("key")).repartitionByRange(max(1, -(-size // SHARD)), "key").withColumn("shard", F.spark_partition_id()))
    bounds = sorted((r.least, r.most, r.shard) for r in ranged.groupBy("shard").agg(F.min("key").alias("least"), F.max("key").alias("most")).collect())
    least, most, number = [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shards = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                half = word[::-1][: len(word) - len(word) // 2] if backward else word[: len(word) // 2]
                reach = range(bisect_left(most, half), bisect_right(least, half + "\U0010ffff"))
                at += [i] * len(reach)
                shards += [number[k] for k in reach]
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shards, pa.int32())], names=["word", "shard"])

    queries = ranged.select("word").mapInArrow(routed, "word string, shard int")
    asked = checkpoint(queries)
    copies = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("copies"))
    # One row for each range: as many as the driver has bounds of.
    copied = ranged.join(F.broadcast(copies), "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("shard", "copy", "word", "n")
    spread = asked.join(F.broadcast(copies), "shard").withColumn("copy", F.pmod(F.xxhash64("word"), F.col("copies")).cast("int")).select("shard", "copy", "word")

    def search(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, int, int, str]] = []
        if len(known) and len(asked):
            turn = (lambda w: w[::-1]) if backward else (lambda w: w)
            held = sorted(zip(map(turn, known["word"]), known["n"], strict=True))
            automaton, n = Automaton([w for w, _ in held]), np.array([x for _, x in held])
            order = np.empty(len(held), dtype=np.int64)  # by number: place among the words, most frequent first
            order[sorted(range(len(held)), key=lambda i: (-n[i], turn(held[i][0])))] = np.arange(len(held))
            at_place = np.argsort(order)
            words = asked["word"].tolist()
            for a in range(0, len(words), BATCH):
                part = words[a : a + BATCH]
                halves = np.array([len(w) - len(w) // 2 if backward else len(w) // 2 for w in part])
                q, found = automaton.near([turn(w) for w in part], halves)
                if backward:  # what shares the first half as well is found forward
                    new = np.array([turn(held[i][0])[: len(part[k]) // 2] != part[k][: len(part[k]) // 2] for k, i in zip(q.tolist(), found.tolist(), strict=True)], dtype=bool)
                    q, found = q[new], found[new]
                if len(q):
                    firsts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                    best = at_place[np.minimum.reduceat(order[found], firsts)]
                    counts = np.diff(firsts, append=len(q))
                    out += [(part[k], c, -int(n[b]), turn(held[b][0])) for k, c, b in zip(q[firsts].tolist(), counts.tolist(), best.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["word", "n_near", "less", "near"])

    keys = ["shard", "copy"]
    return copied.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(search, "word string, n_near long, less long, near string")


def grouped(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of vocabulary (distinct word of two code points or more, n).

    Two words are near if one inserted, deleted or replaced code point makes one the other. form: the
    near word with the largest n, of equal ones the first in code-point order, if its n is at least
    ratio times the word's; else null. root: the last of the forms that follow from the word, or the
    word. n_near: the number of near words. form_n: the form's n. An empty vocabulary gives an empty table.
    """
    words = checkpoint(vocabulary.select("word", "n").where("word IS NOT NULL"))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("less"), F.lit(None).cast("string").alias("near"))
    both = own.unionByName(_looked_up(words, False).withColumn("n", F.lit(None).cast("long"))).unionByName(_looked_up(words, True).withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("less", "near"))).alias("best")
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    rows = checkpoint(found.select("word", "n", "n_near", F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    # Pointer doubling: a form is twice as frequent as its word, so chains are as long as the logarithm of the largest n.
    links = checkpoint(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpoint(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
