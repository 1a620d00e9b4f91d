"""Toxicity by a Levenshtein automaton that is run together with a lexicon trie.

The lexicon has words and word stems. Its trie and the automaton are intersected as one lazily
determinised machine: a state is a set of (trie node, edits so far), its transitions are found when
first taken, and most words leave the machine after a few letters. So each different word is read
once, whatever the size of the lexicon, and misspelled terms are found with their distance.

Each hit is weighed by its context: inside quotation marks or after a word of reporting it counts as
quotation, after an address of the second person it counts for more. A logistic function of the
weighed sums is the score.

Learning: terms are picked by how much more often they stand in toxic than in clean texts; the
function's weights are fitted by Newton steps. Both use a bounded sample of labelled texts
(SAMPLE_TOXIC, SAMPLE_CLEAN: those with the smallest hashes of their ids), without near copies, so
that one often-copied text doesn't fill the lexicon. Scale: scoring has no shuffle; learning moves
only the sample, and the driver gets counted terms and a few numbers per sampled text. How many terms
there are follows from what counts as significant; only the sample bounds them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import checkpoint, text_of

#: Terms of abuse that are in the lexicon even where no sample has them.
SEEDS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown bastard asshole dumbass dummkopf arschloch abschaum connard salaud imbécile pendejo imbécil cabrón".split()
REPORTING = frozenset("said says wrote writes called quote quoted quotes quoting word term phrase insult sagte schrieb wort zitat dit écrit mot citation dijo escribió palabra cita".split())
SECOND_PERSON = frozenset("you your youre u du dich dein tu toi vous eres usted tú bist".split())
QUOTES = {"“": "”", "«": "»", "„": "“", "‹": "›"}
SAMPLE_TOXIC, SAMPLE_CLEAN = 8192, 16384
PREDICT = 0.7
WINDOW = 6
CACHE = 400_000
STATES = 50_000
_WORD = re.compile(r"[^\W_]+")
_SPELT = re.compile(r"(?:[^\W_]|[$@])+")  # words and the symbols that stand for letters
_LEET = str.maketrans("013457$@", "oieastsa")
#: Weights of the score before learning: bias, sum of the hits, their share of the words.
PRIOR = np.array([-3.5, 2.5, 1.0])


@dataclass
class Model:
    terms: list[tuple[str, bool, float]]  # (term, whether it is a stem, weight)
    weights: list[float] = field(default_factory=PRIOR.tolist)
    vetoes: frozenset[str] = frozenset()  # words near a term that clean texts use


def edits_allowed(term: str, stem: bool) -> int:
    return 0 if len(term) < (6 if stem else 5) else 2 if len(term) >= 9 and not stem else 1


class Machine:
    """The automaton run together with the trie. first: whether a term's first letter may be wrong too."""

    def __init__(self, terms: list[tuple[str, bool, float]], first: bool = False) -> None:
        self.first = first
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # of each node: (term, stem, edits allowed)
        self.allowed = [0]  # of each node: most edits of any term below it
        for t, (term, stem, _) in enumerate(terms):
            node, k = 0, edits_allowed(term, stem)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], k)
            self.ends[node].append((t, stem, k))
        if first:
            self.allowed[0] = max(self.allowed)
        self._clear()

    def _clear(self) -> None:
        """Forget the states that were met; they are found again when needed."""
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []  # (edits, term) if a word ends here
        self.stem: list[tuple[int, int] | None] = []  # (edits, term) if a stem ends here
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        todo = list(edits.items())
        while todo:  # letters of the term that the word leaves out
            node, e = todo.pop()
            if (node or self.first) and edits.get(node) == e:
                for child in self.children[node].values():
                    if e + 1 <= self.allowed[child] and edits.get(child, 99) > e + 1:
                        edits[child] = e + 1
                        todo.append((child, e + 1))
        if not edits:
            return -1
        key = tuple(sorted(edits.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            found = [(e, t, stem) for node, e in key for t, stem, k in self.ends[node] if e <= k]
            self.whole.append(min(((e, t) for e, t, stem in found if not stem), default=None))
            self.stem.append(min(((e, t) for e, t, stem in found if stem), default=None))
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        edits: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.allowed[node] and edits.get(node, 99) > e:
                edits[node] = e

        for node, e in self.states[state]:
            if node or self.first:
                reach(node, e + 1)  # a letter too many
            for letter, child in self.children[node].items():
                if letter == c:
                    reach(child, e)
                elif node or self.first:
                    reach(child, e + 1)  # a wrong letter
        to = self.moves[state][c] = self._state(edits)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, or None; a stem matches a word that begins like it."""
        if len(self.states) > STATES:
            self._clear()
        state, best, moves = self.start, None, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return best
            if (found := self.stem[state]) is not None and (best is None or found < best):
                best = found
        if (found := self.whole[state]) is not None and (best is None or found < best):
            best = found
        return best


class _Matches(dict):
    """The match of each word met, found once."""

    def __init__(self, machine: Machine, vetoes: frozenset[str]) -> None:
        super().__init__()
        self.machine, self.vetoes = machine, vetoes

    def __missing__(self, word: str) -> tuple[int, int] | None:
        found = self.machine.match(word)
        if found is None and not word.isalpha() and not word.isdigit():
            found = self.machine.match(word.translate(_LEET))
            found = found and (max(found[0], 1), found[1])
        if found is not None and found[0] and word in self.vetoes:
            found = None
        if len(self) > CACHE:
            self.clear()
        self[word] = found
        return found


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.matches = model, _Matches(Machine(model.terms, first=True), model.vetoes)

    def hits(self, text: str) -> tuple[int, list[tuple[str, int, int, float]]]:
        """Words of the text; (word, edits, term, weight of its context) of each hit, under 0.5: quotation."""
        low = text.lower()
        spans = self._spans(low) if "$" in low or "@" in low else None
        words = [low[a:b] for a, b in spans] if spans is not None else _WORD.findall(low)
        found = [i for i, x in enumerate(map(self.matches.__getitem__, words)) if x is not None]
        if not found:
            return len(words), []
        spans = spans if spans is not None else [m.span() for m in _WORD.finditer(low)]
        out = []
        for i in found:
            edits, term = self.matches[words[i]]
            before = words[max(0, i - WINDOW) : i]
            weight = 0.3 if self._quoted(low, *spans[i]) or not REPORTING.isdisjoint(before) else 1.25 if not SECOND_PERSON.isdisjoint(before[-3:]) else 1.0
            out.append((words[i], edits, term, weight))
        return len(words), out

    def _spans(self, text: str) -> list[tuple[int, int]]:
        """Where words stand; $ and @ are letters of a word that is a term with them and has no term without."""
        spans = []
        for m in _SPELT.finditer(text):
            parts = [x.span() for x in _WORD.finditer(text, *m.span())]
            symbols = len(parts) != 1 or parts[0] != m.span()
            if symbols and any(map(str.isalpha, m[0])) and all(self.matches[text[a:b]] is None for a, b in parts) and self.matches[m[0]] is not None:
                spans.append(m.span())
            else:
                spans += parts
        return spans

    @staticmethod
    def _quoted(text: str, start: int, end: int) -> bool:
        """Whether quotation marks of the same line enclose the place."""
        begin, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        head, tail = text[begin:start], text[end : len(text) if stop < 0 else stop]
        if head.count('"') % 2 and '"' in tail:
            return True
        return any(0 <= head.rfind(a) > head.rfind(b) and b in tail for a, b in QUOTES.items())

    def features(self, text: str) -> np.ndarray:
        n, hits = self.hits(text)
        # A misspelled hit counts less by its edits; quotation by its context.
        abuse = sum(self.model.terms[term][2] * weight / (1 + edits) for _, edits, term, weight in hits)
        return np.array([1.0, math.log1p(abuse), math.log1p(1000 * abuse / n) / 7 if n else 0.0])

    def score(self, text: str) -> float:
        return float(1 / (1 + math.exp(-max(-60.0, min(60.0, float(self.features(text) @ np.asarray(self.model.weights)))))))


_SCORERS: dict[int, tuple[Model, Scorer]] = {}


def _scorer(model: Model) -> Scorer:
    """A worker's scorer of a model, with the words it has met."""
    key = hash((tuple(model.terms), tuple(model.weights), model.vetoes))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = (model, Scorer(model))
    return _SCORERS[key][1]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sketch(text: str) -> int:
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, toxic of the labelled texts that are learnt from: none that is held out, a bounded number, one of each group of near copies."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    part = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(n)
    ids = F.broadcast(part(1, SAMPLE_TOXIC).union(part(0, SAMPLE_CLEAN)))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(ids, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_sketch(x) for x in batch.column(0).to_pylist()], pa.int64()), batch.column(0), batch.column(1)], names=["sketch", "text", "toxic"])

    sketched = texts.select("text", F.col("toxic").cast("int")).mapInArrow(run, "sketch long, text string, toxic int")
    return checkpoint(sketched.groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))


def _counted(rows: DataFrame, terms_of, least: int) -> DataFrame:
    """term, toxic, clean: in how many texts a term stands; terms_of: a set for a text. Each task counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = list({**counts[1], **counts[0]})
            columns = [pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "clean"])

        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(terms_of(text))
                if len(counts[0]) + len(counts[1]) > CACHE:
                    yield out()
                    counts[0].clear()
                    counts[1].clear()
        yield out()

    parts = rows.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= least)


def _parts(text: str) -> set[str]:
    """The words of a text (with a final $) and their first 3 to 8 letters."""
    out: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        out.add(word + "$")
        out.update(word[:k] for k in range(3, min(len(word), 8) + 1))
    return out


def choose_terms(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Of candidates (term, toxic, clean) those that tell most, none of which begins another; then the seeds that are left."""
    weighed = []
    for term, toxic, clean in counts:
        lift = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
        if lift >= 3.0 and toxic >= 3 * clean:
            weighed.append((toxic * lift, len(term), term, min(6.0, lift)))
    chosen: list[tuple[str, bool, float]] = []
    taken: set[str] = set()  # what the chosen begin with, they themselves included
    bare: set[str] = set()
    for _, _, term, weight in sorted(weighed, reverse=True):
        word = term.rstrip("$")
        if word in taken or any(word[:k] in bare for k in range(1, len(word) + 1)):
            continue
        chosen.append((word, not term.endswith("$"), weight))
        bare.add(word)
        taken.update(word[:k] for k in range(1, len(word) + 1))
    seen = {term.rstrip("$"): clean for term, _, clean in counts if term.endswith("$")}
    return chosen + [(x, False, 2.0) for x in SEEDS if x not in taken and not seen.get(x)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learnt from the labelled texts that are not held out. With no toxic sample it has the seeds and the prior weights."""
    rows = sample(docs, labels, id_col, text_col)
    totals = dict(rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(choose_terms([], n_toxic, n_clean))
    found = _counted(rows, _parts, max(3, n_toxic // 100)).where("toxic >= 3 * clean")
    model = Model(choose_terms([tuple(x) for x in found.collect()], n_toxic, n_clean))

    def near(text: str) -> set[str]:
        return {word for word, edits, _, _ in _scorer(model).hits(text)[1] if edits}

    vetoes = _counted(rows, near, 0).where("clean > 0 AND clean >= toxic")
    model.vetoes = frozenset(x.term for x in vetoes.collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            values = np.array([scorer.features(x) for x in batch.column(0).to_pylist()]).reshape(-1, len(PRIOR))
            yield pa.RecordBatch.from_arrays([*(pa.array(values[:, i]) for i in range(len(PRIOR))), batch.column(1)], names=[*(f"x{i}" for i in range(len(PRIOR))), "toxic"])

    # A few different rows of numbers, counted; the sample bounds them.
    schema = ", ".join(f"x{i} double" for i in range(len(PRIOR))) + ", toxic int"
    data = np.array([tuple(x) for x in rows.mapInArrow(run, schema).collect()], dtype=np.float64)
    x, y, weights = data[:, :-1], data[:, -1], PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(PRIOR)), x.T @ (y - p) - (weights - PRIOR))
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    # Hits never speak against toxicity.
    weights[1:] = np.maximum(weights[1:], 0.0)
    model.weights = weights.tolist()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted (1 if score >= PREDICT).

    A null or empty text has the score of one without hits. Null and repeated ids and rows are kept;
    other columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            scores = np.array([scorer.score(x) for x in batch.column(2).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= PREDICT).astype(np.int32))], names=["_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(run, "_id long, held_out boolean, score double, predicted int").withColumnRenamed("_id", id_col)


def kept_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score() doesn't predict toxic, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([scorer.score(x or "") < PREDICT for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
