"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS entries 1 and -1, drawn from a hash of the letter. An
n-gram binds its letters' vectors, each rotated by its place, by entry-wise products; a text's vector
bundles (sums) those of its n-grams, and a language's prototype those of its labelled texts. A text
has the language whose prototype has the largest cosine with it.

Letters are those of any script, in lower case, with their combining marks; whatever stands between
words is one gap, a letter of its own, also at both ends of a text.

Scale: both passes read each text once, inside its row; texts are never shuffled. A task of fit()
sends one row per language and entry, summed on the way. The prototypes are sent to the workers; they
are bounded by MAX_LANGUAGES, not by the corpus. A worker keeps at most CACHE vectors of n-grams and
forgets them all when they are more, which changes nothing but speed; long texts are read in pieces.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAM = 3
#: Code points that are laid out at once; a sum of as many ones is exact in single precision.
PIECE = 1 << 19
CACHE = 16_384
#: More than there are codes of languages (ISO 639-3 has about 7,900): the prototypes stay under 70 MB.
MAX_LANGUAGES = 8192
UNKNOWN = "und"

_BITS = 21  # of a code point


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """By code point: itself if it is a letter or mark, else 0; and whether it is a letter."""
    kind = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    number = np.arange(0x110000, dtype=np.int64)
    return np.where(np.isin(kind, ["L", "M"]), number, 0), np.array([x == "L" for x in kind])


def letter_vector(code: int) -> np.ndarray:
    """The vector of a code point; 0 is the gap."""
    bits = np.frombuffer(hashlib.shake_128(b"letter %d" % code).digest(DIMENSIONS // 8), dtype=np.uint8)
    return (np.unpackbits(bits).astype(np.int8) * 2 - 1).astype(np.int8)


class Space:
    """A worker's vectors of n-grams."""

    def __init__(self) -> None:
        self.symbols, self.letters = _kinds()
        self.of_letter: dict[int, np.ndarray] = {}
        self.room = np.zeros((CACHE // 2, DIMENSIONS), dtype=np.float32)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.int64)  # sorted, with the place of each one's vector
        self.places = np.zeros(0, dtype=np.int64)
        self.vectors = np.zeros((CACHE, DIMENSIONS), dtype=np.float32)

    def made(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of n-grams."""
        out = np.ones((len(keys), DIMENSIONS), dtype=np.int8)
        for place in range(GRAM):
            codes, which = np.unique((keys >> (_BITS * place)) & ((1 << _BITS) - 1), return_inverse=True)
            for c in codes.tolist():
                if c not in self.of_letter:
                    self.of_letter[c] = letter_vector(c)
            out *= np.stack([np.roll(self.of_letter[c], place) for c in codes.tolist()])[which]
        if len(self.of_letter) > CACHE:
            self.of_letter.clear()
        return out.astype(np.float32)

    def bundled(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct n-grams, each as often as counted; keys are sorted."""
        total = np.zeros(DIMENSIONS)
        for a in range(0, len(keys), CACHE // 2):
            part, n = keys[a : a + CACHE // 2], counts[a : a + CACHE // 2].astype(np.float32)
            at = np.searchsorted(self.keys, part)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == part[known]
            if not known.all():
                if len(self.keys) + int((~known).sum()) > CACHE:
                    self.forget()
                    known[:] = False
                new = part[~known]
                self.vectors[len(self.keys) : len(self.keys) + len(new)] = self.made(new)
                keys_, places = np.concatenate([self.keys, new]), np.concatenate([self.places, len(self.keys) + np.arange(len(new))])
                order = np.argsort(keys_, kind="stable")
                self.keys, self.places = keys_[order], places[order]
                at = np.searchsorted(self.keys, part)
            total += n @ np.take(self.vectors, self.places[at], axis=0, out=self.room[: len(part)], mode="clip")
        return total

    def grams(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Sorted distinct n-grams, how often each occurs, and whether there are letters, of each piece of a text."""
        text, before = text.lower(), np.zeros(1, dtype=np.int64)
        for a in range(0, len(text), PIECE):
            points = np.frombuffer(text[a : a + PIECE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
            codes = np.concatenate([before, self.symbols[points], np.zeros(1 if a + PIECE >= len(text) else 0, dtype=np.int64)])
            keep = (codes[1:] != 0) | (codes[:-1] != 0)
            codes = np.concatenate([codes[:1], codes[1:][keep]])
            before = codes[1 - GRAM :]
            keys = sum(codes[k : len(codes) - GRAM + 1 + k] << (_BITS * (GRAM - 1 - k)) for k in range(GRAM))
            if len(codes) >= GRAM:
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                yield keys[first], np.diff(first, append=len(keys)), bool(self.letters[points].any())

    def vector(self, text: str) -> tuple[np.ndarray, bool]:
        """A text's vector, and whether it has letters."""
        total, lettered = np.zeros(DIMENSIONS), False
        for keys, counts, letters in self.grams(text):
            total += self.bundled(keys, counts)
            lettered |= letters
        return total, lettered


_SPACES: list[Space] = []


def space() -> Space:
    """This process's vectors."""
    if not _SPACES:
        _SPACES.append(Space())
    return _SPACES[0]


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and the unit vector of each."""

    languages: tuple[str, ...]
    prototypes: np.ndarray


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """A prototype of each language from all rows of labelled with a text and a language.

    Rows without either are passed over, as are languages none of whose texts has a letter; repeated
    rows count as often as they stand. No rows give no languages. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bundles, held, size = space(), {}, {}, 0

        def flush(lang: str) -> int:
            keys, counts = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            distinct, which = np.unique(keys, return_inverse=True)
            summed = np.bincount(which, weights=counts).astype(np.int64)
            for shift in range(0, int(summed.max()).bit_length(), 20):  # exact in single precision, however large the counts are
                bundles[lang] = bundles.get(lang, 0) + own.bundled(distinct, (summed >> shift) & 0xFFFFF).astype(np.int64) * (1 << shift)
            return 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for keys, counts, _ in own.grams(text):
                    held.setdefault(lang, []).append((keys, counts))
                    size += len(keys)
                if size > PIECE:
                    size = sum(flush(x) for x in list(held))
        for lang in list(held):
            flush(lang)
        for lang, bundle in bundles.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(bundle, pa.int64())], names=["lang", "entry", "value"])

    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInArrow(run, "lang string, entry int, value long").groupBy("lang", "entry").agg(F.sum("value").alias("value"))
    got = sums.limit(MAX_LANGUAGES * DIMENSIONS + 1).toPandas()
    if len(got) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    table = got.pivot(index="lang", columns="entry", values="value").sort_index() if len(got) else got
    matrix = table.to_numpy(dtype=np.float64).reshape(-1, DIMENSIONS) if len(got) else np.zeros((0, DIMENSIONS))
    length = np.linalg.norm(matrix, axis=1)
    return Profiles(tuple(x for x, n in zip(table.index, length, strict=True) if n) if len(got) else (), matrix[length > 0] / length[length > 0, None])


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", also: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of also, lang_pred, score.

    score: the largest cosine of the text's vector with a prototype, in 9 digits, at least 0; of equal
    ones the first language in order is taken. Where the text is null or has no letter, or no language
    was learnt, lang_pred is ``und`` and score 0. Null and repeated ids and repeated rows are kept; an
    empty table gives an empty table. Other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, languages, prototypes = space(), known.value.languages, known.value.prototypes
        for batch in batches:
            found, scores = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                total, lettered = own.vector(text) if text and languages else (None, False)
                length = np.linalg.norm(total) if lettered else 0.0
                cosines = np.round(prototypes @ (total / length), 9) if length else np.zeros(1)
                found.append(languages[int(cosines.argmax())] if length else UNKNOWN)
                scores.append(min(1.0, max(0.0, float(cosines.max()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias(id_col), *also, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
