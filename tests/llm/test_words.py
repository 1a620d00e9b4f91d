"""Operators 11, 12 and 13 against plain loops and held-out accuracy, with nulls, empty, long and repeated rows, ties, clashing names and empty tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import language, search, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "doc_id long, text string, lang string, score string, id string, word string, n string, shard string, lang_pred string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, *"abcdefg") for i, t, lang in rows], CLASH)


# --- 11 --------------------------------------------------------------------------------------


def plain_vector(text):
    """The sum over all places of the product of rotated letter vectors."""
    keep = lambda c: __import__("unicodedata").category(c)[0] in "LM"
    codes = [0]
    for c in text.lower():
        code = ord(c) if keep(c) else 0
        if code or codes[-1]:
            codes.append(code)
    codes += [0] if codes[-1] else []
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        total += np.roll(language.letter_vector(a), 2).astype(int) * np.roll(language.letter_vector(b), 1) * language.letter_vector(c)
    return total


@pytest.mark.parametrize("piece, cache", [(1 << 19, 16_384), (7, 8)])
def test_vectors_equal_plain_sums(monkeypatch, piece, cache):
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "CACHE", cache)
    random.seed(1)
    space = language.Space()
    for text in ["a", "Is", "", "  ", "12 -- 3", "Ünï 77 x", "日本語のテキスト", "हिन्दी", "İstanbul ß", *("".join(random.choice("abcd éß. 7\n") for _ in range(random.randint(0, 80))) for _ in range(40))]:
        total, lettered = space.vector(text)
        assert lettered == any(c.isalpha() for c in text)
        if lettered:
            assert (total == plain_vector(text)).all()


def test_languages_of_held_out_texts(spark):
    random.seed(2)
    syllables = {"aa": "ba ko mi tu sel", "bb": "schu ver ein ung heit", "cc": "ción ado mente ra los"}
    say = lambda lang, n: " ".join("".join(random.choices(syllables[lang].split(), k=random.randint(1, 3))) for _ in range(n)).capitalize()
    rows = [(i, say(lang, random.randint(4, 40)), lang) for i in range(120) for lang in [random.choice(list(syllables))]]
    odd = [(None, None, "aa"), (500, "", "aa"), (501, "123 !!", "bb"), (502, say("bb", 20_000), "bb"), (502, say("bb", 3), None), (503, "12", "dd"), (1, rows[1][1], rows[1][2])]
    train = table(spark, rows + odd)
    profiles = language.fit(train)
    assert profiles.languages == ("aa", "bb", "cc")  # dd has no letters
    test = [(1000 + i, say(lang, random.randint(3, 20)), lang) for i in range(150) for lang in [random.choice(list(syllables))]]
    got = language.predict(table(spark, test + odd), profiles).collect()
    assert len(got) == len(test) + len(odd) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in test}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (None, 500, 501, 503)} == {(None, "und", 0.0), (500, "und", 0.0), (501, "und", 0.0), (503, "und", 0.0)}
    assert [r.lang_pred for r in got if r.doc_id == 502] == ["bb", "bb"]
    bundles = {lang: sum(plain_vector(t) for _, t, own in rows + odd if own == lang and t and any(c.isalpha() for c in t) and len(t) < 5000) for lang in ("aa", "cc")}
    for lang, bundle in bundles.items():
        assert np.allclose(profiles.prototypes[profiles.languages.index(lang)], bundle / np.linalg.norm(bundle))
    assert language.predict(train.where("1 = 0"), profiles).count() == 0
    nothing = language.fit(train.where("1 = 0"))
    assert {(r.lang_pred, r.score) for r in language.predict(train, nothing).collect()} == {("und", 0.0)}


# --- 12 --------------------------------------------------------------------------------------


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if plain_near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def words_like(rng, letters, n):
    some = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(n)]
    return some + [w[:i] + rng.choice(letters) + w[i + rng.randint(0, 1) :] for w in some for i in [rng.randrange(len(w))]]


@pytest.mark.parametrize("shard, queries, batch", [(1 << 16, 1 << 17, 4096), (40, 25, 7)])
def test_spelling_groups_equal_all_pairs(spark, monkeypatch, shard, queries, batch):
    for name, value in (("SHARD", shard), ("QUERIES", queries), ("BATCH", batch)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(3)
    words = {*words_like(rng, "aab", 60), *words_like(rng, "abcé÷ß", 120), "aaaaa", "aaaaaa", "aaaaaaa", "a" * 300, "a" * 301, "ab" * 150, "𝒳xyzw", "𝒴xyzw"}
    counts = {w: rng.choice([3, 3, 4, 6, 12, 50]) for w in words}
    got = spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", spelling.F.lit("clash")))
    assert {tuple(r) for r in got.collect()} == plain_groups(counts)
    assert spelling.grouped(spark.createDataFrame([], "word string, n long")).count() == 0
    assert [tuple(r) for r in spelling.grouped(spark.createDataFrame([("alone", 3), (None, 9)], "word string, n long")).collect()] == [("alone", None, "alone", 3, 0, None)]


def test_automaton_numbers_are_ranks():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(400)})
    own = spelling.Automaton(words)
    assert len(own.final) < len({w[:i] for w in words for i in range(len(w) + 1)})  # fewer states than the trie
    for number, word in enumerate(words):
        state, n = own.root, 0
        for c in word:
            there, edge = own.step(np.array([state]), np.array([ord(c)]))
            assert len(there)
            n, state = n + int(own.skip[edge[0]]), int(own.target[edge[0]])
        assert own.final[state] and n == number


def test_vocabulary_equals_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 20)
    rng = random.Random(5)
    pool = ["Straße", "ÉCOLE", "École", "naïve", "hello", "HELLO", "wörd×s", "ab", "c", "İstanbul", "long" * 30]
    rows = [(None, None, None), (1, "", None), (2, "  12 ", None), *((i, " ".join(rng.choices(pool, k=rng.randint(1, 60))), None) for i in range(300))]
    rows += rows[5:9] + [(None, "hello hello", None)]
    want = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
            want[word] += 1
    got = {r.word: r.n for r in spelling.vocabulary(table(spark, rows), alter=spelling.altered).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3} and any(w not in [p.translate(LOWER) for p in pool] for w in got)
    assert spelling.vocabulary(table(spark, rows).where("1 = 0")).count() == 0


# --- 13 --------------------------------------------------------------------------------------


def plain_search(docs, items, limit=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    found = [(i, Counter(terms(t))) for i, t, _ in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    queries = defaultdict(set)
    for i, t in items:
        queries[i] |= set(terms(t))
    out = Counter()
    for item, own in queries.items():
        scored = []
        for i, c, n in found:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0))
        for rank, (score, null, i) in enumerate(sorted(scored)[:limit], 1):
            out[item, rank, None if null else i, -score] += 1
    return out


@pytest.mark.parametrize("block, held, terms, piece", [(64, 256, 1_000_000, 1 << 22), (3, 2, 12, 40)])
def test_search_equals_brute_force(spark, monkeypatch, block, held, terms, piece):
    for name, value in (("BLOCK", block), ("HELD", held), ("TERMS", terms), ("PIECE", piece)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(6)
    pool = ["The", "the", "of", "Été", "x9", "rare1", "rare2", "日本", "İ", *[f"w{k}" for k in range(40)]]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60))), None) for i in range(300)]
    docs += [(None, None, None), (None, "the rare1", None), (None, "the rare1", None), (7, docs[7][1], None), (900, "- !! ", None), (901, "rare2 " * 3000 + "w1", None)]
    docs += [(1000 + k, "rare1 copy of w3", None) for k in range(120)]  # ties beyond the limit
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere"), (23, "RARE1 rare1"), (None, "w1 w2"), (24, "rare2"), (24, "w5")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, score string")
    got = search.search(table(spark, docs).repartition(5), frame)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain_search(docs, items)
    assert search.search(table(spark, docs), frame.where("1 = 0")).count() == 0
    assert search.search(table(spark, docs).where("1 = 0"), frame).count() == 0


def test_bounds_hold_and_few_blocks_are_scored(spark, monkeypatch):
    """No document scores over its block's bound, and blocks under the threshold are left out."""
    rng = random.Random(7)
    monkeypatch.setattr(search, "BLOCK", 8)
    docs = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=20)), None) for i in range(400)] + [(1000 + i, "w1 w2 w3", None) for i in range(8)]
    queries = search.Queries.of([(1, ["w1", "w2", "w3"]), (2, ["w9"])])
    forward = search.forward_index(table(spark, docs).coalesce(1), queries.number)
    n_docs, n_terms = len(docs), 400 * 20 + 24
    queries.weights = np.array([700, 800, 900, 5])
    blocks = search.with_maxima(forward, n_docs, n_terms).collect()
    mine, over = np.zeros(len(queries.number), dtype=np.int64), Counter()
    best = max(int(queries.scores(0, *(np.array(x, dtype=np.int64) for x in (b.sizes, b.terms, b.impacts)), mine).max()) for b in blocks)
    for b in blocks:
        bounds = queries.bounds(np.array(b.max_terms), np.array(b.max_impacts))
        for q in (0, 1):
            scores = queries.scores(q, *(np.array(x, dtype=np.int64) for x in (b.sizes, b.terms, b.impacts)), mine)
            assert scores.max() <= bounds[q] and not mine.any()
        over["scored" if bounds[0] >= best else "left out"] += 1
    assert over["left out"] > over["scored"] >= 1
