"""Operators 1, 2, 3, 5, 6, 8 and 9 against brute force, round trips and held-out accuracy, with nulls, empty, long and repeated rows, clashing names and empty tables."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash

from tallyspark.llm import bpe, chat, components, fingerprint, html_main, license_scan, simhash, toxicity

CLASH = "doc_id long, text string, row string, h string, fp string, component_id string, score string, _id string, sketch string, toxic string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "r", "h", "f", "c", "s", "i", "k", "t") for i, t in rows], CLASH)


# --- 1 ---------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for phrase, label in license_scan.BASE for q in [phrase.split()] for i in range(len(words)) if words[i : i + len(q)] == q]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "CHUNK", 200)
    random.seed(5)
    words = ["CC", "by", "general", "Public", "LICENSE", "all", "rights", "reserved", "é", "İ", "x9", "-", "·", "\x00"]
    rows = [(None, None), (1, ""), (2, "cc"), (3, "All rights reserved. ALL RIGHTS RESERVED"), (3, "All rights reserved. ALL RIGHTS RESERVED"), (4, "x " * 5000 + "cc-by")]
    rows += [(10 + i, "".join(random.choice(words) + random.choice(" .\n") for _ in range(random.randint(0, 60)))) for i in range(150)]
    got = license_scan.scan(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *places(t)) for i, t in rows)
    assert license_scan.scan(table(spark, rows).where("1 = 0")).count() == 0


def spans_by_hand(text, templates):
    """(label, covered share) of each verified span: all diagonals, all chains, by plain loops."""
    words, out = plain_words(text), []
    for label, phrase in templates:
        own = phrase.split()
        known = [q for q in range(len(own) - 1) if not license_scan.STOP.issuperset(own[q : q + 2])]
        hits = [(p, q) for p in range(len(words) - 1) for q in known if words[p : p + 2] == own[q : q + 2]]
        votes = Counter(p - q for p, q in hits)
        for d, n in votes.items():
            if any((m, -e) > (n, -d) for e, m in votes.items() if abs(e - d) <= license_scan.REACH):
                continue
            near = sorted((p, q) for p, q in hits if abs(p - q - d) <= license_scan.REACH)
            longest: list[int] = []
            for i, (p, q) in enumerate(near):
                longest.append(1 + max((longest[j] for j in range(i) if near[j][0] < p and near[j][1] < q), default=0))
            if max(longest) >= license_scan.COVER * len(known):
                out.append((label, max(longest) / len(known)))
    return sorted(out)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_license_spans_equal_brute_force(spark):
    random.seed(15)
    templates = [("long", license_scan.TEMPLATES[2][1]), ("mit", "released under the mit license"), ("again", "take the red fox and the blue fox and take the red fox home")]
    rows = [(0, "released under mit license the mit"), (1, "the mit license " * 40), (2, "released under the mit license " * 3)]
    for i in range(3, 200):
        words = random.choice(templates)[1].split() * random.choice([1, 1, 2])
        for _ in range(random.randint(0, 8)):
            k, kind = random.randrange(len(words)), random.random()
            words[k : k + (kind < 0.6)] = [] if kind < 0.3 else [random.choice(["x", "fox", "the", "mit"])]
            words = words or ["x"]
        if random.random() < 0.2:
            random.shuffle(words)
        rows.append((i, " ".join(random.choices(["a", "the", "fox"], k=random.randint(0, 9)) + words)))
    got = license_scan.scan(table(spark, rows), templates).collect()
    texts = dict(rows)
    for r in got:
        found = sorted((x.label, x.cover) for x in r.spans if x.label not in ("cc-by", "gpl", "reserved"))
        assert found == spans_by_hand(texts[r.doc_id], templates)
        assert all(0 <= x.first < x.last <= r.n_words for x in r.spans)
    assert got and not next(r for r in got if r.doc_id == 0).labels


def test_license_templates_bear_edits(spark):
    text = license_scan.TEMPLATES[2][1].split()
    with_edits = text[:9] + ["really"] + text[9:14] + text[15:]
    rows = [(1, "Foo. Released under the MIT License. " * 2), (2, "pre " * 7 + " ".join(with_edits)), (3, "the software is here"), (4, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in license_scan.scan(table(spark, rows)).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4)] == ["mit", "mit", "", "apache-2.0"]
    assert got[2].spans[0].first == 7 and 0.7 <= got[2].score < 1 and got[4].score == 1.0 and got[3].score == 0.0


# --- 2 ---------------------------------------------------------------------------------------


def distance(a, b, prefix):
    """Edits from a to b, or to the nearest beginning of b."""
    row, best = list(range(len(a) + 1)), [len(a)]
    for j, y in enumerate(b, 1):
        new = [j]
        for i, x in enumerate(a, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != y)))
        row = new
        best.append(row[-1])
    return min(best) if prefix else row[-1]


def test_machine_equals_brute_force():
    random.seed(6)
    for _ in range(150):
        terms = [("".join(random.choices("abc", k=random.randint(3, 10))), random.random() < 0.4, 1.0) for _ in range(4)]
        machine = toxicity.Machine(terms)
        for _ in range(30):
            word = "".join(random.choices("abc", k=random.randint(1, 12)))
            near = [(e, i) for i, (t, stem, _) in enumerate(terms) if t[0] == word[0] and (e := distance(t[1:], word[1:], stem)) <= toxicity.edits_allowed(t, stem)]
            assert machine.match(word) == min(near, default=None)


def test_machine_allows_edits_at_the_first_letter(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 60)
    random.seed(6)
    for _ in range(80):
        terms = [("".join(random.choices("abc", k=random.randint(3, 10))), random.random() < 0.4, 1.0) for _ in range(4)]
        machine = toxicity.Machine(terms, first=True)
        for _ in range(30):
            word = "".join(random.choices("abc", k=random.randint(1, 12)))
            near = [(e, i) for i, (t, stem, _) in enumerate(terms) if (e := distance(t, word, stem)) <= toxicity.edits_allowed(t, stem)]
            assert machine.match(word) == min(near, default=None)


def test_first_letters_and_symbols_are_read():
    scorer = toxicity.Scorer(toxicity.Model(toxicity.choose_terms([], 0, 0)))
    for word in ("xidiot", "diot", "ztupid", "$tupid", "@sshole", "a$$hole", "$cum"):
        assert [e for _, e, _, _ in scorer.hits(f"oh {word} you")[1]] == [1], word
    assert scorer.hits("mail jo@home.org for $50 or 5$")[1] == [] and scorer.hits("mail jo@home.org")[0] == 4


def test_toxicity_held_out_accuracy(spark):
    random.seed(7)
    plain = ["".join(random.choices("aeioulmnrst", k=random.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        words, bad = random.choices(plain, k=60), i % 5 == 0
        if bad:
            for at in random.sample(range(60), 3):
                words[at] = random.choice(["zidrok", "vumpel", "krast" + random.choice("aeiou") + "x"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = table(spark, rows + [(None, None), (5000, ""), (5001, "you are a wumpel vumpll zidrock")])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, *_ in labels if got[i].held_out]
    assert len(held) > 250 and all(got[i].predicted == int(i % 5 == 0) for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[5000].predicted == got[None].predicted == 0 and got[None].held_out is False and got[5001].score > got[5000].score
    kept = toxicity.kept_rows(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got.values())
    assert toxicity.score(docs.where("1 = 0"), model).count() == 0
    none = toxicity.fit(docs, known.where("1 = 0"))
    assert toxicity.Scorer(none).score("you idiot") > toxicity.Scorer(none).score('he said "you idiot" once')


def test_scores_equal_a_plain_version():
    """Hits by edit distance over all terms, contexts by looking at the words before, the logistic function by hand."""
    random.seed(21)
    terms = [("stupid", False, 2.0), ("idiot", False, 3.0), ("worthless", False, 1.5), ("moron", True, 2.5)]
    model = toxicity.Model(terms, [-2.0, 1.5, 0.7])
    scorer = toxicity.Scorer(model)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    def plain(text):
        words, total = re.findall(r"[^\W_]+", text.lower()), 0.0
        for i, w in enumerate(words):
            near = []
            for t, (term, stem, _) in enumerate(terms):
                e = min(distance(w[:k], term) for k in range(len(w) + 1)) if stem else distance(w, term)
                if e <= toxicity.edits_allowed(term, stem):
                    near.append((e, t))
            if near:
                e, t = min(near)
                weight = 0.3 if any(x in toxicity.REPORTING for x in words[max(0, i - toxicity.WINDOW) : i]) else 1.25 if any(x in toxicity.SECOND_PERSON for x in words[max(0, i - 3) : i]) else 1.0
                total += terms[t][2] * weight / (1 + e)
        x = [1.0, np.log1p(total), np.log1p(1000 * total / len(words)) / 7 if words else 0.0]
        return 1 / (1 + np.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True))))

    pool = ["stupid", "stupyd", "xstupid", "idiot", "idit", "worthles", "worthlessly", "moronic", "morn", "the", "you", "said", "are", "house", "green", "wrote", "fox"]
    for _ in range(300):
        text = " ".join(random.choices(pool, k=random.randint(0, 14)))
        assert abs(scorer.score(text) - plain(text)) < 1e-12, text


def test_toxicity_of_the_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").select("predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 50 and right >= 0.97 * len(rows)


# --- 3 ---------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_brute_force(prints):
    """prints: (id, fingerprint) rows."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[find(f)].append(i)
    return {f: min(least[find(f)], default=None) for f in values}


def test_every_near_pair_meets_in_a_table():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for a in range(64):
        for b in range(a + 1):
            assert any(not m & (1 << a | 1 << b) for m in masks)


def test_simhash_equals_brute_force(spark):
    random.seed(8)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(random.choices(words, k=40)) for _ in range(12)]
    rows = [(None, None), (900, ""), (901, " \n"), (902, "ONE two"), (903, "one TWO"), (904, "x " * 30000)]
    for i in range(160):
        text = random.choice(base).split()
        if i % 3:
            text[random.randrange(40)] = "new" + str(i % 7)
        rows.append((1000 - i, " ".join(text)))
    rows += [(1000, base[0]), (1000, base[0])]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    least = classes_by_brute_force(prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", least[f]) for i, f in prints)
    assert simhash.near_duplicates(table(spark, rows).where("1 = 0")).count() == 0


def test_links_of_a_large_bucket(spark):
    """A ball of near fingerprints around a centre, and chains: the classes are those of all pairs."""
    random.seed(9)
    centre, values = random.getrandbits(64), set()
    for _ in range(120):
        f = centre
        for _ in range(random.randint(0, 3)):
            f ^= 1 << random.randrange(64)
        values.add(f)
    f = random.getrandbits(64)
    for _ in range(30):
        values.add(f)
        f ^= 1 << random.randrange(64) | 1 << random.randrange(64)
    signed = {simhash._signed(x): x for x in values}
    roots = {r.node: r.root for r in components.connected(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    least = classes_by_brute_force([(x, x) for x in values])
    mine, truth = defaultdict(set), defaultdict(set)
    for s, x in signed.items():
        mine[roots.get(s, s)].add(x)
        truth[least[x]].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, truth.values()))


# --- 5 ---------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|im_end|>\n", "<|im_end|>", "<\\|im_end|>", "<|a|><|b|>", "<<SYS>> x <</SYS>>", "[INST", "a\nb<s></s>", "<|", "\\n", "", "é" * 50]


def test_chat_round_trip(spark):
    rows = [(k, i, NASTY[(i + k) % len(NASTY)] if k else random.choice(["user", "assistant"]), NASTY[i]) for k in range(3) for i in range(len(NASTY))]
    rows += [(None, 0, "assistant", None), (7, None, None, "x"), (8, 1, "assistant", "same"), (8, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, "t", "s") for r in rows], "conv_id long, turn long, role string, text string, segment string, record string")
    turns = chat.canonical_rows(df.drop("record"))
    for r in chat.segments(turns).collect():
        assert chat.read_segment(r.segment) == (r.role, r.text)
        assert not re.search(chat.CONTROL, r.segment[len(chat.OPEN) : -len(chat.CLOSE)])
    got = {r.conv_id: r for r in chat.digests(chat.segments(turns)).collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        loss = "".join(text for role, text in ts if role == "assistant")
        whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in ts).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.segments(turns.where("1 = 0"))).count() == 0


def test_chat_layouts(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, 2: {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 5},
        3: {"prompt": "a", "completion": "b"}, 4: {"instruction": "a", "input": "", "output": "b"}, 5: {"system": "s", "prompt": "a", "response": "b"}, 6: {"instruction": "a", "input": "c", "output": "b"}, 7: {"question": "a", "answer": None},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(8, '{"z": 1}'), (9, "{bad"), (10, None)]
    good, rest = chat.canonical_json(spark.createDataFrame(rows, "conv_id long, record string"))
    got = defaultdict(list)
    for r in good.orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    plain = [("user", "a"), ("assistant", "b")]
    assert got[1] == got[2] == got[3] == got[4] == plain and got[5] == [("system", "s"), *plain] and got[6] == [("user", "a\n\nc"), ("assistant", "b")] and got[7] == [("user", "a"), ("assistant", "")]
    assert {r.conv_id for r in rest.collect()} == {8, 9, 10}
    typed = spark.createDataFrame([(1, "a", "b", 3)], "conv_id long, prompt string, completion string, more int")
    assert [(r.role, r.text) for r in chat.canonical_rows(typed).orderBy("turn").collect()] == plain
    with pytest.raises(ValueError):
        chat.canonical_rows(spark.createDataFrame([(1, "a")], "conv_id long, x string"))


def test_bad_records_are_rejected_and_the_rest_is_read(spark):
    good = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    records = [
        (1, {"messages": [*good, "oops"]}), (2, {"messages": [{"role": "user", "content": "\ud800"}]}), (3, {"messages": good, "text": "x"}), (4, {"messages": good, "system": "s"}), (5, {"messages": []}),
        (6, {"messages": good, "system": None, "id": 3}), (7, [1]), (8, {"messages": {"role": "a", "content": "b"}}), (9, {"messages": [None]}),
    ]
    rows = [(i, json.dumps(x)) for i, x in records] + [(10, "[" * 100_000), (11, None), (12, "{"), (None, json.dumps({"messages": good}))]
    turns, rejected = chat.canonical_json(spark.createDataFrame(rows, "conv_id long, record string"))
    got = {}
    for r in turns.collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    both = {0: ("user", "a"), 1: ("assistant", "b")}
    assert got == {4: {0: ("system", "s"), 1: ("user", "a"), 2: ("assistant", "b")}, 6: both, None: both}
    assert {r.conv_id for r in rejected.collect()} == {1, 2, 3, 5, 7, 8, 9, 10, 11, 12}


# --- 6 ---------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(bpe, "SLICE", 300)
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(10)
    letters = "abcdefghijklmnop éüß日本語😀́\x1c\x1f  　\r\n\t.,!?'\"0123456789<|>"
    texts = ["", "a" * 3000, " " * 700 + "x", "!?" * 400, "<|endoftext|>", "it's we'll I'D", "ab" * 128, "abc" * 200] + ["".join(random.choices(letters, k=random.randint(0, 300))) for _ in range(60)]
    rows = [*enumerate(texts), (None, None), (3, texts[3])]
    docs = table(spark, rows)
    got = bpe.digests(docs).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def expected(i, text):
        ids = reference.encode_ordinary(text or "")
        return i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((text or "").encode())

    assert Counter(tuple(r) for r in got) == Counter(expected(i, t) for i, t in rows)
    encoded = bpe.encode(docs)
    back = Counter((r.doc_id, bytes(r.bytes)) for r in bpe.decode(encoded).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in rows)
    assert bpe.digests(docs.where("1 = 0")).count() == 0


def test_bpe_of_thirty_million_characters_equals_the_library(spark):
    """One text of random words, under the codec's 512 MB, encoded and decoded in runs."""
    random.seed(11)
    words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyzé ", k=random.randint(1, 12))) for _ in range(300_000)]
    text = " ".join(random.choices(words, k=4_200_000))
    assert len(text) > 30_000_000
    own = bpe.codec()
    library = tiktoken.Encoding("own", pat_str=__import__("public_tokenizers").PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids = np.array(library.encode_ordinary(text), dtype="<u4")
    docs = spark.createDataFrame([(1, text[:15_000_000], text[15_000_000:])], "doc_id long, a string, b string").selectExpr("doc_id", "concat(a, b) AS text")
    got = bpe.digests(docs).collect()
    assert [tuple(r) for r in got] == [(1, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())]


def test_bpe_of_very_long_pieces_equals_the_library(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    monkeypatch.setattr(bpe, "STATES", 1 << 16)
    monkeypatch.setattr(bpe, "SEGMENT", 1 << 11)
    own = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    random.seed(12)
    texts = ["the" * 4000, "a" * 9001, "-" * 5000, " " * 3000, "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)), "".join(random.choices(["ation", "the", "house", "er", "information"], k=900))]
    texts += ["".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(5000)), *("".join(random.choices("aabbcde- =eth", k=random.randint(1, 700))) for _ in range(40))]
    tokens, offsets = own.encode(texts)
    for i, text in enumerate(texts):
        assert tokens[offsets[i] : offsets[i + 1]].tolist() == reference.encode_ordinary(text)
    assert own.decode(tokens, offsets) == [x.encode() for x in texts]


# --- 8 ---------------------------------------------------------------------------------------


def test_fingerprints_equal_a_loop(spark, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 3000)
    monkeypatch.setattr(fingerprint, "CHUNK", 1500)
    word = lambda: "".join(random.choices("abcdeé", k=random.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(random.randint(0, 120)))) for i in random.sample(range(1000), 60)]
    rows += [(None, "first of all"), (2000, None), (2001, ""), (2002, rows[0][1]), (2002, rows[0][1]), (2003, "z" * 20000)]
    got = fingerprint.fingerprints(table(spark, rows)).collect()
    order = sorted(((-1 if i is None else i, (t or "").encode(), i, t or "") for i, t in rows))
    expected = Counter()
    for k, (_, raw, i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        new = fingerprint.edited(text, after)
        a, b, c = (plain_chunks(x.encode()) for x in (text, new, after))
        expected[i, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint.written(a), fingerprint.written(b), fingerprint.likeness(a, b), fingerprint.likeness(a, c)] += 1
    assert Counter(tuple(r) for r in got) == expected
    assert fingerprint.fingerprints(table(spark, rows).where("1 = 0")).count() == 0
    alone = fingerprint.fingerprints(table(spark, [(1, "abc def")])).first()
    assert alone.near_next == 1.0


def plain_chunks(data):
    """Byte by byte."""
    out, start = set(), 0
    while start < len(data):
        cut = min(len(data), start + fingerprint.GREATEST)
        for at in range(start + fingerprint.LEAST - 1, cut):
            h = sum(int(fingerprint._GEAR[data[at - j]]) << j for j in range(fingerprint.WINDOW)) & 0xFFFFFFFF
            if h >> (32 - (fingerprint.STRICT if at < start + fingerprint.TARGET else fingerprint.LOOSE)) == 0:
                cut = at + 1
                break
        piece = data[start:cut]
        out.add(xxhash.xxh3_64_intdigest(piece) >> 24 << 8 | len(piece))
        start = cut
    return frozenset(out)


def test_chunks_resist_shifts():
    random.seed(12)
    text = "".join(random.choices("abcdefgh ", k=5000)).encode()
    a, b = fingerprint.chunk_sets([text, b"something new " + text])
    assert fingerprint.likeness(a, b) > 0.95 and fingerprint.chunk_sets([b""])[0] == frozenset()


# --- 9 ---------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body><nav><a href=/>Home</a></nav><!-- c --><div class='ad'>Buy</div><article><h1>A &amp; B&nbsp;x</h1><p><b>One<br>two.<p>Three &lt;4&gt; &#233;<div class=\"ad\">no</div><p>Four</article><footer>&copy;</footer>", "A & B x\nOne two.\nThree <4> é\nFour"),
    ("<div class='top-menu'><a>Home</a></div><h1>Title</h1><p>First.</p><p>Second, longer text.</p><div id=comments><p>nice!</p></div><div class='cookie-notice'>ok?</div><form>Name <input><button>go</button></form>", "Title\nFirst.\nSecond, longer text."),
    ("<main><header><h1>H</h1></header><p>x</p><aside>side</aside><section class='comment-list'><article>reader</article></section><ul><li>a<li>b</ul></main><header>site</header>", "H\nx\na\nb"),
    ("<nav><ul><li>never closed<article><p>kept</p></article>", "kept"),
    ("<p>cut off in a ta<b", "cut off in a ta"), ("plain &amp text", "plain & text"), ("<nav>x</nav>", ""), ("", ""), (None, ""), ("a < b and c > d <p>e", "a < b and c > d\ne"), ("<p hidden>no</p><p>" + "long " * 5000, ("long " * 5000).strip()),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "u", h, "x", 0) for i, (h, _) in enumerate(PAGES)] + [(None, "u", PAGES[0][0], "x", 0)], "page_id long, url string, html string, text string, n_chars int")
    got = html_main.extract(df).collect()
    expected = Counter((i, None if i == 3 else "u", t, len(t)) for i, (_, t) in enumerate(PAGES))
    expected[None, "u", PAGES[0][1], len(PAGES[0][1])] += 1
    assert Counter(tuple(r) for r in got) == expected
    assert html_main.extract(df.where("1 = 0")).count() == 0


def test_regions_are_found_on_marked_pages():
    """A teaser in an article tag doesn't hide the longer text beside it; a menu without a class outside the mark is no region."""
    text = "This is the text that the page is about. " * 3
    assert html_main.main_text(f"<article>Teaser</article><div><p>{text}</p><p>More.</p></div>") == f"Teaser\n{text.strip()}\nMore."
    assert html_main.main_text(f"<div><a href=/>A</a></div><article><p>{text}</p><p><a href=/b>link</a></p></article><p>small print</p>") == f"{text.strip()}\nlink"
    assert html_main.main_text(f"<p>{text}</p><article><p>{text}</p><aside>c</aside><p>d</p></article><p>e</p>") == f"{text.strip()}\nd"


def test_parts_of_the_text_round_boilerplate_are_joined():
    assert html_main.main_text("<div><p>part one</p><div class=ad>x</div><p>part two, longer</p></div>") == "part one\npart two, longer"
    assert html_main.main_text("<p>a</p><p><a href=/>see</a></p><form>f</form><div><a href=/x>menu</a></div><aside>s</aside><p>b</p><p><a href=/y>end</a></p>") == "a\nsee\nb"
    assert html_main.main_text("<article>one</article><article>two, longer</article><article>three</article>") == "one\ntwo, longer\nthree"


def plain_points(lengths, thresholds):
    """Surges and dives by loops over whole windows."""
    w, found, at = html_main.WINDOW, [], None
    for i in range(len(lengths)):
        onward, backward = sum(lengths[i : i + w]), sum(lengths[max(0, i - w + 1) : i + 1])
        if at is None and lengths[i] > 0 and onward > thresholds[i]:
            at = i
        elif at is not None and max(onward, backward) <= thresholds[i]:
            found.append((at, i))
            at = None
    return found + ([(at, len(lengths))] if at is not None else [])


def test_points_equal_plain_loops():
    random.seed(13)
    for _ in range(3000):
        lengths = [random.choice([0, 0, 1, 5, 40, 200]) for _ in range(random.randint(0, 25))]
        thresholds = [random.choice([0, 5, 60])] * len(lengths)
        assert html_main.points(lengths, thresholds) == plain_points(lengths, thresholds)


SENTENCES = "".join(f"<p>{'This is a long sentence about the matter at hand. ' * 6}</p>" for _ in range(5))
TOLD = "\n".join([("This is a long sentence about the matter at hand. " * 6).strip()] * 5)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div>Home</div><div>News</div><div>Sport</div><div>Contact</div><h1>The title</h1>" + SENTENCES + "<div>Copyright 2020</div><div>Terms</div>", "The title\n" + TOLD),
        (f'<div class="content ad-free">{SENTENCES}</div>', TOLD),
        (f'<div class="page-header">{SENTENCES}</div><p>Imprint</p>', TOLD),
        (f'<div class="has-sidebar">{SENTENCES}<div class="sidebar">side</div></div>', TOLD),
        (f"<article><h1>T</h1>{SENTENCES}</article><div id=c1>" + "<p>A short answer of a reader.</p>" * 90 + "</div>", "T\n" + TOLD),
        (f"<h1>T</h1>{SENTENCES[:310]}</p><div class='comments-area'>{SENTENCES}</div>", "T\n" + TOLD.split("\n")[0]),
        (f"<form><nav>n</nav>{SENTENCES}<div class=ad-box>ad</div></form>", TOLD),
        (f"<div>{SENTENCES}<p class=ad>ad<p>Yes.</p><p>No.</p><p>Yes.</p>{SENTENCES}</div>", f"{TOLD}\nYes.\nNo.\nYes.\n{TOLD}"),
        ("<div>" + "<p>long</p>" * 20_000 + "</div>", "\n".join(["long"] * 20_000)),
    ],
)
def test_the_points_decide_and_lists_only_weigh(page, text):
    assert html_main.main_text(page) == text


def test_pages_without_marks_give_nearly_the_same_text(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    bare = [re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", x) for x in pages]
    same = sum(html_main.main_text(a) == html_main.main_text(b) for a, b in zip(pages, bare, strict=True))
    assert same >= 0.95 * len(pages)
