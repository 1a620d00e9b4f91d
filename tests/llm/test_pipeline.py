"""run() of corpus_pipeline.py against a brute-force version in plain Python on a small folder of tables."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

import corpus_pipeline
from tallyspark.llm import packing, pii, quality, queries, toxicity

from .test_free import classes_by_brute_force, plain_fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def xx(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode(), seed % (1 << 64))


def buckets_of(text, n):
    words = WORD.findall(text or "")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [signed(xx(w)) % n for w in words] + [signed(xx(b, xx(a))) % n for a, b in zip(words, words[1:], strict=False)]


def quality_by_brute_force(rows, trusted):
    n = quality.MIN_BUCKETS
    raw, target = Counter(), Counter()
    for i, text in rows:
        grams = buckets_of(text, n)
        raw.update(grams)
        if i in trusted:
            target.update(grams)
    share = sum(target.values()) / sum(raw.values())
    kept = []
    for i, text in rows:
        words = WORD.findall(text or "")
        often = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {k + j for k in range(len(words) - 2) if often[tuple(words[k : k + 3])] > 1 for j in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            continue
        each = [math.log((target[g] + quality.SMOOTHING) / ((raw[g] - 1) * share + quality.SMOOTHING)) for g in buckets_of(text, n)]
        if round(sum(each) / len(each), 9) >= quality.THRESHOLD:
            kept.append((i, text))
    return kept


def make(spark, folder):
    random.seed(20)
    common = ["".join(random.choices("aeioulmnrstd", k=random.randint(2, 6))) for _ in range(120)]
    rows, labels = [], []
    for i in range(160):
        words = random.choices(common, k=random.randint(80, 140))
        toxic = i % 9 == 0
        if toxic:
            for at in random.sample(range(len(words)), 4):
                words[at] = random.choice(["zidrok", "vumpel"])
        if i % 8 == 1:
            words = [w + "$$$" for w in words]
        if i % 7 == 3:
            words[3] = f"x{i}.y@mail{i}.example.com"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 8 != 1), int(toxic)))
    rows += [(1000 + i, rows[i][1] + (" end" if i % 2 else "")) for i in range(0, 40, 3)]  # exact and near copies
    rows += [(2000, None), (2001, ""), (None, rows[2][1].upper()), (2002, "too short")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return rows, labels


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, labels = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "pii", "packing"]

    good = quality_by_brute_force(rows, {i for i, q, _ in labels if q == 1})
    after_quality = stages["quality rules"](spark, docs, str(tmp_path))
    assert after_quality.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in after_quality.collect()) == Counter(good) and 60 < len(good) < len(rows)

    model = toxicity.fit(after_quality, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    clean = [(i, t) for i, t in good if scorer.score(t) < toxicity.PREDICT]
    assert not any(i is not None and i % 9 == 0 and i < 160 for i, _ in clean)
    after_toxic = stages["toxicity"](spark, after_quality, str(tmp_path))
    assert after_toxic.columns == docs.columns and Counter((r.doc_id, r.text) for r in after_toxic.collect()) == Counter(clean)

    prints = [(i, plain_fingerprint(t)) for i, t in clean]
    least = classes_by_brute_force(prints)
    alone = [(i, t) for (i, t), (_, f) in zip(clean, prints, strict=True) if i is None or least[f] == i]
    after_dedup = stages["near-duplicates"](spark, after_toxic, str(tmp_path))
    assert after_dedup.columns == docs.columns and Counter((r.doc_id, r.text) for r in after_dedup.collect()) == Counter(alone) and len(alone) < len(clean)

    after_pii = stages["pii"](spark, after_dedup, str(tmp_path))
    assert after_pii.columns == docs.columns
    core = {r.form: r.core for r in pii.assigned(after_dedup, "public test data").collect()}
    mails = re.compile("|".join(map(re.escape, sorted(core, key=len, reverse=True))))
    hidden = Counter((i, mails.sub(lambda m: core[m[0]], t)) for i, t in alone)
    got = after_pii.collect()
    assert Counter((r.doc_id, r.text) for r in got) == hidden and all(r.n_chars == len(r.text) for r in got) and core

    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = Counter((i, len(WORD.findall(t))) for i, t in alone)
    assert Counter((r.doc_id, r.n_tokens) for r in result) == lengths
    counts = Counter(n for _, n in lengths.elements())
    bounds = packing.optimal_bounds(sorted(counts), [counts[x] for x in sorted(counts)], 16)
    slots = defaultdict(list)
    for r in result:
        assert r.bucket_len == bounds[r.bucket] == min(b for b in bounds if b >= r.n_tokens)
        slots[r.bucket, r.batch].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and len(s) * bounds[b] <= 16_384 for (b, _), s in slots.items())


def test_empty_documents(spark, tmp_path):
    make(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name


def test_a_repeated_id_loses_only_its_rows_of_other_classes(spark, tmp_path):
    words = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(2, words("b")), (5, words("b")), (5, words("a")), (6, words("a")), (7, words("c")), (7, words("c"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.stages.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(2, words("b")), (5, words("a")), (7, words("c"))])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_exact_columns_equal_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df, result = queries.QUERIES[name](spark, sf), con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(result.fetchall())
