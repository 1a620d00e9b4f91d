"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, fingerprint, html_main, language, license_scan, packing, pii, quality, search, simhash, spelling, toxicity
from tallyspark.llm.common import pii_key, table


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the texts that labels call good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "n_pii", "pii_kinds")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of two layouts: the table's rows, and conversation -7 as a record with a list of messages; rejected counts a conversation's records without turns."""
    rows = chat.canonical_rows(table(spark, sf_dir, "conversations"))
    say = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": say}, {"role": "assistant", "content": say}]})
    extra, rejected = chat.canonical_json(spark.createDataFrame([(-7, record)], "conv_id long, record string"))
    n_rejected = rejected.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rejected"))  # of one record, so broadcast
    out = chat.digests(chat.segments(rows.unionByName(extra))).join(F.broadcast(n_rejected), "conv_id", "left")
    return out.withColumn("rejected", F.coalesce("rejected", F.lit(0)).cast("long"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the labelled documents whose remainder of crc32(doc_id) by 4 is not 2; a null id counts as an empty one."""
    docs, held_out = table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    return language.predict(docs, language.fit(docs.where(~held_out)), also=(held_out.alias("held_out"),))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(spelling.vocabulary(table(spark, sf_dir, "documents"), alter=spelling.altered))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_license_scan that are counted exactly."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_chat_format reads back from its output."""
    return op5_chat_format(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures of op7_quality."""
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that op8_fingerprint compares."""
    return op8_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def packed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_packing packs, and that each row fits its bucket and batch."""
    row = op10_packing(spark, sf_dir)
    fits = (F.col("n_tokens") <= F.col("bucket_len")) & (F.col("slot") < F.greatest(F.lit(1), F.floor(F.lit(16_384) / F.greatest("bucket_len", F.lit(1)))))
    return row.select("doc_id", "n_tokens", fits.alias("fits"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_chat_format": op5_chat_format,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_fingerprint": op8_fingerprint,
    "op9_html_main": op9_html_main,
    "op10_packing": op10_packing,
    "op11_language": op11_language,
    "op12_spelling": op12_spelling,
    "op13_search": op13_search,
    "license_base": license_base,
    "chat_turns": chat_turns,
    "quality_base": quality_base,
    "edited_texts": edited_texts,
    "packed_lengths": packed_lengths,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLACES = "list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by' OR w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' OR w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved')"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: SQL for what can be counted exactly. What is hashed, learnt, parsed or optimised has none; tests/llm holds it against brute force.
ORACLE_SQL: dict[str, str] = {
    "license_base": rf"""SELECT doc_id, len(w) AS n_words, len(found) AS n_base, found[1] - 1 AS first_word, found[len(found)] - 1 AS last_word,
      array_to_string(list_sort(list_distinct(list_transform(found, lambda i: CASE w[i] WHEN 'cc' THEN 'cc-by' WHEN 'general' THEN 'gpl' ELSE 'reserved' END))), ',') AS base_labels
      FROM (SELECT doc_id, w, {_PLACES} AS found FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents))""",
    "chat_turns": """WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256 FROM turns GROUP BY conv_id""",
    "quality_base": rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
      windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM (SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM d)),
      repeats AS (SELECT row, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY row),
      lines AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row)
      SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
      len(w) < 50 OR 100 * coalesce(repeats.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN repeats USING (row) LEFT JOIN lines USING (row)""",
    "edited_texts": """SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(after, 1, length(t) // 2)) AS edited_sha256
      FROM (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id, t), first_value(t) OVER (ORDER BY doc_id, t)) AS after FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "op12_spelling": r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
      runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
      bytes AS (SELECT run, c, list_concat([4294967295], flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))) AS b FROM runs),
      hashed AS (SELECT run, c, xor(list_reduce(b, lambda h, x: xor(h >> 8, t[(xor(h, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
      words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, c FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
      cut AS (SELECT word, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
      shorter AS (SELECT DISTINCT cut.word, rest FROM cut JOIN words ON words.word = rest),
      near AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT word, rest FROM shorter UNION SELECT rest, word FROM shorter),
      best AS (SELECT w.word, w.n, count(x.word) AS n_near, arg_max(x.word, (x.n, -x.place)) AS near, max(x.n) AS near_n FROM words w LEFT JOIN near ON near.word = w.word LEFT JOIN (SELECT word, n, row_number() OVER (ORDER BY word) AS place FROM words) x ON x.word = near.near GROUP BY w.word, w.n),
      judged AS (SELECT word, n, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM best),
      chain AS (SELECT word, word AS last_form, 0 AS depth FROM judged UNION ALL SELECT chain.word, judged.form, depth + 1 FROM chain JOIN judged ON judged.word = chain.last_form WHERE judged.form IS NOT NULL)
      SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN (SELECT word, arg_max(last_form, depth) AS root FROM chain GROUP BY word) USING (word)""",
    "op13_search": rf"""WITH found AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
      docs AS (SELECT *, len(terms) AS n FROM found WHERE len(terms) > 0),
      total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
      items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
      tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs) SEMI JOIN items USING (term) GROUP BY ALL),
      weights AS (SELECT term, floor(1000 * ln((2 * total.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, total.docs),
      impacts AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total.docs) // total.terms))) AS part FROM tf JOIN weights USING (term), total),
      scored AS (SELECT item_id, row, doc_id, sum(part)::BIGINT AS score FROM items JOIN impacts USING (term) GROUP BY ALL),
      ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
      SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
    "packed_lengths": f"SELECT doc_id, len({_WORDS}) AS n_tokens, true AS fits FROM documents",
}
