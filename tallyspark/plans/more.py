"""Queries of the smaller operators: scalar functions, sources, audit tables, identities, repairs, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P
from tallyspark.operators import accounts, dashboards, documents, facilities, names, quality, reports, schedule, statements
from tallyspark.plans import adapters as A
from tallyspark.plans.queries import _BASE_SQL, _INFER_SQL, _MONTHLY_SQL, _ORDER, _SCHEDULE_SQL, _TX, _clean, _inferred, _on_clean, _register
from tallyspark.schemas import LEDGER, evolve
from tallyspark.sources import files, layers
from tallyspark.sources import ledger as L

# --- scalar functions ------------------------------------------------------------------------

_register(
    "date_formats",
    lambda spark, sf_dir: A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")).select(
        "o_orderkey",
        P.date(
            F.element_at(
                F.array(
                    F.date_format("d", "dd-MM-yyyy"), F.date_format("d", "d/M/yyyy"), F.date_format("d", "yyyy-MM-dd"), F.date_format("d", "dd.MM.yyyy"), F.date_format("d", "d-MMM-yyyy"), F.concat(F.date_format("d", "dd/MM/yyyy"), F.lit(" 00:00:00")),
                    F.concat(F.day("d").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split())), F.month("d")), F.lit(" "), F.year("d").cast("string")),
                    F.date_format("d", "MMM d, yyyy"), F.date_format("d", "yyyyMMdd"), F.lit("31-02-2024"), F.lit("x"), F.date_format("d", "MM-dd-yyyy"),
                ), (F.col("o_orderkey") % 12 + 1).cast("int"),
            )
        ).alias("d"),
    ),
    """SELECT o_orderkey, CASE o_orderkey % 12 WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate::DATE END ELSE o_orderdate::DATE END AS d FROM orders""",
)
_register(
    "money_functions",
    lambda spark, sf_dir: A.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("t"), (F.col("l_partkey") % 4).alias("k"), "l_quantity", "l_extendedprice"
    ).withColumn("s", F.concat("t", F.element_at(F.array(F.lit(""), F.lit(" DB"), F.lit(" CR"), F.lit(" x")), (F.col("k") + 1).cast("int")))).select(
        "l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(P.split_mutation(F.col("s")), ("db", "cr"), strict=True)), P.us_amount(F.col("s")).alias("absolute"), P.plain_number(F.col("s")).alias("signed"),
        P.frequency(F.format_number("l_quantity", 0)).alias("frequency"), P.to_float(F.col("t")).alias("to_float"), P.to_amount(F.col("t")).alias("to_amount"), P.to_int(F.col("l_quantity")).alias("to_int"), P.percent_label(F.col("l_quantity") / 1000).alias("percent"),
        P.rupiah_label(F.round("l_extendedprice", 0)).alias("rupiah"), P.token_kind(F.when(F.col("k") == 0, F.col("t")).when(F.col("k") == 1, "01/02").when(F.col("k") == 2, "10:11:12").otherwise("01/02/24 10:11")).alias("token"),
    ),
    """SELECT l_orderkey, l_linenumber, CASE WHEN k = 1 THEN p END AS db, CASE WHEN k IN (0, 2) THEN p END AS cr, CASE WHEN k IN (0, 1) THEN p END AS absolute, (CASE k WHEN 0 THEN p WHEN 1 THEN -p END)::DOUBLE AS signed, l_quantity::BIGINT AS frequency,
      CASE WHEN p < 1000 THEN p::DOUBLE ELSE 0.0 END AS to_float, p::DOUBLE AS to_amount, l_quantity::INT AS to_int, replace(printf('%.2f', round(l_quantity / 10, 2)), '.', ',') || '%' AS percent,
      'Rp ' || replace(format('{:,}', round(l_extendedprice, 0)::BIGINT), ',', '.') AS rupiah, CASE k WHEN 0 THEN 'money' WHEN 1 THEN 'date' WHEN 2 THEN 'time' ELSE 'datetime' END AS token
    FROM (SELECT *, l_partkey % 4 AS k, l_extendedprice::DECIMAL(20,2) AS p FROM lineitem)""",
)
_register(
    "label_functions",
    lambda spark, sf_dir: A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderpriority").select(
        "o_orderkey", P.month_label(F.col("d")).alias("month"), P.month_label(F.col("d"), "_").alias("sheet"), P.day_label(F.col("d")).alias("day"), P.first_day_label(P.day_label(F.col("d"))).alias("first_day"),
        P.output_name("{account}_{year}:{kind}.xlsx", account=F.col("o_orderkey"), year=F.year("d"), kind=F.col("o_orderpriority")).alias("file"), P.add_diagnostic(P.add_diagnostic(F.when(F.col("o_orderkey") % 2 == 0, "a"), F.lit("b")), F.lit("a")).alias("issues"),
        P.localised(F.element_at(F.array(F.lit("Overdue"), F.lit("Unknown"), F.lit("xyz")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("local"), F.sha2(F.col("o_orderpriority").cast("binary"), 256).alias("hash"), P.sheet_name(F.concat("o_orderpriority", F.lit("/x:y"))).alias("safe"),
        P.join_text(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "  b  c ")).alias("joined"),
    ),
    """SELECT o_orderkey, strftime(o_orderdate, '%b-%y') AS month, strftime(o_orderdate, '%b_%y') AS sheet, strftime(o_orderdate, '%d/%m') AS day, '01/' || strftime(o_orderdate, '%m') AS first_day, o_orderkey || '_' || year(o_orderdate) || '_' || o_orderpriority || '.xlsx' AS file,
      CASE WHEN o_orderkey % 2 = 0 THEN 'a | b' ELSE 'b | a' END AS issues, CASE o_orderkey % 3 WHEN 0 THEN 'Lewat Jatuh Tempo' WHEN 1 THEN 'Tidak Diketahui' ELSE 'xyz' END AS local, sha256(o_orderpriority) AS hash, substr(o_orderpriority || '_x_y', 1, 31) AS safe,
      o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' b c' ELSE '' END AS joined FROM orders""",
)

# --- sources ---------------------------------------------------------------------------------

_NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
# A table is a file, or a folder of part files.
_register("folder_scan", lambda spark, sf_dir: files.binary(spark, sf_dir, "parquet").select(F.regexp_extract("path", r"/([^/]+\.parquet)(?:/.*)?$", 1).alias("file_name")).distinct().orderBy("file_name"), "SELECT unnest([" + ", ".join(f"'{x}.parquet'" for x in _NAMES) + "]) AS file_name")
_register(
    "decoded_texts",
    lambda spark, sf_dir: A.table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" café")).alias("t")).select(
        "c_custkey", files.decoded(F.when(F.col("c_custkey") % 3 == 0, F.encode("t", "UTF-8")).when(F.col("c_custkey") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("t", "UTF-8"))).otherwise(F.concat(F.encode("t", "ISO-8859-1"), F.unhex(F.lit("80"))))).alias("text")
    ),
    "SELECT c_custkey, c_name || ' café' || CASE WHEN c_custkey % 3 = 2 THEN '€' ELSE '' END AS text FROM customer",
)


def _file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part")
    account, month = (F.col("p_partkey") + 1_000_000).cast("string"), (F.col("p_partkey") % 12 + 1).cast("int")
    names = F.element_at(F.array(*map(F.lit, "Januari February Maret Apr Mei June Juli August Sep Oktober Nov Desember".split())), month)
    by_name = F.concat(F.lit("in/x/"), account, F.lit("_2023-"), F.lpad(month.cast("string"), 2, "0"), F.lit(".pdf"))
    by_words = F.concat(F.lit("in/x/rek "), account, F.lit(" "), names, F.lit(" 2022.pdf"))
    by_folder = F.concat(F.lit("in/"), account, F.lit(" 2021 "), names, F.lit("/scan.pdf"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, by_name).when(F.col("p_partkey") % 3 == 1, by_words).otherwise(by_folder).alias("path"))


_register(
    "file_metadata", lambda spark, sf_dir: _file_paths(spark, sf_dir).select("p_partkey", *(c.alias(n) for c, n in zip(files.metadata_from_path(F.col("path")), ("account", "year", "month"), strict=True))),
    "SELECT p_partkey, (p_partkey + 1000000)::VARCHAR AS account, (2023 - p_partkey % 3)::INT AS year, (p_partkey % 12 + 1)::INT AS month FROM part",
)


def _sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers.register(spark, f"{sf_dir}/nation.parquet", "Nation View")
    layers.register(spark, f"{sf_dir}/customer.parquet", "Customer View")
    return layers.query(spark, "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer_view JOIN nation_view ON c_nationkey = n_nationkey GROUP BY n_name")


_register("sql_view", _sql_view, "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_register(
    "upload_names", lambda spark, sf_dir: accounts.unique_names(A.table(spark, sf_dir, "part").select("p_partkey", F.lit("up").alias("folder"), "p_type"), ["folder"], "p_type", ["p_partkey"]).select("p_partkey", F.col("sheet").alias("name")),
    "SELECT p_partkey, CASE WHEN n = 1 THEN safe ELSE substr(safe, 1, 31 - length('_' || n)) || '_' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lower(safe) ORDER BY p_partkey) AS n FROM (SELECT *, substr(trim(regexp_replace(p_type, '\\s+', ' ', 'g')), 1, 31) AS safe FROM part))",
)

# --- audit -----------------------------------------------------------------------------------


def _file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = A.ledger(spark, sf_dir)
    failed = ledger.where("status = 'failed'").select("file_hash", F.concat(F.lit("bad "), "file_name").alias("error_message"))
    return accounts.file_report(A.files(spark, sf_dir), failed, ledger.where("status = 'success'"), L.successes(ledger, "report", "core", "1"))


_register(
    "file_report", _file_report,
    """SELECT 'h-' || c_custkey AS file_hash, c_name AS file_name, CASE WHEN e.m IS NULL THEN 'success' ELSE 'error' END AS status, coalesce(n, 0)::BIGINT AS row_count, e.m AS error_message, coalesce(ok, false) AS loaded_from_cache FROM customer
    LEFT JOIN (SELECT file_hash, string_agg('bad ' || file_name, '; ' ORDER BY 'bad ' || file_name) AS m FROM ledger WHERE status = 'failed' GROUP BY 1) e ON e.file_hash = 'h-' || c_custkey
    LEFT JOIN (SELECT file_hash, count(*) AS n, bool_or(parser_version = '1') AS ok FROM ledger WHERE status = 'success' GROUP BY 1) s ON s.file_hash = 'h-' || c_custkey""", A.LEDGER_SQL,
)
_register(
    "cleanup_candidates", lambda spark, sf_dir: accounts.to_clean(A.files(spark, sf_dir), A.ledger(spark, sf_dir).where("status = 'failed'")),
    "SELECT 'h-' || c_custkey AS file_hash, c_name AS file_name FROM customer WHERE 'h-' || c_custkey NOT IN (SELECT file_hash FROM ledger WHERE status = 'failed')", A.LEDGER_SQL,
)
_register(
    "cleanup_summary", lambda spark, sf_dir: accounts.cleanup_summary(A.ledger(spark, sf_dir).select(F.col("job_id").alias("target"), F.col("row_count").alias("deleted_files"), (F.col("row_count") * 100).alias("deleted_bytes"), (F.col("status") == "failed").cast("int").alias("errors"))),
    "SELECT job_id AS target, sum(row_count)::BIGINT AS deleted_files, sum(row_count * 100)::BIGINT AS deleted_bytes, count_if(status = 'failed')::BIGINT AS errors FROM ledger GROUP BY 1", A.LEDGER_SQL,
)
_register(
    "audit_events", lambda spark, sf_dir: L.current(L.event(A.ledger(spark, sf_dir), "running", 0).unionByName(L.event(A.ledger(spark, sf_dir), "done", 1).where("row_count > 4"))).select("job_id", "file_name", "event", "seq"),
    "SELECT job_id, file_name, CASE WHEN row_count > 4 THEN 'done' ELSE 'running' END AS event, (CASE WHEN row_count > 4 THEN 1 ELSE 0 END)::INT AS seq FROM ledger", A.LEDGER_SQL,
)
_register(
    "schema_evolution", lambda spark, sf_dir: evolve(A.ledger(spark, sf_dir).select("job_id", "file_name", "status", F.lit(1).alias("extra")), LEDGER).drop("processed_at"),
    "SELECT job_id, file_name, NULL::VARCHAR AS file_hash, NULL::VARCHAR AS document_type, NULL::VARCHAR AS parser_name, NULL::VARCHAR AS parser_version, status, NULL::BIGINT AS row_count, 1::INT AS extra FROM ledger", A.LEDGER_SQL,
)
_register(
    "lineage_added", lambda spark, sf_dir: files.with_lineage(files.with_lineage(A.ledger(spark, sf_dir).select("file_name", "file_hash"), "job-1", "old", "0"), "job-2", "core", "1", cached=True),
    "SELECT file_name, file_hash, 'job-2' AS job_id, 'core' AS parser_name, '1' AS parser_version, true AS loaded_from_cache FROM ledger", A.LEDGER_SQL,
)
_on = lambda name, f, sql, *ctes: _register(name, f, sql, A.FACILITIES_SQL, *ctes)
_on(
    "dwh_lineage", lambda spark, sf_dir: facilities.clean(files.with_lineage(A.facilities(spark, sf_dir), "job-1", "core", "1"), A.AS_OF).select("source_file", "seq", "nama", "job_id", "parser_name", "parser_version", "loaded_from_cache"),
    "SELECT source_file, seq::INT AS seq, nama, 'job-1' AS job_id, 'core' AS parser_name, '1' AS parser_version, false AS loaded_from_cache FROM fac",
)
_register(
    "changed_labels", lambda spark, sf_dir: accounts.differing(A.ledger(spark, sf_dir).select("file_name", F.when(F.substring("file_name", 3, 20).cast("long") % 10 == 0, "x").otherwise(F.col("status")).alias("status")), A.ledger(spark, sf_dir).select("file_name", "status"), "file_name"),
    "SELECT file_name FROM ledger WHERE substr(file_name, 3)::BIGINT % 10 = 0", A.LEDGER_SQL,
)

# --- facilities ------------------------------------------------------------------------------

_on("real_rows", lambda spark, sf_dir: A.facilities(spark, sf_dir).agg(F.count_if(~facilities.is_fallback(F.col("keterangan"))).alias("rows")), "SELECT (SELECT count(*) FROM fac) + (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS rows")
_DUP = ["nama", "nik_npwp", "bank", "penggunaan", "plafond", "baki_debet", "kol", "awal", "jatuh_tempo", "rate", "keterangan"]


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities of which every third place is reported again, with the same values, at a later place."""
    places = F.when(F.col("seq") % 3 == 0, F.array(F.col("seq"), F.col("seq") + 1000)).otherwise(F.array("seq"))
    return _clean(spark, sf_dir).withColumn("seq", F.explode(places))


_on("dedup_all_keys", lambda spark, sf_dir: facilities.keep_first(_twice(spark, sf_dir), ["source_file", *_DUP], ["seq"]).select("source_file", "seq", "nama", "bank", "kol"), "SELECT source_file, seq::INT AS seq, nama, bank, kol::INT AS kol FROM fac QUALIFY row_number() OVER (PARTITION BY source_file, nama, l_partkey % 50 = 0, bank, penggunaan, plafond, baki, kol, awal, jatuh_tempo, rate, keterangan ORDER BY seq) = 1")
_on("dedup_removed", lambda spark, sf_dir: facilities.removed(_twice(spark, sf_dir), ["source_file", *_DUP]), "SELECT (SELECT count(*) + count_if(seq % 3 = 0) FROM fac)::BIGINT AS rows, (SELECT count(*) + count_if(seq % 3 = 0) FROM fac)::BIGINT - (SELECT count(*) FROM (SELECT DISTINCT source_file, nama, l_partkey % 50 = 0, bank, penggunaan, plafond, baki, kol, awal, jatuh_tempo, rate, keterangan FROM fac))::BIGINT AS removed")
_on_clean(
    "option_lists_all", lambda df: dashboards.option_lists(df, ["nama", "bank", "penggunaan", "kol", "keterangan", "maturity_bucket"]).orderBy("column", "value"),
    " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS column, {v}::VARCHAR AS value FROM fac" for c, v in (("nama", "nama"), ("bank", "bank"), ("penggunaan", "penggunaan"), ("kol", "kol"), ("keterangan", "keterangan"), ("maturity_bucket", "bucket"))),
)
_on(
    "schedule_beside_year", lambda spark, sf_dir: schedule.beside_year(_clean(spark, sf_dir)),
    """SELECT source_file, seq, count(*)::BIGINT AS years, min(year)::INT AS first_year, sum(cpltd)::BIGINT AS cpltd, sum(interest)::BIGINT AS interest, 1::INT AS period FROM (SELECT source_file, seq::INT AS seq, year(due) AS year, sum(payment) AS cpltd, sum(interest) AS interest FROM sched GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    _BASE_SQL, _SCHEDULE_SQL,
)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged facilities of which some break a rule, by the place of a part's number."""
    f = A.facilities(spark, sf_dir).where("keterangan NOT LIKE 'Tidak ada%' AND bank <> 'Jumlah'")
    k = F.col("seq") % 10
    return f.withColumns(
        {
            "bank": F.when(k == 1, "").otherwise(F.col("bank")), "plafond": F.when(k == 2, "-5").otherwise(F.col("plafond")), "baki_debet": F.when(k == 3, "-1").when(k == 2, "-9").otherwise(F.lit("0")), "rate": F.when(k == 4, "150").otherwise("0.2"),
            "jatuh_tempo": F.when(k == 5, "31-02-2024").otherwise(F.col("jatuh_tempo")), "keterangan": F.when(k == 6, "Tidak ada Fasilitas Aktif").otherwise(F.col("keterangan")), "nama": F.lit("x"), "nik_npwp": F.when(k == 7, "12").otherwise(""), "kol": F.when(k == 0, "9").otherwise("1"),
        }
    )


_on(
    "dq_facilities_all", lambda spark, sf_dir: quality.facility_issues(_broken(spark, sf_dir)).select("source_file", "rule_name", "severity", "row_number"),
    """SELECT source_file, x.r AS rule_name, x.s AS severity, (seq + 1)::INT AS row_number FROM (SELECT source_file, seq, unnest(CASE seq % 10 WHEN 1 THEN [{'r': 'bank_required', 's': 'ERROR'}] WHEN 2 THEN [{'r': 'plafond_non_negative', 's': 'ERROR'}, {'r': 'baki_debet_non_negative', 's': 'ERROR'}]
      WHEN 3 THEN [{'r': 'baki_debet_non_negative', 's': 'ERROR'}] WHEN 4 THEN [{'r': 'rate_range', 's': 'WARNING'}] WHEN 5 THEN [{'r': 'jatuh_tempo_date', 's': 'WARNING'}] WHEN 6 THEN [{'r': 'fallback_exposure', 's': 'ERROR'}] WHEN 7 THEN [{'r': 'identity_format', 's': 'WARNING'}] WHEN 0 THEN [{'r': 'kol_range', 's': 'ERROR'}] ELSE [] END) AS x FROM fac)""",
)

# --- reports ---------------------------------------------------------------------------------


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report's first page, a label or a number each; by the customer's key the number is labelled, bare, a tax number, or absent."""
    c = A.table(spark, sf_dir, "customer")
    nik = F.concat(F.lit("3171"), F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("150199"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"))
    npwp = F.concat(F.lit("99"), F.lpad(F.col("c_custkey").cast("string"), 13, "0"))
    other = F.lit("3171015001990001")
    k = F.col("c_custkey") % 5
    lines = (
        F.when(k == 0, F.array(F.lit("Data Pokok Debitur"), other, F.lit("NIK"), F.lit("-"), nik)).when(k == 1, F.array(F.lit("Data"), F.lit("1111111111111111"), F.concat(F.lit("no "), nik)))
        .when(k == 2, F.array(F.lit("NPWP"), F.lit("x"), npwp)).when(k == 3, F.array(F.lit("NIK"), F.lit("Plafon"), F.lit("123"), F.concat(F.lit("NPWP : "), npwp))).otherwise(F.array(F.lit("none")))
    )
    return c.select("c_custkey", lines.alias("lines"))


_register(
    "identity_search", lambda spark, sf_dir: _identities(spark, sf_dir).select("c_custkey", reports.identity(F.col("lines")).alias("identity")),
    """SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN '3171' || lpad((c_custkey % 90 + 10)::VARCHAR, 2, '0') || '150199' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN c_custkey % 5 IN (2, 3) THEN '99' || lpad(c_custkey::VARCHAR, 13, '0') ELSE '' END AS identity FROM customer""",
)
_register(
    "report_numbers", lambda spark, sf_dir: A.table(spark, sf_dir, "orders").select("o_orderkey", reports.report_number(F.concat(F.lit("Nomor Laporan "), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.col("o_orderkey").cast("string"), F.lit("/IDEB/12/2024 dan 9/IDEB/9/9"))).otherwise(""))).alias("no_laporan")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey || '/IDEB/12/2024' END AS no_laporan FROM orders",
)

# --- statements ------------------------------------------------------------------------------

_mixed = lambda spark, sf_dir: A.transactions(spark, sf_dir)
_register(
    "numeric_mirrors", lambda spark, sf_dir: accounts.numeric_mirrors(_mixed(spark, sf_dir).select("account", "source_sequence", "db", "cr", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("saldo").cast("string")).alias("saldo")), ["db", "cr", "saldo"]),
    "SELECT account, source_sequence, db, cr, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE saldo::VARCHAR END AS saldo, coalesce(db, 0)::DOUBLE AS db_numeric, coalesce(cr, 0)::DOUBLE AS cr_numeric, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE coalesce(saldo, 0)::DOUBLE END AS saldo_numeric FROM tx", *_TX,
)
_register(
    "without_openings", lambda spark, sf_dir: accounts.without_openings(statements.opening_rows(_inferred(spark, sf_dir), _ORDER).select("account", "keterangan", F.lit(None).cast("decimal(20,2)").alias("db"), F.lit(None).cast("decimal(20,2)").alias("cr")).unionByName(_mixed(spark, sf_dir).select("account", F.concat("keterangan", F.lit(" saldo awal")).alias("keterangan"), "db", "cr"))),
    "SELECT account, keterangan || ' saldo awal' AS keterangan, db, cr FROM tx", *_TX,
)
_register(
    "signed_sides", lambda spark, sf_dir: _mixed(spark, sf_dir).select("account", "source_sequence", F.concat(F.when(F.col("direction") == "CR", "+").when(F.col("event_id") % 2 == 0, "-").otherwise(""), F.format_number("amount", 2)).alias("n")).select("account", "source_sequence", *(c.alias(n) for c, n in zip(accounts.signed_sides(F.col("n")), ("db", "cr"), strict=True))),
    "SELECT account, source_sequence, db, cr FROM tx", *_TX,
)
_register(
    "recap_lookup", lambda spark, sf_dir: accounts.long_recap(statements.mart(_mixed(spark, sf_dir), ["account"]), ["account"], {"total_db": "Mutasi  db", "total_cr": "MUTASI CR"}).withColumn("seq", F.when(F.col("keterangan") == "MUTASI CR", 2).otherwise(1)).groupBy("account").agg(accounts.recap_value("MUTASI DB").alias("db"), accounts.recap_value("mutasi cr").alias("cr"), accounts.recap_value("none").alias("no")),
    "SELECT account, coalesce(sum(db), 0)::DECIMAL(30,2) AS db, coalesce(sum(cr), 0)::DECIMAL(30,2) AS cr, NULL::DECIMAL(30,2) AS no FROM tx GROUP BY 1", *_TX,
)
_register(
    "recap_first_of_label", lambda spark, sf_dir: accounts.first_of_label(_mixed(spark, sf_dir).select("account", "source_sequence", F.when(F.col("event_id") % 2 == 0, F.lower("keterangan")).otherwise(F.col("keterangan")).alias("keterangan"), "amount"), ["account"], "keterangan", "source_sequence").select("account", "source_sequence", "amount"),
    "SELECT account, source_sequence, amount FROM tx QUALIFY row_number() OVER (PARTITION BY account, keterangan ORDER BY source_sequence) = 1", *_TX,
)
_register(
    "txt_reconciliation", lambda spark, sf_dir: statements.parse_transactions(statements.classify(A.statement_lines(_mixed(spark, sf_dir)), metadata_first=True)).groupBy("account").agg(F.count(F.lit(1)).alias("rows"), F.sum(P.to_float(F.col("db"))).cast("decimal(30,2)").alias("db"), F.sum(P.to_float(F.col("cr"))).cast("decimal(30,2)").alias("cr")),
    "SELECT account, count(*) AS rows, coalesce(sum(db), 0)::DECIMAL(30,2) AS db, coalesce(sum(cr), 0)::DECIMAL(30,2) AS cr FROM tx WHERE NOT contains(keterangan, 'BUNGA') GROUP BY 1", *_TX,
)


def _wrong_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with all balances, but one in seven; of which one in five stands on the wrong side and one in eleven has no amounts."""
    tx = _mixed(spark, sf_dir)
    e = F.col("event_id")
    so_far = Window.partitionBy("account").orderBy("source_sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = tx.withColumn("right", (F.lit(A.OPENING) + F.sum(F.coalesce("cr", F.lit(0)) - F.coalesce("db", F.lit(0))).over(so_far)).cast("decimal(20,2)"))
    side = lambda a, b: F.when(e % 11 == 0, None).when(e % 5 == 0, F.col(b)).otherwise(F.col(a)).cast("decimal(20,2)")
    return both.select("account", "source_sequence", "event_id", side("db", "cr").alias("db"), side("cr", "db").alias("cr"), F.col("right").alias("saldo"), F.lit(A.OPENING).cast("decimal(20,2)").alias("opening"), "direction")


_WRONG = "wrong AS (SELECT * FROM tx)"
#: A balance that doesn't change decides nothing: rows of zero stay as they are.
_DECIDED = "SELECT account, source_sequence, CASE WHEN amount <> 0 THEN db WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN cr ELSE db END AS db, CASE WHEN amount <> 0 THEN cr WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 0 THEN db ELSE cr END AS cr FROM wrong"
#: Balances of rows on the wrong side do change, so 'swap' only fills rows without amounts.
_FILLED = "SELECT account, source_sequence, CASE WHEN event_id % 5 = 0 AND event_id % 11 <> 0 THEN cr ELSE db END AS db, CASE WHEN event_id % 5 = 0 AND event_id % 11 <> 0 THEN db ELSE cr END AS cr FROM wrong"
for _rule, _sql in (("gap", _DECIDED), ("simple", _DECIDED), ("swap", _FILLED)):
    _register(
        f"side_repair_{_rule}", lambda spark, sf_dir, rule=_rule: accounts.repaired_sides(_wrong_sides(spark, sf_dir), F.col("opening"), ["account"], ["source_sequence"], rule, F.col("direction")).select("account", "source_sequence", "db", "cr"),
        _sql, *_TX, _WRONG,
    )


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as rows of a table with wrapped lines, noise between them and a footer with rubbish after it."""
    tx = _mixed(spark, sf_dir).select("account", "source_sequence", "event_id", "tanggal", "keterangan", "kolom3", "amount")
    row = lambda k, date, text, amount, when=F.lit(True): F.when(when, F.struct((F.col("source_sequence") * 4 + k).alias("n"), date.alias("date"), text.alias("text"), amount.alias("amount")))
    blank, e = F.lit(""), F.col("event_id")
    each = F.array_compact(F.array(row(0, F.date_format("tanggal", "dd/MM"), F.col("keterangan"), F.when(e % 3 == 0, "").otherwise(F.col("amount").cast("string"))), row(1, blank, F.col("kolom3"), F.when(e % 3 == 0, F.col("amount").cast("string")).otherwise(""), e % 2 == 0), row(2, blank, F.lit("Halaman 3"), blank, e % 9 == 0), row(1, blank, F.lit("x9"), F.col("amount").cast("string"), (e % 3 == 0) & (e % 2 != 0))))
    body = tx.select("account", F.explode(each).alias("r")).select("account", "r.*")
    foot = tx.select("account").distinct().select("account", F.posexplode(F.array(F.lit("TOTAL MUTASI"), F.lit("rubbish"))).alias("k", "text")).select("account", (F.col("k") + 10_000_000).alias("n"), F.lit("").alias("date"), "text", F.lit("1").alias("amount"))
    return body.unionByName(foot)


_register(
    "wrapped_rows", lambda spark, sf_dir: accounts.merged_rows(accounts.without_noise(_wrapped(spark, sf_dir), ["account"], "n", "text", r"(?i)^halaman \d+$", "^TOTAL"), ["account"], "n", F.col("date") != "", "text", ["amount"]),
    "SELECT account, (source_sequence * 4)::INT AS n, keterangan || CASE WHEN event_id % 2 = 0 THEN ' ' || kolom3 WHEN event_id % 3 = 0 THEN ' x9' ELSE '' END AS text, amount::VARCHAR AS amount FROM tx", *_TX,
)
_register(
    "parser_diagnostics", lambda spark, sf_dir: quality.parser_diagnostics(_mixed(spark, sf_dir).groupBy("source_file", "account").agg(F.when(F.col("account").endswith("1"), "balance mismatch | overlap").otherwise("  ").alias("validation_issues"))).select("source_file", "table_name", "rule_name", "severity", "message"),
    "SELECT DISTINCT source_file, 'stg_bank_statement_summary' AS table_name, 'txt_parser_diagnostics' AS rule_name, 'WARNING' AS severity, 'balance mismatch | overlap' AS message FROM tx WHERE right(account, 1) = '1'", *_TX,
)
_register(
    "carried_messages",
    lambda spark, sf_dir: quality.transaction_issues(_mixed(spark, sf_dir).select("source_file", "source_sequence", F.lit("x").alias("tanggal"), F.lit("y").alias("keterangan"), F.lit("1").alias("db"), F.lit(None).cast("string").alias("cr"), F.lit("1.00").alias("saldo"), F.when(F.col("event_id") % 6 == 0, "balance mismatch").otherwise("").alias("validation_issue"))).select("source_file", "rule_name", "severity", "row_number", "message"),
    "SELECT source_file, 'transaction_validation' AS rule_name, 'WARNING' AS severity, (source_sequence + 1)::INT AS row_number, 'balance mismatch' AS message FROM tx WHERE event_id % 6 = 0", *_TX,
)
_register(
    "frame_errors", lambda spark, sf_dir: quality.frame_errors(_mixed(spark, sf_dir).select("account", F.when(~F.col("account").endswith("1"), F.col("tanggal")).alias("tanggal"), F.when(~F.col("account").endswith("2"), F.col("keterangan")).alias("keterangan"), F.when(F.col("account").endswith("3"), None).otherwise(F.col("amount")).alias("saldo"), F.when(~F.col("account").endswith("4"), F.col("amount")).alias("db"), F.when(F.col("account").endswith("5"), F.col("amount")).alias("cr")), ["account"]),
    "SELECT DISTINCT account, CASE right(account, 1) WHEN '1' THEN 'missing date' WHEN '2' THEN 'missing description' WHEN '3' THEN 'missing balance' WHEN '4' THEN 'missing debit and credit' ELSE 'debit and credit' END AS error FROM tx WHERE right(account, 1) IN ('1', '2', '3', '4', '5')", *_TX,
)
_register(
    "account_closing", lambda spark, sf_dir: accounts.metadata(statements.parse_blocks(statements.classify(A.statement_lines(_mixed(spark, sf_dir)).unionByName(_mixed(spark, sf_dir).groupBy("source_file").agg(F.sum("amount").alias("s")).select("source_file", F.lit(100_000_000).alias("line_no"), F.concat(F.lit("SALDO AKHIR "), F.format_number("s", 2)).alias("line")))))).select("source_file", "account", "saldo_awal", "saldo_akhir"),
    "SELECT source_file, account, 100000::DECIMAL(20,2) AS saldo_awal, sum(amount)::DECIMAL(20,2) AS saldo_akhir FROM tx GROUP BY 1, 2", *_TX,
)
_register(
    "yearly_workbook", lambda spark, sf_dir: documents.workbook(statements.monthly(_inferred(spark, sf_dir), _ORDER), _mixed(spark, sf_dir), ["account"], _ORDER)["Summary"],
    f"SELECT account, year, month, 0::INT AS place, db_total, cr_total, db_count::DECIMAL(30,2) AS db_count, cr_count::DECIMAL(30,2) AS cr_count FROM ({_MONTHLY_SQL}) UNION ALL SELECT account, year, NULL, 1, coalesce(round(sum(db_total) / count(db_total), 2), 0)::DECIMAL(30,2), coalesce(round(sum(cr_total) / count(cr_total), 2), 0)::DECIMAL(30,2), round(avg(db_count), 2)::DECIMAL(30,2), round(avg(cr_count), 2)::DECIMAL(30,2) FROM ({_MONTHLY_SQL}) GROUP BY 1, 2",
    *_TX, _INFER_SQL,
)
_register(
    "workbook_months", lambda spark, sf_dir: documents.workbook(statements.monthly(_inferred(spark, sf_dir), _ORDER), _mixed(spark, sf_dir), ["account"], _ORDER)["Months"],
    "SELECT strftime(tanggal, '%b_%y') AS sheet, account, source_sequence, tanggal, keterangan, db, cr FROM tx", *_TX,
)


def _first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report's first page in seven layouts, by the customer's key."""
    c = A.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("BUDI "), F.translate(F.col("c_custkey").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit("XY"))
    shapes = [
        ["Posisi Data Terakhir", "Data Pokok Debitur", name, "NIK / 3171", "Nama Debitur", "OTHER NAME"],
        ["Data Pokok Debitur", "Nama Debitur", "WIRASWASTA", "Indonesia", "BANDUNG", name, "NPWP"],
        ["Data Pokok Debitur", "Nama Debitur", "FIRST NAME", name, "12 / x", "Ringkasan Fasilitas", "LATE NAME"],
        ["Data Pokok Debitur", "Nama Debitur", "123", "JENIS KELAMIN", name],
        ["RAHASIA", name, "Informasi diberikan kepada", "Data Pokok Debitur", "1"],
        ["lower text", "Nomor Laporan", "Nama Debitur", "9", F.concat(F.lit("PT "), name), "NPWP", "X"],
        ["BANK ABC", "12", "nik"],
    ]
    texts = [F.array(*(x if not isinstance(x, str) else F.lit(x) for x in shape)) for shape in shapes]
    k = F.col("c_custkey") % 7
    return c.select("c_custkey", reduce(lambda w, i: w.when(k == i, texts[i]), range(1, 7), F.when(k == 0, texts[0])).alias("lines"))


_register(
    "debtor_names", lambda spark, sf_dir: _first_pages(spark, sf_dir).select("c_custkey", names.debtor(F.col("lines")).alias("nama")),
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN '' ELSE CASE WHEN c_custkey % 7 = 5 THEN 'PT ' ELSE '' END || 'BUDI ' || translate(c_custkey::VARCHAR, '0123456789', 'ABCDEFGHIJ') || 'XY' END AS nama FROM customer",
)


_register(
    "batch_groups", lambda spark, sf_dir: files.batches(_file_paths(spark, sf_dir), "path").select("account", "year", F.size("paths").alias("files"), F.get("paths", 0).alias("first")),
    """SELECT account, year, count(*)::INT AS files, min(path) AS first FROM (SELECT (p_partkey + 1000000)::VARCHAR AS account, (2023 - p_partkey % 3)::INT AS year,
      CASE p_partkey % 3 WHEN 0 THEN 'in/x/' || (p_partkey + 1000000) || '_2023-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '.pdf' WHEN 1 THEN 'in/x/rek ' || (p_partkey + 1000000) || ' ' || m || ' 2022.pdf' ELSE 'in/' || (p_partkey + 1000000) || ' 2021 ' || m || '/scan.pdf' END AS path
      FROM (SELECT *, ['Januari', 'February', 'Maret', 'Apr', 'Mei', 'June', 'Juli', 'August', 'Sep', 'Oktober', 'Nov', 'Desember'][p_partkey % 12 + 1] AS m FROM part)) GROUP BY 1, 2""",
)
_on_clean("bars_by_bank", lambda df: dashboards.bars(df, "bank"), "SELECT bank AS value, count(*) AS facility_count, sum(baki)::DECIMAL(38,4) AS total_baki_debet, (row_number() OVER (ORDER BY sum(baki) DESC, bank))::INT AS place FROM fac GROUP BY 1")
_on_clean("bars_by_debtor", lambda df: dashboards.bars(df, "nama"), "SELECT nama AS value, count(*) AS facility_count, sum(baki)::DECIMAL(38,4) AS total_baki_debet, (row_number() OVER (ORDER BY sum(baki) DESC, nama))::INT AS place FROM fac GROUP BY 1")
_on_clean("bars_by_kol", lambda df: dashboards.bars(df, "kol", ["1", "2", "3", "4", "5"]), "SELECT kol::VARCHAR AS value, count(*) AS facility_count, sum(baki)::DECIMAL(38,4) AS total_baki_debet, kol::INT AS place FROM fac GROUP BY kol")
_on_clean("bars_by_bucket", lambda df: dashboards.bars(df, "maturity_bucket", facilities.BUCKETS), "SELECT bucket AS value, count(*) AS facility_count, sum(baki)::DECIMAL(38,4) AS total_baki_debet, list_position(['Overdue', '0-3 Months', '3-6 Months', '6-12 Months', '>12 Months', 'Unknown'], bucket)::INT AS place FROM fac GROUP BY 1")
_on_clean(
    "sorted_lists", lambda df: dashboards.in_order(dashboards.problem_list(df).select("source_file", "seq", "kol", "baki_debet", "rate"), F.desc_nulls_last("kol"), F.desc_nulls_last("baki_debet"), F.desc_nulls_last("rate"), "source_file", "seq").withColumn("baki_debet", F.col("baki_debet").cast("decimal(20,4)")),
    "SELECT source_file, seq::INT AS seq, kol::INT AS kol, baki AS baki_debet, rate::DOUBLE AS rate FROM fac WHERE kol >= 3 ORDER BY kol DESC, baki DESC, rate DESC NULLS LAST, source_file, seq",
)
