"""The queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import dashboards as D
from tallyspark.operators import accounts, detect, facilities, quality, reports, schedule, statements
from tallyspark.plans import adapters as A
from tallyspark.sources import files as sources
from tallyspark.sources import ledger as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities.clean(A.facilities(spark, sf_dir), A.AS_OF)


def _register(name: str, run: Query, sql: str | None, *ctes: str) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql


def _on_clean(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _register(name, lambda spark, sf_dir: f(_clean(spark, sf_dir)), sql, A.FACILITIES_SQL)


def _dec(x: str, scale: int = 4) -> str:
    return f"coalesce(sum({x}), 0)::DECIMAL(38,{scale})"


_PL, _BK, _COST = _dec("plafond"), _dec("baki"), _dec("cost", 7)
_MEAN = "round(sum(rate)::DOUBLE / nullif(count(rate), 0), 6)"
_LIST = ["source_file", "seq", "nama", "bank", "kol", "keterangan"]
_listed = lambda df: df.select(*_LIST, F.col("baki_debet").cast("decimal(20,4)").alias("baki_debet"), "rate", "remaining_days")
_LIST_SQL = "source_file, seq::INT AS seq, nama, bank, kol::INT AS kol, keterangan, baki AS baki_debet, rate::DOUBLE AS rate, remaining_days::INT AS remaining_days"

_on_clean(
    "clean_facilities",
    lambda df: df.select(*_LIST, F.col("baki_debet").cast("decimal(20,4)").alias("baki_debet"), "rate", "remaining_days", "awal", "jatuh_tempo", "maturity_bucket", F.array_join("risk_flags", ", ").alias("risk_flags"), F.round("utilization_ratio", 6).alias("utilization_ratio")),
    f"""SELECT {_LIST_SQL}, awal, jatuh_tempo, bucket AS maturity_bucket, round(CASE WHEN plafond > 0 THEN bk / pl ELSE 0 END, 6) AS utilization_ratio,
    array_to_string(list_filter([CASE kol WHEN 1 THEN 'Current' WHEN 2 THEN 'Special Mention' ELSE 'Problem Loan' END, CASE WHEN kol >= 3 AND baki > 0 THEN 'Outstanding Problem Loan' END,
      CASE WHEN keterangan = 'Hapus Tagih' THEN 'Charged-Off' END, CASE WHEN keterangan = 'Dihapusbukukan' THEN 'Written-Off' END, CASE WHEN rate > 0.30 THEN 'High Rate' END,
      CASE WHEN remaining_days BETWEEN 0 AND 90 THEN 'Near Maturity' END, CASE WHEN remaining_days < 0 THEN 'Overdue' END], lambda x: x IS NOT NULL), ', ') AS risk_flags FROM fac""",
)
_on_clean("maturity_mart", D.mart_maturity, f"SELECT bucket AS maturity_bucket, count(*) AS facility_count, {_BK} AS total_baki_debet, {_PL} AS total_plafond FROM fac GROUP BY 1")
_on_clean("risk_mart", D.mart_risk, f"SELECT keterangan, kol::INT AS kol, count(*) AS facility_count, {_BK} AS total_baki_debet, {_PL} AS total_plafond FROM fac GROUP BY 1, 2")
_on_clean(
    "summary_mart", D.mart_summary,
    f"SELECT count(*) AS facility_count, count(DISTINCT nama) AS debtor_count, count(DISTINCT bank) AS bank_count, {_PL} AS total_plafond, {_BK} AS total_baki_debet, round(sum(coalesce(rate, 0))::DOUBLE / count(*), 6) AS average_rate, count(DISTINCT source_file) AS source_file_count FROM fac",
)
_RATIO = "round(sum(baki)::DOUBLE / sum(plafond)::DOUBLE, 6)"
_on_clean(
    "kpi_summary", D.kpi_summary,
    f"SELECT {_PL} AS total_plafond, {_BK} AS total_baki_debet, count(DISTINCT nama) AS debtors, count(*) AS facilities, count(DISTINCT bank) AS banks, sum(is_active)::BIGINT AS active_facilities, sum(is_off)::BIGINT AS written_off_facilities, max(kol)::INT AS worst_kol, {_MEAN} AS average_rate, {_RATIO} AS utilization_ratio FROM fac",
)
_on_clean(
    "kpi_risk", D.kpi_risk,
    f"SELECT {_dec('CASE WHEN kol >= 3 THEN baki END')} AS problem_exposure, count_if(kol >= 3)::BIGINT AS problem_facilities, sum(is_off)::BIGINT AS written_off_facilities, max(kol)::INT AS highest_kol, count_if(coalesce(rate, 0) > 0.30)::BIGINT AS high_rate_facilities, count_if(kol >= 3 AND baki > 0)::BIGINT AS outstanding_problem_loans FROM fac",
)
_on_clean(
    "kpi_maturity", D.kpi_maturity,
    f"SELECT {_dec('CASE WHEN remaining_days BETWEEN 0 AND 90 THEN baki END')} AS due_soon_baki_debet, count_if(remaining_days BETWEEN 0 AND 90)::BIGINT AS due_soon_facilities, {_dec('CASE WHEN remaining_days < 0 THEN baki END')} AS overdue_baki_debet, count_if(remaining_days < 0)::BIGINT AS overdue_facilities, {_MEAN} AS average_rate, max(rate)::DOUBLE AS highest_rate, {_COST} AS annual_interest_cost FROM fac",
)
_on_clean("count_by_kol", lambda df: D.by_kol(df).select("kol", "facility_count"), "SELECT kol::INT AS kol, count(*) AS facility_count FROM fac GROUP BY 1")
_on_clean("sum_by_kol", lambda df: D.by_kol(df).select("kol", "total_baki_debet"), f"SELECT kol::INT AS kol, {_BK} AS total_baki_debet FROM fac GROUP BY 1")
_on_clean(
    "debtor_summary", D.debtor_summary,
    f"SELECT nama, {_PL} AS total_plafond, {_BK} AS total_baki_debet, count(*) AS facilities, count(DISTINCT bank) AS banks, max(kol)::INT AS worst_kol, {_MEAN} AS average_rate, {_RATIO} AS utilization_ratio, sum(is_active)::BIGINT AS active_facilities, sum(is_off)::BIGINT AS written_off_facilities FROM fac GROUP BY nama",
)
_FLAGS = """flags AS (
  SELECT nama, source_file, seq, flag, pos FROM (SELECT nama, source_file, seq, unnest([CASE kol WHEN 1 THEN 'Current' WHEN 2 THEN 'Special Mention' ELSE 'Problem Loan' END, CASE WHEN kol >= 3 AND baki > 0 THEN 'Outstanding Problem Loan' END,
      CASE WHEN keterangan = 'Hapus Tagih' THEN 'Charged-Off' END, CASE WHEN keterangan = 'Dihapusbukukan' THEN 'Written-Off' END, CASE WHEN rate > 0.30 THEN 'High Rate' END,
      CASE WHEN remaining_days BETWEEN 0 AND 90 THEN 'Near Maturity' END, CASE WHEN remaining_days < 0 THEN 'Overdue' END]) AS flag, unnest(range(7)) AS pos FROM fac) WHERE flag IS NOT NULL
), firsts AS (SELECT nama, flag, min(row(source_file, seq, pos)) AS first_at FROM flags GROUP BY 1, 2), joined AS (SELECT nama, string_agg(flag, ', ' ORDER BY first_at) AS risk_flags FROM firsts GROUP BY 1)"""
_register(
    "debtor_risk_ranking", lambda spark, sf_dir: D.debtor_risk_ranking(_clean(spark, sf_dir)),
    f"SELECT fac.nama, {_BK} AS total_baki_debet, max(kol)::INT AS worst_kol, {_dec('CASE WHEN kol >= 3 THEN baki END')} AS problem_exposure, sum(is_off)::BIGINT AS written_off_count, count_if(coalesce(rate, 0) > 0.30)::BIGINT AS high_rate_count, any_value(risk_flags) AS risk_flags FROM fac JOIN joined ON fac.nama = joined.nama GROUP BY fac.nama",
    A.FACILITIES_SQL, _FLAGS,
)
_on_clean("status_summary", D.status_summary, f"SELECT keterangan, count(*) AS facility_count, {_BK} AS total_baki_debet FROM fac GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_on_clean(
    "maturity_bucket_dim", D.maturity_buckets,
    f"""SELECT d.i::INT AS bucket_order, d.b AS maturity_bucket, count(fac.seq) AS facility_count, {_BK} AS total_baki_debet, {_PL} AS total_plafond, {_MEAN} AS average_rate, {_COST} AS annual_interest_cost
    FROM (VALUES (0,'Overdue'),(1,'0-3 Months'),(2,'3-6 Months'),(3,'6-12 Months'),(4,'>12 Months'),(5,'Unknown')) d(i, b) LEFT JOIN fac ON fac.bucket = d.b GROUP BY 1, 2 HAVING d.b <> 'Unknown' OR count(fac.seq) > 0""",
)
_on_clean("maturity_year", D.maturity_years, f"SELECT year(jatuh_tempo)::INT AS jatuh_tempo_year, count(*) AS facility_count, {_BK} AS total_baki_debet, {_MEAN} AS average_rate, {_COST} AS annual_interest_cost FROM fac WHERE jatuh_tempo IS NOT NULL GROUP BY 1")
_on_clean("avg_rate_bank_top15", D.average_rate_by_bank, f"SELECT bank, {_MEAN} AS average_rate FROM fac GROUP BY 1 HAVING count(rate) > 0 ORDER BY 2 DESC, 1 LIMIT 15")
_on_clean(
    "rate_bands", D.rate_bands,
    f"""SELECT d.b AS rate_band, count(fac.seq) AS facility_count, {_BK} AS total_baki_debet, {_MEAN} AS average_rate FROM (VALUES ('0-10%'),('10-20%'),('20-30%'),('30-40%'),('>40%')) d(b)
    LEFT JOIN fac ON d.b = CASE WHEN coalesce(rate,0) < 0 THEN '' WHEN coalesce(rate,0) <= 0.10 THEN '0-10%' WHEN rate <= 0.20 THEN '10-20%' WHEN rate <= 0.30 THEN '20-30%' WHEN rate <= 0.40 THEN '30-40%' ELSE '>40%' END GROUP BY 1""",
)
_KOLS = ", ".join(f"{_dec(f'CASE WHEN kol = {k} THEN baki END')} AS kol_{k}" for k in range(1, 6))
_on_clean("heatmap_debtor", lambda df: D.heatmap(df, "nama"), f"SELECT nama, {_KOLS} FROM fac GROUP BY 1")
_on_clean("heatmap_bank", lambda df: D.heatmap(df, "bank"), f"SELECT bank, {_KOLS} FROM fac GROUP BY 1")
_on_clean(
    "subtotal_rows", facilities.subtotals,
    f"""SELECT nama, 'Jumlah' AS bank, {_PL} AS total_plafond, {_BK} AS total_baki_debet, max(kol)::INT AS worst_kol, max(r)::INT AS worst_status_rank, any_value(s) AS worst_status
    FROM (SELECT *, CASE keterangan WHEN 'Hapus Tagih' THEN 6 WHEN 'Dihapusbukukan' THEN 5 WHEN 'Hapus Buku' THEN 5 WHEN 'Aktif' THEN 4 WHEN 'Lunas Karena Pengambilalihan Agunan' THEN 3 WHEN 'Lunas Dengan Diskon' THEN 2 ELSE 1 END AS r, first_value(keterangan) OVER (PARTITION BY nama ORDER BY CASE keterangan WHEN 'Hapus Tagih' THEN 6 WHEN 'Dihapusbukukan' THEN 5 WHEN 'Hapus Buku' THEN 5 WHEN 'Aktif' THEN 4 WHEN 'Lunas Karena Pengambilalihan Agunan' THEN 3 WHEN 'Lunas Dengan Diskon' THEN 2 ELSE 1 END DESC, seq, source_file DESC) AS s FROM fac) GROUP BY nama""",
)
_on_clean("top_banks", lambda df: D.top_sum(df, "bank"), f"SELECT bank, {_BK} AS total FROM fac GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_on_clean("top_debtors", lambda df: D.top_sum(df, "nama"), f"SELECT nama, {_BK} AS total FROM fac GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_on_clean("top_rates", lambda df: _listed(D.top_rows(df, "rate")), f"SELECT {_LIST_SQL} FROM fac WHERE rate IS NOT NULL ORDER BY fac.rate DESC, source_file, seq LIMIT 10")
_on_clean("top_interest_cost", lambda df: _listed(D.top_rows(df, "annual_interest_cost")), f"SELECT {_LIST_SQL} FROM fac ORDER BY bk * coalesce(fac.rate::DOUBLE, 0.0) DESC, source_file, seq LIMIT 10")
_on_clean("problem_list", lambda df: _listed(D.problem_list(df)), f"SELECT {_LIST_SQL} FROM fac WHERE kol >= 3")
_on_clean("written_off_list", lambda df: _listed(D.written_off_list(df)), f"SELECT {_LIST_SQL} FROM fac WHERE is_off = 1")
_on_clean("high_rate_list", lambda df: _listed(D.high_rate_list(df)), f"SELECT {_LIST_SQL} FROM fac WHERE rate > 0.30")
_on_clean("high_rate_outstanding_list", lambda df: _listed(D.high_rate_outstanding_list(df)), f"SELECT {_LIST_SQL} FROM fac WHERE rate > 0.30 AND baki > 0")
_on_clean("due_soon_list", lambda df: _listed(D.due_soon_list(df)), f"SELECT {_LIST_SQL} FROM fac WHERE remaining_days BETWEEN 0 AND 90")
_on_clean("overdue_list", lambda df: _listed(D.overdue_list(df)), f"SELECT {_LIST_SQL} FROM fac WHERE remaining_days < 0")
_on_clean(
    "multi_risk_list", lambda df: _listed(D.multi_risk_list(df)),
    f"SELECT {_LIST_SQL} FROM fac WHERE (CASE WHEN kol >= 3 AND baki > 0 THEN 1 ELSE 0 END) + is_off + (CASE WHEN rate > 0.30 THEN 1 ELSE 0 END) + (CASE WHEN remaining_days <= 90 THEN 1 ELSE 0 END) >= 1",
)
_CHOICE = {"kol": [2, 3, 4], "keterangan": ["Aktif", "Dihapusbukukan"], "bank": []}
_on_clean(
    "filtered_dashboard", lambda df: D.kpi_filtered(D.filtered(df, **_CHOICE)),
    f"SELECT {_PL} AS total_plafond, {_BK} AS total_baki_debet, count(DISTINCT nama) AS debtors, count(*) AS facilities, count(DISTINCT bank) AS banks, max(kol)::INT AS worst_kol, {_MEAN} AS average_rate, {_RATIO} AS utilization_ratio, sum(is_active)::BIGINT AS active_facilities, sum(is_off)::BIGINT AS written_off_facilities, {_dec('CASE WHEN kol >= 3 THEN baki END')} AS problem_exposure, count_if(remaining_days BETWEEN 0 AND 90)::BIGINT AS due_soon, count_if(remaining_days < 0)::BIGINT AS overdue FROM fac WHERE kol IN (2, 3, 4) AND keterangan IN ('Aktif', 'Dihapusbukukan')",
)
_on_clean("option_lists", lambda df: D.options(df, "bank"), "SELECT DISTINCT bank AS value FROM fac")
_on_clean(
    "rate_histogram", lambda df: D.rate_histogram(df, empty=True).select("bin", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "facility_count"),
    """SELECT bin::INT AS bin, round(a + bin * (z - a) / 20, 9) AS low, CASE WHEN bin = 19 OR z = a THEN round(z, 9) ELSE round(a + (bin + 1) * (z - a) / 20, 9) END AS high, count(place) AS facility_count
    FROM (SELECT min(rate::DOUBLE) AS a, max(rate::DOUBLE) AS z FROM fac), unnest(range(20)) AS t(bin)
    LEFT JOIN (SELECT CASE WHEN z > a THEN least(floor((rate::DOUBLE - a) / ((z - a) / 20)), 19) ELSE 0 END::INT AS place FROM fac, (SELECT min(rate::DOUBLE) AS a, max(rate::DOUBLE) AS z FROM fac) WHERE rate IS NOT NULL) ON place = bin
    WHERE z > a OR bin = 0 AND z IS NOT NULL GROUP BY bin, a, z""",
)
_on_clean("rate_scatter", D.rate_scatter, "SELECT kol::INT AS kol, row_number() OVER (PARTITION BY kol ORDER BY rate, source_file, seq)::INT AS place, rate::DOUBLE AS rate, baki AS baki_debet, source_file, seq::INT AS seq FROM fac WHERE rate IS NOT NULL AND baki > 0")
_register(
    "ffill_name", lambda spark, sf_dir: facilities.fill_names(A.facilities(spark, sf_dir)).select("source_file", "seq", "nama"),
    "SELECT source_file, seq::INT AS seq, nama FROM fac UNION ALL SELECT 'report-' || o_orderkey, n, c_name FROM orders JOIN customer ON o_custkey = c_custkey, (VALUES (9000, 50), (9001, 97)) v(n, m) WHERE o_orderkey % m = 0", A.FACILITIES_SQL,
)
_KEYS = ["nama", "bank", "penggunaan", "kol", "keterangan"]
_register(
    "dedup_facilities", lambda spark, sf_dir: facilities.keep_first(_clean(spark, sf_dir), _KEYS, ["source_file", "seq"]).select("source_file", "seq", *_KEYS),
    "SELECT source_file, seq::INT AS seq, nama, bank, penggunaan, kol::INT AS kol, keterangan FROM fac QUALIFY row_number() OVER (PARTITION BY nama, bank, penggunaan, kol, keterangan ORDER BY source_file, seq) = 1", A.FACILITIES_SQL,
)
_BASE_SQL = "base AS (SELECT *, year(jatuh_tempo) * 12 + month(jatuh_tempo) - year(awal) * 12 - month(awal) + 1 AS term FROM fac WHERE jatuh_tempo >= awal AND plafond > 0), shares AS (SELECT *, round_even((plafond::DECIMAL(20,4) / term)::DOUBLE, 0) AS share FROM base), firsts AS (SELECT *, greatest(0.0, round_even(pl - share, 0)) AS first_left FROM shares)"
_SCHEDULE_SQL = """plan AS (
  SELECT source_file, seq, nama, bank, period, term, awal, jatuh_tempo, coalesce(rate::DOUBLE, 0.0) AS rate, share, CASE WHEN period = 1 THEN pl ELSE greatest(0.0, first_left - (period - 2) * share) END AS opening
  FROM (SELECT *, unnest(range(1, term + 1)) AS period FROM firsts)
), sched AS (
  SELECT source_file, seq::INT AS seq, nama, bank, period::INT AS period, CASE WHEN period = term THEN jatuh_tempo ELSE (awal + to_months((period - 1)::INT))::DATE END AS due,
    (CASE WHEN period = term THEN floor(opening) ELSE share END)::BIGINT AS payment, (CASE WHEN period = 1 THEN 0 ELSE round_even(opening * (rate / 12), 0) END)::BIGINT AS interest,
    greatest(0.0, round_even(opening - CASE WHEN period = term THEN floor(opening) ELSE share END, 0))::BIGINT AS balance FROM plan
)"""
_register("installment_schedule", lambda spark, sf_dir: schedule.schedule(_clean(spark, sf_dir)), "SELECT *, payment - interest AS principal FROM sched", A.FACILITIES_SQL, _BASE_SQL, _SCHEDULE_SQL)
_register(
    "installment_yearly", lambda spark, sf_dir: schedule.yearly(_clean(spark, sf_dir)),
    "SELECT source_file, seq, year(due)::INT AS year, sum(payment)::BIGINT AS cpltd, sum(interest)::BIGINT AS interest, max_by(balance, period) AS ltd FROM sched GROUP BY 1, 2, 3", A.FACILITIES_SQL, _BASE_SQL, _SCHEDULE_SQL,
)
_register(
    "dq_facilities", lambda spark, sf_dir: quality.facility_issues(A.facilities(spark, sf_dir)).select("source_file", "table_name", "rule_name", "severity", "column_name", "row_number"),
    """SELECT source_file, 'stg_facilities' AS table_name, rule_name, severity, column_name, row_number::INT AS row_number FROM (
      SELECT source_file, 'identity_format' AS rule_name, 'WARNING' AS severity, 'nik_npwp' AS column_name, seq + 1 AS row_number FROM fac WHERE l_partkey % 50 = 0
      UNION ALL SELECT source_file, 'baki_debet_over_plafond', 'WARNING', 'baki_debet', seq + 1 FROM fac WHERE baki > plafond
      UNION ALL SELECT source_file, 'nama_required', 'ERROR', 'nama', seq + 1 FROM fac WHERE seq > 1
      UNION ALL SELECT 'report-' || o_orderkey, 'kol_range', 'ERROR', 'kol', 9002 FROM orders WHERE o_orderkey % 97 = 0)""", A.FACILITIES_SQL,
)
_money4 = lambda c: F.col(c).cast("decimal(20,4)").alias(c)
_reported = lambda spark, sf_dir, kind: reports.facilities(A.report_texts(A.facilities(spark, sf_dir)), [kind])
_register(
    "block_parse_roundtrip",
    lambda spark, sf_dir: reports.without_guarantees(_reported(spark, sf_dir, reports.CREDIT)).select("source_file", "seq", "jenis_fasilitas", "bank", "penggunaan", _money4("plafond"), _money4("baki_debet"), "kol", "awal", "jatuh_tempo", "rate", "keterangan", "no_rekening", "no_akad_akhir"),
    "SELECT * FROM rep WHERE jenis_fasilitas <> 'Bank Garansi'", A.FACILITIES_SQL, A.REPORT_SQL,
)
_register(
    "guarantee_report", lambda spark, sf_dir: reports.guarantees(_reported(spark, sf_dir, reports.GUARANTEE)).select("source_file", "seq", "bank", "no_rekening", "no_akad_akhir", "jenis_garansi", "tujuan_garansi", _money4("nominal"), _money4("setoran_jaminan"), "kol", "tanggal_akad_awal", "jatuh_tempo", "keterangan"),
    "SELECT source_file, seq, bank, no_rekening, no_akad_akhir, 'Garansi Tender' AS jenis_garansi, '' AS tujuan_garansi, baki_debet AS nominal, 1500.5::DECIMAL(20,4) AS setoran_jaminan, kol, awal AS tanggal_akad_awal, jatuh_tempo, keterangan FROM rep WHERE jenis_fasilitas = 'Bank Garansi'", A.FACILITIES_SQL, A.REPORT_SQL,
)
_register(
    "fallback_rows", lambda spark, sf_dir: reports.fallback_rows(A.table(spark, sf_dir, "orders").select(F.concat(F.lit("report-"), F.col("o_orderkey").cast("string")).alias("source_file"), F.col("o_orderpriority").alias("nama"), F.col("o_orderkey").cast("string").alias("no_laporan")), _clean(spark, sf_dir)).drop("plafond", "baki_debet"),
    "SELECT 'report-' || o_orderkey AS source_file, o_orderpriority AS nama, o_orderkey::VARCHAR AS no_laporan, 0::INT AS kol, 'Tidak ada Fasilitas Aktif' AS keterangan FROM orders WHERE 'report-' || o_orderkey NOT IN (SELECT source_file FROM fac)", A.FACILITIES_SQL,
)

# --- statements ------------------------------------------------------------------------------

_ORDER = ["source_sequence"]


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = A.transactions(spark, sf_dir)
    return statements.infer_balances(tx, A.openings(tx), ["account"], _ORDER)


_INFER_SQL = """inferred AS (
  SELECT * EXCLUDE (c, d, base, above), (CASE WHEN saldo IS NOT NULL THEN saldo ELSE coalesce(above, 100000) + c END)::DECIMAL(20,2) AS balance, coalesce(saldo <> coalesce(above, 100000) + c, false) AS mismatch
  FROM (SELECT *, last_value(base IGNORE NULLS) OVER (PARTITION BY account ORDER BY source_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
    FROM (SELECT *, saldo - c AS base FROM (SELECT *, sum(d) OVER (PARTITION BY account ORDER BY source_sequence) AS c FROM (SELECT *, CASE WHEN db IS NOT NULL THEN -db ELSE cr END AS d FROM tx))))
)"""
_TX = (A.TRANSACTIONS_SQL,)
_register(
    "running_balance", lambda spark, sf_dir: statements.running_balance(tx := A.transactions(spark, sf_dir), A.openings(tx), ["account"], _ORDER).select("account", "source_sequence", "saldo", "expected", "ok"),
    "SELECT account, source_sequence, saldo, correct AS expected, coalesce(saldo = correct, true) AS ok FROM tx", *_TX,
)
_register("infer_balance", lambda spark, sf_dir: _inferred(spark, sf_dir).select("account", "source_sequence", "balance", "mismatch"), "SELECT account, source_sequence, balance, mismatch FROM inferred", *_TX, _INFER_SQL)
_CATS = """coalesce(sum(CASE WHEN regexp_matches(keterangan, '\\bADM\\b|ADMIN|BIAYA\\s+ADMIN|FEE|\\bPROVISI\\b') THEN db END), 0)::DECIMAL(30,2) AS adm, coalesce(sum(CASE WHEN regexp_matches(keterangan, '\\bPPH\\b|PAJAK|TAX') THEN db END), 0)::DECIMAL(30,2) AS pajak,
  coalesce(sum(CASE WHEN regexp_matches(keterangan, 'BUNGA|INTEREST|\\bBNG\\b') THEN db END), 0)::DECIMAL(30,2) AS bunga, coalesce(sum(CASE WHEN regexp_matches(keterangan, 'SALDO\\s+MIN') THEN db END), 0)::DECIMAL(30,2) AS saldo_min, coalesce(sum(CASE WHEN regexp_matches(keterangan, 'JASA\\s+GIRO|JAGIR') THEN cr END), 0)::DECIMAL(30,2) AS jagir"""
_MONTHLY_SQL = f"""SELECT account, year(tanggal)::INT AS year, month(tanggal)::INT AS month, sum(db)::DECIMAL(30,2) AS db_total, count(db) AS db_count, sum(cr)::DECIMAL(30,2) AS cr_total, count(cr) AS cr_count, max_by(balance, source_sequence) AS saldo,
  (min_by(CASE WHEN direction = 'DB' THEN balance + amount ELSE balance - amount END, source_sequence))::DECIMAL(20,2) AS saldo_awal, {_CATS} FROM inferred GROUP BY 1, 2, 3"""
_register("monthly_summary", lambda spark, sf_dir: statements.monthly(_inferred(spark, sf_dir), _ORDER), _MONTHLY_SQL, *_TX, _INFER_SQL)
_register(
    "workbook_footers", lambda spark, sf_dir: statements.footers(statements.monthly(_inferred(spark, sf_dir), _ORDER)),
    f"SELECT account, year, month, sum(db_total)::DECIMAL(38,2) AS db_total, sum(cr_total)::DECIMAL(38,2) AS cr_total, sum(db_count)::BIGINT AS db_count, sum(cr_count)::BIGINT AS cr_count, coalesce(round(sum(db_total)::DOUBLE / nullif(count(db_total), 0), 2), 0.0) AS db_mean, coalesce(round(sum(cr_total)::DOUBLE / nullif(count(cr_total), 0), 2), 0.0) AS cr_mean FROM ({_MONTHLY_SQL}) GROUP BY GROUPING SETS ((account, year, month), (account, year))", *_TX, _INFER_SQL,
)
_register("category_totals_overlap", lambda spark, sf_dir: A.transactions(spark, sf_dir).groupBy("account").agg(*statements.categories_overlapping()), f"SELECT account, {_CATS} FROM tx GROUP BY 1", *_TX)
_CAT_SQL = """cats AS (SELECT *, CASE WHEN db IS NOT NULL THEN CASE WHEN regexp_matches(keterangan, '\\bPPH\\b|PAJAK|\\bTAX\\b') THEN 'Pajak' WHEN regexp_matches(keterangan, 'BUNGA') THEN 'Bunga' WHEN regexp_matches(keterangan, 'ADMIN|^BIAYA') THEN 'Adm' END
  ELSE CASE WHEN regexp_matches(keterangan, 'JASA\\s*GIRO') THEN 'JaGir' WHEN regexp_matches(keterangan, 'BUNGA') THEN CASE WHEN right(account, 1) = '0' THEN 'JaGir' ELSE 'Bunga' END END END AS cat, coalesce(db, cr) AS v FROM tx)"""
_register(
    "category_totals_exclusive", lambda spark, sf_dir: statements.categories_exclusive(A.transactions(spark, sf_dir), ["account"], F.col("account").endswith("0")),
    "SELECT account, " + ", ".join(f"sum(CASE WHEN cat = '{c}' THEN v END)::DECIMAL(30,2) AS {c.lower().replace(' ', '_')}" for c in ("Adm", "Pajak", "Bunga", "Saldo Min", "JaGir")) + " FROM cats GROUP BY 1", *_TX, _CAT_SQL,
)
_register(
    "bank_mart", lambda spark, sf_dir: statements.mart(A.transactions(spark, sf_dir), ["source_file", "direction"]),
    f"SELECT source_file, direction, count(*) AS transaction_count, {_dec('db', 2).replace('38', '30')} AS total_db, {_dec('cr', 2).replace('38', '30')} AS total_cr FROM tx GROUP BY 1, 2", *_TX,
)
_register(
    "recap_left_join", lambda spark, sf_dir: statements.recap_join(A.table(spark, sf_dir, "customer").select(F.concat(F.lit("10"), F.col("c_custkey").cast("string")).alias("account")), A.transactions(spark, sf_dir)),
    "SELECT '10' || c_custkey AS account, (SELECT sum(db)::DECIMAL(30,2) FROM tx WHERE account = '10' || c_custkey) AS total_db, (SELECT sum(cr)::DECIMAL(30,2) FROM tx WHERE account = '10' || c_custkey) AS total_cr FROM customer", *_TX,
)
_OVER_SQL = """over2 AS (SELECT account, source_file, tanggal, keterangan, kolom3, direction, amount, balance, source_sequence, 1 AS blk FROM inferred UNION ALL
  SELECT account, source_file, tanggal, keterangan, kolom3, direction, amount, (CASE WHEN event_id % 40 = 0 THEN balance + 5 ELSE balance END)::DECIMAL(20,2), source_sequence, 2 FROM inferred WHERE tanggal >= DATE '2024-01-21')"""
_register(
    "overlap_dedup", lambda spark, sf_dir: statements.overlap_dedup(A.overlapping(tx := _inferred(spark, sf_dir)), A.blocks(tx)).select("account", "statement_block", "source_sequence", "balance"),
    """SELECT account, account || '#' || blk AS statement_block, source_sequence, balance FROM (SELECT *, max(n) OVER (PARTITION BY account, tanggal, keterangan, kolom3, direction, amount, balance) AS k, row_number() OVER (PARTITION BY account, tanggal, keterangan, kolom3, direction, amount, balance ORDER BY blk, source_sequence) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY account, tanggal, keterangan, kolom3, direction, amount, balance, blk) AS n FROM over2)) WHERE p <= k""", *_TX, _INFER_SQL, _OVER_SQL,
)
_register(
    "overlap_conflicts", lambda spark, sf_dir: statements.overlap_conflicts(A.overlapping(_inferred(spark, sf_dir))),
    """SELECT account, tanggal, keterangan, kolom3, direction, amount, count(DISTINCT balance) AS all_balances, count(DISTINCT blk) AS blocks, greatest(count(DISTINCT CASE WHEN blk = 1 THEN balance END), count(DISTINCT CASE WHEN blk = 2 THEN balance END)) AS widest FROM over2 GROUP BY 1, 2, 3, 4, 5, 6
    HAVING count(DISTINCT blk) >= 2 AND greatest(count(DISTINCT CASE WHEN blk = 1 THEN balance END), count(DISTINCT CASE WHEN blk = 2 THEN balance END)) < count(DISTINCT balance)""", *_TX, _INFER_SQL, _OVER_SQL,
)
_register(
    "txt_parse_roundtrip", lambda spark, sf_dir: statements.parse_transactions(statements.classify(A.statement_lines(A.transactions(spark, sf_dir)))),
    """SELECT source_file, account, tanggal, keterangan || CASE WHEN event_id % 4 = 0 THEN ' LANJUTAN ' || kolom3 ELSE '' END AS keterangan, kolom3, direction, amount, db, cr, saldo, statement_block, source_line, source_sequence FROM tx""", *_TX,
)
_register(
    "txt_blocks", lambda spark, sf_dir: statements.parse_blocks(statements.classify(A.statement_lines(A.transactions(spark, sf_dir)))).select("source_file", "account", "saldo_awal", "period_start", "period_end"),
    "SELECT DISTINCT source_file, account, 100000::DECIMAL(20,2) AS saldo_awal, DATE '2024-01-01' AS period_start, DATE '2024-01-31' AS period_end FROM tx", *_TX,
)
_register(
    "opening_rows", lambda spark, sf_dir: statements.opening_rows(_inferred(spark, sf_dir), _ORDER),
    "SELECT account, year(tanggal)::INT AS year, month(tanggal)::INT AS month, 0::INT AS place, 'SALDO AWAL' AS keterangan, (min_by(CASE WHEN direction = 'DB' THEN balance + amount ELSE balance - amount END, source_sequence))::DECIMAL(20,2) AS balance FROM inferred GROUP BY 1, 2, 3", *_TX, _INFER_SQL,
)
_register(
    "dq_transactions",
    lambda spark, sf_dir: quality.transaction_issues(
        A.transactions(spark, sf_dir).select("source_file", "source_sequence", F.when(F.col("event_id") % 11 != 0, F.col("tanggal").cast("string")).alias("tanggal"), F.when(F.col("event_id") % 13 == 0, "TANGGAL KETERANGAN").when(F.col("event_id") % 17 != 0, F.col("keterangan")).alias("keterangan"),
                                             F.when(F.col("event_id") % 19 != 0, F.col("db").cast("string")).alias("db"), F.when(F.col("event_id") % 19 != 0, F.col("cr").cast("string")).alias("cr"), F.when(F.col("event_id") % 23 == 0, "x").otherwise(F.col("saldo").cast("string")).alias("saldo"), F.lit("").alias("validation_issue"))
    ).select("source_file", "rule_name", "severity", "row_number"),
    """SELECT source_file, rule_name, severity, (source_sequence + 1)::INT AS row_number FROM (SELECT *, unnest([CASE WHEN event_id % 11 = 0 THEN 'tanggal_required' END, CASE WHEN event_id % 13 <> 0 AND event_id % 17 = 0 THEN 'keterangan_required' END, CASE WHEN event_id % 19 = 0 THEN 'db_or_cr_required' END, CASE WHEN event_id % 23 = 0 THEN 'saldo_numeric' END, CASE WHEN event_id % 13 = 0 THEN 'header_row_removed' END]) AS rule_name,
    unnest(['ERROR', 'ERROR', 'ERROR', 'ERROR', 'WARNING']) AS severity FROM tx) WHERE rule_name IS NOT NULL""", *_TX,
)
_register(
    "reconcile_accounts",
    lambda spark, sf_dir: quality.reconcile(tx := A.transactions(spark, sf_dir), A.openings(tx).join(tx.groupBy("account").agg(F.max_by("saldo", F.when(F.col("saldo").isNotNull(), F.col("source_sequence"))).alias("saldo_akhir")), "account"), ["account"]),
    """SELECT account, (100000 + coalesce(sum(cr), 0) - coalesce(sum(db), 0))::DECIMAL(30,2) AS expected, (max_by(saldo, source_sequence) FILTER (WHERE saldo IS NOT NULL))::DECIMAL(30,2) AS saldo_akhir FROM tx GROUP BY 1
    HAVING abs(100000 + coalesce(sum(cr), 0) - coalesce(sum(db), 0) - (max_by(saldo, source_sequence) FILTER (WHERE saldo IS NOT NULL))) > 1""", *_TX,
)
_register("duplicate_months", lambda spark, sf_dir: statements.duplicate_months(_inferred(spark, sf_dir).withColumn("source_file", F.explode(F.array("source_file", F.concat("source_file", F.lit("-copy")))))),
          "SELECT account, year(tanggal)::INT AS year, month(tanggal)::INT AS month, source_file, count(*) AS rows FROM tx GROUP BY 1, 2, 3, 4", *_TX)
_register(
    "same_day_order", lambda spark, sf_dir: statements.same_day_order(A.shuffled_days(A.transactions(spark, sf_dir))),
    "SELECT account, source_row::INT AS source_row, (CASE WHEN ok OR status = 'unresolved' THEN source_row ELSE right_row END)::INT AS place, status FROM shuffled JOIN days USING (account, tanggal) JOIN judged USING (account)", *_TX, A.SHUFFLED_SQL,
)

_register(
    "account_metadata", lambda spark, sf_dir: accounts.metadata(statements.parse_blocks(statements.classify(A.statement_lines(A.transactions(spark, sf_dir))))).select("source_file", "account", "saldo_awal", "period_start", "period_end", "blocks"),
    "SELECT DISTINCT source_file, account, 100000::DECIMAL(20,2) AS saldo_awal, DATE '2024-01-01' AS period_start, DATE '2024-01-31' AS period_end, 1::BIGINT AS blocks FROM tx", *_TX,
)
_register(
    "direction_by_balance", lambda spark, sf_dir: accounts.direction_by_balance(A.transactions(spark, sf_dir), ["account"], _ORDER).select("account", "source_sequence", "side"),
    "SELECT account, source_sequence, CASE WHEN c = -amount THEN 'DB' WHEN c = amount THEN 'CR' END AS side FROM (SELECT *, saldo - lag(saldo) OVER (PARTITION BY account ORDER BY source_sequence) AS c FROM tx)", *_TX,
)
_register(
    "recap_long", lambda spark, sf_dir: accounts.long_recap(statements.mart(A.transactions(spark, sf_dir), ["account"]), ["account"], {"total_db": "MUTASI DB", "total_cr": "MUTASI CR"}),
    f"SELECT account, unnest(['MUTASI DB', 'MUTASI CR']) AS keterangan, unnest([db, cr]) AS amount FROM (SELECT account, {_dec('db', 2).replace('38', '30')} AS db, {_dec('cr', 2).replace('38', '30')} AS cr FROM tx GROUP BY 1)", *_TX,
)
_register(
    "parse_differences", lambda spark, sf_dir: accounts.compare_rows(tx := A.transactions(spark, sf_dir), tx.withColumn("amount", F.when(F.col("event_id") % 25 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(20,2)")), ["account", "source_sequence"], ["amount", "keterangan"]),
    "SELECT account, source_sequence, 'amount' AS column, amount::VARCHAR AS a, (amount + 1)::VARCHAR AS b FROM tx WHERE event_id % 25 = 0", *_TX,
)

# --- files, ledger, scans --------------------------------------------------------------------

_register("incremental_to_parse", lambda spark, sf_dir: L.to_parse(A.files(spark, sf_dir), A.ledger(spark, sf_dir), "report", "core", "1"), "SELECT 'h-' || c_custkey AS file_hash, c_name AS file_name FROM customer WHERE 'h-' || c_custkey NOT IN (SELECT file_hash FROM ledger WHERE status = 'success' AND parser_version = '1')", A.LEDGER_SQL)
_register("incremental_to_reuse", lambda spark, sf_dir: L.to_reuse(A.files(spark, sf_dir), A.ledger(spark, sf_dir), "report", "core", "1"), "SELECT 'h-' || c_custkey AS file_hash, c_name AS file_name FROM customer WHERE 'h-' || c_custkey IN (SELECT file_hash FROM ledger WHERE status = 'success' AND parser_version = '1')", A.LEDGER_SQL)
_register("latest_success_by_hash", lambda spark, sf_dir: L.latest_by_hash(A.ledger(spark, sf_dir)).select("file_hash", "file_name", "processed_at"), "SELECT file_hash, file_name, processed_at FROM ledger WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY processed_at DESC, file_name DESC) = 1", A.LEDGER_SQL)
_register(
    "job_status", lambda spark, sf_dir: L.job_status(A.ledger(spark, sf_dir)),
    "SELECT job_id, count(*) AS files, count_if(status = 'failed')::BIGINT AS failed, sum(row_count)::BIGINT AS rows, CASE WHEN count_if(status = 'failed') = 0 THEN 'success' WHEN count_if(status = 'failed') < count(*) THEN 'partial_success' ELSE 'failed' END AS status FROM ledger GROUP BY 1", A.LEDGER_SQL,
)
_register("job_history", lambda spark, sf_dir: L.history(A.ledger(spark, sf_dir)).select("job_id", "file_name", "status", "processed_at"), "SELECT job_id, file_name, status, processed_at FROM ledger ORDER BY processed_at DESC, file_name DESC LIMIT 50", A.LEDGER_SQL)
_WORDS = {"en": [(" the ", 3), (" of ", 2), (" with ", 1)], "de": [(" der ", 3), (" und ", 2), (" die ", 1)], "fr": [(" le ", 3), (" des ", 2), (" la ", 1)]}
_score_sql = lambda k: " + ".join(f"(CASE WHEN contains(lower(text), '{m}') THEN {w} ELSE 0 END)" for m, w in _WORDS[k])
_register(
    "marker_score", lambda spark, sf_dir: A.table(spark, sf_dir, "documents").select("doc_id", detect.best_of({k: detect.score(F.lower("text"), m) for k, m in _WORDS.items()}, 4).alias("best")),
    f"SELECT doc_id, CASE WHEN top < 4 OR (CASE WHEN en = top THEN 1 ELSE 0 END) + (CASE WHEN de = top THEN 1 ELSE 0 END) + (CASE WHEN fr = top THEN 1 ELSE 0 END) > 1 THEN NULL WHEN en = top THEN 'en' WHEN de = top THEN 'de' ELSE 'fr' END AS best FROM (SELECT *, greatest(en, de, fr) AS top FROM (SELECT doc_id, {_score_sql('en')} AS en, {_score_sql('de')} AS de, {_score_sql('fr')} AS fr FROM documents))",
)
_TEXT = f"upper(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_register("bank_detect", lambda spark, sf_dir: A.table(spark, sf_dir, "documents").select("doc_id", detect.detect_bank(F.concat(F.when(F.col("doc_id") % 5 == 0, "BANK CENTRAL ASIA ").when(F.col("doc_id") % 5 == 1, "Kopra by\nMandiri ").when(F.col("doc_id") % 5 == 2, "LAPORAN TRANSAKSI FINANSIAL ").otherwise(""), "text"), F.lit("x.pdf")).alias("bank")),
          "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'BCA' WHEN 1 THEN 'Mandiri' WHEN 2 THEN 'BRI' END AS bank FROM documents")
_found_sql = lambda k, p: (f"len(list_filter(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'), lambda x: NOT regexp_matches(x, '{detect.SAFE.replace(chr(39), chr(39) * 2)}')))" if k == "assigned credential" else f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))")
_scan_sql = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS family, {_found_sql(k, p)} AS findings FROM documents" for k, p in detect.SCAN.items())
_register("privacy_scan", lambda spark, sf_dir: detect.scan(A.table(spark, sf_dir, "documents"), "doc_id", "text"), f"SELECT doc_id, family, findings::BIGINT AS findings FROM ({_scan_sql}) WHERE findings > 0")
_register("lineage_roundtrip", lambda spark, sf_dir: sources.without_lineage(sources.with_lineage(A.ledger(spark, sf_dir).select("file_name", "file_hash", "status"), "job-1", "core", "1")), "SELECT file_name, file_hash, status FROM ledger", A.LEDGER_SQL)
_register(
    "sheet_names", lambda spark, sf_dir: accounts.unique_names(A.table(spark, sf_dir, "part"), ["p_brand"], "p_type", ["p_partkey"]).select("p_partkey", "sheet"),
    "SELECT p_partkey, CASE WHEN n = 1 THEN safe ELSE substr(safe, 1, 31 - length('_' || n)) || '_' || n END AS sheet FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(safe) ORDER BY p_partkey) AS n FROM (SELECT *, substr(trim(regexp_replace(p_type, '\\s+', ' ', 'g')), 1, 31) AS safe FROM part))",
)
_register(
    "error_rows", lambda spark, sf_dir: accounts.error_rows(A.ledger(spark, sf_dir).where("status = 'failed'").select("file_name", F.col("status").alias("error")), "job-x", "parse", "ParseError").drop("occurred_at"),
    "SELECT 'job-x' AS job_id, file_name, 'parse' AS stage, 'ParseError' AS error_type, status AS error_message FROM ledger WHERE status = 'failed'", A.LEDGER_SQL,
)
