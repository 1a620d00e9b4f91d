"""Data-quality rules as data: each is a predicate with its severity, column and message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P
from tallyspark.operators.facilities import is_fallback


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    column: str | None
    broken: Column
    message: str | Column


def issues(df: DataFrame, table: str, rules: list[Rule], row: Column) -> DataFrame:
    """One row per broken rule and row of df, in one pass."""
    each = [
        F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"), F.lit(r.column).cast("string").alias("column_name"), (F.lit(r.message) if isinstance(r.message, str) else r.message).alias("message")))
        for r in rules
    ]
    found = df.select("source_file", row.cast("int").alias("row_number"), F.explode(F.array_compact(F.array(*each))).alias("i"))
    return found.select("source_file", F.lit(table).alias("table_name"), "i.rule_name", "i.severity", "i.column_name", "row_number", "i.message")


def facility_rules() -> list[Rule]:
    text = lambda c: P.clean_text(F.col(c))
    plafond, baki, rate = P.rupiah(F.col("plafond")), P.rupiah(F.col("baki_debet")), F.regexp_replace("rate", ",", ".").try_cast("double")
    fallback, kol = is_fallback(F.col("keterangan")), P.grade(F.col("kol"))
    percent = F.when(rate.between(0, 1), rate * 100).otherwise(rate)
    return [
        Rule("nama_required", "ERROR", "nama", ~fallback & (text("nama") == ""), "a facility needs a debtor"),
        Rule("identity_format", "WARNING", "nik_npwp", (text("nik_npwp") != "") & ~text("nik_npwp").rlike(r"^\d{15,16}$"), "an identity has 15 or 16 digits"),
        Rule("bank_required", "ERROR", "bank", ~fallback & (text("bank") == ""), "a facility needs a bank"),
        Rule("kol_range", "ERROR", "kol", ~kol.between(1, 5), "a grade is 1 to 5"),  # fallback rows too
        Rule("plafond_non_negative", "ERROR", "plafond", plafond < 0, "a limit is not negative"),
        Rule("baki_debet_non_negative", "ERROR", "baki_debet", baki < 0, "an outstanding amount is not negative"),
        Rule("baki_debet_over_plafond", "WARNING", "baki_debet", (plafond >= 0) & (baki > plafond), "outstanding over the limit"),
        Rule("rate_range", "WARNING", "rate", ~percent.between(0, 100), "a rate is 0 to 100 percent"),
        Rule("jatuh_tempo_date", "WARNING", "jatuh_tempo", (text("jatuh_tempo") != "") & P.date(F.col("jatuh_tempo")).isNull(), "the maturity is no date"),
        Rule("fallback_exposure", "ERROR", "keterangan", fallback & ((plafond != 0) | (baki != 0)), "a report without facilities has no exposure"),
    ]


def transaction_rules() -> list[Rule]:
    text = lambda c: P.clean_text(F.col(c))
    joined = F.upper(F.concat_ws(" ", *(text(c) for c in ("tanggal", "keterangan", "db", "cr", "saldo"))))
    return [
        Rule("tanggal_required", "ERROR", "tanggal", text("tanggal") == "", "a transaction needs a date"),
        Rule("keterangan_required", "ERROR", "keterangan", text("keterangan") == "", "a transaction needs a description"),
        Rule("db_or_cr_required", "ERROR", "db/cr", P.us_money(F.col("db")).isNull() & P.us_money(F.col("cr")).isNull(), "a transaction needs a debit or a credit"),
        Rule("saldo_numeric", "ERROR", "saldo", (text("saldo") != "") & P.us_money(F.col("saldo")).isNull(), "a balance is a number"),
        Rule("transaction_validation", "WARNING", "validation_issue", text("validation_issue") != "", text("validation_issue")),
        Rule("header_row_removed", "WARNING", None, joined.contains("TANGGAL") & joined.contains("KETERANGAN"), "a repeated header is among the transactions"),
    ]


def facility_issues(staged: DataFrame) -> DataFrame:
    return issues(staged, "stg_facilities", facility_rules(), F.col("seq") + 1)


def transaction_issues(tx: DataFrame) -> DataFrame:
    """tx has its columns as text; validation_issue carries a row's own messages."""
    return issues(tx, "stg_transactions", transaction_rules(), F.col("source_sequence") + 1)


def reconcile(tx: DataFrame, summaries: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """Keys of which opening, debits, credits and closing don't add up within the tolerance."""
    sums = tx.groupBy(*keys).agg(F.coalesce(F.sum("db"), F.lit(0)).alias("total_db"), F.coalesce(F.sum("cr"), F.lit(0)).alias("total_cr"))
    both = sums.join(summaries.select(*keys, "saldo_awal", "saldo_akhir"), keys).where("saldo_awal IS NOT NULL AND saldo_akhir IS NOT NULL")
    expected = (F.col("saldo_awal") + F.col("total_cr") - F.col("total_db")).cast("decimal(30,2)")
    return both.withColumn("expected", expected).where(F.abs(F.col("expected") - F.col("saldo_akhir")) > tolerance).select(*keys, "expected", F.col("saldo_akhir").cast("decimal(30,2)").alias("saldo_akhir"))


def parser_diagnostics(summaries: DataFrame) -> DataFrame:
    """An issue for each account whose summary carries a parser's messages (validation_issues)."""
    said = P.clean_text(F.col("validation_issues"))
    return summaries.where(said != "").select(
        "source_file", F.lit("stg_bank_statement_summary").alias("table_name"), F.lit("txt_parser_diagnostics").alias("rule_name"), F.lit("WARNING").alias("severity"), F.lit("validation_issues").alias("column_name"),
        F.lit(None).cast("int").alias("row_number"), said.alias("message"),
    )


def frame_errors(tx: DataFrame, keys: list[str]) -> DataFrame:
    """keys and error of each frame that can't be used: without rows with an amount, or with rows that lack a date, a description, a balance or both sides."""
    bad = lambda c: F.count_if(c) > 0
    sums = tx.groupBy(*keys).agg(
        bad(P.clean_text(F.col("tanggal").cast("string")) == "").alias("d"), bad(P.clean_text(F.col("keterangan")) == "").alias("k"), bad(F.col("saldo").isNull()).alias("s"), bad(F.col("db").isNull() & F.col("cr").isNull()).alias("n"),
        bad(F.col("db").isNotNull() & F.col("cr").isNotNull()).alias("b"),
    )
    checks = [("d", "missing date"), ("k", "missing description"), ("s", "missing balance"), ("n", "missing debit and credit"), ("b", "debit and credit")]
    return sums.select(*keys, F.explode(F.array_compact(F.array(*(F.when(F.col(c), m) for c, m in checks)))).alias("error"))
