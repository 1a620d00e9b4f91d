"""Transactions from the page text of five banks' statements.

A layout is data: what opens and closes a table on a page, how a transaction begins, the pattern of
the line with its amounts. One native pass reads them all: marks switch a page's table on and off,
running sums number the transactions, and each transaction's lines are folded into one row. A row
that doesn't fit its pattern keeps its text and says so in error; nothing is dropped silently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P

M = r"([\d,]+\.\d{2})"


@dataclass(frozen=True)
class Layout:
    bank: str
    start: str  # the first line of a transaction
    amounts: str  # the line with amounts; groups: (when)(text) and those that fields() reads
    stamp: str  # how 'when' is written
    stop: str  # ends the table
    header: tuple[str, ...] = ()  # marks that begin the table; none: a start does
    noise: str = r"^\s*$"  # lines to pass over
    head_noise: str = ""  # dropped from the end of the first text
    more_noise: str = ""  # dropped from the beginning of the lines that follow
    cut_at: str = ""  # lines that follow end two places before this mark of the header
    later: bool = False  # the amounts are not on the first line
    account: str = ""  # a line that names the account of what follows
    skip: str = ""  # a first line that is no transaction
    signed: bool = False  # the sign tells the side, of an amount of zero too


LAYOUTS = {
    "BCA": Layout("BCA", r"^\s*\d{2}/\d{2}\s", rf"^\s*(\d{{2}}/\d{{2}})\s+(.*?)\s*{M}\s*(DB)?\s*(?:{M})?\s*$", "", r"Bersambung ke halaman|SALDO AWAL\s*:", ("TANGGAL", "KETERANGAN", "CBG", "MUTASI", "SALDO"), skip="SALDO AWAL"),
    "BRI": Layout(
        "BRI", r"^\s*\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\s", rf"^\s*(\d{{2}}/\d{{2}}/\d{{2}} \d{{2}}:\d{{2}}:\d{{2}})\s+(.*?)\s+{M}\s+{M}\s+{M}\s*$", "dd/MM/yy HH:mm:ss", "Saldo Awal|Created By|IBIZ_|Terbilang",
        ("Tanggal Transaksi", "Uraian Transaksi", "Teller"), noise=r"^\s*$|Transaction Date", head_noise=r"\s{2,}[A-Z0-9]{4,10}\s*$",
    ),
    "BNI": Layout(
        "BNI", r"^\s*\d{2} [A-Za-z]{3} \d{4}\s", r"^\s*(\d{2} [A-Za-z]{3} \d{4})\s+(.*?)\s+([+-]?\d[\d,]*(?:\.\d{2})?)\s+(\d[\d,]*(?:\.\d{2})?)\s*$", "dd MMM yyyy", "PT Bank Negara|Informasi Lainnya|Saldo Akhir",
        ("Tanggal & Waktu", "Nominal (IDR)"), noise=r"^\s*$|Saldo Awal", more_noise=r"^\s*\d{2}:\d{2}:\d{2}\s+WIB\s*", cut_at="Nominal (IDR)",
    ),
    "Mandiri": Layout("Mandiri", r"^\s*(?:\d{2}/\d{2}/\d{4} \d{2}:\d{2}:(?:\d{2})?|\d{2} [A-Za-z]{3} \d{4},)\s*$", rf"^()(.*?)\s*{M}\s+{M}\s+{M}\s*$", "", r"(?!)", noise=r"^\s*$", later=True),
    "DKI": Layout(
        "DKI", r"^\s*\d{2} [A-Za-z]{3} \d{2} \d{2}:\d{2}\s", rf"^\s*(\d{{2}} [A-Za-z]{{3}} \d{{2}} \d{{2}}:\d{{2}})\s+(.*?)\s*\b(DEBIT|KREDIT)\s+{M}\s+{M}\s*$", "dd MMM yy HH:mm", "DISCLAIMER",
        account=r"^\s*TAB(?:UNGAN)?\s+MONAS.*?-\s*(\d+)\s*$",
    ),
}

#: As the competing readers of one bank take its ledger: what has no plus is a debit, so a zero has a side.
SIGNED = replace(LAYOUTS["BNI"], signed=True)


def _signed(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("decimal(20,2)")


def _fields(layout: Layout, group: Callable[[int], Column]) -> tuple[Column, Column, Column]:
    """debit, credit, balance; a zero side is null, unless the layout's sign tells it."""
    bank = layout.bank
    if bank == "BCA":
        return F.when(group(4) == "DB", P.us_money(group(3))), F.when(group(4) != "DB", P.us_money(group(3))), P.us_money(group(5))
    if bank == "BNI":
        n = _signed(group(3))
        if layout.signed:
            plus = group(3).startswith("+")
            return F.when(~plus, F.abs(n)), F.when(plus, F.abs(n)), _signed(group(4))
        return F.when(n < 0, -n), F.when(n > 0, n), _signed(group(4))
    if bank == "DKI":
        return F.when(group(3) == "DEBIT", P.us_money(group(4))), F.when(group(3) == "KREDIT", P.us_money(group(4))), P.us_money(group(5))
    return F.nullif(P.us_money(group(3)), F.lit(0)), F.nullif(P.us_money(group(4)), F.lit(0)), P.us_money(group(5))


def read(lines: DataFrame, layout: Layout) -> DataFrame:
    """source_file, account, page, source_row, posting, tanggal (dd/MM), keterangan, debit, credit, balance, error.

    lines: source_file, page, line_no, line. source_row numbers a document's transactions.
    """
    in_page = Window.partitionBy("source_file", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    in_file = Window.partitionBy("source_file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.col("line")
    is_header = F.lit(False)
    if layout.header:
        is_header = F.lit(True)
        for mark in layout.header:
            is_header = is_header & line.contains(mark)
    starts = line.rlike(layout.start) & ~(line.contains(layout.skip) if layout.skip else F.lit(False))
    named = F.nullif(F.regexp_extract(line, layout.account, 1), F.lit("")) if layout.account else F.lit(None).cast("string")
    switch = F.when(is_header, 1).when(named.isNotNull() | line.rlike(layout.stop), 0)
    if not layout.header:
        switch = switch.when(starts, 1)
    rows = lines.withColumns({"_header": is_header, "_named": named, "_switch": switch, "_starts": starts})
    # A table without a header goes on over a page's end.
    span = in_page if layout.header else in_file
    rows = rows.withColumns({"_on": F.coalesce(F.last("_switch", ignorenulls=True).over(span), F.lit(0)), "account": F.last("_named", ignorenulls=True).over(in_file)})
    if layout.cut_at:
        rows = rows.withColumn("_cut", F.last(F.when(F.col("_header"), F.instr("line", layout.cut_at) - 3), ignorenulls=True).over(in_page))
    # A line of the table that begins like a transaction but isn't one belongs to none.
    body = rows.where((F.col("_on") == 1) & ~F.col("_header") & F.col("_named").isNull() & ~line.rlike(layout.noise) & (F.col("_starts") | ~line.rlike(layout.start)))
    numbered = body.withColumn("source_row", F.sum(F.col("_starts").cast("int")).over(in_file)).where("source_row > 0")
    text = F.substring("line", 1, F.greatest(F.col("_cut"), F.lit(0))) if layout.cut_at else line
    cut = F.when(F.col("_starts"), line).otherwise(text)
    each = numbered.groupBy("source_file", "source_row").agg(
        F.max(F.when(F.col("_starts"), F.col("account"))).alias("account"), F.min("page").alias("page"), F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", cut.alias("line")))), lambda x: x["line"]).alias("lines")
    )
    if layout.later:
        at = F.array_position(F.transform("lines", lambda x: x.rlike(layout.amounts)), True).cast("int")
        each = each.withColumn("_at", at).withColumn("first", F.when(F.col("_at") > 0, F.get("lines", F.col("_at") - 1)).otherwise(""))
        clock = r"^\s*\d{2}(?::\d{2}:\d{2})?\s*$"
        inner = F.slice("lines", 2, F.greatest(F.col("_at") - 2, F.lit(0)))
        first_time = F.coalesce(F.get(F.filter(inner, lambda x: x.rlike(clock)), 0), F.lit(""))
        said = F.filter(inner, lambda x: ~x.rlike(clock))
        head = F.trim(F.get("lines", 0))
        modern = head.endswith(",")
        when = F.when(modern, F.concat(F.regexp_replace(head, ",$", " "), F.trim(first_time))).when(head.rlike(r":\d{2}:\d{2}$"), head).otherwise(F.concat(head, F.trim(first_time)))
        posting = F.coalesce(F.try_to_timestamp(when, F.lit("dd MMM yyyy HH:mm:ss")), F.try_to_timestamp(when, F.lit("dd/MM/yyyy HH:mm:ss")))
        described = F.array_append(said, F.regexp_replace(F.rtrim(F.regexp_extract("first", layout.amounts, 2)), "-$", ""))
    else:
        each = each.withColumn("first", F.get("lines", 0))
        when = F.regexp_extract("first", layout.amounts, 1)
        posting = F.try_to_timestamp(when, F.lit(layout.stamp)) if layout.stamp else F.lit(None).cast("timestamp")
        more = F.slice("lines", 2, F.size("lines"))
        if layout.more_noise:
            more = F.transform(more, lambda x: F.regexp_replace(x, layout.more_noise, ""))
        own = F.regexp_extract("first", layout.amounts, 2)
        described = F.concat(F.array(F.regexp_replace(own, layout.head_noise, "") if layout.head_noise else own), more)
    fits = F.col("first").rlike(layout.amounts)
    debit, credit, balance = _fields(layout, lambda n: F.regexp_extract("first", layout.amounts, n))
    compact = F.array_join(F.filter(F.transform(described, P.clean_text), lambda x: x != ""), " ")
    out = each.select(
        "source_file", "account", "page", F.col("source_row").cast("int").alias("source_row"), posting.cast("timestamp_ntz").alias("posting"), F.coalesce(F.date_format(posting, "dd/MM"), F.nullif(when, F.lit(""))).alias("tanggal"),
        compact.alias("keterangan"), F.when(fits, debit).alias("debit"), F.when(fits, credit).alias("credit"), F.when(fits, balance).alias("balance"), fits.alias("_fits"),
    )
    both = F.col("debit").isNotNull() & F.col("credit").isNotNull()
    return out.withColumn("error", F.when(~F.col("_fits"), "missing amounts").when(both, "debit and credit")).drop("_fits")


def sheets(monthly: DataFrame, issues: DataFrame) -> dict[str, DataFrame]:
    """What a workbook holds, by sheet: the months of all accounts by year, month and file (if it has one), and the issues (a row that says so if there are none)."""
    none = issues.sparkSession.createDataFrame([("no_issues", "INFO")], "rule_name string, severity string")
    have = issues.select("rule_name", "severity")
    return {"Summary": monthly.orderBy("account", "year", "month", *(c for c in ("source_file",) if c in monthly.columns)), "Data_Quality": have if not have.isEmpty() else none}
