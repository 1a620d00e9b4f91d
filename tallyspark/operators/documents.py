"""Statement documents: what their pages print besides transactions, the checks between the two, and the frames made of both.

The patterns and labels below are what the banks print (fixed values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P
from tallyspark.operators import reports
from tallyspark.operators.statements import category_exclusive

#: Account, type, period and currency by bank: a pattern whose first group is the value, or =value.
FIELDS = {
    "BCA": {"account": r"NO\. REKENING\s*:\s*(\d+)", "account_type": r"^\s*(REKENING (?:TAHAPAN|GIRO))\s*$", "period": r"PERIODE\s*:\s*([^\r\n]+)", "currency": r"MATA UANG\s*:\s*(\w+)"},
    "BRI": {"account": r"No\. Rekening\s*:\s*(\d+)", "account_type": r"Nama Produk\s*:\s*(.*?)\s{3,}", "period": r"Periode Transaksi\s*:\s*(\d{2}/\d{2}/\d{2}\s*-\s*\d{2}/\d{2}/\d{2})", "currency": r"Valuta\s*:\s*(\w+)"},
    "BNI": {"account": r"TAPLUS.*?-\s*(\d+)", "account_type": "=TAPLUS MUDA", "period": r"Periode:\s*([^\r\n]+)", "currency": r"Mata Uang:\s*(\w+)"},
    "Mandiri": {"account": r"Account No\.?(?:\s+Account Name[^\n]*\n)?\s+(\d+)", "account_type": "=Account Statement", "period": r"^Period\s+(?:Currency\s+Branch\s*\n\s*)?([^\r\n]+?\d{4})\b(?:\s+\w+\s+\w+)?$", "currency": (r"^Currency\s+(\w+)", r"^Period\s+Currency\s+Branch\s*\n[^\n]*\d{4}\s+(\w+)")},
    "DKI": {"account": r"DKI\s*-\s*(\d+)", "account_type": "=Tabungan", "period": r"\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+20\d{2})", "currency": "=IDR"},
}
AMOUNT = r"([\d,]+\.\d{2})"
FOUR = rf"{AMOUNT}\s+[+-]?{AMOUNT}\s+[+-]?{AMOUNT}\s+{AMOUNT}"
SUMMARY = ["saldo_awal", "cr_total", "db_total", "saldo_akhir", "cr_count", "db_count"]


def texts(lines: DataFrame) -> DataFrame:
    """source_file, text: a document's pages in order."""
    return lines.groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def field(pattern: str | tuple[str, ...], text: str = "text") -> Column:
    """The first group of the pattern's (or the first pattern's that has one) first match, by line and whatever the case, with single spaces; null if there is none."""
    if isinstance(pattern, str) and pattern.startswith("="):
        return F.lit(pattern[1:])
    return F.coalesce(*(P.blank_to_null(F.regexp_extract(F.col(text), f"(?im){p}", 1)) for p in ([pattern] if isinstance(pattern, str) else pattern)))


def _only(label: str, rest: str, group: int) -> Column:
    """A group of the one match of a label; null if there are more or none."""
    pattern = f"{label}{rest}"
    found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group))
    return F.when(F.size(found) == 1, F.nullif(F.get(found, 0), F.lit("")))


def _printed(bank: str) -> dict[str, Column]:
    """The printed recap of a document with one account; null where it is missing or not clear."""
    money = lambda c: P.us_money(c)
    four = lambda at, names: {n: F.get(at, names.index(n)) for n in ("saldo_awal", "cr_total", "db_total", "saldo_akhir")}
    none = {"cr_count": F.lit(None).cast("long"), "db_count": F.lit(None).cast("long")}
    if bank == "BCA":
        line = r"\s*:\s*([\d,]+\.\d{2})(?:[^\S\n]+(\d+))?"
        return {
            "saldo_awal": money(_only("SALDO AWAL", line, 1)), "cr_total": money(_only("MUTASI CR", line, 1)), "db_total": money(_only("MUTASI DB", line, 1)), "saldo_akhir": money(_only("SALDO AKHIR", line, 1)),
            "cr_count": _only("MUTASI CR", line, 2).try_cast("long"), "db_count": _only("MUTASI DB", line, 2).try_cast("long"),
        }
    if bank == "BRI":
        return four(reports.recap_bounded(F.col("text")), ["saldo_awal", "db_total", "cr_total", "saldo_akhir"]) | none
    if bank == "BNI":
        return four(reports.recap(F.col("text"), ["Saldo Awal", "Total Pemasukan", "Total Pengeluaran", "Saldo Akhir"], 4), ["saldo_awal", "cr_total", "db_total", "saldo_akhir"]) | none
    # Labels stand before their values, or three of them head a line with three values.
    one = lambda label: money(field(label + r"[^\S\n]+([\d,]+\.\d{2})"))
    opened = reports.recap(F.col("text"), ["Opening Balance", "No. of Debit", "Total Amount Debited"], 3, reports.INTEGER)
    closed = reports.recap(F.col("text"), ["Closing Balance", "No. of Credit", "Total Amount Credited"], 3, reports.INTEGER)
    return {
        "saldo_awal": F.coalesce(one("Opening Balance"), F.get(opened, 0)), "cr_total": F.coalesce(one("Total Amount Credited"), F.get(closed, 2)), "db_total": F.coalesce(one("Total Amount Debited"), F.get(opened, 2)),
        "saldo_akhir": F.coalesce(one("Closing Balance"), F.get(closed, 0)), "cr_count": F.coalesce(field(r"No\.? of Credit[^\S\n]+(\d+)").try_cast("long"), F.get(closed, 1).cast("long")),
        "db_count": F.coalesce(field(r"No\.? of Debit[^\S\n]+(\d+)").try_cast("long"), F.get(opened, 1).cast("long")),
    }


def summaries(lines: DataFrame, bank: str) -> DataFrame:
    """source_file, bank, account, account_type, period, currency, saldo_awal, cr_total, db_total, saldo_akhir, cr_count, db_count, error.

    One row per account of a document. What isn't printed is null; error names the first field that
    should be there and isn't, or says that the recap is missing or not clear.
    """
    fields = FIELDS[bank]
    docs = texts(lines).select("source_file", "text", F.lit(bank).alias("bank"), *(field(p).alias(c) for c, p in fields.items()))
    if bank == "DKI":
        after = F.lead("line").over(Window.partitionBy("source_file").orderBy("page", "line_no"))
        own = lines.withColumn("after", after).where(F.col("line").rlike(rf"^\s*TAB(?:UNGAN)?\s+MONAS.*{FOUR}"))
        at = lambda n: P.us_money(F.regexp_extract("line", FOUR, n))
        recaps = own.select("source_file", F.nullif(F.regexp_extract("after", r"-\s*(\d+)", 1), F.lit("")).alias("account"), at(1).alias("saldo_awal"), at(2).alias("cr_total"), at(3).alias("db_total"), at(4).alias("saldo_akhir"))
        rows = docs.drop("account", "text").join(recaps, "source_file", "left").withColumns({c: F.lit(None).cast("long") for c in ("cr_count", "db_count")})
    else:
        rows = docs.withColumns(_printed(bank)).drop("text")
    lacking = [F.when(F.col(c).isNull(), f"missing statement field: {c}") for c in fields]
    return rows.select("source_file", "bank", "account", "account_type", "period", "currency", *SUMMARY, F.coalesce(*lacking, F.when(F.col("saldo_awal").isNull() | F.col("saldo_akhir").isNull(), "missing or ambiguous recap")).alias("error"))


def errors(found: DataFrame, tx: DataFrame) -> DataFrame:
    """source_file, account, error of each broken check: fields and recap of the summary, and the transactions against it.

    tx: as layouts.read() gives it; a transaction without an account belongs to its document's.
    """
    keys = ["source_file", "account"]
    whole = found.where("error IS NULL")
    own = tx.withColumnRenamed("account", "_own").join(whole.select(*keys), "source_file").where("_own IS NULL OR _own = account")
    rows = own.select(*keys, "source_row", F.col("debit").alias("db"), F.col("credit").alias("cr"), F.col("balance").alias("saldo"))
    broken = reports.statement_errors(rows, whole, keys, ["source_row"])
    unread = tx.where("error IS NOT NULL").select(*keys, F.concat(F.lit("transaction "), F.col("source_row").cast("string"), F.lit(": "), F.col("error")).alias("error"))
    return found.where("error IS NOT NULL").select(*keys, "error").unionByName(broken.select(*keys, "error")).unionByName(unread)


def transactions_frame(tx: DataFrame, found: DataFrame, bank: str) -> DataFrame:
    """The transactions as a statement's frame; extra columns by bank: posting date, clock and signed amount, or account and source row."""
    base = [F.col("source_file"), F.col("source_row"), F.col("tanggal"), F.col("keterangan"), F.col("debit").alias("db"), F.col("credit").alias("cr"), F.col("balance").alias("saldo")]
    extra = {
        "Mandiri": [F.col("posting").alias("posting_date")],
        "BNI": [F.coalesce("credit", -F.col("debit")).cast("decimal(20,2)").alias("mutasi")],
        "DKI": [F.col("account"), F.col("posting").alias("tanggal_jam"), F.col("source_row").alias("source_pdf_row")],
    }.get(bank, [])
    known = found.where("error IS NULL").select("source_file").distinct()
    return tx.join(known, "source_file", "left_semi").select(*base, *extra)


def recap_frame(tx: DataFrame, found: DataFrame, bank: str) -> DataFrame:
    """The recap of each account: wide for DKI, else long (keterangan, amount, frekuensi) with the categories after the printed rows; saldo_awal and saldo_akhir stand beside each."""
    keys = ["source_file", "account"]
    whole = found.where("error IS NULL")
    rows = tx.drop("account").join(whole.select(*keys, "account_type"), "source_file") if bank != "DKI" else tx.join(whole.select(*keys, "account_type"), keys)
    giro = F.upper(F.coalesce("account_type", F.lit(""))).contains("GIRO")
    named = rows.select(*keys, F.col("debit").alias("db"), F.col("credit").alias("cr"), "keterangan", "account_type").withColumn("_cat", category_exclusive(giro))
    cats = ["Adm", "Pajak", "Bunga", "Saldo Min", "JaGir"]
    sums = named.groupBy(*keys).agg(*(F.sum(F.when(F.col("_cat") == c, F.coalesce("db", "cr"))).cast("decimal(30,2)").alias(c.lower().replace(" ", "_")) for c in cats))
    both = whole.join(sums, keys, "left")
    if bank == "DKI":
        return both.select(*keys, "saldo_awal", F.col("cr_total").alias("transaksi_masuk"), F.col("db_total").alias("transaksi_keluar"), "saldo_akhir", *(c.lower().replace(" ", "_") for c in cats))
    labels = ["SALDO AWAL", "MUTASI CR", "MUTASI DB", "SALDO AKHIR"] if bank == "BCA" else ["Saldo Awal", "Total Pemasukan", "Total Pengeluaran", "Saldo Akhir"]
    one = lambda k, label, amount, count=None: F.struct(F.lit(k).alias("place"), F.lit(label).alias("keterangan"), F.col(amount).cast("decimal(30,2)").alias("amount"), (F.col(count) if count and bank == "BCA" else F.lit(None)).cast("long").alias("frekuensi"))
    printed = [one(k, label, *c) for k, (label, c) in enumerate(zip(labels, (("saldo_awal",), ("cr_total", "cr_count"), ("db_total", "db_count"), ("saldo_akhir",)), strict=True))]
    each = F.array(*printed, *(one(4 + k, c, c.lower().replace(" ", "_")) for k, c in enumerate(cats)))
    return both.select(*keys, F.explode(each).alias("x"), "saldo_awal", "saldo_akhir").select(*keys, "x.*", "saldo_awal", "saldo_akhir")


def monthly_by_posting(frame: DataFrame) -> DataFrame:
    """Figures of each document and month of posting; the opening balance follows from the month's first row."""
    first = F.min_by(F.col("saldo") + F.coalesce("db", F.lit(0)) - F.coalesce("cr", F.lit(0)), "source_row").cast("decimal(20,2)")
    return frame.groupBy("source_file", F.year("posting_date").alias("year"), F.month("posting_date").alias("month")).agg(
        F.sum("db").cast("decimal(30,2)").alias("db_total"), F.count("db").alias("db_count"), F.sum("cr").cast("decimal(30,2)").alias("cr_total"), F.count("cr").alias("cr_count"), first.alias("saldo_awal"),
        F.max_by("saldo", F.when(F.col("saldo").isNotNull(), F.col("source_row"))).alias("saldo_akhir"),
    )


def month_of(period: Column) -> tuple[Column, Column]:
    """Year and month that a printed period begins with: a month's name and a year, or a date."""
    words = F.filter(F.transform(F.split(period, r"[^A-Za-z]+"), P.month_number), lambda m: m.isNotNull())
    dated = P.date(F.regexp_extract(period, r"(\d{1,2}/\d{1,2}/\d{2,4})", 1))
    year = F.coalesce(F.regexp_extract(period, r"\b(20\d{2})\b", 1).try_cast("int"), F.year(dated))
    return year, F.coalesce(F.get(words, 0), F.month(dated))


def printed_months(found: DataFrame, tx: DataFrame) -> DataFrame:
    """Of each account the month's figures as they are printed; counts that aren't printed are those of the transactions."""
    counts = tx.groupBy("source_file").agg(F.count("debit").alias("_db"), F.count("credit").alias("_cr"))
    year, month = month_of(F.col("period"))
    return found.where("error IS NULL").join(counts, "source_file", "left").select(
        "account", year.alias("year"), month.alias("month"), "saldo_awal", "db_total", F.coalesce("db_count", "_db", F.lit(0)).cast("long").alias("db_count"), "cr_total", F.coalesce("cr_count", "_cr", F.lit(0)).cast("long").alias("cr_count"), "saldo_akhir"
    )


def workbook(months: DataFrame, tx: DataFrame, keys: list[str], order: list[str]) -> dict[str, DataFrame]:
    """A yearly workbook as named tables: Summary (with a mean row for each year: place 1, means over the months that have the figure) and Months (all months' sheets, a sheet name in each row)."""
    figures = ["db_total", "cr_total", "db_count", "cr_count"]
    label = lambda y, m: F.concat(F.get(F.array(*(F.lit(x) for x in ("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))), m - 1), F.lit("_"), F.lpad((y % 100).cast("string"), 2, "0"))
    base = months.select(*keys, "year", "month", F.lit(0).alias("place"), *(F.col(c).cast("decimal(30,2)").alias(c) for c in figures))
    mean = base.groupBy(*keys, "year").agg(F.lit(None).cast("int").alias("month"), F.lit(1).alias("place"), *(F.coalesce(F.avg(c), F.lit(0)).cast("decimal(30,2)").alias(c) for c in figures))
    sheets = tx.withColumn("sheet", label(F.year("tanggal"), F.month("tanggal")))
    return {"Summary": base.unionByName(mean.select(*base.columns)), "Months": sheets.select("sheet", *keys, *order, "tanggal", "keterangan", "db", "cr")}
