"""Bank statements: text to transactions, balances, overlap between blocks, monthly figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P
from tallyspark.functions.lineage import checkpoint
from tallyspark.operators.ranking import chain_places, join_same

# --- text ------------------------------------------------------------------------------------

ACCOUNT = r"(?i)No\.\s*Rekening\s*:\s*(\d+)"
PERIOD = r"(?i)Periode\s+Tgl\.\s*:\s*(\d{1,2}/\d{1,2}/\d{2})\s+To\s+(\d{1,2}/\d{1,2}/\d{2})"
MONEY = r"\d[\d,]*\.\d{2}(?:\s+DB)?"
LINE = rf"(?i)^\s*(\d{{1,2}}/\d{{2}}/\d{{2}})\s+(.*?)\s+({MONEY})(?:\s+({MONEY}))?\s*$"
#: Words of lines that are no transaction text (fixed values).
METADATA = ["NO. REKENING", "NAMA NASABAH", "KUASA", "ALAMAT", "PLAFOND", "PERIODE TGL.", "HALAMAN KE", "BUNGA", "BUNGA OD", "DENDA", "TANGGAL BUKA", "TANGGAL AKHIR", "TANGGAL CETAK"]


def lines(files: DataFrame) -> DataFrame:
    """source_file, line_no, line of (source_file, content)."""
    split = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)
    return files.select("source_file", F.posexplode(split).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _money_at_end(line: Column) -> Column:
    return P.us_money(F.element_at(F.regexp_extract_all(line, F.lit(f"(?i)({MONEY})"), 1), -1))


def classify(text_lines: DataFrame, metadata_first: bool = False) -> DataFrame:
    """Lines with kind, block (0 before the first account) and tx (0 before the first transaction).

    A line is the first of these that it matches: account, period, opening, closing, carried,
    transaction, metadata, continuation. Period, opening and closing need an open block. Running
    sums number blocks and transactions; what closes a transaction starts a group without text.
    metadata_first: as the older reconciliation reader, which drops lines with a metadata word even
    if they are transactions.
    """
    upper = F.upper(P.clean_text(F.col("line")))
    keyword = F.lit(False)
    for word in METADATA:
        keyword = keyword | upper.contains(word)
    by_file = Window.partitionBy("source_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = text_lines.withColumn("text", P.clean_text(F.col("line"))).where("text <> ''")
    blocks = rows.withColumn("is_account", F.col("line").rlike(ACCOUNT)).withColumn("block", F.sum(F.col("is_account").cast("int")).over(by_file))
    inside = F.col("block") > 0
    kind = (
        F.when(F.col("is_account"), "account").when(F.lit(metadata_first) & (keyword | upper.rlike(r"^\*+$")) & ~F.col("line").rlike(PERIOD), "metadata").when(F.col("line").rlike(PERIOD) & inside, "period").when(F.col("line").rlike(r"(?i)SALDO\s+AWAL") & inside, "opening")
        .when(F.col("line").rlike(r"(?i)SALDO\s+AKHIR") & inside, "closing").when(F.col("line").rlike("(?i)PINDAHAN"), "carried").when(F.col("line").rlike(LINE), "tx")
        .when(keyword | upper.rlike(r"^\*+$"), "metadata").when(F.col("line").rlike(r"(?i)SALDO\s+(?:AWAL|AKHIR)"), "metadata").otherwise("more")
    )
    starts = F.col("kind").isin("account", "closing", "carried", "tx").cast("int")
    return blocks.withColumn("kind", kind).withColumn("part", F.sum(starts).over(by_file)).drop("is_account")


def parse_transactions(classified: DataFrame) -> DataFrame:
    """One row per transaction line, with the lines that continue it."""
    account = F.max(F.when(F.col("kind") == "account", F.regexp_extract("line", ACCOUNT, 1)))
    accounts = classified.where("kind = 'account'").groupBy("source_file", "block").agg(account.alias("account"))
    texts = classified.where("kind IN ('tx', 'more')").groupBy("source_file", "part").agg(
        F.min_by("line", F.struct(F.when(F.col("kind") == "tx", 0).otherwise(1), "line_no")).alias("line"), F.max(F.col("kind") == "tx").alias("is_tx"), F.max("block").alias("block"), F.min("line_no").alias("source_line"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "more", F.struct("line_no", "text")))), lambda x: x["text"]).alias("more"),
    ).where("is_tx")
    part = lambda n: F.regexp_extract("line", LINE, n)
    first, code = P.body_and_code(part(2))
    described = F.aggregate("more", P.strip_page_artefact(first), lambda a, x: P.strip_page_artefact(P.join_text(a, x)))
    amount, debit = P.us_amount(part(3)), P.is_debit(part(3))
    order = Window.partitionBy("source_file").orderBy("source_line")
    rows = texts.join(accounts, ["source_file", "block"], "left").where("account IS NOT NULL")
    return rows.select(
        "source_file", "account", P.statement_date(part(1)).alias("tanggal"), described.alias("keterangan"), code.alias("kolom3"), F.when(debit, "DB").otherwise("CR").alias("direction"), amount.alias("amount"),
        F.when(debit, amount).alias("db"), F.when(~debit, amount).alias("cr"), P.us_money(part(4)).alias("saldo"), F.concat_ws("#", "account", F.col("block").cast("string")).alias("statement_block"),
        F.col("source_line").cast("int").alias("source_line"), F.row_number().over(order).alias("source_sequence"),
    ).where("tanggal IS NOT NULL")


def parse_blocks(classified: DataFrame) -> DataFrame:
    """One row per block: account, opening (a carried balance sets it anew), closing, period, first line."""
    last = lambda kinds: F.max_by(_money_at_end(F.col("line")), F.when(F.col("kind").isin(kinds) & F.col("line").rlike(MONEY), F.col("line_no")))
    one = lambda kind, pattern, n: F.max(F.when(F.col("kind") == kind, F.regexp_extract("line", pattern, n)))
    return classified.where("block > 0").groupBy("source_file", "block").agg(
        one("account", ACCOUNT, 1).alias("account"), last(["opening", "carried"]).alias("saldo_awal"), last(["closing"]).alias("saldo_akhir"),
        P.statement_date(one("period", PERIOD, 1)).alias("period_start"), P.statement_date(one("period", PERIOD, 2)).alias("period_end"), F.min("line_no").alias("source_line_start"),
    ).withColumn("statement_block", F.concat_ws("#", "account", F.col("block").cast("string")))


# --- balances --------------------------------------------------------------------------------


def delta() -> Column:
    """What a row does to the balance: 0 if both or neither side is given."""
    return F.when(F.col("db").isNotNull() & F.col("cr").isNull(), -F.col("db")).when(F.col("db").isNull() & F.col("cr").isNotNull(), F.col("cr")).otherwise(F.lit(0).cast("decimal(20,2)"))


def running_balance(tx: DataFrame, opening: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """tx with expected (opening and all changes so far) and ok (it equals saldo, or saldo is not given)."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    expected = (F.col("saldo_awal") + F.sum(delta()).over(so_far)).cast("decimal(20,2)")
    return tx.join(opening.select(*keys, "saldo_awal"), keys, "left").withColumn("expected", expected).withColumn("ok", F.coalesce(F.col("saldo") == F.col("expected"), F.lit(True)))


def infer_balances(tx: DataFrame, opening: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """tx with balance (saldo, or the last printed one and all changes since) and mismatch.

    With c the sum of changes so far, saldo - c is constant between consistent rows. So the balance
    before a row follows from the last printed row above it, without walking row by row.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = tx.join(opening.select(*keys, "saldo_awal"), keys, "left").withColumn("_d", delta()).withColumn("_c", F.sum("_d").over(upto)).withColumn("_base", F.col("saldo") - F.col("_c"))
    before = F.coalesce(F.last("_base", ignorenulls=True).over(above), F.col("saldo_awal"))
    one_side = F.col("db").isNull() != F.col("cr").isNull()
    found = rows.withColumn("_expected", F.when(one_side, before + F.col("_c")).cast("decimal(20,2)"))
    return found.withColumn("balance", F.coalesce("saldo", "_expected").cast("decimal(20,2)")).withColumn("mismatch", F.coalesce(F.col("saldo") != F.col("_expected"), F.lit(False))).drop("_d", "_c", "_base", "_expected")


# --- overlapping blocks ----------------------------------------------------------------------

CORE = ["account", "tanggal", "keterangan", "kolom3", "direction", "amount"]


def overlap_dedup(tx: DataFrame, blocks: DataFrame) -> DataFrame:
    """Of equal transactions of several blocks as many as the block with most of them has.

    Kept are those of the block with the longest period, then the earliest, then the first. tx must
    have balance; blocks has one row per statement_block.
    """
    period = blocks.select("source_file", "statement_block", F.coalesce(F.datediff("period_end", "period_start"), F.lit(-1)).alias("_span"), F.col("period_start").alias("_start"), F.col("block").alias("_order"))
    rows = tx.join(period, ["source_file", "statement_block"], "left")
    key = [F.upper(c) if c in ("keterangan", "kolom3") else F.col(c) for c in CORE] + [F.col("balance")]
    in_block = F.count(F.lit(1)).over(Window.partitionBy(*key, "source_file", "statement_block"))
    placed = Window.partitionBy(*key).orderBy(F.desc("_span"), F.asc_nulls_last("_start"), "source_file", "_order", "source_sequence")
    kept = rows.withColumn("_n", in_block).withColumn("_keep", F.max("_n").over(Window.partitionBy(*key))).withColumn("_place", F.row_number().over(placed))
    return kept.where("_place <= _keep").drop("_span", "_start", "_order", "_n", "_keep", "_place")


def overlap_conflicts(tx: DataFrame) -> DataFrame:
    """Equal transactions of two or more blocks whose balances no single block covers.

    Only transactions of several blocks and several balances can be such; they are found in one pass,
    and what is distinct is counted of them alone.
    """
    same = Window.partitionBy(*CORE)
    several = lambda c: F.min(c).over(same) < F.max(c).over(same)
    rows = tx.select(*CORE, "statement_block", "balance").withColumns({"_blocks": several("statement_block"), "_balances": several("balance")}).where("_blocks AND _balances")
    own = rows.select(*CORE, "statement_block", "balance").distinct().withColumn("_n", F.count("balance").over(Window.partitionBy(*CORE, "statement_block")))
    counted = own.groupBy(*CORE).agg(F.count_distinct("balance").alias("all_balances"), F.count_distinct("statement_block").alias("blocks"), F.max("_n").alias("widest"))
    return counted.where("blocks >= 2 AND widest < all_balances")


# --- figures ---------------------------------------------------------------------------------

ADM_TXT, TAX, INTEREST, MIN_BALANCE, GIRO = r"(?i)\bADM\b|ADMIN|BIAYA\s+ADMIN|FEE|\bPROVISI\b", r"(?i)\bPPH\b|PAJAK|TAX", r"(?i)BUNGA|INTEREST|\bBNG\b", r"(?i)SALDO\s+MIN", r"(?i)JASA\s+GIRO|JAGIR"


def categories_overlapping() -> list[Column]:
    """Five sums whose categories may overlap; 0.00 where there is none."""
    total = lambda side, pattern: F.coalesce(F.sum(F.when(F.col("keterangan").rlike(pattern), F.col(side))), F.lit(0)).cast("decimal(30,2)")
    return [total("db", ADM_TXT).alias("adm"), total("db", TAX).alias("pajak"), total("db", INTEREST).alias("bunga"), total("db", MIN_BALANCE).alias("saldo_min"), total("cr", GIRO).alias("jagir")]


def category_exclusive(giro: Column) -> Column:
    """The one category of a row, or null; giro: whether it is a current account."""
    text = F.upper(F.coalesce("keterangan", F.lit("")))
    transfer = text.contains("MCM INHOUSETRF") & text.contains("TRANSFER FEE")
    debit = (
        F.when(text.rlike(r"\bPPH\b|PAJAK|\bTAX\b"), "Pajak").when(text.rlike(r"SALDO\s+MIN"), "Saldo Min").when(text.rlike(r"BUNGA|INTEREST|\bBNG\b"), "Bunga")
        .when(text.rlike(r"\bADM\b|ADMIN|\bPROVISI\b|FEE|^BIAYA(?:\s|$)") & ~transfer, "Adm")
    )
    credit = F.when(text.rlike(r"JASA\s*GIRO|JAGIR"), "JaGir").when(text.rlike(r"BUNGA|INTEREST|\bBNG\b"), F.when(giro, "JaGir").otherwise("Bunga"))
    return F.when(F.col("db").isNotNull(), debit).when(F.col("cr").isNotNull(), credit)


def categories_exclusive(tx: DataFrame, by: list[str], giro: Column) -> DataFrame:
    """Sums by category; null where there is none."""
    cat = tx.withColumn("_cat", category_exclusive(giro)).withColumn("_v", F.coalesce("db", "cr"))
    return cat.groupBy(*by).agg(*(F.sum(F.when(F.col("_cat") == c, F.col("_v"))).cast("decimal(30,2)").alias(c.lower().replace(" ", "_")) for c in ("Adm", "Pajak", "Bunga", "Saldo Min", "JaGir")))


def monthly(tx: DataFrame, order: list[str]) -> DataFrame:
    """Of each account and month: sums, counts, last balance, opening (from the first row), categories."""
    known = F.when(F.col("balance").isNotNull(), F.struct(*order))
    opening = F.min_by(F.when(F.col("direction") == "DB", F.col("balance") + F.col("amount")).otherwise(F.col("balance") - F.col("amount")), F.struct(*order))
    return tx.groupBy("account", F.year("tanggal").alias("year"), F.month("tanggal").alias("month")).agg(
        F.sum("db").cast("decimal(30,2)").alias("db_total"), F.count("db").alias("db_count"), F.sum("cr").cast("decimal(30,2)").alias("cr_total"), F.count("cr").alias("cr_count"),
        F.max_by("balance", known).alias("saldo"), opening.cast("decimal(20,2)").alias("saldo_awal"), *categories_overlapping(),
    )


def mart(tx: DataFrame, by: list[str]) -> DataFrame:
    side = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(30,2)")
    return tx.groupBy(*by).agg(F.count(F.lit(1)).alias("transaction_count"), side("db").alias("total_db"), side("cr").alias("total_cr"))


def recap_join(recap: DataFrame, tx: DataFrame) -> DataFrame:
    """The recap with each account's sums; null where an account has none."""
    return recap.join(tx.groupBy("account").agg(F.sum("db").cast("decimal(30,2)").alias("total_db"), F.sum("cr").cast("decimal(30,2)").alias("total_cr")), "account", "left")


def footers(month_rows: DataFrame) -> DataFrame:
    """Rows by account, year and month, with a total row (month null) for each year; means are of the months that have the figure, 0 if none has."""
    mean = lambda c: F.coalesce(F.round(F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0)), 2), F.lit(0.0))
    return month_rows.rollup("account", "year", "month").agg(F.sum("db_total").cast("decimal(38,2)").alias("db_total"), F.sum("cr_total").cast("decimal(38,2)").alias("cr_total"), F.sum("db_count").alias("db_count"), F.sum("cr_count").alias("cr_count"), mean("db_total").alias("db_mean"), mean("cr_total").alias("cr_mean")).where("year IS NOT NULL")


def duplicate_months(tx: DataFrame, files: str = "source_file") -> DataFrame:
    """Of files with the same transactions in a month of an account the first; the month's signature is an order-free digest."""
    row = F.xxhash64("tanggal", F.upper("keterangan"), "direction", "amount", "balance")
    months = tx.groupBy("account", F.year("tanggal").alias("year"), F.month("tanggal").alias("month"), files).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(38,0)")).alias("s"))
    first = F.row_number().over(Window.partitionBy("account", "year", "month", "rows", "x", "s").orderBy(files))
    return months.withColumn("_first", first).where("_first = 1").drop("_first", "x", "s")


def opening_rows(tx: DataFrame, order: list[str]) -> DataFrame:
    """An opening row before the first transaction of each account and month, at place 0."""
    first = tx.groupBy("account", F.year("tanggal").alias("year"), F.month("tanggal").alias("month")).agg(
        F.min_by(F.when(F.col("direction") == "DB", F.col("balance") + F.col("amount")).otherwise(F.col("balance") - F.col("amount")), F.struct(*order)).cast("decimal(20,2)").alias("balance")
    )
    return first.select("account", "year", "month", F.lit(0).alias("place"), F.lit("SALDO AWAL").alias("keterangan"), "balance")


def same_day_order(tx: DataFrame) -> DataFrame:
    """account, source_row, place, status: each account's rows in an order in which the printed balances add up.

    A day begins with the opening balance and all changes before it, whatever their order. So days
    are judged by themselves: one whose printed order adds up keeps it. Only rows of the others are
    linked, each to the one whose balance before its change is this one's balance, and placed by
    pointer doubling. status is 'printed', 'chained' or 'unresolved' (one day is enough); an unresolved
    account keeps its printed order. Days go by their first row. Days of an account are summed up before
    they are put in order, so windows see a row per day, or a day's rows.
    """
    day = ["account", "day"]
    change = (F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).cast("decimal(20,2)")
    rows = tx.select(*day, "source_row", "balance", "opening", change.alias("_change"))
    sums = rows.groupBy(*day).agg(F.min("source_row").alias("_first"), F.sum("_change").alias("_sum"), F.count(F.lit(1)).alias("_rows"), F.min("opening").alias("_opening"))
    upto = Window.partitionBy("account").orderBy("_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = sums.select(*day, (F.col("_opening") + F.sum("_sum").over(upto) - F.col("_sum")).cast("decimal(20,2)").alias("_before"), (F.sum("_rows").over(upto) - F.col("_rows")).alias("_offset"))
    joined = join_same(rows, days, day)
    printed = Window.partitionBy(*day).orderBy("source_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adds_up = F.coalesce(F.col("_before") + F.sum("_change").over(printed) == F.col("balance"), F.lit(False))
    numbered = joined.withColumns({"_adds_up": adds_up, "_n": F.row_number().over(printed)})
    judged = checkpoint(numbered.withColumn("_ok", F.min("_adds_up").over(Window.partitionBy(*day))).drop("_adds_up"))
    others = judged.where("NOT _ok").select(*day, "_n", "_before", (F.col("balance") - F.col("_change")).cast("decimal(20,2)").alias("_from"), F.col("balance").cast("decimal(20,2)").alias("_to"))
    chained = checkpoint(chain_places(others, day, "_n", "_before", "_from", "_to").withColumnRenamed("place", "_chained"))
    accounts = chained.groupBy("account").agg(F.when(F.max(F.col("_chained").isNull()), "unresolved").otherwise("chained").alias("_status"))
    placed = join_same(judged, chained.withColumnRenamed("_n", "_row"), day, "left", F.col("_n") == F.col("_row"), ~F.col("_ok")).withColumn("_place", F.coalesce("_chained", "_n"))
    known = join_same(placed, accounts, ["account"], "left").withColumn("status", F.coalesce("_status", F.lit("printed")))
    clear = known.where("status <> 'unresolved'").select("account", "source_row", (F.col("_offset") + F.col("_place")).cast("int").alias("place"), "status")
    kept = F.row_number().over(Window.partitionBy("account").orderBy("source_row"))
    return clear.unionByName(known.where("status = 'unresolved'").select("account", "source_row", kept.alias("place"), "status"))
