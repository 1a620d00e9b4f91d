"""Smaller operators on accounts, recaps, names and error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import parsing as P


def metadata(blocks: DataFrame) -> DataFrame:
    """Of each account: opening of the earliest dated block that has one, closing of the latest; else of the first and the last block that has it."""
    opened, closed = F.col("saldo_awal").isNotNull(), F.col("saldo_akhir").isNotNull()
    early = F.when(opened & F.col("period_start").isNotNull(), F.struct("period_start", "block"))
    late = F.when(closed & F.col("period_end").isNotNull(), F.struct("period_end", "block"))
    return blocks.groupBy("source_file", "account").agg(
        F.coalesce(F.min_by("saldo_awal", early), F.min_by("saldo_awal", F.when(opened, F.col("block")))).alias("saldo_awal"),
        F.coalesce(F.max_by("saldo_akhir", late), F.max_by("saldo_akhir", F.when(closed, F.col("block")))).alias("saldo_akhir"),
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.count(F.lit(1)).alias("blocks"),
    )


def direction_by_balance(tx: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """tx with side: DB where the printed balance fell by the amount, CR where it rose by it, else null (a first row, a gap, or neither)."""
    change = F.col("saldo") - F.lag("saldo").over(Window.partitionBy(*keys).orderBy(*order))
    return tx.withColumn("side", F.when(change == -F.col("amount"), "DB").when(change == F.col("amount"), "CR"))


def repaired_sides(tx: DataFrame, opening: Column, keys: list[str], order: list[str], rule: str, mark: Column | None = None) -> DataFrame:
    """tx with db and cr repaired from the printed balances; opening: a column of tx, mark: one that says DB or CR where a row names its side.

    rule 'gap': the balance's change decides side and amount, unless a row without a balance stands
    before; one that doesn't change decides nothing. 'simple': the same against the last printed balance, whatever lies between. 'swap': a row
    without amounts gets the change, and a row whose balance is the one above it moves to the other side; where
    the balance didn't change, a row with neither amount gets a zero on the side of its mark.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    above = by.rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last("saldo", ignorenulls=True).over(above), opening)
    rows = tx.withColumn("_last", last).withColumn("_gap", F.coalesce(F.lag("saldo").over(by).isNull() & (F.row_number().over(by) > 1), F.lit(False)))
    change = (F.col("saldo") - F.col("_last")).cast("decimal(20,2)")
    fell, rose = F.coalesce(change < 0, F.lit(False)), F.coalesce(change > 0, F.lit(False))
    if rule == "swap":
        db, cr = F.coalesce("db", F.lit(0)), F.coalesce("cr", F.lit(0))
        none = (db == 0) & (cr == 0)
        to_cr = F.coalesce(~none & (F.col("_last") + cr == F.col("saldo")) & F.col("db").isNotNull(), F.lit(False))
        to_db = F.coalesce(~none & ~to_cr & (F.col("_last") - db == F.col("saldo")) & F.col("cr").isNotNull(), F.lit(False))
        still = F.coalesce(change == 0, F.lit(False)) & F.col("db").isNull() & F.col("cr").isNull()
        zero = lambda side: still & F.coalesce((F.lit(None) if mark is None else mark) == side, F.lit(False))
        new_db = F.when(none & fell, -change).when(to_cr, None).when(to_db, F.col("cr")).when(zero("DB"), 0).otherwise(F.col("db"))
        new_cr = F.when(none & rose, change).when(to_cr, F.col("db")).when(to_db, None).when(zero("CR"), 0).otherwise(F.col("cr"))
    else:
        skip = F.col("_gap") if rule == "gap" else F.lit(False)
        new_db = F.when(~skip & fell, -change).when(~skip & rose, None).otherwise(F.col("db"))
        new_cr = F.when(~skip & rose, change).when(~skip & fell, None).otherwise(F.col("cr"))
    return rows.withColumns({"db": new_db.cast("decimal(20,2)"), "cr": new_cr.cast("decimal(20,2)")}).drop("_last", "_gap")


def merged_rows(rows: DataFrame, keys: list[str], order: str, start: Column, text: str, values: list[str]) -> DataFrame:
    """Rows that begin a transaction with those that follow it: texts are joined, of each value the first that isn't blank stays and others go to the text. Rows before the first start are dropped."""
    group = F.sum(start.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = rows.withColumn("_group", group).where("_group > 0")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(order, P.clean_text(F.col(c)).alias("x")))), lambda s: s["x"])
    each = part.groupBy(*keys, "_group").agg(F.min(order).alias(order), *(listed(c).alias(c) for c in [text, *values]))
    filled = lambda c: F.filter(F.col(c), lambda x: x != "")
    more = [F.slice(filled(c), 2, F.size(c)) for c in values]
    return each.select(*keys, order, F.array_join(F.concat(filled(text), *more), " ").alias(text), *(F.coalesce(F.get(filled(c), 0), F.lit("")).alias(c) for c in values))


def without_noise(rows: DataFrame, keys: list[str], order: str, text: str, noise: str, footer: str) -> DataFrame:
    """Rows without those whose text is noise, and without all from the first footer on."""
    ended = F.max(F.col(text).rlike(footer)).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_ended", ended).where(~F.col("_ended") & ~F.col(text).rlike(noise)).drop("_ended")


def without_openings(tx: DataFrame) -> DataFrame:
    """Transactions without rows that only state an opening balance."""
    return tx.where(~(F.upper(F.coalesce("keterangan", F.lit(""))).contains("SALDO AWAL") & F.col("db").isNull() & F.col("cr").isNull()))


def first_of_label(recap: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """A long recap with each label once, its first row; labels that differ in case or spaces are one."""
    place = F.row_number().over(Window.partitionBy(*keys, F.upper(P.clean_text(F.col(label)))).orderBy(order))
    return recap.withColumn("_place", place).where("_place = 1").drop("_place")


def numeric_mirrors(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_numeric, a double, for each; what is no number gives 0."""
    return df.withColumns({f"{c}_numeric": P.to_float(F.col(c)) for c in columns})


def signed_sides(nominal: Column) -> tuple[Column, Column]:
    """Debit and credit of a signed amount: what has no plus sign is a debit."""
    value, plus = F.abs(P.us_money(F.regexp_replace(nominal, "[+-]", ""))), P.clean_text(nominal).startswith("+")
    return F.when(~plus, value), F.when(plus, value)


def recap_value(label: str, case: str = "keterangan", value: str = "amount") -> Column:
    """In an aggregate over a long recap: the first value of the label, whatever its case; seq gives the order."""
    return F.min_by(value, F.when(F.upper(P.clean_text(F.col(case))) == label.upper(), F.col("seq")))


def long_recap(wide: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """keys, keterangan, amount: a row for each of the columns; labels are the dictionary's values."""
    each = F.array(*(F.struct(F.lit(label).alias("keterangan"), F.col(c).cast("decimal(30,2)").alias("amount")) for c, label in columns.items()))
    return wide.select(*keys, F.explode(each).alias("x")).select(*keys, "x.keterangan", "x.amount")


def unique_names(df: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """df with sheet: the name made safe for a sheet, with _2, _3 ... after the first of those that differ by case only, at most 31 characters."""
    safe = P.sheet_name(F.col(name))
    place = F.row_number().over(Window.partitionBy(*keys, F.lower(safe)).orderBy(*order))
    suffix = F.concat(F.lit("_"), place.cast("string"))
    return df.withColumn("sheet", F.when(place == 1, safe).otherwise(F.concat(safe.substr(F.lit(1), 31 - F.length(suffix)), suffix)))


def error_rows(df: DataFrame, job_id: str, stage: str, error_type: str) -> DataFrame:
    """Six columns of an error report from rows whose fields may go by other names."""
    have = {c.lower() for c in df.columns}
    pick = lambda names, default: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have), F.lit(default).cast("string"))
    return df.select(
        pick(["job_id"], job_id).alias("job_id"), pick(["file_name", "file", "source_file_name", "source_file"], "").alias("file_name"), pick(["stage"], stage).alias("stage"), pick(["error_type"], error_type).alias("error_type"),
        pick(["error_message", "error", "message"], "").alias("error_message"), pick(["occurred_at", "created_at"], None).alias("occurred_at"),
    )


def differing(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Keys of old whose row in new differs: a label that is already written must not change."""
    columns = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return both.where(~same).select(key)


def compare_rows(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Where two parses differ: key, column, a and b; a key that one of them lacks has nulls on its side."""
    joined = a.alias("a").join(b.alias("b"), keys, "full")
    each = F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("a"), F.col(f"b.{c}").cast("string").alias("b"))) for c in columns))
    return joined.select(*keys, F.explode(F.array_compact(each)).alias("x")).select(*keys, "x.*")


def cleanup_summary(audit: DataFrame) -> DataFrame:
    """Files and bytes removed, and errors, of each target."""
    return audit.groupBy("target").agg(F.sum("deleted_files").alias("deleted_files"), F.sum("deleted_bytes").alias("deleted_bytes"), F.sum("errors").alias("errors"))


def file_report(files: DataFrame, errors: DataFrame, rows: DataFrame, cached: DataFrame) -> DataFrame:
    """One row per file (file_hash, file_name): status, row_count, error_message, loaded_from_cache.

    errors: file_hash, error_message (several are one text). rows: parsed rows with file_hash.
    cached: hashes that were taken from the cache. All are joined by the content's hash.
    """
    said = errors.groupBy("file_hash").agg(F.array_join(F.array_sort(F.collect_set("error_message")), "; ").alias("error_message"))
    counts = rows.groupBy("file_hash").agg(F.count(F.lit(1)).alias("row_count"))
    known = cached.select("file_hash").distinct().withColumn("loaded_from_cache", F.lit(True))
    out = files.join(said, "file_hash", "left").join(counts, "file_hash", "left").join(known, "file_hash", "left")
    return out.select("file_hash", "file_name", F.when(F.col("error_message").isNotNull(), "error").otherwise("success").alias("status"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "error_message", F.coalesce("loaded_from_cache", F.lit(False)).alias("loaded_from_cache"))


def to_clean(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Files that may be cleaned up: those that didn't fail."""
    return files.join(errors.select("file_hash").distinct(), "file_hash", "left_anti")
