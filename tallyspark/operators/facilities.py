"""Credit facilities: from staged text to the clean table with its risk and maturity columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import parsing as P
from tallyspark.schemas import FACILITY, conform

SUBTOTAL = "jumlah"
FALLBACK = "tidak ada fasilitas aktif"
HIGH_RATE = 0.30
BUCKETS = ["Overdue", "0-3 Months", "3-6 Months", "6-12 Months", ">12 Months", "Unknown"]
#: All risk flags, in their order.
FLAGS = ["Current", "Special Mention", "Problem Loan", "Outstanding Problem Loan", "Charged-Off", "Written-Off", "High Rate", "Near Maturity", "Overdue"]
SEVERITY = ["aktif", "dihapusbukukan", "hapus tagih"]


def is_fallback(keterangan: Column) -> Column:
    return F.lower(P.clean_text(keterangan)) == FALLBACK


def maturity_bucket(days: Column) -> Column:
    return F.when(days.isNull(), "Unknown").when(days < 0, "Overdue").when(days <= 90, "0-3 Months").when(days <= 180, "3-6 Months").when(days <= 365, "6-12 Months").otherwise(">12 Months")


def risk_flags(kol: Column, baki: Column, rate: Column, days: Column, keterangan: Column) -> Column:
    """The flags that hold, in order; an array, joined at the edge only."""
    text = F.lower(keterangan)
    flags = [
        F.when(kol == 1, "Current").when(kol == 2, "Special Mention").when(kol >= 3, "Problem Loan"),
        F.when((kol >= 3) & (baki > 0), "Outstanding Problem Loan"),
        F.when(text.contains("hapus tagih"), "Charged-Off"),
        F.when(text.contains("dihapusbukukan"), "Written-Off"),
        F.when(rate > HIGH_RATE, "High Rate"),
        F.when((days >= 0) & (days <= 90), "Near Maturity"),
        F.when(days < 0, "Overdue"),
    ]
    return F.array_compact(F.array(*flags))


def written_off(keterangan: Column) -> Column:
    return F.coalesce(keterangan.rlike(r"(?i)dihapusbukukan|hapus\s+tagih"), F.lit(False))


def active(keterangan: Column) -> Column:
    return F.coalesce(F.lower(keterangan).contains("aktif"), F.lit(False))


def problem(kol: Column) -> Column:
    return F.coalesce(kol >= 3, F.lit(False))


def high_rate(rate: Column) -> Column:
    return F.coalesce(rate, F.lit(0.0)) > HIGH_RATE


def outstanding_problem() -> Column:
    return problem(F.col("kol")) & (F.col("baki_debet") > 0)


def fill_names(df: DataFrame) -> DataFrame:
    """A blank name is that of the row above in the same file; '' if none is above. Parallel by file."""
    above = Window.partitionBy("source_file").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("nama", F.coalesce(F.last(F.nullif(P.column_text(F.col("nama")), F.lit("")), ignorenulls=True).over(above), F.lit("")))


def clean(staged: DataFrame, as_of: str) -> DataFrame:
    """The clean table: subtotal and fallback rows dropped, names filled, text parsed, risk columns derived.

    Lineage columns that staged has besides its schema are carried along.
    """
    more = [c for c in staged.columns if c.lower() not in FACILITY.names]
    base = conform(staged, FACILITY) if not more else conform(staged, T.StructType(FACILITY.fields + [staged.schema[c] for c in more]))
    # Text is read below the window that fills names. So what uses a parsed column stays above it and doesn't parse again,
    # and columns that a query doesn't use, that window too, are pruned.
    text = base.where(F.lower(P.column_text(F.col("bank"))) != SUBTOTAL).select(
        "source_file", "seq", "nama", *(P.column_text(F.col(c)).alias(c) for c in ("nik_npwp", "bank", "penggunaan")),
        P.rupiah(F.col("plafond")).alias("plafond"), P.rupiah(F.col("baki_debet")).alias("baki_debet"), P.grade(F.col("kol")).alias("kol"),
        P.date(F.col("awal")).alias("awal"), P.date(F.col("jatuh_tempo")).alias("jatuh_tempo"), P.rate(F.col("rate")).alias("rate"),
        *(P.column_text(F.col(c)).alias(c) for c in ("no_laporan", "keterangan")), *more,
    )
    # Rows that say there is no facility still give their name to those below.
    read = fill_names(text).where(F.lower("keterangan") != FALLBACK)
    days = F.datediff("jatuh_tempo", F.lit(as_of).cast("date"))
    dated = read.withColumn("remaining_days", days).withColumns({"jatuh_tempo_year": F.year("jatuh_tempo"), "jatuh_tempo_month": F.month("jatuh_tempo")})
    return dated.withColumns(
        {
            "utilization_ratio": F.when(F.col("plafond") > 0, F.col("baki_debet") / F.col("plafond")).otherwise(0.0),
            "maturity_bucket": maturity_bucket(F.col("remaining_days")),
            "annual_interest_cost": F.col("baki_debet") * F.coalesce("rate", F.lit(0.0)),
            "risk_flags": risk_flags(F.col("kol"), F.col("baki_debet"), F.col("rate"), F.col("remaining_days"), F.col("keterangan")),
        }
    )


def keep_first(staged: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys (null equals null) the first by order, which must be total."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return staged.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def removed(staged: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows there are, and how many of them keep_first() drops."""
    return staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))


def status_rank(keterangan: Column) -> Column:
    """Severity: charged off 6, written off 5, active 4, settled by collateral 3, with a discount 2, settled 1, other or none 0."""
    return P.once(
        F.lower(P.clean_text(keterangan)),
        lambda t: F.when(t.contains("hapus tagih"), 6).when(F.regexp_replace(t, "[^a-z0-9]", "").contains("dihapusbukukan") | t.contains("hapus buku"), 5).when(t.contains("aktif"), 4)
        .when(t.contains("pengambilalihan agunan"), 3).when(t.contains("diskon"), 2).when(t.contains("lunas"), 1).otherwise(0),
    )


def subtotals(clean_df: DataFrame) -> DataFrame:
    """A 'Jumlah' row for each debtor: sums, worst grade and worst status (the first row of the worst rank; if all have rank 0 the first that isn't blank)."""
    order = F.struct(F.col("_rank"), (F.col("keterangan") != "").alias("given"), F.struct((-F.col("seq")).alias("seq"), F.col("source_file")))
    return clean_df.withColumn("_rank", status_rank(F.col("keterangan"))).groupBy("nama").agg(
        F.lit("Jumlah").alias("bank"), money_sum("plafond").alias("total_plafond"), money_sum("baki_debet").alias("total_baki_debet"),
        F.max("kol").alias("worst_kol"), F.max("_rank").alias("worst_status_rank"), F.max_by("keterangan", order).alias("worst_status"),
    )


def money_sum(column: str | Column, scale: int = 4) -> Column:
    """A sum of amounts by exact decimals, so it doesn't depend on the order of rows or partitions; 0 for none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.sum(c.cast(f"decimal(24,{scale})")), F.lit(0)).cast(f"decimal(38,{scale})")


def cost_sum() -> Column:
    """An amount of four places times a rate of three has seven."""
    return money_sum("annual_interest_cost", 7)


def mean(column: str | Column, places: int = 6) -> Column:
    """A mean of what is not null, from an exact sum."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(F.sum(c.cast("decimal(20,6)")).cast("double") / F.nullif(F.count(c), F.lit(0)), places)
