"""Aggregates of the clean facility table: marts, key figures, rankings, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.facilities import BUCKETS, FLAGS, active, cost_sum, high_rate, mean, money_sum, outstanding_problem, problem, written_off
from tallyspark.operators.ranking import global_rank

RATE_BANDS = [("0-10%", 0.0, 0.10), ("10-20%", 0.10, 0.20), ("20-30%", 0.20, 0.30), ("30-40%", 0.30, 0.40), (">40%", 0.40, None)]


def _count(c: Column) -> Column:
    return F.count_if(c)


def _sum_if(c: Column, column: str = "baki_debet") -> Column:
    return money_sum(F.when(c, F.col(column)))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(0.0), 6)


def _named(column: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("Unknown"))


def mart_summary(df: DataFrame) -> DataFrame:
    """One row; distinct counts take '' as a value, null rates count as 0 in the mean."""
    return df.agg(
        F.count(F.lit(1)).alias("facility_count"), F.count_distinct("nama").alias("debtor_count"), F.count_distinct("bank").alias("bank_count"),
        money_sum("plafond").alias("total_plafond"), money_sum("baki_debet").alias("total_baki_debet"), mean(F.coalesce("rate", F.lit(0.0))).alias("average_rate"), F.count_distinct("source_file").alias("source_file_count"),
    )


def mart_risk(df: DataFrame) -> DataFrame:
    return _mart(df, "keterangan", "kol")


def mart_maturity(df: DataFrame) -> DataFrame:
    return _mart(df, "maturity_bucket")


def _mart(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("facility_count"), money_sum("baki_debet").alias("total_baki_debet"), money_sum("plafond").alias("total_plafond"))


def kpi_summary(df: DataFrame) -> DataFrame:
    """Ten figures; distinct counts ignore '', the mean rate ignores nulls."""
    filled = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    return df.agg(
        money_sum("plafond").alias("total_plafond"), money_sum("baki_debet").alias("total_baki_debet"), filled("nama").alias("debtors"), F.count(F.lit(1)).alias("facilities"), filled("bank").alias("banks"),
        _count(active(F.col("keterangan"))).alias("active_facilities"), _count(written_off(F.col("keterangan"))).alias("written_off_facilities"), F.max("kol").alias("worst_kol"), mean("rate").alias("average_rate"),
        _ratio(money_sum("baki_debet"), money_sum("plafond")).alias("utilization_ratio"),
    )


def kpi_risk(df: DataFrame) -> DataFrame:
    bad = problem(F.col("kol"))
    return df.agg(
        _sum_if(bad).alias("problem_exposure"), _count(bad).alias("problem_facilities"), _count(written_off(F.col("keterangan"))).alias("written_off_facilities"),
        F.max("kol").alias("highest_kol"), _count(high_rate(F.col("rate"))).alias("high_rate_facilities"), _count(outstanding_problem()).alias("outstanding_problem_loans"),
    )


def due_soon() -> Column:
    return F.coalesce(F.col("remaining_days").between(0, 90), F.lit(False))


def overdue() -> Column:
    return F.coalesce(F.col("remaining_days") < 0, F.lit(False))


def kpi_maturity(df: DataFrame) -> DataFrame:
    return df.agg(
        _sum_if(due_soon()).alias("due_soon_baki_debet"), _count(due_soon()).alias("due_soon_facilities"), _sum_if(overdue()).alias("overdue_baki_debet"), _count(overdue()).alias("overdue_facilities"),
        mean("rate").alias("average_rate"), F.max("rate").alias("highest_rate"), cost_sum().alias("annual_interest_cost"),
    )


def filtered(df: DataFrame, **choices: list) -> DataFrame:
    """Rows that are in every choice; an empty choice is none."""
    return reduce(lambda d, x: d.where(F.col(x[0]).isin(x[1])), ((k, v) for k, v in choices.items() if v), df)


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.nullif(F.col(column).cast("string"), F.lit("")).alias("value")).where("value IS NOT NULL").distinct()


def option_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value: options() of several columns in one pass."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns))
    return df.select(F.inline(each)).where("value IS NOT NULL").distinct()


def kpi_filtered(df: DataFrame) -> DataFrame:
    return df.agg(
        money_sum("plafond").alias("total_plafond"), money_sum("baki_debet").alias("total_baki_debet"), F.count_distinct("nama").alias("debtors"), F.count(F.lit(1)).alias("facilities"), F.count_distinct("bank").alias("banks"),
        F.max("kol").alias("worst_kol"), mean("rate").alias("average_rate"), _ratio(money_sum("baki_debet"), money_sum("plafond")).alias("utilization_ratio"),
        _count(active(F.col("keterangan"))).alias("active_facilities"), _count(written_off(F.col("keterangan"))).alias("written_off_facilities"), _sum_if(problem(F.col("kol"))).alias("problem_exposure"),
        _count(due_soon()).alias("due_soon"), _count(overdue()).alias("overdue"),
    )


def by_kol(df: DataFrame) -> DataFrame:
    return df.where("kol IS NOT NULL").groupBy("kol").agg(F.count(F.lit(1)).alias("facility_count"), money_sum("baki_debet").alias("total_baki_debet"))


def debtor_summary(df: DataFrame) -> DataFrame:
    out = df.groupBy("nama").agg(
        money_sum("plafond").alias("total_plafond"), money_sum("baki_debet").alias("total_baki_debet"), F.count(F.lit(1)).alias("facilities"), F.count_distinct(F.nullif(F.col("bank"), F.lit(""))).alias("banks"),
        F.max("kol").alias("worst_kol"), mean("rate").alias("average_rate"), _ratio(money_sum("baki_debet"), money_sum("plafond")).alias("utilization_ratio"),
        _count(active(F.col("keterangan"))).alias("active_facilities"), _count(written_off(F.col("keterangan"))).alias("written_off_facilities"),
    )
    return out.withColumn("nama", _named("nama"))


def debtor_risk_ranking(df: DataFrame) -> DataFrame:
    """Seven columns for each debtor; flags in the order in which they are first seen.

    One pass: a first aggregate by report and debtor, of numbers only and where the reports already
    are, has the sums and each flag's first place in the report. The second has a flag's first place
    among the reports; flags are nine at most, and no list of a debtor's facilities is ever made.
    """
    each = df.groupBy("nama", "source_file").agg(
        money_sum("baki_debet").alias("baki"), F.max("kol").alias("kol"), _sum_if(problem(F.col("kol"))).alias("problem"), F.count_if(written_off(F.col("keterangan"))).alias("off"), F.count_if(high_rate(F.col("rate"))).alias("high"),
        *(F.min(F.when(F.array_contains("risk_flags", flag), F.col("seq"))).alias(f"_seq_{at}") for at, flag in enumerate(FLAGS)),
    )
    first = [F.min(F.when(F.col(f"_seq_{at}").isNotNull(), F.struct("source_file", F.col(f"_seq_{at}").alias("seq"), F.lit(at).alias("at")))) for at in range(len(FLAGS))]
    flags = F.transform(F.array_sort(F.array_compact(F.array(*first))), lambda x: F.get(F.lit(FLAGS), x["at"]))
    out = each.groupBy("nama").agg(
        F.sum("baki").cast("decimal(38,4)").alias("total_baki_debet"), F.max("kol").alias("worst_kol"), F.sum("problem").cast("decimal(38,4)").alias("problem_exposure"), F.sum("off").alias("written_off_count"),
        F.sum("high").alias("high_rate_count"), F.array_join(flags, ", ").alias("risk_flags"),
    )
    return out.withColumn("nama", _named("nama"))


def status_summary(df: DataFrame, top: int = 10) -> DataFrame:
    return df.groupBy(_named("keterangan").alias("keterangan")).agg(F.count(F.lit(1)).alias("facility_count"), money_sum("baki_debet").alias("total_baki_debet")).orderBy(F.desc("facility_count"), "keterangan").limit(top)


def maturity_buckets(df: DataFrame) -> DataFrame:
    """All buckets in order, empty ones with 0; Unknown only if it occurs.

    The fixed list is added to the few aggregated rows and these are aggregated again; a join from
    its side would push a filter on the bucket, with all that computes it, below the aggregate.
    """
    facts = df.groupBy("maturity_bucket").agg(
        F.count(F.lit(1)).alias("facility_count"), money_sum("baki_debet").alias("total_baki_debet"), money_sum("plafond").alias("total_plafond"), mean("rate").alias("average_rate"), cost_sum().alias("annual_interest_cost")
    )
    out = _with_all(facts, "maturity_bucket", BUCKETS).where("maturity_bucket <> 'Unknown' OR facility_count > 0")
    return out.select((F.array_position(F.lit(BUCKETS), F.col("maturity_bucket")) - 1).cast("int").alias("bucket_order"), *out.columns)


def _with_all(facts: DataFrame, by: str, values: list[str]) -> DataFrame:
    """facts (one row per value of by) with a row of zeros for each value that lacks one; means stay null. Others than values are dropped."""
    zero = facts.sparkSession.createDataFrame([(v,) for v in values], f"{by} string").select(
        by, *(F.lit(None if c.startswith("average") else 0).cast(facts.schema[c].dataType).alias(c) for c in facts.columns if c != by)
    )
    both = facts.unionByName(zero).groupBy(by).agg(*(F.max(c).alias(c) if c.startswith("average") else F.sum(c).cast(facts.schema[c].dataType).alias(c) for c in facts.columns if c != by))
    return both.where(F.col(by).isin(values))


def maturity_years(df: DataFrame) -> DataFrame:
    return df.where("jatuh_tempo_year IS NOT NULL").groupBy("jatuh_tempo_year").agg(
        F.count(F.lit(1)).alias("facility_count"), money_sum("baki_debet").alias("total_baki_debet"), mean("rate").alias("average_rate"), cost_sum().alias("annual_interest_cost")
    )


def average_rate_by_bank(df: DataFrame, top: int = 15) -> DataFrame:
    means = df.where("trim(bank) <> ''").groupBy("bank").agg(mean("rate").alias("average_rate")).where("average_rate IS NOT NULL")
    return means.orderBy(F.desc("average_rate"), "bank").limit(top)


def rate_bands(df: DataFrame) -> DataFrame:
    """All five bands, closed on the right; a null rate is in the first but not in its mean; a negative one is in none."""
    r = F.coalesce("rate", F.lit(0.0))
    inside = lambda low, high: (r >= low if low == 0 else r > low) & (F.lit(True) if high is None else r <= high)
    band = reduce(lambda c, x: c.when(inside(x[1], x[2]), x[0]), RATE_BANDS, F.when(F.lit(False), ""))
    facts = df.withColumn("rate_band", band).groupBy("rate_band").agg(F.count(F.lit(1)).alias("facility_count"), money_sum("baki_debet").alias("total_baki_debet"), mean("rate").alias("average_rate"))
    return _with_all(facts, "rate_band", [x[0] for x in RATE_BANDS])


def heatmap(df: DataFrame, by: str) -> DataFrame:
    """Outstanding by debtor or bank (rows) and grade (columns kol_1 to kol_5), 0 where there is none."""
    wide = df.where(f"{by} IS NOT NULL AND kol IS NOT NULL").groupBy(by).pivot("kol", [1, 2, 3, 4, 5]).agg(money_sum("baki_debet"))
    return wide.select(by, *(F.coalesce(F.col(str(k)), F.lit(0).cast("decimal(38,4)")).alias(f"kol_{k}") for k in range(1, 6)))


def top_sum(df: DataFrame, by: str, value: str = "baki_debet", top: int = 10) -> DataFrame:
    return df.groupBy(_named(by).alias(by)).agg(money_sum(value).alias("total")).orderBy(F.desc("total"), by).limit(top)


def top_rows(df: DataFrame, value: str, top: int = 10) -> DataFrame:
    """The rows with the largest value; ties by file and place."""
    return df.where(f"{value} IS NOT NULL").orderBy(F.desc(value), "source_file", "seq").limit(top)


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """df in one order. A sort samples its rows before it deals them by range, so they are dealt by file first and not computed twice."""
    return df.repartition("source_file").orderBy(*order)


def problem_list(df: DataFrame) -> DataFrame:
    return df.where(problem(F.col("kol")))


def written_off_list(df: DataFrame) -> DataFrame:
    return df.where(written_off(F.col("keterangan")))


def high_rate_list(df: DataFrame) -> DataFrame:
    return df.where(high_rate(F.col("rate")))


def high_rate_outstanding_list(df: DataFrame) -> DataFrame:
    return df.where(high_rate(F.col("rate")) & (F.col("baki_debet") > 0))


def multi_risk_list(df: DataFrame) -> DataFrame:
    return df.where(F.size("risk_flags") > 1)


def due_soon_list(df: DataFrame) -> DataFrame:
    return df.where(due_soon())


def overdue_list(df: DataFrame) -> DataFrame:
    return df.where(overdue())


def rate_histogram(df: DataFrame, bins: int = 20, empty: bool = False) -> DataFrame:
    """bin, low, high, facility_count: equal bins from the least to the largest rate; the last one is closed. One bin if there is one rate, none if there is no rate. Empty ones have a row, with 0, only if asked for."""
    # Nulls are dropped by their count; a filter on the rate would be pushed down with all that reads it, which then is read twice.
    rates = df.groupBy("rate").agg(F.count("rate").alias("n")).where("n > 0")
    # One row. Counts are taken along, so that rates are the same for both sides of the join and computed once.
    edges = rates.agg(F.min(F.struct("rate", "n")).alias("least"), F.max(F.struct("rate", "n")).alias("most")).select(F.col("least.rate").alias("least"), F.col("most.rate").alias("most"))
    width = (F.col("most") - F.col("least")) / bins
    at = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("rate") - F.col("least")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = rates.join(F.broadcast(edges)).withColumn("bin", at).groupBy("least", "most").pivot("bin", list(range(bins))).agg(F.sum("n"))
    each = [F.struct(F.lit(k).alias("bin"), (F.col("least") + k * width).alias("low"), (F.col("most") if k == bins - 1 else F.col("least") + (k + 1) * width).alias("high"), F.coalesce(F.col(str(k)), F.lit(0)).alias("facility_count")) for k in range(bins)]
    one = F.array(F.struct(F.lit(0).alias("bin"), F.col("least").alias("low"), F.col("most").alias("high"), F.col("0").alias("facility_count")))
    found = counts.select(F.inline(F.when(F.col("most") > F.col("least"), F.array(*each)).otherwise(one)))
    return found if empty else found.where("facility_count > 0")


def rate_scatter(df: DataFrame) -> DataFrame:
    """Points of outstanding against rate, numbered by rate inside each grade. There are five grades, so places are counted by ranges, not in a window by grade."""
    points = df.where("rate IS NOT NULL AND kol IS NOT NULL AND baki_debet > 0").select("kol", "rate", "source_file", "seq", F.col("baki_debet").cast("decimal(20,4)").alias("baki_debet"))
    placed = global_rank(points, [F.asc("rate"), F.asc("source_file"), F.asc("seq")], "place", within=["kol"])
    return placed.select("kol", F.col("place").cast("int").alias("place"), "rate", "baki_debet", "source_file", "seq")


def workbook(df: DataFrame, guarantees: DataFrame | None = None, issues: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a facility workbook: facilities with subtotals, guarantees if there are any, four dashboards, instalments, issues."""
    from tallyspark.operators import facilities, schedule

    flat = df.withColumn("risk_flags", F.array_join("risk_flags", ", "))
    out = {
        "SLIK": flat, "Subtotals": facilities.subtotals(df), "Dashboard_Summary": kpi_summary(df), "Dashboard_Risk": kpi_risk(df), "Dashboard_Maturity": maturity_buckets(df), "Dashboard_Debtors": debtor_risk_ranking(df),
        "Angsuran": schedule.schedule(df), "Angsuran_Tahunan": schedule.yearly(df),
    }
    if guarantees is not None and not guarantees.isEmpty():
        out["Bank_Garansi"] = guarantees
    if issues is not None:
        out["Data_Quality"] = issues
    return out


def bars(df: DataFrame, by: str, order: list[str] | None = None) -> DataFrame:
    """place, value and sums by a column, null groups kept; place: in a given order of values, else by the sum, from 1."""
    sums = df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("facility_count"), money_sum("baki_debet").alias("total_baki_debet"))
    if order:
        return sums.withColumn("place", F.coalesce(F.nullif(F.array_position(F.lit(order), F.col("value")).cast("int"), F.lit(0)), F.lit(len(order) + 1)))
    # Debtors may be very many, so no window sees all of them.
    placed = global_rank(sums, [F.desc("total_baki_debet"), F.asc_nulls_last("value")], "place")
    return placed.select("value", "facility_count", "total_baki_debet", F.col("place").cast("int").alias("place"))
