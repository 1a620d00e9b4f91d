"""Plans of queries whose work must not grow faster than their tables."""

from pyspark.sql import functions as F

from tallyspark.functions import parsing as P
from tallyspark.plans import more  # noqa: F401
from tallyspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_grades_are_counted_without_what_they_do_not_need(spark):
    got = plan(spark, "count_by_kol")
    assert "Window" not in got and "l_extendedprice" not in got and "l_shipdate" not in got


def test_usual_forms_are_read_as_others(spark):
    texts = ["01-02-2024", "31-02-2024", "12-31-2024", "01-02-2024\n", " 1/2/24 ", "", None, "1.234,56", "-5", "1,2,3", "Rp 1.000", "\x1b[31m7,5", "--", "1-2-3"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(P.date(F.col("t")).cast("string"), P.rupiah(F.col("t"))).collect()
    dates = ["2024-02-01", None, "2024-12-31", "2024-02-01", "2024-02-01"]
    assert [r[0] for r in got[:7]] == dates + [None, None]
    assert [r[1] for r in got[6:]] == [0.0, 1234.56, -5.0, 0.0, 1000.0, 7.5, 0.0, 0.0]



def scans(got, name="lineitem"):
    return got.count(f"{name}.parquet]")


def test_options_of_all_columns_are_one_pass(spark):
    assert scans(plan(spark, "option_lists_all")) == 1


def test_rows_that_are_reported_again_are_one_pass(spark):
    assert scans(plan(spark, "dedup_all_keys")) == 1 and scans(plan(spark, "dedup_removed")) == 1


def test_years_beside_the_schedule_are_one_pass(spark):
    assert scans(plan(spark, "schedule_beside_year")) == 1


def test_years_of_equal_loans_are_summed_for_each(spark):
    from tallyspark.operators import schedule

    rows = [("a", 1, "2024-03-01", "2025-02-01", 1200.0, 0.12), ("a", 1, "2024-03-01", "2025-02-01", 1200.0, 0.12), ("b", 1, "2024-01-31", "2024-02-01", 5.0, None), ("c", 1, "2024-02-01", "2024-01-01", 5.0, 0.1)]
    clean = spark.createDataFrame(rows, "source_file string, seq int, awal string, jatuh_tempo string, plafond double, rate double").withColumns({"awal": F.to_date("awal"), "jatuh_tempo": F.to_date("jatuh_tempo"), "nama": F.lit("n"), "bank": F.lit("b")})
    columns = ["source_file", "seq", "period", "years", "first_year", "cpltd", "interest"]
    got = sorted(tuple(r) for r in schedule.beside_year(clean).select(*columns).collect())
    assert len(got) == 3 and got == sorted(tuple(r) for r in schedule.beside(schedule.schedule(clean), schedule.yearly(clean)).select(*columns).collect())


def test_the_cache_has_a_folder_for_a_run_not_for_a_file(spark, tmp_path):
    from tallyspark.sources import layers

    rows = lambda n, *hashes: spark.createDataFrame([("t", "1", h, n) for h in hashes], "document_type string, parser_version string, source_file_hash string, n int")
    for run, n, hashes in ((1, 1, "abc"), (2, 2, "bd"), (2, 3, "bd")):
        layers.cache_write(rows(n, *hashes), str(tmp_path), run)
    assert len(list(tmp_path.glob("cache/*/*/*=*"))) == 2
    assert sorted((r.source_file_hash, r.n) for r in layers.cache_read(spark, str(tmp_path), "t", "1").collect()) == [("a", 1), ("b", 3), ("c", 1), ("d", 3)]


def test_no_report_text_is_shuffled(spark):
    got = plan(spark, "block_parse_roundtrip")
    assert got.index("Setoran Jaminan") < got.index("Exchange")


def test_facilities_of_one_kind_are_those_of_all(spark):
    from tallyspark.operators import reports

    one = lambda kind, *more: "\n".join([kind, "Pelapor", "001 - IDEB", " 014 -  X\x1b[0m Y ", "Rp 7,00", "Baki Debet", "Rp 1.002,50", "Kondisi", *more, "Agunan", "Kondisi", "Lunas"])
    content = "\n".join(["x", one(reports.CREDIT, "HAPUS  TAGIH"), one(reports.GUARANTEE, "Fasilitas Aktif"), one(reports.CREDIT, "Lunas", "Kualitas", "2 - x"), one(reports.CREDIT, "Lunas")])
    texts = spark.createDataFrame([("a", content), ("b", None), ("c", one(reports.CREDIT, "Dihapus-bukukan"))], "source_file string, content string")
    rows = lambda df: sorted((r.source_file, r.seq, r.bank, r.keterangan, r.baki_debet, r.kol) for r in df.collect())
    every = rows(reports.facilities(texts))
    assert every == [("a", 1, "X Y", "Hapus Tagih", 7.0, None), ("a", 2, "X Y", "Aktif", 7.0, None), ("a", 3, "X Y", "Lunas", 7.0, 2), ("c", 1, "X Y", "Dihapusbukukan", 7.0, None)]
    assert every == rows(reports.facilities(reports.split(texts)))
    assert rows(reports.facilities(texts, [reports.GUARANTEE])) == every[1:2]


def test_conflicts_and_equal_months_take_one_pass(spark):
    assert scans(plan(spark, "overlap_conflicts"), "events") == 2  # transactions, and the accounts' openings
    assert scans(plan(spark, "duplicate_months"), "events") == 2


def test_words_are_not_dealt_by_the_buckets_of_bands(spark):
    from tallyspark.plans import readers  # noqa: F401

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the words were many
    try:
        assert "SortMergeJoin" not in plan(spark, "band_cells")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_clean_columns_are_read_as_others(spark):
    texts = ["", None, " ", "a", " a ", "a b", "a  b", "a\tb", "a b\n", "é", "a\u00a0b", "\x1b[31mx", "\x7f", "'", "12", "012 ", "9999999999", "-3", "0.350", "35", "1.000,5", "0,5 %", "1e5", ".5", "5."]
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(P.column_text(t), P.clean_text(t), P.grade(t), P.rate(t), P.rupiah(t)).collect()
    assert all(r[0] == r[1] for r in got)
    assert [r[2] for r in got[14:]] == [12, 12, None, 3, 0, 35, 1, 0, 1, 5, 5]
    assert [r[3] for r in got[14:]] == [0.12, 0.12, 99999999.99, -0.03, 0.35, 0.35, 1.0, 0.5, 1.0, 0.05, 0.05]
    assert [r[4] for r in got[14:]] == [12.0, 12.0, 9999999999.0, -3.0, 350.0, 35.0, 1000.5, 0.5, 15.0, 5.0, 5.0]


def test_facilities_are_not_copied_for_each_flag(spark):
    from tallyspark.operators import dashboards, facilities

    assert "Generate" not in plan(spark, "debtor_risk_ranking")
    rows = [("f1", 2, ["Current", "Overdue"]), ("f1", 1, []), ("f10", 1, ["Problem Loan", "High Rate", "Overdue"]), ("f2", 1, ["Special Mention", "High Rate"]), ("e", 9, ["Near Maturity"])]
    clean = spark.createDataFrame([("d", *r, 2.5, 3, 0.31, "Hapus Tagih") for r in rows] + [("x", "f1", 3, [], None, None, None, None)], "nama string, source_file string, seq int, risk_flags array<string>, baki_debet double, kol int, rate double, keterangan string")
    got = {r.nama: tuple(r)[1:] for r in dashboards.debtor_risk_ranking(clean).collect()}
    assert (float(got["d"][0]), *got["d"][1:]) == (12.5, 3, got["d"][2], 5, 5, "Near Maturity, Current, Overdue, Problem Loan, High Rate, Special Mention") and float(got["d"][2]) == 12.5
    assert (float(got["x"][0]), *got["x"][3:]) == (0.0, 0, 0, "")
    flags = facilities.risk_flags(F.lit(3), F.lit(1.0), F.lit(0.4), F.lit(-1), F.lit("hapus tagih, dihapusbukukan"))
    assert set(spark.range(1).select(flags).first()[0]) <= set(facilities.FLAGS) and len(facilities.FLAGS) == 9


def test_rates_are_not_read_by_a_filter_too(spark):
    assert not [line for line in plan(spark, "rate_histogram").split("\n") if "Filter" in line and "regexp_extract" in line]


def test_rates_of_all_or_none(spark):
    from tallyspark.operators import dashboards

    rates = lambda *values: sorted((r.bin, r.facility_count) for r in dashboards.rate_histogram(spark.createDataFrame([(v,) for v in values], "rate double"), 4).collect())
    assert rates(None, None) == [] and rates(0.1, None, 0.1) == [(0, 2)] and rates(0.0, 0.1, 0.4, None, 0.35) == [(0, 1), (1, 1), (3, 2)]


def test_rows_are_dealt_before_they_are_sampled_for_an_order(spark):
    assert "hashpartitioning(source_file" in plan(spark, "sorted_lists")


def test_the_interests_of_a_year_are_no_list(spark):
    assert "aggregate(sequence(" not in plan(spark, "installment_yearly")


def test_facilities_are_dealt_once_by_their_report(spark):
    text = plan(spark, "installment_schedule")
    assert len([line for line in text.split("\n") if "Exchange hashpartitioning(" in line]) <= 3 and "hashpartitioning(l_orderkey" not in text and "hashpartitioning(l_suppkey" not in text


def test_pages_are_dealt_to_their_documents_once(spark):
    from tallyspark.operators import detect, isolation
    from tallyspark.plans import readers

    lines = readers._damaged_pages(spark, SF)
    text = isolation.read_pages(lines).rows._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in text and "hashpartitioning(source_file, page" not in text and "line_no" not in "".join(x for x in text.split("\n") if "Scan ExistingRDD" in x)
    whole = lines.groupBy("source_file").agg(F.array_join(F.collect_list("line"), "\n").alias("text")).select("source_file", detect.detect_layout(F.col("text")).alias("bank"))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, lines.groupBy("source_file").agg(detect.layout_of_lines(F.col("line")).alias("bank")).collect()), key=str)
