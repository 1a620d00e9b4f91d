from datetime import date

from pyspark.sql import functions as F

from tallyspark.functions import parsing as P
from tallyspark.operators import dashboards, facilities, quality, schedule
from tallyspark.schemas import FACILITY, conform


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_parsing(spark):
    assert one(spark, P.rupiah, "Rp 1.234,56", "1.5", "", None, "x", "-2,5") == [1234.56, 15.0, 0.0, 0.0, 0.0, -2.5]
    assert one(spark, P.rate, "12", "1", "0,3 %", "x", None) == [0.12, 1.0, 0.3, None, None]
    assert one(spark, P.us_money, "1,234.50", "10.00 DB", "x", None) == [P_dec("1234.50"), P_dec("-10.00"), None, None]
    assert one(spark, P.date, "1 Januari 2024", "31-02-2024", "05/03/2024", "2024-01-02", "3.4.2024", "x") == [date(2024, 1, 1), None, date(2024, 3, 5), date(2024, 1, 2), date(2024, 4, 3), None]
    assert one(spark, P.grade, "5 - macet", "x") == [5, None]
    assert one(spark, P.month_number, "Mei", "DEC", "x") == [5, 12, None]


def P_dec(x):
    from decimal import Decimal

    return Decimal(x)


def staged(spark, *rows):
    base = dict(source_file="f", nama="A", nik_npwp="", bank="B", penggunaan="", plafond="100", baki_debet="50", kol="1", awal="01-01-2024", jatuh_tempo="01-06-2024", rate="0,1", no_laporan="", keterangan="Aktif")
    return conform(spark.createDataFrame([base | {"seq": i} | r for i, r in enumerate(rows, 1)]), FACILITY)


def test_clean(spark):
    df = staged(
        spark, {}, {"nama": "", "bank": "Jumlah"}, {"nama": "", "kol": "3", "plafond": "0", "rate": "0,31", "keterangan": "Hapus Tagih", "jatuh_tempo": "31-12-2023"}, {"nama": "C", "keterangan": "Tidak ada Fasilitas Aktif", "kol": "0"},
        {"nama": "D", "jatuh_tempo": "", "rate": ""},
    )
    rows = {r.seq: r for r in facilities.clean(df, "2024-01-01").collect()}
    assert set(rows) == {1, 3, 5} and rows[3].nama == "A" and rows[3].utilization_ratio == 0.0
    assert rows[3].risk_flags == ["Problem Loan", "Outstanding Problem Loan", "Charged-Off", "High Rate", "Overdue"]
    assert rows[5].maturity_bucket == "Unknown" and rows[5].annual_interest_cost == 0.0 and rows[1].remaining_days == 152
    assert {r.rule_name for r in quality.facility_issues(df).where("row_number = 5").collect()} == {"kol_range", "fallback_exposure"}


def test_buckets(spark):
    days = spark.createDataFrame([(x,) for x in (-1, 0, 90, 91, 180, 181, 365, 366, None)], "d int")
    assert [r[0] for r in days.select(facilities.maturity_bucket(F.col("d"))).collect()] == ["Overdue", "0-3 Months", "0-3 Months", "3-6 Months", "3-6 Months", "6-12 Months", "6-12 Months", ">12 Months", "Unknown"]


def test_empty_table(spark):
    none = facilities.clean(staged(spark, {}).where("1 = 0"), "2024-01-01")
    assert dashboards.debtor_risk_ranking(none).count() == 0
    assert [r.facility_count for r in dashboards.maturity_buckets(none).orderBy("bucket_order").collect()] == [0] * 5
    assert dashboards.kpi_summary(none).first().facilities == 0


def test_schedule_equals_the_recurrence(spark):
    import random

    random.seed(2)
    rows = []
    for i in range(60):
        months = random.randint(0, 30)
        end = date(2024 + months // 12, months % 12 + 1, 28)
        rows.append(("f", i, "n", "b", date(2024, 1, 28), end, float(random.randint(1, 10**6)), random.choice([None, 0.1, 0.123])))
    df = spark.createDataFrame(rows, "source_file string, seq int, nama string, bank string, awal date, jatuh_tempo date, plafond double, rate double")
    got = {(r.seq, r.period): (r.payment, r.interest, r.principal, r.balance) for r in schedule.schedule(df).collect()}
    expected = {}
    for _, i, _, _, start, end, limit, rate in rows:
        term = (end.year - start.year) * 12 + end.month - start.month + 1
        share, opening = round(limit / term), limit
        for p in range(1, term + 1):
            pay = int(opening) if p == term else share
            interest = 0 if p == 1 else round(opening * ((rate or 0) / 12))
            opening = max(0, round(opening - pay))
            expected[i, p] = (pay, interest, pay - interest, opening)
    assert got == expected


def test_keep_first_is_idempotent_and_null_safe(spark):
    df = spark.createDataFrame([("f", 1, None), ("f", 2, None), ("f", 3, "x")], "source_file string, seq int, k string")
    once = facilities.keep_first(df, ["k"], ["source_file", "seq"])
    assert sorted(r.seq for r in once.collect()) == [1, 3] and facilities.keep_first(once, ["k"], ["seq"]).count() == 2


def test_the_workbook_has_all_tables(spark):
    from tallyspark.operators import dashboards
    from tallyspark.plans import adapters

    df = facilities.clean(adapters.facilities(spark, "/root/testdata/sf0.001"), adapters.AS_OF)
    tables = dashboards.workbook(df, issues=df.limit(0))
    assert {"SLIK", "Subtotals", "Angsuran", "Angsuran_Tahunan", "Data_Quality"} < set(tables) and "Bank_Garansi" not in tables
    assert tables["SLIK"].count() == df.count() and tables["Dashboard_Maturity"].count() >= 5
