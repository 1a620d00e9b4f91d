import random
from datetime import date
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from tallyspark.operators import quality, ranking, reports, statements

HEAD = "No. Rekening : 123\nPeriode Tgl. : {} To {}\nSALDO AWAL 1,000.00\n"
OVERLAP = HEAD.format("01/01/24", "31/01/25") + "05/01/24 BIAYA ADMIN ABC 500.00 DB 500.00\n  SISA TEKS 2 B 2 2\n06/01/24 SETOR X1 100.00 600.00\n" + HEAD.format("01/01/24", "31/01/24") + "05/01/24 BIAYA ADMIN ABC 500.00 DB 500.00\nSISA TEKS\n"
CARRY = "No. Rekening : 9\nSALDO AWAL 1,000.00\n01/02/24 A B 100.00 DB 900.00\nNo. Rekening : 9\nPINDAHAN 900.00\n02/02/24 C D 100.00\nSALDO AKHIR 1,000.00\n"


def parsed(spark, text):
    lines = statements.classify(statements.lines(spark.createDataFrame([("f", text)], "source_file string, content string")))
    tx, blocks = statements.parse_transactions(lines), statements.parse_blocks(lines)
    return statements.infer_balances(tx, blocks, ["source_file", "statement_block"], ["source_sequence"]), blocks


def test_overlap_keeps_the_long_block(spark):
    tx, blocks = parsed(spark, OVERLAP)
    assert blocks.count() == 2
    kept = statements.overlap_dedup(tx, blocks).orderBy("source_sequence").collect()
    assert [(r.statement_block, r.keterangan, r.kolom3, r.db, r.cr, r.balance) for r in kept] == [
        ("123#1", "BIAYA ADMIN SISA TEKS", "ABC", Dec("500.00"), None, Dec("500.00")),
        ("123#1", "SETOR", "X1", None, Dec("100.00"), Dec("600.00")),
    ]


def test_repeated_block_keeps_its_multiplicity(spark):
    block = HEAD.format("01/01/24", "31/01/24") + "05/01/24 X Y 10.00 DB 990.00\n05/01/24 X Y 10.00 DB 990.00\n"
    tx, blocks = parsed(spark, block + block)
    assert tx.count() == 4 and statements.overlap_dedup(tx, blocks).count() == 2
    assert tx.where("mismatch").count() == 2  # the second of each pair


def test_carried_balance_opens_the_next_page(spark):
    tx, blocks = parsed(spark, CARRY)
    rows = tx.orderBy("source_sequence").collect()
    assert [r.balance for r in rows] == [Dec("900.00"), Dec("1000.00")] and not any(r.mismatch for r in rows)
    assert blocks.orderBy("block").collect()[1].saldo_akhir == Dec("1000.00")


def test_source_amounts_stay_on_a_mismatch(spark):
    tx, _ = parsed(spark, "No. Rekening : 1\nSALDO AWAL 1,000.00\n01/02/24 A B 100.00 DB 950.00\n")
    row = tx.first()
    assert row.mismatch and row.db == Dec("100.00") and row.balance == Dec("950.00")


def test_inference_equals_a_loop(spark):
    import random

    random.seed(4)
    rows, expected = [], {}
    for a in range(5):
        last = Dec(1000)
        for n in range(40):
            side, amount = random.choice(["db", "cr", "both", "none"]), Dec(random.randint(1, 99))
            printed = last + random.choice([0, 0, 1]) if random.random() < 0.5 else None
            rows.append((str(a), n, amount if side in ("db", "both") else None, amount if side in ("cr", "both") else None, printed))
            change = -amount if side == "db" else amount if side == "cr" else None
            if printed is None:
                balance, wrong = (last + change if change is not None else None), False
            else:
                balance, wrong = printed, change is not None and last + change != printed
            expected[str(a), n] = (balance, wrong)
            last = balance if balance is not None else last
    tx = spark.createDataFrame(rows, "account string, n int, db decimal(20,2), cr decimal(20,2), saldo decimal(20,2)")
    opening = tx.select("account").distinct().withColumn("saldo_awal", F.lit(1000).cast("decimal(20,2)"))
    got = {(r.account, r.n): (r.balance, r.mismatch) for r in statements.infer_balances(tx, opening, ["account"], ["n"]).collect()}
    assert got == expected


def test_conflict_only_where_no_block_covers(spark):
    rows = [("a", "1", 10), ("a", "2", 11), ("b", "1", 5), ("b", "1", 6), ("b", "2", 6)]
    tx = spark.createDataFrame(rows, "keterangan string, statement_block string, balance int").withColumns({"account": F.lit("x"), "tanggal": F.lit(date(2024, 1, 1)), "kolom3": F.lit(None).cast("string"), "direction": F.lit("DB"), "amount": F.lit(1)})
    assert [r.keterangan for r in statements.overlap_conflicts(tx).collect()] == ["a"]


def test_categories(spark):
    rows = [("PPH ADMIN", 1, None), ("SALDO MIN BUNGA", 2, None), ("BUNGA", 3, None), ("BIAYA KARTU", 4, None), ("MCM INHOUSETRF TRANSFER FEE", 5, None), ("JASA GIRO", None, 6), ("BUNGA", None, 7), (None, 8, None)]
    tx = spark.createDataFrame(rows, "keterangan string, db int, cr int").withColumns({c: F.col(c).cast("decimal(20,2)") for c in ("db", "cr")})
    giro = statements.categories_exclusive(tx, [], F.lit(True)).first()
    assert (giro.adm, giro.pajak, giro.bunga, giro.saldo_min, giro.jagir) == (4, 1, 3, 2, 13)
    savings = statements.categories_exclusive(tx, [], F.lit(False)).first()
    assert (savings.bunga, savings.jagir) == (10, 6)
    both = tx.agg(*statements.categories_overlapping()).first()
    assert (both.adm, both.pajak, both.bunga, both.saldo_min, both.jagir) == (6, 1, 5, 2, 6)


def test_same_day_order(spark):
    schema = "account string, day date, debit decimal(20,2), credit decimal(20,2), balance decimal(20,2), source_row int, opening decimal(20,2)"
    day = date(2024, 1, 1)
    rows = [("a", day, None, Dec(5), Dec(15), 1, Dec(0)), ("a", day, None, Dec(10), Dec(10), 2, Dec(0)), ("b", day, Dec(1), None, Dec(98), 1, Dec(100)), ("c", day, Dec(1), None, Dec(99), 1, Dec(100))]
    got = {(r.account, r.place): (r.source_row, r.status) for r in statements.same_day_order(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", 1): (2, "chained"), ("a", 2): (1, "chained"), ("b", 1): (1, "unresolved"), ("c", 1): (1, "printed")}


def test_recaps(spark):
    head = "Saldo Awal Total Transaksi Debet Total Transaksi Kredit Saldo Akhir\n"
    good, two = head + "page 1\n1,000.00 300.00 500.00 1,200.00\nTerbilang\n", head + "1.00 1.00 1.00 1.00\n1.00 1.00 1.00 1.00\nTerbilang"
    rows = spark.createDataFrame([(good,), (two,), (head + "Terbilang\n1.00 1.00 1.00 1.00",)], "t string")
    got = [r[0] for r in rows.select(reports.recap_bounded(F.col("t"))).collect()]
    assert got[0] == [Dec("1000.00"), Dec("300.00"), Dec("500.00"), Dec("1200.00")] and got[1:] == [None, None]
    assert rows.limit(1).select(reports.recap(F.col("t"), ["Saldo Awal", "Saldo Akhir"], 4)).first()[0][3] == Dec("1200.00")


def test_statement_errors(spark):
    tx = spark.createDataFrame([("a", 1, Dec(30), None, Dec(970)), ("a", 2, None, Dec(10), Dec(980))], "account string, n int, db decimal(20,2), cr decimal(20,2), saldo decimal(20,2)")

    def errors(closing=980, debit=30, count=1):
        s = spark.createDataFrame([("a", Dec(1000), Dec(closing), Dec(debit), Dec(10), count, 1)], "account string, saldo_awal decimal(20,2), saldo_akhir decimal(20,2), db_total decimal(20,2), cr_total decimal(20,2), db_count int, cr_count int")
        return {r.error for r in reports.statement_errors(tx, s, ["account"], ["n"]).collect()}

    assert errors() == set()
    assert errors(closing=981) == {"printed recap is inconsistent", "closing balance mismatch"}
    assert "debit total mismatch" in errors(debit=31) and errors(count=2) == {"debit count mismatch"}


def test_reconcile_each_account(spark):
    tx = spark.createDataFrame([("f", "1", Dec(10), None), ("f", "2", None, Dec(5)), ("f", "3", None, None)], "source_file string, account string, db decimal(20,2), cr decimal(20,2)")
    s = spark.createDataFrame([("f", "1", Dec(100), Dec(90)), ("f", "2", Dec(100), Dec(100)), ("f", "3", Dec(1), Dec(2))], "source_file string, account string, saldo_awal decimal(20,2), saldo_akhir decimal(20,2)")
    assert [r.account for r in quality.reconcile(tx, s, ["source_file", "account"]).collect()] == ["2"]


def test_same_day_chains_equal_plain_following(spark):
    """Days in any order against following the balances row by row; days that aren't clear stay as printed."""
    random.seed(3)
    schema = "account string, day date, debit decimal(20,2), credit decimal(20,2), balance decimal(20,2), source_row int, opening decimal(20,2)"
    rows, truth = [], {}
    for k in range(25):
        account, at, row, status, placed = f"a{k}" if k else None, 100, 0, "printed", []
        for d in range(1, 4):
            changes = [random.choice([1, 2, 3, 5, -1, -2]) * random.choice([1, 10, 100]) for _ in range(random.randint(1, 9))]
            before, own = at, []
            for c in changes:
                at += c
                own.append((c, at))
            shown = own if random.random() < 0.4 else random.sample(own, len(own))
            if k % 7 == 3 and d == 2:
                shown = [(c, None) for c, _ in shown]
            left, now, order = list(range(len(shown))), before, []
            if any(b is None for _, b in shown) or [b for _, b in shown] != [before + sum(c for c, _ in shown[: i + 1]) for i in range(len(shown))]:
                while left:
                    fit = [i for i in left if shown[i][1] is not None and now + shown[i][0] == shown[i][1]]
                    if len(fit) != 1:
                        break
                    order.append(fit[0])
                    left.remove(fit[0])
                    now = shown[fit[0]][1]
                status = "unresolved" if left or status == "unresolved" else "chained"
            else:
                order = left
            placed += [row + 1 + i for i in order] if len(order) == len(shown) else [row + 1 + i for i in range(len(shown))]
            for c, b in shown:
                row += 1
                rows.append((account, date(2024, 1, d), Dec(-c) if c < 0 else None, Dec(c) if c > 0 else None, None if b is None else Dec(b), row, Dec(100)))
        truth[account] = (status, placed if status != "unresolved" else list(range(1, row + 1)))
    got = {}
    for r in statements.same_day_order(spark.createDataFrame(rows, schema).repartition(4)).collect():
        got.setdefault(r.account, []).append((r.place, r.source_row, r.status))
    assert len({s for s, _ in truth.values()}) == 3
    assert {a: ({s for *_, s in x}, [row for _, row, _ in sorted(x)]) for a, x in got.items()} == {a: ({s}, p) for a, (s, p) in truth.items()}
    assert statements.same_day_order(spark.createDataFrame([], schema)).count() == 0


def test_global_rank(spark):
    random.seed(4)
    rows = [(random.choice(["x", "x", "x", "y", None]), random.choice([1, 2, 2, 3, None, random.randint(4, 900)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    key = lambda r: (r[1] is None, -(r[1] or 0))
    got = ranking.global_rank(df, [F.desc_nulls_last("v"), F.asc("i")]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r["rank"])] == [r[2] for r in sorted(rows, key=lambda r: (key(r), r[2]))] and sorted(r["rank"] for r in got) == list(range(1, 601))
    dense = ranking.global_rank(df, [F.desc_nulls_last("v")], "d", within=["g"], dense=True).collect()
    for g in ("x", "y", None):
        values = sorted({key(r) for r in rows if r[0] == g})
        assert {(r.i, r.d) for r in dense if r.g == g} == {(r[2], 1 + values.index(key(r))) for r in rows if r[0] == g}
    assert ranking.global_rank(df.where("1 = 0"), [F.asc("v")]).count() == 0
