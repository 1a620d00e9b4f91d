"""Which bank's statement a text is, and scans of texts for secrets and personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.parsing import once

#: Markers of each bank's statements and their weights (fixed values); a marker that begins with (? is a pattern.
MARKERS = {
    "BCA": [("BANK CENTRAL ASIA", 10), ("REKENING TAHAPAN", 8), ("BCA BERHAK", 7), ("TANGGAL KETERANGAN CBG MUTASI SALDO", 5), ("CBG MUTASI SALDO", 4), ("NO. REKENING : HALAMAN : PERIODE", 3)],
    "BNI": [
        ("PT BANK NEGARA INDONESIA", 12), ("BANK NEGARA INDONESIA", 10), ("TRANSACTION INQUIRY", 8), ("ACCOUNT STATEMENT", 6), ("ACCOUNT INFORMATION", 5), ("POSTING DATE", 4), ("EFFECTIVE DATE", 4), ("TRANSACTION DESCRIPTION", 4),
        ("POST DATE BRANCH JOURNAL NO. DESCRIPTION AMOUNT DB/CR BALANCE", 7), ("TOTAL DEBIT", 4), ("TOTAL CREDIT", 4), ("TAPLUS", 6), ("TAPLUS MUDA", 6), ("TANGGAL & WAKTU", 4), ("RINCIAN TRANSAKSI", 4),
    ],
    "DKI": [("BANK JAKARTA", 10), ("BANK DKI", 10), ("TABUNGAN MONAS", 8), ("TAB MONAS", 7), (r"(?i)\bDKI\s*-\s*\d{6,}\b", 8), ("E-STATEMENT RINGKASAN", 5), ("TRANSAKSI MASUK TRANSAKSI KELUAR", 4), ("JAKONE", 4)],
    "Mandiri": [("KOPRA BY MANDIRI", 12), ("BANK MANDIRI", 10), ("BMRIIDJA", 8), ("ACCOUNT STATEMENT SUMMARY", 5), ("ACCOUNT NO. ACCOUNT NAME ALIAS PERIOD CURRENCY BRANCH", 5), ("TOTAL AMOUNT DEBITED", 4), ("TOTAL AMOUNT CREDITED", 4)],
    "BRI": [("BANK RAKYAT INDONESIA", 12), ("BRINIDJA", 8), ("GIRO UMUM-IDR", 7), ("UNIT KERJA BUSINESS UNIT", 6), ("NO. REKENING ACCOUNT NO", 5), ("TANGGAL TRANSAKSI TRANSACTION DATE", 5), ("URAIAN TRANSAKSI TRANSACTION DESCRIPTION", 5)],
}
FILE_BONUS = {"BCA": ("BCA", 2), "BNI": ("BNI", 2), "DKI": ("JAKOM|BANK JAKARTA", 2), "Mandiri": ("MANDIRI", 3), "BRI": (r"\bBRI\b", 4)}
LEAST_SCORE = 4


def normalised(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def score(text: Column, markers: list[tuple[str, int]]) -> Column:
    """The weights of the markers that occur; text is normalised. No join: the markers are few and part of the plan."""
    one = lambda m, w: F.when(text.rlike(m) if m.startswith("(?") else text.contains(m), w).otherwise(0)
    return reduce(lambda a, b: a + b, (one(m, w) for m, w in markers))


def best_of(scores: dict[str, Column], least: int) -> Column:
    """The name of the one largest score; null if it is under least or shared."""
    names = F.array(*map(F.lit, scores))
    pick = lambda a, top: F.when((top >= least) & (F.size(F.filter(a, lambda x: x == top)) == 1), F.element_at(names, F.array_position(a, top).cast("int")))
    return once(F.array(*scores.values()), lambda a: pick(a, F.array_max(a)))


def detect_bank(text: Column, file_name: Column) -> Column:
    """The bank of a statement's first pages: a heading decides, else the markers; null if it is unclear."""

    def decide(x: Column) -> Column:
        t, f = x["t"], x["f"]
        scores = {k: score(t, m) + F.when(f.rlike(FILE_BONUS[k][0]), FILE_BONUS[k][1]).otherwise(0) for k, m in MARKERS.items()}
        return (
            F.when(t.contains("LAPORAN TRANSAKSI FINANSIAL"), "BRI").when(t.contains("LAPORAN MUTASI REKENING") & t.contains("RINCIAN TRANSAKSI"), "BNI")
            .when(t.contains("TOTAL AMOUNT DEBITED") | t.contains("LAPORAN REKENING KORAN") & t.contains("REFERENCE"), "Mandiri").otherwise(best_of(scores, LEAST_SCORE))
        )

    return once(F.struct(normalised(text).alias("t"), normalised(file_name).alias("f")), decide)


def _layout(has: Callable[..., Column], like: Callable[[str], Column]) -> Column:
    return (
        F.when(like("REKENING (TAHAPAN|GIRO)") & has("CBG", "MUTASI"), "BCA").when(has("LAPORAN TRANSAKSI FINANSIAL", "Total Transaksi Debet"), "BRI").when(has("Laporan Mutasi Rekening", "Rincian Transaksi"), "BNI")
        .when(has("Posting Date", "Total Amount Debited"), "Mandiri").when(has("E-Statement", "Transaksi Masuk", "Transaksi Keluar"), "DKI")
    )


def detect_layout(text: Column) -> Column:
    """The layout of a statement's text, the first whose marks are all there; null if none is."""
    return _layout(lambda *x: reduce(lambda a, b: a & b, (text.contains(m) for m in x)), text.rlike)


def layout_of_lines(line: Column) -> Column:
    """detect_layout() as an aggregate over a document's lines: no mark goes over a line's end, so its text isn't needed."""
    met = lambda c: F.coalesce(F.max(c), F.lit(False))
    return _layout(lambda *x: reduce(lambda a, b: a & b, (met(line.contains(m)) for m in x)), lambda p: met(line.rlike(p)))


#: Markers of the two generations of one bank's statements (fixed values).
BNI_NEW = ["TRANSACTION INQUIRY", "ACCOUNT STATEMENT", "ACCOUNT INFORMATION", "POST DATE", "POSTING DATE", "EFFECTIVE DATE", "TRANSACTION DESCRIPTION", "DB/CR", "TOTAL DEBIT", "TOTAL CREDIT"]
BNI_OLD = ["LAPORAN MUTASI REKENING", "TANGGAL & WAKTU", "RINCIAN TRANSAKSI", "NOMINAL (IDR)", "SALDO (IDR)"]


def bni_format(text: Column) -> Column:
    """'new' or 'old' by which has more markers, three at least; a tie is old; null if neither has three."""
    count = lambda t: F.struct(score(t, [(m, 1) for m in BNI_NEW]).alias("new"), score(t, [(m, 1) for m in BNI_OLD]).alias("old"))
    return once(once(normalised(text), count), lambda n: F.when((n["new"] >= 3) & (n["new"] > n["old"]), "new").when((n["old"] >= 3) & (n["old"] >= n["new"]), "old"))


#: Families of secrets and personal data that a scan counts (fixed values); plain enough for any engine.
SCAN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "card": r"\b\d{16}\b",
    "identity": r"\b\d{15}\b",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY(?: BLOCK)?-----",
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "GitHub token": r"\b(?:github_pat_|gh[pousr]_)[A-Za-z0-9_]{20,}\b",
    "OpenAI-style API key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "Slack token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "Google API key": r"\bAIza[0-9A-Za-z_-]{30,}\b",
    "credential in URL": r"(?i)\b[a-z][a-z0-9+.-]*://[^/\s:@]+:[^/\s@]+@",
    "assigned credential": r"(?i)\b(?:api[_-]?key|client[_-]?secret|access[_-]?key|password|passwd|pwd|token|secret)\s*[:=]\s*[\"']?[A-Za-z0-9]{8,}",
}
#: What an assigned credential may begin with and be no secret (fixed values).
SAFE = r"(?i)[:=]\s*[\"']?(?:example|placeholder|dummy|test|changeme|your[_-])"


def scan(df: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """key, family, findings of each text and family with any; assigned credentials with a safe value don't count."""

    def count(family: str, pattern: str) -> Column:
        if family != "assigned credential":
            return F.regexp_count(F.col(text), F.lit(pattern)).cast("long")
        return F.size(F.filter(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda x: ~x.rlike(SAFE))).cast("long")

    each = F.array(*(F.struct(F.lit(k).alias("family"), count(k, p).alias("findings")) for k, p in (patterns or SCAN).items()))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(each).alias("x")).select(key, "x.family", "x.findings").where("findings > 0")
