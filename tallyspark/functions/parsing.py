"""Column functions that read text: white space, money of two locales, rates, grades, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names of both languages and their short forms, a year a row (fixed values).
MONTHS = (
    "januari februari maret april mei juni juli agustus september oktober november desember "
    "january february march april may june july august september october november december "
    "jan feb mar apr mei jun jul agu sep okt nov des "
    "jan feb mar apr may jun jul aug sep oct nov dec"
).split()


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once, however often body and what the optimizer makes of it use it."""
    return F.get(F.transform(F.array(value), body), 0)


def clean_text(c: Column) -> Column:
    """Control characters, escape sequences and runs of white space as one space, trimmed; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), r"(?:\x1b(?:\[[0-?]*[ -/]*[@-~]|[@-Z\\-_])|[\s\x00-\x1f\x7f-\x9f])+", " ")), F.lit(""))


def column_text(c: Column) -> Column:
    """clean_text() of a column (c is used several times): printable ASCII without two spaces in a row is trimmed only."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[ -~]*\z") & ~text.contains("  "), F.trim(text)).otherwise(clean_text(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(clean_text(c), F.lit(""))


def join_text(a: Column, b: Column) -> Column:
    """a and b with a space between, without the blank ones."""
    return F.array_join(F.filter(F.array(clean_text(a), clean_text(b)), lambda x: x != ""), " ")


def strip_page_artefact(c: Column) -> Column:
    """Drops a trailing 'n B n n', which page breaks leave in wrapped descriptions."""
    return clean_text(F.regexp_replace(c, r"(?i)\s+\d+\s+B\s+\d+\s+\d+\s*$", ""))


def us_money(c: Column) -> Column:
    """1,234.56 as DECIMAL(20,2), negative with the suffix DB; null if it is no number."""
    text = F.upper(clean_text(c))
    number = F.regexp_replace(text, r"DB|[,+\s]", "").try_cast("decimal(20,2)")
    return F.when(text.contains("DB"), -number).otherwise(number)


def us_amount(c: Column) -> Column:
    return F.abs(us_money(c))


def is_debit(c: Column) -> Column:
    return F.upper(clean_text(c)).contains("DB")


def rupiah(c: Column) -> Column:
    """Rp 1.234,56 as DOUBLE; without a comma every dot parts thousands; 0 if it is no number."""
    text = c.cast("string")
    # The usual forms first: a number without thousands has one sign to replace at most, and digits alone need no cleaning.
    digits = F.when(text.rlike(r"^[0-9,.\-]+\z"), text).otherwise(F.regexp_replace(clean_text(c), r"[^0-9,.\-]", ""))
    number = F.when(text.rlike(r"^\d+(?:,\d+)?\z"), F.replace(text, F.lit(","), F.lit("."))).otherwise(F.translate(digits, ",.", "."))
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def rate(c: Column) -> Column:
    """The first number as a fraction: over 1 it is a percentage. Null if there is none."""
    text = c.cast("string")
    found = F.regexp_replace(F.regexp_extract(clean_text(c), r"([-+]?\d+(?:[.,]\d+)?)", 1), ",", ".")
    # The usual form first: a number alone.
    number = F.when(text.rlike(r"^\d+(?:\.\d+)?\z"), text).otherwise(found).try_cast("double")
    return once(number, lambda n: F.when(F.abs(n) > 1, n / 100).otherwise(n))


def grade(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(r"^\d+\z"), text).otherwise(F.regexp_extract(clean_text(c), r"(\d+)", 1)).try_cast("int")


def month_number(name: Column) -> Column:
    """1 to 12; null if it is no month's name."""
    return once(F.array_position(F.lit(MONTHS), F.lower(name)), lambda at: F.when(at > 0, (at - 1) % 12 + 1).cast("int"))


def date(c: Column) -> Column:
    """A day in one of the usual orders, as lenient readers take it; null otherwise.

    Day, month and year (or year first), parted by -, /, . or spaces; months as numbers or names of
    both languages. The day stands before the month; where that makes no date, after it. A year of
    two digits is one of 2000 to 2099. A time of day that follows is ignored.
    """
    day = F.regexp_replace(clean_text(c), r"(?i)[ t]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: ?[ap]m|z)?$", "")

    def read(p: Column) -> Column:
        at = lambda i: F.get(p, i)
        number = lambda i: F.coalesce(month_number(at(i)).cast("string"), at(i))
        made = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), m, d), "yyyy-M-d")
        joined = F.array_join(p, "-")
        return (
            F.when(joined.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), made(at(0), at(1), at(2))).when(joined.rlike(r"^\d{1,2}-\d{1,2}-(?:\d{2}|\d{4})$"), F.coalesce(made(at(2), at(1), at(0)), made(at(2), at(0), at(1))))
            .when(joined.rlike(r"^\d{1,2}-[A-Za-z]+-(?:\d{2}|\d{4})$"), made(at(2), number(1), at(0))).when(joined.rlike(r"^[A-Za-z]+-\d{1,2}-\d{4}$"), made(at(2), number(0), at(1)))
            .when(joined.rlike(r"^\d{8}$"), F.try_to_date(joined, "yyyyMMdd"))
        )

    # The usual form first; it needs no parts.
    text = c.cast("string")
    part = lambda at, n: F.substring(text, at, n)
    plain = F.when(text.rlike(r"^\d{2}-\d{2}-\d{4}\z"), F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)).try_cast("date"))
    return F.coalesce(plain, F.when(text != "", once(F.split(day, r"[-/., ]+"), read)))


def statement_date(c: Column) -> Column:
    """d/MM/yy of the years 2000 to 2099."""
    return F.try_to_date(clean_text(c), "d/M/yy")


def sheet_name(c: Column) -> Column:
    """At most 31 characters, without those that sheet names forbid."""
    return F.substring(F.regexp_replace(clean_text(c), r"[\[\]:*?/\\]", "_"), 1, 31)


def rupiah_label(c: Column) -> Column:
    return F.concat(F.lit("Rp "), F.translate(F.format_number(c, 0), ",", "."))


def body_and_code(body: Column) -> tuple[Column, Column]:
    """Description and code: the last of several words is a code if it has only letters, digits, / and -."""
    text = clean_text(body)
    coded = r"(?i)^(.*\S)\s+([A-Z0-9/\-]+)$"
    has = text.rlike(coded)
    return F.when(has, F.regexp_extract(text, coded, 1)).otherwise(text), F.when(has, F.regexp_extract(text, coded, 2)).otherwise(F.lit(""))


def frequency(c: Column) -> Column:
    """A count as it is printed, with thousands parted by commas; null if it is no number."""
    return us_money(F.regexp_replace(F.upper(clean_text(c)), "DB|CR", "")).cast("long")


def split_mutation(c: Column) -> tuple[Column, Column]:
    """Debit and credit of a printed amount: DB says which; CR may stand for the other."""
    value = us_money(F.regexp_replace(F.upper(clean_text(c)), "DB|CR", ""))
    return F.when(is_debit(c), value), F.when(~is_debit(c), value)


def plain_number(c: Column) -> Column:
    """1,234.50 as DOUBLE with the sign of a DB suffix; null if it is no number."""
    return us_money(c).cast("double")


def to_float(c: Column) -> Column:
    """A DOUBLE as it stands; what is no number (thousands parted by commas, too) or null gives 0."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0))


def to_amount(c: Column) -> Column:
    """A DOUBLE with commas dropped; null if it is no number."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")


def to_int(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double").cast("int")


def month_label(d: Column, separator: str = "-") -> Column:
    """Jan-24; with _ the name of a sheet."""
    return F.concat(F.get(F.array(*map(F.lit, "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())), F.month(d) - 1), F.lit(separator), F.date_format(d, "yy"))


def day_label(d: Column) -> Column:
    return F.date_format(d, "dd/MM")


def first_day_label(day: Column) -> Column:
    """01/mm for a day label dd/mm; the label itself if it is none."""
    return F.when(day.rlike(r"^\d{2}/\d{2}$"), F.concat(F.lit("01/"), F.substring(day, 4, 2))).otherwise(day)


def percent_label(rate_: Column) -> Column:
    """A fraction as a percentage with two decimals and a comma."""
    return F.concat(F.translate(F.format_number(rate_ * 100, 2), ".,", ",."), F.lit("%"))


def output_name(template: str, **fields: Column) -> Column:
    """A template with {names}; ValueError if it asks for a field that isn't given."""
    import string

    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            if name not in fields:
                raise ValueError(f"unknown placeholder {{{name}}}; known: {sorted(fields)}")
            parts.append(fields[name].cast("string"))
    return F.regexp_replace(F.concat(*parts), r'[<>:"/\\|?*]', "_")


def add_diagnostic(issues: Column, message: Column) -> Column:
    """A list of diagnostics joined by ' | ' with a message added, unless it is blank or there already."""
    have = F.filter(F.split(F.coalesce(issues, F.lit("")), r" \| "), lambda x: x != "")
    return F.array_join(F.array_union(have, F.filter(F.array(clean_text(message)), lambda x: x != "")), " | ")


#: Labels in Indonesian of what the engine names in English (fixed values).
LOCAL = {
    "Overdue": "Lewat Jatuh Tempo", "0-3 Months": "0-3 Bulan", "3-6 Months": "3-6 Bulan", "6-12 Months": "6-12 Bulan", ">12 Months": ">12 Bulan", "Unknown": "Tidak Diketahui", "Current": "Lancar",
    "Special Mention": "Dalam Perhatian Khusus", "Problem Loan": "Kredit Bermasalah", "High Rate": "Bunga Tinggi", "Near Maturity": "Mendekati Jatuh Tempo", "Written-Off": "Dihapusbukukan", "Charged-Off": "Hapus Tagih",
}


def localised(c: Column) -> Column:
    """The label in Indonesian; one that has none stays."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in LOCAL.items() for x in pair)), c), c)


def token_kind(c: Column) -> Column:
    """date, time, datetime, money or text: what a token is as a whole."""
    t = clean_text(c)
    return (
        F.when(t.rlike(r"^\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?$"), "date").when(t.rlike(r"^\d{1,2}:\d{2}(?::\d{2})?$"), "time").when(t.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4} \d{1,2}:\d{2}(?::\d{2})?$"), "datetime")
        .when(t.rlike(r"^[+-]?\d{1,3}(?:,\d{3})*\.\d{2}(?: (?:DB|CR))?$"), "money").otherwise("text")
    )
