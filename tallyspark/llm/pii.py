"""PII surrogates: detected entities get keyed replacements of their own kind.

An entity's normal form (digits of a phone number, an e-mail address in lower case, a name in lower
case) and a secret key give its surrogate, so an entity has one surrogate wherever and however it is
written, and the text keeps its format: digits stay digits, letters keep case and script, separators
stay, card numbers keep a valid check digit, addresses stay addresses, and names follow the gender
of the title; a neutral title takes the gender that the same given name has elsewhere in the text.
A name that stands with a title somewhere is replaced wherever else it stands in that text.

Two entities must not share a surrogate, and no surrogate may be a real entity of the corpus. All
normal forms of the corpus are held against each other; of those that clash the later ones are given
the next attempt until none does. Surrogates of every kind get longer with the attempt (an IPv4
address moves to the IPv6 block for documentation), so there are enough of them even where all of a
shape are real, and the loop ends for any corpus. Clashes are rare, so only these few exceptions are
looked up when texts are rewritten; all other surrogates are computed in place.

Only DataFrame functions are used. Scale: texts are scanned twice and never shuffled. The distinct
normal forms are shuffled once, pre-aggregated by task, so an entity in very many documents is one
row of each task. Exceptions are broadcast only if they are few.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import broadcast_if_small, checkpoint, text_of
from tallyspark.llm.quality import let, text_key

TITLES = {"m": "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|господин|г-н", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Doña|госпожа|г-жа", "n": "Dr|Prof|Doctor|Professor"}
#: Labels of a domain up to one that begins with two letters. Groups are repeated possessively only: Java's other loops take stack for each round, and a long run ends the executor.
LABELS = r"(?:\.(?![A-Za-z]{2})[\p{L}\p{N}-]++)*+\.[A-Za-z]{2}"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@[\p{{L}}\p{{N}}-]++(?:{LABELS}[\p{{L}}\p{{N}}-]*+(?={LABELS}))*+{LABELS}[A-Za-z]*"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?!\d)"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CLOUD_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET_WORD = r"(?:[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]|[Ss]ecret|[Tt]oken|[Pp]ass(?:word|wd)|[Pp]wd)\s{0,2}[=:]"
SECRET = rf"(?<!\p{{L}}){SECRET_WORD}\s{{0,2}}[\"']?[A-Za-z0-9_/+-]{{8,}}"
#: A possessive 's is no part of a name.
NAME = r"\p{Lu}(?:\p{L}|['-](?!s(?!\p{L}))(?=\p{L}))++"
PERSON = rf"(?<!\p{{L}})(?:{'|'.join(TITLES.values())})\.? {NAME}(?: {NAME})?"
ENTITY = "|".join([EMAIL, CLOUD_KEY, SECRET, SSN, PHONE, CARD, IP, PERSON])
#: Where none of these stands there is no entity.
HINT = rf"[0-9@]|AKIA|{SECRET_WORD}|(?:{'|'.join(TITLES.values())})\.? \p{{Lu}}"

GIVEN = {
    "latin-m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Noah Oskar Paul Robert Simon Thomas Viktor",
    "latin-f": "Anna Berta Clara Diana Emma Flora Greta Helena Ida Julia Karla Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera",
    "cyrillic-m": "Адам Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Семён Тимур Юрий",
    "cyrillic-f": "Анна Вера Галина Дарья Елена Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса Софья Юлия",
}
GIVEN["latin-n"], GIVEN["cyrillic-n"] = f"{GIVEN['latin-m']} {GIVEN['latin-f']}", f"{GIVEN['cyrillic-m']} {GIVEN['cyrillic-f']}"
SYLLABLES = {"latin": "bal ber dor fel gar hen kor lam mer nor pel ras sel tor vin wal", "cyrillic": "бал бер дор фел гар хен кор лам мер нор пел рас сел тор вин вал"}
#: A surrogate of digits gets one digit more after each so many attempts, one of letters a letter every second attempt.
DIGIT_EVERY = 4


def _number(seed: Column, at: Column | int) -> Column:
    """A number under 2^32 for each place of a seed."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", seed, (at if isinstance(at, Column) else F.lit(at)).cast("string")), 256), 1, 8), 16, 10).cast("long")


def _swapped(text: Column, seed: Column) -> Column:
    """text with each letter and digit replaced by one of its class; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        n = _number(seed, i)
        step = lambda first, size: F.chr(first + n % size)
        cyrillic = lambda first: F.get(F.split(F.lit("".join(chr(first + k) for k in range(32))), ""), (n % 32).cast("int"))
        return (
            F.when(c.rlike("^[0-9]$"), step(F.lit(48), 10)).when(c.rlike(r"^\p{IsCyrillic}$") & (c == F.upper(c)), cyrillic(0x410)).when(c.rlike(r"^\p{IsCyrillic}$"), cyrillic(0x430))
            .when(c.rlike(r"^\p{Lu}$"), step(F.lit(65), 26)).when(c.rlike(r"^\p{L}$"), step(F.lit(97), 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits; 0 if the last digit is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by those of digits, in order."""
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(_digits(F.substring(shape, 1, i + 1))), 1)).otherwise(c)), "")


def kind_of(e: Column) -> Column:
    """The kind of a match of ENTITY; null for a card number whose check digit is wrong."""
    full = lambda pattern: e.rlike(f"^(?:{pattern})$")
    return (
        F.when(e.contains("@"), "email").when(full(CLOUD_KEY), "cloud_key").when(full(SECRET), "secret").when(full(PERSON), "person").when(full(SSN), "ssn").when(full(IP), "ip")
        .when(full(CARD), F.when(luhn(_digits(e)) == 0, "card")).when(full(PHONE), "phone")
    )


def _title_gender(e: Column) -> Column:
    return F.when(e.rlike(rf"^(?:{TITLES['f']})\.? "), "f").when(e.rlike(rf"^(?:{TITLES['m']})\.? "), "m").otherwise("n")


def _names(e: Column) -> Column:
    return F.regexp_replace(e, rf"^(?:{'|'.join(TITLES.values())})\.? ", "")


def _value(e: Column) -> Column:
    return F.regexp_extract(e, r"([A-Za-z0-9_/+-]{8,})$", 1)


def _phone(e: Column) -> Column:
    """Digits of a phone number; one of ten digits is the same with and without the country's 1."""
    return F.regexp_replace(_digits(e), r"^1(?=\d{10}$)", "")


def genders_of(matches: Column) -> Column:
    """Array of (form, gender) of the given names that stand with a title of a gender."""
    parts = lambda e: F.split(F.lower(_names(e)), " ")
    one = lambda e: F.when((kind_of(e) == "person") & (_title_gender(e) != "n") & (F.size(parts(e)) == 2), F.struct(F.get(parts(e), 0).alias("form"), _title_gender(e).alias("gender")))
    return F.filter(F.transform(matches, one), lambda x: x.isNotNull())


def forms_in(matches: Column) -> Column:
    """Array of (kind, form) of all the matches of a text."""
    none = F.array().cast("array<struct<kind:string,form:string>>")
    return let(genders_of(matches), lambda g: F.flatten(F.transform(matches, lambda e: F.coalesce(forms_of(e, g), none))))


def forms_of(e: Column, genders: Column) -> Column:
    """Array of (kind, form): the normal forms that a match is made of; a person has one for each name."""
    form = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("form"))
    one = lambda kind, x: F.array(form(kind, x))
    k = kind_of(e)

    def person(names: Column) -> Column:
        parts = F.split(F.lower(names), " ")
        own = _title_gender(e)
        known = F.array_max(F.transform(F.filter(genders, lambda x: x["form"] == F.get(parts, 0)), lambda x: x["gender"]))
        given = F.struct(F.concat(F.lit("given-"), F.when(own == "n", F.coalesce(known, own)).otherwise(own)).alias("kind"), F.get(parts, 0).alias("form"))
        return F.when(F.size(parts) == 2, F.array(given, form("family", F.get(parts, 1)))).otherwise(F.array(form("family", F.get(parts, 0))))

    return (
        F.when(k == "email", one("email", F.lower(e))).when(k == "cloud_key", one("cloud_key", e)).when(k == "secret", one("secret", _value(e))).when(k == "ip", one("ip", e))
        .when(k == "ssn", one("ssn", _digits(e))).when(k == "card", one("card", _digits(e))).when(k == "phone", one("phone", _phone(e))).when(k == "person", person(_names(e)))
    )


def surrogate_of(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form."""
    # Of a fixed length, as it is hashed again for each place of the form.
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string")), 256)

    places = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    more_letters = lambda s: F.array_join(F.transform(places(F.ceil(attempt / 2).cast("int")), lambda i: F.chr(97 + _number(s, -i) % 26)), "")
    more_digits = lambda s: F.array_join(F.transform(places(F.floor(attempt / DIGIT_EVERY).cast("int")), lambda i: (_number(s, -i) % 10).cast("string")), "")

    def email(s: Column) -> Column:
        host, top = F.regexp_extract(form, r"@(.*)\.[^.]*$", 1), F.regexp_extract(form, r"\.([^.]*)$", 1)
        own = F.regexp_replace(host, r"\.?example$", "")
        return F.concat(_swapped(F.substring_index(form, "@", 1), s), more_letters(s), F.lit("@"), F.when(own != "", F.concat(_swapped(own, F.concat(s, F.lit("@"))), F.lit("."))).otherwise(""), F.lit("example."), top)

    def card(s: Column) -> Column:
        body = F.concat(F.substring(form, 1, 1), _swapped(form.substr(F.lit(2), F.length(form) - 2), s), more_digits(s))
        return F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))

    def ip(s: Column) -> Column:
        v4 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, 1 + _number(s, i) % 223).otherwise(_number(s, i) % 256).cast("string")), ".")
        v6 = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.lower(F.hex(_number(s, i) % 65536))), ":"))
        return F.when(attempt < 2 * DIGIT_EVERY, v4).otherwise(v6)

    def name(s: Column) -> Column:
        script = F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        syllable = lambda at: F.get(F.split(F.when(script == "cyrillic", SYLLABLES["cyrillic"]).otherwise(SYLLABLES["latin"]), " "), (_number(s, at) % 16).cast("int"))
        # Names grow by a syllable every second attempt, so there are enough of them for any number of entities.
        syllables = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), n), syllable), "")
        more = F.floor(attempt / 2).cast("int")
        family = F.concat(*(syllable(i) for i in range(4)), F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(4), 3 + more), syllable), "")).otherwise(""))
        lists = reduce(lambda c, x: c.when(F.concat(script, F.lit("-"), F.substring(kind, -1, 1)) == x, GIVEN[x].lower()), GIVEN, F.when(F.lit(False), ""))
        # A list of given names is short: those after the first attempt get two syllables, later ones more, which keeps them apart.
        given = let(F.split(lists, " "), lambda x: F.get(x, (_number(s, 0) % F.size(x)).cast("int")))
        return F.when(kind == "family", family).otherwise(F.concat(given, F.when(attempt > 0, F.concat(F.lit("-"), syllables(2 + F.floor((attempt - 1) / 2).cast("int")))).otherwise("")))

    def phone(s: Column) -> Column:
        head = F.when(F.length(form) > 10, F.substring(form, 1, 1)).otherwise("")
        rest = form.substr(F.length(head) + 1, F.length(form))
        # No group that may stand for an area begins with 0 or 1.
        return F.concat(head, (2 + _number(s, 99) % 8).cast("string"), _swapped(rest.substr(F.lit(2), F.length(rest)), s), more_digits(s))

    return let(
        seed,
        lambda s: F.when(kind == "email", email(s)).when(kind == "card", card(s)).when(kind == "ip", ip(s)).when(kind == "phone", phone(s))
        .when(kind == "cloud_key", F.concat(F.lit("AKIA"), _swapped(form.substr(F.lit(5), F.length(form)), s), F.upper(more_letters(s)))).when(kind == "ssn", F.concat(_swapped(form, s), more_digits(s)))
        .when(kind == "secret", F.when(form.rlike("^[0-9a-f]+$"), F.translate(F.concat(_swapped(form, s), more_letters(s)), "ghijklmnopqrstuvwxyz", "abcdefabcdefabcdefab")).otherwise(F.concat(_swapped(form, s), more_letters(s)))).otherwise(name(s)),
    )


def _in_case(name: Column, shape: Column) -> Column:
    return F.when(shape == F.upper(shape), F.upper(name)).otherwise(F.initcap(name))


def _rewritten(e: Column, core: Callable[[Column], Column], genders: Column) -> Column:
    """A match with its surrogate in its own format; core gives the surrogate of a (kind, form)."""
    k = kind_of(e)

    def person(forms: Column) -> Column:
        title = F.regexp_extract(e, rf"^(?:{'|'.join(TITLES.values())})\.? ", 0)
        return F.concat(title, F.array_join(F.transform(forms, lambda f: _in_case(core(f), _names(e))), " "))

    def digits(whole: Column, size: Column) -> Column:
        # What stands before the form is kept; digits beyond the form's follow at the end.
        kept = F.left(_digits(e), F.length(_digits(e)) - size)
        return F.concat(_refilled(e, F.concat(kept, whole)), whole.substr(size + 1, F.length(whole)))

    def render(forms: Column) -> Column:
        whole = core(F.get(forms, 0))
        return (
            F.when(k.isin("card", "phone", "ssn"), digits(whole, F.length(F.get(forms, 0)["form"]))).when(k == "secret", F.concat(e.substr(F.lit(1), F.length(e) - F.length(_value(e))), whole))
            .when(k == "person", person(forms)).when((k == "email") & (e == F.upper(e)), F.upper(whole)).otherwise(whole)
        )

    return F.when(k.isNull(), e).otherwise(let(forms_of(e, genders), render))


def _named(matches: Column, genders: Column) -> Column:
    """Array of (name, f: kind and form) of the names of three letters or more that stand with a title."""
    each = lambda e: F.when(kind_of(e) == "person", F.zip_with(F.split(_names(e), " "), forms_of(e, genders), lambda n, f: F.struct(n.alias("name"), f.alias("f")))).otherwise(F.array().cast("array<struct<name:string,f:struct<kind:string,form:string>>>"))
    return F.filter(F.flatten(F.transform(matches, each)), lambda x: F.length(x["name"]) >= 3)


def _mentions(segment: Column, names: Column) -> Column:
    """Array of the bare names in what stands between matches."""
    pattern = F.concat(F.lit(r"(?<![\p{L}'-])(?:"), F.array_join(F.array_distinct(F.transform(names, lambda x: x["name"])), "|"), F.lit(r")(?!\p{L})"))
    return F.struct(F.regexp_extract_all(segment, pattern, F.lit(0)).alias("met"), F.split(segment, pattern, -1).alias("rest"))


def _renamed(found: Column, names: Column, core: Callable[[Column], Column]) -> Column:
    new = F.transform(found["met"], lambda m: _in_case(core(F.get(F.filter(names, lambda x: x["name"] == m), 0)["f"]), m))
    return F.array_join(F.zip_with(found["rest"], F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def assigned(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """kind, form, attempt, core of each entity of docs: no two of a kind share a core, and no core is a form of its kind."""
    matches = docs.select(_matches(text_of(text_col)).alias("e")).where(F.size("e") > 0)
    found = matches.select(F.explode(forms_in(F.col("e"))).alias("f")).select("f.kind", "f.form").distinct()
    made = lambda df: df.withColumn("core", surrogate_of(F.col("kind"), F.col("form"), F.col("attempt"), key))
    now = checkpoint(made(found.withColumn("attempt", F.lit(0))))
    real = now.select("kind", F.col("form").alias("core"))
    while True:
        # The least (attempt, form) of those that share a core keeps it.
        first = now.groupBy("kind", "core").agg(F.min(F.struct("attempt", "form")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "core", "first")
        late = now.join(first, ["kind", "core"]).where(F.struct("attempt", "form") != F.col("first")).select("kind", "form")
        taken = now.join(real, ["kind", "core"], "left_semi").select("kind", "form")
        clash = checkpoint(late.union(taken).distinct().withColumn("clash", F.lit(1)))
        if clash.isEmpty():
            return now
        moved = now.join(clash, ["kind", "form"], "left")
        now = checkpoint(made(moved.select("kind", "form", (F.col("attempt") + F.coalesce("clash", F.lit(0))).alias("attempt"))))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text rewritten, and n_pii (entities and bare names replaced) and pii_kinds (distinct kinds, sorted, comma-joined).

    Who has the key can find entities by trying them, so it must be kept secret.

    Columns of docs named n_pii or pii_kinds are replaced; all others are kept, whatever their names,
    and all rows, with null or repeated ids or not. A null text stays null and has no entities; a text
    without entities is not changed. An empty table gives an empty table. A number in the form of a
    card whose check digit is wrong is no entity. A bare name is one of at least three letters that
    stands with a title in the same text.
    """
    exceptions = assigned(docs, key, text_col).where("attempt > 0").select("kind", "form", "attempt")
    own = [c for c in docs.columns if c.lower() not in ("n_pii", "pii_kinds")]
    # The caller's columns travel in one struct, so no name of theirs meets one of ours.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), *text_key(text_col))
    # A match is rewritten inside its row. Where attempts other than the first are needed, a map of these comes by a join on the text's key.
    if exceptions.isEmpty():
        rows = rows.withColumn("tries", F.lit(None).cast("map<string,int>"))
    else:
        met = rows.select("_k1", "_k2", _matches(text_of()).alias("e")).where(F.size("e") > 0).select("_k1", "_k2", F.explode(forms_in(F.col("e"))).alias("f"))
        tries = met.select("_k1", "_k2", "f.kind", "f.form").distinct().join(broadcast_if_small(exceptions), ["kind", "form"])
        maps = checkpoint(tries.groupBy("_k1", "_k2").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "kind", "form"), "attempt"))).alias("tries")))
        rows = rows.join(broadcast_if_small(maps), ["_k1", "_k2"], "left")

    def core(f: Column) -> Column:
        attempt = F.coalesce(F.try_element_at(F.col("tries"), F.concat_ws("\x1f", f["kind"], f["form"])), F.lit(0))
        return surrogate_of(f["kind"], f["form"], attempt, key)

    none = F.array().cast("array<struct<new:string,kind:string>>")
    found = rows.withColumn("e", _matches(text_of())).withColumn("genders", genders_of(F.col("e"))).withColumn("names", _named(F.col("e"), F.col("genders")))
    parts = F.transform("e", lambda e: F.struct(_rewritten(e, core, F.col("genders")).alias("new"), kind_of(e).alias("kind")))
    between = F.when(F.size("e") > 0, F.split("text", ENTITY, -1))
    bare = F.when(F.size("names") > 0, F.transform(between, lambda x: _mentions(x, F.col("names"))))
    done = found.withColumn("p", F.when(F.size("e") > 0, parts).otherwise(none)).withColumn("bare", bare)
    segments = F.when(F.col("bare").isNull(), between).otherwise(F.transform("bare", lambda x: _renamed(x, F.col("names"), core)))
    joined = F.array_join(F.zip_with(segments, F.concat(F.transform("p", lambda p: p["new"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kinds = F.filter(F.transform("p", lambda p: p["kind"]), lambda x: x.isNotNull())
    n_bare = F.coalesce(F.aggregate(F.transform("bare", lambda x: F.size(x["met"])), F.lit(0), lambda a, n: a + n), F.lit(0))
    return done.select(
        *(F.when(F.size("p") == 0, F.col("text")).otherwise(joined).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in own),
        (F.size(kinds) + n_bare).cast("long").alias("n_pii"), F.array_join(F.sort_array(F.array_distinct(kinds)), ",").alias("pii_kinds"),
    )
