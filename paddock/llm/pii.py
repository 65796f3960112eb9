"""Format-preserving Feistel pseudonyms for validated numbers, dates and mail addresses.

Each value is found by its pattern and validated (Luhn, octets, calendar, number ranges). It is then permuted, under a
key, within the set of the valid values of its format: an alternating Feistel network over two parts, whose round
function is a keyed SHA-256. So equal values get equal pseudonyms in all documents, different values get different ones,
and separators, lengths and check digits stay right. Values that are not valid stay as they are.

Null texts stay null, texts without values stay the same. Rows are rewritten one by one, so repeated rows get the same texts,
empty tables stay empty, and extra columns stay (one called pii_found is replaced). At one place the first pattern of the list
wins. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The secret is the session's setting KEY_SETTING; the queries over synthetic tables use TEST_KEY where it is unset.
KEY_SETTING, TEST_KEY, ROUNDS = "spark.paddock.pii.key", "pseudonym-key-1", 10
_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: A label of a host. Its loops are possessive, as those over labels: nothing shorter could match, and no stack grows with the host.
_LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
#: In this order a position is tried.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}@{_LABEL}(?:\.{_LABEL})++",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}" + _E + "|" + r"(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}" + _E,
    "card": _B + r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{13,19})" + _E,
    "ssn": _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + r"(?![-0-9A-Za-z])",
    "date": _B + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})" + rf"(?:{_E}|(?=[Tt][0-9]{{2}}))",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
}
ANY = "|".join(PATTERNS.values())
#: The 146,097 days of 400 years from this one; a product of 27 and 5411, the radices of a date's two parts.
FIRST_DAY, DATE_RADICES = "1800-01-01", (27, 5411)
#: The days of the other years from 1 to 9999 are permuted among themselves: those before FIRST_DAY, and the radices of all.
DAYS_BEFORE, OTHER_RADICES = 657_071, (762, 4601)


def _random(key: str, kind: str, turn: Column, half: Column, bound: Column) -> Column:
    """The round function: 60 bits of a keyed SHA-256, below ``bound``."""
    seen = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(seen, 1, 15), 16, 10).cast("long") % bound


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs of 0 <= left < n_left and 0 <= right < n_right, as a struct (l, r)."""
    def turn(acc: Column, t: Column) -> Column:
        even = t % 2 == 0
        l, r = acc["l"], acc["r"]
        return F.struct(
            F.when(even, (l + _random(key, kind, t, r, n_left)) % n_left).otherwise(l).alias("l"),
            F.when(even, r).otherwise((r + _random(key, kind, t, l, n_right)) % n_right).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def put_digits(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    at = lambda i: F.length(only_digits(F.substring(form, F.lit(1), i)))
    char = lambda i: F.substring(form, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(char(i).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of as many digits (2 to 36)."""
    size = F.length(digits)
    a = F.floor(size / 2).cast("int")
    b = size - a
    out = feistel(F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, b).cast("long"), _power(a), _power(b), key, kind)
    # one more step, so that the network is worked out once for both of its parts
    return F.transform(F.array(out), lambda o: F.concat(F.lpad(o["l"].cast("string"), a, "0"), F.lpad(o["r"].cast("string"), b, "0")))[0]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a whole number; a valid one's is divisible by 10."""
    size = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (size - i) % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    digits = only_digits(value)
    paid = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    whole = F.transform(F.array(paid), lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))[0]
    return F.when(luhn_sum(digits) % 10 == 0, F.transform(F.array(whole), lambda w: put_digits(value, w))[0])


def _phone(value: Column, key: str) -> Column:
    """The last ten digits are permuted; a country code before them stays."""
    digits = only_digits(value)
    code = F.length(digits) - 10
    moved = permute_digits(F.substring(digits, code + 1, F.lit(10)), key, "phone")
    return F.transform(F.array(F.concat(F.substring(digits, F.lit(1), code), moved)), lambda w: put_digits(value, w))[0]


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = feistel(rank * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def show(o: Column) -> Column:
        k = F.floor(o["l"] / 99)
        k = k + 1 + F.when(k >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(k.cast("string"), 3, "0"), F.lpad((o["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((o["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, F.transform(F.array(out), show)[0])


def _date(value: Column, key: str) -> Column:
    """Year first, or day first; with slashes month first if day first is no date."""
    days, others = DATE_RADICES[0] * DATE_RADICES[1], OTHER_RADICES[0] * OTHER_RADICES[1]

    def moved(form: str) -> Column:
        def turned(day: Column) -> Column:
            near = day.between(0, days - 1)
            place = F.when(near, day).otherwise(day + DAYS_BEFORE - F.when(day < 0, 0).otherwise(days))
            radix = [F.when(near, a).otherwise(b) for a, b in zip(DATE_RADICES, OTHER_RADICES)]
            out = feistel(place % radix[0], F.floor(place / radix[0]), *radix, key, f"date:{form}")
            back = lambda o: o["r"] * radix[0] + o["l"]
            new = F.transform(F.transform(F.array(out), back), lambda n: F.when(near, n).otherwise(n - DAYS_BEFORE + F.when(n < DAYS_BEFORE, 0).otherwise(days)))[0]
            return F.when(day.between(-DAYS_BEFORE, others - DAYS_BEFORE + days - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form))

        day = F.datediff(F.try_to_timestamp(value, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        return F.transform(F.array(day), turned)[0]

    of = lambda like, form: F.when(value.rlike(like), moved(form))
    return F.coalesce(of("^[0-9]{4}-", "yyyy-MM-dd"), of("^[0-9]{4}/", "yyyy/MM/dd"), of(r"^[0-9]{2}\.", "dd.MM.yyyy"), of("^[0-9]{2}/", "dd/MM/yyyy"), of("^[0-9]{2}/", "MM/dd/yyyy"))


def _ip(value: Column, key: str) -> Column:
    part = [F.split(value, r"\.")[i].cast("int") for i in range(4)]
    plain = ~value.rlike(r"(^|\.)0[0-9]")
    out = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ip")
    show = lambda o: F.concat_ws(".", *[F.floor(x / 256).cast("string") if k == 0 else (x % 256).cast("string") for x in (o["l"], o["r"]) for k in (0, 1)])
    return F.when(plain & F.greatest(*part).between(0, 255), F.transform(F.array(out), show)[0])


def _email(value: Column, key: str) -> Column:
    """Letters and digits of the part before the @, each within its own kind: the halves shift each other."""
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    a = F.floor(F.length(name) / 2).cast("int")
    kinds = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")

    def shifted(text: Column, other: Column, turn: Column) -> Column:
        stream = F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), turn.cast("string"), F.length(text).cast("string"), other).cast("binary"), 256)

        def char(i: Column) -> Column:
            c, step = F.substring(text, i, F.lit(1)), F.conv(F.substring(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
            return F.coalesce(*[F.when(F.instr(F.lit(k), c) > 0, F.substring(F.lit(k), (F.instr(F.lit(k), c) - 1 + step) % len(k) + 1, F.lit(1))) for k in kinds], c)

        return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), char), ""))

    def turn(acc: Column, t: Column) -> Column:
        even = t % 2 == 0
        return F.struct(F.when(even, shifted(acc["l"], acc["r"], t)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(shifted(acc["r"], acc["l"], t)).alias("r"))

    start = F.struct(F.substring(name, F.lit(1), a).alias("l"), F.substring(name, a + 1, F.length(name) - a).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.transform(F.array(out), lambda o: F.concat(o["l"], o["r"], F.lit("@"), host))[0]


def pseudonym(value: Column, key: str) -> Column:
    """struct (kind, new) of a found value; kind and new are null if it isn't valid."""
    makers = {"email": _email, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip}
    kind = F.coalesce(*[F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)) for k in PATTERNS])
    tagged = F.struct(kind.alias("kind"), value.alias("old"))
    new = lambda t: F.coalesce(*[F.when(t["kind"] == k, make(t["old"], key)) for k, make in makers.items()])
    with_new = F.transform(F.array(tagged), lambda t: F.struct(t["kind"].alias("kind"), t["old"].alias("old"), new(t).alias("new")))[0]
    return F.transform(F.array(with_new), lambda t: F.struct(F.when(t["new"].isNotNull(), t["kind"]).alias("kind"), t["old"].alias("old"), F.coalesce(t["new"], t["old"]).alias("new")))[0]


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with the text rewritten, and pii_found: array of struct (kind, old, new); kind is null for what was left."""
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    seen = docs.drop("pii_found").withColumn("pii_found", F.when(F.col("text").isNotNull(), F.transform(found, lambda v: pseudonym(v, key))))
    news = F.concat(F.transform("pii_found", lambda p: p["new"]), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split("text", ANY, -1), news, lambda gap, new: F.concat(gap, new)), "")
    return seen.withColumn("text", F.when(F.size("pii_found") > 0, whole).otherwise(F.col("text")))


def rewrite(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in the text, the same columns; n_chars follows the text."""
    out = pseudonymised(docs, key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("pii_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the rewritten text and how many values of each kind were replaced."""
    out = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    count = lambda k: F.coalesce(F.size(F.filter("pii_found", lambda p: p["kind"] == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", *[count(k) for k in PATTERNS])
