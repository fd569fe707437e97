"""Operator 8: format-preserving pseudonyms by keyed Feistel networks. DataFrame functions only.

Numbers and dates are validated, then permuted within their own format by a Feistel
network whose round function is SHA-256 of key, format, round and half: digits by
addition modulo a power of ten, addresses modulo 65,536, dates as a day number in mixed
radix.  A permutation keeps different values different, and the same value has the same
pseudonym in every document, so records stay linked.

    card   13 to 19 digits, Luhn valid          all but the check digit, which is recomputed
    phone  + country code and national number, or ten digits in groups    the national digits; separators and a code before them do not matter
    ssn    ddd-dd-dddd, assigned ranges          all digits, walked on until the result is an assigned range too
    ip     four octets                           the 32-bit address
    date   y-m-d, d/m/y, d.m.y, or m/d/y if it   the day number, walked on among the days of a month up to the 12th, or
           is no d/m/y, 1900 to 2099             among later ones, in every spelling: m/d/y reads back, and spellings link
    email  local@domain                          keyed hashes (names have no fixed format)

What fails validation stays as it is, and so do formats not named here: IBANs, IPv6
addresses, and telephone numbers without a country code or groups.  Lengths in the patterns are those of the formats: an
address has at most 64 characters before the @, labels of at most 63 and 127 of them, a last
one of 2 to 63 letters; a telephone number at most 15 digits.  A match starts only where no
character of its own kind stands before it and runs are possessive, so that any text is read
in linear time and without deep recursion.

Defined cases: a null text stays null and counts as no values; empty and very long texts
are read whole; rows are independent, so repeated rows and null doc_ids pass through; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BEFORE, BEHIND = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}+(?![A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9A-Za-z])",
    "date": rf"{BEFORE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}){BEHIND}",
    "phone": (
        r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?\([0-9]{3}\)|\+1[ .-]?[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"
        r"|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)|[0-9]{2,5})[ .-]?[0-9]{5,8}(?![ .-][0-9])|\+[0-9]{1,3}[ .-][0-9](?:[ .-][0-9]{2}){4}"
        r"|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![.-][0-9])|\+[0-9]{8,15}"
        rf"|\([0-9]{{3}}\) ?[0-9]{{3}}[ .-][0-9]{{4}}|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){BEHIND}"
    ),
    "ssn": rf"{BEFORE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{BEHIND}",
    "card": rf"{BEFORE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){BEHIND}",
}
ANY = "|".join(PATTERNS.values())
WORTH_A_LOOK = r"[0-9]{3}|[0-9][./][0-9]|\+[0-9]|@"
FIRST_DAY, DAYS, DAY_RADIX = "1900-01-01", 73_049, (17, 4_297)  # 1900 to 2099; 17 x 4,297 days
WALK = 64  # steps after which a walk ends; over a third of the values are valid, so no walk comes near
#: Country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SSN_UNASSIGNED = r"^(?:000|666|9)|^[0-9]{3}00|0000$"


def prf(key: str, form: Column | str, round_: Column, half: Column, modulus: Column) -> Column:
    form = F.lit(form) if isinstance(form, str) else form
    text = F.concat_ws("|", F.lit(key), form, round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long") % modulus


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, form: Column | str) -> Column:
    """struct(l, r): a permutation of pairs below (left_size, right_size), for any sizes."""

    def step(pair: Column, i: Column) -> Column:
        even = i % 2 == 0
        moved_left = (pair["l"] + prf(key, form, i, pair["r"], left_size)) % left_size
        moved_right = (pair["r"] + prf(key, form, i, pair["l"], right_size)) % right_size
        return F.struct(F.when(even, moved_left).otherwise(pair["l"]).alias("l"), F.when(even, pair["r"]).otherwise(moved_right).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def walked(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """The first valid one of step(start), step(step(start)), ...: step, a permutation, made one of the valid values."""
    return F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), step(start), lambda v, _: F.when(valid(v), v).otherwise(step(v)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, form: str) -> Column:
    """As many digits; at least two are needed, one digit is left alone."""
    n = F.length(digits)
    a = (n / 2).cast("int")
    left, right = F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n - a)
    pair = feistel(left, right, ten_to(a), ten_to(n - a), key, F.concat_ws(":", F.lit(form), n))
    joined = F.concat(F.lpad(pair["l"].cast("string"), a, "0"), F.lpad(pair["r"].cast("string"), n - a, "0"))
    return F.when(n >= 2, joined).otherwise(digits)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Sum from the last digit on; every other digit doubled, the last one too if ``doubled_first``."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + F.pmod(i + int(doubled_first), F.lit(2))))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))


def in_format(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced one after another by those given."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(F.split(form, ""), start, put)["out"]


def whole(kind: str) -> str:
    return f"^(?:{PATTERNS[kind]})$"


def kind_of(m: Column) -> Column:
    """The first format that a candidate has and is valid in; null if none."""
    digits = digits_of(m)
    return (
        F.when(m.rlike(whole("email")), "email")
        .when(m.rlike(whole("ip")), "ip")
        .when(m.rlike(whole("date")) & day_of(m).isNotNull(), "date")
        .when(m.rlike(whole("phone")) & F.length(digits).between(8, 15), "phone")
        .when(m.rlike(whole("ssn")) & ~digits.rlike(SSN_UNASSIGNED), "ssn")
        .when(m.rlike(whole("card")) & ~digits.rlike("^0+$") & (luhn_sum(digits, False) % 10 == 0), "card")
    )


def day_number(year: Column, month: Column, day: Column) -> Column:
    """Days since FIRST_DAY of a calendar date in range; null otherwise."""
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return bound(F.datediff(date, F.lit(FIRST_DAY).cast("date")), lambda n: F.when(n.between(0, DAYS - 1), n))


def date_of(m: Column) -> Column:
    """struct(n, order, mark): the day number, how it is written (ymd, dmy or, with slashes if it is no dmy, mdy) and its separator; n null if no date."""

    def read(parts: Column) -> Column:
        a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
        found = lambda n, order, mark: F.struct(n.alias("n"), F.lit(order).alias("order"), F.lit(mark).alias("mark"))
        slashed = bound(day_number(c, b, a), lambda n: F.when(n.isNotNull(), found(n, "dmy", "/")).otherwise(found(day_number(c, a, b), "mdy", "/")))
        return F.when(m.contains("-"), found(day_number(a, b, c), "ymd", "-")).when(m.contains("/"), slashed).otherwise(found(day_number(c, b, a), "dmy", "."))

    return F.when(m.rlike(whole("date")), bound(F.split(m, "[-/.]"), read))


def day_of(m: Column) -> Column:
    """Days since FIRST_DAY of a calendar date in range, in any of the ways to write it; null otherwise."""
    return date_of(m)["n"]


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    digits = digits_of(m)
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = F.concat(body, F.pmod(-luhn_sum(body, True), F.lit(10)).cast("string"))

    code = F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 1)).otherwise("")
    national = F.substring(digits, F.length(code) + 1, F.length(digits))
    phone = F.concat(code, permuted_digits(national, key, "phone"))
    ssn = walked(digits, lambda d: permuted_digits(d, key, "ssn"), lambda d: ~d.rlike(SSN_UNASSIGNED))

    octets = F.split(m, r"\.")
    octet = lambda i: F.get(octets, F.lit(i)).cast("long")
    address = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65_536), F.lit(65_536), key, "ip")
    ip = F.concat_ws(".", *[x.cast("int").cast("string") for half in ("l", "r") for x in (F.floor(address[half] / 256), address[half] % 256)])

    calendar = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def moved(n: Column) -> Column:
        return bound(feistel(F.floor(n / DAY_RADIX[1]), n % DAY_RADIX[1], F.lit(DAY_RADIX[0]), F.lit(DAY_RADIX[1]), key, "date"), lambda p: p["l"] * DAY_RADIX[1] + p["r"])

    def rewritten(w: Column) -> Column:
        late = F.dayofmonth(calendar(w["n"])) > 12
        day = walked(w["n"].cast("long"), moved, lambda v: (F.dayofmonth(calendar(v)) > 12) == late)
        parts = F.split(F.date_format(calendar(day), "yyyy-MM-dd"), "-")
        put = lambda p, *places: F.concat(F.get(p, F.lit(places[0])), w["mark"], F.get(p, F.lit(places[1])), w["mark"], F.get(p, F.lit(places[2])))
        return bound(parts, lambda p: F.when(w["order"] == "ymd", put(p, 0, 1, 2)).when(w["order"] == "mdy", put(p, 1, 2, 0)).otherwise(put(p, 2, 1, 0)))

    date = bound(date_of(m), rewritten)

    at = F.split(F.lower(m), "@")
    hashed = lambda part, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), part), 256), 1, n)
    email = F.concat(F.lit("u"), hashed(F.lower(m), 16), F.lit("@d"), hashed(F.get(at, F.lit(1)), 10), F.lit(".example"))

    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "date", date)
        .when(kind == "phone", in_format(m, phone)).when(kind == "ssn", in_format(m, ssn))
        .when(kind == "card", in_format(m, card)).otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_values, kinds): whole texts with pseudonyms, the number of values and their kinds in order."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(WORTH_A_LOOK), F.lit(False)).alias("look"))
    nothing = F.array().cast("array<string>")
    found = rows.withColumn("hits", F.when(F.col("look"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(nothing))
    valued = found.withColumn("values", F.transform("hits", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    renamed = valued.withColumn("new", F.transform("values", lambda v: pseudonym(v["m"], v["kind"], key)))
    between = F.split("text", ANY, -1)
    text = F.when(F.size("hits") == 0, F.col("text")).otherwise(F.concat_ws("", F.flatten(F.zip_with(between, "new", lambda p, n: F.array(p, F.coalesce(n, F.lit("")))))))
    kinds = F.filter(F.transform("values", lambda v: v["kind"]), lambda k: k.isNotNull())
    return renamed.select("doc_id", text.alias("text"), F.size(kinds).alias("n_values"), F.array_join(kinds, ",").alias("kinds"))
