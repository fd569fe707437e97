"""Operator 8 against a version in plain Python, and on texts that would make careless patterns slow or deeply recursive."""

import datetime as dt
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import pii

KEY = "k"
FIRST = dt.date(1900, 1, 1)


def shift(form, i, half, modulus):
    return int(hashlib.sha256(f"{KEY}|{form}|{i}|{half}".encode()).hexdigest()[:15], 16) % modulus


def pair(left, right, left_size, right_size, form):
    for i in range(8):
        if i % 2 == 0:
            left = (left + shift(form, i, right, left_size)) % left_size
        else:
            right = (right + shift(form, i, left, right_size)) % right_size
    return left, right


def digits_moved(digits, form):
    n, a = len(digits), len(digits) // 2
    if n < 2:
        return digits
    left, right = pair(int(digits[:a]), int(digits[a:]), 10**a, 10 ** (n - a), f"{form}:{n}")
    return str(left).zfill(a) + str(right).zfill(n - a)


def luhn(digits):
    return sum(v - 9 * (v > 9) for v in (int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits)))) % 10


def check_digit(body):
    return next(c for c in "0123456789" if luhn(body + c) == 0)


def refilled(form, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in form)


def date(year, month, day):
    try:
        found = dt.date(int(year), int(month), int(day))
    except ValueError:
        return None
    return (found - FIRST).days if 1900 <= found.year <= 2099 else None


def day_moved(n):
    left, right = pair(n // 4297, n % 4297, 17, 4297, "date")
    return left * 4297 + right


def assigned(d):
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def valued(m):
    """(kind, pseudonym) of one match, or None."""
    digits = re.sub("[^0-9]", "", m)
    has = lambda kind: re.fullmatch(pii.PATTERNS[kind].replace(pii.BEFORE, "").replace(pii.BEHIND, ""), m)
    if has("email"):
        whole = m.lower()
        mix = lambda part: hashlib.sha256(f"{KEY}|email|{part}".encode()).hexdigest()
        return "email", f"u{mix(whole)[:16]}@d{mix(whole.split('@')[1])[:10]}.example"
    if has("ip"):
        a, b, c, d = map(int, m.split("."))
        x, y = pair(a * 256 + b, c * 256 + d, 65536, 65536, "ip")
        return "ip", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if has("date"):
        a, b, c = re.split("[-/.]", m)
        if "-" in m:
            n, form = date(a, b, c), "%Y-%m-%d"
        else:
            n, form = date(c, b, a), "%d/%m/%Y" if "/" in m else "%d.%m.%Y"
            if n is None and "/" in m:
                n, form = date(c, a, b), "%m/%d/%Y"
        if n is not None:
            late = (FIRST + dt.timedelta(n)).day > 12
            n = day_moved(n)
            while ((FIRST + dt.timedelta(n)).day > 12) != late:
                n = day_moved(n)
            return "date", (FIRST + dt.timedelta(n)).strftime(form)
    if has("phone") and 8 <= len(digits) <= 15:
        code = ""
        if m[0] == "+":
            code = digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGITS else digits[:3]
        return "phone", refilled(m, code + digits_moved(digits[len(code) :], "phone"))
    if has("ssn") and assigned(digits):
        d = digits_moved(digits, "ssn")
        while not assigned(d):
            d = digits_moved(d, "ssn")
        return "ssn", refilled(m, d)
    if has("card") and set(digits) != {"0"} and luhn(digits) == 0:
        body = digits_moved(digits[:-1], "card")
        return "card", refilled(m, body + check_digit(body))
    return None


TWO_DIGITS = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def by_hand(text):
    kinds = []

    def put(m):
        found = valued(m[0])
        if found is None:
            return m[0]
        kinds.append(found[0])
        return found[1]

    return re.sub(pii.ANY, put, text), len(kinds), ",".join(kinds)


TEXTS = [
    "", "nothing here", "pay 4111 1111 1111 1111 or 378282246310005 or 3782 822463 10005, not 4111111111111112",
    "12/25/1990 25/12/1990 5/6/1990 2/29/2024 2/30/2024 13/13/2000 1.2.2003 31.4.2003 1984-02-29 1985-02-29 1899-12-31 2100-01-01",
    "+49 30 1234567, +49 170 1234567, +491701234567, +49 (170) 1234567, +33 1 23 45 67 89, +1 (603) 555-8791, (603) 555-8791, 603.555.8791, +44 20 7946 0958",
    "123-45-6789 000-12-3456 666-12-3456 900-12-3456 123-00-4567 123-45-0000 078-05-1120", "10.0.0.1 255.255.255.255 256.1.1.1 1.2.3.4.5 v1.2.3.4",
    "Bob.x+y@Mail3.example.com. a@b.co, a@b, @b.com, x@y.z1, mail me@here.example.Next", "ids 1234567890123 12345678901234567890 000-000 2024-01-05T10:00 192.168.1.10:80",
    "user@host.museum +1 (603) 555-8791 4111 1111 1111 1111 and 12/31/1999, été 21/01/2001 ünï@code.de",
]


def test_whole_texts_as_by_hand(spark, sf="/root/testdata/sf0.001"):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = rows.unionByName(spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in pii.pseudonymised(rows, KEY).collect():
        assert (r["text"], r["n_values"], r["kinds"]) == by_hand(texts[r["doc_id"]])


def test_numbers_written_in_two_ways_link(spark):
    forms = ["+49 170 1234567", "+491701234567", "+49 (170) 1234567", "+49-170-1234567"]
    out = [r["text"] for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert len({re.sub("[^0-9]", "", t) for t in out}) == 1 and out[0] != forms[0]


def test_every_day_links_in_every_spelling(spark):
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    forms = {"y": "yyyy-MM-dd", "d": "dd/MM/yyyy", "p": "dd.MM.yyyy", "m": "MM/dd/yyyy"}
    moved = lambda f: pii.pseudonym(F.date_format(day, f), F.lit("date"), KEY)
    out = spark.range(0, 73_049, 1, 8).select("id", (F.dayofmonth(day) > 12).alias("late"), *[F.to_date(moved(f), f).alias(k) for k, f in forms.items() if k != "m"], F.when(F.dayofmonth(day) > 12, moved(forms["m"])).alias("m")).cache()  # else every use below works a pseudonym out again
    read = F.to_date("m", forms["m"])
    checks = out.agg(
        F.count("*").alias("days"), F.count_distinct("y").alias("different"), F.count_if((F.col("y") == F.col("d")) & (F.col("y") == F.col("p"))).alias("linked"),
        F.count_if(F.col("late") & (read == F.col("y")) & (F.dayofmonth(read) > 12)).alias("month_first"), F.count_if("late").alias("late"), F.count_if(F.year("y").between(1900, 2099)).alias("in_range"),
    ).first()
    assert checks["days"] == checks["different"] == checks["linked"] == checks["in_range"] == 73_049 and checks["month_first"] == checks["late"]


def test_month_first_dates_and_ssns_stay_in_their_range(spark):
    days = [FIRST + dt.timedelta(n) for n in range(0, 73049, 7)]
    forms = [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    out = spark.createDataFrame([(f,) for f in forms], "m string").select(pii.pseudonym(F.col("m"), F.lit("date"), KEY).alias("p")).collect()
    moved = {r["p"] for r in out}
    assert len(moved) == len(forms) and all(dt.datetime.strptime(p, "%m/%d/%Y").day > 12 for p in moved)
    numbers = spark.range(1, 4000).select(F.format_string("%03d-%02d-%04d", F.lit(665), F.lit(7), "id").alias("m"))
    got = [r["p"] for r in numbers.select(pii.pseudonym(F.col("m"), F.lit("ssn"), KEY).alias("p")).collect()]
    assert len(set(got)) == 3999 and all(assigned(p.replace("-", "")) for p in got)


@pytest.mark.parametrize(
    "text",
    [
        "123 a@b" + ".b" * 20_000, "1" * 1_000_000 + " 123-45-6789", "a" * 1_000_000 + "@b.com 123", "a@" * 300_000 + "123", "1." * 400_000 + "123", "+1 " * 300_000,
        "a@b" + ".bb" * 200 + " 123-45-6789", "1-2-3-" * 200_000 + "123", "(123) " * 200_000, "123 " + ".%+-" * 250_000, "4111 " * 200_000, "a@" + "b-" * 400_000 + ".com 123",
    ],
    ids=range(12),
)
def test_long_runs_take_linear_time(spark, text):
    began = time.time()
    row = pii.pseudonymised(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first()
    assert row["text"] is not None and time.time() - began < 60
    if "123-45-6789" in text:
        assert "123-45-6789" not in row["text"]
