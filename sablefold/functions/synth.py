"""Invented values: the candidate with number k of a shape, as column expressions.

A shape is what a value's replacements have in common: the kind of generator and, for codes, the
value with digits and letters marked. Candidates of one shape differ by construction: counter slots
hold the digits of (b + a * k) mod N in mixed radix, with a prime to N. Slots before them are filled
from a hash of shape and k, never of the value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Marks of a shape: any digit, a letter in upper or lower case, a first digit that isn't 0.
DIGIT, UPPER, LOWER, LEAD = "\u0001", "\u0002", "\u0003", "\u0004"
#: Largest counter; a * k stays below 2**62.
COUNTER = 1_000_000_000
#: Days of birth that fakes fall on: 18 to 90 years before the anchor.
DAYS = (90 - 18) * 365


def kind_of(category: str, field: str, native: str, value: Column) -> Column:
    """Generator of a value: name, email, phone, address, word, date:<layout>, int, id, digits."""
    if native in ("tinyint", "smallint", "int", "bigint"):
        return F.lit("int")
    if native in ("float", "double"):
        return F.lit("real")
    if native in ("date", "timestamp", "timestamp_ntz"):
        return F.lit(f"date:{'native' if native == 'date' else 'time'}")
    digit = value.rlike("[0-9]")
    if category == "name":
        return F.lit("name")
    if category == "address":
        return F.lit("address")
    if category == "identifier":
        return F.lit("id")
    if category == "contact":
        mail = F.lit(True) if "email" in field.lower() else value.contains("@")
        phone = F.lit(True) if "phone" in field.lower() else digit
        return F.when(mail, "email").when(phone & digit, "digits").otherwise("phone")
    if category == "date":
        return F.concat(F.lit("date:"), layout(value))
    return F.when(value.rlike("^[0-9]+$"), "digits").when(digit, "id").otherwise("word")


def layout(value: Column) -> Column:
    """Layout of a string date: separator and order by its parts; ISO where it has none."""
    parts = lambda sep: F.split(value, sep)
    out = F.lit("yyyy-MM-dd")
    for sep in ("\\.", "-", "/"):
        p, s = parts(sep), sep[-1]
        fits = (F.size(p) == 3) & value.rlike(f"^[0-9]{{1,4}}{sep}[0-9]{{1,2}}{sep}[0-9]{{1,4}}$")
        order = F.when(F.length(p[0]) == 4, f"yyyy{s}MM{s}dd").when(p[0].try_cast("int") > 12, f"dd{s}MM{s}yyyy").otherwise(f"MM{s}dd{s}yyyy")
        out = F.when(fits, order).otherwise(out)
    return out


def shape_of(kind: Column, value: Column) -> Column:
    """The shape within a kind: marked value for codes, the kind itself for the rest."""
    marked = F.regexp_replace(value, "[0-9]", DIGIT)
    code = F.regexp_replace(F.regexp_replace(marked, "[A-Z]", UPPER), "[a-z]", LOWER)
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\.0$", ""), r"^(-?)[0-9]", f"$1{LEAD}"), "[0-9]", DIGIT)
    # a fraction's last digit isn't 0, so that equal numbers have equal texts
    number = F.when(number.contains("."), F.regexp_replace(number, f"{DIGIT}$", LEAD)).otherwise(number)
    return F.when(kind == "id", code).when(kind == "digits", marked).when(kind.isin("int", "real"), number).otherwise(F.lit(""))


def radices(shape: Column) -> Column:
    return F.transform(F.split(shape, ""), lambda c: F.when(c == DIGIT, 10).when(c.isin(UPPER, LOWER), 26).when(c == LEAD, 9).otherwise(1).cast("long"))


def counter(shape: Column) -> Column:
    """(size, weights): how many candidates the counter slots tell apart, and each slot's weight (0: none)."""
    start = F.struct(F.lit(1).cast("long").alias("size"), F.lit(True).alias("open"), F.array().cast("array<bigint>").alias("weights"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc["open"] & (acc["size"] * r <= COUNTER)
        slot = F.when(fits & (r > 1), acc["size"]).otherwise(F.lit(0).cast("long"))
        return F.struct(F.when(fits, acc["size"] * r).otherwise(acc["size"]).alias("size"), fits.alias("open"), F.concat(F.array(slot), acc["weights"]).alias("weights"))

    folded = F.aggregate(F.reverse(radices(shape)), start, step)
    return F.struct(folded["size"].alias("size"), folded["weights"].alias("weights"))


def stride(size: int, seed: int) -> int:
    """A number prime to ``size`` near the golden section of it."""
    a = max(1, int(size * 0.6180339887) + seed % 97)
    while math.gcd(a, size) != 1:
        a += 1
    return a


def _mixed(size: Column, k: Column, seed: int) -> Column:
    """(b + a * k) mod size for a column of sizes: products of 9, 10 and 26. A step of 2 * 3 * 5 * 13 * m + 1
    shares no factor with any of them."""
    a = F.floor(size * F.lit(0.6180339887) / 390) * 390 + F.lit(1)
    return F.pmod(F.lit(seed * 7919 + 17) + a * F.pmod(k, size), size).cast("long")


def code(shape: Column, size: Column, weights: Column, k: Column, seed: int) -> Column:
    """The k-th candidate of a code shape."""
    x = _mixed(size, k, seed)
    slots = F.arrays_zip(F.split(shape, "").alias("c"), radices(shape).alias("r"), weights.alias("w"), F.sequence(F.lit(1), F.length(shape)).alias("i"))

    def fill(s: Column) -> Column:
        c, r, w, i = s.getField("c"), s.getField("r"), s.getField("w"), s.getField("i")
        hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), shape, k.cast("string"), i.cast("string"))), 1, 7), 16, 10).cast("long")
        n = F.when(w > 0, F.pmod(F.floor(x / F.greatest(w, F.lit(1))), r)).otherwise(F.pmod(hashed, r)).cast("int")
        letter = lambda base: F.char(n + F.lit(base))
        return F.when(r == 1, c).when(c == DIGIT, n.cast("string")).when(c == LEAD, (n + 1).cast("string")).when(c == UPPER, letter(65)).otherwise(letter(97))

    return F.array_join(F.transform(slots, fill), "")


def _pick(words: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(at, F.lit(len(words))) + 1).cast("int"))


def free(kind: str, k: Column, seed: int, locale: str | None, anchor: str) -> Column:
    """The k-th candidate of a kind without a code shape; beyond the vocabulary it goes on with numbers."""
    first, last = vocab.of(vocab.FIRST, locale), vocab.of(vocab.LAST, locale)
    sizes = {"name": len(first) * len(last), "email": len(first) * len(last) * len(vocab.DOMAIN), "address": 899 * len(vocab.STREET) * len(vocab.KIND) * len(vocab.CITY), "phone": 10_000_000, "word": len(vocab.WORD)}
    if kind.startswith("date:"):
        a = stride(DAYS, seed)
        inside = F.date_sub(F.lit(anchor).cast("date"), (F.lit(18 * 365 + 5) + F.pmod(F.lit(seed * 31 + 7) + F.lit(a) * k, F.lit(DAYS))).cast("int"))
        day = F.when(k < DAYS, inside).otherwise(F.date_sub(F.lit(anchor).cast("date"), (F.lit(90 * 365 + 5) + k - DAYS).cast("int")))
        form = kind.partition(":")[2]
        if form == "native":
            return day.cast("string")
        return F.date_format(day, "yyyy-MM-dd 00:00:00.000000" if form == "time" else form)
    n = sizes[kind]
    x = F.pmod(F.lit(seed * 7919 + 17) + F.lit(stride(n, seed)) * F.pmod(k, F.lit(n)), F.lit(n))
    again = F.floor(k / n) + 1
    number = F.when(again > 1, F.concat(F.lit(" "), again.cast("string"))).otherwise(F.lit(""))
    div = lambda c, d: F.floor(c / d)
    if kind == "name":
        return F.concat(_pick(first, x), F.lit(" "), _pick(last, div(x, len(first))), number)
    if kind == "email":
        local = F.lower(F.concat(_pick(first, x), F.lit("."), _pick(last, div(x, len(first)))))
        return F.concat(local, F.trim(number), F.lit("@"), _pick(vocab.DOMAIN, div(x, len(first) * len(last))))
    if kind == "address":
        s = F.concat((F.pmod(x, F.lit(899)) + 101).cast("string"), F.lit(" "), _pick(vocab.STREET, div(x, 899)), F.lit(" "), _pick(vocab.KIND, div(x, 899 * len(vocab.STREET))))
        return F.concat(s, F.lit(", "), _pick(vocab.CITY, div(x, 899 * len(vocab.STREET) * len(vocab.KIND))), number)
    if kind == "phone":
        return F.concat(F.lit("+1-555-"), F.lpad(div(x, 10_000).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.pmod(x, F.lit(10_000)).cast("string"), 4, "0"), number)
    return F.concat(_pick(vocab.WORD, x), number)
