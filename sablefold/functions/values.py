"""Value-level expressions: text forms, checks, shapes, redaction, shifting, perturbing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..patterns import BY_NAME, CARD_RUN, LABELS, SHAPES

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_leaf(kind: T.DataType) -> bool:
    """Types that processing supports."""
    return isinstance(kind, (T.StringType, T.BooleanType, *INTEGRAL, *FRACTIONAL, *TEMPORAL))


def as_text(value: Column, kind: T.DataType) -> Column:
    """The one text form of a value that mappings hold and shapes look at. Doubles have no exponent:
    at most six decimals, at least one."""
    if isinstance(kind, FRACTIONAL):
        fixed = value.cast("decimal(38,6)").cast("string")
        return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ".0")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return value.cast("string")


def from_text(text: Column, kind: T.DataType) -> Column:
    """The typed value of a text form; null where it is none."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast(kind)
    return text if isinstance(kind, T.StringType) else text.try_cast(kind)


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def nik_ok(nik: Column) -> Column:
    """Plausible: a region, a month, a day (40 more for women)."""
    day, month = F.substring(nik, 7, 2), F.substring(nik, 9, 2)
    return nik.rlike("^[0-9]{16}$") & (F.substring(nik, 1, 2) != "00") & month.between("01", "12") & (day.between("01", "31") | day.between("41", "71"))


def has_card(text: Column) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(0)), lambda x: luhn_ok(F.regexp_replace(x, "[^0-9]", "")))


def nik_counts(text: Column) -> Column:
    """(examined, valid) of one value: 16-digit runs up to the first plausible one; a value with digits
    but none plausible counts one more; a value without digits counts nothing."""
    runs = F.regexp_extract_all(text, F.lit(BY_NAME["nik"].pattern), F.lit(0))
    at = F.aggregate(runs, F.struct(F.lit(0).alias("seen"), F.lit(False).alias("hit")), lambda acc, x: F.struct((acc["seen"] + F.when(acc["hit"], 0).otherwise(1)).alias("seen"), (acc["hit"] | nik_ok(x)).alias("hit")))
    digits = text.rlike("[0-9]")
    return F.struct((at["seen"] + F.when(digits & ~at["hit"], 1).otherwise(0)).alias("examined"), at["hit"].cast("int").alias("valid"))


def shape_ratio(name: str, text: Column) -> Column:
    """Aggregate: share of non-null values with a shape."""
    if name == "nik":
        counts = nik_counts(text)
        return F.coalesce(F.sum(F.when(text.isNotNull(), counts["valid"])) / F.nullif(F.sum(F.when(text.isNotNull(), counts["examined"])), F.lit(0)), F.lit(0.0))
    hit = has_card(text) if name == "credit_card" else text.rlike(BY_NAME[name].pattern)
    return F.coalesce(F.avg(F.when(text.isNotNull(), hit.cast("double"))), F.lit(0.0))


def shape_order(name: str) -> int:
    return [s.name for s in SHAPES].index(name)


def prose_ratio(text: Column) -> Column:
    """Aggregate: share of values with four words or more."""
    return F.coalesce(F.avg(F.when(text.isNotNull(), (F.size(F.split(F.trim(text), r"\s+")) >= 4).cast("double"))), F.lit(0.0))


def redact_full(value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.lit("[REDACTED]")).otherwise(value)


def redact_partial(value: Column) -> Column:
    """All but the last four characters masked; all of a short value."""
    n = F.length(value)
    return F.when(n <= 4, F.repeat(F.lit("X"), n)).otherwise(F.concat(F.repeat(F.lit("X"), n - 4), F.right(value, F.lit(4))))


def token_label(field: str) -> str:
    low = field.lower()
    return next((label for part, label in LABELS if part in low), "PII")


#: Layouts that string dates are tried in, over their first ten characters.
LAYOUTS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")
_FORMS = (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{4}/\d{1,2}/\d{1,2}$")


def shift_text(value: Column, days: int) -> Column:
    """A date in the first layout that fits, moved; other text unchanged."""
    head = F.substring(value, 1, 10)
    tries = []
    for layout, form in zip(LAYOUTS, _FORMS, strict=True):
        lax = layout.replace("MM", "M").replace("dd", "d")
        day = F.try_to_timestamp(F.when(head.rlike(form), head), F.lit(lax)).cast("date")
        tries.append(F.date_format(F.date_add(day, days), layout))
    return F.coalesce(*tries, value)


def shift_native(value: Column, kind: T.DataType, days: int) -> Column:
    return F.date_add(value, days) if isinstance(kind, T.DateType) else (value + F.expr(f"INTERVAL {days} DAYS")).cast(kind)


def perturb_factor(text: Column, seed: int, pct: float) -> Column:
    """1 - pct to 1 + pct, the same for the same seed and value, in any engine that has md5."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return F.lit(1.0) + (draw * F.lit(2.0) - F.lit(1.0)) * F.lit(float(pct))


def perturb(text: Column, kind: T.DataType, seed: int, pct: float) -> Column:
    """Text form of the perturbed value: integers round, fractions keep six decimals, digit strings stay
    digit strings, anything else is unchanged."""
    factor = perturb_factor(text, seed, pct)
    whole = F.round(text.try_cast("double") * factor).cast("long").cast("string")
    if isinstance(kind, INTEGRAL):
        return whole
    if isinstance(kind, FRACTIONAL):
        return as_text(F.round(text.try_cast("double") * factor, 6), T.DoubleType())
    if isinstance(kind, T.StringType):
        decimal = as_text(F.round(text.try_cast("double") * factor, 6), T.DoubleType())
        return F.when(text.rlike(r"^-?[0-9]{1,15}$"), whole).when(text.rlike(r"^-?[0-9]{1,15}\.[0-9]+$"), decimal).otherwise(text)
    return text


def coalesce_all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), columns)
