"""Scrubbing prose: spans of personal data become numbered tokens, the same for the same value in a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import luhn_ok, nik_ok
from ..patterns import BY_NAME, CARD_RUN
from ..work import ranked, written

#: Detectors in order of precedence among spans of the same place.
ORDER = ("email", "url_credentials", "iban", "ipv4", "npwp", "credit_card", "nik", "bpjs", "phone")
_FINDERS = {n: re.compile(CARD_RUN if n == "credit_card" else BY_NAME[n].pattern, re.ASCII) for n in ORDER}
SPANS = "array<struct<start:int,end:int,label:string,value:string>>"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _plausible(nik: str) -> bool:
    day, month = int(nik[6:8]), int(nik[8:10])
    return nik[:2] != "00" and 1 <= month <= 12 and (1 <= day <= 31 or 41 <= day <= 71)


def _valid(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "credit_card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "nik":
        return _plausible(text)
    return kind != "phone" or len(digits) >= 7


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, label) of a text: earliest first, longest of those that begin together, no overlaps."""
    if not text:
        return []
    found = [(m.start(), -m.end(), i, n) for i, n in enumerate(ORDER) for m in _FINDERS[n].finditer(text) if _valid(n, m[0])]
    out, at = [], 0
    for start, end, _, n in sorted(found):
        if start >= at:
            out.append((start, -end, BY_NAME[n].label))
            at = -end
    return out


def spans(text: Column) -> Column:
    """find_spans() of a column, with values (Arrow batches)."""

    @F.pandas_udf(SPANS)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: [{"start": a, "end": b, "label": n, "value": s[a:b]} for a, b, n in find_spans(s)])

    return find(text)


def counts(text: Column) -> list[Column]:
    """Validated matches of each detector by itself, before overlaps are resolved; built-in functions."""
    out = []
    for n in ORDER:
        found = F.regexp_extract_all(text, F.lit(CARD_RUN if n == "credit_card" else BY_NAME[n].pattern), F.lit(0))
        digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
        if n == "credit_card":
            found = F.filter(found, lambda x: luhn_ok(digits(x)))
        elif n == "nik":
            found = F.filter(found, nik_ok)
        elif n == "phone":
            found = F.filter(found, lambda x: F.length(digits(x)) >= 7)
        out.append(F.coalesce(F.size(found), F.lit(0)).cast("long").alias(f"n_{n}"))
    return out


def scrub(df: DataFrame, text: str, session: list[str], order: list[str], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``df`` with its prose scrubbed, dictionary (session..., value, label, token)).

    A session's tokens are numbered over all labels by first occurrence (``order``, then position);
    ``known`` values keep their token and new numbers go on after them. Sessions are independent: no
    task sees more than one session's distinct values at a time, and only first occurrences are ranked.
    """
    row = "__row"
    df = written(df.withColumn(row, F.monotonically_increasing_id()).withColumn("__spans", spans(F.col(f"`{text}`"))), "scrub-spans")
    each = df.select(row, *session, *order, F.posexplode("__spans").alias("__at", "__s"))
    first = each.groupBy(*session, F.col("__s.value").alias("value")).agg(F.min(F.struct(*order, "__at", F.col("__s.label").alias("label"))).alias("first"))
    base = None
    if known is not None:
        first = first.join(known.select(*session, "value"), [*session, "value"], "left_anti")
        base = known.groupBy(*session).agg(F.max(F.regexp_extract("token", r"_(\d+)>$", 1).cast("long")).alias("__base"))
    numbered = ranked(first, session, [F.col("first")], "__n")
    numbered = numbered.join(base, session, "left") if base is not None else numbered.withColumn("__base", F.lit(0))
    token = F.concat(F.lit("<"), F.col("first.label"), F.lit("_"), (F.col("__n") + 1 + F.coalesce("__base", F.lit(0))).cast("string"), F.lit(">"))
    new = numbered.select(*session, "value", F.col("first.label").alias("label"), token.alias("token"))
    table = written(new if known is None else known.select(*session, "value", "label", "token").unionByName(new), "scrub-tokens")
    pairs = each.select(row, *session, F.col("__s.value").alias("value")).distinct().join(table, [*session, "value"])
    maps = pairs.groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct("value", "token"))).alias("__map"))
    joined = df.join(maps, row, "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    t = F.col(f"`{text}`")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.element_at(F.col("__map"), s["value"])).alias("out"))

    whole = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    new_text = F.when(F.size("__spans") > 0, whole).otherwise(t)
    columns = [c for c in df.columns if c not in (row, "__spans")]
    return joined.select(*[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in columns]), table


def scrub_string(text: str, known: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """One text on the driver: (scrubbed, dictionary of value to token), going on from ``known``."""
    table, out, at = dict(known or {}), [], 0
    for a, b, label in find_spans(text):
        token = table.setdefault(text[a:b], f"<{label}_{len(table) + 1}>")
        out += [text[at:a], token]
        at = b
    return "".join(out) + text[at:], table


def scrub_messages(messages: list[dict], known: dict[str, str] | None = None) -> tuple[list[dict], dict[str, str]]:
    """A chat request's messages: string content, or text parts of a list."""
    table, out = dict(known or {}), []
    for m in messages:
        content = m.get("content")
        if isinstance(content, str):
            content, table = scrub_string(content, table)
        elif isinstance(content, list):
            parts = []
            for p in content:
                if isinstance(p, dict) and isinstance(p.get("text"), str):
                    text, table = scrub_string(p["text"], table)
                    p = p | {"text": text}
                parts.append(p)
            content = parts
        out.append(m | {"content": content})
    return out, table
