"""Restoring originals: columns, nested leaves, JSON text, and prose that quotes replacements."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_text, from_text
from ..patterns import TOKEN
from ..plans.paths import json_leaves, json_replace, kind_at, parse, rebuilt, values_at
from ..work import written
from . import mapping as M
from .apply import ROW, join_flat, keyed
from .collect import json_values, looked_up, with_lookup
from .mapping import _type

#: Replacements whose matcher is sent to the executors at once; more make further passes.
BLOCK = 50_000
#: Replacements up to which every text is tried against all of them where matches begin and end with words.
DIRECT = 1_000
#: Words of a replacement that are sought together; a longer one is found by its first ones.
RUN = 16


def restore(df: DataFrame, mapping: DataFrame, scope: str = "") -> DataFrame:
    """``df`` with the replacements of the scope's mapping turned back and original types restored.

    The scope falls back to "" and then to the only scope there is. JSON strings are restored at their
    planned paths. A replacement that stands for several originals (full and partial redaction) stays
    as it is: restoring one of them at will would be wrong.
    """
    own = M.entries(mapping, scope)
    heads = own.select("column", "kind", "path", "original_dtype", "processed_dtype").distinct().collect()  # one row a target
    clear = own.groupBy("path", "replacement").agg(F.min("original").alias("original"), F.count_distinct("original").alias("n")).filter("n = 1")
    pairs = lambda path: clear.filter(F.col("path") == path).select(F.col("replacement").alias("key"), F.col("original").alias("value"))
    columns, present = df.columns, set(df.columns)
    deep: dict[str, list] = {}
    for h in heads:
        if h.kind != "flat" and h.column in present:
            deep.setdefault(h.column, []).append(h)
    if deep:
        schema = df.schema
        df = keyed(df)
        for column, group in sorted(deep.items()):
            if group[0].kind == "nested":
                names = {}
                for i, h in enumerate(group):
                    kind = kind_at(schema, h.path)
                    df = with_lookup(df, ROW, F.transform(values_at(h.path), lambda x, k=kind: as_text(x, k)), pairs(h.path), "key", "value", f"__map_{i}")
                    names[h.path] = (f"__map_{i}", _type(h.original_dtype))

                def change(value: Column, leaf: T.DataType, path: str, names: dict = names) -> Column:
                    name, kind = names[path]
                    text = as_text(value, leaf)
                    return F.coalesce(from_text(looked_up(name, text), kind), value if leaf == kind else from_text(text, kind))

                new = rebuilt(column, schema[column].dataType, list(names), change)
            elif group[0].kind == "json":
                paths = [h.path.partition(":")[2] for h in group]
                rows = clear.filter(F.col("path").isin([h.path for h in group])).select(F.concat_ws("\u0000", F.substring_index("path", ":", -1), "replacement").alias("key"), F.col("original").alias("value"))
                values = F.transform(json_values(F.col(f"`{column}`"), paths), lambda x: F.concat_ws("\u0000", x["path"], x["value"]))
                df = with_lookup(df, ROW, values, rows, "key", "value", "__map_0")
                new = _json_restore(F.col(f"`{column}`"), F.col("__map_0"))
            else:
                df = df.select(ROW, *[F.col(f"`{c}`") for c in columns])
                found = restore_text(df, column, own.filter(F.col("path") == group[0].path))
                df = found.drop("spans").withColumn(column, F.col("restored")).drop("restored")
                new = F.col(f"`{column}`")
            df = df.select(ROW, *[new.alias(c) if c == column else F.col(f"`{c}`") for c in columns])
        df = df.drop(ROW)
    for h in heads:
        if h.kind == "flat" and h.column in present:
            df = join_flat(df, h.column, pairs(h.path), df.schema[h.column].dataType, _type(h.original_dtype))
    return df.select(*[F.col(f"`{c}`") for c in columns])


def _json_restore(text: Column, lookup: Column) -> Column:
    @F.pandas_udf("string")
    def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps in parts:
            out = []
            for s, m in zip(texts, maps, strict=True):
                doc, known = parse(s), dict(m) if m is not None else {}
                changes = {(p, v): known[k] for p, v in json_leaves(doc) if (k := f"{p}\0{v}") in known} if doc is not None and known else {}
                out.append(json.dumps(json_replace(doc, changes), ensure_ascii=False) if changes else s)
            yield texts.__class__(out, index=texts.index, dtype=object)

    return rewrite(text, lookup)


def restore_values(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Values of one column turned back by a reverse lookup over all entries; unknown ones pass."""
    rows = M.reverse(mapping).select(F.col("replacement").alias("key"), F.col("original").alias("value"))
    kind = df.schema[column].dataType
    return join_flat(df, column, rows, kind, kind)


# --- prose -----------------------------------------------------------------------------------------


def restore_tokens(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Typed tokens in prose turned back by built-in functions only: gaps and tokens are split apart, tokens
    looked up through the row's own map, and all joined again. Unknown tokens stay."""
    columns = df.columns
    df = keyed(df)
    text = F.col(f"`{column}`")
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    rows = M.reverse(mapping.filter(F.col("replacement").rlike(f"^{TOKEN}$"))).select(F.col("replacement").alias("key"), F.col("original").alias("value"))
    df = with_lookup(df, ROW, tokens, rows, "key", "value", "__map")
    gaps = F.split(text, TOKEN, -1)
    new = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.col("__map"), t), t))
    whole = F.array_join(F.zip_with(gaps, new, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    return df.select(*[F.when(F.col("__map").isNull(), text).otherwise(whole).alias(column) if c == column else F.col(f"`{c}`") for c in columns])


def _matcher(keys: list[str], boundary: bool, tolerant: bool) -> re.Pattern:
    """One alternation, longest first."""
    body = "|".join(re.escape(k) for k in sorted(keys, key=lambda k: (-len(k), k)))
    body = f"(?:{body})" + ("(?:['’]s)?" if tolerant else "")
    return re.compile(rf"(?<!\w){body}(?!\w)" if boundary or tolerant else body, re.IGNORECASE if tolerant else 0)


def restore_string(text: str, pairs: dict[str, str], boundary: bool = False, tolerant: bool = False) -> tuple[str, list[tuple[int, int, str]], list[str]]:
    """One text restored: (text, spans (start, end, original) in the new text, ambiguous fragments left alone).

    One pass, longest match first, so restored text is never looked at again. Tolerant matching ignores
    case, lets a possessive ``'s`` go along, and takes a first or last part of a two-part replacement if
    it belongs to one replacement only.
    """
    known, unclear = dict(pairs), set()
    if tolerant:
        known, unclear = _fragments(pairs)
    if not known and not unclear:
        return text, [], []
    found = [(m.start(), m.end(), m[0]) for m in _matcher([*known, *unclear], boundary, tolerant).finditer(text)]
    return _replace(text, found, known, unclear, tolerant)


def _fragments(pairs: dict[str, str]) -> tuple[dict[str, str], set[str]]:
    known = {k.lower(): v for k, v in pairs.items()}
    parts: dict[str, set[str]] = {}
    for fake, original in pairs.items():
        for x, y in _parts(fake, original):
            parts.setdefault(x, set()).add(y)
    unclear = {p for p, o in parts.items() if len(o) > 1 and p not in known}
    for p, o in parts.items():
        if len(o) == 1:
            known.setdefault(p, next(iter(o)))
    return known, unclear


def _parts(fake: str, original: str) -> list[tuple[str, str]]:
    """First and last part of a replacement of several parts, with what each stands for."""
    a, b = fake.split(), original.split()
    if len(a) < 2:
        return []
    ends = (a[0], b[0] if len(b) > 1 else original), (a[-1], b[-1] if len(b) > 1 else original)
    return [(x.lower(), y) for x, y in ends if len(x) >= 2 and x.isalpha()]


def _replace(text: str, found: list[tuple[int, int, str]], known: dict[str, str], unclear: set[str], tolerant: bool) -> tuple[str, list, list]:
    out, spans, left, at, size = [], [], [], 0, 0
    for a, b, hit in found:
        if a < at:
            continue
        key, tail = (hit.lower(), "") if tolerant else (hit, "")
        if tolerant and key not in known and key not in unclear and key[-2:] in ("'s", "’s"):
            key, tail = key[:-2], hit[-2:]
        if key in unclear:
            left.append(key)
            continue
        if key not in known:
            continue
        original = known[key]
        out += [text[at:a], original, tail]
        size += a - at
        spans.append((size, size + len(original), original))
        size += len(original) + len(tail)
        at = b
    return "".join(out) + text[at:], spans, list(dict.fromkeys(left))


def restore_text(df: DataFrame, column: str, mapping: DataFrame, boundary: bool = False, tolerant: bool = False) -> DataFrame:
    """``df`` with ``restored`` and ``spans`` of a prose column; see restore_string().

    Where matches begin and end with words (``boundary``, ``tolerant``), a join finds the replacements of each
    text. Otherwise the matcher goes to the executors in blocks of at most BLOCK replacements; each block's
    pass marks its matches, and the last step takes the longest ones of all passes.
    """
    rows = M.reverse(mapping).filter(F.col("replacement") != "")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    kind = "struct<restored:string,spans:array<struct<start:int,end:int,original:string>>,ambiguous:array<string>>"
    if (boundary or tolerant) and n > DIRECT:
        return _restore_words(df, column, rows, kind, boundary, tolerant)
    if blocks == 1:
        pairs = {r[0]: r[1] for r in rows.collect()}

        @F.pandas_udf(kind)
        def whole(part: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in part:
                got = [restore_string(t, pairs, boundary, tolerant) if t else (t, [], []) for t in texts]
                yield pd.DataFrame({"restored": [g[0] for g in got], "spans": [[{"start": a, "end": b, "original": o} for a, b, o in g[1]] for g in got], "ambiguous": [g[2] for g in got]})

        done = df.withColumn("__r", whole(F.col(f"`{column}`")))
        out = done.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__r.restored").alias("restored"), F.col("__r.spans").alias("spans"))
        return out
    marks = []
    for at in range(blocks):
        pairs = {r[0]: r[1] for r in rows.filter(F.pmod(F.xxhash64("replacement"), F.lit(blocks)) == at).collect()}
        marks.append(_marks(F.col(f"`{column}`"), pairs, boundary))

    @F.pandas_udf(kind)
    def joined(part: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in part:
            got = []
            for t, spans in zip(texts, found, strict=True):
                order = sorted(((s["start"], -s["end"], s["original"]) for s in spans)) if t else []
                known = {t[a:-b]: o for a, b, o in order}
                got.append(_replace(t, [(a, -b, t[a:-b]) for a, b, _ in order], known, set(), False) if t else (t, [], []))
            yield pd.DataFrame({"restored": [g[0] for g in got], "spans": [[{"start": a, "end": b, "original": o} for a, b, o in g[1]] for g in got], "ambiguous": [[] for _ in got]})

    done = df.withColumn("__found", F.flatten(F.array(*marks))).withColumn("__r", joined(F.col(f"`{column}`"), F.col("__found")))
    return done.select(*[F.col(f"`{c}`") for c in df.columns], F.col("__r.restored").alias("restored"), F.col("__r.spans").alias("spans"))


def _words(text: str, tolerant: bool) -> list[str]:
    """Runs of word characters, in one case if tolerant. A match holds whole runs: no word character may be
    next to it."""
    return re.findall(r"\w+", text.lower().replace("ς", "σ") if tolerant else text)


def _restore_words(df: DataFrame, column: str, rows: DataFrame, kind: str, boundary: bool, tolerant: bool) -> DataFrame:
    """restore_text() for matches of whole words and any number of replacements: a replacement joins the texts
    that have its words in sequence, by their hash, and a text is matched against its own replacements only."""

    @F.pandas_udf("array<struct<key:string,value:string,whole:boolean>>")
    def spelt(fakes: pd.Series, originals: pd.Series) -> pd.Series:
        def keys(fake: str, original: str) -> list[dict]:
            if not tolerant:
                return [{"key": fake, "value": original, "whole": True}]
            parts = [{"key": x, "value": y, "whole": False} for x, y in _parts(fake, original)]
            return [{"key": fake.lower(), "value": original, "whole": True}, *parts]

        return pd.Series([keys(a, b) for a, b in zip(fakes, originals, strict=True)], dtype=object)

    @F.pandas_udf("struct<n:int,gram:string>")
    def head(part: pd.Series) -> pd.DataFrame:
        words = [_words(k, tolerant)[:RUN] for k in part]
        return pd.DataFrame({"n": [len(w) for w in words], "gram": [" ".join(w) or k[0] for w, k in zip(words, part, strict=True)]})

    each = rows.select(F.explode(spelt("replacement", "original")).alias("k")).select("k.*")
    own, part = F.when(F.col("whole"), F.col("value")), F.when(~F.col("whole"), F.col("value"))
    keys = each.groupBy("key").agg(F.max(own).alias("own"), F.min(part).alias("least"), F.max(part).alias("most"))
    # a part that stands for several has no value
    keys = keys.select("key", F.coalesce("own", F.when(F.col("least") == F.col("most"), F.col("least"))).alias("value"), head("key").alias("h"))
    keys = written(keys.select("key", "value", "h.n", F.xxhash64("h.gram").alias("gram")), "replacements")
    sizes = sorted(r[0] for r in keys.select("n").distinct().collect())  # RUN + 1 at most

    @F.pandas_udf("array<string>")
    def grams(part: pd.Series) -> pd.Series:
        def of(text: str | None) -> list[str]:
            if not text:
                return []
            words = _words(text, tolerant)
            found = {" ".join(words[i : i + n]) for n in sizes if n for i in range(len(words) - n + 1)}
            return list(found | set(re.findall(r"\W", text)) if 0 in sizes else found)

        return pd.Series([of(t) for t in part], dtype=object)

    @F.pandas_udf(kind)
    def matched(part: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in part:
            got = []
            for t, keys in zip(texts, found, strict=True):
                if not t or keys is None:
                    got.append((t, [], []))
                    continue
                known = {k["key"]: k["value"] for k in keys if k["value"] is not None}
                unclear = {k["key"] for k in keys if k["value"] is None}
                hits = [(m.start(), m.end(), m[0]) for m in _matcher([*known, *unclear], boundary, tolerant).finditer(t)]
                got.append(_replace(t, hits, known, unclear, tolerant))
            yield pd.DataFrame({"restored": [g[0] for g in got], "spans": [[{"start": a, "end": b, "original": o} for a, b, o in g[1]] for g in got], "ambiguous": [g[2] for g in got]})

    columns = df.columns
    df = keyed(df)
    hashes = F.array_distinct(F.transform(grams(F.col(f"`{column}`")), lambda g: F.xxhash64(g)))
    pairs = df.select(ROW, F.explode(hashes).alias("gram")).join(keys.select("gram", "key", "value"), "gram")
    found = pairs.groupBy(ROW).agg(F.collect_list(F.struct("key", "value")).alias("__found"))
    done = df.join(found, ROW, "left").withColumn("__r", matched(F.col(f"`{column}`"), F.col("__found")))
    return done.select(*[F.col(f"`{c}`") for c in columns], F.col("__r.restored").alias("restored"), F.col("__r.spans").alias("spans"))


def _marks(text: Column, pairs: dict[str, str], boundary: bool) -> Column:
    """Every match of one block, overlapping ones of other blocks included."""

    @F.pandas_udf("array<struct<start:int,end:int,original:string>>")
    def find(part: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = _matcher(list(pairs), boundary, False) if pairs else None
        for texts in part:
            yield texts.map(lambda t: _all(pattern, t, pairs) if t and pattern else [])

    return find(text)


def _all(pattern: re.Pattern, text: str, pairs: dict[str, str]) -> list[dict]:
    out, at = [], 0
    while m := pattern.search(text, at):
        out.append({"start": m.start(), "end": m.end(), "original": pairs[m[0]]})
        at = m.start() + 1
    return out


def restore_messages(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Tokens in the ``content`` of an array of messages turned back (built-in functions only)."""
    columns, kind = df.columns, df.schema[column].dataType.elementType
    df = keyed(df)
    tokens = F.flatten(F.transform(F.col(column), lambda m: F.coalesce(F.regexp_extract_all(m["content"], F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>"))))
    rows = M.reverse(mapping.filter(F.col("replacement").rlike(f"^{TOKEN}$"))).select(F.col("replacement").alias("key"), F.col("original").alias("value"))
    df = with_lookup(df, ROW, tokens, rows, "key", "value", "__map")

    def back(text: Column) -> Column:
        parts = F.zip_with(F.split(text, TOKEN, -1), F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), lambda g, t: F.concat(g, F.coalesce(F.try_element_at(F.col("__map"), t), t, F.lit(""))))
        return F.array_join(parts, "")

    new = F.transform(F.col(column), lambda m: F.struct(*[F.when(F.col("__map").isNull(), m[f.name]).otherwise(back(m[f.name])).alias(f.name) if f.name == "content" else m[f.name].alias(f.name) for f in kind]))
    return df.select(*[new.alias(c) if c == column else F.col(f"`{c}`") for c in columns])
