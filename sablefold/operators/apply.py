"""Applying a mapping: lookups by equality join. Spark broadcasts a mapping only under the session's
size threshold, measured on the written table; beyond it the join shuffles and AQE splits hot values."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_text, from_text
from ..plans.paths import json_leaves, json_replace, parse, rebuilt
from ..plans.planner import Target, target_type
from ..work import spare, written
from .collect import leaf_values, looked_up, with_lookup

ROW = "__sablefold_row"


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with a stored row number."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def join_flat(df: DataFrame, column: str, pairs: DataFrame, source: T.DataType, goal: T.DataType) -> DataFrame:
    """Column ``column`` replaced where ``pairs`` (key, value as text) has its value. The mapping's side is
    cast to the column's type for the join; values without a row stay, cast to the goal type if it differs.

    Nulls match nothing and would all be hashed to one task: their part of the join key is the partition that
    they are read in. A frequent value is left to AQE, which splits the frame's side of an outer join."""
    key, value, spread = spare(df, "__key"), spare(df, "__value"), spare(df, "__spread")
    if isinstance(source, (T.FloatType, T.DoubleType)):
        # doubles meet by their one text form
        side = pairs.select(F.col("key").alias(key), F.col("value").alias(value))
        on = as_text(F.col(f"`{column}`"), source) == F.col(key)
    else:
        side = pairs.select(from_text(F.col("key"), source).alias(key), F.col("value").alias(value)).filter(F.col(key).isNotNull())
        on = F.col(f"`{column}`") == F.col(key)
    dealt = df.withColumn(spread, F.when(F.col(f"`{column}`").isNull(), F.spark_partition_id() + 1).otherwise(0).cast("long"))
    # always 0, but no constant that the optimizer would take out of the join key
    side = side.withColumn(f"{spread}_", F.pmod(F.xxhash64(key), F.lit(1)))
    joined = dealt.join(side, on & (F.col(spread) == F.col(f"{spread}_")), "left")
    own = F.col(f"`{column}`")
    same = own if source == goal else from_text(as_text(own, source), goal) if not isinstance(goal, T.StringType) else as_text(own, source)
    new = F.coalesce(from_text(F.col(value), goal), same).alias(column)
    return joined.select(*[new if c == column else F.col(f"`{c}`") for c in df.columns])


def json_rewrite(text: Column, lookup: Column, paths: list[str]) -> Column:
    """Documents with mapped strings at ``paths`` replaced; text that isn't a document stays as it is."""
    wanted = frozenset(paths)

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps in parts:
            out = []
            for s, m in zip(texts, maps, strict=True):
                doc, known = parse(s), dict(m) if m is not None else {}
                if doc is None or not known:
                    out.append(s)
                    continue
                changes = {(p, v): known[v] for p, v in json_leaves(doc) if p in wanted and v in known}
                out.append(json.dumps(json_replace(doc, changes), ensure_ascii=False) if changes else s)
            yield texts.__class__(out, index=texts.index, dtype=object)

    return rewrite(text, lookup)


def text_rewrite(text: Column, lookup: Column, find_names: Callable[[str], list[tuple[int, int]]]) -> Column:
    """Prose with its name spans replaced, left to right."""

    @F.pandas_udf("string")
    def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, maps in parts:
            out = []
            for s, m in zip(texts, maps, strict=True):
                known, at, new = dict(m) if m is not None else {}, 0, []
                for a, b in sorted(find_names(s)) if s and known else ():
                    if a >= at:
                        new += [s[at:a], known.get(s[a:b], s[a:b])]
                        at = b
                out.append("".join(new) + s[at:] if s else s)
            yield texts.__class__(out, index=texts.index, dtype=object)

    return rewrite(text, lookup)


def apply(df: DataFrame, targets: list[Target], mapping: DataFrame, scope: str = "", find_names: Callable | None = None, redacting: bool = False) -> DataFrame:
    """``df`` with every target replaced by ``mapping``; columns keep their order. Nulls, empty strings and
    values without a row stay. ``redacting`` turns processed leaves into strings."""
    own = mapping.filter(F.col("scope") == scope)
    pairs = lambda t: own.filter(F.col("path") == t.path).select(F.col("original").alias("key"), F.col("replacement").alias("value"))
    goal = lambda kind: T.StringType() if redacting else kind
    columns, schema = df.columns, df.schema
    deep: dict[str, list[Target]] = {}
    for t in targets:
        if t.kind != "flat":
            deep.setdefault(t.column, []).append(t)
    if deep:
        df = keyed(df)
    for column, group in deep.items():
        kind, changes = group[0].kind, []
        for i, t in enumerate(group if kind == "nested" else group[:1]):
            name = f"__map_{i}"
            paths = [t] if kind == "nested" else group
            values = F.flatten(F.array(*[leaf_values(df, p, find_names) for p in paths]))
            rows = pairs(t) if kind != "json" else own.filter(F.col("path").isin([p.path for p in group])).select(F.col("original").alias("key"), F.col("replacement").alias("value")).dropDuplicates(["key"])
            df = with_lookup(df, ROW, values, rows, "key", "value", name)
            changes.append(name)
        if kind == "nested":
            by_path = {t.path: n for t, n in zip(group, changes, strict=True)}

            def change(value: Column, leaf: T.DataType, path: str, by_path: dict = by_path) -> Column:
                text = as_text(value, leaf)
                new = from_text(looked_up(by_path[path], text), goal(leaf))
                return F.coalesce(new, value if goal(leaf) == leaf else text)

            new = rebuilt(column, schema[column].dataType, list(by_path), change)
        elif kind == "json":
            new = json_rewrite(F.col(f"`{column}`"), F.col("__map_0"), [t.json_path for t in group])
        else:
            new = text_rewrite(F.col(f"`{column}`"), F.col("__map_0"), find_names)
        df = df.select(ROW, *[new.alias(c) if c == column else F.col(f"`{c}`") for c in columns])
    df = df.select(*[F.col(f"`{c}`") for c in columns])
    for t in [t for t in targets if t.kind == "flat"]:
        kind = target_type(df, t)
        df = join_flat(df, t.column, pairs(t), kind, goal(kind))
    return df
