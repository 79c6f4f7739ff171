"""Originals: the distinct values of all targets, computed once, and per-row lookups for nested leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import as_text
from ..plans.paths import json_leaves, parse, values_at
from ..plans.planner import Target, target_type

ORIGINALS = "target int, original string"


def json_values(column: Column, paths: list[str]) -> Column:
    """(path, value) of the strings at ``paths`` of each document, as an array of structs."""
    wanted = frozenset(paths)

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def collect(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: [{"path": p, "value": v} for p, v in json_leaves(d) if p in wanted] if (d := parse(s)) is not None else [])

    return collect(column)


def span_texts(column: Column, find_names: Callable[[str], list[tuple[int, int]]]) -> Column:
    """Texts of the name spans of each value, as an array."""

    @F.pandas_udf("array<string>")
    def collect(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: list(dict.fromkeys(s[a:b] for a, b in find_names(s))) if s else [])

    return collect(column)


def leaf_values(df: DataFrame, t: Target, find_names: Callable | None) -> Column:
    """Text forms of a target's values in one row, as an array."""
    if t.kind == "flat":
        return F.array(as_text(F.col(f"`{t.column}`"), df.schema[t.column].dataType))
    if t.kind == "nested":
        kind = target_type(df, t)
        return F.transform(values_at(t.path), lambda x: as_text(x, kind))
    if t.kind == "json":
        return F.transform(json_values(F.col(f"`{t.column}`"), [t.json_path]), lambda x: x["value"])
    return span_texts(F.col(f"`{t.column}`"), find_names)


def originals(df: DataFrame, targets: list[Target], find_names: Callable | None = None) -> DataFrame:
    """(target, original): distinct values of every target by its number, null and empty ones left out.

    One scan for all targets; values are reduced before the shuffle.
    """
    if not targets:
        return df.sparkSession.createDataFrame([], ORIGINALS)
    flat = [i for i, t in enumerate(targets) if t.kind == "flat"]
    rest = [i for i, t in enumerate(targets) if t.kind != "flat"]
    parts = []
    if flat:
        pairs = F.array(*[F.struct(F.lit(i).alias("target"), leaf_values(df, targets[i], None)[0].alias("original")) for i in flat])
        parts.append(df.select(F.explode(pairs).alias("p")).select("p.target", "p.original"))
    for i in rest:
        parts.append(df.select(F.lit(i).alias("target"), F.explode(leaf_values(df, targets[i], find_names)).alias("original")))
    every = reduce(DataFrame.unionByName, parts)
    return every.filter(F.col("original").isNotNull() & (F.col("original") != "")).distinct()


def with_lookup(df: DataFrame, row_id: str, values: Column, mapping: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with a map ``name`` from each of the row's own ``values`` to its replacement.

    ``mapping`` (key, value) joins the exploded values by equality, whatever its size; a row's map holds
    no more than its own values. ``row_id`` must be stored in ``df``, not computed by it.
    """
    pairs = df.select(row_id, F.explode(F.array_distinct(values)).alias(key)).filter(F.col(key).isNotNull())
    found = pairs.join(mapping.select(key, value), key).groupBy(row_id).agg(F.map_from_entries(F.collect_set(F.struct(key, value))).alias(name))
    return df.join(found, row_id, "left")


def looked_up(lookup: str, text: Column) -> Column:
    return F.when(F.col(lookup).isNotNull() & text.isNotNull(), F.try_element_at(F.col(lookup), text))


def arrow_rows(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def string_type(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)
