"""Read-only queries over protected copies: describe, page, search, aggregate, under an allowlist."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.values import FRACTIONAL, INTEGRAL, as_text
from ..plans.paths import bare, json_prune, parse
from ..plans.planner import plan
from ..work import written
from . import mapping as M
from .apply import apply
from .restore import restore_string

MAX_ROWS, MAX_CELL, MAX_TEXT = 100, 500, 1_000_000
OPERATIONS = ("count", "n_unique", "sum", "mean", "min", "max")
log = logging.getLogger(__name__)


class GatewayError(ValueError):
    """A request that the gateway refuses; its message is for the caller."""


@dataclass(frozen=True)
class Policy:
    """Leaves that callers may see: kept ones, processed ones, and others only if ``keep_unmatched``."""

    keep: tuple[str, ...] = ()
    keep_unmatched: bool = False
    blocked: tuple[str, ...] = ()

    def allows(self, path: str, processed: set[str]) -> bool:
        own = bare(path)
        prefixes = [own] + [own[:i] for i, c in enumerate(own) if c in ".:"]
        kept = {bare(k) for k in self.keep}
        if any(p in kept for p in prefixes) or own in processed:
            return True
        return self.keep_unmatched and not any(p in {bare(b) for b in self.blocked} for p in prefixes)


def _pruned(value: Column, kind: T.DataType, path: str, policy: Policy, processed: set[str]) -> Column | None:
    """``value`` with only its allowed leaves; None where nothing is left. Lists of lists are never shown."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, _pruned(value[f.name], f.dataType, f"{path}.{f.name}", policy, processed)) for f in kind]
        left = [p.alias(n) for n, p in parts if p is not None]
        return F.when(value.isNotNull(), F.struct(*left)) if left else None
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.MapType)):
            return None
        probe = F.lit(None).cast(kind.elementType)
        if _pruned(probe, kind.elementType, path, policy, processed) is None:
            return None
        return F.transform(value, lambda x: _pruned(x, kind.elementType, path, policy, processed))
    if isinstance(kind, T.MapType):
        return None
    return value if policy.allows(path, processed) else None


def _json_pruned(column: str, policy: Policy, processed: set[str]) -> Column:
    @F.pandas_udf("string")
    def prune(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for s in part:
                doc = parse(s)
                got = json_prune(doc, lambda p: policy.allows(f"{column}:{p}", processed)) if doc is not None else None
                out.append(None if got is None else json.dumps(got, ensure_ascii=False, separators=(",", ":")))
            yield part.__class__(out, index=part.index, dtype=object)

    return prune(F.col(f"`{column}`"))


def project(df: DataFrame, policy: Policy, processed: set[str], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """The allowed part of a frame. Unparseable JSON becomes null. Nothing left is an error."""
    columns = []
    for f in df.schema:
        if f.name in json_columns and isinstance(f.dataType, T.StringType) and not policy.allows(f.name, set()):
            columns.append(_json_pruned(f.name, policy, processed).alias(f.name))
        elif (part := _pruned(F.col(f"`{f.name}`"), f.dataType, f.name, policy, processed)) is not None:
            columns.append(part.alias(f.name))
    if not columns:
        raise GatewayError("the policy leaves no column")
    out = df.select(*columns)
    pruned = [f.name for f in out.schema if f.name in json_columns]
    if pruned:
        seen = out.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in pruned]).first()
        out = out.drop(*[c for c in pruned if not seen[c]])
    return out


def cell(value: Column, kind: T.DataType, longest: int = MAX_CELL) -> Column:
    """What callers see of a value: long strings cut, dates and decimals as text, nested ones alike."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[cell(value[f.name], f.dataType, longest).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: cell(x, kind.elementType, longest))
    if isinstance(kind, T.StringType):
        return F.when(F.length(value) > longest, F.concat(F.left(value, F.lit(longest)), F.lit("…"))).otherwise(value)
    return value if isinstance(kind, (T.BooleanType, *INTEGRAL, *FRACTIONAL)) else value.cast("string")


def describe(df: DataFrame) -> DataFrame:
    """column, type, nulls, distinct (null counts as a value; null for nested columns): one aggregate."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema):
        c, nested = F.col(f"`{f.name}`"), isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        aggs.append((F.lit(None).cast("long") if nested else F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0))).alias(f"d{i}"))
        rows.append(F.struct(F.lit(i).alias("at"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("nulls"), F.col(f"d{i}").alias("distinct")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def search(df: DataFrame, column: str, text: str, mode: str = "contains", case_sensitive: bool = False) -> DataFrame:
    """Rows whose value, as text, contains or equals ``text`` literally."""
    value, wanted = as_text(F.col(f"`{column}`"), df.schema[column].dataType), F.lit(text)
    if not case_sensitive:
        value, wanted = F.lower(value), F.lower(wanted)
    if mode not in ("contains", "equals"):
        raise GatewayError("mode is contains or equals")
    return df.filter(F.contains(value, wanted) if mode == "contains" else value == wanted)


def aggregate(df: DataFrame, group_by: list[str], aggregations: list[tuple[str, str | None]] | None = None) -> DataFrame:
    """Groups (null is one, sorted first) with count, n_unique (null counts), sum (0 without values), mean,
    min and max, named ``op_column``; ``count`` by default."""
    out, names = [], []
    for op, column in aggregations or [("count", None)]:
        name = "count" if op == "count" else f"{op}_{column}"
        if op not in OPERATIONS:
            raise GatewayError(f"unknown operation {op}")
        if name in names or name in group_by:
            raise GatewayError(f"two columns would be called {name}")
        names.append(name)
        if op == "count":
            out.append(F.count(F.lit(1)).alias(name))
            continue
        kind, c = df.schema[column].dataType, F.col(f"`{column}`")
        if op in ("sum", "mean") and not isinstance(kind, (*INTEGRAL, *FRACTIONAL, T.DecimalType, T.BooleanType)):
            raise GatewayError(f"{op} needs a number")
        c = c.cast("long") if isinstance(kind, T.BooleanType) and op in ("sum", "mean") else c
        made = {"n_unique": lambda c=c: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0)), "sum": lambda c=c: F.coalesce(F.sum(c), F.lit(0)), "mean": lambda c=c: F.avg(c), "min": lambda c=c: F.min(c), "max": lambda c=c: F.max(c)}
        out.append(made[op]().alias(name))
    keys = [F.col(f"`{g}`") for g in group_by]
    return df.groupBy(*keys).agg(*out).orderBy(*[k.asc_nulls_first() for k in keys])


@dataclass
class Gateway:
    """Datasets that were protected once, written, and are then only read."""

    config: Config = field(default_factory=lambda: Config(mode="redact"))
    max_rows: int = MAX_ROWS
    restore_dir: str | None = None
    datasets: dict[str, tuple[DataFrame, set[str]]] = field(default_factory=dict)
    mapping: DataFrame | None = None

    def __post_init__(self) -> None:
        config = self.config.resolved()
        if config.mode in ("shift", "perturb") or (config.mode == "redact" and config.redact_style == "partial"):
            raise GatewayError(f"{config.mode} leaves parts of originals visible and cannot be served")

    def add(self, name: str, df: DataFrame, policy: Policy | None = None) -> None:
        """Protect a dataset and keep its allowed part, rows in the order in which ``df`` gives them."""
        config, policy = self.config.resolved(), policy or Policy()
        # numbered before anything is joined, since joins change the order
        rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "gateway-rows")
        own = plan(df, config)
        mapping = M.build({name: (rows, own.targets)}, config, self.mapping)
        done = apply(rows, own.targets, mapping, name, redacting=config.mode == "redact")
        blocked = tuple(dict.fromkeys([*policy.blocked, *[p for p, _ in own.skipped]]))
        policy = Policy((*policy.keep, "__row"), policy.keep_unmatched, blocked)
        processed = {bare(t.path) for t in own.targets}
        shown = project(done, policy, processed, config.json_columns)
        if shown.columns == ["__row"]:
            raise GatewayError("the policy leaves no column")
        self.datasets[name] = (written(shown, "gateway"), processed)
        self.mapping = mapping if self.mapping is None else M.extend(self.mapping, mapping)

    def _frame(self, name: str) -> DataFrame:
        if name not in self.datasets:
            raise GatewayError("unknown dataset")
        return self.datasets[name][0]

    def _need(self, df: DataFrame, columns: list[str], flat: bool = False) -> None:
        for c in columns:
            if c not in df.columns or c == "__row":
                raise GatewayError("unknown column")
            if flat and isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)):
                raise GatewayError("a nested column cannot be compared or grouped")

    def _page(self, df: DataFrame, columns: list[str] | None, offset: int, limit: int) -> dict:
        if offset < 0:
            raise GatewayError("offset is 0 or more")
        shown = [c for c in (columns or df.columns) if c != "__row"]
        self._need(df, shown)
        limit, total = max(1, min(limit, self.max_rows)), df.count()
        page = df.orderBy("__row").offset(offset).limit(limit).select(*[cell(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in shown])
        rows = [r.asDict(recursive=True) for r in page.collect()]  # max_rows at most
        return {"rows": rows, "total": total, "offset": offset, "has_more": offset + len(rows) < total}

    def _safe(self, call: Callable[[], object]) -> object:
        try:
            return call()
        except (GatewayError, M.MappingError):
            raise
        except PySparkException as e:  # Spark's messages may quote data
            log.error("gateway query failed: %s", type(e).__name__)
            raise GatewayError("the query failed") from None

    def list_datasets(self) -> list[dict]:
        return [{"name": n, "rows": df.count(), "columns": [c for c in df.columns if c != "__row"]} for n, (df, _) in sorted(self.datasets.items())]

    def describe(self, name: str) -> dict:
        df, processed = self._frame(name), self.datasets[name][1]

        def run() -> dict:
            rows = [r.asDict() for r in describe(df.drop("__row")).orderBy("at").collect()]
            for r in rows:
                r["faked"] = any(p == r["column"] or p.startswith((f"{r['column']}.", f"{r['column']}:")) for p in processed)
            return {"columns": rows, "sample": self._page(df, None, 0, 5)["rows"]}

        return self._safe(run)

    def read_rows(self, name: str, columns: list[str] | None = None, offset: int = 0, limit: int = MAX_ROWS) -> dict:
        return self._safe(lambda: self._page(self._frame(name), columns, offset, limit))

    def search_rows(self, name: str, column: str, text: str, mode: str = "contains", case_sensitive: bool = False, offset: int = 0, limit: int = MAX_ROWS) -> dict:
        df = self._frame(name)
        self._need(df, [column], flat=True)
        return self._safe(lambda: self._page(search(df, column, text, mode, case_sensitive), None, offset, limit))

    def aggregate(self, name: str, group_by: list[str], aggregations: list[tuple[str, str | None]] | None = None, limit: int = MAX_ROWS) -> list[dict]:
        df = self._frame(name)
        self._need(df, group_by + [c for _, c in aggregations or [] if c], flat=True)
        return self._safe(lambda: [r.asDict() for r in aggregate(df, group_by, aggregations).limit(max(1, min(limit, self.max_rows))).collect()])

    def restore_to_file(self, text: str, name: str) -> dict:
        """Originals go to a private file, never to the caller."""
        if not self.restore_dir or self.mapping is None:
            raise GatewayError("restoring is not enabled")
        if len(text) > MAX_TEXT:
            raise GatewayError("the text is too long")
        if os.path.basename(name) != name or name.startswith("."):
            raise GatewayError("a plain file name is needed")
        words = set(text.split()) | {text}
        pairs = {r.replacement: r.original for r in M.reverse(self.mapping).filter(F.contains(F.lit(text), F.col("replacement")) & (F.col("replacement") != "")).collect()} if words else {}
        done, spans, _ = restore_string(text, pairs)
        try:
            fd = os.open(os.path.join(self.restore_dir, name), os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        except FileExistsError:
            raise GatewayError("the file exists") from None
        with os.fdopen(fd, "w") as f:
            f.write(done)
        return {"name": name, "restored": len(spans)}
