"""Planning: which leaves of a frame a run processes. Pure functions of schema, statistics and config."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.values import is_leaf, prose_ratio
from ..operators.detect import Stats, confidence, match_name, scan
from ..patterns import BY_NAME
from .paths import bare, json_leaves, kind_at, last_name, leaves, parse, resolve

#: Least share of values with four words or more in a column of prose.
PROSE_LEAST = 0.3


@dataclass(frozen=True)
class Target:
    """One leaf to process. ``kind`` is flat, nested, json or text."""

    kind: str
    column: str
    path: str
    category: str
    dtype: str
    pattern: str | None = None
    confidence: float = 1.0
    name_match: bool = True
    value_detector: str | None = None
    value_ratio: float = 0.0

    @property
    def field(self) -> str:
        return last_name(self.path)

    @property
    def json_path(self) -> str | None:
        return self.path.partition(":")[2] if self.kind == "json" else None


@dataclass
class Plan:
    targets: list[Target] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def plan(df: DataFrame, config: Config | None = None, selected: Iterable[str] | None = None, stats: Stats | None = None, find_names: Callable[[str], list] | None = None) -> Plan:
    """Targets of ``df``.

    ``selected`` limits them to columns or paths (with or without ``[*]``, ``column:path`` in JSON text);
    an empty selection selects nothing. A selected top column takes all that is below it. Columns of a
    type that cannot be processed are skipped with a reason and stay skipped. Jobs, all over whole columns:
    one aggregate for value shapes, one for the leaves of each JSON column, one for all prose ratios, and a
    search for a name in each column of prose.
    """
    config = (config or Config()).resolved()
    chosen = None if selected is None else {bare(s) for s in selected}
    patterns = config.patterns()
    out = Plan()
    json_columns = set(config.json_columns) | {s.split(":")[0] for s in (chosen or ()) if ":" in s}
    if stats is None:
        stats = scan(df, config.sample_size) if config.value_detection and chosen != set() else Stats({}, {})

    def wanted(path: str) -> bool:
        own = bare(path)
        return chosen is None or own in chosen or own.split(".")[0].split(":")[0] in chosen

    # flat columns
    for f in df.schema:
        if f.name in json_columns or isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            continue
        name = match_name(f.name, patterns, config.match_strategy)
        shape = next(iter(stats.shapes(f.name)), None)
        forced = chosen is not None and f.name in chosen
        if not (name or shape or forced) or not wanted(f.name):
            continue
        if not is_leaf(f.dataType):
            out.skipped.append((f.name, f"type {f.dataType.simpleString()} cannot be processed"))
            continue
        if isinstance(f.dataType, T.BooleanType) and config.mode == "fake":
            out.skipped.append((f.name, "a boolean has no other fake value than the original's opposite"))
            continue
        category = name[1] if name else BY_NAME[shape[0]].category if shape else "custom"
        ratio = shape[1] if shape else 0.0
        out.targets.append(Target("flat", f.name, f.name, category, f.dataType.simpleString(), name[0] if name else None, 1.0 if name else confidence(False, ratio), bool(name), shape[0] if shape else None, ratio))
    # nested leaves; a matching struct stands for the strings below it
    explicit = {p: c for c in config.extra_pii_columns if "." in c and (p := resolve(df.schema, c))}
    for path, kind in leaves(df.schema):
        top = path.split(".")[0].split("[")[0]
        parts = [top if i == 0 else p for i, p in enumerate(bare(path).split("."))]
        name = match_name(parts[-1], patterns, config.match_strategy)
        if config.strict_paths:
            name = None
        elif not name and isinstance(kind, T.StringType):
            name = next((m for p in parts[:-1] if (m := match_name(p, patterns, "exact" if config.match_strategy == "exact" else "normalized"))), None)
        forced = path in explicit or (chosen is not None and (bare(path) in chosen or top in chosen) and isinstance(kind, T.StringType) and not any(match_name(last_name(p), patterns, config.match_strategy) for p, _ in leaves(df.schema) if p.split(".")[0].split("[")[0] == top)) or (chosen is not None and bare(path) in chosen)
        if not (name or forced) or not (wanted(path) or path in explicit and chosen is None):
            continue
        if not is_leaf(kind) or (isinstance(kind, T.BooleanType) and config.mode == "fake"):
            out.skipped.append((path, f"type {kind.simpleString()} cannot be processed"))
            continue
        out.targets.append(Target("nested", top, path, name[1] if name else "custom", kind.simpleString(), name[0] if name else None))
    # JSON text
    for column in [f.name for f in df.schema if f.name in json_columns and isinstance(f.dataType, T.StringType)]:
        asked = {s.partition(":")[2] for s in (chosen or ()) if s.startswith(f"{column}:")}
        if chosen is not None and not asked and column not in chosen:
            continue
        named = lambda path: match_name(last_name(path), patterns, config.match_strategy)
        for path in json_paths(df, column, lambda path, asked=asked, named=named: bare(path) in asked if asked else named(path) is not None):
            name = named(path)
            out.targets.append(Target("json", column, f"{column}:{path}", name[1] if name else "custom", "string", name[0] if name else None))
    # names in prose
    if config.ner and find_names:
        taken = {t.column for t in out.targets}
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in taken and f.name not in json_columns and wanted(f.name)]
        ratios = df.agg(*[prose_ratio(F.col(f"`{c}`")) for c in texts]).first() if texts else ()
        for column, ratio in zip(texts, ratios, strict=True):
            if ratio >= PROSE_LEAST and has_names(df, column, find_names):
                out.targets.append(Target("text", column, column, "name", "string", None, 0.5, False, "ner"))
    out.warnings += [f"{path}: {why}; left unchanged" for path, why in out.skipped]
    return out


def json_paths(df: DataFrame, column: str, wanted: Callable[[str], bool]) -> list[str]:
    """Paths of the strings in all documents of a column that are ``wanted``, in order. A task sends each
    path once; paths that aren't wanted stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            before = len(known)
            for doc in map(parse, batch.column(0).to_pylist()):
                for path in {p for p, _ in json_leaves(doc)} if doc is not None else ():
                    if path not in known:
                        known[path] = wanted(path)
            yield pa.RecordBatch.from_arrays([pa.array([p for p in list(known)[before:] if known[p]], pa.string())], names=["path"])

    found = df.select(F.col(f"`{column}`").alias("doc")).filter("doc is not null").mapInArrow(run, "path string")
    return [r[0] for r in found.distinct().orderBy("path").collect()]


def has_names(df: DataFrame, column: str, find_names: Callable[[str], list]) -> bool:
    """Whether any value of a column holds a name; a task ends with its first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(find_names(x) for x in batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([True])], names=["found"])
                return

    return df.select(F.col(f"`{column}`").alias("text")).filter("text <> ''").mapInArrow(run, "found boolean").limit(1).count() > 0


def target_type(df: DataFrame, t: Target) -> T.DataType:
    if t.kind == "nested":
        return kind_at(df.schema, t.path)
    return T.StringType() if t.kind in ("json", "text") else df.schema[t.column].dataType


def detection_frame(df: DataFrame, config: Config | None = None, find_names: Callable | None = None) -> DataFrame:
    """The plan as a DataFrame, with distinct values of each target: dry run and report."""
    from ..operators.collect import originals

    found = plan(df, config, find_names=find_names)
    spark = df.sparkSession
    rows = [(i, t.path, t.column, t.kind, t.category, float(t.confidence), t.name_match, t.value_detector, float(t.value_ratio)) for i, t in enumerate(found.targets)]
    table = spark.createDataFrame(rows, "target int, path string, column string, kind string, category string, confidence double, name_match boolean, value_detector string, value_ratio double")
    counts = originals(df, found.targets, find_names).groupBy("target").agg(F.count(F.lit(1)).alias("unique_count"))
    return table.join(counts, "target", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0))).drop("target")
