"""Leak check of processed output, and the audit of a run. Neither ever holds a value."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.values import as_text
from ..patterns import BY_NAME, SHAPE_LEAST
from ..plans.paths import bare, json_leaves, leaves, parse, values_at
from ..plans.planner import Plan, Target
from . import mapping as M
from .detect import ratio_columns


@dataclass(frozen=True)
class Finding:
    kind: str
    path: str
    detail: str
    count: int


@dataclass
class LeakReport:
    findings: list[Finding] = field(default_factory=list)

    @property
    def clean(self) -> bool:
        return not self.findings

    def summary(self) -> str:
        return "no leaks found" if self.clean else "; ".join(f"{f.path}: {f.detail}" for f in self.findings)


def leaf_frame(df: DataFrame, json_columns: tuple[str, ...] = (), numbers: bool = False) -> DataFrame:
    """(path, value) of every string leaf of ``df``; of JSON columns' strings too, and of numbers and dates
    if asked. One scan: a row's leaves are one array."""
    parts = []
    for f in df.schema:
        if isinstance(f.dataType, T.StringType) or (numbers and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.BooleanType))):
            parts.append(F.array(F.struct(F.lit(f.name).alias("path"), as_text(F.col(f"`{f.name}`"), f.dataType).alias("value"))))
    for path, kind in leaves(df.schema):
        if isinstance(kind, T.StringType):
            parts.append(F.transform(values_at(path), lambda v, p=path: F.struct(F.lit(bare(p)).alias("path"), v.alias("value"))))
    for c in json_columns:
        if c in df.columns:
            parts.append(_json_leaves(c))
    if not parts:
        return df.sparkSession.createDataFrame([], "path string, value string")
    return df.select(F.explode(F.flatten(F.array(*parts))).alias("l")).select("l.path", "l.value").filter(F.col("value").isNotNull())


def _json_leaves(column: str):
    @F.pandas_udf("array<struct<path:string,value:string>>")
    def collect(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda s: [{"path": f"{column}:{bare(p)}", "value": v} for p, v in json_leaves(d)] if (d := parse(s)) is not None else [])

    return collect(F.col(f"`{column}`"))


def surviving(output: DataFrame, originals: DataFrame, json_columns: tuple[str, ...] = (), numbers: bool = False) -> DataFrame:
    """(path, leaked): how many distinct originals (column ``original``) stand as whole values in each leaf."""
    found = leaf_frame(output, json_columns, numbers).distinct().join(originals.select(F.col("original").alias("value")).distinct(), "value", "left_semi")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("leaked"))


def check(output: DataFrame, targets: list[Target], mapping: DataFrame, scope: str = "", json_columns: tuple[str, ...] = (), numbers: bool = False) -> LeakReport:
    """Originals of the scope that survive anywhere, and value shapes in leaves that were not processed."""
    report = LeakReport()
    originals = M.entries(mapping, scope)
    kept = originals.filter(F.col("original") != F.col("replacement"))
    for r in surviving(output, kept, json_columns, numbers).orderBy("path").collect():  # a row a leaf
        report.findings.append(Finding("original", r.path, f"{r.leaked} original values survive", r.leaked))
    done = {bare(t.path) for t in targets} | {t.column for t in targets}
    fields = [f for f in output.schema if isinstance(f.dataType, T.StringType) and f.name not in done]
    if fields:
        rest = output.select(*[F.col(f"`{f.name}`") for f in fields])
        row = rest.agg(*ratio_columns(rest.schema)).first().asDict()
        for i, f in enumerate(fields):
            for name, shape in BY_NAME.items():
                ratio = float(row[f"{i}_{name}"])
                if ratio >= SHAPE_LEAST:
                    report.findings.append(Finding("shape", f.name, f"{name} shape at {ratio:.0%} of values ({shape.description})", 0))
    return report


def target_counts(mapping: DataFrame) -> DataFrame:
    """scope, path, category, unique_count of each processed leaf."""
    return mapping.groupBy("scope", "path", "category").agg(F.count(F.lit(1)).alias("unique_count"))


def audit(plans: dict[str, Plan], mapping: DataFrame, config: Config, reports: dict[str, LeakReport], warnings: list[str], started: datetime) -> dict:
    counts = {(r.scope, r.path): r.unique_count for r in target_counts(mapping).collect()}
    rows = [
        {"scope": scope, "path": t.path, "kind": t.kind, "category": t.category, "confidence": t.confidence, "signal": "name" if t.name_match else t.value_detector, "unique_count": counts.get((scope, t.path), 0)}
        for scope, p in plans.items()
        for t in p.targets
    ]
    return {
        "run_id": uuid.uuid4().hex,
        "started": started.isoformat(),
        "finished": datetime.now(timezone.utc).isoformat(),
        "config": {"mode": config.mode, "redact_style": config.redact_style, "match_strategy": config.match_strategy},
        "targets": rows,
        "warnings": list(dict.fromkeys(warnings)),
        "leaks": {scope: r.summary() for scope, r in reports.items()},
        "clean": all(r.clean for r in reports.values()),
    }


def audit_text(report: dict) -> str:
    lines = [f"run {report['run_id']}", f"started {report['started']}, finished {report['finished']}", f"mode {report['config']['mode']}"]
    lines += [f"{r['scope'] or '-'} {r['path']}: {r['category']}, {r['signal']}, {r['unique_count']} values" for r in report["targets"]]
    lines += [f"warning: {w}" for w in report["warnings"]] + [f"leak check {s or '-'}: {x}" for s, x in report["leaks"].items()]
    return "\n".join(lines) + "\n"


def write_audit(report: dict, stem: str) -> tuple[str, str]:
    paths = f"{stem}_audit.json", f"{stem}_audit.txt"
    with open(paths[0], "w") as f:
        json.dump(report, f, indent=1)
    with open(paths[1], "w") as f:
        f.write(audit_text(report))
    return paths
