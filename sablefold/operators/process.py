"""Whole runs: plan, map, apply, check. One run may hold several frames (sheets) under one mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ..config import Config
from ..plans.planner import Plan, plan
from . import leak
from . import mapping as M
from .apply import apply
from .restore import restore


@dataclass
class Run:
    frames: dict[str, DataFrame]
    mapping: DataFrame
    plans: dict[str, Plan]
    warnings: list[str] = field(default_factory=list)
    reports: dict[str, leak.LeakReport] = field(default_factory=dict)
    audit: dict | None = None


def process_frames(frames: dict[str, DataFrame], config: Config | None = None, selected: dict[str, Iterable[str]] | Iterable[str] | None = None, known: DataFrame | None = None, find_names: Callable | None = None, verify: bool = False) -> Run:
    """Protect several frames. The scope of a single frame named "default" is ""."""
    config, started = (config or Config()).resolved(), datetime.now(timezone.utc)
    scope = lambda name: "" if name == "default" and len(frames) == 1 else name
    chosen = lambda name: selected.get(name) if isinstance(selected, dict) else selected
    plans = {name: plan(df, config, chosen(name), find_names=find_names) for name, df in frames.items()}
    mapping = M.build({scope(n): (df, plans[n].targets) for n, df in frames.items()}, config, known, find_names)
    out = {n: apply(df, plans[n].targets, mapping, scope(n), find_names, config.mode == "redact") for n, df in frames.items()}
    run = Run(out, mapping, plans, [w for p in plans.values() for w in p.warnings])
    if config.mode in ("shift", "perturb"):
        same = mapping.filter("original = replacement").select("path").distinct().collect()
        run.warnings += [f"{r.path}: some values are no {'dates' if config.mode == 'shift' else 'numbers'} and stay as they are" for r in same]
    if verify:
        run.reports = {n: leak.check(df, plans[n].targets, mapping, scope(n), config.json_columns) for n, df in out.items()}
        run.audit = leak.audit({scope(n): p for n, p in plans.items()}, mapping, config, {scope(n): r for n, r in run.reports.items()}, run.warnings, started)
    run.warnings = list(dict.fromkeys(run.warnings))
    return run


def process(df: DataFrame, config: Config | None = None, selected: Iterable[str] | None = None, known: DataFrame | None = None, find_names: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(protected frame, mapping)."""
    run = process_frames({"default": df}, config, selected, known, find_names)
    return run.frames["default"], run.mapping


def restore_frames(frames: dict[str, DataFrame], mapping: DataFrame) -> dict[str, DataFrame]:
    return {name: restore(df, mapping, name) for name, df in frames.items()}
