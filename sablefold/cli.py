"""Command line: process, detect, restore, columns, presets, project, cleanup."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from . import config as C
from .functions.names import gazetteer
from .operators import leak
from .operators.mapping import extend, merge, reverse
from .operators.process import process_frames, restore_frames
from .operators.restore import restore, restore_string
from .patterns import NAMES, PRESETS
from .plans.planner import detection_frame
from .sources import mappings, tables
from .work import written


def _spark() -> SparkSession:
    return SparkSession.builder.appName("sablefold").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sablefold")
    sub = p.add_subparsers(dest="command", required=True)

    def run(name: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--mode", choices=C.MODES, default="fake")
        s.add_argument("--redact-style", choices=C.STYLES, default="typed-token")
        s.add_argument("--match-strategy", choices=C.STRATEGIES, default="normalized")
        s.add_argument("--seed", type=int, default=0)
        s.add_argument("--extra-pii-columns", nargs="*", default=[])
        s.add_argument("--override-defaults", action="store_true")
        s.add_argument("--json-columns", nargs="*", default=[])
        s.add_argument("--strict-paths", action="store_true")
        s.add_argument("--locale")
        s.add_argument("--preset", choices=sorted(PRESETS))
        s.add_argument("--sheets", nargs="*")
        s.add_argument("--all-sheets", action="store_true")
        s.add_argument("--infer-schema-length", type=int)
        s.add_argument("--shift-days", type=int)
        s.add_argument("--perturb-pct", type=float)
        s.add_argument("--ner", action="store_true")
        return s

    s = run("process")
    s.add_argument("--output", required=True)
    s.add_argument("--mapping-out")
    s.add_argument("--encrypt", action="store_true")
    s.add_argument("--passphrase")
    s.add_argument("--audit-out")
    s.add_argument("--dry-run", action="store_true")
    s.add_argument("--project-mapping")
    s.add_argument("--columns", nargs="*")
    run("detect")
    s = sub.add_parser("restore")
    s.add_argument("input")
    s.add_argument("--mapping", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--scope", default="")
    s.add_argument("--sheets", nargs="*")
    s.add_argument("--all-sheets", action="store_true")
    s.add_argument("--passphrase")
    s.add_argument("--text", action="store_true")
    s.add_argument("--tolerant", action="store_true")
    s.add_argument("--word-boundary", action="store_true")
    s = sub.add_parser("columns")
    s.add_argument("action", choices=("add", "list", "remove"))
    s.add_argument("names", nargs="*")
    s = sub.add_parser("presets")
    s.add_argument("action", choices=("list", "show"))
    s.add_argument("name", nargs="?")
    s = sub.add_parser("project")
    s.add_argument("action", choices=("init", "add", "status"))
    s.add_argument("path")
    s.add_argument("--from", dest="source")
    s.add_argument("--passphrase")
    s = sub.add_parser("cleanup")
    s.add_argument("folder")
    s.add_argument("--older-than")
    return p


def _config(a: argparse.Namespace) -> C.Config:
    made = C.Config(a.mode, a.redact_style, a.match_strategy, a.seed, a.locale, a.preset, tuple(a.extra_pii_columns), a.override_defaults, tuple(a.json_columns), a.strict_paths, a.shift_days, a.perturb_pct, a.ner)
    return C.with_user_columns(made).resolved()


def _frames(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    got = tables.read(spark, a.input, a.sheets, a.all_sheets)
    return got if isinstance(got, dict) else {"default": got}


def _process(a: argparse.Namespace) -> int:
    spark, config = _spark(), _config(a)
    frames = _frames(spark, a)
    if a.dry_run:
        return _report(frames, config)
    known = mappings.load(spark, a.project_mapping, a.passphrase) if a.project_mapping and os.path.exists(a.project_mapping) else None
    run = process_frames(frames, config, a.columns, known, gazetteer() if config.ner else None, verify=True)
    for w in run.warnings:
        print(f"warning: {w}", file=sys.stderr)
    if len(frames) == 1:
        tables.write(next(iter(run.frames.values())), a.output)
    else:
        tables.write_sheets(run.frames, a.output)
    if a.mapping_out:
        mappings.save(run.mapping, a.mapping_out, config, a.encrypt, a.passphrase)
    if a.project_mapping:
        # the old file may be what the plan still reads
        merged = run.mapping if known is None else written(extend(known, run.mapping), "merged")
        mappings.save(merged, a.project_mapping, config, a.encrypt, a.passphrase)
    if a.audit_out:
        leak.write_audit(run.audit, a.audit_out)
    for scope, report in run.reports.items():
        print(f"{scope}: {report.summary()}")
    return 0 if all(r.clean for r in run.reports.values()) else 2


def _report(frames: dict[str, DataFrame], config: C.Config) -> int:
    for name, df in frames.items():
        for r in detection_frame(df, config, gazetteer() if config.ner else None).toLocalIterator():
            print(f"{name}\t{r.path}\t{r.category}\t{r.confidence}\t{r.value_detector or '-'}\t{r.unique_count} values")
    return 0


def _restore(a: argparse.Namespace) -> int:
    spark = _spark()
    mapping = mappings.load(spark, a.mapping, a.passphrase)
    if a.text:
        with open(a.input) as f:
            text = f.read()
        pairs = {r.replacement: r.original for r in reverse(mapping).toLocalIterator()}
        done, _, left = restore_string(text, pairs, a.word_boundary, a.tolerant)
        with open(a.output, "w") as f:
            f.write(done)
        if left:
            print("ambiguous: " + ", ".join(left), file=sys.stderr)
        return 0
    frames = _frames(spark, a)
    if len(frames) == 1:
        tables.write(restore(next(iter(frames.values())), mapping, a.scope), a.output)
    else:
        tables.write_sheets(restore_frames(frames, mapping), a.output)
    return 0


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "process":
        return _process(a)
    if a.command == "detect":
        return _report(_frames(_spark(), a), replace(_config(a)))
    if a.command == "restore":
        return _restore(a)
    if a.command == "columns":
        now = C.user_columns()
        if a.action != "list":
            C.set_user_columns([*now, *a.names] if a.action == "add" else [c for c in now if c not in a.names])
        print("\n".join(C.user_columns()))
    elif a.command == "presets":
        for name in [a.name] if a.action == "show" else sorted(PRESETS):
            if name not in PRESETS:
                raise SystemExit(f"unknown preset {name}")
            locale, patterns = PRESETS[name]
            print(f"{name}: {locale}, {len(patterns)} patterns" + ("\n" + "\n".join(f"{p}: {c}" for p, c in patterns) if a.action == "show" else ""))
        if a.action == "list":
            print(f"built in: {len(NAMES)} patterns")
    elif a.command == "project":
        if a.action == "init":
            mappings._private(a.path, b'{"version": "2.0", "mappings": []}')
        elif a.action == "add":
            if not a.source:
                raise SystemExit("project add needs --from, a mapping file")
            spark = _spark()
            added = mappings.load(spark, a.source, a.passphrase)
            now = merge(mappings.load(spark, a.path, a.passphrase), added) if os.path.exists(a.path) else added
            mappings.save(written(now, "merged"), a.path, C.Config())
        else:
            made = mappings.created_at(a.path)
            print("no project" if made is None else f"{mappings.load(_spark(), a.path).count()} values")
    elif a.command == "cleanup":
        days = C.parse_age(a.older_than) if a.older_than else C.retention_days()
        if days is None:
            raise SystemExit("no age given and none configured")
        print("\n".join(mappings.expire(a.folder, days)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
