"""Paths into nested schemas: ``a.b``, ``a[*].b``, and ``column:json.path`` for JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bare(path: str) -> str:
    return path.replace("[*]", "")


def last_name(path: str) -> str:
    return bare(path).rpartition(":")[2].rpartition(".")[2]


def leaves(schema: T.StructType) -> Iterator[tuple[str, T.DataType]]:
    """Every leaf below a nested column, as (path, type). Lists of lists repeat the mark."""

    def walk(path: str, kind: T.DataType) -> Iterator[tuple[str, T.DataType]]:
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from walk(f"{path}.{f.name}", f.dataType)
        elif isinstance(kind, T.ArrayType):
            yield from walk(f"{path}[*]", kind.elementType)
        else:
            yield path, kind

    for f in schema:
        if isinstance(f.dataType, (T.StructType, T.ArrayType)):
            yield from walk(f.name, f.dataType)


def resolve(schema: T.StructType, dotted: str) -> str | None:
    """The full path of a dotted path written with or without ``[*]``."""
    wanted = bare(dotted)
    return next((p for p, _ in leaves(schema) if bare(p) == wanted), None)


def kind_at(schema: T.StructType, path: str) -> T.DataType:
    return next(k for p, k in leaves(schema) if p == path)


def _steps(path: str) -> list[str]:
    return [s for part in path.split(".") for s in ([part.split("[")[0]] + ["*"] * part.count("[*]"))]


def values_at(path: str) -> Column:
    """All values at a path of one row, as a flat array."""

    def collect(value: Column, steps: list[str]) -> Column:
        if not steps:
            return F.array(value)
        if steps[0] == "*":
            inner = F.transform(value, lambda x: collect(x, steps[1:]))
            return F.coalesce(F.flatten(F.filter(inner, lambda x: x.isNotNull())), F.array())
        return collect(value[steps[0]], steps[1:])

    first, *rest = _steps(path)
    return collect(F.col(f"`{first}`"), rest)


def replace_at(value: Column, kind: T.DataType, path_steps: list[list[str]], change: Callable[[Column, T.DataType, list[str]], Column], here: list[str]) -> Column:
    """``value`` rebuilt with ``change`` applied at every path; one expression for all paths of a column."""
    if not path_steps:
        return value
    if any(not s for s in path_steps):
        return change(value, kind, here)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: replace_at(x, kind.elementType, [s[1:] for s in path_steps], change, [*here, "*"]))
    fields = []
    for f in kind:
        below = [s[1:] for s in path_steps if s[0] == f.name]
        fields.append(replace_at(value[f.name], f.dataType, below, change, [*here, f.name]).alias(f.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def rebuilt(column: str, kind: T.DataType, paths: list[str], change: Callable[[Column, T.DataType, str], Column]) -> Column:
    """Column ``column`` with ``change(value, type, path)`` at each of ``paths``."""
    by_steps = {tuple(_steps(p)): p for p in paths}
    return replace_at(F.col(f"`{column}`"), kind, [list(s[1:]) for s in by_steps], lambda v, k, here: change(v, k, by_steps[(column, *here)]), [])


# --- JSON text -------------------------------------------------------------------------------------


def json_leaves(doc: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, value) of every string in a parsed document."""
    if isinstance(doc, dict):
        for k, v in doc.items():
            yield from json_leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(doc, list):
        for v in doc:
            yield from json_leaves(v, f"{path}[*]")
    elif isinstance(doc, str):
        yield path, doc


def parse(text: str | None) -> object | None:
    """A document of an object or a list; None for anything else."""
    try:
        doc = json.loads(text) if text else None
    except ValueError:
        return None
    return doc if isinstance(doc, (dict, list)) else None


def json_replace(doc: object, mapping: dict[tuple[str, str], str], path: str = "") -> object:
    """The document with strings replaced by (path, value)."""
    if isinstance(doc, dict):
        return {k: json_replace(v, mapping, f"{path}.{k}" if path else k) for k, v in doc.items()}
    if isinstance(doc, list):
        return [json_replace(v, mapping, f"{path}[*]") for v in doc]
    return mapping.get((path, doc), doc) if isinstance(doc, str) else doc


def json_prune(doc: object, keep: Callable[[str], bool], path: str = "") -> object:
    """The document's allowed leaves; objects and lists stay where something of them does."""
    if isinstance(doc, dict):
        got = {k: json_prune(v, keep, f"{path}.{k}" if path else k) for k, v in doc.items()}
        return {k: v for k, v in got.items() if v is not None} or None
    if isinstance(doc, list):
        got = [x for x in (json_prune(v, keep, f"{path}[*]") for v in doc) if x is not None]
        return got or None
    return doc if keep(path) else None
