"""Mapping tables on disk: parquet (the engine's own, any size), JSON and SQLite for exchange, encrypted or not."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import closing
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators.mapping import COLUMNS, SCHEMA, check_saveable
from ..work import stored, streamed
from . import crypto
from .documents import Reader

VERSION = "2.0"
TOOL = "sablefold"
#: What an entry of the exchange document says of its pairs.
HEAD = ("scope", "column", "category", "kind", "path", "original_dtype", "processed_dtype")


def _tagged(value: str, kind: str) -> dict:
    tag = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}.get(kind, "str")
    make = {"bool": lambda v: v == "true", "int": int, "float": float}.get(tag, str)
    return {"t": tag, "v": make(value)}


def _plain(value: dict) -> str:
    v = value["v"]
    return str(v).lower() if isinstance(v, bool) else str(v)


def _write_json(mapping: DataFrame, config: Config, path: str) -> None:
    """The exchange document. Its rows come sorted, and the driver holds some thousand at once."""
    text = json.JSONEncoder(ensure_ascii=False).encode
    head = {
        "version": VERSION,
        "tool": TOOL,
        "session_id": uuid.uuid4().hex,
        "created_at": datetime.now(timezone.utc).isoformat(),
        "config": {"mode": config.mode, "redact_style": config.redact_style, "match_strategy": config.match_strategy, "seed": config.seed},
        "mappings": [],
    }
    entry = None
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text(head).removesuffix("]}"))
        for *about, orig_type, original, repl_type, replacement in streamed(mapping.select(*COLUMNS).orderBy("scope", "path", "original"), "exchange"):
            e = dict(zip(COLUMNS, about))
            if (e["scope"], e["path"]) != entry:
                f.write(("" if entry is None else "]}, ") + text({k: e[k] for k in HEAD} | {"pairs": []}).removesuffix("]}"))
                entry = e["scope"], e["path"]
            else:
                f.write(", ")
            f.write(text([_tagged(original, orig_type), _tagged(replacement, repl_type)]))
        f.write("]}" if entry is None else "]}]}")


def _read_json(path: str) -> Iterator[tuple]:
    """Rows of COLUMNS, one pair after another; see from_document()."""
    version, found = "1", False
    with Reader(path) as doc:
        for key in doc.items():
            if key == "version":
                version = str(doc.value())
            elif key != "mappings":
                doc.value()
            elif doc.peek() == "[":
                found = True
                for _ in doc.elements():
                    yield from _read_entry(doc)
            else:
                found = True
                yield from from_document({"version": version, "mappings": doc.value()})
        doc.end()
    if not found and not version.startswith("1"):
        raise KeyError("mappings")


def _read_entry(doc: Reader) -> Iterator[tuple]:
    e, held = {}, []
    for key in doc.items():
        if key != "pairs" or doc.peek() != "[":
            e[key] = doc.value()
        elif e.keys() >= set(HEAD):
            for _ in doc.elements():
                yield from _pair(e, doc.value())
        else:  # what the pairs belong to comes after them
            held = [doc.value() for _ in doc.elements()]
    for pair in held:
        yield from _pair(e, pair)


def _pair(e: dict, pair: object) -> Iterator[tuple]:
    try:
        a, b = _plain(pair[0]), _plain(pair[1])
    except (KeyError, IndexError, TypeError):
        return
    yield (e["scope"], e["column"], e["kind"], e["path"], e["category"], e["original_dtype"], e["processed_dtype"], e["original_dtype"], a, e["processed_dtype"], b)


def from_document(doc: dict) -> list[tuple]:
    """Rows of COLUMNS. Documents of version 1 hold plain strings by column; pairs that don't decode are left out."""
    rows = []
    if str(doc.get("version", "1")).startswith("1"):
        for column, e in doc.get("mappings", {}).items():
            pairs = e.get("mapping", e) if isinstance(e, dict) else {}
            category = e.get("category", "custom") if isinstance(e, dict) else "custom"
            rows += [("", column, "flat", column, category, "string", "string", "string", str(a), "string", str(b)) for a, b in pairs.items() if not isinstance(b, (dict, list))]
        return rows
    for e in doc["mappings"]:
        for pair in e["pairs"]:
            rows += _pair(e, pair)
    return rows


def _private(path: str, raw: bytes | Iterable[bytes]) -> None:
    fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
    os.fchmod(fd, 0o600)
    with os.fdopen(fd, "wb") as f:
        f.writelines([raw] if isinstance(raw, bytes) else raw)


def save(mapping: DataFrame, path: str, config: Config, encrypt: bool = False, passphrase: str | None = None) -> None:
    """Write by extension: ``.parquet`` (a folder), ``.db``/``.sqlite``, else JSON; files are private (0600).
    Ambiguous mappings of lossless modes are refused."""
    check_saveable(mapping, config.resolved().lossless)
    ext = os.path.splitext(path)[1]
    if ext == ".parquet":
        mapping.select(*COLUMNS).write.mode("overwrite").parquet(path)
        return
    with tempfile.TemporaryDirectory() as local:
        made = f"{local}/plain"
        (_write_sqlite if ext in (".db", ".sqlite") else _write_json)(mapping, config, made)
        if encrypt:
            crypto.seal_file(mapping.sparkSession, made, f"{local}/sealed", passphrase)
            made = f"{local}/sealed"
        with open(made, "rb") as f:
            _private(path, iter(lambda: f.read(1 << 20), b""))


def _write_sqlite(mapping: DataFrame, config: Config, path: str) -> None:
    """Rows come in the order of the primary key, and the driver holds some thousand at once."""
    with closing(sqlite3.connect(path)) as db:
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        db.execute("CREATE TABLE metadata (key TEXT PRIMARY KEY, value TEXT)")
        names = ["column_name" if c == "column" else c for c in COLUMNS]
        db.execute(f"CREATE TABLE mappings ({', '.join(n + ' TEXT' for n in names)}, PRIMARY KEY (scope, path, original))")
        meta = {"version": VERSION, "tool": TOOL, "session_id": uuid.uuid4().hex, "created_at": datetime.now(timezone.utc).isoformat(), "mode": config.mode, "redact_style": config.redact_style}
        db.executemany("INSERT INTO metadata VALUES (?, ?)", meta.items())
        rows = streamed(mapping.select(*COLUMNS).orderBy("scope", "path", "original"), "exchange")
        db.executemany(f"INSERT OR REPLACE INTO mappings VALUES ({', '.join('?' * len(names))})", rows)
        db.commit()


def _is_sqlite(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(16) == b"SQLite format 3\0"


def _opened(path: str) -> closing:
    return closing(sqlite3.connect(f"{Path(path).resolve().as_uri()}?mode=ro&immutable=1", uri=True))


def _read_sqlite(path: str) -> Iterator[tuple]:
    with _opened(path) as db:
        have = [r[1] for r in db.execute("PRAGMA table_info(mappings)")]
        if "scope" not in have:
            for c, a, b in db.execute("SELECT column_name, original, replacement FROM mappings"):
                yield ("", c, "flat", c, "custom", "string", "string", "string", a, "string", b)
        else:
            yield from db.execute(f"SELECT {', '.join('column_name' if c == 'column' else c for c in COLUMNS)} FROM mappings")


def load(spark: SparkSession, path: str, passphrase: str | None = None) -> DataFrame:
    """A mapping of any kind save() writes, or of the older JSON version; encryption is recognised. Files go
    through the driver some thousand rows at once, into a table of the work folder."""
    if os.path.isdir(path) or path.endswith(".parquet"):
        return spark.read.schema(SCHEMA).parquet(path)
    with tempfile.TemporaryDirectory() as local:
        if not _is_sqlite(path) and crypto.is_envelope(path):
            crypto.unseal_file(spark, path, f"{local}/plain", passphrase)
            path = f"{local}/plain"
        rows = (_read_sqlite if _is_sqlite(path) else _read_json)(path)
        return stored(spark, rows, pa.schema([(c, pa.string()) for c in COLUMNS]), "loaded")


def created_at(path: str) -> float | None:
    """When a mapping file was made; None for files that aren't mappings."""
    try:
        if _is_sqlite(path):
            with _opened(path) as db:
                made = dict(db.execute("SELECT key, value FROM metadata")).get("created_at")
        else:
            with Reader(path) as doc:
                if doc.peek() != "{":
                    return None
                top = {}
                for key in doc.items():
                    top[key] = doc.value() if key in ("enc", "created_at") else doc.skip(3)
                doc.end()
            if top.get("enc") == "aes-gcm":
                return os.path.getmtime(path)
            if "mappings" not in top:
                return None
            made = top.get("created_at")
    except (ValueError, sqlite3.Error):
        return None
    return datetime.fromisoformat(made).timestamp() if made else os.path.getmtime(path)


def expire(folder: str, days: float, now: float | None = None) -> list[str]:
    """Delete mapping files of a folder that are older; other files are never touched."""
    gone = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path) and (made := created_at(path)) is not None and made < (now or time.time()) - days * 86400:
            os.unlink(path)
            gone.append(name)
    return gone
