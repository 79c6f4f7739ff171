"""Reading and writing tables by extension."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xlsx

FORMATS = {".csv": "csv", ".tsv": "csv", ".xlsx": "excel", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".parquet": "parquet"}


def format_of(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"Unsupported file format: {ext}")
    return FORMATS[ext]


def read(spark: SparkSession, path: str, sheet_names: Iterable[str] | None = None, all_sheets: bool = False, infer_rows: int | None = None) -> DataFrame | dict[str, DataFrame]:
    """A table; a dict of tables for several sheets. Schemas come from whole files (``infer_rows`` is
    accepted for old callers: Spark looks at everything). Files are read lazily and in splits."""
    kind = format_of(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.lower().endswith(".tsv") else ",", multiLine=True, escape='"')
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "ndjson"):
        try:
            df = spark.read.json(path, multiLine=kind == "json", mode="FAILFAST")
            if "_corrupt_record" in df.columns:
                raise ValueError("not a list of records")
            return df
        except (PySparkException, Py4JJavaError, ValueError) as e:  # a failed task may come through as it is
            raise ValueError(f"Failed to read {'JSON' if kind == 'json' else 'NDJSON'} file: {type(e).__name__}") from None
    xlsx.register(spark)
    load = lambda s: spark.read.format("xlsx").options(**({"sheet": s} if s else {})).load(path)
    names = list(xlsx.sheets(path)) if all_sheets else list(sheet_names or ())
    if not names:
        return load(None)
    return load(names[0]) if len(names) == 1 and not all_sheets else {n: load(n) for n in names}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows: path, value."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def write(df: DataFrame, path: str, single: bool = True) -> None:
    """Write by extension. ``single`` makes one file of that name, streamed through the driver (for results
    that people open); otherwise a folder of part files is written by the executors."""
    kind = format_of(path)
    if not single:
        if kind == "excel":
            raise ValueError("a workbook is one file")
        w = df.write.mode("overwrite")
        {"csv": lambda: w.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", escape='"'), "parquet": lambda: w.parquet(path), "json": lambda: w.json(path), "ndjson": lambda: w.json(path)}[kind]()
        return
    if kind == "excel":
        xlsx.write(path, {"Sheet1": (df.columns, (tuple(r) for r in df.toLocalIterator()))})
    elif kind == "parquet":
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(df.schema)
        with pq.ParquetWriter(path, schema) as out:
            for rows in _batches(df):
                import pyarrow as pa

                out.write_table(pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], schema=schema))
    elif kind == "csv":
        import csv

        with open(path, "w", newline="") as f:
            out = csv.writer(f, delimiter="\t" if path.endswith(".tsv") else ",")
            out.writerow(df.columns)
            for rows in _batches(df):
                out.writerows(["" if v is None else v for v in r] for r in rows)
    else:
        lines = (r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator())
        with open(path, "w") as f:
            if kind == "ndjson":
                f.writelines(x + "\n" for x in lines)
            else:
                f.write("[")
                for i, x in enumerate(lines):
                    f.write(("," if i else "") + "\n" + x)
                f.write("\n]\n")


def _batches(df: DataFrame, n: int = 1000):
    rows = []
    for r in df.toLocalIterator():
        rows.append(r)
        if len(rows) == n:
            yield rows
            rows = []
    if rows:
        yield rows


def write_sheets(frames: dict[str, DataFrame], path: str) -> list[str]:
    """Sheets of one workbook, or sibling files ``stem_sheet.ext``."""
    if format_of(path) == "excel":
        xlsx.write(path, {n: (df.columns, (tuple(r) for r in df.toLocalIterator())) for n, df in frames.items()})
        return [path]
    stem, ext = os.path.splitext(path)
    out = []
    for name, df in frames.items():
        out.append(f"{stem}_{name}{ext}")
        write(df, out[-1])
    return out


def dump_json(data: object, path: str) -> None:
    with open(path, "w") as f:
        json.dump(data, f, indent=1, ensure_ascii=False)
