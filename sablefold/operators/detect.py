"""Detection: names on the driver over the schema, value shapes of all columns in one aggregate."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.values import INTEGRAL, as_text, is_leaf, prose_ratio, shape_ratio
from ..patterns import FUZZY_LEAST, INDONESIAN_NAMES, INDONESIAN_SHAPES, ORGANISATION, SHAPE_LEAST, SHAPES


def normalize(name: str) -> str:
    return re.sub(r"[\s_\-]+", "", name.lower())


def _tokens(name: str) -> list[str]:
    return re.findall("[a-z0-9]+", name.lower())


def match_name(name: str, patterns: list[tuple[str, str]], strategy: str = "normalized") -> tuple[str, str] | None:
    """The (pattern, category) that a column name matches, or None."""
    if strategy == "exact":
        return next((p for p in patterns if p[0] == name), None)
    own = normalize(name)
    if hit := next((p for p in patterns if normalize(p[0]) == own), None) if strategy == "normalized" else None:
        return hit
    if strategy != "fuzzy":
        return None
    words = set(_tokens(name))
    if len(_tokens(name)) > 1 and words & set(ORGANISATION):
        return None
    best, score = None, 0.0
    for p in patterns:
        parts = set(_tokens(p[0]))
        got = len(words & parts) / len(parts) if parts else 0.0
        if got > score:
            best, score = p, got
    return best if score >= FUZZY_LEAST else None


def names_frame(names: DataFrame, patterns: list[tuple[str, str]], strategy: str) -> DataFrame:
    """match_name() over a relation of names (column ``name``): name, category, pattern of those that match.

    For catalogues with more columns than a driver loop should see; the pattern table has a few dozen rows.
    """
    spark = names.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(patterns)], "at int, pattern string, category string"))
    norm = lambda c: F.regexp_replace(F.lower(c), r"[\s_\-]+", "")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    names = names.select("name").distinct()
    if strategy == "exact":
        hits = names.join(table, F.col("name") == F.col("pattern")).withColumn("score", F.lit(1.0))
    elif strategy == "normalized":
        hits = names.join(table, norm(F.col("name")) == norm(F.col("pattern"))).withColumn("score", F.lit(1.0))
    else:
        # equi-join on shared words, so that no pair without one is made
        own = names.filter(~((F.size(words(F.col("name"))) > 1) & F.arrays_overlap(words(F.col("name")), F.array(*map(F.lit, ORGANISATION)))))
        own = own.select("name", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
        parts = table.select("at", "pattern", "category", F.size(F.array_distinct(words(F.col("pattern")))).alias("n"), F.explode(F.array_distinct(words(F.col("pattern")))).alias("word"))
        hits = own.join(parts, "word").groupBy("name", "at", "pattern", "category", "n").agg(F.count(F.lit(1)).alias("k")).withColumn("score", F.col("k") / F.col("n")).filter(F.col("score") >= FUZZY_LEAST)
    best = F.max_by(F.struct("pattern", "category"), F.struct("score", (-F.col("at")).alias("rank"))).alias("best")
    return hits.groupBy("name").agg(best).select("name", "best.category", "best.pattern")


def shape_columns(schema: T.StructType) -> list[T.StructField]:
    """Top-level columns whose values are looked at."""
    return [f for f in schema if is_leaf(f.dataType) and not isinstance(f.dataType, T.BooleanType)]


@dataclass(frozen=True)
class Stats:
    """What one pass over a frame found: ratios by column and shape, and prose ratios of string columns."""

    ratios: dict[str, dict[str, float]]
    prose: dict[str, float]

    def shapes(self, column: str) -> list[tuple[str, float]]:
        """Shapes of a column from SHAPE_LEAST on, largest share first, ties in definition order."""
        got = [(s.name, self.ratios.get(column, {}).get(s.name, 0.0)) for s in SHAPES]
        return sorted([x for x in got if x[1] >= SHAPE_LEAST], key=lambda x: -x[1])


def _text(f: T.StructField) -> Column:
    return as_text(F.col(f"`{f.name}`"), f.dataType)


def ratio_columns(schema: T.StructType) -> list[Column]:
    """Aggregates ``i_shape`` for column number i of shape_columns()."""
    out = []
    for i, f in enumerate(shape_columns(schema)):
        text = _text(f)
        for s in SHAPES:
            # a run of digits can't have letters, dots or signs: those shapes are 0 without a look
            if isinstance(f.dataType, INTEGRAL) and s.name in ("email", "iban", "ipv4", "url_credentials", "npwp"):
                out.append(F.lit(0.0).alias(f"{i}_{s.name}"))
            else:
                out.append(shape_ratio(s.name, text).alias(f"{i}_{s.name}"))
    return out


def scan(df: DataFrame, sample_size: int | None = None) -> Stats:
    """Shares of all shapes in all columns: one job, one row back. With ``sample_size`` only that many
    rows are looked at, as they come."""
    fields = shape_columns(df.schema)
    strings = [f for f in fields if isinstance(f.dataType, T.StringType)]
    if not fields:
        return Stats({}, {})
    seen = df.limit(sample_size) if sample_size else df
    prose = [prose_ratio(F.col(f"`{f.name}`")).alias(f"p_{i}") for i, f in enumerate(strings)]
    row = seen.agg(*ratio_columns(df.schema), *prose).first().asDict()
    ratios = {f.name: {s.name: float(row[f"{i}_{s.name}"]) for s in SHAPES} for i, f in enumerate(fields)}
    return Stats(ratios, {f.name: float(row[f"p_{i}"]) for i, f in enumerate(strings)})


def shape_report(df: DataFrame) -> DataFrame:
    """column, shape, ratio (six decimals) of every column and shape from SHAPE_LEAST on, as a DataFrame."""
    fields = shape_columns(df.schema)
    wide = df.agg(*ratio_columns(df.schema))
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(s.name).alias("shape"), F.lit(k).alias("at"), F.col(f"{i}_{s.name}").alias("ratio")) for i, f in enumerate(fields) for k, s in enumerate(SHAPES)])
    return wide.select(F.explode(rows).alias("r")).select("r.column", "r.shape", "r.at", F.round("r.ratio", 6).alias("ratio")).filter(F.col("ratio") >= SHAPE_LEAST)


def confidence(name_hit: bool, ratio: float) -> float:
    return round(0.5 * name_hit + 0.5 * ratio, 3)


def confidence_report(df: DataFrame, config: Config | None = None, stats: Stats | None = None) -> list[dict]:
    """Columns that their name or their values speak for: column, category, pattern, confidence, name_match,
    value_detector, value_ratio; most certain first."""
    config = (config or Config()).resolved()
    stats = stats or scan(df, config.sample_size)
    patterns, by = config.patterns(), {s.name: s for s in SHAPES}
    out = []
    for f in df.schema:
        name = match_name(f.name, patterns, config.match_strategy)
        shape = next(iter(stats.shapes(f.name)), None)
        if name or shape:
            out.append(
                {
                    "column": f.name,
                    "category": name[1] if name else by[shape[0]].category,
                    "pattern": name[0] if name else None,
                    "confidence": confidence(bool(name), shape[1] if shape else 0.0),
                    "name_match": bool(name),
                    "value_detector": shape[0] if shape else None,
                    "value_ratio": shape[1] if shape else 0.0,
                }
            )
    return sorted(out, key=lambda r: -r["confidence"])


def locale_hint(columns: list[str], stats: Stats | None = None) -> str | None:
    """id_ID where a name or a shape is Indonesian."""
    known = {normalize(n) for n in INDONESIAN_NAMES}
    shapes = {s for c in (stats.ratios if stats else {}) for s, _ in stats.shapes(c)}
    return "id_ID" if known & {normalize(c) for c in columns} or shapes & set(INDONESIAN_SHAPES) else None
