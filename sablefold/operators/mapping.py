"""Mapping tables: one row for each (scope, target, original), built from distinct values by set logic.

No counters or retries: uniqueness of fakes is an anti-join against originals and used replacements
plus a join on ranks; token numbers are ranks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import synth
from ..functions.values import perturb, redact_full, redact_partial, shift_native, shift_text, as_text, from_text, token_label
from ..plans.planner import Target, target_type
from ..work import ranked, written
from .collect import originals

COLUMNS = ("scope", "column", "kind", "path", "category", "original_dtype", "processed_dtype", "orig_type", "original", "repl_type", "replacement")
SCHEMA = ", ".join(f"`{c}` string" for c in COLUMNS)


#: Candidate fakes of a block; a task makes one block or several.
CANDIDATES = 10_000


class MappingError(ValueError):
    """A mapping that cannot be saved or used as asked. Messages hold no values."""


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def processed_type(kind: T.DataType, config: Config) -> T.DataType:
    return T.StringType() if config.mode == "redact" else kind


def build(frames: dict[str, tuple[DataFrame, list[Target]]], config: Config, known: DataFrame | None = None, find_names: Callable | None = None) -> DataFrame:
    """The mapping of several frames (by scope) with their targets, as a written table.

    Same original and category give the same fake in any column and scope; in token styles a value has
    one token for each target path, the same in every scope. ``known`` rows are reused first: they are
    part of the result only where a value occurs.
    """
    config = config.resolved()
    spark = next(iter(frames.values()))[0].sparkSession
    parts, meta, at = [], [], 0
    for scope, (df, targets) in frames.items():
        if targets:
            parts.append(originals(df, targets, find_names).select((F.col("target") + at).alias("target"), "original"))
        for t in targets:
            kind = target_type(df, t)
            meta.append((at, scope, t.column, t.kind, t.path, t.category, t.field, kind.simpleString(), processed_type(kind, config).simpleString()))
            at += 1
    if not meta:
        return written(empty(spark), "mapping")
    values = written(reduce(DataFrame.unionByName, parts), "originals")
    table = spark.createDataFrame(meta, "target int, scope string, column string, kind string, path string, category string, field string, original_dtype string, processed_dtype string")
    if config.mode == "redact":
        found = _redacted(values, meta, config, known)
    elif config.mode == "fake":
        found = _faked(values, meta, config, known)
    else:
        found = _changed(values, meta, config)
    out = found.join(F.broadcast(table), "target")  # a row a target
    out = out.select("scope", "column", "kind", "path", "category", "original_dtype", "processed_dtype", F.col("original_dtype").alias("orig_type"), "original", F.col("processed_dtype").alias("repl_type"), "replacement")
    return written(out, "mapping")


def _meta(spark: SparkSession, meta: list[tuple], fields: dict[str, int]) -> DataFrame:
    kinds = {"target": "int"}
    return F.broadcast(spark.createDataFrame([(m[0], *[m[i] for i in fields.values()]) for m in meta], ", ".join(["target int", *[f"{n} {kinds.get(n, 'string')}" for n in fields]])))


def _redacted(values: DataFrame, meta: list[tuple], config: Config, known: DataFrame | None) -> DataFrame:
    spark = values.sparkSession
    if config.redact_style in ("full", "partial"):
        change = redact_full if config.redact_style == "full" else redact_partial
        return values.select("target", "original", change(F.col("original")).alias("replacement"))
    # a value at the same path of a later scope takes the token it has
    places = spark.createDataFrame([(m[0], m[4], token_label(m[6])) for m in meta], "target int, path string, label string")
    values = values.join(F.broadcast(places), "target")
    firsts = values.groupBy("path", "original").agg(F.min(F.struct("target", "label")).alias("first"))
    firsts = firsts.select("path", "original", "first.target", "first.label")
    if known is not None:
        reuse = known.groupBy("path", "original").agg(F.min("replacement").alias("had"))
        firsts = firsts.join(reuse, ["path", "original"], "left")
        last = known.select(F.max(F.regexp_extract("replacement", r"_(\d+)>?$", 1).try_cast("long"))).first()[0] or 0
    else:
        firsts, last = firsts.withColumn("had", F.lit(None).cast("string")), 0
    new = ranked(firsts.filter("had is null").drop("had"), [], [F.col("target"), F.col("original")], "rank")
    n = (F.col("rank") + 1 + last).cast("long")
    token = F.format_string("REDACTED_%04d", n) if config.redact_style == "token" else F.concat(F.lit("<"), F.col("label"), F.lit("_"), n.cast("string"), F.lit(">"))
    tokens = new.select("path", "original", token.alias("replacement")).unionByName(firsts.filter("had is not null").select("path", "original", F.col("had").alias("replacement")))
    return values.join(tokens, ["path", "original"]).select("target", "original", "replacement")


def _changed(values: DataFrame, meta: list[tuple], config: Config) -> DataFrame:
    """Shift and perturb: a function of value and seed; what isn't a date or a number stays as it is."""
    days = config.shift_days if config.shift_days is not None else (config.seed * 7919 % 30 + 1) * (-1 if config.seed % 2 else 1)
    pct = config.perturb_pct if config.perturb_pct is not None else 0.05
    change = F.lit(None).cast("string")
    for m in meta:
        kind = _type(m[7])
        value = F.col("original")
        if config.mode == "shift":
            new = as_text(shift_native(from_text(value, kind), kind, days), kind) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else shift_text(value, days) if isinstance(kind, T.StringType) else value
        else:
            new = perturb(value, kind, config.seed, pct)
        change = F.when(F.col("target") == m[0], new).otherwise(change)
    return values.select("target", "original", F.coalesce(change, F.col("original")).alias("replacement"))


def _type(name: str) -> T.DataType:
    simple = {"string": T.StringType(), "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType()}
    return simple[name]


def _faked(values: DataFrame, meta: list[tuple], config: Config, known: DataFrame | None) -> DataFrame:
    """Fakes by rank in pools of unused candidates; see synth for candidates.

    The pool of a shape is its first 2n candidates (n originals) without originals and used
    replacements, so at least n remain unless the shape's space is dense. Originals that a dense space
    leaves over take the next leftover original in cyclic order: still one to one, never their own.
    """
    spark = values.sparkSession
    kind = F.lit(None).cast("string")
    for m in meta:
        kind = F.when(F.col("target") == m[0], synth.kind_of(m[5], m[6], m[7], F.col("original"))).otherwise(kind)
    cats = spark.createDataFrame([(m[0], m[5]) for m in meta], "target int, category string")
    values = values.withColumn("gen", kind).join(F.broadcast(cats), "target")
    # one fake for each category and original; the first target's hint decides the generator
    keyed = values.groupBy("category", "original").agg(F.min(F.struct("target", "gen")).alias("first")).select("category", "original", "first.gen")
    used = spark.createDataFrame([], "replacement string")
    had = None
    if known is not None:
        had = known.groupBy("category", "original").agg(F.min("replacement").alias("replacement"))
        used = known.select("replacement").distinct()
        keyed = keyed.join(had.select("category", "original"), ["category", "original"], "left_anti")
    keyed = keyed.withColumn("shape", synth.shape_of(F.col("gen"), F.col("original")))
    # one fake for each original of a shape, whatever categories it came under
    one = keyed.select("gen", "shape", "original").distinct()
    one = written(ranked(one, ["gen", "shape"], [F.md5(F.concat(F.lit(f"{config.seed}:"), F.col("original"))), F.col("original")], "rank"), "fake-ranks")
    sizes = one.groupBy("gen", "shape").agg(F.count(F.lit(1)).alias("n"))
    coded = F.col("gen").isin("id", "digits", "int", "real")
    sizes = sizes.withColumn("c", F.when(coded, synth.counter(F.col("shape")))).select("gen", "shape", "n", F.when(coded, F.col("c.size")).otherwise(F.lit(1 << 40)).alias("size"), "c.weights")
    extra = F.lit(0) if known is None else F.lit(known.count())
    wanted = F.least(F.col("size"), 2 * F.col("n") + extra)
    sizes = sizes.withColumn("wanted", wanted)
    gens = sizes.groupBy("gen").agg(F.sum(F.floor((F.col("wanted") - 1) / CANDIDATES) + 1).alias("blocks")).collect()  # a dozen generators
    kinds = [r.gen for r in gens]
    numbers = _numbers(sizes, sum(r.blocks for r in gens))
    text = F.when(coded, synth.code(F.col("shape"), F.col("size"), F.col("weights"), F.col("k"), config.seed))
    for g in kinds:
        if g not in ("id", "digits", "int", "real"):
            text = text.when(F.col("gen") == g, synth.free(g, F.col("k"), config.seed, config.locale, config.anchor_date))
    text = F.when(F.col("gen") == "real", F.concat(text, F.when(text.contains("."), F.lit("")).otherwise(F.lit(".0")))).otherwise(text)
    pool = numbers.select("gen", "shape", "k", text.alias("replacement"))
    # no fake is an original of the run, nor one that another shape or an earlier run has given
    pool = pool.join(one.select(F.col("original").alias("replacement")).distinct(), "replacement", "left_anti").join(used, "replacement", "left_anti")
    pool = pool.withColumn("claim", F.concat_ws("|", F.lpad(F.col("gen"), 24, " "), "shape"))
    pool = pool.groupBy("replacement").agg(F.min(F.struct("claim", "k", "gen", "shape")).alias("f")).select("f.gen", "f.shape", "f.k", "replacement")
    pool = written(ranked(pool, ["gen", "shape"], [F.col("k")], "rank").select("gen", "shape", "rank", "replacement"), "fake-pool")
    given = one.join(pool, ["gen", "shape", "rank"], "left")
    left = given.filter("replacement is null").drop("replacement")
    done = given.filter("replacement is not null").select("gen", "shape", "original", "replacement")
    if left.limit(1).count():
        done = done.unionByName(_leftover(left, one, used))
    fakes = keyed.join(done, ["gen", "shape", "original"]).select("category", "original", "replacement")
    if had is not None:
        fakes = fakes.unionByName(had.join(values.select("category", "original").distinct(), ["category", "original"], "left_semi").select("category", "original", "replacement"))
    return values.join(fakes, ["category", "original"]).select("target", "original", "replacement")


def _numbers(sizes: DataFrame, blocks: int) -> DataFrame:
    """One row for each candidate ``k`` below ``wanted`` of a row of ``sizes``; blocks of numbers first, so that a
    large shape is made by many tasks. Their number is set: blocks are so small before they are filled that
    adaptive execution would put them all into one task."""
    parts = min(blocks, max(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 16))
    each = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("wanted") - 1) / CANDIDATES))))
    each = each.repartition(max(1, parts), "gen", "shape", "block")
    return each.withColumn("k", F.explode(F.sequence(F.col("block") * CANDIDATES, F.least(F.col("block") * CANDIDATES + CANDIDATES - 1, F.col("wanted") - 1))))


def _leftover(left: DataFrame, one: DataFrame, used: DataFrame) -> DataFrame:
    """Originals without a candidate: each takes the next one's value, the last the first's; a single one
    takes another original of its shape, or a label where the shape has no other value."""
    turn = written(ranked(left.select("gen", "shape", "original"), ["gen", "shape"], [F.col("original")], "i"), "leftover")
    n = turn.groupBy("gen", "shape").agg(F.count(F.lit(1)).alias("n"))
    order = turn.join(n, ["gen", "shape"])
    ahead = turn.select("gen", "shape", F.col("i").alias("j"), F.col("original").alias("next"))
    cyclic = order.filter("n > 1").withColumn("j", F.pmod(F.col("i") + 1, F.col("n"))).join(ahead, ["gen", "shape", "j"]).select("gen", "shape", "original", F.col("next").alias("replacement"))
    single = order.filter("n = 1").select("gen", "shape", "original")
    other = single.join(one.select("gen", "shape", F.col("original").alias("another")), ["gen", "shape"]).filter("another <> original").groupBy("gen", "shape", "original").agg(F.min("another").alias("replacement"))
    labels = single.join(other.select("gen", "shape"), ["gen", "shape"], "left_anti")
    labels = ranked(labels, [], [F.col("gen"), F.col("shape")], "at")
    # numbers go on after all replacements of earlier runs, so a label never repeats one of theirs
    number = (F.col("at") + 1 + F.lit(used.count())).cast("string")
    label = F.when(F.col("gen").isin("int", "real"), F.concat(F.repeat(F.lit("9"), 6), number)).otherwise(F.concat(F.col("gen"), F.lit("#F"), number))
    labels = labels.select("gen", "shape", "original", label.alias("replacement"))
    return cyclic.unionByName(other).unionByName(labels)


# --- queries over mapping tables -------------------------------------------------------------------


def bijective(mapping: DataFrame) -> DataFrame:
    """scope, column, path, originals, replacements, bijective of each entry."""
    return mapping.groupBy("scope", "column", "path").agg(F.count(F.lit(1)).alias("originals"), F.count_distinct("replacement").alias("replacements")).withColumn("bijective", F.col("originals") == F.col("replacements"))


def check_saveable(mapping: DataFrame, lossless: bool) -> None:
    """Refuse an ambiguous mapping in a mode that promises restoring."""
    if lossless and (n := mapping.groupBy("scope", "path", "replacement").agg(F.count_distinct("original").alias("n")).filter("n > 1").count()):
        raise MappingError(f"{n} replacements stand for several originals")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both mappings; entries (scope, path) of ``new`` take the place of old ones."""
    kept = old.join(new.select("scope", "path").distinct(), ["scope", "path"], "left_anti")
    return kept.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def extend(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both mappings row by row; a value that ``old`` maps at a (scope, path) keeps its replacement."""
    fresh = new.join(old.select("scope", "path", "original"), ["scope", "path", "original"], "left_anti")
    return old.select(*COLUMNS).unionByName(fresh.select(*COLUMNS))


def reverse(mapping: DataFrame, order: str | None = None) -> DataFrame:
    """(replacement, original): the last original in ``order`` (a column; else the largest) wins."""
    return mapping.groupBy("replacement").agg(F.max_by("original", order or "original").alias("original"))


def lookup(mapping: DataFrame, replacement: str, column: str | None = None) -> str | None:
    """Original of one replacement, in any entry or that of a column."""
    rows = mapping.filter(F.col("replacement") == replacement)
    rows = rows.filter(F.col("column") == column) if column else rows
    got = rows.agg(F.max("original")).first()
    return got[0] if got else None


def scopes(mapping: DataFrame) -> list[str]:
    return sorted(r[0] for r in mapping.select("scope").distinct().collect())


def entries(mapping: DataFrame, scope: str) -> DataFrame:
    """Rows of a scope; of the scope "" where it has none, or of the only scope there is."""
    own = scopes(mapping)
    use = scope if scope in own else "" if "" in own else own[0] if len(own) == 1 else scope
    return mapping.filter(F.col("scope") == use)
