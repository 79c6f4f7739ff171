"""Mixing sources to target weights by capped water-filling; DataFrame and SQL functions only.

Every source has a weight and a size (words). The mix takes as many words as all sources hold
together, shared by weight; a source stops at ``cap`` times its size, and what it cannot take is
reshared by weight among the others until none is above its cap.

The limit of that resharing has a closed form. Order the sources by ``cap * size / weight``; those
below the water level take their cap, the others ``weight * level``. Two running sums over the
table of sources (one row a source) give the level, so nothing loops on the driver.

A source of size s with target t gives every document ``floor(t / s)`` whole repetitions. The rest
of t is filled by one more repetition of documents in the order of a seeded hash; the document on
which the target falls contributes a fractional repetition, its first words. So a source's taken
words are its target, rounded to whole words, whatever the sizes of its documents.

Scale: the hash order of a source is never sorted as a whole. Word counts are summed for each of
``BINS`` hash ranges (partial sums before the shuffle), the range in which the target falls is
found from those sums, and only rows in that one range (about 1 / BINS of a source) are ordered.
A source with a third of all rows therefore puts 1 / (3 * BINS) of the rows in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, word_count, written

#: Hash ranges of a source; three hexadecimal digits of the hash.
BINS = 4096
SEED = "mix-1"
WEIGHTS = (1, 2, 3)
CAP = 3


def _key(source: str) -> list[Column]:
    """Join keys of a source that keep null apart from the empty string."""
    return [F.col(source).isNull(), F.coalesce(F.col(source), F.lit(""))]


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets for a table (source, source_size) with one row a source.

    Sources by code point, null last, get the weights in turn. Returns source, source_size, target
    (double). Sources without words have target 0; an empty table gives an empty table. The windows
    here run over one row a source.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("limit"))
    by_level = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.row_number().over(by_level).alias("k"),
        ((F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))).alias("level"),
    )
    # the first source that the level leaves below its cap sets the level for all that follow
    free = F.when(F.col("limit") / F.col("w") > F.col("level"), F.struct("k", "level"))
    t = t.select("*", F.min(free).over(every).alias("first"))
    target = F.when(F.col("first").isNull() | (F.col("k") < F.col("first.k")), F.col("limit")).otherwise(F.col("w") * F.col("first.level"))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, source and any other columns) with what the mix takes of each row.

    Adds mix_size, mix_source_size, mix_target, mix_whole (whole repetitions) and mix_extra (words
    of one more repetition). Null texts have size 0 and are never taken; a null source is a source
    of its own; repeated rows count one by one; rows that tie in the hash order go by doc_id, then
    size. Columns of ``docs`` keep their names and values; a column of it named like an added one
    is replaced.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_whole", "mix_extra", "mix_hash"]
    docs = docs.drop(*added)
    docs = docs.select("*", size.alias("mix_size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("mix_hash"))
    bins = docs.groupBy("source", F.substring("mix_hash", 1, 3).alias("bin")).agg(F.sum("mix_size").alias("words"))
    bins = written(bins, "mix-bins")
    filled = water_fill(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    plan = filled.select("source", "source_size", "target", whole.alias("whole"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5))).cast("long"))
    p, b = plan.alias("p"), bins.alias("b")
    run = Window.partitionBy("p.source").orderBy("b.bin").rowsBetween(Window.unboundedPreceding, -1)
    steps = p.join(b, [x == y for x, y in zip(_key("p.source"), _key("b.source"), strict=True)]).select(*_named("p.source"), "p.source_size", "p.target", "p.whole", "p.rest", "b.bin", F.sum("b.words").over(run).alias("upto"), F.col("b.words").alias("words"))
    cut = F.when(F.coalesce(F.col("upto"), F.lit(0)) + F.col("words") > F.col("rest"), F.struct("bin", F.coalesce(F.col("upto"), F.lit(0)).alias("upto")))
    plan = written(steps.groupBy("none", "name").agg(*[F.first(c).alias(c) for c in ("source_size", "target", "whole", "rest")], F.min(cut).alias("cut")), "mix-plan")
    # one row a source: Spark broadcasts it if its written size is under the session's threshold, else joins by shuffle
    own = docs.select("*", *_named("source"))
    took = own.join(plan, ["none", "name"], "left").drop("none", "name")
    took = took.withColumn("mix_bin", F.substring("mix_hash", 1, 3))
    on = (F.col("mix_bin") == F.col("cut.bin")) & (F.col("mix_size") > 0)
    order = Window.partitionBy("source").orderBy("mix_hash", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("cut.upto") - F.coalesce(F.sum("mix_size").over(order), F.lit(0))
    some = took.filter(F.coalesce(on, F.lit(False))).withColumn("mix_extra", F.greatest(F.lit(0), F.least(F.col("mix_size"), left)).cast("long"))
    full = F.when(F.col("cut").isNull() | (F.col("mix_bin") < F.col("cut.bin")), F.col("mix_size")).otherwise(F.lit(0)).cast("long")
    rest = took.filter(~F.coalesce(on, F.lit(False))).withColumn("mix_extra", F.when(F.col("rest") > 0, full).otherwise(F.lit(0)).cast("long"))
    out = some.unionByName(rest)
    return out.select(*[c for c in docs.columns if c not in added], "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole"), "mix_extra")


def _named(source: str) -> list[Column]:
    none, name = _key(source)
    return [none.alias("none"), name.alias("name")]


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: a row of ``docs`` comes out once for each repetition, whole ones
    with their text, a fractional one with its first words (white space between them kept). Rows
    that the mix takes nothing of go; texts without words weigh nothing and come out once.
    """
    taken = mix(docs, word_count(F.col("text")), weights, cap, seed)
    whole = F.col("mix_whole") + (F.col("mix_extra") == F.col("mix_size")).cast("long")
    part = F.when((F.col("mix_extra") > 0) & (F.col("mix_extra") < F.col("mix_size")), F.array(F.col("mix_extra"))).otherwise(F.array().cast("array<bigint>"))
    times = F.when(F.col("mix_size") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), part))
    each = taken.select("*", F.explode(times).alias("mix_words"))
    pieces = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    # a leading run of white space is a piece without a word
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), F.lit(1)).otherwise(F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), (F.col("mix_words").cast("int") + lead)), "")
    columns = [F.when(F.col("mix_words") >= 0, cut).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        columns = [F.when(F.col("mix_words") >= 0, F.length(cut).cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, columns, strict=True)]
    return each.select(*columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of ``documents``; see mix()."""
    docs = table(spark, sf_dir, "documents")
    # word counts once; text leaves the plan here
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    out = mix(sized, F.col("size"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_whole") * F.col("mix_size") + F.col("mix_extra")).alias("taken"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::DOUBLE AS w
  FROM sized GROUP BY source),
lim AS (SELECT *, 3.0::DOUBLE * source_size AS lim FROM named),
lev AS (
  SELECT *, row_number() OVER o AS k,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM lim WINDOW o AS (ORDER BY lim / w, source NULLS LAST)),
fst AS (SELECT *, min(CASE WHEN lim / w > level THEN k END) OVER () AS fk FROM lev),
tgt AS (
  SELECT source, source_size,
    CASE WHEN fk IS NULL OR k < fk THEN lim ELSE w * max(CASE WHEN k = fk THEN level END) OVER () END AS target
  FROM fst),
pln AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM tgt),
rst AS (SELECT *, greatest(0, floor(target - whole * source_size + 0.5))::BIGINT AS rest FROM pln)
SELECT doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM sized s JOIN rst r ON s.source IS NOT DISTINCT FROM r.source
"""
