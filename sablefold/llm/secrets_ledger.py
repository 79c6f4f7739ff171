"""Secret scans over an incremental blob ledger; DataFrame and SQL functions only.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger
is a parquet table (rule_version, blob, spans) with one row for each blob that a rule version has
scanned, findings or not. A run reduces its versions to distinct blobs (copies shrink before the
shuffle), drops pairs of blob and rule version that the ledger has, scans the rest, appends them,
and joins findings back to all paths. A blob is scanned once however many paths and commits hold
it; a new rule version scans everything once more, beside the old rows.

Spans come from the regular expression engine of the JVM: ``split`` gives the gaps between the
matches that ``regexp_extract_all`` gives, and running lengths of both are the positions in code
points. Matches are leftmost and non-overlapping for each kind, and checked for length afterwards.

Null texts count as empty. Nothing is dropped for size: texts are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import folder, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the shortest length of ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Runs of a class are greedy, so a minimum inside the pattern (access, hex) drops the same matches
#: as a check afterwards; an assignment's failing match still uses up its text, so it is checked after.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULE_VERSION = "base-1"
#: Matches of a text that one fold goes over.
CHUNK = 128
#: Rows of a finding, among which the paths of its blob are dealt.
SALTS = 8
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def blob_id(text: Column) -> Column:
    """Content address of a version; null and empty texts share one blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _of_rule(text: Column, rank: int, rule: Rule) -> Column:
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    rows = F.arrays_zip(F.transform(gaps, lambda x: F.length(x).cast("long")).alias("gap"), F.transform(found, lambda x: F.length(x).cast("long")).alias("own"), F.transform(value, lambda x: F.length(x).cast("long")).alias("value"))
    empty = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["0"]
        end = start + x["1"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["2"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    rows = F.transform(rows, lambda x: F.struct(*[x[f].alias(str(i)) for i, f in enumerate(("gap", "own", "value"))]))
    # a fold copies what it has gathered at every step, so it goes over CHUNK matches at a time
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(rows), F.lit(1)) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, F.lit(CHUNK)))
    folded = F.transform(chunks, lambda x: F.aggregate(x, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step))
    bases = F.aggregate(folded, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    moved = F.zip_with(folded, F.slice(bases, F.lit(1), F.size(folded)), lambda x, base: F.transform(x["spans"], lambda s: F.struct((s["start"] + base).alias("start"), s["rank"].alias("rank"), (s["end"] + base).alias("end"), s["kind"].alias("kind"))))
    return F.when(text.rlike(rule.pattern), F.flatten(moved)).otherwise(empty)


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text as an array of (start, rank, end, kind), by start, then the order of the rules."""
    return F.array_sort(F.concat(*[_of_rule(text, i, r) for i, r in enumerate(rules)]))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, ledger: str, rule_version: str) -> DataFrame:
    return spark.read.schema(f"blob string, spans {SPANS}").parquet(f"{ledger}/rule_version={rule_version}")


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of ``versions`` (text, any other columns) that ``ledger`` lacks under
    ``rule_version``, append them to it, and return the ledger's rows (blob, spans) of that version.

    Each run appends a batch of files in one commit; a run that fails half-way leaves no rows.
    """
    spark = versions.sparkSession
    path = f"{ledger}/rule_version={rule_version}"
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    if _exists(spark, path):
        # both sides are dealt by blob already, so texts move once
        blobs = blobs.join(read_ledger(spark, ledger, rule_version).select("blob"), "blob", "left_anti")
    blobs.select("blob", find_spans(F.col("text"), rules).alias("spans")).write.mode("append").parquet(path)
    return read_ledger(spark, ledger, rule_version)


def join_paths(versions: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    """Findings for every row of ``versions``: its columns and ``secret_spans`` (never null). Blobs
    without findings don't enter the join; one that many paths share stands in it SALTS times, and its
    paths are dealt among those. A blob that two runs at once have written counts once."""
    found = ledger_rows.filter(F.size("spans") > 0).groupBy(F.col("blob").alias("secret_blob")).agg(F.first("spans").alias("secret_spans"))
    found = found.withColumn("secret_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = versions.drop("secret_blob", "secret_spans", "secret_salt").withColumn("secret_blob", blob_id(F.col("text")))
    names = [F.col(f"`{f.name}`") for f in versions.schema if isinstance(f.dataType, T.AtomicType) and f.name != "text"]
    rows = rows.withColumn("secret_salt", F.pmod(F.xxhash64(*names), F.lit(SALTS)).cast("int") if names else F.lit(0))
    out = rows.join(found, ["secret_blob", "secret_salt"], "left").drop("secret_salt")
    return out.withColumn("secret_spans", F.coalesce("secret_spans", F.array().cast(SPANS)))


def redact(text: Column, spans: Column) -> Column:
    """The text with every found span replaced by ``[kind]``; overlapping spans are cut out together."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact_documents(docs: DataFrame, ledger: str) -> DataFrame:
    """``docs`` with all secrets in text replaced by their kind; n_chars, if there, follows. No row goes."""
    found = join_paths(docs, scan_unseen(docs, ledger))
    hit = F.size("secret_spans") > 0
    clean = found.withColumn("text", redact(F.col("text"), F.col("secret_spans")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every row of ``documents``, through a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = join_paths(docs, scan_unseen(docs, folder(spark, "ledger")))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in RULES], F.sha2(_joined(spans), 256).alias("base_sha256"), _joined(spans).alias("spans"))


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP6_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT rid, 'assign' AS kind, 0 AS ord, 8 AS least,
    string_split_regex(text, '"""
    + _ASSIGN
    + r"""') AS gaps, regexp_extract_all(text, '"""
    + _ASSIGN
    + r"""', 0) AS found, regexp_extract_all(text, '"""
    + _ASSIGN
    + r"""', 2) AS val FROM d
  UNION ALL
  SELECT rid, 'access', 1, 16, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL
  SELECT rid, 'hex', 2, 32, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM d),
u AS (SELECT rid, kind, ord, least, unnest(gaps[:len(found)]) AS gap, unnest(found) AS own, unnest(val) AS v, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0),
p AS (SELECT rid, kind, ord, length(v) >= least AS ok, sum(length(gap) + length(own)) OVER (PARTITION BY rid, kind ORDER BY i) AS e, length(own) AS n FROM u),
s AS (SELECT rid, kind, ord, (e - n)::BIGINT AS st, e::BIGINT AS e FROM p WHERE ok),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || st || ':' || e, ',' ORDER BY st, ord) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""
)
