"""Queries of the engine's own operators over the driver tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import io_queries
from .config import Config
from .functions import values as V
from .functions.names import gazetteer
from .operators import apply as A
from .operators import detect, gateway, leak, scrub
from .operators import mapping as M
from .operators import restore as R
from .operators.collect import originals
from .operators.process import process, process_frames
from .patterns import NAMES, SHAPES
from .plans.planner import Target, detection_frame


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _flat(column: str, category: str = "name", dtype: str = "string") -> Target:
    return Target("flat", column, column, category, dtype)


def _redact(df: DataFrame, column: str, style: str, category: str = "name") -> tuple[DataFrame, DataFrame]:
    config = Config(mode="redact", redact_style=style)
    targets = [_flat(column, category)]
    mapping = M.build({"": (df, targets)}, config)
    return A.apply(df, targets, mapping, redacting=True), mapping


# --- detection ---------------------------------------------------------------------------------------


def detect_names_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Columns of three tables whose names match, by shared words."""
    names = [(c,) for t in ("customer", "supplier", "part", "nation", "region") for c in _t(spark, d, t).columns]
    return detect.names_frame(spark.createDataFrame(names, "name string"), list(NAMES), "fuzzy")


def detect_shapes_orders(spark: SparkSession, d: str) -> DataFrame:
    return detect.shape_report(_t(spark, d, "orders")).drop("at")


def shape_ratio_documents(spark: SparkSession, d: str) -> DataFrame:
    """Share of all shapes in document texts, rounded to nine decimals."""
    text = F.col("text")
    return _t(spark, d, "documents").agg(*[F.round(V.shape_ratio(s.name, text), 9).alias(s.name) for s in SHAPES])


def confidence_report(spark: SparkSession, d: str) -> DataFrame:
    rows = detect.confidence_report(_t(spark, d, "customer"), Config(match_strategy="fuzzy"))
    return spark.createDataFrame([(r["column"], r["category"], r["confidence"], r["value_detector"]) for r in rows], "column string, category string, confidence double, value_detector string")


def luhn_cards_documents(spark: SparkSession, d: str) -> DataFrame:
    """Card-like runs of each document that pass the check digit."""
    from .patterns import CARD_RUN

    runs = F.regexp_extract_all(F.col("text"), F.lit(CARD_RUN), F.lit(0))
    good = F.filter(F.transform(runs, lambda x: F.regexp_replace(x, "[^0-9]", "")), V.luhn_ok)
    return _t(spark, d, "documents").select("doc_id", F.explode(good).alias("card"))


def nik_candidates_documents(spark: SparkSession, d: str) -> DataFrame:
    runs = F.regexp_extract_all(F.col("text"), F.lit(r"\b\d{16}\b"), F.lit(0))
    each = _t(spark, d, "documents").select("doc_id", F.explode(runs).alias("nik"))
    return each.select("doc_id", "nik", V.nik_ok(F.col("nik")).alias("plausible"))


def prose_columns(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").agg(F.round(V.prose_ratio(F.col("text")), 9).alias("text"), F.round(V.prose_ratio(F.col("source")), 9).alias("source"))


def detection_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """The plan of a run over customer, with distinct values of each target."""
    return detection_frame(_t(spark, d, "customer"), Config(match_strategy="fuzzy")).select("path", "category", "confidence", "name_match", "value_detector", "unique_count")


# --- replacing ---------------------------------------------------------------------------------------


def redact_full_customer(spark: SparkSession, d: str) -> DataFrame:
    return _redact(_t(spark, d, "customer"), "c_name", "full")[0].select("c_custkey", "c_name", "c_mktsegment")


def redact_partial_customer(spark: SparkSession, d: str) -> DataFrame:
    return _redact(_t(spark, d, "customer"), "c_name", "partial")[0].select("c_custkey", "c_name")


def redact_token_customer(spark: SparkSession, d: str) -> DataFrame:
    return _redact(_t(spark, d, "customer"), "c_name", "token")[0].select("c_custkey", "c_name")


def typed_token_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Numbers go on from customer to supplier."""
    config = Config(mode="redact", match_strategy="fuzzy", value_detection=False)
    run = process_frames({"customer": _t(spark, d, "customer"), "supplier": _t(spark, d, "supplier")}, config)
    c, s = run.frames["customer"], run.frames["supplier"]
    return c.select(F.lit("customer").alias("table"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(s.select(F.lit("supplier").alias("table"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


def typed_token_segments(spark: SparkSession, d: str) -> DataFrame:
    """A column of few values in a table of many rows."""
    return _redact(_t(spark, d, "customer"), "c_mktsegment", "typed-token", "custom")[0].select("c_custkey", "c_mktsegment")


def mapping_bijective(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "customer")
    parts = [_redact(df, c, s, "custom")[1].withColumn("scope", F.lit(s)) for c, s in (("c_name", "typed-token"), ("c_mktsegment", "partial"))]
    return M.bijective(parts[0].unionByName(parts[1])).select("scope", "path", "originals", "replacements", "bijective")


def restore_typed_token(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    protected, mapping = process(df, Config(mode="redact"), ["c_name", "c_mktsegment"])
    return R.restore(protected, mapping)


def restore_fake_types(spark: SparkSession, d: str) -> DataFrame:
    """Fakes of text, integers, fractions and dates, turned back."""
    df = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_day"), "o_orderpriority")
    protected, mapping = process(df, Config(seed=5, value_detection=False), ["o_custkey", "o_totalprice", "o_day", "o_orderpriority"])
    return R.restore(protected, mapping)


def _invariants(df: DataFrame, protected: DataFrame, key: str, column: str) -> DataFrame:
    """What must hold of fakes, as counts: rows, distinct originals and fakes, own values, originals that
    are fakes of others, fakes of another shape."""
    both = df.select(key, F.col(column).cast("string").alias("o")).join(protected.select(key, F.col(column).cast("string").alias("f")), key)
    pairs = both.select("o", "f").distinct()
    reused = pairs.select(F.col("f").alias("x")).distinct().join(pairs.select(F.col("o").alias("x")).distinct(), "x", "left_semi").count()
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o").alias("n_originals"), F.count_distinct("f").alias("n_fakes"), F.count_if(F.col("o") == F.col("f")).alias("n_own"), F.count_if(shape(F.col("o")) != shape(F.col("f"))).alias("n_other_shape")).withColumn("n_reused", F.lit(reused).cast("long"))


def fake_identifier_customer(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "customer")
    targets = [_flat("c_name", "identifier")]
    mapping = M.build({"": (df, targets)}, Config(seed=3))
    return _invariants(df, A.apply(df, targets, mapping), "c_custkey", "c_name")


def fake_integers_orders(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "orders")
    return _invariants(df, process(df, Config(seed=4, value_detection=False), ["o_custkey"])[0], "o_orderkey", "o_custkey").drop("n_other_shape", "n_reused")


def fake_names_and_dates(spark: SparkSession, d: str) -> DataFrame:
    """Names and dates of birth are injective and nobody's own."""
    df = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Person "), F.col("o_custkey").cast("string")).alias("full_name"), F.to_date("o_orderdate").alias("dob"))
    protected = process(df, Config(seed=6, value_detection=False))[0]
    parts = [_invariants(df, protected, "o_orderkey", c).select(F.lit(c).alias("column"), "n_rows", "n_originals", "n_fakes", "n_own") for c in ("full_name", "dob")]
    return parts[0].unionByName(parts[1])


def fake_reuse_across_tables(spark: SparkSession, d: str) -> DataFrame:
    """The same nation key has the same fake in both tables: pairs of keys seen in both."""
    c, s = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("member_code")), _t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("member_code"))
    run = process_frames({"c": c, "s": s}, Config(value_detection=False))
    m = run.mapping.select("scope", "original", "replacement")
    both = m.filter("scope = 'c'").alias("a").join(m.filter("scope = 's'").alias("b"), F.col("a.original") == F.col("b.original"))
    return both.select(F.col("a.original").alias("nation"), (F.col("a.replacement") == F.col("b.replacement")).alias("same"))


def fake_dense_codes(spark: SparkSession, d: str) -> DataFrame:
    """Nine tenths of a code space are originals: still one to one, same shape, nobody's own."""
    df = spark.range(900).select("id", F.format_string("%03d", "id").alias("member_code"))
    return _invariants(df, process(df, Config(seed=2, value_detection=False))[0], "id", "member_code").drop("n_reused")


def shift_orders_17d(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_text"))
    out = process(df, Config(shift_days=17, value_detection=False), ["o_orderdate", "o_text"])[0]
    return out.select("o_orderkey", F.to_date("o_orderdate").alias("o_day"), "o_text")


def perturb_acctbal_5pct(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    out = process(df, Config(perturb_pct=0.05, seed=9, value_detection=False), ["c_acctbal"])[0]
    return out.select("c_custkey", "c_acctbal")


# --- nested and JSON ---------------------------------------------------------------------------------


def _nested(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    return c.select("c_custkey", F.struct(F.col("c_name").alias("full_name"), F.array(F.struct(F.col("c_mktsegment").alias("phone"), F.lit("x").alias("label")), F.struct(F.col("c_name").alias("phone"), F.lit("y").alias("label"))).alias("contacts")).alias("person"))


def nested_struct_apply(spark: SparkSession, d: str) -> DataFrame:
    out = process(_nested(spark, d), Config(mode="redact", redact_style="partial"), ["person.full_name"])[0]
    return out.select("c_custkey", F.col("person.full_name").alias("full_name"), F.col("person.contacts")[1]["phone"].alias("phone"))


def array_struct_apply(spark: SparkSession, d: str) -> DataFrame:
    out = process(_nested(spark, d), Config(mode="redact", redact_style="partial"), ["person.contacts[*].phone"])[0]
    return out.select("c_custkey", F.posexplode("person.contacts").alias("at", "c")).select("c_custkey", "at", F.col("c.phone").alias("phone"), F.col("c.label").alias("label"))


def nested_restore(spark: SparkSession, d: str) -> DataFrame:
    protected, mapping = process(_nested(spark, d), Config(mode="redact"), ["person"])
    out = R.restore(protected, mapping)
    return out.select("c_custkey", F.col("person.full_name").alias("full_name"), F.col("person.contacts")[0]["phone"].alias("first"), F.col("person.contacts")[1]["phone"].alias("second"))


def _json(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("full_name"), F.struct(F.col("c_mktsegment").alias("phone")).alias("more"))).alias("doc"))


def json_text_apply(spark: SparkSession, d: str) -> DataFrame:
    out = process(_json(spark, d), Config(mode="redact", redact_style="partial", json_columns=("doc",)))[0]
    return out.select("c_custkey", F.get_json_object("doc", "$.full_name").alias("full_name"), F.get_json_object("doc", "$.more.phone").alias("phone"))


def json_text_restore(spark: SparkSession, d: str) -> DataFrame:
    protected, mapping = process(_json(spark, d), Config(mode="redact", json_columns=("doc",)))
    out = R.restore(protected, mapping)
    return out.select("c_custkey", F.get_json_object("doc", "$.full_name").alias("full_name"), F.get_json_object("doc", "$.more.phone").alias("phone"))


def json_props_collect(spark: SparkSession, d: str) -> DataFrame:
    """Distinct string values of a path in JSON text."""
    df = _t(spark, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("doc"))
    return originals(df, [Target("json", "doc", "doc:kind", "custom", "string")]).select("original")


def names_in_prose(spark: SparkSession, d: str) -> DataFrame:
    """Known names in prose replaced and turned back."""
    df = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("yesterday Adra Belan saw number "), F.col("c_custkey").cast("string")).alias("note"))
    find = gazetteer()
    config = Config(mode="redact", ner=True, value_detection=False)
    run = process_frames({"default": df}, config, find_names=find)
    back = R.restore(run.frames["default"], run.mapping)
    return run.frames["default"].select("c_custkey", F.col("note").alias("protected")).join(back.select("c_custkey", F.col("note").alias("restored")), "c_custkey")


# --- checks ------------------------------------------------------------------------------------------


def leak_original_values(spark: SparkSession, d: str) -> DataFrame:
    """Customer names that a protected copy still shows in a column that was left alone."""
    df = _t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_name").alias("c_copy"))
    protected, mapping = _redact(df, "c_name", "typed-token")
    return leak.surviving(protected, mapping.filter("original <> replacement"))


def leak_value_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes in the string columns that a run left alone."""
    df = _t(spark, d, "customer").select("c_name", F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("c_where"))
    protected, mapping = _redact(df, "c_name", "typed-token")
    report = leak.check(protected, [_flat("c_name")], mapping)
    return spark.createDataFrame([(f.path, f.kind, f.detail) for f in report.findings], "path string, kind string, detail string")


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    run = process_frames({"customer": _t(spark, d, "customer"), "supplier": _t(spark, d, "supplier")}, Config(mode="redact", value_detection=False, match_strategy="fuzzy"))
    return leak.target_counts(run.mapping)


# --- mapping tables ----------------------------------------------------------------------------------


def mapping_merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    a = _redact(_t(spark, d, "customer"), "c_mktsegment", "full")[1]
    b = _redact(_t(spark, d, "customer"), "c_mktsegment", "partial")[1]
    return M.merge(a, b).select("path", "original", "replacement")


def mapping_anti_join_new(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a run over all customers adds to the mapping of one segment's."""
    df = _t(spark, d, "customer")
    old = _redact(df.filter("c_mktsegment = 'BUILDING'"), "c_name", "partial")[1]
    new = _redact(df, "c_name", "partial")[1]
    return M.extend(old, new).join(old.select("original"), "original", "left_anti").select("original", "replacement")


def mapping_project_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a first run stay, numbers go on after them."""
    df = _t(spark, d, "customer")
    config, targets = Config(mode="redact"), [_flat("c_name")]
    first = M.build({"": (df.filter("c_mktsegment = 'BUILDING'"), targets)}, config)
    return M.build({"": (df, targets)}, config, first).select("original", "replacement")


def mapping_reverse(spark: SparkSession, d: str) -> DataFrame:
    return M.reverse(_redact(_t(spark, d, "customer"), "c_mktsegment", "partial")[1])


# --- gateway -----------------------------------------------------------------------------------------


def gateway_describe(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("c_some"))
    return gateway.describe(df).select("column", "nulls", "distinct")


def gateway_page(spark: SparkSession, d: str) -> DataFrame:
    """Rows 40 to 59 in key order, cells as callers see them."""
    df = _t(spark, d, "documents").orderBy("doc_id").offset(40).limit(20)
    return df.select("doc_id", gateway.cell(F.col("text"), T.StringType(), 80).alias("text"), gateway.cell(F.col("n_chars"), T.LongType()).alias("n_chars"))


def gateway_search_contains(spark: SparkSession, d: str) -> DataFrame:
    return gateway.search(_t(spark, d, "part"), "p_name", "A").select("p_partkey", "p_name")


def gateway_search_equals(spark: SparkSession, d: str) -> DataFrame:
    return gateway.search(_t(spark, d, "customer"), "c_mktsegment", "building", "equals").select("c_custkey")


def gateway_group_by(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").alias("custkey"), F.round("o_totalprice").cast("long").alias("price"))
    out = gateway.aggregate(df, ["o_orderstatus"], [("count", None), ("sum", "price"), ("min", "price"), ("max", "price"), ("mean", "price"), ("n_unique", "custkey")])
    return out.withColumn("mean_price", F.round("mean_price", 4))


def gateway_n_unique_nulls(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("nation"), F.lit(None).cast("long").alias("nothing"))
    return gateway.aggregate(df, ["c_mktsegment"], [("n_unique", "nation"), ("sum", "nothing")])


def gateway_policy(spark: SparkSession, d: str) -> DataFrame:
    """Only processed leaves and kept ones are shown."""
    df = _t(spark, d, "customer")
    protected, _ = _redact(df, "c_name", "partial")
    return gateway.project(protected, gateway.Policy(keep=("c_custkey",), keep_unmatched=False), {"c_name"})


# --- prose -------------------------------------------------------------------------------------------


def scrub_span_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", *scrub.counts(F.col("text")))


def scrub_tokens_by_session(spark: SparkSession, d: str) -> DataFrame:
    """Scrubbed conversations; the e-mail addresses put in here are numbered by first turn."""
    df = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.col("role"), F.lit(" wrote u"), (F.col("turn") % 3).cast("string"), F.lit("@x.org")).alias("text"))
    return scrub.scrub(df, "text", ["conv_id"], ["turn"])[0]


def scrub_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents scrubbed, each a session of its own."""
    out = scrub.scrub(_t(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"], ["doc_id"])[0]
    return out


def restore_tokens_text(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "customer")
    mapping = _redact(df, "c_name", "typed-token")[1]
    prose = mapping.select(F.monotonically_increasing_id().alias("id"), "original", F.concat(F.lit("about "), F.col("replacement"), F.lit(", and <PERSON_0> too")).alias("prose"))
    return R.restore_tokens(prose, "prose", mapping).select("original", "prose")


def restore_prose_exact(spark: SparkSession, d: str) -> DataFrame:
    df = _t(spark, d, "supplier").select(F.col("s_name").alias("supplier_name"))
    protected, mapping = process(df, Config(seed=8, value_detection=False), ["supplier_name"])
    text = protected.select(F.concat(F.lit("see "), F.col("supplier_name"), F.lit(".")).alias("t"))
    return R.restore_text(text, "t", mapping).select("restored")


QUERIES = {f.__name__: f for f in (
    detect_names_fuzzy, detect_shapes_orders, shape_ratio_documents, confidence_report, luhn_cards_documents, nik_candidates_documents, prose_columns, detection_dry_run,
    redact_full_customer, redact_partial_customer, redact_token_customer, typed_token_two_tables, typed_token_segments, mapping_bijective, restore_typed_token, restore_fake_types,
    fake_identifier_customer, fake_integers_orders, fake_names_and_dates, fake_reuse_across_tables, fake_dense_codes, shift_orders_17d, perturb_acctbal_5pct,
    nested_struct_apply, array_struct_apply, nested_restore, json_text_apply, json_text_restore, json_props_collect, names_in_prose,
    leak_original_values, leak_value_shapes, audit_counts, mapping_merge_last_wins, mapping_anti_join_new, mapping_project_reuse, mapping_reverse,
    gateway_describe, gateway_page, gateway_search_contains, gateway_search_equals, gateway_group_by, gateway_n_unique_nulls, gateway_policy,
    scrub_span_counts, scrub_tokens_by_session, scrub_documents, restore_tokens_text, restore_prose_exact,
)}


# --- the same in SQL ---------------------------------------------------------------------------------

_MASK = "CASE WHEN length({0}) <= 4 THEN repeat('X', length({0})) ELSE repeat('X', length({0}) - 4) || right({0}, 4) END"
_LUHN = "(list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN (length({0}) - i) % 2 = 1 THEN CASE WHEN 2 * substr({0}, i, 1)::INT > 9 THEN 2 * substr({0}, i, 1)::INT - 9 ELSE 2 * substr({0}, i, 1)::INT END ELSE substr({0}, i, 1)::INT END)) % 10 = 0)"
_CARD = r"\d(?:[ \-]?\d){12,18}"
_NIK = "({0} NOT LIKE '00%' AND substr({0}, 9, 2) BETWEEN '01' AND '12' AND (substr({0}, 7, 2) BETWEEN '01' AND '31' OR substr({0}, 7, 2) BETWEEN '41' AND '71'))"
_TEXT = {s.name: s.pattern for s in SHAPES}
_RATIO = {n: f"coalesce(avg(regexp_matches({{0}}, '{p}')::INT::DOUBLE), 0.0)" for n, p in _TEXT.items()}
_RATIO["credit_card"] = f"coalesce(avg((len(list_filter(regexp_extract_all({{0}}, '{_CARD}'), lambda r: {_LUHN.replace("{0}", "regexp_replace(r, '[^0-9]', '', 'g')")})) > 0)::INT::DOUBLE), 0.0)"
_NIK_RUNS = r"regexp_extract_all({0}, '\b\d{16}\b')"
_NIK_AT = "list_position(list_transform(" + _NIK_RUNS + ", lambda n: " + _NIK.replace("{0}", "n") + "), true)"
_RATIO["nik"] = "coalesce(sum((" + _NIK_AT + " IS NOT NULL)::INT)::DOUBLE / nullif(sum(CASE WHEN " + _NIK_AT + " IS NOT NULL THEN " + _NIK_AT + " WHEN regexp_matches({0}, '[0-9]') THEN len(" + _NIK_RUNS + ") + 1 ELSE 0 END), 0), 0.0)"
_NUMBER = r"regexp_replace(regexp_replace(({0}::DECIMAL(38,6))::VARCHAR, '0+$', ''), '\.$', '.0')"
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_NAME_ROWS = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(NAMES))
_ORGANISATION = "['company','companies','corporate','business','employer','organisation','organization','firm']"


def _shapes(table: str, columns: dict[str, str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", '{n}' AS shape, round({r.replace("{0}", x)}, 6) AS ratio FROM {table}" for c, x in columns.items() for n, r in _RATIO.items()]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE ratio >= 0.3"


_TOKENS = "SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM (SELECT DISTINCT c_name FROM customer WHERE c_name <> '')"
_INVARIANT = "SELECT count(*) AS n_rows, count(DISTINCT {c}) AS n_originals, count(DISTINCT {c}) AS n_fakes, 0::BIGINT AS n_own{more} FROM {t}"

ORACLE = {
    "detect_names_fuzzy": f"""WITH p(k, pattern, category) AS (VALUES {_NAME_ROWS}),
      n AS (SELECT column_name AS name FROM (DESCRIBE customer) UNION SELECT column_name FROM (DESCRIBE supplier) UNION SELECT column_name FROM (DESCRIBE part) UNION SELECT column_name FROM (DESCRIBE nation) UNION SELECT column_name FROM (DESCRIBE region)),
      s AS (SELECT name, k, pattern, category, len(list_intersect({_WORDS.replace("{0}", 'name')}, {_WORDS.replace("{0}", 'pattern')}))::DOUBLE / len(list_distinct({_WORDS.replace("{0}", 'pattern')})) AS score FROM n, p
        WHERE NOT (len({_WORDS.replace("{0}", 'name')}) > 1 AND list_has_any({_WORDS.replace("{0}", 'name')}, {_ORGANISATION})))
      SELECT name, category, pattern FROM s WHERE score >= 0.8 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, k) = 1""",
    "detect_shapes_orders": _shapes("orders", {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_totalprice": _NUMBER.replace("{0}", "o_totalprice"), "o_orderdate": _STAMP.replace("{0}", "o_orderdate"), "o_orderpriority": "o_orderpriority"}),
    "shape_ratio_documents": "SELECT " + ", ".join(f"round({r.replace("{0}", 'text')}, 9) AS {n}" for n, r in _RATIO.items()) + " FROM documents",
    "confidence_report": f"SELECT 'c_name' AS \"column\", 'name' AS category, round(0.5 + 0.5 * {_RATIO['phone'].replace("{0}", 'c_name')}, 3) AS confidence, 'phone' AS value_detector FROM customer",
    "luhn_cards_documents": f"SELECT doc_id, card FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_CARD}')), '[^0-9]', '', 'g') AS card FROM documents) WHERE {_LUHN.replace("{0}", 'card')}",
    "nik_candidates_documents": rf"SELECT doc_id, nik, {_NIK.replace("{0}", 'nik')} AS plausible FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{16}}\b')) AS nik FROM documents)",
    "prose_columns": r"SELECT round(avg((len(string_split_regex(trim(text, ' '), '\s+')) >= 4)::INT::DOUBLE), 9) AS text, round(avg((len(string_split_regex(trim(source, ' '), '\s+')) >= 4)::INT::DOUBLE), 9) AS source FROM documents",
    "detection_dry_run": f"SELECT 'c_name' AS path, 'name' AS category, 1.0::DOUBLE AS confidence, true AS name_match, 'phone' AS value_detector, (SELECT count(DISTINCT c_name) FROM customer) AS unique_count",
    "redact_full_customer": "SELECT c_custkey, CASE WHEN c_name IS NULL OR c_name = '' THEN c_name ELSE '[REDACTED]' END AS c_name, c_mktsegment FROM customer",
    "redact_partial_customer": f"SELECT c_custkey, {_MASK.replace("{0}", 'c_name')} AS c_name FROM customer",
    "redact_token_customer": f"SELECT c_custkey, 'REDACTED_' || lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0') AS c_name FROM customer JOIN ({_TOKENS}) USING (c_name)",
    "typed_token_two_tables": f"""WITH c AS ({_TOKENS}), s AS (SELECT s_name, (SELECT count(*) FROM c) + row_number() OVER (ORDER BY s_name) AS n FROM (SELECT DISTINCT s_name FROM supplier))
      SELECT 'customer' AS "table", c_custkey AS key, '<PERSON_' || n || '>' AS name FROM customer JOIN c USING (c_name) UNION ALL SELECT 'supplier', s_suppkey, '<PERSON_' || n || '>' FROM supplier JOIN s USING (s_name)""",
    "typed_token_segments": "SELECT c_custkey, '<PII_' || n || '>' AS c_mktsegment FROM customer JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment)",
    "mapping_bijective": f"SELECT 'typed-token' AS scope, 'c_name' AS path, count(DISTINCT c_name) AS originals, count(DISTINCT c_name) AS replacements, true AS bijective FROM customer UNION ALL SELECT 'partial', 'c_mktsegment', count(DISTINCT c_mktsegment), count(DISTINCT {_MASK.replace("{0}", 'c_mktsegment')}), count(DISTINCT c_mktsegment) = count(DISTINCT {_MASK.replace("{0}", 'c_mktsegment')}) FROM customer",
    "restore_typed_token": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "restore_fake_types": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate::DATE AS o_day, o_orderpriority FROM orders",
    "fake_identifier_customer": _INVARIANT.format(c="c_name", t="customer", more=", 0::BIGINT AS n_other_shape, 0::BIGINT AS n_reused"),
    "fake_integers_orders": _INVARIANT.format(c="o_custkey", t="orders", more=""),
    "fake_names_and_dates": "SELECT 'full_name' AS \"column\", count(*) AS n_rows, count(DISTINCT o_custkey) AS n_originals, count(DISTINCT o_custkey) AS n_fakes, 0::BIGINT AS n_own FROM orders UNION ALL SELECT 'dob', count(*), count(DISTINCT o_orderdate::DATE), count(DISTINCT o_orderdate::DATE), 0 FROM orders",
    "fake_reuse_across_tables": "SELECT DISTINCT c_nationkey::VARCHAR AS nation, true AS same FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    "fake_dense_codes": "SELECT 900::BIGINT AS n_rows, 900::BIGINT AS n_originals, 900::BIGINT AS n_fakes, 0::BIGINT AS n_own, 0::BIGINT AS n_other_shape",
    "shift_orders_17d": "SELECT o_orderkey, (o_orderdate + INTERVAL 17 DAY)::DATE AS o_day, strftime(o_orderdate + INTERVAL 17 DAY, '%d/%m/%Y') AS o_text FROM orders",
    "perturb_acctbal_5pct": f"SELECT c_custkey, round(c_acctbal * (1.0 + (('0x' || substr(md5('9:' || {_NUMBER.replace("{0}", 'c_acctbal')}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE * 2.0 - 1.0) * 0.05::DOUBLE), 6) AS c_acctbal FROM customer",
    "nested_struct_apply": f"SELECT c_custkey, {_MASK.replace("{0}", 'c_name')} AS full_name, c_name AS phone FROM customer",
    "array_struct_apply": f"SELECT c_custkey, 0::INT AS at, {_MASK.replace("{0}", 'c_mktsegment')} AS phone, 'x' AS label FROM customer UNION ALL SELECT c_custkey, 1, {_MASK.replace("{0}", 'c_name')}, 'y' FROM customer",
    "nested_restore": "SELECT c_custkey, c_name AS full_name, c_mktsegment AS first, c_name AS second FROM customer",
    "json_text_apply": f"SELECT c_custkey, {_MASK.replace("{0}", 'c_name')} AS full_name, {_MASK.replace("{0}", 'c_mktsegment')} AS phone FROM customer",
    "json_text_restore": "SELECT c_custkey, c_name AS full_name, c_mktsegment AS phone FROM customer",
    "json_props_collect": "SELECT DISTINCT event_type AS original FROM events",
    "names_in_prose": "SELECT c_custkey, 'yesterday <PII_1> saw number ' || c_custkey AS protected, 'yesterday Adra Belan saw number ' || c_custkey AS restored FROM customer",
    "leak_original_values": "SELECT 'c_copy' AS path, count(DISTINCT c_name) AS leaked FROM customer",
    "leak_value_shapes": "SELECT 'c_where' AS path, 'shape' AS kind, 'email shape at 100% of values (email address)' AS detail",
    "audit_counts": "SELECT 'customer' AS scope, 'c_name' AS path, 'name' AS category, count(DISTINCT c_name) AS unique_count FROM customer UNION ALL SELECT 'supplier', 's_name', 'name', count(DISTINCT s_name) FROM supplier",
    "mapping_merge_last_wins": f"SELECT DISTINCT 'c_mktsegment' AS path, c_mktsegment AS original, {_MASK.replace("{0}", 'c_mktsegment')} AS replacement FROM customer",
    "mapping_anti_join_new": f"SELECT DISTINCT c_name AS original, {_MASK.replace("{0}", 'c_name')} AS replacement FROM customer WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')",
    "mapping_project_reuse": "WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM (SELECT DISTINCT c_name FROM customer WHERE c_mktsegment = 'BUILDING')), b AS (SELECT c_name, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY c_name) AS n FROM (SELECT DISTINCT c_name FROM customer WHERE c_name NOT IN (SELECT c_name FROM a))) SELECT c_name AS original, '<PERSON_' || n || '>' AS replacement FROM (SELECT * FROM a UNION ALL SELECT * FROM b)",
    "mapping_reverse": f"SELECT {_MASK.replace("{0}", 'c_mktsegment')} AS replacement, max(c_mktsegment) AS original FROM customer GROUP BY 1",
    "gateway_describe": "SELECT 'c_custkey' AS \"column\", count(*) FILTER (c_custkey IS NULL) AS nulls, count(DISTINCT c_custkey) AS \"distinct\" FROM customer UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_some', count(*) FILTER (c_custkey % 3 <> 0), count(DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END) + 1 FROM customer",
    "gateway_page": "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS text, n_chars FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40",
    "gateway_search_contains": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')",
    "gateway_search_equals": "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'",
    "gateway_group_by": "SELECT o_orderstatus, count(*) AS count, sum(p)::BIGINT AS sum_price, min(p) AS min_price, max(p) AS max_price, round(avg(p), 4) AS mean_price, count(DISTINCT o_custkey) AS n_unique_custkey FROM (SELECT *, round(o_totalprice)::BIGINT AS p FROM orders) GROUP BY 1",
    "gateway_n_unique_nulls": "SELECT c_mktsegment, count(DISTINCT CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END) + max((c_custkey % 7 = 0)::INT) AS n_unique_nation, 0::BIGINT AS sum_nothing FROM customer GROUP BY 1",
    "gateway_policy": f"SELECT c_custkey, {_MASK.replace("{0}", 'c_name')} AS c_name FROM customer",
    "scrub_tokens_by_session": """WITH s AS (SELECT conv_id, turn, role, 'u' || (turn % 3) || '@x.org' AS v FROM conversations),
      f AS (SELECT conv_id, v, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM s GROUP BY 1, 2)
      SELECT conv_id, turn, role || ' wrote <EMAIL_' || n || '>' AS text FROM s JOIN f USING (conv_id, v)""",
    "scrub_span_counts": "SELECT doc_id, " + ", ".join(
        {
            "credit_card": f"len(list_filter(regexp_extract_all(text, '{_CARD}'), lambda r: {_LUHN.replace("{0}", "regexp_replace(r, '[^0-9]', '', 'g')")}))",
            "nik": f"len(list_filter({_NIK_RUNS.replace("{0}", 'text')}, lambda n: {_NIK.replace('{0}', 'n')}))",
            "phone": f"len(list_filter(regexp_extract_all(text, '{_TEXT['phone']}'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) >= 7))",
        }.get(n, f"len(regexp_extract_all(text, '{_TEXT[n]}'))")
        + f"::BIGINT AS n_{n}"
        for n in scrub.ORDER
    ) + " FROM documents",
    "restore_tokens_text": "SELECT DISTINCT c_name AS original, 'about ' || c_name || ', and <PERSON_0> too' AS prose FROM customer",
    "restore_prose_exact": "SELECT 'see ' || s_name || '.' AS restored FROM supplier",
}

QUERIES |= io_queries.QUERIES
ORACLE |= io_queries.ORACLE
