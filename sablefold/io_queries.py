"""More queries of the engine's own operators: files, mapping files, planning, restoring, gateway, streams."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import apply as A
from .operators import detect, gateway, leak, scrub
from .operators import mapping as M
from .operators import restore as R
from .operators.process import process, process_frames, restore_frames
from .patterns import PRESETS
from .plans.planner import Target, plan
from .sources import mappings, tables
from .streaming import protect
from .work import work_path

PASSPHRASE = "only for this check"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A fresh folder of the driver's file system, for formats that are one file."""
    path = work_path(spark, "files").removeprefix("file://")
    os.makedirs(path)
    return path


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _flat(column: str, category: str = "name", dtype: str = "string") -> Target:
    return Target("flat", column, column, category, dtype)


def _tokens(spark: SparkSession, d: str, style: str = "typed-token") -> tuple[DataFrame, DataFrame, Config]:
    """(protected, mapping, config) of customer names."""
    df, config = _t(spark, d, "customer"), Config(mode="redact", redact_style=style)
    mapping = M.build({"": (df, [_flat("c_name")])}, config)
    return A.apply(df, [_flat("c_name")], mapping, redacting=True), mapping, config


# --- files -------------------------------------------------------------------------------------------


def source_formats(spark: SparkSession, d: str) -> DataFrame:
    names = ["a.csv", "b.TSV", "c.xlsx", "d.json", "e.ndjson", "f.jsonl", "g.parquet"]
    return _rows(spark, [(n, tables.format_of(n)) for n in names], "name string, format string")


def _through(spark: SparkSession, df: DataFrame, name: str, single: bool = False) -> DataFrame:
    """``df`` written as files and read again, cast back to its types."""
    path = f"{_folder(spark)}/{name}"
    tables.write(df, path, single)
    back = spark.read.json(path) if not single and name.endswith(("json", "jsonl")) else tables.read(spark, path)
    return back.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema])


def source_csv(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, _t(spark, d, "customer"), "t.csv")


def source_tsv(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, _t(spark, d, "supplier"), "t.tsv")


def source_json_array(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, _t(spark, d, "nation"), "t.json", single=True)


def source_ndjson(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props"), "t.ndjson")


def source_parquet(spark: SparkSession, d: str) -> DataFrame:
    return _through(spark, _t(spark, d, "part"), "t.parquet")


def source_excel_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Two sheets of one workbook, written and read."""
    path = f"{_folder(spark)}/t.xlsx"
    frames = {n: _t(spark, d, n) for n in ("nation", "region")}
    tables.write_sheets(frames, path)
    back = tables.read(spark, path, all_sheets=True)
    pick = lambda n, k, v: back[n].select(F.lit(n).alias("sheet"), F.col(k).cast("long").alias("key"), F.col(v).alias("name"))
    return pick("nation", "n_nationkey", "n_name").unionByName(pick("region", "r_regionkey", "r_name"))


def source_sibling_files(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a run in formats without sheets: a file each."""
    paths = tables.write_sheets({n: _t(spark, d, n) for n in ("nation", "region")}, f"{_folder(spark)}/run.csv")
    return _rows(spark, [(os.path.basename(p), tables.read(spark, p).count()) for p in paths], "file string, n_rows long")


def source_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole text files as rows."""
    path = _folder(spark)
    for r in _t(spark, d, "region").collect():
        with open(f"{path}/{r.r_regionkey}.txt", "w") as f:
            f.write(f"first line\n{r.r_name}")
    return tables.read_text(spark, path).select("value")


# --- mapping files -----------------------------------------------------------------------------------


def _saved(spark: SparkSession, d: str, name: str, passphrase: str | None = None) -> DataFrame:
    _, mapping, config = _tokens(spark, d)
    path = f"{_folder(spark)}/{name}"
    mappings.save(mapping, path, config, passphrase is not None, passphrase)
    return mappings.load(spark, path, passphrase).select("scope", "path", "category", "original", "replacement")


def mapping_file_json(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d, "m.json")


def mapping_file_sqlite(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d, "m.db")


def mapping_file_parquet(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d, "m.parquet")


def mapping_file_encrypted(spark: SparkSession, d: str) -> DataFrame:
    return _saved(spark, d, "m.json", PASSPHRASE)


def mapping_file_first_version(spark: SparkSession, d: str) -> DataFrame:
    """The older layout, plain strings by column."""
    pairs = {r.n_name: r.n_name.lower() for r in _t(spark, d, "nation").collect()}
    path = f"{_folder(spark)}/old.json"
    tables.dump_json({"mappings": {"n_name": {"category": "custom", "mapping": pairs}}}, path)
    return mappings.load(spark, path).select("scope", "path", "kind", "original", "replacement")


def mapping_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Of a mapping, an encrypted one and another file, those that go after a day and after an hour."""
    _, mapping, config = _tokens(spark, d)
    path = _folder(spark)
    mappings.save(mapping, f"{path}/m.json", config)
    mappings.save(mapping, f"{path}/n.json", config, True, PASSPHRASE)
    tables.dump_json({"a": 1}, f"{path}/notes.json")
    late = time.time() + 7200
    return _rows(spark, [(a, n) for a, days in (("day", 1.0), ("hour", 1 / 24)) for n in mappings.expire(path, days, late)], "age string, file string")


# --- planning ----------------------------------------------------------------------------------------


def _people(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    contact = F.struct(F.concat(F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email"), F.lit("home").alias("label"))
    return c.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("patient_name"), F.array(contact).alias("contacts"), F.col("c_mktsegment").alias("diagnosis")).alias("patient"), F.encode("c_name", "UTF-8").alias("phone"))


def _planned(spark: SparkSession, found: list[Target]) -> DataFrame:
    return _rows(spark, [(t.kind, t.path, t.category) for t in found], "kind string, path string, category string")


def plan_nested_paths(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, plan(_people(spark, d), Config(value_detection=False)).targets)


def plan_dotted_extras(spark: SparkSession, d: str) -> DataFrame:
    return _planned(spark, plan(_people(spark, d), Config(value_detection=False, extra_pii_columns=("patient.diagnosis",))).targets)


def plan_selection(spark: SparkSession, d: str) -> DataFrame:
    """One leaf out of several, either notation."""
    df, config = _people(spark, d), Config(value_detection=False)
    parts = [_planned(spark, plan(df, config, [s]).targets).withColumn("asked", F.lit(s)) for s in ("patient.contacts.email", "patient.contacts[*].email", "patient.patient_name")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def plan_skipped_types(spark: SparkSession, d: str) -> DataFrame:
    """Columns of types that cannot be processed are named, not changed."""
    return _rows(spark, [(p,) for p, _ in plan(_people(spark, d), Config(value_detection=False)).skipped], "path string")


def plan_user_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a user adds, alone and beside the built-in names."""
    df = _t(spark, d, "customer").withColumnRenamed("c_name", "full_name")
    rows = [(str(o).lower(), t.path, t.category) for o in (False, True) for t in plan(df, Config(value_detection=False, extra_pii_columns=("c_mktsegment",), override_defaults=o)).targets]
    return _rows(spark, rows, "alone string, path string, category string")


def plan_presets(spark: SparkSession, d: str) -> DataFrame:
    """Names that only a preset knows, and its locale."""
    df = _t(spark, d, "customer").select(F.col("c_name").alias("nama_ibu"), F.col("c_custkey").alias("no_kk"))
    rows = [(p or "none", t.path, t.category, Config(preset=p).resolved().locale) for p in (None, *PRESETS) for t in plan(df, Config(value_detection=False, preset=p)).targets]
    return _rows(spark, rows, "preset string, path string, category string, locale string")


def plan_late_json_leaf(spark: SparkSession, d: str) -> DataFrame:
    """A leaf that one document in all orders has is planned and replaced."""
    o = _t(spark, d, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0]
    text = F.when(F.col("o_orderkey") == last, F.to_json(F.struct(F.lit("a@x.org").alias("email")))).otherwise(F.to_json(F.struct(F.col("o_orderstatus").alias("status"))))
    out = process(o.select("o_orderkey", text.alias("doc")), Config(mode="redact", redact_style="full", value_detection=False, json_columns=("doc",)))[0]
    return out.select("o_orderkey", F.get_json_object("doc", "$.email").alias("email"), F.get_json_object("doc", "$.status").alias("status"))


def locale_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = [(",".join(c), detect.locale_hint(list(c))) for c in (("nik", "name"), ("name", "email"), ("Nama Lengkap",))]
    return _rows(spark, rows, "columns string, locale string")


# --- fakes -------------------------------------------------------------------------------------------


def _counts(spark: SparkSession, df: DataFrame, column: str, form: str) -> DataFrame:
    """Rows, distinct originals and fakes, own values, and fakes not of a form."""
    protected, mapping = process(df, Config(seed=11, value_detection=False))
    pairs = mapping.filter(F.col("path") == column)
    shown = protected.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(column).alias("n_fakes"))
    own = pairs.agg(F.count_distinct("original").alias("n_originals"), F.count_if(F.col("original") == F.col("replacement")).alias("n_own"), F.count_if(~F.col("replacement").rlike(form)).alias("n_other_form"))
    return shown.join(own)  # a row each


def fake_emails(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, _t(spark, d, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email")), "email", r"^[^@\s]+@[^@\s]+\.[a-z]+$")


def fake_phones(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, _t(spark, d, "customer").select(F.format_string("+62-81-%07d", "c_custkey").alias("phone")), "phone", r"[0-9]")


def fake_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, _t(spark, d, "customer").select(F.concat(F.lit("Street "), F.col("c_custkey").cast("string")).alias("address")), "address", r"[A-Za-z]")


def fake_generic_words(spark: SparkSession, d: str) -> DataFrame:
    """A column without a category of its own: the user's."""
    df = _t(spark, d, "part").select(F.col("p_name").alias("label"))
    targets = [_flat("label", "custom")]
    mapping = M.build({"": (df, targets)}, Config(seed=12))
    out = A.apply(df, targets, mapping)
    own = mapping.agg(F.count_distinct("original").alias("n_originals"), F.count_if(F.col("original") == F.col("replacement")).alias("n_own"))
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_fakes")).join(own)  # a row each


def fake_saturated_dates(spark: SparkSession, d: str) -> DataFrame:
    """Every day of 82 years as a date of birth: still one to one."""
    days = spark.range(30_000).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("dob"))
    return _counts(spark, days, "dob", r"^\d{4}-\d{2}-\d{2}$")


def fake_last_labels(spark: SparkSession, d: str) -> DataFrame:
    """One code whose shape has no other value gets a label."""
    df = _t(spark, d, "region").select("r_regionkey", F.lit("---").alias("member_code"))
    out = process(df, Config(value_detection=False))[0]
    return out.select("r_regionkey", (F.col("member_code") != "---").alias("replaced"), F.lit(out.select("member_code").distinct().count()).cast("long").alias("n_fakes"))


def shift_warnings(spark: SparkSession, d: str) -> DataFrame:
    """A value that is no date stays, and the run says so once."""
    df = _t(spark, d, "region").select(F.col("r_name").alias("dob"))
    run = process_frames({"a": df, "b": df}, Config(shift_days=3, value_detection=False))
    return _rows(spark, [(w.split(":")[0],) for w in run.warnings], "path string")


# --- mapping tables and restoring --------------------------------------------------------------------


def mapping_scopes(spark: SparkSession, d: str) -> DataFrame:
    run = process_frames({"c": _t(spark, d, "customer"), "s": _t(spark, d, "supplier")}, Config(mode="redact", match_strategy="fuzzy", value_detection=False))
    return _rows(spark, [(s, M.entries(run.mapping, s).count()) for s in M.scopes(run.mapping)], "scope string, entries long")


def mapping_lookup(spark: SparkSession, d: str) -> DataFrame:
    _, mapping, _ = _tokens(spark, d)
    asked = ["<PERSON_1>", "<PERSON_7>", "<PERSON_0>"]
    return _rows(spark, [(t, M.lookup(mapping, t, "c_name")) for t in asked], "token string, original string")


def mapping_refused(spark: SparkSession, d: str) -> DataFrame:
    """Which mapping of a mode that promises restoring is refused: the one with two originals for a token."""
    _, mapping, config = _tokens(spark, d)
    double = mapping.withColumn("replacement", F.when(F.col("replacement") == "<PERSON_2>", "<PERSON_1>").otherwise(F.col("replacement")))
    rows = []
    for name, m in (("sound", mapping), ("ambiguous", double)):
        try:
            M.check_saveable(m, config.lossless)
            rows.append((name, False))
        except M.MappingError:
            rows.append((name, True))
    return _rows(spark, rows, "mapping string, refused boolean")


def restore_one_column(spark: SparkSession, d: str) -> DataFrame:
    protected, mapping, _ = _tokens(spark, d)
    odd = protected.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("unknown")).otherwise(F.col("c_name")).alias("c_name"))
    return R.restore_values(odd, "c_name", mapping)


def restore_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Names in prose in another case, with an ending."""
    df = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Person"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"), F.lit(" Berra")).alias("supplier_name"))
    known = df.select(F.lit("").alias("scope"), F.lit("supplier_name").alias("column"), F.lit("flat").alias("kind"), F.lit("supplier_name").alias("path"), F.lit("name").alias("category"), F.lit("string").alias("original_dtype"), F.lit("string").alias("processed_dtype"), F.lit("string").alias("orig_type"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("original"), F.lit("string").alias("repl_type"), F.col("supplier_name").alias("replacement"))
    text = df.select("s_suppkey", F.concat(F.lit("saw "), F.upper("supplier_name"), F.lit("'s note")).alias("t"))
    return R.restore_text(text, "t", known.select(*M.COLUMNS), tolerant=True).select("s_suppkey", "restored")


def restore_sheets(spark: SparkSession, d: str) -> DataFrame:
    frames = {"c": _t(spark, d, "customer").select("c_custkey", "c_name"), "s": _t(spark, d, "supplier").select("s_suppkey", "s_name")}
    run = process_frames(frames, Config(seed=4, match_strategy="fuzzy", value_detection=False))
    back = restore_frames(run.frames, run.mapping)
    return back["c"].select(F.lit("c").alias("sheet"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(back["s"].select(F.lit("s").alias("sheet"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


def restore_chat_response(spark: SparkSession, d: str) -> DataFrame:
    """Tokens in the messages of a response."""
    _, mapping, _ = _tokens(spark, d)
    message = F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("hello "), F.col("replacement")).alias("content")))
    out = R.restore_messages(mapping.select("original", message.alias("messages")), "messages", mapping)
    return out.select("original", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("content"))


def leak_of_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Findings of a verified run over two frames, one of which keeps a copy of its names."""
    frames = {"c": _t(spark, d, "customer").select("c_name", F.col("c_name").alias("remark")), "s": _t(spark, d, "supplier").select("s_name")}
    run = process_frames(frames, Config(mode="redact", match_strategy="fuzzy", value_detection=False), {"c": ["c_name"], "s": ["s_name"]}, verify=True)
    rows = [(n, f.path, f.kind) for n, r in run.reports.items() for f in r.findings if f.kind != "shape"]
    return _rows(spark, rows, "sheet string, path string, kind string").select("sheet", "path").distinct()


def leak_processed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shapes are not sought in leaves that a run has processed."""
    df = _t(spark, d, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email"), F.concat(F.col("c_custkey").cast("string"), F.lit("@y.org")).alias("other"))
    targets = [_flat("email", "contact")]
    mapping = M.build({"": (df, targets)}, Config(seed=3))
    return _rows(spark, [(f.path,) for f in leak.check(A.apply(df, targets, mapping), targets, mapping).findings], "path string").distinct()


# --- gateway and chat --------------------------------------------------------------------------------


def _gateway(spark: SparkSession, d: str, restore_dir: str | None = None) -> gateway.Gateway:
    g = gateway.Gateway(Config(mode="redact", value_detection=False), restore_dir=restore_dir)
    g.add("customers", _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), "c_mktsegment"), gateway.Policy(keep=("id",)))
    return g


def gateway_list(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(x["name"], x["rows"], ",".join(x["columns"])) for x in _gateway(spark, d).list_datasets()], "name string, n_rows long, columns string")


def gateway_json_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of JSON text that the policy leaves; text that is no document becomes null."""
    doc = F.when(F.col("c_custkey") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("who"))))
    df = _t(spark, d, "customer").select("c_custkey", doc.alias("doc"))
    return gateway.project(df, gateway.Policy(keep=("c_custkey", "doc:segment")), set(), ("doc",))


def gateway_cells(spark: SparkSession, d: str) -> DataFrame:
    """Long strings are cut, dates come as text."""
    o = _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.repeat("o_orderpriority", 20).alias("long"))
    return o.select(*[gateway.cell(F.col(f.name), f.dataType, 40).alias(f.name) for f in o.schema])


def gateway_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Requests and how each is answered: refused or not."""
    g = _gateway(spark, d)
    asked: dict[str, Callable[[], object]] = {
        "known dataset": lambda: g.read_rows("customers", limit=1),
        "unknown dataset": lambda: g.read_rows("nobody"),
        "hidden column": lambda: g.read_rows("customers", ["c_mktsegment"]),
        "negative offset": lambda: g.read_rows("customers", offset=-1),
        "unknown mode": lambda: g.search_rows("customers", "full_name", "x", "like"),
        "sum of text": lambda: g.aggregate("customers", ["id"], [("sum", "full_name")]),
        "restoring without a folder": lambda: g.restore_to_file("x", "f.txt"),
        "shifted data": lambda: gateway.Gateway(Config(mode="shift")),
        "partial redaction": lambda: gateway.Gateway(Config(mode="redact", redact_style="partial")),
    }
    rows = []
    for name, call in asked.items():
        try:
            call()
            rows.append((name, False))
        except gateway.GatewayError:
            rows.append((name, True))
    return _rows(spark, rows, "request string, refused boolean")


def gateway_restores_to_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    g = _gateway(spark, d, path)
    told = g.restore_to_file("about <PERSON_1> and <PERSON_2>, not <PERSON_0>", "note.txt")
    with open(f"{path}/note.txt") as f:
        return _rows(spark, [(f.read(), told["restored"], oct(os.stat(f"{path}/note.txt").st_mode & 0o777))], "note string, restored long, mode string")


def scrub_and_restore_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents scrubbed, then their tokens turned back by the run's dictionary: the texts again."""
    df = _t(spark, d, "documents").select("doc_id", "text")
    out, table = scrub.scrub(df, "text", ["doc_id"], ["doc_id"])
    tokens = F.regexp_extract_all("text", F.lit(R.TOKEN), F.lit(0))
    pairs = out.select("doc_id", F.explode(F.array_distinct(tokens)).alias("token")).join(table, ["doc_id", "token"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("known"))
    whole = out.join(pairs, "doc_id", "left")
    parts = F.zip_with(F.split("text", R.TOKEN, -1), tokens, lambda gap, t: F.concat(gap, F.coalesce(F.try_element_at(F.col("known"), t), t, F.lit(""))))
    return whole.select("doc_id", F.sha2(F.when(F.col("known").isNull(), F.col("text")).otherwise(F.array_join(parts, "")), 256).alias("sha256"))


def scrub_chat(spark: SparkSession, d: str) -> DataFrame:
    """A chat request: the same value has one token in all its messages, parts of a list too."""
    messages = [{"role": "user", "content": "mail budi@x.com"}, {"role": "user", "content": [{"type": "text", "text": "again budi@x.com and ann@y.org"}]}]
    done, table = scrub.scrub_messages(messages)
    texts = [m["content"] if isinstance(m["content"], str) else m["content"][0]["text"] for m in done]
    return _rows(spark, [(t, len(table)) for t in texts], "text string, n_values long")


def stream_protect_restore(spark: SparkSession, d: str) -> DataFrame:
    """Customer as a stream in micro-batches under one growing mapping; turned back at the end."""
    base, folder = _t(spark, d, "customer").select("c_custkey", "c_name"), work_path(spark, "stream")
    for i in range(3):
        base.filter(F.pmod("c_custkey", F.lit(3)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = protect.protect_stream(stream, [_flat("c_name")], Config(mode="redact"), f"{folder}/mapping", f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    mapping = spark.read.parquet(f"{folder}/mapping").drop("batch")
    shown = spark.read.parquet(f"{folder}/out").drop("batch")
    back = R.restore(shown, mapping.select(*M.COLUMNS))
    return back.withColumn("n_tokens", F.lit(shown.select("c_name").distinct().count()).cast("long"))


QUERIES = {f.__name__: f for f in (
    source_formats, source_csv, source_tsv, source_json_array, source_ndjson, source_parquet, source_excel_sheets, source_sibling_files, source_text,
    mapping_file_json, mapping_file_sqlite, mapping_file_parquet, mapping_file_encrypted, mapping_file_first_version, mapping_expiry,
    plan_nested_paths, plan_dotted_extras, plan_selection, plan_skipped_types, plan_user_columns, plan_presets, plan_late_json_leaf, locale_hints,
    fake_emails, fake_phones, fake_addresses, fake_generic_words, fake_saturated_dates, fake_last_labels, shift_warnings,
    mapping_scopes, mapping_lookup, mapping_refused, restore_one_column, restore_tolerant, restore_sheets, restore_chat_response, leak_of_sheets, leak_processed_paths,
    gateway_list, gateway_json_keys, gateway_cells, gateway_refusals, gateway_restores_to_file, scrub_and_restore_documents, scrub_chat, stream_protect_restore,
)}

_NUMBERED = "SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM (SELECT DISTINCT c_name FROM customer WHERE c_name <> '')"
_MAPPING = f"SELECT '' AS scope, 'c_name' AS path, 'name' AS category, c_name AS original, '<PERSON_' || n || '>' AS replacement FROM ({_NUMBERED})"
_FAKES = "SELECT count(*) AS n_rows, count(DISTINCT {0}) AS n_fakes, count(DISTINCT {0}) AS n_originals, 0::BIGINT AS n_own{1} FROM {2}"
_PATHS = "('nested', 'patient.patient_name', 'name'), ('nested', 'patient.contacts[*].email', 'contact')"

ORACLE = {
    "source_formats": "SELECT * FROM (VALUES ('a.csv', 'csv'), ('b.TSV', 'csv'), ('c.xlsx', 'excel'), ('d.json', 'json'), ('e.ndjson', 'ndjson'), ('f.jsonl', 'ndjson'), ('g.parquet', 'parquet')) t(name, format)",
    "source_csv": "SELECT * FROM customer",
    "source_tsv": "SELECT * FROM supplier",
    "source_json_array": "SELECT * FROM nation",
    "source_ndjson": "SELECT event_id, user_id, event_type, value, props FROM events",
    "source_parquet": "SELECT * FROM part",
    "source_excel_sheets": "SELECT 'nation' AS sheet, n_nationkey::BIGINT AS key, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region",
    "source_sibling_files": "SELECT 'run_nation.csv' AS file, count(*) AS n_rows FROM nation UNION ALL SELECT 'run_region.csv', count(*) FROM region",
    "source_text": "SELECT 'first line' || chr(10) || r_name AS value FROM region",
    "mapping_file_json": _MAPPING,
    "mapping_file_sqlite": _MAPPING,
    "mapping_file_parquet": _MAPPING,
    "mapping_file_encrypted": _MAPPING,
    "mapping_file_first_version": "SELECT '' AS scope, 'n_name' AS path, 'flat' AS kind, n_name AS original, lower(n_name) AS replacement FROM nation",
    "mapping_expiry": "SELECT * FROM (VALUES ('hour', 'm.json'), ('hour', 'n.json')) t(age, file)",
    "plan_nested_paths": f"SELECT * FROM (VALUES {_PATHS}) t(kind, path, category)",
    "plan_dotted_extras": f"SELECT * FROM (VALUES {_PATHS}, ('nested', 'patient.diagnosis', 'custom')) t(kind, path, category)",
    "plan_selection": "SELECT * FROM (VALUES ('nested', 'patient.contacts[*].email', 'contact', 'patient.contacts.email'), ('nested', 'patient.contacts[*].email', 'contact', 'patient.contacts[*].email'), ('nested', 'patient.patient_name', 'name', 'patient.patient_name')) t(kind, path, category, asked)",
    "plan_skipped_types": "SELECT 'phone' AS path",
    "plan_user_columns": "SELECT * FROM (VALUES ('false', 'full_name', 'name'), ('false', 'c_mktsegment', 'custom'), ('true', 'c_mktsegment', 'custom')) t(alone, path, category)",
    "plan_presets": "SELECT * FROM (VALUES ('id', 'nama_ibu', 'name', 'id_ID'), ('id', 'no_kk', 'identifier', 'id_ID')) t(preset, path, category, locale)",
    "plan_late_json_leaf": "SELECT o_orderkey, CASE WHEN o_orderkey = m THEN '[REDACTED]' END AS email, CASE WHEN o_orderkey < m THEN o_orderstatus END AS status FROM orders, (SELECT max(o_orderkey) AS m FROM orders)",
    "locale_hints": "SELECT * FROM (VALUES ('nik,name', 'id_ID'), ('name,email', NULL), ('Nama Lengkap', 'id_ID')) t(columns, locale)",
    "fake_emails": _FAKES.format("c_custkey", ", 0::BIGINT AS n_other_form", "customer"),
    "fake_phones": _FAKES.format("c_custkey", ", 0::BIGINT AS n_other_form", "customer"),
    "fake_addresses": _FAKES.format("c_custkey", ", 0::BIGINT AS n_other_form", "customer"),
    "fake_generic_words": _FAKES.format("p_name", "", "part"),
    "fake_saturated_dates": "SELECT 30000::BIGINT AS n_rows, 30000::BIGINT AS n_fakes, 30000::BIGINT AS n_originals, 0::BIGINT AS n_own, 0::BIGINT AS n_other_form",
    "fake_last_labels": "SELECT r_regionkey, true AS replaced, 1::BIGINT AS n_fakes FROM region",
    "shift_warnings": "SELECT 'dob' AS path",
    "mapping_scopes": "SELECT 'c' AS scope, count(DISTINCT c_name) AS entries FROM customer UNION ALL SELECT 's', count(DISTINCT s_name) FROM supplier",
    "mapping_lookup": f"SELECT token, c_name AS original FROM (VALUES ('<PERSON_1>', 1), ('<PERSON_7>', 7), ('<PERSON_0>', 0)) t(token, k) LEFT JOIN ({_NUMBERED}) ON n = k",
    "mapping_refused": "SELECT * FROM (VALUES ('sound', false), ('ambiguous', true)) t(mapping, refused)",
    "restore_one_column": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE c_name END AS c_name FROM customer",
    "restore_tolerant": "SELECT s_suppkey, 'saw S' || s_suppkey || '''s note' AS restored FROM supplier",
    "restore_sheets": "SELECT 'c' AS sheet, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier",
    "restore_chat_response": "SELECT DISTINCT c_name AS original, 'assistant' AS role, 'hello ' || c_name AS content FROM customer WHERE c_name <> ''",
    "leak_of_sheets": "SELECT 'c' AS sheet, 'remark' AS path",
    "leak_processed_paths": "SELECT 'other' AS path",
    "gateway_list": "SELECT 'customers' AS name, count(*) AS n_rows, 'id,full_name' AS columns FROM customer",
    "gateway_json_keys": "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN '{\"segment\":\"' || c_mktsegment || '\"}' END AS doc FROM customer",
    "gateway_cells": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, substr(repeat(o_orderpriority, 20), 1, 40) || '…' AS long FROM orders",
    "gateway_refusals": "SELECT * FROM (VALUES ('known dataset', false), ('unknown dataset', true), ('hidden column', true), ('negative offset', true), ('unknown mode', true), ('sum of text', true), ('restoring without a folder', true), ('shifted data', true), ('partial redaction', true)) t(request, refused)",
    "gateway_restores_to_file": f"SELECT 'about ' || max(CASE WHEN n = 1 THEN c_name END) || ' and ' || max(CASE WHEN n = 2 THEN c_name END) || ', not <PERSON_0>' AS note, 2::BIGINT AS restored, '0o600' AS mode FROM ({_NUMBERED})",
    "scrub_and_restore_documents": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "scrub_chat": "SELECT * FROM (VALUES ('mail <EMAIL_1>', 2::BIGINT), ('again <EMAIL_1> and <EMAIL_2>', 2::BIGINT)) t(text, n_values)",
    "stream_protect_restore": "SELECT c_custkey, c_name, (SELECT count(DISTINCT c_name) FROM customer) AS n_tokens FROM customer",
}
