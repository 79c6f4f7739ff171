"""Files by extension, workbooks, mapping files of every kind, expiry, and the command line over them."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F
from sablefold import cli
from sablefold.config import Config, parse_age
from sablefold.operators.process import process
from sablefold.operators.mapping import COLUMNS
from sablefold.sources import crypto, documents, mappings, tables
from sablefold.work import written

ROWS = [(1, "Ann Lee", "ann@x.org", 1.5), (2, 'Bo "B" Ray, Jr', None, 2.0), (3, "Ümit\nÖz", "u@x.org", None)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "id bigint, full_name string, email string, score double")


def plain(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("ext", ["csv", "tsv", "json", "ndjson", "jsonl", "parquet", "xlsx"])
def test_single_files_round_trip(spark, people, tmp_path, ext):
    path = str(tmp_path / f"t.{ext}")
    tables.write(people, path)
    back = tables.read(spark, path).select("id", "full_name", "email", "score")
    assert os.path.isfile(path) and [(int(a), b, c, d) for a, b, c, d in plain(back)] == ROWS


@pytest.mark.parametrize("ext", ["csv", "json", "ndjson", "parquet"])
def test_folders_of_parts_round_trip(spark, people, tmp_path, ext):
    path = str(tmp_path / f"t.{ext}")
    tables.write(people.filter("id < 3"), path, single=False)
    read = spark.read.json if ext in ("json", "ndjson") else lambda p: tables.read(spark, p)
    assert plain(read(path).select("id", "full_name", "email", "score")) == ROWS[:2]


def test_sheets_and_unknown_formats(spark, people, tmp_path):
    book = str(tmp_path / "b.xlsx")
    tables.write_sheets({"one": people, "two": people.filter("id = 1")}, book)
    got = tables.read(spark, book, all_sheets=True)
    assert list(got) == ["one", "two"] and got["two"].count() == 1
    assert tables.read(spark, book, ["two"]).count() == 1 and tables.read(spark, book).count() == 3
    assert [os.path.basename(p) for p in tables.write_sheets(got, str(tmp_path / "s.csv"))] == ["s_one.csv", "s_two.csv"]
    with pytest.raises(ValueError, match="Unsupported file format: .doc"):
        tables.read(spark, "x.doc")
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(ValueError, match="Failed to read JSON file"):
        tables.read(spark, str(tmp_path / "bad.json"))


@pytest.mark.parametrize("name,encrypt", [("m.parquet", False), ("m.json", False), ("m.json", True), ("m.db", False), ("m.db", True)])
def test_mapping_files_round_trip(spark, people, tmp_path, name, encrypt):
    config = Config(seed=1, value_detection=False)
    mapping = process(people, config, ["full_name", "score"])[1]
    path = str(tmp_path / name)
    mappings.save(mapping, path, config, encrypt, "pass" if encrypt else None)
    back = mappings.load(spark, path, "pass" if encrypt else None)
    assert plain(back) == plain(mapping)
    if os.path.isfile(path):
        assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    if encrypt:
        with open(path, "rb") as f:
            assert b"Ann" not in f.read()
        with pytest.raises(crypto.CryptoError):
            mappings.load(spark, path, "other")


@pytest.mark.parametrize("name,encrypt", [("m.json", False), ("m.db", False), ("m.json", True), ("m.db", True)])
def test_mapping_files_take_no_rows_as_results(spark, tmp_path, monkeypatch, name, encrypt):
    rows = spark.range(3000).select(*[F.lit(c).alias(c) for c in COLUMNS[:8] if c != "path"], F.when(F.col("id") < 9, "a").otherwise("ü").alias("path"), F.format_string("%040d\n", "id").alias("original"), F.lit("string").alias("repl_type"), F.format_string('<"%d">', "id").alias("replacement"))
    mapping, path = written(rows.select(*COLUMNS).withColumn("orig_type", F.lit("string")).withColumn("original_dtype", F.lit("string")).withColumn("processed_dtype", F.lit("string")), "m"), str(tmp_path / name)
    for f in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(mapping), f, None)
    collect, most = type(mapping).collect, []
    monkeypatch.setattr(type(mapping), "collect", lambda df: most.append(len(got := collect(df))) or got)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda s, data, *a, made=type(spark).createDataFrame: most.append(len(data)) or made(s, data, *a))
    monkeypatch.setattr(documents, "CHUNK", 1000)
    monkeypatch.setattr(crypto, "CHUNK", 1000)  # several files of chunks
    mappings.save(mapping, path, Config(mode="redact"), encrypt, "pass" if encrypt else None)
    assert mappings.created_at(path) is not None
    back = mappings.load(spark, path, "pass" if encrypt else None)
    assert max(most, default=0) <= 1 and sorted(map(tuple, collect(back))) == sorted(map(tuple, collect(mapping)))
    if encrypt:
        with open(path) as f:
            doc = json.load(f)
        assert len(doc["chunks"]) > 256
        for changed in (doc["chunks"][:-1], doc["chunks"][1::-1] + doc["chunks"][2:]):
            with open(path, "w") as f:
                json.dump(doc | {"chunks": changed}, f)
            with pytest.raises(crypto.CryptoError):
                mappings.load(spark, path, "pass")


def test_documents_are_read_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(documents, "CHUNK", 3)
    made = tmp_path / "d.json"
    entry = {"pairs": [[{"t": "int", "v": 12345}, {"t": "bool", "v": True}]], "scope": "", "column": "c", "category": "x", "kind": "flat", "path": "c", "original_dtype": "bigint", "processed_dtype": "boolean"}
    made.write_text(json.dumps({"mappings": [entry, entry | {"pairs": []}], "version": 2.0, "created_at": None}, indent=3))
    assert [(r[0], r[7:]) for r in mappings._read_json(str(made))] == [("", ("bigint", "12345", "boolean", "true"))]
    assert mappings.created_at(str(made)) == os.path.getmtime(made)
    for bad in ('{"mappings": [1, 2}', '{"mappings": []} x', '["mappings"]', "", '{"a": 1}', '{"mappings": [],}', "{1: 2}"):
        made.write_text(bad)
        assert mappings.created_at(str(made)) is None and not crypto.is_envelope(str(made))


def test_first_version_and_undecodable_pairs(spark, tmp_path):
    old = tmp_path / "v1.json"
    old.write_text(json.dumps({"mappings": {"name": {"category": "name", "mapping": {"A": "B"}}, "plain": {"C": "D"}}}))
    assert {(r.column, r.category, r.original, r.replacement) for r in mappings.load(spark, str(old)).collect()} == {("name", "name", "A", "B"), ("plain", "custom", "C", "D")}
    entry = {"scope": "", "column": "c", "category": "custom", "kind": "flat", "path": "c", "original_dtype": "string", "processed_dtype": "string", "pairs": [[{"t": "str", "v": "a"}, {"t": "str", "v": "b"}], [{"t": "str"}, None]]}
    new = tmp_path / "v2.json"
    new.write_text(json.dumps({"version": "2.0", "mappings": [entry]}))
    assert [(r.original, r.replacement) for r in mappings.load(spark, str(new)).collect()] == [("a", "b")]


def test_expiry_touches_mappings_only(spark, people, tmp_path):
    config = Config(mode="redact", value_detection=False)
    mappings.save(process(people, config, ["full_name"])[1], str(tmp_path / "m.json"), config)
    (tmp_path / "notes.json").write_text('{"a": 1}')
    (tmp_path / "notes.txt").write_text("mapping")
    assert mappings.expire(str(tmp_path), parse_age("7d")) == []
    gone = mappings.expire(str(tmp_path), parse_age("24h"), now=os.path.getmtime(tmp_path / "m.json") + 2 * 86400)
    assert [os.path.basename(p) for p in gone] == ["m.json"] and sorted(os.listdir(tmp_path)) == ["notes.json", "notes.txt"]


def test_command_line(spark, people, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("SABLEFOLD_CONFIG", str(tmp_path / "config.yaml"))
    at = lambda n: str(tmp_path / n)
    tables.write(people, at("in.parquet"))
    assert cli.main(["process", at("in.parquet"), "--output", at("out.parquet"), "--mapping-out", at("m.json"), "--mode", "redact", "--audit-out", at("run")]) == 0
    shown = spark.read.parquet(at("out.parquet"))
    assert shown.filter(F.col("full_name").rlike("^<PERSON_[0-9]+>$")).count() == 3
    assert cli.main(["restore", at("out.parquet"), "--mapping", at("m.json"), "--output", at("back.parquet")]) == 0
    assert plain(spark.read.parquet(at("back.parquet"))) == plain(people)
    with open(at("run_audit.json")) as f:
        assert "Ann" not in f.read()
    token = shown.filter("id = 1").first().full_name
    (tmp_path / "note.txt").write_text(f"{token} called")
    assert cli.main(["restore", at("note.txt"), "--mapping", at("m.json"), "--output", at("note.out"), "--text"]) == 0
    assert (tmp_path / "note.out").read_text() == "Ann Lee called"
    capsys.readouterr()
    assert cli.main(["columns", "add", "badge"]) == 0 and "badge" in capsys.readouterr().out
    assert cli.main(["columns", "remove", "badge"]) == 0 and "badge" not in capsys.readouterr().out
    assert cli.main(["presets", "list"]) == 0 and cli.main(["detect", at("in.parquet")]) == 0
    assert "full_name" in capsys.readouterr().out
    assert cli.main(["project", "init", at("p.json")]) == 0 and cli.main(["project", "add", at("p.json"), "--from", at("m.json")]) == 0
    assert cli.main(["project", "status", at("p.json")]) == 0 and mappings.load(spark, at("p.json")).count() == mappings.load(spark, at("m.json")).count()


def test_every_query_has_its_sql():
    from sablefold import queries

    assert set(queries.ORACLE) <= set(queries.QUERIES) and len(queries.QUERIES) > 90
    assert set(queries.QUERIES) - set(queries.ORACLE) <= {"scrub_documents"}
