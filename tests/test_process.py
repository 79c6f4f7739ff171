import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from sablefold.api import Config, gazetteer, process, process_frames, restore, restore_frames
from sablefold.functions import values as V
from sablefold.operators import leak
from sablefold.operators import mapping as M
from sablefold.plans.planner import Target

PLAIN = dict(value_detection=False)
REDACT = dict(mode="redact", **PLAIN)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    data = [(rng.choice(["Ann Lee", "Bo Ray", "", None, "Ünal Ö'x"]), f"u{i % 7}@x.org", 10_000 + i % 9, float(i) / 4, dt.date(1960, 1, 1) + dt.timedelta(days=i * 37), dt.datetime(2000, 1, 2, 3, 4, 5, i), "keep") for i in range(60)]
    return spark.createDataFrame(data, "name string, email string, phone long, card_number double, dob date, date_of_birth timestamp_ntz, note string")


@pytest.mark.parametrize("config", [Config(seed=3, **PLAIN), Config(redact_style="token", **REDACT), Config(**REDACT)])
def test_round_trip_of_types(people, config):
    protected, mapping = process(people, config)
    assert M.bijective(mapping).filter("not bijective").count() == 0
    if config.mode == "fake":
        assert protected.schema.simpleString() == people.schema.simpleString()
    assert mapping.filter("original = replacement").count() == 0
    assert rows(restore(protected, mapping)) == rows(people)
    before, after = rows(people), rows(protected)
    assert len(before) == len(after) and all(r[-1] == "keep" for r in after)
    # nulls and empty strings stay, everything else changes
    assert sorted(str(r[0]) for r in before if not r[0]) == sorted(str(r[0]) for r in after if not r[0])


def test_tokens_are_numbered_in_order_over_scopes(spark):
    a = spark.createDataFrame([("b",), ("a",), ("10",), ("9",)], "name string")
    b = spark.createDataFrame([("a",), ("z",), ("Z",)], "name string")
    run = process_frames({"s1": a, "s2": b}, Config(**REDACT))
    got = {(r.scope, r.original): r.replacement for r in run.mapping.collect()}
    assert got == {("s1", "10"): "<PERSON_1>", ("s1", "9"): "<PERSON_2>", ("s1", "a"): "<PERSON_3>", ("s1", "b"): "<PERSON_4>", ("s2", "a"): "<PERSON_3>", ("s2", "Z"): "<PERSON_5>", ("s2", "z"): "<PERSON_6>"}
    back = restore_frames(run.frames, run.mapping)
    assert rows(back["s2"]) == rows(b)


def test_two_columns_take_two_tokens_each(spark):
    df = spark.createDataFrame([("x", "y"), ("y", "x")], "name string, email string")
    _, mapping = process(df, Config(redact_style="token", **REDACT))
    assert {r.replacement for r in mapping.collect()} == {f"REDACTED_000{i}" for i in range(1, 5)}


@pytest.mark.parametrize("width,n", [(2, 90), (3, 900)])
def test_dense_codes(spark, width, n):
    df = spark.range(n).select(F.lpad((F.col("id") + 10 ** (width - 1)).cast("string"), width, "0").alias("member_code"))
    protected, mapping = process(df, Config(seed=1, **PLAIN))
    m = {r.original: r.replacement for r in mapping.collect()}
    assert len(m) == n == len(set(m.values())) and all(a != b and len(b) == width and b.isdigit() for a, b in m.items())
    assert rows(restore(protected, mapping)) == rows(df)


def test_all_letter_pairs_and_dense_integers(spark):
    pairs = spark.range(676).select(F.concat(F.char(F.lit(65) + F.floor(F.col("id") / 26)), F.char(F.lit(65) + F.col("id") % 26)).alias("member_code"))
    m = {r.original: r.replacement for r in process(pairs, Config(**PLAIN))[1].collect()}
    assert len(set(m.values())) == 676 and all(a != b and b.isalpha() and len(b) == 2 for a, b in m.items())
    ints = spark.range(100, 1000).select(F.col("id").alias("member_code"))
    protected, mapping = process(ints, Config(**PLAIN))
    assert protected.distinct().count() == 900 and mapping.filter("original = replacement").count() == 0 and protected.dtypes == ints.dtypes


def test_many_dates(spark):
    df = spark.range(30_000).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "dd/MM/yyyy").alias("dob"))
    _, mapping = process(df, Config(**PLAIN))
    assert mapping.select("replacement").distinct().count() == 30_000 and mapping.filter("original = replacement").count() == 0
    assert mapping.filter(~F.col("replacement").rlike(r"^\d{2}/\d{2}/\d{4,5}$")).count() == 0


def test_shapes_of_identifiers(spark):
    values = ["ABCDEF", "M-001", "ab-Cd 12", "JKT/2024/0042", "x", "---"]
    m = {r.original: r.replacement for r in process(spark.createDataFrame([(v,) for v in values], "member_code string"), Config(seed=9, **PLAIN))[1].collect()}
    kind = lambda c: "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
    assert all([kind(c) for c in a] == [kind(c) for c in b] for a, b in m.items() if a != "---") and all(a != b for a, b in m.items())


def test_same_person_same_fake(spark):
    df = spark.createDataFrame([("Ann", "Ann"), ("Bo", "Cy")], "patient_name string, member_name string")
    got = process(df, Config(**PLAIN))[0].collect()
    assert got[0].patient_name == got[0].member_name and len({got[0].patient_name, got[1].patient_name, got[1].member_name}) == 3
    again = process(df, Config(**PLAIN))[0].collect()
    assert sorted(again) == sorted(got)
    other = spark.createDataFrame([("Budi",)], "nama string")
    assert process(other, Config(locale="id_ID", **PLAIN))[0].first() != process(other, Config(**PLAIN))[0].first()


def test_project_reuse(spark):
    a, b = spark.createDataFrame([("Ann",), ("Bo",)], "name string"), spark.createDataFrame([("Bo",), ("Cy",)], "name string")
    for config in (Config(**PLAIN), Config(**REDACT)):
        first = process(a, config)[1]
        second = process(b, config, known=first)[1]
        one, two = ({r.original: r.replacement for r in m.collect()} for m in (first, second))
        assert two["Bo"] == one["Bo"] and two["Cy"] not in one.values()
        assert M.extend(first, second).count() == 3


def test_nested_json_and_prose(spark):
    doc = json.dumps({"patient_name": "Ann", "n": 1, "contact": {"phone": "555", "tags": ["Ann", None]}}, ensure_ascii=False)
    df = spark.createDataFrame([(1, ("Ann", [("a@x.org", "home"), (None, "work")]), doc, "yesterday Adra Belan saw Bo here"), (2, None, "not json", None), (3, ("", []), None, "")], "id long, patient struct<full_name:string,contacts:array<struct<email:string,label:string>>>, payload string, note string")
    config = Config(json_columns=("payload",), ner=True, **PLAIN)
    run = process_frames({"default": df}, config, find_names=gazetteer())
    out = {r.id: r for r in run.frames["default"].collect()}
    assert {t.path for t in run.plans["default"].targets} == {"patient.full_name", "patient.contacts[*].email", "payload:patient_name", "payload:contact.phone", "note"}
    assert out[1].patient.full_name != "Ann" and out[1].patient.contacts[0].email != "a@x.org" and out[1].patient.contacts[1].email is None and out[1].patient.contacts[0].label == "home"
    got = json.loads(out[1].payload)
    assert got["patient_name"] not in ("Ann", None) and got["contact"]["tags"] == ["Ann", None] and got["n"] == 1 and out[2].payload == "not json" and out[3].payload is None
    assert "Adra Belan" not in out[1].note and out[1].note.startswith("yesterday ")
    assert {r.id: r for r in restore(run.frames["default"], run.mapping).collect()} == {r.id: r for r in df.collect()}


def test_shift_and_perturb(spark):
    df = spark.createDataFrame([("1990-01-01", dt.date(1990, 1, 15), 100, "12.5", "words"), ("31/12/1999", None, -7, "0042", None)], "dob string, birth_date date, phone long, card_no string, name string")
    out = sorted(process(df, Config(shift_days=10, **PLAIN))[0].collect(), key=str)
    assert {r.dob for r in out} == {"1990-01-11", "10/01/2000"} and out[0].birth_date in (None, dt.date(1990, 1, 25)) and {r.name for r in out} == {"words", None}
    run = process_frames({"default": df}, Config(perturb_pct=0.1, seed=2, **PLAIN))
    got = sorted(run.frames["default"].collect(), key=lambda r: r.phone)
    assert 90 <= got[1].phone <= 110 and got[1].phone != 100 and 11 <= float(got[1].card_no) <= 14 and got[1].name == "words" and run.warnings


def test_empty_frames_and_odd_columns(spark):
    df = spark.createDataFrame([], "name string, `a.b` string, __value string")
    for config in (Config(**PLAIN), Config(**REDACT)):
        protected, mapping = process(df, config)
        assert protected.columns == df.columns and protected.count() == 0 and mapping.count() == 0 and restore(protected, mapping).count() == 0
    odd = spark.createDataFrame([("Ann", "k", 1)], "name string, `x y` string, rank int")
    assert process(odd, Config(**PLAIN))[0].columns == odd.columns


def test_leak_check_and_audit(spark, tmp_path):
    df = spark.createDataFrame([(f"Person {i}", f"Person {i}" if i < 3 else "n", f"a{i}@x.org") for i in range(9)], "name string, note string, where_to string")
    run = process_frames({"default": df}, Config(**REDACT), ["name"], verify=True)
    report = run.reports["default"]
    assert {(f.kind, f.path) for f in report.findings} == {("original", "note"), ("shape", "where_to")} and [f.count for f in report.findings if f.kind == "original"] == [3]
    text = leak.audit_text(run.audit) + json.dumps(run.audit) + report.summary()
    assert "Person" not in text and "x.org" not in text and run.audit["targets"][0]["unique_count"] == 9
    assert all((tmp_path / f"r_audit.{e}").exists() for e in ("json", "txt")) if leak.write_audit(run.audit, str(tmp_path / "r")) else False
    clean = process_frames({"default": df.select("name")}, Config(**REDACT), verify=True)
    assert clean.reports["default"].clean


def test_ambiguous_mappings_are_refused(spark):
    df = spark.createDataFrame([("Ann Lee 12",), ("Bob Lee 12",)], "name string")
    protected, mapping = process(df, Config(redact_style="partial", **REDACT))
    with pytest.raises(M.MappingError) as e:
        M.check_saveable(mapping, True)
    assert "Lee" not in str(e.value)
    assert rows(restore(protected, mapping)) == rows(protected)


def test_value_functions(spark):
    df = spark.createDataFrame([("abcd",), ("abcdefgh",), (None,)], "v string")
    assert [r[0] for r in df.select(V.redact_partial(F.col("v"))).collect()] == ["XXXX", "XXXXefgh", None]
    assert [V.token_label(f) for f in ("work_email", "phone", "full_name", "x")] == ["EMAIL", "PHONE", "PERSON", "PII"]
    assert [r[0] for r in spark.createDataFrame([(12345678.5,), (3.0,)], "v double").select(V.as_text(F.col("v"), spark.range(1).select(F.lit(1.0)).schema[0].dataType)).collect()] == ["12345678.5", "3.0"]


def test_mapping_tables(spark):
    t = [Target("flat", "name", "name", "name", "string")]
    a = M.build({"": (spark.createDataFrame([("Ann",), ("Bo",)], "name string"), t)}, Config(**REDACT))
    b = M.build({"": (spark.createDataFrame([("Bo",)], "name string"), t)}, Config(redact_style="full", **REDACT))
    assert rows(M.merge(a, b).select("original", "replacement")) == [("Bo", "[REDACTED]")]
    assert M.extend(a, b).count() == 2 and M.lookup(a, "<PERSON_1>") == "Ann" and M.lookup(a, "none") is None and M.scopes(a) == [""]


def test_large_ranks_equal_windows(spark, monkeypatch):
    from sablefold import work

    df = spark.range(500).select(F.col("id") % 3, (F.col("id") * 7 % 11).alias("v"), "id").toDF("g", "v", "id")
    small = rows(work.ranked(df, ["g"], [F.col("v"), F.col("id")], "r"))
    whole = rows(work.ranked(df, [], [F.col("v"), F.col("id")], "r"))
    monkeypatch.setattr(work, "WINDOW_ROWS", 50)
    assert rows(work.ranked(df, ["g"], [F.col("v"), F.col("id")], "r")) == small and rows(work.ranked(df, [], [F.col("v"), F.col("id")], "r")) == whole


def test_leaves_and_names_that_come_late_are_planned(spark):
    """Personal data first seen after thousands of rows is planned like any other, on every run."""
    docs = [(i, '{"status": "open", "n": 1}', "nothing at all here") for i in range(3000)] + [(3000, '{"contact": {"email": "a@x.org"}}', "yesterday Adra Belan came by")]
    df = spark.createDataFrame(docs, "id long, doc string, note string").repartition(5, "id")
    config = Config(json_columns=("doc",), ner=True, **REDACT)
    run = process_frames({"default": df}, config, find_names=gazetteer())
    assert {t.path for t in run.plans["default"].targets} == {"doc:contact.email", "note"}
    last = run.frames["default"].filter("id = 3000").first()
    assert "a@x.org" not in last.doc and "Adra" not in last.note
    assert rows(restore(run.frames["default"], run.mapping)) == rows(df)


def test_many_nulls_join_in_several_tasks(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 50 == 0, F.concat(F.lit("P"), F.col("id").cast("string"))).alias("name")).repartition(6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        protected, mapping = process(df, Config(**REDACT))
        parts = [r["count"] for r in protected.groupBy(F.spark_partition_id()).count().collect()]
        assert len(parts) > 2 and max(parts) < 2500
        assert rows(restore(protected, mapping)) == rows(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_candidates_are_made_by_many_tasks(spark):
    sizes = spark.createDataFrame([("real", "99999.99", 300_001), ("int", "9", 9)], "gen string, shape string, wanted long")
    made = M._numbers(sizes, 32)
    assert made.groupBy("gen").agg(F.count_distinct("k").alias("n"), F.min("k").alias("least"), F.max("k").alias("most")).orderBy("gen").collect() == [("int", 9, 0, 8), ("real", 300_001, 0, 300_000)]
    tasks = [r[0] for r in made.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(tasks) > 2 and max(tasks) < 200_000
