import pytest
from pyspark.sql import functions as F
from sablefold.config import Config
from sablefold.functions import values as V
from sablefold.operators import detect as D
from sablefold.patterns import NAMES
from sablefold.plans.planner import detection_frame, plan


def strings(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns))


def test_name_matching():
    p = list(NAMES)
    assert D.match_name("Patient Name", p) == ("patient_name", "name")
    assert D.match_name("Patient Name", p, "exact") is None
    assert [D.match_name(n, p, "fuzzy") for n in ("username", "filename", "company_name")] == [None] * 3
    assert D.match_name("patients_full_name_2024", p, "fuzzy")[1] == "name" and D.match_name("phone_number", p, "fuzzy")[1] == "contact"


@pytest.mark.parametrize("strategy", ["exact", "normalized", "fuzzy"])
def test_names_frame_equals_the_function(spark, strategy):
    names = ["Patient Name", "email", "username", "company_name", "phone-number", "the_phone_number", "x", "NAMA", "card number 2"]
    got = {r.name: (r.pattern, r.category) for r in D.names_frame(spark.createDataFrame([(n,) for n in names], "name string"), list(NAMES), strategy).collect()}
    assert got == {n: m for n in names if (m := D.match_name(n, list(NAMES), strategy))}


def test_checksums(spark):
    row = spark.range(1).select(*[V.luhn_ok(F.lit(x)).alias(f"l{i}") for i, x in enumerate(("4111111111111111", "5500000000000004", "4111111111111112"))], *[V.nik_ok(F.lit(x)).alias(f"n{i}") for i, x in enumerate(("3174051209900001", "0014051209900001", "3174055209900001"))]).first()
    assert list(row) == [True, True, False, True, False, True]


def test_shapes_of_values(spark):
    df = strings(spark, a=["John", "Jane", "Bob"], b=["a@x.com", "b@y.org", "not-an-email"], c=["4111111111111111", None, "x"])
    stats = D.scan(df)
    assert stats.shapes("a") == [] and stats.shapes("b")[0][0] == "email" and dict(stats.shapes("c"))["credit_card"] == 0.5
    assert D.scan(df.limit(0)).shapes("b") == []


def test_confidence_and_locale(spark):
    df = strings(spark, email=["a@x.com", "b@y.org"], col_7=["c@x.com", "d@y.org"])
    report = {r["column"]: r for r in D.confidence_report(df)}
    assert report["email"]["confidence"] == 1.0 and report["col_7"]["confidence"] == 0.5 and not report["col_7"]["name_match"]
    assert D.locale_hint(["nik", "name"]) == "id_ID" and D.locale_hint(["name", "email"]) is None


def test_selection_and_skipped_types(spark):
    df = spark.sql("select 'a' name, 'b' note, cast(1.5 as decimal(5,2)) phone, true email, struct('x' as name, 'y' as other) person")
    p = plan(df, Config(value_detection=False))
    assert [t.path for t in p.targets] == ["name", "person.name"] and [s[0] for s in p.skipped] == ["phone", "email"] and len(p.warnings) == 2
    assert [t.path for t in plan(df, Config(), []).targets] == []
    assert [t.path for t in plan(df, Config(), ["note", "person.other"]).targets] == ["note", "person.other"]
    assert [t.path for t in plan(df, Config(strict_paths=True, value_detection=False)).targets] == ["name"]
    assert "custom" in {t.category for t in plan(df, Config(extra_pii_columns=("note", "person.other"), value_detection=False)).targets}


def test_list_paths_with_and_without_marks(spark):
    df = spark.sql("select struct('A' as patient_name, array(struct('e@x.org' as email), struct('f@x.org' as email)) as contacts) patient, 1L id")
    found = [t.path for t in plan(df, Config(value_detection=False)).targets]
    assert found == ["patient.patient_name", "patient.contacts[*].email"]
    for chosen in ("patient.contacts.email", "patient.contacts[*].email"):
        assert [t.path for t in plan(df, Config(value_detection=False), [chosen]).targets] == ["patient.contacts[*].email"]


def test_dry_run_counts(spark):
    got = detection_frame(strings(spark, email=["a@x.com", "a@x.com", "", None]), Config(value_detection=False)).collect()
    assert [(r.path, r.unique_count) for r in got] == [("email", 1)]


def test_config():
    assert Config(shift_days=3).resolved().mode == "shift" and Config(preset="id").resolved().locale == "id_ID"
    assert Config().lossless and not Config(mode="redact", redact_style="full").lossless
    with pytest.raises(ValueError):
        Config(mode="nothing")
