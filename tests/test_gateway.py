"""Serving protected copies, scrubbing prose, restoring prose, and continuous input."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F
from sablefold.config import Config
from sablefold.functions.names import gazetteer
from sablefold.operators import gateway as G
from sablefold.operators import restore as R
from sablefold.operators import scrub as S
from sablefold.operators.process import process
from sablefold.plans.planner import Target
from sablefold.streaming.protect import protect_stream, scrub_stream

CANARY = "Zyxwv Canary"


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    df = spark.createDataFrame([(i, f"{CANARY} {i}", ["red", "blue", None][i % 3], {"phone": f"+62-812-000-{i:04d}", "note": f"{CANARY} {i}"}, json.dumps({"full_name": f"{CANARY} {i}", "size": i}), float(i)) for i in range(120)], "id int, full_name string, color string, box struct<phone:string,note:string>, doc string, price double")
    gate = G.Gateway(Config(mode="redact", json_columns=("doc",), value_detection=False), restore_dir=str(tmp_path_factory.mktemp("restored")))
    gate.add("people", df, G.Policy(keep=("id", "color", "price")))
    return gate


def test_no_original_in_any_answer(served):
    answers = [served.list_datasets(), served.describe("people"), served.read_rows("people"), served.read_rows("people", offset=100), served.search_rows("people", "full_name", "canary"), served.aggregate("people", ["full_name"])]
    said = json.dumps(answers, default=str)
    assert "Canary" not in said and "812-000" not in said
    # what the policy doesn't name is not shown at all
    row = served.read_rows("people", limit=1)["rows"][0]
    assert set(row["box"]) == {"phone"} and set(json.loads(row["doc"])) == {"full_name"}


def test_pages_search_and_groups(served):
    page = served.read_rows("people", ["id"], 110, 1000)
    assert [r["id"] for r in page["rows"]] == list(range(110, 120)) and page["total"] == 120 and not page["has_more"]
    assert len(served.read_rows("people", ["id"])["rows"]) == G.MAX_ROWS and served.read_rows("people", ["id"], 0, 0)["has_more"]
    assert served.search_rows("people", "color", "RED")["total"] == 40 and served.search_rows("people", "color", "RED", case_sensitive=True)["total"] == 0
    assert served.search_rows("people", "color", "re", "equals")["total"] == 0 and served.search_rows("people", "color", ".")["total"] == 0
    groups = served.aggregate("people", ["color"], [("count", None), ("sum", "price"), ("n_unique", "id"), ("min", "price"), ("max", "price"), ("mean", "price")])
    assert [g["color"] for g in groups] == [None, "blue", "red"] and sum(g["sum_price"] for g in groups) == sum(range(120))
    told = {c["column"]: c for c in served.describe("people")["columns"]}
    assert told["color"]["nulls"] == 40 and told["color"]["distinct"] == 3 and told["full_name"]["faked"] and not told["id"]["faked"] and told["box"]["distinct"] is None


def test_refusals(served, spark):
    for call in (lambda: served.read_rows("nobody"), lambda: served.read_rows("people", ["secret"]), lambda: served.read_rows("people", offset=-1), lambda: served.search_rows("people", "box", "x"), lambda: served.aggregate("people", ["color"], [("sum", "full_name")]), lambda: served.aggregate("people", ["color"], [("count", None), ("count", None)]), lambda: served.aggregate("people", ["color"], [("median", "price")])):
        with pytest.raises(G.GatewayError):
            call()
    for config in (Config(mode="shift"), Config(perturb_pct=0.1), Config(mode="redact", redact_style="partial")):
        with pytest.raises(G.GatewayError):
            G.Gateway(config)
    with pytest.raises(G.GatewayError):
        G.Gateway(Config(mode="redact", value_detection=False)).add("x", spark.range(3), G.Policy())


def test_restored_text_goes_to_a_private_file(served):
    token = served.search_rows("people", "id", "7", "equals")["rows"][0]["full_name"]
    told = served.restore_to_file(f"ask {token}", "a.txt")
    path = os.path.join(served.restore_dir, "a.txt")
    assert told == {"name": "a.txt", "restored": 1} and stat.S_IMODE(os.stat(path).st_mode) == 0o600
    with open(path) as f:
        assert f.read() == f"ask {CANARY} 7"
    for name in ("a.txt", "../b.txt", ".hidden"):
        with pytest.raises(G.GatewayError):
            served.restore_to_file("x", name)


def test_long_cells_are_cut(spark):
    df = spark.createDataFrame([("x" * 600, [["y"]])], "t string, deep array<array<string>>")
    assert df.select(G.cell(F.col("t"), df.schema["t"].dataType)).first()[0] == "x" * 500 + "…"
    assert G.project(df, G.Policy(keep_unmatched=True), set()).columns == ["t"]


def test_scrubbed_spans(spark):
    text = "Mail a.b@x.org or call +62 812-3456-7890; card 4111 1111 1111 1111, again a.b@x.org from 10.0.0.1"
    clean, table = S.scrub_string(text)
    assert clean == "Mail <EMAIL_1> or call <PHONE_2>; card <CARD_3>, again <EMAIL_1> from <IP_4>" and len(table) == 4
    more, table = S.scrub_messages([{"role": "user", "content": [{"type": "text", "text": "c@y.org a.b@x.org"}, {"type": "image"}]}, {"role": "user", "content": None}], table)
    assert more[0]["content"][0]["text"] == "<EMAIL_5> <EMAIL_1>" and more[1]["content"] is None
    df = spark.createDataFrame([("s", 1, text), ("s", 2, "a.b@x.org"), ("t", 1, "nobody"), ("t", 2, None)], "session string, turn int, text string")
    out, _ = S.scrub(df, "text", ["session"], ["turn"])
    assert {(r.session, r.turn): r.text for r in out.collect()} == {("s", 1): clean, ("s", 2): "<EMAIL_1>", ("t", 1): "nobody", ("t", 2): None}


def test_prose_is_restored_once_and_longest_first():
    pairs = {"Ada": "Bo", "Ada Belan": "Ann Lee", "Bo": "Cy"}
    assert R.restore_string("Ada Belan met Ada, Adas and Bo", pairs)[0] == "Ann Lee met Bo, Bos and Cy"
    done, spans, _ = R.restore_string("Ada Belan met Adas", pairs, boundary=True)
    assert done == "Ann Lee met Adas" and spans == [(0, 7, "Ann Lee")]
    done, _, unclear = R.restore_string("ADA's friend Belan, and Kim", {"Ada Belan": "Ann Lee", "Kim Ota": "Bo Ray", "Kim Ito": "Cy Fox"}, tolerant=True)
    assert done == "Ann's friend Lee, and Kim" and unclear == ["kim"]


def test_prose_in_blocks_equals_one_block(spark, monkeypatch):
    names = spark.createDataFrame([(f"Name{i}",) for i in range(60)], "full_name string")
    mapping = process(names, Config(seed=2, value_detection=False))[1]
    fakes = [r.replacement for r in mapping.orderBy("original").collect()]
    text = spark.createDataFrame([(" and ".join(fakes[i : i + 7]) + fakes[0],) for i in range(0, 50, 5)] + [("",), (None,)], "t string")
    want = sorted(r.restored or "" for r in R.restore_text(text, "t", mapping).collect())
    monkeypatch.setattr(R, "BLOCK", 25)
    assert sorted(r.restored or "" for r in R.restore_text(text, "t", mapping).collect()) == want and "Name0" in want[-1]


@pytest.mark.parametrize("tolerant", [True, False])
def test_words_in_prose_are_joined(spark, monkeypatch, tolerant):
    fakes = {"Ada Belan": "Ann Lee", "Kim Ota": "Bo Ray", "Kim Ito": "Cy Fox", "<PERSON_1>": "Di Low", "***": "star", "O'Neil": "Ed", "Nikos ΑΣ": "Σam Y", "Eve": "Flo", "EVE ONE": "Gil", "one two three-four": "Hal"}
    texts = ["ADA's friend Belan, and Kim", "Ada Belan met Adas, KIM OTA's and ada  belan", "x<PERSON_1> <person_1> *** a***b ****", "o'neil's Neil O'Neil O", "Nikos ΑΣ's νικος ας", "eve one Eve's ONE", "one two three-four one two three", "", None, "none"]
    mapping = spark.createDataFrame([("p", o, f) for f, o in fakes.items()], "path string, original string, replacement string")
    text = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [(i, *(R.restore_string(t, fakes, True, tolerant)[:2] if t else (t, []))) for i, t in enumerate(texts)]
    for limit in ("DIRECT", "BLOCK"):
        monkeypatch.setattr(R, limit, 3)
        got = R.restore_text(text, "t", mapping, True, tolerant).orderBy("i").collect()
        assert [(r.i, r.restored, [tuple(s) for s in r.spans]) for r in got] == want


def test_messages_are_restored(spark):
    names = spark.createDataFrame([("Ann",), ("Bo",)], "full_name string")
    mapping = process(names, Config(mode="redact", value_detection=False))[1]
    df = spark.createDataFrame([(1, [("user", "<PERSON_1> and <PERSON_2> and <PERSON_9>"), ("bot", None)]), (2, [])], "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: [m.content for m in r.messages] for r in R.restore_messages(df, "messages", mapping).collect()}
    assert got == {1: ["Ann and Bo and <PERSON_9>", None], 2: []}


def test_names_in_prose(spark):
    find = gazetteer()
    text = "yesterday Adra Belan saw a number"
    assert [text[a:b] for a, b in find(text)] == ["Adra Belan"]


def test_streams_equal_batches(spark, tmp_path):
    source = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame([(f"s{i % 2}", part, f"u{(i + part) % 4}@x.org wrote") for i in range(8)], "session string, turn int, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: spark.readStream.schema("session string, turn int, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    at = lambda n: str(tmp_path / n)
    target = Target("flat", "text", "text", "contact", "string")
    protect_stream(stream(), [target], Config(mode="redact"), at("map"), at("out"), at("check")).awaitTermination()
    mapping = spark.read.parquet(at("map"))
    assert mapping.count() == 4 == mapping.select("replacement").distinct().count() == mapping.select("original").distinct().count()
    assert spark.read.parquet(at("out")).groupBy("text").count().count() == 4
    back = R.restore(spark.read.parquet(at("out")).drop("batch"), mapping.drop("batch"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, spark.read.parquet(str(source)).collect()))
    scrub_stream(stream(), "text", "session", ["turn"], at("dict"), at("scrubbed"), at("check2")).awaitTermination()
    tokens = spark.read.parquet(at("dict"))
    assert tokens.groupBy("session", "value").count().filter("count > 1").count() == 0 and tokens.groupBy("session", "token").count().filter("count > 1").count() == 0
    assert spark.read.parquet(at("scrubbed")).filter(F.col("text").rlike("^<EMAIL_[0-9]+> wrote$")).count() == 24
