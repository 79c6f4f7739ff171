import re

import pytest
from pyspark.sql import functions as F
from sablefold.llm import secrets_ledger as S
from sablefold.llm.common import folder

from .helpers import documents, oracle, same

KEY = "AKIA" + "B" * 16
ROWS = [
    (1, 'é password = "abcdefgh1" and API_KEY:zzzzzzzzzz; ' + KEY, "en", "x"),
    (2, "secret=token: longenough99 token='short' passwd:12345678", "en", "x"),
    (3, None, "en", None),
    (4, "", "en", "x"),
    (5, "0123456789abcdef" * 3 + "g deadbeef ſecret=abcdefgh", "en", "x"),
    (5, "0123456789abcdef" * 3 + "g deadbeef ſecret=abcdefgh", "en", "x"),
    (6, "😀 token=" + "f" * 40 + " AKIA123 " + KEY + KEY, "en", "y"),
    (None, "apikey=aaaaaaaa", "en", "y"),
    (8, "word " * 20000 + "secret: " + "q" * 5000, "en", "y"),
]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_equals_sql(spark, tmp_path, rows):
    d = documents(tmp_path, rows)
    same(S.op6_secret_scans(spark, d), oracle(S.OP6_SQL, d, "documents"))


def test_equals_python(spark, tmp_path):
    d = documents(tmp_path, ROWS)
    rules = [("assign", re.compile(S.RULES[0].pattern, re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in S.op6_secret_scans(spark, d).collect():
        found = [(m.start(), i, kind, m.end()) for i, (kind, p, g, n) in enumerate(rules) for m in p.finditer(texts[r.doc_id]) if len(m[g]) >= n]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_ledger_scans_only_unseen_blobs(spark, tmp_path):
    d = documents(tmp_path, ROWS)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ledger = folder(spark, "ledger")
    assert S.scan_unseen(docs, ledger).count() == len({r[1] or "" for r in ROWS})
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("token=0123456789")))
    assert S.scan_unseen(more, ledger).count() == len({r[1] or "" for r in ROWS}) + 1
    assert S.scan_unseen(more, ledger).groupBy("blob").count().filter("count > 1").count() == 0
    # a new rule version scans all again, beside the old rows
    assert S.scan_unseen(docs, ledger, rule_version="base-2").count() == len({r[1] or "" for r in ROWS})
    assert S.join_paths(more, S.read_ledger(spark, ledger, S.RULE_VERSION)).count() == more.count()


def test_redaction_removes_every_span(spark, tmp_path):
    docs = spark.read.parquet(documents(tmp_path, ROWS) + "/documents.parquet")
    clean = S.redact_documents(docs, folder(spark, "ledger"))
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    text = " ".join(r.text or "" for r in clean.collect())
    assert KEY not in text and "abcdefgh1" not in text and "short" in text
    assert {r.doc_id: r.text for r in clean.collect()}[1] == "é [assign]\" and [assign]; [access]"


def test_many_findings_in_one_text(spark, tmp_path):
    rows = [(1, " ".join(f"token={'a' * 9}{i} x{KEY} " + "0f" * 20 for i in range(700)), "en", "s"), (2, None, None, None)]
    d = documents(tmp_path, rows)
    same(S.op6_secret_scans(spark, d), oracle(S.OP6_SQL, d, "documents"))


def test_second_run_scans_nothing(spark, tmp_path):
    docs = spark.read.parquet(documents(tmp_path, ROWS) + "/documents.parquet")
    ledger = folder(spark, "ledger")
    first = S.scan_unseen(docs, ledger)
    rows = first.count()
    # other rules under the same version: no blob is scanned again, so the findings stay
    second = S.scan_unseen(docs, ledger, (S.Rule("none", "(?!)"),))
    assert second.count() == rows and second.exceptAll(first).count() == 0
    # two runs at once may both have written a blob; its paths still come once
    again = S.join_paths(docs, first.unionByName(second))
    assert again.count() == docs.count()
