import pytest
from pyspark.sql import functions as F
from sablefold.llm import mixing

from .helpers import documents, oracle, same

ROWS = [(1, "a b c", "en", "x"), (2, None, "en", "x"), (3, "", None, None), (4, "one two\tthree\nfour  five", "de", "y"), (4, "one two\tthree\nfour  five", "de", "y"), (None, "p q r s", "en", None), (7, " lead and trail ", "en", "z"), (8, "w " * 500, "en", "z")]


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[:1], [(i, "w " * (i % 37), "en", f"s{i % 5}") for i in range(300)]])
def test_equals_sql(spark, tmp_path, rows):
    d = documents(tmp_path, rows)
    same(mixing.op2_mixing(spark, d), oracle(mixing.OP2_SQL, d, "documents"))


def _fill(sizes, weights, cap):
    """The resharing as the words say it: round after round."""
    left, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        free -= set(over)
    return target


def test_targets_equal_rounds_of_resharing(spark):
    sizes = [5, 1000, 1, 0, 80, 80, 3, 2000, 17]
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.water_fill(frame).orderBy("source").collect()]
    assert got == pytest.approx(_fill(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))], 3))
    assert sum(got) == pytest.approx(sum(sizes))


def test_taken_words_meet_targets(spark, tmp_path):
    d = documents(tmp_path, [(i, "w " * ((i * 7919) % 211), "en", f"s{i % 4}") for i in range(400)])
    out = mixing.op2_mixing(spark, d)
    doc = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    for r in out.join(doc, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 1
    assert out.filter("taken > 3 * size").count() == 0


def test_corpus_has_the_words_taken(spark, tmp_path):
    d = documents(tmp_path, ROWS)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixing.op2_mixing(spark, d).select(F.sum("taken")).first()[0]
    assert all(any((r.text or "").startswith(m.text or "") for r in docs.collect()) for m in mixed.collect())
