import zlib

import corpus_pipeline
import numpy as np
import pytest
from sablefold.llm import language as L

from .helpers import documents

WORDS = {"aa": ["kala", "mato", "suri", "tane"], "bb": ["ßtrog", "münz", "kraft", "zwölf"], "cc": ["señor", "niño", "llave", "queso"]}


def rows(n=240):
    rng = np.random.default_rng(2)
    out = [(i, " ".join(rng.choice(WORDS[lang], 30)), lang, "s") for i, lang in enumerate(np.resize(list(WORDS), n))]
    return [*out, (1001, None, "aa", "s"), (1002, "123 ... \n", "aa", "s"), (1003, "", None, "s"), (1004, "queso niño " * 4000, None, "s"), (None, "ßtrog kraft zwölf münz", "cc", "s"), (7, out[7][1], "bb", None), (7, out[7][1], "bb", None)]


def test_held_out_accuracy(spark, tmp_path):
    all_rows = rows()
    got = L.op7_language_id(spark, documents(tmp_path, all_rows)).collect()
    assert len(got) == len(all_rows)
    true = {r[0]: r[2] for r in all_rows[:240]}
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert held and all(r.lang_pred == true[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3
    assert by[1004].lang_pred == "cc" and by[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_predictions_ignore_held_out_labels(spark, tmp_path):
    base = rows()
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    changed = [(d, t, "aa" if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else lang, "other") for d, t, lang, s in base]
    key = lambda r: (r[0] is None, r[0] or 0)
    one, two = (sorted(map(tuple, L.op7_language_id(spark, documents(tmp_path / x, y)).collect()), key=key) for x, y in (("a", base), ("b", changed)))
    assert one == two


@pytest.mark.parametrize("some", [[], [(1, "some text", None, "s"), (2, None, "en", "s")]])
def test_without_labels_all_is_unknown(spark, tmp_path, some):
    got = L.op7_language_id(spark, documents(tmp_path, some)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * len(some)


def test_kernel_equals_sets():
    texts = ["abc abd", "xyz", "abc", "ß é"]
    bits = np.stack([L.presence(t) for t in texts])
    sets = [set(np.flatnonzero(b)) for b in bits]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert L.kernel(bits, bits)[i, j] == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, rel=1e-6)


def test_fit_is_bounded(spark, tmp_path):
    docs = spark.read.parquet(documents(tmp_path, rows(600)) + "/documents.parquet")
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null")
    assert len(L._chosen(labelled, 60)) <= 60
    # one id, one text: the bound holds
    same = labelled.limit(1).crossJoin(spark.range(500)).drop("id")
    assert len(L._chosen(labelled.unionByName(same), 60)) <= 60


def test_fit_equals_the_textbook():
    texts = [(" ".join(np.random.default_rng(i).choice(WORDS[lang], 6)), lang) for i, lang in enumerate(np.resize(list(WORDS), 40).tolist())]
    bits, langs = np.stack([L.presence(t) for t, _ in texts]), [lang for _, lang in texts]
    sets = [set(np.flatnonzero(b)) for b in bits]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    own = np.unique(np.linspace(0, 39, 15).astype(int))
    # features whose products are the kernel's projection on the landmarks
    values, vectors = np.linalg.eigh(k[np.ix_(own, own)])
    z = np.hstack([k[:, own] @ vectors @ np.diag(values**-0.5), np.ones((40, 1))])
    weight = np.array([1 / langs.count(x) for x in langs])
    want = np.zeros((40, 3))
    for c, lang in enumerate(sorted(WORDS)):
        y = np.array([1.0 if x == lang else -1.0 for x in langs])
        want[:, c] = z @ np.linalg.solve(z.T @ (z * weight[:, None]) + L.RIDGE * np.eye(z.shape[1]), z.T @ (y * weight))
    model = L.fit_bits(bits, langs, landmarks=15)
    assert np.allclose(model.scores(bits, model.landmarks()), want, atol=1e-4)


def test_pipeline_rejects_what_no_language_claims(spark, tmp_path):
    junk = ["это русский текст о погоде и о городе", "これは日本語の文章です", "xq 9931 @@ ## k", "0x9f 0xbb 7788"]
    known = rows()
    docs = spark.read.parquet(documents(tmp_path, known + [(2000 + i, t, None, "s") for i, t in enumerate(junk)]) + "/documents.parquet")
    model = L.fit(docs)
    marks = model.landmarks().astype(np.float32)
    margin = lambda t: max(model.scores(L.presence(t)[None], marks)[0])
    want = [(d, t) for d, t, *_ in known if L.has_letter(t) and margin(t) > 0]
    assert len(want) == sum(L.has_letter(r[1]) for r in known)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
