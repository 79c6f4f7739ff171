import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sablefold.llm import neighbours as N

from .helpers import oracle


def table(tmp_path, rows):
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("v", pa.int32()), ("score", pa.string())])
    full = [(i, v, 1, "x") for i, v in rows]
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True) if full else [[]] * 4, schema, strict=True)], schema=schema), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def random_rows(n, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(50, None), (100, [0.0] * 16), (150, [float("nan")] + [1.0] * 15), (200, [None] + [1.0] * 15), (250, [float("inf")] + [1.0] * 15), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (None, [1.0] * 16), (350, [])]


@pytest.mark.parametrize("rows", [random_rows(420), [], random_rows(3), ODD + [r for r in random_rows(260) if r[0] not in dict(ODD)], [(i, [1.0, 2.0, 3.0]) for i in range(120)]])
def test_equals_sql(spark, tmp_path, rows):
    d = table(tmp_path, rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in N.op8_neighbours(spark, d).collect())
    want = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in oracle(N.OP8_SQL, d, "embeddings"))
    assert got == want


def test_blocks_and_tiles_change_nothing(spark, tmp_path, monkeypatch):
    frame = spark.read.parquet(table(tmp_path, random_rows(300)) + "/embeddings.parquet")
    ask = frame.filter("vec_id % 3 = 0")
    whole = sorted(map(tuple, N.nearest(frame, ask, 4).collect()))
    assert whole == sorted(map(tuple, N.nearest(frame, ask, 4, block=17 * 16 * 13).collect()))
    by = {d: (np.array([0, 1]), x, N.Quantised(x), N.Heaps(2, 3)) for d, x in [(16, np.random.default_rng(1).normal(size=(2, 16)))]}
    monkeypatch.setattr(N, "TILE_QUERIES", 1)
    x = np.random.default_rng(2).normal(size=(40, 16))
    for i in range(0, 40, 7):
        N._tile(by[16], np.arange(10 + i, 10 + min(i + 7, 40)), x[i : i + 7])
    score = N.cosine(np.repeat(by[16][1], 40, axis=0), np.tile(x, (2, 1))).reshape(2, 40)
    assert np.array_equal(by[16][3].id, np.argsort(-score, axis=1)[:, :3] + 10)


def test_components_of_any_magnitude_take_part(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 8)) * 10.0 ** rng.choice([-310, -200, -20, 0, 20, 200, 300], 90)[:, None]
    x[3], x[4] = 5e-324, 1.7e308
    x[5] = [1e200, 1e-200, 0, 0, 0, 0, 0, 3e199]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in N.nearest(frame, frame.filter("vec_id % 10 = 0 or vec_id in (3, 4, 5)"), 4).collect())
    unit = N.scaled(x)
    want = []
    for q in sorted({*range(0, 90, 10), 3, 4, 5}):
        score = N.cosine(np.repeat(unit[q : q + 1], 90, axis=0), unit)
        best = sorted((i for i in range(90) if i != q), key=lambda i: (-score[i], i))[:4]
        want += [(q, r + 1, i, float(score[i])) for r, i in enumerate(best)]
    assert got == want and len(got) == 48
    with pytest.raises(ValueError):
        N.Quantised(np.array([[1.0, np.inf]]))


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 33)), rng.exponential(size=(60, 33)) ** 4
    qa, qb = N.Quantised(a), N.Quantised(b)
    near = N.product(qa.codes, qb.codes) * qa.scale[:, None] * qb.scale[None, :]
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert np.all(np.abs(near - true) <= qa.norm[:, None] * qb.error[None, :] + qa.error[:, None])
