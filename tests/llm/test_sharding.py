import zlib

import numpy as np
import pytest
from sablefold.llm import sharding

from .helpers import documents

ROWS = [(i, f"text {i % 11} " * (i % 29), ["en", "fr", None, "de"][i % 4], f"s{i % 6}") for i in range(250)] + [(None, None, None, None), (9, "", "en", ""), (9, "", "en", "")]


def test_curve_visits_every_cell_in_steps_of_one():
    for dims, bits in ((2, 3), (3, 2)):
        points = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert_index(points, bits)
        assert sorted(index) == list(range(len(points)))
        path = points[np.argsort(index)]
        assert np.all(np.abs(np.diff(path, axis=0)).sum(axis=1) == 1)


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[:3]])
def test_law_rows(spark, tmp_path, rows):
    got = sharding.op3_sharding(spark, documents(tmp_path, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, []).append(t or "")
    for r in got:
        assert any((r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id])
        assert r.law == "rows" and r.grown_shard is None


def test_equal_texts_lie_side_by_side(spark, tmp_path):
    """A group is split only by the cuts between shards."""
    got = sorted(sharding.op3_sharding(spark, documents(tmp_path, ROWS)).collect(), key=lambda r: (r.shard, r.slot))
    order = [(r.size, r.text_crc32) for r in got]
    runs = [x for i, x in enumerate(order) if i == 0 or x != order[i - 1]]
    assert len(runs) == len(set(runs))
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.op3_sharding(spark, documents(tmp_path, ROWS)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_shards_prune_on_each_dimension(spark, tmp_path):
    # no text occurs twice: copies lie side by side whatever their languages and sources are
    rows = [(i, "x" * int(v) + f"{i:04d}", "en" if i % 2 else "fr", f"s{(i * 7) % 16:02d}") for i, v in enumerate(np.random.default_rng(3).integers(1, 4000, 1600))]
    got = sharding.op3_sharding(spark, documents(tmp_path, rows)).collect()
    source, lang = {r[0]: r[3] for r in rows}, {r[0]: r[2] for r in rows}

    def boxes(shard):
        """Mean share of the size range, the sources and the languages that a shard touches."""
        by = {}
        for r in got:
            by.setdefault(shard(r), []).append(r)
        return [np.mean(x) for x in zip(*[((max(r.size for r in v) - min(r.size for r in v)) / 4000, len({source[r.doc_id] for r in v}) / 16, len({lang[r.doc_id] for r in v}) / 2) for v in by.values()], strict=True)]

    cut, unsorted = boxes(lambda r: r.shard), boxes(lambda r: r.doc_id * 2654435761 % 2**32 * 16 >> 32)
    assert all(a < b for a, b in zip(cut, unsorted, strict=True)) and np.prod(cut) < np.prod(unsorted) / 4


def test_names_are_ranked_by_their_whole_value(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"common-crawl-snapshot-{'abcd'[i % 4]}") for i in range(400)] + [(1000, "x", "en", None)]
    docs = spark.read.parquet(documents(tmp_path, rows) + "/documents.parquet")
    assert sorted(map(tuple, sharding.ranks(docs, "source", 3).collect())) == [(f"common-crawl-snapshot-{c}", 100 * i) for i, c in enumerate("abcd")]
    source, by = {r[0]: r[3] for r in rows}, {}
    for r in sharding.op3_sharding(spark, str(tmp_path)).collect():
        by.setdefault(r.shard, set()).add(source[r.doc_id])
    assert np.mean([len(v) for v in by.values()]) < 2
