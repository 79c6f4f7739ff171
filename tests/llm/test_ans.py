import io
import zlib

import numpy as np
import pytest
from sablefold.llm import ans
from sablefold.llm.common import folder

from .helpers import documents

P = pytest.importorskip("public_tokenizers")
ROWS = [(5, "Hello  World's 123!", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (9, "naïve É 😀 日本語 z\x0b\x1c y\x85 é", "en", "s"), (9, "same id", "en", "s"), (None, "no id", "en", "s"), (7, "<|endoftext|>word <|EndOfText|> Up " * 3, "en", "s"), (8, "the quick brown fox " * 30_000, "en", "s")]


@pytest.mark.parametrize("rows", [ROWS, [], [(i * 7 % 97, "w " * (i % 5), "en", "s") for i in range(97)]])
def test_files_hold_the_librarys_ids(spark, tmp_path, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    coded = [(d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x, *_ in rows]
    got = sorted((tuple(r) for r in ans.op10_token_ids(spark, documents(tmp_path, rows)).collect()), key=lambda r: r[1])
    # ascending, without gaps; rows of one id in any order
    assert [r[0] for r in got] == sorted((d for d, _ in coded), key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((d, n, crc) for d, _, n, crc in got), key=key) == sorted(((d, len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for d, own in coded), key=key)


def _table(ids):
    return ans.Table(*np.unique(np.asarray(ids, np.int64), return_counts=True))


@pytest.mark.parametrize("n", [0, 1, ans.LANES - 1, ans.LANES, ans.LANES + 1, 50_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.pareto(0.5, n) * 3).astype(np.int64) % 50_000
    tab = _table(ids)
    assert np.array_equal(ans.decode_block(tab, ans.encode_block(tab, ids)), ids)
    if n:
        assert int(tab.freq.sum()) == 1 << ans.SCALE
        same = np.full(n, 7)
        assert np.array_equal(ans.decode_block(_table(same), ans.encode_block(_table(same), same)), same)


def test_blocks_near_the_entropy():
    ids = np.random.default_rng(1).geometric(0.1, ans.BLOCK)
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    bits = -(counts * np.log2(counts)).sum() * len(ids)
    assert len(ans.encode_block(_table(ids), ids)) * 8 < bits * 1.02 + 64 * ans.LANES + 100


class _Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_checkpoints_and_damage(monkeypatch):
    monkeypatch.setattr(ans, "BLOCK", 3000)
    ids = np.random.default_rng(2).integers(0, 300, 20_000)
    tab, lengths = _table(ids), np.array([0, 7000, 1, 12_999])
    raw = b"".join(ans.pack_file(tab, [None, 1, 2, 2], lengths, iter(np.array_split(ids, 7))))
    r = ans.Reader(_Source(raw), tab)
    for first, n in ((0, 1), (2999, 2), (5000, 9000), (19_999, 1), (0, 20_000)):
        assert np.array_equal(r.ids(first, n), ids[first : first + n])
    docs = list(r.documents())
    assert [d[:2] for d in docs] == [(None, 0), (1, 0), (2, 7000), (2, 7001)] and np.array_equal(np.concatenate([d[2] for d in docs]), ids)
    for at in (0, 12, 40, len(raw) // 2, len(raw) - 2):
        bad = bytearray(raw)
        bad[at] ^= 64
        with pytest.raises((ans.AnsError, zlib.error)):
            list(ans.Reader(_Source(bytes(bad)), tab).documents())
    with pytest.raises(ans.AnsError):
        list(ans.Reader(_Source(raw[:-9]), tab).documents())


def test_many_files_keep_global_starts(spark):
    rows = [(i, list(range(i % 50))) for i in range(500)]
    tokens = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    tab, target = ans.count_ids(tokens), folder(spark, "ids")
    listed = ans.write_tokens(tokens, tab, target, 40)
    out = ans.read_tokens(listed, tab, target).orderBy("doc_id").collect()
    assert [list(r.ids) for r in out] == [r[1] for r in rows]
    assert [r.start for r in out] == [sum(len(x[1]) for x in rows[:i]) for i in range(500)]


@pytest.mark.parametrize("same", [False, True])
def test_files_are_bounded_by_ids(spark, same):
    rng = np.random.default_rng(5)
    rows = [(7 if same else i, rng.integers(0, 90, n).tolist()) for i, n in enumerate([0, 0, 400, 3, 0, 99, 100, 101, 250, 1, 1, 1] * 9)]
    tokens = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    tab, target = ans.count_ids(tokens), folder(spark, "ids")
    listed = ans.write_tokens(tokens, tab, target, 50, 100)
    files = listed.collect()
    assert all(f.n_ids <= 100 or f.n_docs == 1 for f in files) and sum(f.n_docs for f in files) == len(rows)
    out = sorted(ans.read_tokens(listed, tab, target).collect(), key=lambda r: (r.start, r.n_tokens))
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]
    assert sorted((r.doc_id, list(r.ids)) for r in out) == sorted(rows)
    if same:  # one id spreads over runs
        assert len({f.file for f in files}) > 1
