import base64
import hashlib
import random

import pyarrow as pa
import pytest
from sablefold.llm import bpe

from .helpers import documents

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
ROWS = [(1, "Hello  world's 123 \n\n x", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (4, "naïve 😀 日本語 ß  z  ", "en", "s"), (4, "same id", "en", "s"), (None, " lead", "en", "s"), (7, "<|endoftext|> word " * 3, "en", "s"), (8, "a" * 3000 + " " * 700 + "é" * 600 + "\n" * 300, "en", "s"), (9, "the quick brown fox " * 3000, "en", "s"), (10, "tab\tand \t both \x1c x\r\n", "en", "s")]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


@pytest.mark.parametrize("rows", [ROWS, []])
def test_equals_the_library(spark, tmp_path, library, rows):
    got = sorted(map(tuple, bpe.op9_bpe(spark, documents(tmp_path, rows)).collect()), key=str)
    want = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_random_texts_equal_the_library(library):
    own = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(11)
    texts = ["".join(rng.choices("aeinrst'XÉ9 _.\t\n  ſ日😀", k=rng.randint(0, 120))) for _ in range(800)]
    ids = own.encode(pa.array(texts)).to_pylist()
    assert ids == [library.encode_ordinary(t) for t in texts]
    # both ways of merging agree
    for t in texts[:200]:
        for piece in own.pieces(t):
            raw = piece.encode()
            assert own.encode(pa.array([piece])).to_pylist()[0] == (own.merge(raw) if raw not in own.ranks else [own.ranks[raw]])


def test_another_vocabulary_and_other_columns(spark, tmp_path):
    path = tmp_path / "small.tiktoken"
    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abab", b"ba", b"bab"]
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
    docs = spark.createDataFrame([(1, "ababab", "x"), (2, None, "y")], "id int, body string, ids string")
    out = bpe.decode(bpe.encode(docs, str(path), P.PATTERN, "body"), str(path), P.PATTERN).orderBy("id").collect()
    assert [r.ids for r in out] == [[257, 256], []] and [bytes(r.decoded) for r in out] == [b"ababab", b""]
    assert tiktoken.Encoding("s", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={}).encode_ordinary("ababab") == [257, 256]


def test_another_pattern_is_followed(library):
    own = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), r"[a-z]+ [a-z]+|\s+|.")
    other = tiktoken.Encoding("other", pat_str=r"[a-z]+ [a-z]+|\s+|.", mergeable_ranks=own.ranks, special_tokens={})
    texts = ["the other words here", "of the", "  a b c  ", "", "in 9 to be"]
    assert own.encode(pa.array(texts)).to_pylist() == [other.encode_ordinary(t) for t in texts]


def test_a_full_store_keeps_what_is_used_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    own = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for i in range(12):
        texts = [f"zebrafishes qwertyuiop {i}xq{i * 7}zz " + " ".join(f"w{i}k{j}ord" for j in range(30)) for _ in range(2)]
        ids = own.encode(pa.array(texts))
        assert ids.to_pylist() == [library.encode_ordinary(t) for t in texts]
        assert [x.decode() for x in own.decode(ids).to_pylist()] == texts
    assert len(own.spans.slot) < 120 and " qwertyuiop" in own.spans.slot


def test_unknown_ids_have_no_bytes(library):
    own = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert own.decode(pa.array([[10**6, -3], [72, 10**6, 73], None, []], pa.list_(pa.int32()))).to_pylist() == [b"", library.decode_bytes([72, 73]), b"", b""]
