import hashlib
import random

import pytest
from sablefold.llm import fingerprints as P

from .helpers import documents

ROWS = [(5, "the same text " * 30, "en", "x"), (2, "😀é" * 100, "en", "x"), (9, None, None, None), (7, "", "en", "x"), (3, "abc", "en", "y"), (4, "the same text " * 30, "en", "y"), (11, "z" * 30_000, "en", "y"), (11, "another under one id", "en", "y"), (None, "no id", "en", "z")]


@pytest.mark.parametrize("rows", [ROWS, [], ROWS[:1], [(i * 3 % 101, f"text {i} " * (i % 17), "en", "s") for i in range(101)]])
def test_equals_brute_force(spark, tmp_path, rows):
    got = P.op5_fingerprints(spark, documents(tmp_path, rows)).collect()
    order = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        k = len(t) // 4
        other = (t[:-k] if k else t) + following[:k]
        want.append((d, len(t), hashlib.sha256(other.encode()).hexdigest(), P.fingerprint(t), P.fingerprint(other), P.likeness(P.fingerprint(t), P.fingerprint(other)), P.likeness(P.fingerprint(t), P.fingerprint(following))))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_small_ranges_agree_with_one(spark, tmp_path):
    docs = spark.read.parquet(documents(tmp_path, [(i * 7 % 503, f"{i}" * (i % 40), "en", "s") for i in range(503)] + [(5, "again", "en", "s")] * 20) + "/documents.parquet")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    each = lambda d, t, n: {"a": f"{d}:{t}", "b": n}
    assert sorted(map(tuple, P.with_next(docs, each, schema, 3).collect())) == sorted(map(tuple, P.with_next(docs, each, schema, 10_000).collect()))


def test_span_equality_and_extensions_equal_string_comparison():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rng.choices("abé😀", k=rng.randint(0, 60))) for _ in range(2))
        b = b + a[rng.randint(0, 10) :]
        x, y = P.PrefixHashes(a), P.PrefixHashes(b)
        for _ in range(30):
            i, j, n = rng.randint(0, len(a)), rng.randint(0, len(b)), rng.randint(0, 30)
            assert x.same(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert x.extension(i, y, j) == k


def test_likeness_follows_the_common_parts():
    text = "".join(random.Random(1).choices("abcdefgh ", k=4000))
    f = P.fingerprint
    assert P.likeness(f(text), f(text)) == 1
    assert 0.7 <= P.likeness(f(text), f(text[:3000] + "#" * 1000)) <= 0.76
    assert 0.7 <= P.likeness(f(text), f("#" * 1000 + text[1000:])) <= 0.76
    assert P.likeness(f(text), f("#" * 4000)) == 0 == P.likeness(f(text), f(""))
    assert P.likeness(f(text), f(text + text[:500])) > 0.8
    # edits near both ends leave the middle, which neither head nor tail reaches
    assert P.likeness(f(text), f("#" + text[1:3990] + "#" * 10)) > 0.9
    assert 0.4 <= P.likeness(f(text), f("#" * 1000 + text[1000:3000] + "%" * 1000)) <= 0.5
    # as far from the end, not from the beginning
    assert 0.3 <= P.likeness(f(text), f("#" * 1500 + text[1000:3000] + "%" * 1000)) <= 0.5
    assert all(pow(a, p - 2, p) * a % p == 1 for p, a in zip(P.PRIMES, P.BASES, strict=True))


def test_likeness_equals_comparing_the_texts():
    rng = random.Random(9)
    for _ in range(200):
        a = "".join(rng.choices("ab", k=rng.randint(0, 300)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 9)] = rng.choices("abc", k=rng.randint(0, 9))
        b = "".join(b)
        step, n, m = max(P.step_of(len(a)), P.step_of(len(b))), len(a), len(b)
        held = set()
        for i in range(min(n, m) // step):
            if a[i * step : (i + 1) * step] == b[i * step : (i + 1) * step]:
                held.update(range(i * step, (i + 1) * step))
            if a[n - (i + 1) * step : n - i * step] == b[m - (i + 1) * step : m - i * step]:
                held.update(range(max(n, m) - (i + 1) * step, max(n, m) - i * step))
        want = 1.0 if a == b else min(len(held), n, m) / max(n, m)
        assert P.likeness(P.fingerprint(a), P.fingerprint(b)) == want == P.likeness(P.fingerprint(b), P.fingerprint(a))
