import random

import numpy as np
import pytest
from sablefold.llm import neardup as D

from .helpers import documents


def sets_of(rows, k):
    out = []
    for _, t, *_ in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for w in words if w]
        out.append({tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set())
    return out


def brute(rows, k, num, den):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = sets_of(rows, k)
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return [(r[0], len(sets[i]), low.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def edited(rng, words, n, new="v"):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"{new}{rng.randint(0, 10**9)}"
    return " ".join(out)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = lambda n: rng.choices(vocabulary, k=n)
    texts = [" ".join(base(rng.randint(5, 120))) for _ in range(150)]
    for _ in range(25):  # pairs and small groups
        b = base(rng.randint(60, 300))
        texts += [" ".join(b)] + [edited(rng, b, rng.choice([1, 2, len(b) // 60 + 1])) for _ in range(rng.randint(1, 4))]
    hub = base(200)  # copies link the original only
    texts += [" ".join(hub)] + [edited(rng, hub, 4) for _ in range(150)]
    line = " ".join(base(40))  # a passage that many share
    texts += [line + " " + " ".join(base(60)) for _ in range(60)]
    texts += ["same text again"] * 40 + ["one", "One", "two words", "two  words", "", None, " \n\t", None]
    texts += ["Long " + "x y z " * 8000, "long " + "x y z " * 8000 + "end"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], (rows[1][0], "another text under a known id", "en", "s"), (None, texts[0], "en", "s"), (None, "nobody's only text here", "en", "s"), (None, "nobody's only text here", "en", "s")]


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, tmp_path, k, num):
    rows = corpus()
    docs = spark.read.parquet(documents(tmp_path, rows) + "/documents.parquet")
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute(rows, k, num, 100), key=key)
    assert sorted(map(tuple, D.group_documents(docs, k, num, 100).collect()), key=key) == want
    # large components are dealt out and give the same groups
    assert sorted(map(tuple, D.group_documents(docs, k, num, 100, bulk=6000).collect()), key=key) == want


def test_links_across_chunks_of_a_passage_family(spark, tmp_path):
    k, num = 5, 80
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(180)]
    texts = []
    for d in range(220):  # alike through the passage, below the threshold
        tail = [f"t{d}x{i}" for i in range(40)]
        texts.append(" ".join(passage + tail))
        if d < 40:  # and a true near copy each
            texts.append(" ".join(passage + tail[:30] + ["new"] + tail[31:]))
    rng.shuffle(texts)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = spark.read.parquet(documents(tmp_path, rows) + "/documents.parquet")
    want = brute(rows, k, num, 100)
    assert len({c for _, _, c in want}) == 220
    assert sorted(map(tuple, D.group_documents(docs, k, num, 100, bulk=4000).collect())) == want


def test_pairs_across_groups_hold_every_link():
    rng = np.random.default_rng(4)
    base = np.arange(40)
    sets = [set(rng.choice(base, rng.integers(4, 36), replace=False).tolist()) | {100 + i} for i in range(150)]
    order = {x: i for i, x in enumerate(sorted(set().union(*sets), key=lambda x: (sum(x in s for s in sets), x)))}
    found = set()
    for x in order:
        rows = sorted((len(s), i, sorted(order[y] for y in s).index(order[x])) for i, s in enumerate(sets) if x in s)
        n, who, place = (np.array(c) for c in zip(*rows, strict=True))
        for i, js in D.pairs_across(n, place, who[:, None], 80, 100):
            found |= {(min(who[i], who[j]), max(who[i], who[j])) for j in js}
    links = {(i, j) for j in range(150) for i in range(j) if 180 * len(sets[i] & sets[j]) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert links and links <= found and len(found) < 150 * 149 // 4


def test_query_columns_and_empty_tables(spark, tmp_path):
    assert D.op1_neardup(spark, documents(tmp_path, [])).collect() == []
    got = D.op1_neardup(spark, documents(tmp_path, [(2, "a b c d", "en", "s"), (1, "A b  c\nd", "en", "s"), (3, None, None, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_dedup_keeps_one_of_each_group(spark, tmp_path):
    rows = corpus(5)[:-6]
    docs = spark.read.parquet(documents(tmp_path, rows) + "/documents.parquet")
    kept = D.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, n, c in brute(rows, 5, 80, 100) if d == c})


def test_components_of_chains_and_stars(spark):
    name = lambda i: b"%05d" % i
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 301), (301, 300), (500, 500)]
    frame = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in edges], "a binary, b binary")
    got = {int(bytes(r.node)): int(bytes(r.root)) for r in D.components(frame).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 300: 300, 301: 300}


def test_search_inside_a_component_equals_all_pairs():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 200 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in rng.integers(0, 40, 60)]
    sigs = np.stack([(D.signature(s) & np.uint32(255)).astype(np.uint8) for s in sets])
    got = D.links_within(sets, sigs, 85, 100, -1.0)
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    assert len(set(zip(got, group, strict=True))) == len(set(got)) == len(set(group))


def test_dense_regions_lose_no_link(spark, tmp_path):
    k, num = 3, 85
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(90)]
    texts = []
    for d in range(700):  # one passage in more rows than a region compares, alike at 0.6
        tail = [f"t{d}x{i}" for i in range(30)]
        texts.append(" ".join(passage + tail))
        if d < 60:  # near copies from 0.85 to 0.95
            own = passage + tail
            texts.append(edited(rng, own[:110], 1 if d % 2 else 2) + " " + " ".join(own[110:]))
    rng.shuffle(texts)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    docs = spark.read.parquet(documents(tmp_path, rows) + "/documents.parquet")
    assert sorted(map(tuple, D.group_documents(docs, k, num, 100).collect())) == sorted(brute(rows, k, num, 100))


def test_borders_and_cuts_lose_no_region(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "REGION", 12)
    monkeypatch.setattr(D, "HELD", 64)
    rng = np.random.default_rng(3)
    rows = []
    for region, size in enumerate([1, 5, 12, 11, 150, 3, 12, 40, 2, 9, 12]):
        base = rng.integers(0, 256, D.HASHES)
        for i in range(size):
            low = np.where(rng.random(D.HASHES) < 0.1, rng.integers(0, 256, D.HASHES), base).astype(np.uint8)
            label = np.concatenate([[region] * D.LEAST, rng.integers(0, 3, D.DEPTH - D.LEAST)]).astype(">u4")
            rows.append((0, label.tobytes(), low.tobytes(), b"\0" + region.to_bytes(4, "big") + i.to_bytes(20, "big")))
    rows.sort()
    columns = list(zip(*rows, strict=True))
    batch = lambda part, a, b: pa.RecordBatch.from_arrays([pa.array([part] * (b - a), pa.int32()), pa.array(columns[0][a:b], pa.int32()), *[pa.array(c[a:b], pa.binary()) for c in columns[1:]]], names=["part", "tree", "label", "low", "node"])
    cuts = [0, 33, 60, 130, 200, len(rows)]
    found = []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        run = D._Run(0.6)
        for i in range(a, b, 10):
            run.add(batch(part, i, min(i + 10, b)))
            found += list(run.close(False))
        if run.held:
            found += list(run.close(True))
    found = pa.Table.from_batches(found).to_pylist()
    borders = sorted((r for r in found if r["kind"] == D.BORDER), key=lambda r: (r["part"], r["tree"], r["label"], r["low"], r["a"]))
    for part in sorted({r["part"] for r in borders}):
        own = [r for r in borders if r["part"] == part]
        run = D._Run(0.6)
        run.add(pa.RecordBatch.from_arrays([pa.array([r["part"] for r in own], pa.int32()), pa.array([r["tree"] for r in own], pa.int32()), *[pa.array([r[c] for r in own], pa.binary()) for c in ("label", "low", "a")]], names=["part", "tree", "label", "low", "node"]))
        found += pa.Table.from_batches(run.close(True, False)).to_pylist()
    root = {r[3]: r[3] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        if r["kind"] == D.EDGE:
            assert r["a"] < r["b"]
            root[top(r["b"])] = top(r["a"])
    assert sum(r["kind"] == D.DENSE for r in found) >= 1
    for region in range(11):
        own = [r[3] for r in rows if r[3][1:5] == region.to_bytes(4, "big")]
        assert len({top(x) for x in own}) == 1 or len(own) > 12


def test_rows_without_id(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long, "en", "s"), (None, long, "en", "s"), (None, "only null ids have this text", "en", "s"), (None, "only null ids have this text", "en", "t"), (None, "", "en", "s"), (None, None, "en", "s"), (7, "", "en", "s"), (7, "", "en", "s")]
    d = documents(tmp_path, rows)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in D.op1_neardup(spark, d).collect()), key=str)
    want = [(5, 38, 5, True), (None, 38, 5, False), (None, 4, None, True), (None, 4, None, True), (None, 0, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True)]
    assert got == sorted(want, key=str)
    kept = D.deduplicate(spark.read.parquet(d + "/documents.parquet"), 3, 85, 100).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, long), (None, "only null ids have this text"), (None, ""), (None, None), (7, ""), (7, "")], key=str)


def test_links_that_signatures_skip_are_found():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: len(base) - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in rng.integers(0, 30, 80)]
    sigs = rng.integers(0, 256, (80, D.HASHES)).astype(np.uint8)  # say nothing
    group = list(range(80))
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    got = D.links_within(sets, sigs, 85, 100, 0.5)
    assert len(set(zip(got, group, strict=True))) == len(set(got)) == len(set(group)) > 1


def test_counters_of_the_prefix_join_reach_the_driver_as_arrays(spark):
    import tracemalloc

    texts = spark.range(30).selectExpr("cast(cast(id as string) as binary) as node", "array_join(transform(sequence(1, 20000), x -> concat(id, 'w', x)), ' ') as text")
    groups = texts.selectExpr("node", "node as group")
    texts.count()
    tracemalloc.start()
    try:
        D._across(texts, groups, 3, 85, 100)  # counts at once, joins later
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 8 MB of counters; as an object a row they took 243 MB
    assert peak < 50 << 20


def test_few_edges_take_one_task_and_give_what_rounds_give(spark, monkeypatch):
    rng = random.Random(8)
    # names that end in zeros, a long chain, a star and pairs
    names = [bytes([0, i % 7, i // 256, i % 256]) + bytes(D.NODE - 4) for i in range(900)]
    rng.shuffle(names)
    pairs = list(zip(names[:300], names[1:300])) + [(names[300], x) for x in names[301:600]] + list(zip(names[600:900:2], names[601:900:2])) + [(names[5], names[5])]
    edges = D.written(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a binary, b binary"), "test-edges")
    tables, written = [], D.written
    monkeypatch.setattr(D, "written", lambda df, name: tables.append(name) or written(df, name))
    few = sorted(map(tuple, D.components(edges).collect()))
    assert tables == ["dedup-components"]
    monkeypatch.setattr(D, "EDGES", 10)
    assert few == sorted(map(tuple, D.components(edges).collect())) and len(few) == 900
    assert {r for _, r in few} == {min(names[:300]), min(names[300:600]), *(min(p) for p in zip(names[600:900:2], names[601:900:2]))}
    monkeypatch.setattr(D, "EDGES", 10_000)
    assert D.components(edges.filter("a = b")).collect() == []
