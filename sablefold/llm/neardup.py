"""Near-duplicate groups by a MinHash LSH forest, confirmed on full shingle sets.

Links: two documents whose shingle sets have intersection / union of at least a threshold. A group is
a connected component of links; its name is its smallest doc_id.

1. Every text gives its set (64-bit hashes of distinct word shingles, whole texts), a digest of the
   set, and a MinHash signature. Documents with equal sets are one class; copies go no further. A class
   is a node: its smallest doc_id in sortable bytes, then the digest; the least node of a group names it.
2. LSH forest: ``TREES`` sorted orders, each by its own ``DEPTH`` hash values. All trees are one
   range-partitioned, sorted table. Rows that share at least ``LEAST`` values are a region; a region of
   at most ``REGION`` rows is compared at that depth, a denser one at the next depth, and so on
   (adaptive depth), rows that agree in everything in the order of the rest of their signatures, in
   windows. Neighbours in the sorted order, which share the longest prefixes, are compared as well.
   Comparing means signatures, in matrix form; pairs above a slack threshold become candidates, of
   which a region emits a spanning forest, never all pairs. The rows on both sides of a border between
   partitions are compared once more, together.
3. Connected components of the candidates: up to ``EDGES`` edges by one task, more by hash-to-min over edges,
   written each round; both name the same groups.
4. The texts of a candidate component meet once: a filter of fixed size (at most ``FILTER_BITS`` bits, by
   hashed doc_id) keeps most other texts from moving at all. Inside, a breadth-first search confirms links
   on full sets: a pivot is compared with all members not yet reached, in one vector operation, so a
   group around one original costs one pass. Signatures skip pairs far below the threshold there; what
   they may have skipped between two groups comes from an exact prefix join of the component's own sets,
   so every link inside a component is found.
5. Components of more than ``BULK`` shingles are dealt into chunks. The members most like the
   component's majority signature (its hubs) go to every chunk, and candidate pairs that still lie in
   different groups afterwards are confirmed pair by pair.
6. What is then left between the groups of a large component, and between the groups that meet in a
   region of more than ``REGION`` rows, comes from an exact join on prefixes: shingles have one order, about
   rarest first, and a linked pair shares one early enough in both sets that the rest can still hold the
   intersection it needs (``_across``).

What is approximate: a pair is missed only where it shares no two-value region in any tree (2.1e-7 at
similarity 0.85, 4.7e-6 at 0.8), or where its signatures fall under the slack threshold and no other
links or dense region join its ends (2.5e-5 and 2.1e-5). Links reported are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, shuffle_partitions, table, written

TREES, DEPTH = 12, 6
HASHES = TREES * DEPTH
#: Least shared hash values of a region, and rows up to which a region is compared as a whole.
LEAST, REGION = 2, 384
#: Rows of one region held at once; a longer one is cut, with REGION rows on both sides of the cut.
HELD = 1 << 16
#: Parts into which the edges of one node, and the copies of one set, are dealt.
SALTS = 16
#: Bytes of a node: a flag (0, or 1 for a class without any id), the id with its sign turned, the set's digest.
NODE = 25
#: Standard deviations of the signature's estimate by which a candidate may lie below the threshold.
SLACK = 4.5
#: Shingles of a candidate component that one task takes, and hubs of a larger one.
BULK = 3_000_000
HUBS = 4

#: Edges up to which one task finds the connected components; more go through rounds of stars.
EDGES = 1 << 18

#: Counters by which shingles of large components are put in order; the order decides the work, not the result.
COUNTERS = 1 << 20

#: Bits of the filter of members, at most; it lets some other documents pass, which the join then drops.
FILTER_BITS = 1 << 27

_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hashes of words; starts anew when large."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word)
        return h


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word k-shingles. A-Z count as a-z, words are runs of
    anything but ASCII white space; fewer words than k are one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h)
    if n < k:
        out = np.full(1, n, np.uint64)
        for x in h:
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
        return out
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, 32 bits each."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(own), 4096):
        part = (own[None, i : i + 4096] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        np.minimum(out, (part >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def _digest(own: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(own.tobytes())


def features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key (16-byte digest of the set; null for an empty one), sig (HASHES big-endian
    32-bit values) and mark (a hash of the text) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                n, keys, sigs = [], [], []
                for text in batch.column(1).to_pylist():
                    own = shingles(text, k)
                    n.append(len(own))
                    keys.append(_digest(own) if len(own) else None)
                    sigs.append(signature(own).astype(">u4").tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "key", "sig", "mark"])
        _words.clear()
        give_back()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, "doc_id bigint, n_shingles bigint, key binary, sig binary, mark bigint")


def _node(doc_id: Column, key: Column) -> Column:
    """A class's node; nodes sort by id, those without one last."""
    turned = F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), F.lit(bytearray(b"\x01"))).otherwise(F.lit(bytearray(b"\x00"))), F.unhex(turned), key)


def _id(node: Column) -> Column:
    """The doc_id that a node holds."""
    turned = F.conv(F.hex(F.substring(node, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", turned)


def _salt(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def _salts(mask: Column) -> Column:
    """The salts of a bit mask, a row each."""
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return F.explode(F.filter(every, lambda i: F.getbit(mask, i) == 1))


def _floor(share: float) -> float:
    """Least agreement of signatures of a candidate pair for a threshold."""
    return share - SLACK * (share * (1 - share) / HASHES) ** 0.5


def _forest(like: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph ``like`` (boolean matrix), as row numbers."""
    left, out = np.ones(len(rows), bool), []
    for root in range(len(rows)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(like[i] & left)
            left[new] = False
            out += [(int(rows[i]), int(rows[j])) for j in new]
            queue += new.tolist()
    return out


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes between rows of two matrices, corrected for chance (1 / 256)."""
    same = np.zeros((len(a), len(b)), np.float32)
    for c in range(a.shape[1]):
        same += a[:, c, None] == b[None, :, c]
    return (same / a.shape[1] - 1 / 256) / (1 - 1 / 256)


def region_edges(labels: np.ndarray, bytes_: np.ndarray, least: float, depth: int = LEAST) -> list[tuple[int, int]]:
    """Candidate edges (row numbers) of a sorted region: ``labels`` (rows, DEPTH), ``bytes_`` (rows, HASHES)."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(labels), depth)]
    while stack:
        a, b, d = stack.pop()
        if b - a < 2:
            continue
        if b - a <= REGION:
            like = _agreement(bytes_[a:b], bytes_[a:b]) >= least
            out += _forest(like, np.arange(a, b))
            continue
        # neighbours in the sorted order
        near = (((bytes_[a : b - 1] == bytes_[a + 1 : b]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)) >= least
        out += [(int(i), int(i) + 1) for i in np.flatnonzero(near) + a]
        if d < labels.shape[1]:
            cuts = np.flatnonzero(labels[a + 1 : b, d] != labels[a : b - 1, d]) + a + 1
            ends = [a, *cuts.tolist(), b]
            stack += [(x, y, d + 1) for x, y in zip(ends, ends[1:], strict=False)]
        else:
            half = REGION // 2
            stack += [(x, min(x + REGION, b), d) for x in range(a, b - half, half)]
    return out


def _regions(trees: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """First rows of the regions of a sorted run, and its length."""
    head = labels[:, : 4 * LEAST]
    new = np.flatnonzero((trees[1:] != trees[:-1]) | np.any(head[1:] != head[:-1], axis=1)) + 1
    return np.concatenate([[0], new, [len(trees)]])


def _fixed(column: pa.Array, n: int) -> np.ndarray:
    """Binary values of ``n`` bytes each as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n)


def _raw(rows: np.ndarray) -> pa.Array:
    """The reverse of _fixed()."""
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


_FOUND = "kind int, a binary, b binary, part int, tree int, label binary, low binary"
#: Kinds of rows that the forest makes; DENSE says that there is a region of more than REGION rows.
EDGE, BORDER, DENSE = 0, 1, 2


class _Run:
    """A sorted run of the forest's rows, and what is found in it."""

    def __init__(self, least: float) -> None:
        self.least, self.held, self.part, self.first, self.dense = least, [], 0, True, False

    def rows(self) -> int:
        return sum(len(h[0]) for h in self.held)

    def add(self, batch: pa.RecordBatch) -> None:
        self.part = batch.column(0)[0].as_py()
        self.held.append((np.asarray(batch.column(1)), _fixed(batch.column(2), 4 * DEPTH), _fixed(batch.column(3), HASHES), _fixed(batch.column(4), NODE)))

    def close(self, final: bool, borders: bool = True) -> Iterator[pa.RecordBatch]:
        """Edges and border rows of what is held, but for a last region that may go on."""
        trees, labels, lows, nodes = (np.concatenate(x) for x in zip(*self.held, strict=True))
        ends = _regions(trees, labels)
        cut = False
        if not final:
            if len(ends) > 2:
                ends = ends[:-1]
            elif len(trees) < HELD:
                self.held = [(trees, labels, lows, nodes)]
                return
            else:
                cut = True
        found = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a > 1:
                found += [(a + x, a + y) for x, y in region_edges(labels[a:b].reshape(b - a, DEPTH, 4).view(">u4")[:, :, 0], lows[a:b], self.least)]
            if b - a > REGION and not self.dense:
                self.dense = True
                yield self._batch(DENSE, _raw(nodes[a : a + 1]))
        if found:
            pairs = np.array(found)
            one, two = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
            differ = np.argmax(one != two, axis=1)
            turn = np.take_along_axis(one, differ[:, None], 1) > np.take_along_axis(two, differ[:, None], 1)
            yield self._batch(EDGE, _raw(np.where(turn, two, one)), _raw(np.where(turn, one, two)))
        # of the first and the last region, what lies at the border
        if borders and self.first and self.part:
            own = slice(0, min(int(ends[1]), REGION))
            yield self._border(self.part - 1, trees[own], labels[own], lows[own], nodes[own])
        if borders and final:
            own = slice(max(int(ends[-2]), len(trees) - REGION), len(trees))
            yield self._border(self.part, trees[own], labels[own], lows[own], nodes[own])
        self.first = False
        # a cut region's last rows are compared again with what follows
        rest = int(ends[-1]) - (REGION if cut else 0)
        self.held = [(trees[rest:], labels[rest:], lows[rest:], nodes[rest:])] if rest < len(trees) else []

    def _border(self, part: int, trees: np.ndarray, labels: np.ndarray, lows: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        return self._batch(BORDER, _raw(nodes), part=part, tree=trees, label=labels, low=_raw(lows))

    @staticmethod
    def _batch(kind: int, a: pa.Array, b: pa.Array | None = None, part: int = 0, tree: np.ndarray | None = None, label: np.ndarray | None = None, low: pa.Array | None = None) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), a, none if b is None else b, pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.int32()) if tree is None else pa.array(tree.astype(np.int32)), none if label is None else _raw(label), none if low is None else low],
            names=["kind", "a", "b", "part", "tree", "label", "low"],
        )


def candidates(classes: DataFrame, least: float) -> tuple[DataFrame, bool]:
    """Candidate edges (a, b) of ``classes`` (node, sig), a written table of distinct pairs, a < b; and
    whether there are regions of more than REGION rows."""
    spark = classes.sparkSession
    size = 4 * DEPTH
    # the lowest byte of each value stands for it where signatures are compared
    low = F.concat(*[F.substring("sig", 4 * i + 4, 1) for i in range(HASHES)])
    rows = classes.select("node", "sig", low.alias("low"))
    rows = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", t * size + 1, size).alias("label")) for t in range(TREES)])).alias("at"), "node", "low")
    rows = rows.select("at.tree", "at.label", "low", "node")
    order = ["tree", "label", "low", "node"]
    # a partition holds many times REGION rows, so a region that a border cuts lies in two partitions or is dense
    parts = max(1, min(max(shuffle_partitions(spark), 8), TREES * classes.count() // (16 * REGION)))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), *order)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(least)
        for batch in batches:
            if batch.num_rows:
                run.add(batch)
                if run.rows() >= 1 << 14:
                    yield from run.close(False)
        if run.held:
            yield from run.close(True)
        del run
        give_back()

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        for whole in batches:
            parts = np.asarray(whole.column(0))
            for piece in np.split(np.arange(len(parts)), np.flatnonzero(parts[1:] != parts[:-1]) + 1):
                if len(piece):
                    if run is not None and run.part != parts[piece[0]]:
                        yield from run.close(True, False)
                        run = None
                    run = run or _Run(least)
                    run.add(whole.slice(int(piece[0]), len(piece)))
        if run is not None:
            yield from run.close(True, False)

    found = written(rows.mapInArrow(forest, _FOUND), "dedup-forest")
    edge = found.filter(F.col("kind") == BORDER).select("part", *order[:3], F.col("a").alias("node"))
    edge = edge.repartition(max(1, min(parts, shuffle_partitions(spark))), "part").sortWithinPartitions("part", *order)
    found = found.filter(F.col("kind") != BORDER).unionByName(written(edge.mapInArrow(borders, _FOUND), "dedup-borders"))
    edges = written(found.filter(F.col("kind") == EDGE).select("a", "b").distinct(), "dedup-candidates")
    return edges, found.filter(F.col("kind") == DENSE).limit(1).count() > 0


def _mixed(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes of ``classes`` (node, sig) in regions of more than REGION rows where several groups meet, and a few
    others. ``links`` (a, b) names the groups. Regions go by hashes; one row a region is what is shuffled."""
    rows = classes.join(links.select(F.col("a").alias("node"), "b"), "node", "left")
    hashes = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", t * 4 * DEPTH + 1, 4 * LEAST)) for t in range(TREES)])
    rows = rows.select("node", F.xxhash64(F.coalesce("b", "node")).alias("group"), hashes.alias("regions"))
    met = rows.select(F.explode("regions").alias("region"), "group").groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("group").alias("low"), F.max("group").alias("high"))
    met = written(met.filter((F.col("n") > REGION) & (F.col("low") != F.col("high"))).select("region"), "dedup-regions")
    return rows.filter(_filter(met, "region", met.count())(F.col("regions"))).select("node")


def _least(rows: DataFrame) -> DataFrame:
    """(a, salt, m) for ``rows`` (a, b, salt): the least b of each a, once for each salt that a has."""
    some = rows.groupBy("a", "salt").agg(F.min("b").alias("m"))
    whole = some.groupBy("a").agg(F.min("m").alias("m"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("mask"))
    return whole.select("a", "m", _salts(F.col("mask")).alias("salt"))


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of the connected component of each of ``n`` nodes, by edges between their numbers."""
    least = np.arange(n)
    while not np.array_equal(one := least[a], two := least[b]):
        low = np.minimum(one, two)
        np.minimum.at(least, one, low)
        np.minimum.at(least, two, low)
        while not np.array_equal(least, after := least[least]):
            least = after
    return least


def _components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (a, b) of a task; nodes have one length."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            size = len(batch.column(0)[0].as_py())
            held.append(np.hstack([_fixed(batch.column(i), size) for i in (0, 1)]))
    if held:
        ends = np.concatenate(held).reshape(-1, size)
        # in the order of their bytes; nodes are taken from the rows, as numpy's strings lose zeros at their end
        _, first, codes = np.unique(np.ascontiguousarray(ends).view(f"S{size}")[:, 0], return_index=True, return_inverse=True)
        nodes, codes = ends[first], codes.reshape(-1, 2)
        roots = nodes[least_members(codes[:, 0], codes[:, 1], len(nodes))]
        for i in range(0, len(nodes), 1 << 14):
            yield pa.RecordBatch.from_arrays([_raw(nodes[i : i + (1 << 14)]), _raw(roots[i : i + (1 << 14)])], names=["node", "root"])
    del held
    give_back()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a written table of edges (a, b): (node, root), root the smallest node. Up to EDGES
    edges go to one task. More: alternates large and small stars until nothing changes; each round is a written
    table, minima are partial before every shuffle, and the edges of a node are dealt by SALTS, so a node of
    any degree is spread over tasks."""
    now = edges.select("a", "b").filter("a <> b")
    if edges.count() <= EDGES:
        return written(now.coalesce(1).mapInArrow(_components_of, "node binary, root binary"), "dedup-components")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("salt", _salt(F.col("b")))
        low = _least(both).select("a", "salt", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # each a now points at smaller nodes; they and a itself turn to the least of them
        large = large.withColumn("salt", _salt(F.col("b")))
        least = _least(large)
        small = large.join(least, ["a", "salt"]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = written(now, "dedup-round")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _linked(n: int, m: int, both: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * both >= num * (n + m - both)


def links_within(sets: list[np.ndarray], sigs: np.ndarray, num: int, den: int, least: float) -> list[int]:
    """Group number (index of a member) of each set: connected components of the links among all pairs, all
    of them. Signatures (lowest bytes) put the search in order and skip pairs; ``_links_left`` makes up for it."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets) if count else np.zeros(0, np.uint64)
    group = np.full(count, -1)
    # the member most like the majority of signatures first: it reaches the most
    typical = np.array([np.bincount(sigs[:, c]).argmax() for c in range(sigs.shape[1])]) if count > 2 else None
    order = np.argsort(-(sigs == typical).sum(axis=1), kind="stable") if typical is not None else np.arange(count)
    for root in order.tolist():
        if group[root] >= 0:
            continue
        group[root] = root
        queue = [root]
        while queue:
            i = queue.pop(0)
            left = np.flatnonzero(group < 0)
            if not len(left):
                break
            n = sizes[i]
            near = num * np.maximum(sizes[left], n) <= den * np.minimum(sizes[left], n)
            if count > 8:
                near &= ((sigs[left] == sigs[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= least
            left = left[near]
            if not len(left):
                continue
            new = left[_links_of(i, left, flat, starts, sizes, num, den)]
            group[new] = root
            queue += new.tolist()
    if count > 8 and (group != group[0]).any():
        _links_left(group, flat, starts, sizes, num, den)
    return group.tolist()


def _links_of(i: int, others: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of ``others`` are links of set i; sets lie sorted in ``flat``."""
    n, lengths = sizes[i], sizes[others]
    ends = np.cumsum(lengths)
    before = ends - lengths
    mine, values = flat[starts[i] : starts[i] + n], flat[np.repeat(starts[others] - before, lengths) + np.arange(ends[-1])]
    where = np.minimum(np.searchsorted(mine, values), n - 1)
    hits = np.add.reduceat((mine[where] == values).astype(np.int64), before)
    return _linked(n, lengths, hits, num, den)


def _links_left(group: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, num: int, den: int) -> None:
    """Join the groups between which a link is left, by the prefix join of pairs_across(). Changes ``group``."""
    count = len(sizes)
    _, codes, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), sizes)
    order = np.lexsort((codes, times[codes], owner))
    codes, place = codes[order], np.arange(len(flat)) - starts[owner]
    n = sizes[owner]
    use = ((den + num) * (n - place) >= num * (n + -(-num * n // den))) & (times[codes] > 1)
    owner, codes, place = owner[use], codes[use], place[use]
    order = np.lexsort((owner, sizes[owner], codes))
    owner, codes, place = owner[order], codes[order], place[order]
    if not len(codes):
        return
    first = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
    several = np.minimum.reduceat(group[owner], first) != np.maximum.reduceat(group[owner], first)
    seen: set[int] = set()
    for a, b in zip(first[several].tolist(), np.append(first, len(codes))[1:][several].tolist(), strict=True):
        own = owner[a:b]
        for i, js in pairs_across(sizes[own], place[a:b], group[own][:, None], num, den):
            one = int(own[i])
            new = np.array([j for j in own[js].tolist() if group[j] != group[one] and one * count + j not in seen], np.int64)
            if len(new):
                seen.update((one * count + new).tolist())
                for j in new[_links_of(one, new, flat, starts, sizes, num, den)].tolist():
                    group[group == group[j]] = group[one]


def _confirm(rows: DataFrame, k: int, num: int, den: int, least: float) -> DataFrame:
    """Star edges (a, b) of the exact groups inside each (root, chunk) of ``rows`` (root, chunk, node, text): each
    node of a group with the least one."""
    dealt = rows.select("root", "chunk", "node", "text").repartition(max(shuffle_partitions(rows.sparkSession), 8), "root", "chunk").sortWithinPartitions("root", "chunk", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def close() -> tuple[list, list]:
            # a class may have come in more than once
            sigs = np.stack([(signature(s) & np.uint32(255)).astype(np.uint8) for s in sets])
            first: dict[int, bytes] = {}
            got = links_within(sets, sigs, num, den, least)
            for node, g in zip(nodes, got, strict=True):  # in order
                first.setdefault(g, node)
            pairs = [(node, first[g]) for node, g in zip(nodes, got, strict=True) if node != first[g]]
            return [a for a, _ in pairs], [b for _, b in pairs]

        for batch in batches:
            one, two = [], []
            roots, chunks, names, texts = (batch.column(i).to_pylist() for i in range(4))
            for here, node, text in zip(zip(roots, chunks, strict=True), names, texts, strict=True):
                if here != at:
                    if len(sets) > 1:
                        a, b = close()
                        one += a
                        two += b
                    at, nodes, sets = here, [], []
                if nodes and nodes[-1] == node:
                    continue
                own = shingles(text, k)
                if len(own) and _digest(own) == node[-16:]:
                    nodes.append(node)
                    sets.append(own)
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary())], names=["a", "b"])
        if len(sets) > 1:
            a, b = close()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        nodes, sets = [], []
        _words.clear()
        give_back()

    return dealt.mapInArrow(run, "a binary, b binary")


def _hubs(large: DataFrame, sigs: DataFrame) -> DataFrame:
    """(root, node) of the HUBS members of each large component that agree most with its majority signature."""
    member = large.join(sigs, "node")
    bits = member.select("root", "node", F.posexplode(F.array(*[F.substring("sig", 4 * i + 1, 4) for i in range(HASHES)])).alias("at", "value"))
    votes = bits.groupBy("root", "at", "value").agg(F.count(F.lit(1)).alias("n"))
    major = votes.groupBy("root", "at").agg(F.max(F.struct("n", "value")).alias("top")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("at", F.col("top.value").alias("value")))).alias("major"))
    score = sum((F.element_at("major", F.lit(i)) == F.substring("sig", 4 * i + 1, 4)).cast("int") for i in range(HASHES))
    best = Window.partitionBy("root").orderBy(F.col("score").desc(), "node")
    return member.join(major, "root").select("root", "node", score.alias("score")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= HUBS).select("root", "node")


def _own_texts(texts: DataFrame, k: int) -> DataFrame:
    """Rows of ``texts`` (node, text) whose text has the set that the node names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, texts = (batch.column(i).to_pylist() for i in range(2))
            yield batch.filter(pa.array([_digest(shingles(t, k)) == node[-16:] for node, t in zip(nodes, texts, strict=True)], pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def _pairs(edges: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The edges (a, b) that are links, confirmed on the texts of both ends, pair by pair."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                x, y = shingles(ta[i], k), shingles(tb[i], k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(_linked(len(x), len(y), both, num, den)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return edges.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def pairs_across(n: np.ndarray, place: np.ndarray, group: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) of the rows of one shingle, by ascending set size ``n``, that lie in different groups and may
    be links if this is the first shingle they share: what follows its ``place`` in both sets suffices."""
    rest = n - place
    for i in np.flatnonzero((den + num) * rest >= 2 * num * n).tolist():  # the smaller set of a pair
        last = int(np.searchsorted(n, den * n[i] // num, side="right"))
        other = slice(i + 1, last)
        ok = (den + num) * np.minimum(rest[i], rest[other]) >= num * (n[i] + n[other])
        ok &= np.any(group[other] != group[i], axis=1)
        if ok.any():
            yield i, np.flatnonzero(ok) + i + 1


def _across(texts: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, ga, b, gb): every pair of ``texts`` (node, text) in different ``groups`` (node, group) that may be a link."""
    counters = np.uint64(COUNTERS - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(held, (shingles(text, k) & counters).astype(np.int64), 1)
        at = np.flatnonzero(held)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(held[at[i : i + (1 << 16)]])], names=["at", "n"])

    often = _dense(texts.select("text").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n")), COUNTERS)
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for whole in batches:
            for first in range(0, whole.num_rows, 200):
                batch = whole.slice(first, 200)
                row, hs, ns, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for r, text in enumerate(batch.column(2).to_pylist()):
                    own = shingles(text, k)
                    n = len(own)
                    times = often[(own & counters).astype(np.int64)]
                    order = np.lexsort((own, times))
                    place = np.arange(n)
                    # the smallest set that this one can be linked to, and shingles of more than one set
                    use = ((den + num) * (n - place) >= num * (n + -(-num * n // den))) & (times[order] > 1)
                    row.append(np.full(int(use.sum()), r))
                    hs.append(own[order[use]])
                    ns.append(np.full(int(use.sum()), n))
                    places.append(place[use])
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(ns)), pa.array(np.concatenate(places))],
                    names=["h", "node", "group", "n", "place"],
                )

    own = texts.join(groups, "node", "left").select("node", F.coalesce("group", "node").alias("group"), "text")
    rows = own.mapInArrow(prefixes, "h bigint, node binary, group binary, n bigint, place bigint")
    rows = rows.repartition(max(shuffle_partitions(texts.sparkSession), 8), "h").sortWithinPartitions("h", "n", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            h, keys, groups, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
            ends = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            if not final:
                ends = ends[:-1]  # the last shingle may go on
            left, right, size = [], [], 0
            for at in np.flatnonzero(np.diff(ends) > 1).tolist():
                a, b = int(ends[at]), int(ends[at + 1])
                for i, js in pairs_across(n[a:b], place[a:b], groups[a:b], num, den):
                    left.append(np.full(len(js), a + i))
                    right.append(js + a)
                    size += len(js)
                    if size >= 1 << 16:
                        yield pairs(keys, groups, left, right)
                        left, right, size = [], [], 0
            if size:
                yield pairs(keys, groups, left, right)
            rest = int(ends[-1])
            held = [(h[rest:], keys[rest:], groups[rest:], n[rest:], place[rest:])] if rest < len(h) else []

        def pairs(keys: np.ndarray, groups: np.ndarray, left: list, right: list) -> pa.RecordBatch:
            i, j = np.concatenate(left), np.concatenate(right)
            turn = np.fromiter((keys[x].tobytes() > keys[y].tobytes() for x, y in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
            i, j = np.where(turn, j, i), np.where(turn, i, j)
            text = lambda m, at: pa.array([r.tobytes() for r in m[at]], pa.binary())
            return pa.RecordBatch.from_arrays([text(keys, i), text(groups, i), text(keys, j), text(groups, j)], names=["a", "ga", "b", "gb"])

        for batch in batches:
            if batch.num_rows:
                h, n, place = (np.asarray(batch.column(c)) for c in (0, 3, 4))
                go_on = held and (held[-1][0][-1] == h[-1])  # one long list: put together only at its end
                held.append((h, _fixed(batch.column(1), NODE), _fixed(batch.column(2), NODE), n, place))
                if not go_on:
                    yield from found(False)
        if held:
            yield from found(True)

    return rows.mapInArrow(meet, "a binary, ga binary, b binary, gb binary").distinct()


def _dense(rows: DataFrame, size: int) -> np.ndarray:
    """The values of ``rows`` (place, value; longs) at their places in an array of ``size``, else 0. They come to the
    driver as Arrow: an object a row would take 20 times their bytes."""
    out, got = np.zeros(size, np.int64), rows.toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _filter(values: DataFrame, value: str, count: int):
    """A function that says of an array of longs whether one of them may be among ``values``: a bit for each
    value's low bits, at most FILTER_BITS, broadcast."""
    bits = 1 << 16
    while bits < min(16 * count, FILTER_BITS):
        bits *= 2
    place = F.col(value).bitwiseAND(F.lit(bits - 1))
    words = values.filter(F.col(value).isNotNull()).select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("mask"))
    sent = values.sparkSession.sparkContext.broadcast(_dense(words, bits // 64))

    @F.pandas_udf("boolean")
    def may(at: pd.Series) -> pd.Series:
        if not len(at):
            return pd.Series([], dtype=bool)
        x = np.stack(at.to_numpy()).astype(np.int64) & (bits - 1)
        return pd.Series(((sent.value[x >> 6] >> (x & 63)) & 1 == 1).any(axis=1))

    return may


def _likely(docs: DataFrame, members: DataFrame, count: int) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be one of ``members``: all of those and a few others."""
    ids = members.filter(F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id").alias("at"))
    return docs.filter(F.col("doc_id").isNotNull()).filter(_filter(ids, "at", count)(F.array(F.xxhash64("doc_id"))))


def group_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bulk: int = BULK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    A link is ``den * intersection >= num * union`` of the sets of k-word shingles. Null and empty texts
    have no shingles and no links. Rows with a null doc_id may link others; a group without any id has
    component_id null. Rows that repeat an id with other texts are grouped by their texts.
    """
    return _grouped(docs, k, num, den, bulk).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, k: int, num: int, den: int, bulk: int = BULK) -> DataFrame:
    """group_documents() with the set's key, the text's mark, and whether the set is the least of its group."""
    least = _floor(num / den)
    docs = docs.select("doc_id", "text")
    marked = written(features(docs, k), "dedup-features").withColumn("salt", _salt(F.struct("doc_id", "mark")))
    # copies of one set are dealt by salt here and where they come back
    some = marked.filter(F.col("key").isNotNull()).groupBy("key", "salt").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("n_shingles").alias("n"), "sig")).alias("first"))
    classes = some.groupBy("key").agg(F.min("first").alias("first"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("mask"))
    classes = written(classes.select(_node(F.col("first.doc_id"), F.col("key")).alias("node"), "mask", F.col("first.n").alias("n"), F.col("first.sig").alias("sig")), "dedup-classes")
    edges, dense = candidates(classes, least)
    member = written(components(edges).join(classes.select("node", "n"), "node").select("root", "node", _id(F.col("node")).alias("doc_id"), "n"), "dedup-members")
    sums = member.groupBy("root").agg(F.sum("n").alias("bulk")).filter(F.col("bulk") > bulk)
    hot = written(sums.select("root", F.ceil(F.col("bulk") / bulk).cast("int").alias("chunks")), "dedup-hot")
    placed = member.select("root", "node", "doc_id", F.lit(0).alias("chunk"))
    any_hot = hot.limit(1).count() > 0
    if any_hot:
        large = member.join(hot, "root")
        usual = member.join(hot.select("root"), "root", "left_anti").select("root", "node", "doc_id", F.lit(0).alias("chunk"))
        dealt = large.select("root", "node", "doc_id", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
        hubs = _hubs(large.select("root", "node"), classes.select("node", "sig")).join(member, ["root", "node"]).join(hot, "root")
        hubs = hubs.select("root", "node", "doc_id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        placed = written(usual.unionByName(dealt).unionByName(hubs), "dedup-placed")
    links = written(_confirm(_texts(docs, placed, member.count(), k), k, num, den, least), "dedup-links")
    # every node of a group is linked with its least one already
    name = lambda c, r: links.select(F.col("a").alias(c), F.col("b").alias(r))
    if any_hot:
        own = member.join(hot.select("root"), "root", "left_semi").select("node")
        links = components(links).select(F.col("node").alias("a"), F.col("root").alias("b"))
        apart = _between(edges.join(own.select(F.col("node").alias("a")), "a", "left_semi"), name)
        whole = _whole(docs, own, k)
        links = _joined(links, _pairs(written(apart, "dedup-apart"), whole, k, num, den))
        links = _across_groups(links, whole, k, num, den)
    if dense and (own := written(_mixed(classes, links), "dedup-mixed")).limit(1).count():
        links = _across_groups(links, _whole(docs, own, k), k, num, den)
    named = classes.select("node", "mask").join(name("node", "root"), "node", "left").select("node", "mask", F.coalesce("root", "node").alias("root"))
    by_key = named.select(F.substring("node", 10, 16).alias("key"), _salts(F.col("mask")).alias("salt"), _id(F.col("root")).alias("component_id"), (F.col("root") == F.col("node")).alias("head"))
    out = marked.join(by_key, ["key", "salt"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "mark", "head")


def _texts(docs: DataFrame, placed: DataFrame, count: int, k: int) -> DataFrame:
    """(root, chunk, node, text) of ``placed`` (root, chunk, node, doc_id): rows of its ids, among which a text's
    own digest says which is meant; classes without any id are found by their sets."""
    texts = _likely(docs, placed, count).join(placed, "doc_id").select("root", "chunk", "node", "text")
    none = placed.filter(F.col("doc_id").isNull()).select("root", "chunk", "node", F.substring("node", 10, 16).alias("key"))
    if none.limit(1).count():
        texts = texts.unionByName(marked_texts(docs.filter(F.col("doc_id").isNull()), k).join(none, "key").select("root", "chunk", "node", "text"))
    return texts


def _whole(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, text), one written row of each of ``nodes`` (node)."""
    placed = nodes.select(F.lit(None).cast("binary").alias("root"), F.lit(0).alias("chunk"), "node", _id(F.col("node")).alias("doc_id"))
    # the filter and the digests each have a worker for a task; dealt again, they don't run at once
    texts = _texts(docs, placed, nodes.count(), k).select("node", "text").repartition(max(shuffle_partitions(docs.sparkSession), 8), "node")
    texts = _own_texts(texts, k)
    return written(texts.groupBy("node").agg(F.min("text").alias("text")), "dedup-texts")


def _between(pairs: DataFrame, name) -> DataFrame:
    """The ``pairs`` (a, b) whose ends lie in different groups."""
    apart = pairs.join(name("a", "ra"), "a", "left").join(name("b", "rb"), "b", "left")
    return apart.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _joined(links: DataFrame, more: DataFrame) -> DataFrame:
    """``links`` and ``more`` as stars around the least node of each group."""
    groups = components(written(links.unionByName(more), "dedup-joined"))
    return groups.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _across_groups(links: DataFrame, whole: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``links`` (node, least node of its group) and all links between its groups in ``whole`` (node, text)."""
    pairs = written(_across(whole, links.select(F.col("a").alias("node"), F.col("b").alias("group")), k, num, den), "dedup-across")
    if not pairs.limit(1).count():
        return links
    # one pair of two groups first: a link there spares the others
    one = pairs.groupBy(F.least("ga", "gb").alias("g"), F.greatest("ga", "gb").alias("h")).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b")
    links = _joined(links, _pairs(one, whole, k, num, den))
    name = lambda c, r: links.select(F.col("a").alias(c), F.col("b").alias(r))
    apart = written(_between(pairs.join(one, ["a", "b"], "left_anti").select("a", "b"), name), "dedup-apart")
    return _joined(links, _pairs(apart, whole, k, num, den)) if apart.limit(1).count() else links


def marked_texts(docs: DataFrame, k: int) -> DataFrame:
    """(key, text) of each distinct set of ``docs``."""
    schema = "key binary, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(_digest(s) if len(s) else None) for s in (shingles(t, k) for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "text"])

    return docs.select("text").mapInArrow(run, schema).filter(F.col("key").isNotNull()).dropDuplicates(["key"])


def deduplicate(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, one with the smallest doc_id (of a group
    without any id, one of its rows); of rows that repeat this id one is kept. Rows without shingles stay,
    all of them."""
    groups = _grouped(docs, k, num, den)
    heads = groups.filter(F.col("head") & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("key", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    heads = heads.groupBy("key").agg(F.min(F.struct("doc_id", "mark", "rows")).alias("head"))
    kept = written(heads.select(F.col("head.doc_id").alias("__dedup_id"), F.col("head.mark").alias("__dedup_mark"), F.col("head.rows").alias("__dedup_rows")), "dedup-kept")
    full = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(full).join(kept, F.col("doc_id").eqNullSafe(F.col("__dedup_id")) & (F.xxhash64("text") == F.col("__dedup_mark")))
    out = rows.select(*docs.columns)
    if kept.filter("__dedup_rows > 1").limit(1).count():
        # the same text under the same id several times
        again = rows.filter("__dedup_rows > 1").dropDuplicates(["__dedup_id", "__dedup_mark"]).select(*docs.columns)
        out = rows.filter("__dedup_rows = 1").select(*docs.columns).unionByName(again)
    return out.unionByName(docs.filter(~full))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of every row of ``documents``: 3-word shingles, similarity 0.85. A row without
    an id is kept only where its whole group has none."""
    out = group_documents(table(spark, sf_dir, "documents"), 3, 85, 100)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
