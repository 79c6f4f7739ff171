"""Document fingerprints by prefix polynomial hashes.

The prefix array of a text holds, for every position i, the hash of its first i code points: the sum
of code point j times BASE**j, modulo two primes. Any span's hash is a difference of two entries, so
span equality is O(1) and the longest common extension of two positions is a binary search over
prefix equality (PrefixHashes). All of it is vectorised: one multiplication, one running sum.

A fingerprint is a sample of the array: the text's length, its whole hash, and the residues of its
prefixes and suffixes at up to ``POINTS`` multiples of a power of two. Two fingerprints compare
alone. They share the coarser step's points, and a difference of two residues is the hash of the span
between them, so a binary search from any shared point finds how far both texts agree from there
(``extension_at``): the common head, every agreeing run inside, and, over the suffixes, the same from the
end. The likeness is the share of the longer text that those runs cover. Equal texts have equal
fingerprints and likeness 1. A run inside is seen if it holds a whole step and lies as far from the
beginning, or from the end, of one text as of the other.

Scale: one shuffle of the texts. Rows are dealt into ranges of doc_id by quantile cut points (two
numbers a range reach the driver, 16 bytes for RANGE_ROWS rows), a range is a partition and is streamed in order with
one row of look-ahead, and the first row of each range is sent once more to the range before it. Rows that repeat one
id lie in one range, streamed by one task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import shuffle_partitions, table

#: Two primes below 2**31, so that products and sums fit 64 bits; bases chosen at random once.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Moduli and bases of the power tables: the two bases, then their inverses.
TABLES = tuple(zip(PRIMES * 2, BASES + tuple(pow(b, p - 2, p) for b, p in zip(BASES, PRIMES, strict=True)), strict=True))
#: Most prefix points of a fingerprint.
POINTS = 32
#: Rows of a range, about; more rows make more ranges.
RANGE_ROWS = 20_000
#: Stands for a null id among the first ids of ranges.
NO_ID = -(2**63)

_powers: list[np.ndarray] = [np.ones(1, np.uint64) for _ in TABLES]


def powers(k: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of table k; it doubles as longer texts come and is kept by the process."""
    have = _powers[k]
    p = np.uint64(TABLES[k][0])
    while len(have) < n:
        factor = np.uint64(pow(TABLES[k][1], len(have), TABLES[k][0]))
        have = np.concatenate([have, have * factor % p])
    _powers[k] = have
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    """Prefix arrays of a text: span equality and longest common extensions."""

    def __init__(self, text: str | np.ndarray) -> None:
        points = code_points(text) if isinstance(text, str) else text
        self.n = len(points)
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = (points.astype(np.uint64) + np.uint64(1)) * powers(k, self.n) % np.uint64(p)
            # a running sum of terms below 2**31 stays below 2**64 for 2**33 code points
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % np.uint64(p)]))

    def span(self, start: int, end: int, shift: int) -> tuple[int, int]:
        """Hash of [start, end) moved so that its first point weighs BASE**shift; shift >= start."""
        out = []
        for k, p in enumerate(PRIMES):
            own = (int(self.sums[k][end]) - int(self.sums[k][start])) % p
            out.append(own * pow(BASES[k], shift - start, p) % p)
        return out[0], out[1]

    def same(self, a: int, other: PrefixHashes, b: int, length: int) -> bool:
        """Whether [a, a+length) here equals [b, b+length) there."""
        if a + length > self.n or b + length > other.n or min(a, b, length) < 0:
            return False
        shift = max(a, b)
        return self.span(a, a + length, shift) == other.span(b, b + length, shift)

    def extension(self, a: int, other: PrefixHashes, b: int) -> int:
        """Length of the longest common extension of position a here and b there."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(a, other, b, mid):
                low = mid
            else:
                high = mid - 1
        return low


def step_of(n: int, most: int = POINTS) -> int:
    """Smallest power of two of which a text of n code points has at most ``most`` multiples."""
    step = 1
    while n // step > most:
        step *= 2
    return step


def fingerprint(text: str) -> str:
    """``length:whole:prefixes:suffixes``: the whole hash in hexadecimal, residues of both primes in base 64."""
    h = PrefixHashes(text)
    n, step = h.n, step_of(h.n)
    at = np.arange(step, n + 1, step)
    whole = f"{int(h.sums[0][n]):08x}{int(h.sums[1][n]):08x}"
    # a suffix's hash with its first point at weight 1 doesn't depend on where it starts
    inverse = [powers(2 + k, n + 1)[n - at] for k in range(2)]
    tails = [(h.sums[k][n] + np.uint64(PRIMES[k]) - h.sums[k][n - at]) % np.uint64(PRIMES[k]) * inverse[k] % np.uint64(PRIMES[k]) for k in range(2)]
    return f"{n}:{whole}:{_packed([s[at] for s in h.sums])}:{_packed(tails)}"


def _packed(residues: list[np.ndarray]) -> str:
    return base64.b64encode(np.stack(residues, axis=1).astype("<u4").tobytes()).decode("ascii")


class Points:
    """Residues of a fingerprint's prefixes (or suffixes) at multiples of its step, from 0."""

    def __init__(self, packed: str, step: int) -> None:
        self.step = step
        own = np.frombuffer(base64.b64decode(packed), "<u4").reshape(-1, 2).astype(np.int64)
        self.at = np.concatenate([np.zeros((1, 2), np.int64), own])

    def every(self, step: int) -> np.ndarray:
        return self.at[:: step // self.step]


def _spans(one: np.ndarray, two: np.ndarray, suffixes: bool, step: int) -> np.ndarray:
    """Which steps hold the same span, by the differences of neighbouring points."""
    n = min(len(one), len(two)) - 1
    a, b = one[: n + 1], two[: n + 1]
    out = np.ones(n, bool)
    for k, p in enumerate(PRIMES):
        # a suffix's points weigh BASE**step more in the next longer one
        factor = pow(BASES[k], step, p) if suffixes else 1
        out &= (a[1:, k] - a[:-1, k] * factor) % p == (b[1:, k] - b[:-1, k] * factor) % p
    return out


def extension_at(agree: np.ndarray, i: int) -> int:
    """Steps by which two texts agree from point i on, by binary search."""
    low, high = 0, len(agree) - i
    while low < high:
        mid = (low + high + 1) // 2
        if agree[i : i + mid].all():
            low = mid
        else:
            high = mid - 1
    return low


def _runs(agree: np.ndarray) -> list[tuple[int, int]]:
    out, i = [], 0
    while i < len(agree):
        n = extension_at(agree, i)
        if n:
            out.append((i, i + n))
        i += n + 1
    return out


def likeness(one: str, two: str) -> float:
    """Share of the longer text that the runs which two fingerprints have in common cover, 0 to 1."""
    if one == two:
        return 1.0
    n, _, prefix_n, suffix_n = one.split(":")
    m, _, prefix_m, suffix_m = two.split(":")
    a, b = int(n), int(m)
    shorter, longer = min(a, b), max(a, b)
    if not shorter:
        return 0.0
    steps = step_of(a), step_of(b)
    step = max(steps)
    covered: list[tuple[int, int]] = []
    for suffixes, x, y in ((False, prefix_n, prefix_m), (True, suffix_n, suffix_m)):
        agree = _spans(Points(x, steps[0]).every(step), Points(y, steps[1]).every(step), suffixes, step)
        if agree.any():
            # places in the longer text
            covered += [(longer - j * step, longer - i * step) if suffixes else (i * step, j * step) for i, j in _runs(agree)]
    total = end = 0
    for i, j in sorted(covered):
        total += max(0, j - max(i, end))
        end = max(end, j)
    return min(total, shorter) / longer


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, each, schema: T.StructType, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Stream ``docs`` (doc_id, text) in ascending doc_id; ``each(doc_id, text, next text)`` makes a row.

    Ties in doc_id go by text; null ids come first, null texts are empty; the row after the last is
    the first, so a table of one row follows itself. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = rows.filter(F.col("doc_id").isNotNull())
    n = rows.count()
    ranges = max(shuffle_partitions(spark), -(-n // range_rows))
    cuts = sorted(set(known.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100_000)).first()[0] or []))
    bounds = np.asarray(cuts, np.int64)

    @F.pandas_udf("int")
    def of(ids: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        return pd.Series(np.where(null, 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right")).astype(np.int32))

    ranged = rows.select(of("doc_id").alias("range"), "doc_id")
    firsts = sorted(tuple(r) for r in ranged.groupBy("range").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first")).collect())
    # the first row of a range is also the row that follows the range before it
    before = {first: (firsts[i - 1][0] if i else firsts[-1][0]) for i, (_, first) in enumerate(firsts)}
    heads = np.array(sorted(before), np.int64)
    owners = np.array([before[h] for h in heads.tolist()], np.int32)

    @F.pandas_udf("int")
    def owner(ids: pd.Series) -> pd.Series:
        # the range before the one that an id begins; -1 for other ids
        x = ids.fillna(NO_ID).to_numpy(np.int64)
        at = np.minimum(np.searchsorted(heads, x), max(len(heads) - 1, 0))
        return pd.Series(np.where(heads[at] == x, owners[at], -1).astype(np.int32) if len(heads) else np.full(len(x), -1, np.int32))

    own = rows.select(of("doc_id").alias("range"), F.lit(0).alias("tail"), "doc_id", "text")
    extra = rows.select(owner("doc_id").alias("range"), F.lit(1).alias("tail"), "doc_id", "text").filter("range >= 0")
    dealt = own.unionByName(extra).repartitionById(ranges, "range").sortWithinPartitions("range", "tail", "doc_id", "text")

    shape = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size, closed = None, [], 0, None
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                block, tail, doc_id, text = (c[i].as_py() for c in columns)
                if closed == block:
                    continue  # further rows with the id of a range's first row
                if held is not None and held[0] == block:
                    out.append(each(held[1], held[2], text))
                    size += len(text)
                held = (block, doc_id, text)
                if tail:
                    closed, held = block, None
                if size > 1 << 22 or len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    return dealt.mapInArrow(walk, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every row of ``documents`` and of its edited text; see with_next() for ties and nulls."""

    last = ["", fingerprint("")]  # the next text's fingerprint serves again as that text's own

    def each(doc_id: int | None, text: str, following: str) -> dict:
        other = edited(text, following)
        mine = last[1] if last[0] == text else fingerprint(text)
        changed = fingerprint(other)
        last[:] = following, fingerprint(following)
        return {
            "doc_id": doc_id,
            "n_chars": len(text),
            "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": mine,
            "edited_fingerprint": changed,
            "near_edited": likeness(mine, changed),
            "near_next": likeness(mine, last[1]),
        }

    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )
    return with_next(table(spark, sf_dir, "documents"), each, schema)
