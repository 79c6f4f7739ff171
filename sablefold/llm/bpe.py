"""Byte-level BPE by DuckDB recursive queries, one database inside each Python worker.

Encoding: every text is cut into pieces by the vocabulary's pattern. The distinct pieces of a batch
that the worker has not met go into a table of token lists; a recursive query unfolds them into
token-position rows (piece, position, token, next token), joins those with the merge table, contracts
the leftmost pair of minimum rank of every piece, and ends at the fixpoint, when no piece has a pair
left. A piece's ids are then put
together for all its occurrences. Merging never crosses a piece, so texts of any length cost in
proportion to their distinct pieces.

A recursive step contracts one pair of each piece, so a piece of n bytes takes up to n steps.
Pieces longer than ``LONG`` bytes (runs of one letter, of white space) take the same rule, leftmost
pair of minimum rank first, through a heap in O(n log n); results are the same.

Decoding: rows (run of ids, position, id) join the vocabulary and an ordered aggregation concatenates
their bytes, in DuckDB as well; a run is a word, the distinct ones of a batch are decoded once, and
``BLOCK`` ids of them are one aggregate.

Memory: a batch's distinct pieces, caches of at most ``CACHE`` pieces and spans in each worker, from
which those seldom used go first, and DuckDB under ``MEMORY``. Only the vocabulary's path is shipped; nothing is collected or shuffled, and a
lost task is run again from its input alone.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, give_back, portions, table

#: Bytes from which a piece is merged through a heap.
LONG = 256
#: Pieces, and spans of pieces, kept by a worker from one batch to the next.
CACHE = 300_000
#: Rows and bytes of text (or ids) that a worker takes at once, and ids that one list of DuckDB's holds.
ROWS, SIZE, RUN = 2_000, 1 << 20, 1 << 18
#: Pieces that one recursive query merges, and ids that one ordered aggregate decodes.
LEARN, BLOCK = 40_000, 1 << 14
MEMORY = "128MB"

_ENCODE = """
WITH RECURSIVE state(piece, ids, live) AS (
  SELECT piece, ids, true FROM start
  UNION ALL
  SELECT s.piece,
    CASE WHEN b.top IS NULL THEN s.ids ELSE list_concat(s.ids[:(b.top & 4294967295) - 1], [b.top >> 32], s.ids[(b.top & 4294967295) + 2:]) END,
    b.top IS NOT NULL
  FROM state s LEFT JOIN (
    SELECT p.piece, min((m.merged << 32) | p.pos) AS top
    FROM (SELECT piece, (unnest(ids[:-2]) << 32) | unnest(ids[2:]) AS pair, unnest(range(1, len(ids))) AS pos FROM state WHERE live) p
    JOIN merges m ON m.pair = p.pair GROUP BY p.piece) b ON b.piece = s.piece
  WHERE s.live)
SELECT piece, ids FROM state WHERE NOT live ORDER BY piece
"""

_DECODE = """
SELECT t.doc, unhex(array_to_string(list(v.hex ORDER BY t.pos), '')) AS raw
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM texts) t JOIN vocab v ON v.id = t.id
GROUP BY t.doc
"""

#: Two characters of white space in a row, where text can't be cut at single spaces; and the cuts that
#: are safe there: a space between two other characters always begins a piece.
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"
_CUT = re.compile(r"(?<=\S)(?= \S)")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder of one vocabulary inside one process."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.pieces = regex.compile(pattern).findall
        # the cuts below are safe for the given pattern; texts of any other are cut by it alone
        self.cuts = pattern == _default_vocabulary()[1]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
        self.known, self.spans = Store(), Store()
        ids = self.ranks
        merges = [(ids[t[:i]], ids[t[i:]], r) for t, r in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids]
        a, b, merged = np.array(merges, np.int64).reshape(-1, 3).T
        self._table("merges", {"pair": pa.array(a << 32 | b), "merged": pa.array(merged)})
        del merges
        self._table("vocab", {"id": pa.array(list(ids.values()), pa.int64()), "hex": pa.array([t.hex() for t in ids], pa.string())})
        self.bytes = np.array([ids[bytes([i])] for i in range(256)], np.int64)
        self.spaced, self.lengths = np.zeros(max(ids.values()) + 1, bool), np.zeros(max(ids.values()) + 1, np.int64)
        self.lengths[list(ids.values())] = [len(t) for t in ids]
        self.spaced[[i for t, i in ids.items() if t.startswith(b" ")]] = True

    def _table(self, name: str, columns: dict) -> None:
        source = pa.table(columns)  # noqa: F841
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM source")

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces that the store lacks."""
        raws = [p.encode("utf-8", "surrogatepass") for p in new]
        direct = [i for i, r in enumerate(raws) if r in self.ranks]
        if direct:
            self.known.add([new[i] for i in direct], np.ones(len(direct), np.int64), np.array([self.ranks[raws[i]] for i in direct]))
        for i in [i for i, r in enumerate(raws) if len(r) > LONG and r not in self.ranks]:
            ids = self.merge(raws[i])
            self.known.add([new[i]], np.array([len(ids)]), np.array(ids))
        short = [i for i, r in enumerate(raws) if len(r) <= LONG and r not in self.ranks]
        if short:
            offsets = np.concatenate([[0], np.cumsum([len(raws[i]) for i in short])]).astype(np.int32)
            tokens = self.bytes[np.frombuffer(b"".join([raws[i] for i in short]), np.uint8)]
            self._table("start", {"piece": pa.array(range(len(short)), pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))})
            ids = self.db.sql(_ENCODE).to_arrow_table().column(1).combine_chunks()
            self.known.add([new[i] for i in short], np.asarray(ids.value_lengths()).astype(np.int64), np.asarray(ids.flatten()))

    def merge(self, raw: bytes) -> list[int]:
        """One piece by a heap of pairs: leftmost pair of minimum rank first."""
        toks: list[bytes | None] = [raw[i : i + 1] for i in range(len(raw))]
        n = len(toks)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := self.ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if toks[i] is not None else n
            if j >= n or len(toks[i]) + len(toks[j]) != len(both) or toks[i] + toks[j] != both:
                continue
            toks[i], toks[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := self.ranks.get(pair := toks[left] + toks[after[left]])) is not None:
                    heapq.heappush(heap, (r, left, pair))
        return [self.ranks[t] for t in toks if t is not None]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of texts (no nulls). A text is cut where a piece begins whatever stands around, mostly into
        words with their space; such spans repeat, so a span's ids are put together from its pieces once."""
        self.known.trim(CACHE)
        self.spans.trim(CACHE)
        odd = np.asarray(pc.match_substring_regex(texts, _RUN)) if self.cuts else np.ones(len(texts), bool)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        # where no white space follows white space, every single space begins a span
        words = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        coded = words.flatten().dictionary_encode()
        codes, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        rows = np.asarray(words.value_lengths()).astype(np.int64)
        head = np.zeros(len(codes), bool)
        head[np.cumsum(rows) - rows] = True
        at_head, later = (np.bincount(codes[x], minlength=len(names)) > 0 for x in (head, ~head))
        others = [_CUT.split(t) if self.cuts else [t] for t in texts.filter(pa.array(odd)).to_pylist()]
        first, spaced = [names[i] for i in np.flatnonzero(at_head)], [" " + names[i] for i in np.flatnonzero(later)]
        self._learn_spans(list({*first, *spaced}.union(*others).difference(self.spans.slot)))
        slots = np.empty((2, len(names)), np.int64)
        slots[0, later], slots[1, at_head] = self.spans.slots(spaced), self.spans.slots(first)
        rest = self.spans.slots(list(chain.from_iterable(others)))
        self.spans.mark(np.concatenate([slots[0, later], slots[1, at_head], rest]))
        counts, flat = self.spans.put(np.concatenate([slots[head.astype(np.int64), codes], rest]), np.concatenate([rows, np.fromiter(map(len, others), np.int64, len(others))]))
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat))
        return out.take(pa.array(np.argsort(order))) if len(others) else out

    def _learn_spans(self, new: list[str]) -> None:
        cut = [self.pieces(s) for s in new]
        pieces = list(set().union(*cut).difference(self.known.slot))
        for i in range(0, len(pieces), LEARN):
            self._learn(pieces[i : i + LEARN])
        self.spans.add(new, *self.known.put_together(cut))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of lists of ids; null lists are empty, ids that the vocabulary lacks have no bytes. Lists
        are cut before ids that begin with a space, and each distinct run of ids is decoded once."""
        lists = pc.fill_null(ids, pa.scalar([], ids.type))
        flat = np.ascontiguousarray(np.asarray(lists.flatten()), np.int32)
        ends = np.cumsum(np.asarray(lists.value_lengths()).astype(np.int64))
        cut = self.spaced[np.clip(flat, 0, len(self.spaced) - 1)]
        cut[::RUN] = True
        cut[ends[ends < len(flat)]] = True
        starts = np.append(np.flatnonzero(cut), len(flat))
        buffers = [None, pa.py_buffer((4 * starts).astype(np.int32)), pa.py_buffer(flat)]
        runs = pa.Array.from_buffers(pa.binary(), len(starts) - 1, buffers).dictionary_encode()
        sizes = np.asarray(pc.binary_length(runs.dictionary)).astype(np.int64) // 4
        own = np.frombuffer(runs.dictionary.buffers()[2], np.int32, int(sizes.sum()))
        # a block of runs is one ordered aggregate; a run's bytes lie where the sizes of its tokens say
        edges = np.append(np.arange(0, len(own), BLOCK), len(own)).astype(np.int32)
        self.db.register("texts", pa.table({"doc": pa.array(np.arange(len(edges) - 1)), "ids": pa.ListArray.from_arrays(pa.array(edges), pa.array(own))}))
        got = self.db.sql(_DECODE).to_arrow_table().sort_by("doc").column("raw").combine_chunks().to_pylist()
        known = np.where((own >= 0) & (own < len(self.lengths)), self.lengths[np.clip(own, 0, len(self.lengths) - 1)], 0)
        joined, at = b"".join(got), np.append(0, np.cumsum(known))
        if len(joined) != at[-1]:
            raise ValueError(f"decoding gave {len(joined)} bytes where the tokens hold {at[-1]}")
        raws = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at[np.append(0, np.cumsum(sizes))].astype(np.int32)), pa.py_buffer(joined)])
        every = raws.take(runs.indices)
        upto = np.append(0, np.cumsum(np.asarray(pc.binary_length(every)).astype(np.int64)))
        # the runs of a list lie side by side, and so do their bytes
        bounds = upto[np.searchsorted(starts, np.append(0, ends))]
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds.astype(np.int32)), every.buffers()[2]])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The process's codec of a vocabulary; made once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids (array of int) beside its own.

    Null texts count as empty and have no ids. Text that looks like a special token is ordinary text.
    A column of ``df`` named like ``ids`` is replaced.
    """
    return _mapped(df.drop(ids), text, [(ids, "array<int>")], path, pattern, lambda own, values: [own.encode(pc.fill_null(values, ""))])


def decode(df: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its token ids (binary; not always valid UTF-8) beside its own columns.
    Null ids decode to nothing."""
    return _mapped(df.drop(out), ids, [(out, "binary")], path, pattern, lambda own, values: [own.decode(values)])


def round_trip(df: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode() and decode() of what it gave, in one pass and one worker for each task."""

    def both(own: Codec, values: pa.Array) -> list[pa.Array]:
        tokens = own.encode(pc.fill_null(values, ""))
        return [tokens, own.decode(tokens)]

    return _mapped(df.drop(ids, out), text, [(ids, "array<int>"), (out, "binary")], path, pattern, both)


def _mapped(df: DataFrame, source: str, new: list[tuple[str, str]], path: str | None, pattern: str | None, work: Callable[[Codec, pa.Array], list[pa.Array]]) -> DataFrame:
    default = (None, None) if path and pattern else _default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]
    at, names = df.columns.index(source), [n for n, _ in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {kind}" for n, kind in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for whole in batches:
            for batch in portions(whole, at, ROWS, SIZE):
                yield pa.RecordBatch.from_arrays([*batch.columns, *work(own, batch.column(at))], names=[*batch.schema.names, *names])
                pa.default_memory_pool().release_unused()
        give_back()

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids: Column, decoded: Column) -> DataFrame:
    return df.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` encoded, and its ids decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(round_trip(docs), F.col("ids"), F.col("decoded"))
