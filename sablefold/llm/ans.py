"""Token ids in binary files: static range asymmetric numeral system, interleaved and blocked.

One table of frequencies, counted over all ids, is shared by every file. Ids are cut into blocks of
``BLOCK``; a block is coded by ``LANES`` interleaved states (id i belongs to state i mod LANES), so
one vector operation codes or decodes LANES ids. Each block carries its states, its words and a
checksum, and nothing of another block: blocks decode in any order and in parallel.

File layout (little endian):
  magic, version, crc of the frequency table, number of documents, ids, blocks
  document section: length, crc32 of header and section, zlib of the doc_ids (int64), a null mask and the lengths (int64)
  checkpoints: byte offset, first id and number of ids of every block, then their crc32
  blocks: number of ids, number of words, final states (uint64), words (uint32), crc32 of the ids

Documents lie in ascending doc_id; file k holds a range of ids below those of file k+1, and the
manifest (a parquet table of one row a file) says how many ids precede it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, folder, portions, shuffle_partitions, table, written
from .files import put, random_access

MAGIC, VERSION = b"SFRANS", 1
BLOCK = 1 << 17
LANES = 1024
#: Frequencies of the table add up to 2**SCALE; every id that occurs has at least 1.
SCALE = 22
LOW = np.uint64(1 << 31)
END_ID = 1
#: Documents of a sorted run, about, and documents and ids of a file, at most (one document at least).
RUN_DOCS = 20_000
FILE_DOCS, FILE_IDS = 20_000, 1 << 23


class AnsError(ValueError):
    """A file that its checksums or its framing contradict."""


class Table:
    """Frequencies of ids scaled to 2**SCALE."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Ids ascending and distinct, with positive counts; at most 2**SCALE of them."""
        if len(ids) > 1 << SCALE:
            raise AnsError("more distinct ids than the table's scale holds")
        self.ids = np.asarray(ids, np.int64)
        exact = np.asarray(counts, np.float64) / max(float(np.sum(counts)), 1.0) * (1 << SCALE)
        freq = np.maximum(1, np.floor(exact)).astype(np.int64)
        over = int(freq.sum()) - (1 << SCALE)
        if len(freq):
            # what rounding leaves goes to, or comes from, the most frequent ids
            order = np.argsort(-freq, kind="stable")
            if over < 0:
                freq[order[0]] -= over
            while over > 0:
                spare = np.minimum(freq[order] - 1, -(-over // len(order)) if over > len(order) else 1)
                take = np.where(np.cumsum(spare) <= over, spare, np.maximum(0, over - (np.cumsum(spare) - spare)))
                freq[order] -= take
                over -= int(take.sum())
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq, dtype=np.uint64)])[:-1]
        self.crc = zlib.crc32(self.ids.tobytes() + self.freq.tobytes())
        self._slots: np.ndarray | None = None

    def slots(self) -> np.ndarray:
        """Index of the id that owns each of the 2**SCALE slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(tab: Table, ids: np.ndarray) -> bytes:
    n = len(ids)
    index = np.searchsorted(tab.ids, ids)
    if n and (index.max() >= len(tab.ids) or np.any(tab.ids[index] != ids)):
        raise AnsError("an id that the table lacks")
    freq, start = tab.freq[index], tab.start[index]
    states = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    shift, scale = np.uint64(32), np.uint64(SCALE)
    limit = np.uint64(63 - SCALE)
    steps = -(-n // LANES)
    for s in range(steps - 1, -1, -1):
        f, c = freq[s * LANES : (s + 1) * LANES], start[s * LANES : (s + 1) * LANES]
        x = states[: len(f)]
        full = x >= (f << limit)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> shift, x)
        states[: len(f)] = ((x // f) << scale) + (x % f) + c
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return struct.pack("<II", n, len(stream)) + states.astype("<u8").tobytes() + stream.tobytes() + struct.pack("<I", zlib.crc32(np.asarray(ids, "<u4").tobytes()))


def decode_block(tab: Table, raw: bytes) -> np.ndarray:
    """Ids of a block, verified against its checksum."""
    if len(raw) < 12 + 8 * LANES:
        raise AnsError("a block ends early")
    n, count = struct.unpack_from("<II", raw)
    states = np.frombuffer(raw, "<u8", LANES, 8).astype(np.uint64)
    at = 8 + 8 * LANES
    if len(raw) != at + 4 * count + 4:
        raise AnsError("a block ends early")
    stream = np.frombuffer(raw, "<u4", count, at).astype(np.uint64)
    (crc,) = struct.unpack_from("<I", raw, at + 4 * count)
    slots, mask, scale = tab.slots(), np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    out, taken = np.empty(n, np.int64), 0
    for first in range(0, n, LANES):
        width = min(LANES, n - first)
        x = states[:width]
        slot = x & mask
        index = slots[slot.astype(np.int64)]
        out[first : first + width] = tab.ids[index]
        x = tab.freq[index] * (x >> scale) + slot - tab.start[index]
        need = x < LOW
        k = int(np.count_nonzero(need))
        if taken + k > count:
            raise AnsError("a block's words end early")
        x[need] = (x[need] << np.uint64(32)) | stream[taken : taken + k]
        taken += k
        states[:width] = x
    if taken != count or zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise AnsError("block checksum")
    return out


_HEAD = struct.Struct("<6sHIQQI")


def pack_file(tab: Table, doc_ids: list[int | None], lengths: np.ndarray, ids: Iterator[np.ndarray]) -> Iterator[bytes]:
    """Parts of one file; ``ids`` gives the ids in pieces of any length."""
    blocks, rest, total = [], np.zeros(0, np.int64), 0
    for piece in ids:
        rest = np.concatenate([rest, piece]) if len(rest) else np.asarray(piece, np.int64)
        while len(rest) >= BLOCK:
            blocks.append(encode_block(tab, rest[:BLOCK]))
            rest = rest[BLOCK:]
    if len(rest):
        blocks.append(encode_block(tab, rest))
    sizes = [struct.unpack_from("<I", b)[0] for b in blocks]
    total = sum(sizes)
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.asarray(lengths, "<i8").tobytes(), 1)
    head = _HEAD.pack(MAGIC, VERSION, tab.crc, len(doc_ids), total, len(blocks))
    at = len(head) + 8 + len(docs) + 24 * len(blocks) + 4
    points, first = b"", 0
    for b, n in zip(blocks, sizes, strict=True):
        points += struct.pack("<QQQ", at, first, n)
        at += len(b)
        first += n
    yield head + struct.pack("<II", len(docs), zlib.crc32(docs, zlib.crc32(head))) + docs + points + struct.pack("<I", zlib.crc32(points))
    yield from blocks


class Reader:
    """A file of ids, opened at random: documents(), and ids of any range through the checkpoints."""

    def __init__(self, source, tab: Table) -> None:
        self.source, self.tab = source, tab
        magic, version, crc, self.n_docs, self.n_ids, blocks = _HEAD.unpack(self._read(0, _HEAD.size))
        if (magic, version) != (MAGIC, VERSION):
            raise AnsError("not a file of ids")
        if crc != tab.crc:
            raise AnsError("the file was written with another table")
        at = _HEAD.size
        size, told = struct.unpack("<II", self._read(at, 8))
        docs = self._read(at + 8, size)
        if zlib.crc32(docs, zlib.crc32(self._read(0, at))) != told:
            raise AnsError("document section checksum")
        docs, n = zlib.decompress(docs), self.n_docs
        null = np.frombuffer(docs, np.uint8, n, 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(docs, "<i8", n), null, strict=True)]
        self.lengths = np.frombuffer(docs, "<i8", n, 9 * n)
        raw = self._read(at + 8 + size, 24 * blocks + 4)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise AnsError("checkpoint checksum")
        self.points = np.frombuffer(raw[:-4], "<u8").reshape(blocks, 3).astype(np.int64)
        self.size = source.size()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        out = self.source.read(n)
        if len(out) != n:
            raise AnsError("the file ends early")
        return bytes(out)

    def block(self, k: int) -> np.ndarray:
        start = int(self.points[k][0])
        end = int(self.points[k + 1][0]) if k + 1 < len(self.points) else self.size
        return decode_block(self.tab, self._read(start, end - start))

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids first to first + n - 1, decoding only the blocks that hold them."""
        out, k = [], int(np.searchsorted(self.points[:, 1], first, side="right")) - 1
        while n > 0:
            own = self.block(k)
            own = own[first - int(self.points[k][1]) :][:n]
            out.append(own)
            first, n, k = first + len(own), n - len(own), k + 1
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids), block after block."""
        held, at, k = np.zeros(0, np.int64), 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, at, held[:n]
            held, at = held[n:], at + n


#: Parts of words kept by a worker from one batch to the next; rows and bytes of text taken at once.
CACHE = 600_000
ROWS, SIZE = 4_000, 8 << 20
#: Latin-1 letters that composition and lower case treat one by one, and a run of them with signs after it.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PARTS = f"^(?P<head>{_LETTERS})(?P<tail>[!-~]*)$"


class Tokens:
    """Ids by a tokenizers file whose rules never join text across white space.

    Texts are cut at ASCII white space, and each distinct word goes through the library's own normalizer,
    pre-tokenizer and model, one after the other; a text's ids are those of its words in order. Words
    that may hold an added token, which the library looks for first, are encoded whole. A run of Latin-1
    letters, with ASCII signs after it, is put together from the two parts where a probe says that the
    file's rules make one piece of the letters and cut the signs off as if they stood alone.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = own = Tokenizer.from_file(path)
        self.normal = own.normalizer.normalize_str if own.normalizer is not None else lambda text: text
        self.cut = own.pre_tokenizer.pre_tokenize_str if own.pre_tokenizer is not None else lambda text: [(text, None)]
        self.model = own.model.tokenize
        # a character of each added token; a word without any of them holds none
        added = [t.content for t in own.get_added_tokens_decoder().values() if t.content]
        marks = {next((c for c in t if not c.isalnum()), t[0]) for t in added}
        self.odd = re.compile("[" + "".join(map(re.escape, sorted(marks))) + "]", re.IGNORECASE) if marks else None
        # what the rules make of each letter; a run of all of them must come out as one piece
        letters = [chr(c) for c in range(256) if re.fullmatch(_LETTERS, chr(c))]
        each = {c: self._by_rules(c) for c in letters}
        self.letters = {ord(c): p[0] for c, p in each.items() if len(p) == 1}
        self.probe = "".join(letters)
        self.simple = not any(c.isalnum() for c in marks) and self._by_rules(self.probe) == [self.probe.translate(self.letters)]
        self.lower = all(each[c] == each[c.lower()] for c in letters)
        self._start()

    def _start(self) -> None:
        """Nothing known but a word's missing second part. Keys: letters; a tab and signs; a line feed and a word."""
        self.known = Store()
        self.known.add(["\t"], np.zeros(1, np.int64), np.zeros(0, np.int64))

    def _by_rules(self, text: str) -> list[str]:
        return [p for p, _ in self.cut(self.normal(text))]

    def _ids(self, pieces: list[str]) -> list[int]:
        return [t.id for p in pieces for t in self.model(p)]

    def _learn(self, keys: list[str], ids: list[list[int]]) -> None:
        self.known.add(keys, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int64))

    def _heads(self, heads: list[str]) -> np.ndarray:
        new = [h for h in heads if h not in self.known.slot]
        self._learn(new, [self._ids([h if h.isascii() else h.translate(self.letters)]) for h in new] if self.lower else [self._ids([h.translate(self.letters)]) for h in new])
        return self.known.slots(heads)

    def _tails(self, tails: list[str]) -> np.ndarray:
        """Slots of signs after letters; -1 if the rules don't cut before them or an added token may be there."""
        probe = self.probe.translate(self.letters)
        new = {t: self._by_rules(t) for t in tails if "\t" + t not in self.known.slot and not (self.odd and self.odd.search(t))}
        fit = {t: p for t, p in new.items() if self._by_rules(self.probe + t) == [probe, *p]}
        self._learn(["\t" + t for t in fit], [self._ids(p) for p in fit.values()])
        return np.array([self.known.slot.get("\t" + t, -1) for t in tails], np.int64)

    def _wholes(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if "\n" + w not in self.known.slot]
        ids = [self.own.encode(w, add_special_tokens=False).ids if self.odd and self.odd.search(w) else self._ids(self._by_rules(w)) for w in new]
        self._learn(["\n" + w for w in new], ids)
        return self.known.slots(["\n" + w for w in words])

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Two slots for each of some distinct words."""
        out = np.zeros((len(words), 2), np.int64)
        parts = pc.extract_regex(words, _PARTS)
        fits = np.asarray(parts.is_valid()) & self.simple
        tails = pc.struct_field(parts, "tail").filter(pa.array(fits)).dictionary_encode()
        out[fits, 1] = self._tails(tails.dictionary.to_pylist())[np.asarray(tails.indices)] if fits.any() else 0
        fits &= out[:, 1] >= 0
        heads = pc.struct_field(parts, "head").filter(pa.array(fits))
        heads = (pc.utf8_lower(heads) if self.lower else heads).dictionary_encode()
        out[fits, 0] = self._heads(heads.dictionary.to_pylist())[np.asarray(heads.indices)] if fits.any() else 0
        out[~fits, 0], out[~fits, 1] = self._wholes(words.filter(pa.array(~fits)).to_pylist()), 0
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids); no nulls."""
        if len(self.known.slot) > CACHE:
            self._start()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        return self.known.put(self._slots(coded.dictionary)[np.asarray(coded.indices)].ravel(), 2 * np.asarray(split.value_lengths()).astype(np.int64))


_tokens: dict[str, Tokens] = {}


def packed(ids: np.ndarray) -> bytes:
    """Ids as bytes that sort like the ids: width, then big-endian numbers of 2 bytes (4, if any needs them)."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f">u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f">u{raw[0]}", offset=1).astype(np.int64)


def token_ids(docs: DataFrame, path: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """doc_id and ids (packed()) of ``docs`` (doc_id, text), an end id after each document. Null texts
    count as empty."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    tail = np.array([] if end_id is None else [end_id], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        for whole in batches:
            for batch in portions(whole, 1, ROWS, SIZE):
                counts, flat = _tokens[path].encode(pc.fill_null(batch.column(1), ""))
                rows = [packed(np.concatenate([x, tail])) for x in np.split(flat, np.cumsum(counts)[:-1])] if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def _lists(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a column of ids, arrays or packed(); null ones are empty."""
    column = batch.column(k)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        rows = [unpacked(r) if r else np.zeros(0, np.int64) for r in column.to_pylist()]
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array([len(r) for r in rows], np.int64)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()).astype(np.int64), lengths.astype(np.int64)


def count_ids(tokens: DataFrame) -> Table:
    """The shared table: counts of all ids. The driver receives one row for each distinct id, at most
    the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            flat, _ = _lists(batch, 0)
            own = np.bincount(flat) if len(flat) else np.zeros(0, np.int64)
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    return Table(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))


def write_tokens(tokens: DataFrame, tab: Table, target: str, run_docs: int = RUN_DOCS, file_ids: int = FILE_IDS) -> DataFrame:
    """Write ``tokens`` (doc_id, ids: arrays or packed()) below ``target`` in ascending doc_id (null first, ties by
    a hash of the ids, so many rows of one id spread over tasks). A task writes its run in files of at most
    ``file_ids`` ids or one longer document, and holds no more than one. Returns the manifest: file, piece, name,
    n_docs, n_ids, base (ids before the file)."""
    spark = tokens.sparkSession
    runs = max(shuffle_partitions(spark), -(-tokens.count() // run_docs))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("tie")).repartitionByRange(runs, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("file"), "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, lengths, pieces, held, done = [], [], [], 0, []

        def close(file: int) -> None:
            nonlocal doc_ids, lengths, pieces, held
            name = f"tokens-{file:06d}-{len(done):04d}.ids"
            put(target, name, pack_file(tab, doc_ids, np.concatenate(lengths), iter(pieces)))
            done.append((file, len(done), name, len(doc_ids), held))
            doc_ids, lengths, pieces, held = [], [], [], 0

        file = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column(0)[0].as_py()
            own = batch.column(1).to_pylist()
            flat, n = _lists(batch, 2)
            ends = np.cumsum(n)
            first = 0
            while first < len(own):
                before = int(ends[first - 1]) if first else 0
                last = int(np.searchsorted(ends, before + file_ids - held, side="right"))
                last = min(max(last, first + (not doc_ids)), first + FILE_DOCS - len(doc_ids), len(own))
                if last > first:
                    doc_ids += own[first:last]
                    lengths.append(n[first:last])
                    pieces.append(flat[before : int(ends[last - 1])].astype(np.int32))
                    held += int(ends[last - 1]) - before
                if last < len(own):
                    close(file)
                first = last
        if doc_ids:
            close(file)
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["file", "piece", "name", "n_docs", "n_ids"])

    listed = written(dealt.mapInArrow(run, "file int, piece int, name string, n_docs bigint, n_ids bigint"), "ids-files")
    upto = Window.orderBy("file", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return written(listed.withColumn("base", F.coalesce(F.sum("n_ids").over(upto), F.lit(0))), "ids-manifest")


def read_tokens(manifest: DataFrame, tab: Table, target: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids of every
    document, from the files that ``manifest`` lists. All blocks are decoded and verified either way."""
    wanted = ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in batches:
            for name, base in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                with random_access(target, name) as source:
                    for doc_id, at, ids in Reader(source, tab).documents():
                        rows.append((doc_id, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if wanted else None))
                        held += len(ids)
                        if held > 1 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spread = manifest.select("name", "base").repartition(max(shuffle_partitions(manifest.sparkSession), 1), "name")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_ids, starts, counts, crcs, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as token ids in files, read back."""
    tokens = written(token_ids(table(spark, sf_dir, "documents")), "ids")
    tab, target = count_ids(tokens), folder(spark, "id-files")
    manifest = write_tokens(tokens, tab, target)
    return read_tokens(manifest, tab, target, ids=False).drop("ids")
