import gzip
import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sablefold.llm import warc
from sablefold.llm.common import folder
from sablefold.llm.files import open_folder

from .helpers import oracle, same

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("keeper", pa.string())])
ROWS = [(1, "http://a/é\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "äö\r\n\r\n" * 50_000), (6, "u", "<p>one</p>"), (7, "", "last")]


def pages(tmp_path, rows):
    full = [(*r, "k") for r in rows]
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*full, strict=True) if full else [[]] * 4, SCHEMA, strict=True)], schema=SCHEMA), tmp_path / "pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("rows", [ROWS, [], ROWS + [(6, "u", "<p>one</p>"), (None, "u", "last"), (None, "u", "alone")]])
def test_equals_sql(spark, tmp_path, rows):
    d = pages(tmp_path, rows)
    same(warc.op4_warc(spark, d), oracle(warc.OP4_SQL, d, "pages"))


def test_archives_hold_what_was_written(spark, tmp_path):
    d, target = pages(tmp_path, ROWS), folder(spark, "warc")
    listing = warc.write_archives(spark.read.parquet(f"{d}/pages.parquet"), target)
    got = {r.page_id: r for r in warc.read_archives(listing, target).collect()}
    for page_id, _, html in ROWS:
        r = got[page_id]
        if r.record_type == "response":
            assert bytes(r.payload) == (html or "").encode()
        else:
            assert bytes(got[r.refers_to].payload) == (html or "").encode() and r.refers_to > page_id
    system, path = open_folder(target)
    for f in listing.collect():
        with system.open_input_stream(f"{path}/{f.name}", compression=None) as s:
            assert gzip.decompress(s.read()).count(b"WARC/1.1\r\n") == f.records


def _archive():
    parts = [warc.record(i, "u", bytes([65 + i]) * (i * 400_000), None, False) for i in range(3)]
    return parts, b"".join(parts)


def test_reader_frames_members_and_pieces(monkeypatch):
    parts, raw = _archive()
    for size in (7, 1 << 18):
        monkeypatch.setattr(warc, "PIECE", size)
        assert [len(p) for _, _, p in warc.read_records(io.BytesIO(raw[: len(parts[0])] if size == 7 else raw))] == ([0] if size == 7 else [0, 400_000, 800_000])


def test_reader_refuses_damage():
    parts, raw = _archive()
    plain = gzip.decompress(parts[1])
    for bad in (raw[:-5], raw + b"\x1f\x8b", gzip.compress(plain.replace(b"BBBB", b"BBCB", 1)), gzip.compress(plain[:-10]), gzip.compress(plain + b"x"), gzip.compress(b"nonsense\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
