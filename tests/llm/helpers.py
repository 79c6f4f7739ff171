from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("size", pa.string()), ("blob", pa.int64())])


def documents(tmp_path, rows):
    """A documents table with two extra columns whose names operators use inside; rows: (doc_id, text, lang, source)."""
    full = [(d, t, lang, s, None if t is None else len(t), "extra", 1) for d, t, lang, s in rows]
    columns = list(zip(*full, strict=True)) if full else [[] for _ in DOCS]
    pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, DOCS, strict=True)], schema=DOCS), tmp_path / "documents.parquet")
    return str(tmp_path)


def oracle(sql: str, folder: str, *tables: str):
    import duckdb

    db = duckdb.connect()
    for t in tables:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = db.sql(sql)
    return [dict(zip(got.columns, r, strict=True)) for r in got.fetchall()]


def same(df, rows):
    key = lambda r: tuple((v is not None, v) for _, v in sorted(r.items()))
    assert sorted((r.asDict() for r in df.collect()), key=key) == sorted(rows, key=key)
