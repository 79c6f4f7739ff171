"""Encrypted envelopes: AES-256-GCM by Spark's own functions, keys by scrypt.

``{"enc": "aes-gcm", "kdf": "scrypt" | "none", "salt"?, "nonce", "ct"}``, base64 values. A file of more than CHUNK
bytes has ``"chunks"`` (nonce and text of each) instead of the last two; a chunk is bound to its number and the
last one to being the last. A passphrase comes from the caller or from SABLEFOLD_PASSPHRASE.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import stored, streamed
from .documents import Reader

N, R, P, KEY, SALT, NONCE = 1 << 14, 8, 1, 32, 16, 12
#: Bytes that are sealed at once.
CHUNK = 1 << 18
CHUNKS = pa.schema([("at", pa.int64()), ("last", pa.bool_()), ("data", pa.binary())])


class CryptoError(ValueError):
    """A wrong key, a damaged envelope or no key at all."""


def derive(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=N, r=R, p=P, dklen=KEY, maxmem=64 << 20)


def _passphrase(given: str | None) -> str:
    found = given or os.environ.get("SABLEFOLD_PASSPHRASE")
    if not found:
        raise CryptoError("no passphrase")
    return found


def is_envelope(path: str) -> bool:
    try:
        return _head(path).get("enc") == "aes-gcm"
    except ValueError:
        return False


def _head(path: str) -> dict:
    """What a file says at its top, without its chunks and text; nothing, if it is no object."""
    top = {}
    with Reader(path) as doc:
        if doc.peek() == "{":
            for key in doc.items():
                top[key] = doc.value() if key in ("enc", "kdf", "salt") else doc.skip(3)
            doc.end()
    return top


def _call(spark: SparkSession, data: bytes, key: bytes, decrypt: bool) -> bytes:
    frame = spark.createDataFrame([(bytearray(data), bytearray(key))], "d binary, k binary")
    f = F.aes_decrypt if decrypt else F.aes_encrypt
    return bytes(frame.select(f("d", "k", F.lit("GCM")).alias("o")).first()[0])


def seal(spark: SparkSession, data: bytes, passphrase: str | None = None, key: bytes | None = None) -> bytes:
    out = {"enc": "aes-gcm", "kdf": "none" if key else "scrypt"}
    if key is None:
        salt = os.urandom(SALT)
        key, out["salt"] = derive(_passphrase(passphrase), salt), base64.b64encode(salt).decode()
    sealed = _call(spark, data, key, False)
    return json.dumps(out | {"nonce": base64.b64encode(sealed[:NONCE]).decode(), "ct": base64.b64encode(sealed[NONCE:]).decode()}).encode()


def unseal(spark: SparkSession, raw: bytes, passphrase: str | None = None, key: bytes | None = None) -> bytes:
    doc = json.loads(raw)
    if doc["kdf"] == "scrypt":
        key = derive(_passphrase(passphrase), base64.b64decode(doc["salt"]))
    if key is None:
        raise CryptoError("no key")
    try:
        return _call(spark, base64.b64decode(doc["nonce"]) + base64.b64decode(doc["ct"]), key, True)
    except PySparkException:
        raise CryptoError("wrong key or damaged envelope") from None


def _chunks(spark: SparkSession, parts: Iterator[bytes], key: bytes, decrypt: bool) -> Iterator[bytes | None]:
    """Parts sealed or opened by the executors, in order; None for one that doesn't open."""

    def numbered() -> Iterator[tuple]:
        n, now = 0, next(parts)
        for ahead in parts:
            yield n, False, now
            n, now = n + 1, ahead
        yield n, True, now

    table = stored(spark, numbered(), CHUNKS, "chunks", 16, 8)
    by = F.broadcast(spark.createDataFrame([(bytearray(key),)], "k binary"))  # one row, so that no plan shows it
    aad = F.concat(F.col("at").cast("string"), F.when(F.col("last"), ":last").otherwise(":")).cast("binary")
    mode, padding = F.lit("GCM"), F.lit("DEFAULT")
    out = F.try_aes_decrypt("data", "k", mode, padding, aad) if decrypt else F.aes_encrypt("data", "k", mode, padding, F.lit(b""), aad)
    return (r[0] for r in streamed(table.crossJoin(by).orderBy("at").select(out.alias("data")), "sealed", 16))


def seal_file(spark: SparkSession, path: str, out: str, passphrase: str | None = None) -> None:
    """A file's envelope as another file."""
    with open(path, "rb") as f, open(out, "wb") as to:
        if os.path.getsize(path) <= CHUNK:
            to.write(seal(spark, f.read(), passphrase))
            return
        salt = os.urandom(SALT)
        head = {"enc": "aes-gcm", "kdf": "scrypt", "salt": base64.b64encode(salt).decode(), "chunks": []}
        to.write(json.dumps(head).removesuffix("]}").encode())
        for n, sealed in enumerate(_chunks(spark, iter(lambda: f.read(CHUNK), b""), derive(_passphrase(passphrase), salt), False)):
            to.write(b"%s\n\"%s\"" % (b"," if n else b"", base64.b64encode(sealed)))
        to.write(b"]}")


def unseal_file(spark: SparkSession, path: str, out: str, passphrase: str | None = None) -> None:
    head = _head(path)
    with open(path, "rb") as f, open(out, "wb") as to:
        if "chunks" not in head:
            to.write(unseal(spark, f.read(), passphrase))
            return
        if head.get("kdf") != "scrypt":
            raise CryptoError("no key")
        for plain in _chunks(spark, _sealed(path), derive(_passphrase(passphrase), base64.b64decode(head["salt"])), True):
            if plain is None:
                raise CryptoError("wrong key or damaged envelope")
            to.write(plain)


def _sealed(path: str) -> Iterator[bytes]:
    with Reader(path) as doc:
        for key in doc.items():
            if key == "chunks":
                for _ in doc.elements():
                    yield base64.b64decode(doc.value())
            else:
                doc.value()
