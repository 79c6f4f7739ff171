"""Shared helpers of the training-data operators: table access and the shared work folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Below the machine's temporary folder: where written tables go when a local session names no shared folder.
LOCAL_FOLDER = "sablefold-work"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names, shared by driver and executors."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/{LOCAL_FOLDER}"
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}" if base.startswith("/") else base
    base = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    # intermediate data of a session go when its driver ends
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a parquet table in the shared folder and read again: lineage ends here,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a worker's free memory to the machine: workers are kept when a task ends, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def word_count(text: Column) -> Column:
    """Words in a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Store:
    """Ids of strings, laid end to end: 4 bytes an id, and slots by string."""

    def __init__(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.size, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int64)

    def mark(self, slots: np.ndarray) -> None:
        """Count one use of strings, however often ``slots`` names them."""
        used = np.zeros(len(self.uses), bool)
        used[slots] = True
        self.uses += used

    def trim(self, most: int) -> None:
        """Where more than ``most`` strings are held, keep those used twice or more, at most half of ``most``
        and the most used first; uses count half from then on."""
        if len(self.slot) <= most:
            return
        order = np.argsort(-self.uses, kind="stable")[: most // 2]
        kept = np.sort(order[self.uses[order] > 1])
        keys = list(self.slot)  # in the order of their slots
        uses = self.uses[kept] >> 1
        sizes, values = self.put(kept, np.ones(len(kept), np.int64))
        self.__init__()
        self.add([keys[i] for i in kept.tolist()], sizes, values)
        self.uses[:] = uses

    def add(self, keys: list[str], sizes: np.ndarray, values: np.ndarray) -> None:
        n = len(self.start)
        self.slot.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.start = np.concatenate([self.start, len(self.values) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.values = np.concatenate([self.values, values.astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int64)])

    def slots(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))

    def put(self, slots: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of stored strings: (ids of each row, all ids). ``rows`` has the strings of each row."""
        sizes = self.size[slots]
        ends = np.cumsum(sizes)
        flat = self.values[np.repeat(self.start[slots] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(rows)])]
        return np.diff(upto), flat

    def put_together(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        slots = self.slots(list(chain.from_iterable(rows)))
        self.mark(slots)
        return self.put(slots, np.fromiter(map(len, rows), np.int64, len(rows)))


def portions(batch: pa.RecordBatch, at: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows whose column ``at`` holds ``size`` bytes (or list
    elements) at most; a longer value is a piece of its own."""
    column = batch.column(at)
    lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(np.asarray(lengths.fill_null(0)).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = min(first + rows, max(first + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(first, last - first)
        first = last
