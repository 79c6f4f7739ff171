"""The shared work folder: written tables that end lineage, and ranks that no single task computes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Below the machine's temporary folder: where tables go when a local session names no shared folder.
LOCAL_FOLDER = "sablefold-work"
#: Rows up to which a window may rank a group as a whole.
WINDOW_ROWS = 1_000_000


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder of ``spark.checkpoint.dir``, which driver and executors share. What lies
    there goes when the session's driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/{LOCAL_FOLDER}"
    if base.startswith("/"):
        base = f"file://{base}"
    base = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the work folder, read again. Losing an executor costs a re-read."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def streamed(df: DataFrame, name: str, batch: int = 10_000) -> Iterator[tuple]:
    """Rows of ``df`` in their order, for the driver: read ``batch`` at once from a table of the work folder, so
    that no task sends them as its result. The table goes when they have been read."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.parquet(path)
    make = spark._jvm.org.apache.hadoop.fs.Path
    folder = make(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for part in sorted(n for f in store.listStatus(folder) if (n := f.getPath().getName()).startswith("part-")):
            with tempfile.TemporaryDirectory() as local:
                store.copyToLocalFile(False, make(f"{path}/{part}"), make(f"file://{local}/part"), True)
                with pq.ParquetFile(f"{local}/part") as file:
                    for some in file.iter_batches(batch):
                        yield from zip(*[c.to_pylist() for c in some.columns], strict=True)
    finally:
        store.delete(folder, True)


def stored(spark: SparkSession, rows: Iterable[tuple], schema: pa.Schema, name: str, batch: int = 10_000, batches: int = 50) -> DataFrame:
    """Rows that the driver makes one after another, as a table of the work folder: it holds ``batch`` of them at
    once and writes ``batches`` batches into a file."""
    path, rows, n = work_path(spark, name), iter(rows), 0
    make = spark._jvm.org.apache.hadoop.fs.Path
    store = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    some = list(islice(rows, batch))
    while some or not n:
        with tempfile.TemporaryDirectory() as local:
            with pq.ParquetWriter(f"{local}/part", schema) as file:
                for _ in range(batches):
                    columns = zip(*some, strict=True) if some else [()] * len(schema)
                    file.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
                    some = list(islice(rows, batch))
                    if not some:
                        break
            store.copyFromLocalFile(True, True, make(f"file://{local}/part"), make(f"{path}/part-{n:05d}.parquet"))
        n += 1
    return spark.read.parquet(path)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number from 0 in its group (all rows, if ``group`` is empty).

    Up to WINDOW_ROWS rows a window does it. Beyond, a range-partitioned sort does: a row's index in
    its partition plus the counts of the partitions before gives its overall rank, and the least rank
    of its group is taken off; a group may spread over any number of partitions.
    """
    if rows is None:
        df = written(df, "ranked")
        rows = df.count()
    keys = [F.col(c) for c in group]
    if rows <= WINDOW_ROWS:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // WINDOW_ROWS)
    runs = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    runs = written(runs.withColumn("__at", F.monotonically_increasing_id()), "ranked-runs")
    part = F.shiftright("__at", 33)
    counts = runs.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    overall = runs.withColumn("__part", part).join(counts, "__part").withColumn(name, F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    overall = overall.drop("__part", "__base", "__at")
    if not group:
        return overall
    least = overall.groupBy(*group).agg(F.min(name).alias("__least"))
    least = least.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], "__least")
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    return overall.join(least, same).select(*df.columns, (F.col(name) - F.col("__least")).alias(name))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    while name in df.columns:
        name += "_"
    return name
