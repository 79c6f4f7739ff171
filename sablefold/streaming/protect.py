"""Continuous input: each micro-batch is protected under one growing mapping table, exactly as a batch run would.

The mapping lives in parquet folders, one a batch id, so a batch that is run again after a failure
replaces its own rows. Values of earlier batches keep their replacements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.apply import apply
from ..operators.mapping import COLUMNS, SCHEMA, build
from ..operators.scrub import scrub
from ..plans.planner import Target


def _before(spark: SparkSession, path: str, batch: int, schema: str) -> DataFrame | None:
    """Rows of all batches before this one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(f"{schema}, batch bigint").parquet(path).filter(F.col("batch") < batch).drop("batch")


def protect_stream(stream: DataFrame, targets: list[Target], config: Config, mapping_path: str, output_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the protected stream as parquet. Targets are planned beforehand, on a sample or by hand."""
    config = config.resolved()

    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        known = _before(spark, mapping_path, batch, SCHEMA)
        mapping = build({"": (df, targets)}, config, known)
        fresh = mapping if known is None else mapping.join(known.select("path", "original"), ["path", "original"], "left_anti").select(*COLUMNS)
        fresh.write.mode("overwrite").parquet(f"{mapping_path}/batch={batch}")
        apply(df, targets, mapping, "", redacting=config.mode == "redact").write.mode("overwrite").parquet(f"{output_path}/batch={batch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scrub_stream(stream: DataFrame, text: str, session: str, order: list[str], dictionary_path: str, output_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Scrub prose per session; a session's dictionary goes on from batch to batch."""
    kind = stream.schema[session].dataType.simpleString()
    schema = f"`{session}` {kind}, value string, label string, token string"

    def each(df: DataFrame, batch: int) -> None:
        known = _before(df.sparkSession, dictionary_path, batch, schema)
        if known is not None:
            known = known.join(df.select(session).distinct(), session, "left_semi")
        out, table = scrub(df, text, [session], order, known)
        fresh = table if known is None else table.join(known.select(session, "value"), [session, "value"], "left_anti").select(session, "value", "label", "token")
        fresh.write.mode("overwrite").parquet(f"{dictionary_path}/batch={batch}")
        out.write.mode("overwrite").parquet(f"{output_path}/batch={batch}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
