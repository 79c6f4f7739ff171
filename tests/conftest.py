from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def table_dir(tmp_path, **tables):
    """Parquet tables in a folder, as the queries expect them; values are pandas frames or Arrow tables."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, t in tables.items():
        pq.write_table(t if isinstance(t, pa.Table) else pa.Table.from_pandas(t, preserve_index=False), tmp_path / f"{name}.parquet")
    return str(tmp_path)
