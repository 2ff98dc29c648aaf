"""Intermediate tables of jobs that go over the same rows more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the folder that spark.checkpoint.dir names: what it took to make it is done once, and survives lost executors.

    A local session that names none gets a folder of its own; a cluster that names none has nowhere to write that all executors
    see, and works the frame out again for each pass.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            return df
        where = _LOCAL.setdefault(app, f"file://{tempfile.mkdtemp(prefix='spark-')}")
    path = f"{where.rstrip('/')}/strandmark-tables/{app}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
