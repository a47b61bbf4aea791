"""Tables cut from their lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared(df: DataFrame) -> str:
    """The folder of this session below ``spark.checkpoint.dir``; a folder of our own stands in only where none is set and
    all is local (tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df``, written by ``checkpoint()``: later jobs start there, also after a lost executor."""
    shared(df)
    return df.checkpoint()


def kept_rows(df: DataFrame) -> DataFrame:
    """``df``, written as a table of columns: for rows that are read more than once, some columns at a time."""
    folder = f"{shared(df)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def kept_by(df: DataFrame, column: str) -> DataFrame:
    """``df``, written as a table whose folders are the values of ``column``: a filter on it reads those rows only."""
    folder = f"{shared(df)}/kept-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
