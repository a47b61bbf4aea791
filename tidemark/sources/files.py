"""File sources: JSON lines, framed binary records, CSV eras, tails and listings."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schema of captured trades, in both eras (rows without ``event`` are trades).
TRADES = "t double, slot long, sig string, event string, ev_ts long, mint string, user string, is_buy boolean, sol long, tok long, vsol long, vtok long, rsol long, rtok long, failed boolean, fee_lam long, cu long, cu_limit long, priority_fee_micro long, jito_tip_lam long, route string"


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType = TRADES, **options: str) -> DataFrame:
    """Rows of JSON lines with their file; lines that do not parse come with ``_corrupt_record`` and nulls."""
    kind = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    rows = spark.read.schema(StructType([*kind.fields]).add("_corrupt_record", "string")).options(mode="PERMISSIVE", **options).json(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def recent(spark: SparkSession, path: str | list[str], after: str, schema: str | StructType = TRADES) -> DataFrame:
    """Rows of JSON lines of files changed after a time ("2024-05-01T00:00:00", in the session's time zone): a window to start a
    stream from. Other files are dropped when listed, and never opened."""
    return json_lines(spark, path, schema, modifiedAfter=after)


def good(rows: DataFrame) -> DataFrame:
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


def era(rows: DataFrame) -> DataFrame:
    """With ``schema_era`` (1: no event names yet) and event filled in."""
    return rows.withColumn("schema_era", F.when(F.col("event").isNull(), 1).otherwise(2)).withColumn("event", F.coalesce("event", F.lit("TradeEvent")))


def kind(rows: DataFrame, *names: str) -> DataFrame:
    """Rows of an event log of some kinds."""
    return rows.filter(F.col("kind").isin(*names))


def since(rows: DataFrame, first_file: str, last_file: str | None = None) -> DataFrame:
    """Rows of files from ``first_file`` on, by name, up to and without ``last_file`` (the one being written)."""
    rows = rows.filter(F.col("file") >= first_file)
    return rows.filter(F.col("file") < last_file) if last_file else rows


def listing(paths: DataFrame) -> DataFrame:
    """One path for each file name without ``.gz``: the plain file before the compressed one, then by path."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.gz$", "")
    order = Window.partitionBy("name").orderBy(F.col("path").endswith(".gz"), "path")
    return paths.withColumn("name", name).withColumn("r", F.row_number().over(order)).filter("r = 1").select("name", "path").orderBy("name")


def tail(rows: DataFrame, order: Column | str, n: int) -> DataFrame:
    """The last ``n`` rows."""
    return rows.orderBy(F.desc(order) if isinstance(order, str) else order.desc()).limit(n)


def csv_trades(spark: SparkSession, path: str) -> DataFrame:
    """The CSV era: columns by header name, booleans as words."""
    raw = spark.read.option("header", True).csv(path)
    word = F.lower(F.trim("is_buy")).isin("true", "1", "t")
    return raw.select("mint", F.col("slot").try_cast("long").alias("slot"), F.col("event_timestamp").try_cast("double").alias("ts"), F.col("virtual_sol_reserves").try_cast("long").alias("vsol"), F.col("virtual_token_reserves").try_cast("long").alias("vtok"), F.col("real_sol_reserves").try_cast("long").alias("rsol"), (F.col("sol_amount_lamports").try_cast("double") / 1e9).alias("sol"), word.alias("is_buy"), "user")


#: A frame's header: receive time in ns, slot, bytes of payload.
HEADER = "<QQI"
HEADER_BYTES = struct.calcsize(HEADER)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """recv_ns, slot, payload and seq of binary frame files, stopping at a truncated end of a file."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, at, rows = memoryview(content.as_buffer()), 0, []
                while at + HEADER_BYTES <= len(raw):
                    ns, slot, n = struct.unpack_from(HEADER, raw, at)
                    if at + HEADER_BYTES + n > len(raw):
                        break
                    rows.append((name, len(rows), ns, slot, bytes(raw[at + HEADER_BYTES : at + HEADER_BYTES + n])))
                    at += HEADER_BYTES + n
                for lo in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 1024], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "seq", "recv_ns", "slot", "payload"])

    return files.mapInArrow(read, "file string, seq long, recv_ns long, slot long, payload binary")


def of_keys(rows: DataFrame, keys: DataFrame, on: str = "mint") -> DataFrame:
    """Rows of some keys."""
    return rows.join(keys.select(on).distinct(), on, "left_semi")
