"""Sinks: hourly JSON, journals, status snapshots, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_json(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """JSON lines, compressed, a folder for each hour; committed as a whole, so no orphans are left to recover."""
    rows.withColumn("hour", F.date_format(F.timestamp_seconds(F.col(ts)), "yyyyMMdd-HH")).write.mode("append").partitionBy("hour").option("compression", "gzip").json(path)


def stream_hourly(rows: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """The same from a stream, exactly once."""
    hours = rows.withColumn("hour", F.date_format(F.timestamp_seconds(F.col(ts)), "yyyyMMdd-HH"))
    return hours.writeStream.format("json").partitionBy("hour").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def journal(rows: DataFrame, path: str) -> None:
    """Append to an event-sourced journal."""
    rows.write.mode("append").json(path)


def latest(journal_rows: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """A journal's state: the last row of each key and kind, in columns."""
    last = F.max_by(F.struct(*(c for c in journal_rows.columns if c not in (key, kind))), order)
    return journal_rows.groupBy(key).pivot(kind, ["open", "snap", "close"]).agg(last)


def snapshots(stream: DataFrame, path: str, checkpoint: str):
    """Keep ``path`` as the current aggregate of a stream: each batch replaces it."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").json(path)

    return stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the values of ``changes`` where keys match; replaced values stay as ``orig_<column>``."""
    values = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in values))
    out = base.join(new, keys, "left")
    kept = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns]
    return out.select(*kept, *(F.when(F.col("_hit"), F.col(c)).alias(f"orig_{c}") for c in values))


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small result as a table for a report. Of more than ``most`` rows the first are shown, and a last line says so."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    found = rows.limit(most + 1).collect()
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found[:most]]
    return "\n".join(lines + [f"\nFirst {most} rows; there are more."] * (len(found) > most))
