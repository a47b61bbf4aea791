"""The tape: one row per event of a key, in a total order, and adapters that map tables to it.

Columns: key, seq (breaks ties in time), n (row of its key, from 1), ts (seconds), slot, is_buy, sol, actor, mid, vsol,
vtok, rsol, failed, tip. Every operator of the library is defined on these columns, never on a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: vsol * vtok of the price proxies: a middle price of 50 stands at 30e9 virtual reserves.
PRODUCT = 1.8e19
#: Virtual reserves of a fresh classic curve.
VIRTUAL = 30e9


def by_key(*order: str | Column) -> Window:
    return Window.partitionBy("key").orderBy(*(order or ("n",)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def _finished(rows: DataFrame, *order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    vsol, vtok = F.sqrt(F.lit(PRODUCT) * F.col("mid")), F.sqrt(F.lit(PRODUCT) / F.col("mid"))
    rsol = F.when(F.col("key") % 5 == 0, vsol).otherwise(vsol - F.lit(VIRTUAL))
    return rows.withColumns({"n": n, "vsol": vsol, "vtok": vtok, "rsol": rsol})


def events_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` by user: the value stands for price and size. Rows without a price have no valid reserves, and are left
    out, as everywhere in this library."""
    e = read(spark, sf_dir, "events").filter("value > 0")
    ts = seconds(e["ts"])
    rows = e.select(
        e["user_id"].alias("key"), e["event_id"].alias("seq"), ts.alias("ts"), F.floor(ts / 3600).alias("slot"), e["event_type"].isin("purchase", "signup", "click").alias("is_buy"), e["event_type"].alias("kind"), e["value"].alias("sol"), e["value"].alias("mid"),
        F.concat_ws("-", "event_type", (e["event_id"] % 7).cast("string")).alias("actor"), (e["event_type"] == "error").alias("failed"), F.get_json_object("props", "$.k").cast("double").alias("tip"),
    )
    return _finished(rows, "ts", "seq")


def lineitem_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` by part: many rows share a day, so the order beyond time matters."""
    i = read(spark, sf_dir, "lineitem")
    day = F.datediff(i["l_shipdate"].cast("date"), F.lit("1970-01-01").cast("date"))
    rows = i.select(
        i["l_partkey"].alias("key"), i["l_orderkey"].alias("seq"), i["l_linenumber"].alias("line"), i["l_suppkey"].alias("supp"), (day * F.lit(86400.0)).alias("ts"), day.cast("long").alias("slot"), (i["l_returnflag"] != "R").alias("is_buy"),
        i["l_quantity"].alias("sol"), (i["l_extendedprice"] / i["l_quantity"]).alias("mid"), i["l_suppkey"].cast("string").alias("actor"), (i["l_linestatus"] == "F").alias("failed"), i["l_tax"].alias("tip"),
    )
    return _finished(rows, "ts", "seq", "line", "supp")
