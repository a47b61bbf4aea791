"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how often each of its documents is wanted on average. The whole part is taken as it
is; the fraction is a probability that has to become 0 or 1. Two documents at a time pass mass to each other, in words, at
random and without bias, until one of them is decided; the other goes on. So the sum of a source stays what it is, and
each document is taken with its own probability.

Documents of a source are dealt to groups of some :data:`GROUP`; a group leaves one undecided document, these are dealt to
groups again, until a source has one left: a reduction tree whose groups run apart. Large documents are decided before
small ones, in a few classes of size, and what the last document of a class is over or under its probability the smaller
classes make good, all alike. So a source ends within a few words of its target, if it has small documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluation

from . import scratch, words

#: Weights of sources by code point, repeating; the share of all sizes that the mix has; copies of a document at most.
WEIGHTS, SHARE, COPIES = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents that a group decides at once, about.
GROUP = 256
#: Sizes from which on a document belongs to the first, second, ... class.
CLASSES = (2048, 256, 32, 1)
U = np.uint64


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (its words ``[^\\x20\\x09-\\x0D]+``) and unit: rows equal in id, source and text share one."""
    import pyarrow as pa

    scratch.importable(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("unit", F.xxhash64("doc_id", "source", "text"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                n = [_count((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(n, pa.int64()), part.column("unit")], ["doc_id", "source", "size", "unit"])

    return rows.mapInArrow(run, "doc_id long, source string, size long, unit long")


def _count(text: bytes) -> int:
    space = words.SPACE[np.frombuffer(text, np.uint8)]
    return int((~space[1:] & space[:-1]).sum() + (~space[:1]).sum())


def targets(found: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = COPIES) -> DataFrame:
    """source, source_size, n_docs and target of each source of ``found`` (source, size).

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` of all sizes. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight, until none is above. Sources in the order
    of limit by weight tell at once which are at their limit: the first ones, as long as the level that the rest would
    come to is not below their own.
    """
    per = found.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    placed = _placed(per)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    rows = placed.select("source", "source_size", "n_docs", weight.alias("weight"), limit.alias("limit"), (limit / weight).alias("level"))
    levels = rows.groupBy("level").agg(F.sum("weight").alias("weight"), F.sum("limit").alias("limit"))
    totals = levels.agg(F.sum("weight").alias("all_weight"), (F.sum("limit") * (share / most)).alias("pool"))
    cum = evaluation.running(levels, "level", ["weight", "limit"]).crossJoin(F.broadcast(totals))  # one row of totals
    # with the limits below given out, the level of this one and all above
    left = (F.col("pool") - (F.col("cum_limit") - F.col("limit"))) / (F.col("all_weight") - (F.col("cum_weight") - F.col("weight")))
    water = cum.withColumn("left", left).filter("left < level").agg(F.min_by("left", "level").alias("water"))
    return rows.crossJoin(F.broadcast(water)).select("source", "source_size", "n_docs", F.least("limit", F.coalesce(F.col("weight") * F.col("water"), F.col("limit"))).alias("target"))  # one row of water


def _placed(per: DataFrame) -> DataFrame:
    """Sources with rn, from 1 by code point, null last: ranges of sources are numbered apart, after the counts of those
    before them."""
    place = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    cut = scratch.table(per.withColumn("place", place).repartitionByRange("place").withColumn("part", F.spark_partition_id()), "sources")
    before = cut.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("part").orderBy("place"))
    return cut.join(F.broadcast(before), "part").withColumn("rn", F.col("before") + inside)


def _uniform(a: np.ndarray | int, b: int) -> float:
    """A number from 0 to 1 that follows from two keys."""
    x = words.mix(np.array([a], U) ^ words.mix(np.array([b], U) * U(0x9E3779B97F4A7C15)))
    return float(x[0] >> U(11)) / (1 << 53)


def settle(size: np.ndarray, share: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, int]:
    """Shares after all documents but one are decided (0 or 1), and which is left (-1: none). Each step lets two undecided
    documents pass words to each other until one has a share of 0 or 1; shares keep their means, words their sum."""
    share = share.copy()
    held = -1
    key = unit.astype(np.int64).view(U)
    for i in range(len(size)):
        if not 0.0 < share[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, x, y = float(size[held]), float(size[i]), share[held], share[i]
        up, down = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)  # words that can go to the held one, or from it
        if _uniform(key[held], int(key[i])) * (up + down) < down:  # the nearer way is the likelier
            share[held], share[i] = (1.0, y - up / b) if up == (1 - x) * a else (x + up / a, 0.0)
        else:
            share[held], share[i] = (0.0, y + down / b) if down == x * a else (x - down / a, 1.0)
        if not 0.0 < share[held] < 1.0:
            held = i if 0.0 < share[i] < 1.0 else -1
    return share, held


def _settle_groups(rows: DataFrame) -> DataFrame:
    """Each (source, part) of rows (source, unit, size, share, part), decided but for one row."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "unit"], ascending=[False, True], kind="stable")
        share, _ = settle(group["size"].to_numpy(), group["share"].to_numpy(), group["unit"].to_numpy())
        return pd.DataFrame({"source": group["source"], "unit": group["unit"], "size": group["size"], "share": share})

    return rows.groupBy("source", "part").applyInPandas(run, "source string, unit long, size long, share double")


def _undecided() -> Column:
    return (F.col("share") > 0) & (F.col("share") < 1)


def mix(found: DataFrame, goal: DataFrame) -> DataFrame:
    """``found`` (see :func:`sizes`) with source_size, target and copies (0 or more) of each document, so that the sizes
    of the copies of a source come to its target of ``goal`` (see :func:`targets`).

    Sizes of 0 (null and empty texts) have no copies. Rows equal in id, source and text are one unit: all are taken
    alike. Chance follows from ids and texts alone, so reruns agree, however rows are dealt. Null ids and sources are
    values like others. An empty table has no rows.
    """
    spark = found.sparkSession
    goal = scratch.table(goal, "goal").withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    named = found.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    units = scratch.table(named.groupBy("name", "unit", "size").agg(F.count("*").alias("rows")).select("name", "unit", (F.col("size") * F.col("rows")).alias("size"), F.col("size").alias("each")).filter("size > 0"), "units")
    edge = [*CLASSES, 0]
    kind = sum((F.when(F.col("size") < c, 1).otherwise(0) for c in CLASSES[:-1]), F.lit(0))
    rest = scratch.table(units.groupBy("name", kind.alias("kind")).agg(F.sum("size").alias("size"), F.count("*").alias("n")), "classes")
    want = F.try_divide("target", "source_size")
    whole = F.floor(want)  # of target by size: the same for all documents of a source
    need = goal.select("name", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("need")).filter(want.isNotNull())
    done: list[DataFrame] = []
    for c in range(len(CLASSES)):
        left = rest.filter(F.col("kind") >= c).groupBy("name").agg(F.sum("size").alias("left"), F.max(F.when(F.col("kind") == c, F.col("n"))).alias("n")).filter("n IS NOT NULL")
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("need") / F.col("left")))
        level = scratch.table(left.join(need, "name").select("name", "n", "need", share.alias("share")), "level")
        most = level.agg(F.max("n")).first()[0]
        if most is None:
            continue
        rows = units.filter((F.col("size") >= edge[c]) & (F.col("size") < edge[c - 1]) if c else F.col("size") >= edge[c]).join(level.select("name", "n", "share"), "name")
        steps: list[DataFrame] = []
        while True:
            # hashes deal the n rows of a source to groups; the next step has one row of each
            parts = F.ceil(F.col("n") / GROUP).cast("long")
            dealt = rows.select(F.col("name").alias("source"), "unit", "size", "share", F.pmod(F.xxhash64("unit", F.lit(len(steps))), parts).alias("part"))
            steps.append(scratch.table(_settle_groups(dealt).withColumnRenamed("source", "name"), "settled"))
            if most <= GROUP:
                break
            most = -(-most // GROUP)
            rows = steps[-1].filter(_undecided()).join(level.select("name", F.ceil(F.col("n") / GROUP ** len(steps)).cast("long").alias("n")), "name")
        # what is left of a source now is one row, decided by its own share
        last = steps[-1].withColumn("share", F.when(_undecided(), (_chance() < F.col("share")).cast("double")).otherwise(F.col("share")))
        decided = last
        for s in steps[:-1]:
            decided = decided.union(s.filter(~_undecided()))
        decided = scratch.table(decided.select("name", "unit", "size", F.col("share").cast("long").alias("taken")), "decided")
        done.append(decided)
        got = decided.groupBy("name").agg(F.sum(F.col("size") * F.col("taken")).alias("got"))
        need = scratch.table(need.join(got, "name", "left").select("name", "whole", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")), "need")
    base = named.join(goal.select("name", "source_size", "target", whole.alias("whole")), "name")
    if not done:
        return base.select("doc_id", "source", "size", "unit", "source_size", "target", F.lit(0).cast("long").alias("copies"))
    taken = done[0]
    for d in done[1:]:
        taken = taken.union(d)
    out = base.join(taken.filter("taken = 1").select("name", "unit", F.lit(1).alias("one")).distinct(), ["name", "unit"], "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("one", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "unit", "source_size", "target", copies.alias("copies"))


def _chance() -> Column:
    return F.shiftrightunsigned(F.xxhash64("unit", F.lit(977)), 11) / F.lit(float(1 << 53))


def apply(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as it is taken, with a column ``copy`` (from 1)."""
    found = scratch.table(sizes(docs), "sizes")
    taken = mix(found, targets(found, **how)).filter("copies > 0").select("unit", "copies").distinct()
    keyed = docs.withColumn("__unit", F.xxhash64(docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"].cast("string")))
    return keyed.join(taken, keyed["__unit"] == taken["unit"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__unit", "unit", "copies")


def digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words that the mix takes of the document, repeats counted."""
    found = scratch.table(sizes(docs), "sizes")
    return mix(found, targets(found, **how)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
