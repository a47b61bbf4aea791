"""Token-ID / binary output: frequency-ranked ids in byte-aligned variable-length code.

Two passes. The first encodes every whole text and counts ids (a histogram per task, summed by Spark; its size is
that of the vocabulary). The second replaces ids by their frequency rank, so that common ids take one byte, deals
the coded documents out by the number of ids before them, in ascending doc_id order, and writes a segment file of some
``SEGMENT`` ids each.
``read`` decodes the files themselves.

Segment file: ``TMTK1\\n``, documents (u8), then for each document doc_id (i8, least value: null), tokens (u8),
control bytes (u8), data bytes (u8) as four columns, then all control bytes, then all data bytes. ``ranks.u4``
beside them holds the id of each rank. All numbers little-endian.

Cases: a null text counts as empty (its only id is ``end``); repeated doc_ids are all kept, next to each other; a
null doc_id sorts first; an empty table gives no documents; columns beyond doc_id and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, tokens, varbyte

MAGIC, NULL = b"TMTK1\n", np.iinfo(np.int64).min
#: Ids of a segment, about: what one task holds, but for a longer document.
SEGMENT = 4 << 20


def _open(uri: str):
    """The file system and path of a whole URI, for tasks: any that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def histogram(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents: at most ``size`` rows reach the driver."""
    kind = tokens.width(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in tokens.slices(batches, 1):
            total += np.bincount(np.frombuffer(b.column(0)[0].as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def starts(rows: DataFrame) -> DataFrame:
    """row_id, doc_id and ``start``: the ids of all documents before each, by doc_id (null first), then row_id; from
    row_id, doc_id, n_tokens. Ranges of documents are summed apart, and their totals carried over."""
    order = [F.asc_nulls_first("doc_id"), F.asc("row_id")]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = scratch.table(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each range
    inside = F.sum("n_tokens").over(Window.partitionBy("range").orderBy(*order)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "range").select("row_id", "doc_id", (F.col("before") + F.col("inside")).alias("start"))


def write(docs: DataFrame, file: str, at: str, end: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Write segment files below ``at``; returns their manifest (segment, docs, tokens), which is stored too."""
    spark = docs.sparkSession
    at = scratch.qualified(spark, at)
    size = tokens.vocabulary_size(file)
    kind = np.dtype(tokens.width(size))
    encoded, buckets = tokens.encode(docs, file, {"doc_id": "doc_id"}, end)
    counts = histogram(encoded, size)
    ids = np.argsort(-counts, kind="stable")
    rank = np.empty(size, np.uint32)
    rank[ids] = np.arange(size, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)  # the vocabulary bounds it
    fs, top = _open(at)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/ranks.u4") as out:
        out.write(ids.astype("<u4").tobytes())

    # the segment of a document follows from the ids before it, so copies of one doc_id are dealt out like any others
    placed = starts(tokens.documents(encoded).select("row_id", "doc_id", "n_tokens"))
    places = placed.select(F.shiftright("row_id", 20).alias("block"), F.struct("row_id", F.floor(F.col("start") / segment).alias("segment")).alias("place")).repartition(buckets, "block").groupBy("block").agg(F.collect_list("place").alias("places"))
    whole = encoded.join(places.hint("shuffle_hash"), "block").select("block", "doc_id", "n", "ids", "places")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for b in tokens.slices(batches, 1):
            doc_id, n = b.column(1).flatten(), np.asarray(b.column(2).flatten())
            coded = ranks[np.frombuffer(b.column(3)[0].as_buffer(), kind)]
            row_id, place = (np.asarray(x) for x in b.column(4).flatten().flatten())
            part = np.empty(len(n), np.int64)
            part[row_id & ((1 << 20) - 1)] = place
            ends = np.cumsum(n)
            for lo in range(0, len(n), 256):
                hi = min(len(n), lo + 256)
                packed = [varbyte.pack(coded[e - k : e]) for e, k in zip(ends[lo:hi].tolist(), n[lo:hi].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_id.slice(lo, hi - lo), pa.array(np.int64(b.column(0)[0].as_py() << 20) + np.arange(lo, hi)), pa.array(n[lo:hi]), pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary()), pa.array(part[lo:hi])], ["doc_id", "row_id", "n_tokens", "control", "data", "part"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(at)
        numbers = []

        def flush(rows: list[tuple]) -> tuple[int, int, int]:
            index = np.array([(NULL if i is None else i, n, len(c), len(d)) for i, n, c, d, _ in rows], "<i8").T
            number = rows[0][4]
            new = f"{top}/.{number}-{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(new) as out:
                for x in (MAGIC, len(rows).to_bytes(8, "little"), np.ascontiguousarray(index).tobytes(), *(r[2] for r in rows), *(r[3] for r in rows)):
                    out.write(x)
            fs.move(new, f"{top}/{number:020d}.tok")  # the same bytes, whichever attempt comes last
            return number, len(rows), int(index[1].sum())

        rows: list[tuple] = []
        for b in tokens.slices(batches):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[-1][4] != r[4]:
                    numbers.append(flush(rows))
                    rows = []
                rows.append(r)
        if rows:
            numbers.append(flush(rows))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)], ["segment", "docs", "tokens"])

    coded = whole.mapInArrow(code, "doc_id long, row_id long, n_tokens long, control binary, data binary, part long")
    ordered = coded.repartitionById(buckets, F.pmod("part", F.lit(buckets)).cast("int")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "row_id").select("doc_id", "n_tokens", "control", "data", "part")
    return scratch.table(ordered.mapInArrow(store, "segment long, docs long, tokens long"), "segments")


def read(spark: SparkSession, at: str) -> DataFrame:
    """One row per document of the files: segment, ordinal (in its segment), doc_id, first (ids before it in its
    segment), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    scratch.importable(spark)
    at = scratch.qualified(spark, at)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(at).select(F.regexp_extract("path", r"(\d+)\.tok$", 1).cast("long").alias("segment"), "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(at)
        with fs.open_input_stream(f"{top}/ranks.u4") as f:
            ids = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for segment, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = memoryview(content.as_buffer())
                if bytes(raw[:6]) != MAGIC:
                    raise ValueError(f"segment {segment} is not a token file")
                n = int.from_bytes(raw[6:14], "little")
                index = np.frombuffer(raw[14 : 14 + 32 * n], "<i8").reshape(4, n)
                first = np.cumsum(index[1]) - index[1]
                c = 14 + 32 * n
                d = c + int(index[2].sum())
                for lo in range(0, n, 2000):
                    out = []
                    for k in range(lo, min(n, lo + 2000)):
                        nc, nd = int(index[2, k]), int(index[3, k])
                        out.append(ids[varbyte.unpack(bytes(raw[c : c + nc]), bytes(raw[d : d + nd]), int(index[1, k]))].astype("<u4").tobytes())
                        c, d = c + nc, d + nd
                    part = slice(lo, lo + len(out))
                    doc = pa.array(index[0, part], pa.int64(), mask=index[0, part] == NULL)
                    yield pa.RecordBatch.from_arrays([pa.array([segment] * len(out), pa.int64()), pa.array(range(lo, lo + len(out)), pa.int64()), doc, pa.array(first[part]), pa.array(index[1, part]), pa.array(out, pa.binary())], ["segment", "ordinal", "doc_id", "first", "n_tokens", "ids"])

    return files.mapInArrow(decode, "segment long, ordinal long, doc_id long, first long, n_tokens long, ids binary")


def digest(spark: SparkSession, at: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""
    # one row per segment of tens of MB, so this window orders few rows
    before = manifest.select("segment", (F.sum("tokens").over(Window.orderBy("segment")) - F.col("tokens")).alias("before"))
    rows = read(spark, at).select("segment", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(before, "segment").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
