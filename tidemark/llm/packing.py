"""Mixture-controlled packing of documents into sequences of a fixed number of tokens.

Each source is a queue. A window of ``window`` tokens takes from every queue its quota, the target share; a
document is served by the window in which its queue's quota reaches its first token, whole, so a queue overdraws
and the next window gives it that much less: deficit round-robin, with deficits carried through all windows.
Because quotas add up, the window of a document follows from the tokens before it in its queue, and these are
prefix sums. So no task walks a queue, and a source with a third of all rows is dealt over buckets like any other.
Shares are per window; when a queue runs dry, the others go on in their proportions.

Windows are laid end to end and cut every ``length`` tokens, so that only the last sequence is short.

Cases: a null text counts as empty (one token, ``end``); a null source is a queue of its own; repeated rows are
packed as often as they come; shares are by source (None: the null source), and a source of the table without a share or
a share without a source is an error; a document longer than a sequence, or than a window, runs on over the next; an empty
table gives no pieces; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens

#: Queues whose phases are broadcast; those of more are joined as tables of any size are.
MAX_QUEUES = 256
#: Buckets of a queue at most, and rows in a bucket, about, below that.
MAX_BUCKETS, BUCKET_ROWS = 1 << 16, 256
#: Windows whose order one task settles.
SPAN = 1 << 12


def schedule(totals: dict[str, int], shares: dict[str, float] | None, window: int) -> list[tuple[str, int, float, float]]:
    """(queue, its first token, window at that token, windows per token): piecewise linear, a phase for each set of
    queues that still hold tokens. Without ``shares``, each queue's share is its part of all tokens."""
    want = {q: float((shares or totals).get(q, 0)) for q, n in totals.items() if n}
    if any(x <= 0 for x in want.values()):
        least = min((x for x in want.values() if x > 0), default=1.0)
        want = {q: x if x > 0 else least * 1e-3 for q, x in want.items()}
    left, at, out = {q: float(totals[q]) for q in want}, 0.0, []
    while left:
        total = sum(want[q] for q in left)
        quota = {q: window * want[q] / total for q in left}
        out += [(q, round(totals[q] - left[q]), at, 1 / quota[q]) for q in sorted(left)]
        if shares is None:
            break  # all run dry together
        step = min(left[q] / quota[q] for q in left)
        left = {q: left[q] - step * quota[q] for q in left}
        left = {q: n for q, n in left.items() if n > 0.5}
        at += step
    return out


def _in_phases(rows: DataFrame, totals: DataFrame, shares: dict[str | None, float], window: int) -> DataFrame:
    """``rows`` with from, base and rate of the phase that each falls into."""
    wanted = {"" if s is None else f"={s}": x for s, x in shares.items()}
    # as many queues as there are shares, and one more that has none
    held = {r["queue"]: r["n"] for r in totals.limit(len(wanted) + 1).collect()}
    if odd := sorted(held.keys() ^ wanted.keys()):
        raise ValueError(f"sources without a share, or shares without a source: {[q[1:] if q else None for q in odd[:9]]}")
    phases = rows.sparkSession.createDataFrame(schedule(held, wanted, window), "served string, from long, base double, rate double")
    phases = phases.withColumn("to", F.coalesce(F.lead("from").over(Window.partitionBy("served").orderBy("from")), F.lit(1 << 62)))
    phases = F.broadcast(phases) if len(held) <= MAX_QUEUES else phases
    return rows.join(phases, (F.col("queue") == F.col("served")) & (F.col("p") >= F.col("from")) & (F.col("p") < F.col("to")))


def place(sizes: DataFrame, window: int = 1 << 16, shares: dict[str | None, float] | None = None) -> DataFrame:
    """row_id and ``at``, the document's first token in the stream of all windows; from row_id, source, n_tokens."""
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    buckets = max(1, min(MAX_BUCKETS, sizes.count() // BUCKET_ROWS))
    rows = sizes.select(queue.alias("queue"), F.pmod(F.xxhash64("row_id"), F.lit(buckets)).alias("bucket"), "row_id", "n_tokens")
    per = rows.groupBy("queue", "bucket").agg(F.sum("n_tokens").alias("n"))
    totals = per.groupBy("queue").agg(F.sum("n").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0]
    if not whole:
        return sizes.select("row_id", F.lit(0).cast("long").alias("at")).limit(0)
    # tokens before a document in its queue: those of earlier buckets, and of earlier rows of its bucket
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("queue").orderBy("bucket")) - F.col("n")).drop("n")
    if shares is None:  # a single phase, whatever the number of queues
        rates = totals.filter("n > 0").select("queue", F.lit(0).cast("long").alias("from"), F.lit(0.0).alias("base"), (1 / (F.lit(float(window)) * F.col("n") / F.lit(float(whole)))).alias("rate"))
        before = before.join(rates, "queue")
    inside = F.sum("n_tokens").over(Window.partitionBy("queue", "bucket").orderBy("row_id")) - F.col("n_tokens")
    rows = rows.withColumn("p", inside).join(before, ["queue", "bucket"]).withColumn("p", F.col("p") + F.col("before"))
    if shares is not None:
        rows = _in_phases(rows, totals, shares, window)
    rows = rows.select("queue", "row_id", "p", "n_tokens", F.floor(F.col("base") + (F.col("p") - F.col("from")) * F.col("rate")).alias("window"))
    rows = scratch.table(rows, "windows")
    # where each window's part of a queue begins in the stream
    part = rows.groupBy("window", "queue").agg(F.sum("n_tokens").alias("n"), F.min("p").alias("first"))
    part = part.withColumn("span", F.floor(F.col("window") / SPAN))
    spans = part.groupBy("span").agg(F.sum("n").alias("n"))
    spans = spans.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("span").orderBy("window", "queue")) - F.col("n")
    part = part.withColumn("inner", inner).join(spans, "span").select("window", "queue", (F.col("base") + F.col("inner") - F.col("first")).alias("shift"))
    return rows.join(part, ["window", "queue"]).select("row_id", (F.col("p") + F.col("shift")).alias("at"))


def pack(docs: DataFrame, file: str, length: int = 1024, window: int = 1 << 16, shares: dict[str | None, float] | None = None, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, padded (length of its sequence with
    padding), ids (binary, little-endian uint16 or uint32). Ids stay in the block they were encoded in: only row ids,
    sources and lengths are shuffled to find the places, and the places come back to their block."""
    size = tokens.vocabulary_size(file)
    kind = np.dtype(tokens.width(size))
    encoded, buckets = tokens.encode(docs, file, {"doc_id": "doc_id", "source": "source"}, end)
    rows = scratch.table(tokens.documents(encoded).select("row_id", "source", "n_tokens"), "sizes")
    placed = place(rows, window, shares)
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    short = total % length  # tokens in the last sequence, 0: it is full
    rest = min(length, 1 << (short - 1).bit_length()) if short else length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in tokens.slices(batches, 1):
            doc_id, n = block.column(0).flatten(), np.asarray(block.column(1).flatten())
            raw = memoryview(block.column(2)[0].as_buffer())
            row_id, place = (np.asarray(x) for x in block.column(3).flatten().flatten())
            at = np.empty(len(n), np.int64)
            at[row_id & ((1 << 20) - 1)] = place
            base = np.cumsum(n) - n
            for lo in range(0, len(n), 256):
                yield _pieces(doc_id, n, at, base, raw, lo, min(len(n), lo + 256))

    def _pieces(doc_id: pa.Array, n: np.ndarray, at: np.ndarray, base: np.ndarray, raw: memoryview, lo: int, hi: int) -> pa.RecordBatch:
        pieces = (at + n - 1)[lo:hi] // length - at[lo:hi] // length + 1
        row = lo + np.repeat(np.arange(hi - lo), pieces)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = at[row] // length + k
        first = np.maximum(sequence * length, at[row])
        last = np.minimum((sequence + 1) * length, (at + n)[row])
        start = first - at[row]
        w = kind.itemsize
        data = [bytes(raw[x * w : y * w]) for x, y in zip((base[row] + start).tolist(), (base[row] + last - at[row]).tolist(), strict=True)]
        padded = np.where(sequence == total // length, rest, length)
        cols = [doc_id.take(pa.array(row)), *(pa.array(x) for x in (start, last - first, n[row], sequence, first - sequence * length, padded)), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded", "ids"])

    places = placed.select(F.shiftright("row_id", 20).alias("block"), F.struct("row_id", "at").alias("place")).repartition(buckets, "block").groupBy("block").agg(F.collect_list("place").alias("places"))
    whole = encoded.join(places.hint("shuffle_hash"), "block").select("doc_id", "n", "ids", "places")
    return whole.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded long, ids binary")


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def digest(pieces: DataFrame, file: str) -> DataFrame:
    """The pieces with ``ids_crc32``, of their ids as little-endian unsigned 32-bit integers, in place of ``ids``."""
    kind = tokens.width(tokens.vocabulary_size(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, 1024):
            k = b.schema.get_field_index("ids")
            crc = [crc32_of(np.frombuffer(x.as_buffer(), kind)) for x in b.column(k)]
            yield b.set_column(k, "ids_crc32", pa.array(crc, pa.int64()))

    return pieces.mapInArrow(run, pieces.drop("ids").schema.add("ids_crc32", "long"))
