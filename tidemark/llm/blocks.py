"""Documents in blocks, and a merged count-min sketch of what their blocks hold.

A block is a row with the texts of some thousand documents, written once to a bucketed table. Later passes read it
from there, so whole texts are not shuffled, and a lost executor costs its blocks only.

:func:`repeated` is the prefilter of two operators. Every block hashes its keys (64 bits) to the cells of a count-min
sketch, sends its partial sketch - sorted cells as gaps, in byte-aligned variable-length code - to the shards of the
cells, and gets back for each cell how large the merged count is: by powers of two, or only whether it is above 1.
A block counts a cell up to 256; within that, counts are never too low, so a key that two blocks share is always seen to
repeat. A hot key is one cell in each block, so it makes no task longer. A shard has a fixed number of cells, so that the
memory of a task does not grow with the data; the number of shards does.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, varbyte, words

#: Bytes of text in a block, about.
BLOCK = 4 << 20
#: Rows of the sketch; cells of a row for each key, about; bits of the number of a cell in its shard.
DEPTH, CELLS_PER_KEY, SHARD = 2, 2, 20
#: Documents of a block at most.
MOST = 1 << 20
SEEDS = (1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
NONE = np.iinfo(np.int64).max
FLAGS = "array<struct<row:int,shard:int,bits:binary>>"


@dataclass
class Block:
    ids: np.ndarray  # NONE: null
    lengths: np.ndarray
    data: bytes

    def texts(self) -> Iterator[bytes]:
        at = 0
        for n in self.lengths.tolist():
            yield self.data[at : at + n]
            at += n


def build(docs: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int]:
    """The block table of doc_id and text (null: empty): block, ids, lengths, data; and its number of buckets."""
    spark = docs.sparkSession
    scratch.importable(spark)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 20, [], [], 0

        def row() -> pa.RecordBatch:
            data = b"".join(texts)
            lengths = np.array([len(t) for t in texts], "<i8").tobytes()
            cols = [pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in (np.array([NONE if i is None else i for i in ids], "<i8").tobytes(), lengths, data))]
            return pa.RecordBatch.from_arrays(cols, ["block", "ids", "lengths", "data"])

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append((t or "").encode())
                    held += len(texts[-1])
                    if held >= size or len(ids) >= MOST:
                        yield row()
                        number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return scratch.bucketed(rows.mapInArrow(gather, "block long, ids binary, lengths binary, data binary"), "blocks", "block", n), n


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Block, list]]:
    """(number, block, flags) of each row; flags: the lists of the columns beyond."""
    for k in range(batch.num_rows):
        r = batch.slice(k, 1)
        number, ids, lengths, data = (r.column(c)[0].as_py() for c in range(4))
        yield number, Block(np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8"), data), [r.column(c)[0].as_py() or [] for c in range(4, r.num_columns)]
        scratch.released()


def per_block(rows: DataFrame, blocks: DataFrame, n: int, name: str) -> DataFrame:
    """``blocks`` with a column ``name``: the list of ``rows``' other columns for each block."""
    rest = F.struct(*(c for c in rows.columns if c != "block"))
    lists = rows.repartition(n, "block").groupBy("block").agg(F.collect_list(rest).alias(name))
    return blocks.join(lists.hint("shuffle_hash"), "block", "left")


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of keys in a row of the sketch; in the first, they ascend with the keys."""
    return (keys * np.uint64(SEEDS[row]) if row else keys) >> np.uint64(64 - bits)


def sketch_bits(keys: int) -> int:
    return max(16, int(np.ceil(np.log2(max(1, keys) * CELLS_PER_KEY))))


def shard_bits(bits: int) -> int:
    return min(SHARD, bits - 4)


def repeated(blocks: DataFrame, n: int, keys: Callable[[tuple[Block, list]], tuple[np.ndarray, np.ndarray]], bits: int, levels: bool = False) -> DataFrame:
    """``blocks`` with a column ``hot``, for :func:`looked_up`. ``keys`` gives, of an opened row, its distinct 64-bit
    keys, ascending, and how often the block counts each. ``levels``: keep powers of two, not only what is above 1."""
    low = np.uint64(shard_bits(bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, block, more in opened(b):
                found, often = keys((block, more))
                rows = []
                for row in range(DEPTH):
                    cell, count = _counted(cells(found, row, bits), often, row == 0)
                    for shard, lo, hi in _parts(cell, low):
                        at = (cell[lo:hi] & np.uint64((1 << int(low)) - 1)).astype(np.int64)
                        control, data = varbyte.pack(np.diff(at, prepend=0))
                        rows.append((row, shard, number, hi - lo, control, data, zlib.compress(np.minimum(count[lo:hi] - 1, 255).astype(np.uint8), 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, _SENT, strict=True)], _SENT_NAMES)

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << int(low), np.uint16)
        found = []
        for n, control, data, more in zip(*(group[c] for c in ("n", "control", "data", "more")), strict=True):
            at = np.cumsum(varbyte.unpack(control.as_py(), data.as_py(), n.as_py()), dtype=np.int32)
            total[at] = np.minimum(total[at] + (np.frombuffer(zlib.decompress(more.as_buffer()), np.uint8) + np.uint16(1)), 1 << 15)
            found.append(at)
        if levels:
            back = [zlib.compress(np.log2(total[at]).astype(np.uint8), 1) for at in found]
        else:
            back = [np.packbits(total[at] > 1).tobytes() for at in found]
        return pa.table([group["block"], group["row"], group["shard"], pa.array(back, pa.binary())], ["block", "row", "shard", "bits"])

    sent = blocks.mapInArrow(send, "row int, shard int, block long, n int, control binary, data binary, more binary")
    merged = sent.groupBy("row", "shard").applyInArrow(merge, "block long, row int, shard int, bits binary")
    return per_block(merged, blocks, n, "hot")


def _parts(cell: np.ndarray, low: np.uint64) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ascending cells."""
    shard = (cell >> low).astype(np.int64)
    edges = (np.flatnonzero(np.diff(shard)) + 1).tolist()
    return [(int(shard[lo]), lo, hi) for lo, hi in zip([0, *edges], [*edges, len(cell)], strict=True) if hi > lo]


_SENT = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_SENT_NAMES = ["row", "shard", "block", "n", "control", "data", "more"]


def _counted(cell: np.ndarray, often: np.ndarray, ascends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, and their counts in the block."""
    if not ascends:
        order = np.argsort(cell)
        cell, often = cell[order], often[order]
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    return cell[new], np.add.reduceat(often, new) if len(new) else often


def looked_up(found: np.ndarray, hot: list[dict], bits: int, levels: bool = False) -> np.ndarray:
    """Of the block's distinct keys (ascending), which may occur more than once, all blocks together; or with ``levels`` the power
    of two that the count estimate reaches. A function of the key alone, the same in all blocks."""
    low = np.uint64(shard_bits(bits))
    least = np.full(len(found), 255, np.uint8)
    for row in range(DEPTH):
        mine = {h["shard"]: h["bits"] for h in hot if h["row"] == row}
        cell, back = words.distinct(cells(found, row, bits)) if row else words.ascending(cells(found, row, bits))
        level = np.zeros(len(cell), np.uint8)
        for shard, lo, hi in _parts(cell, low):
            level[lo:hi] = np.frombuffer(zlib.decompress(mine[shard]), np.uint8) if levels else np.unpackbits(np.frombuffer(mine[shard], np.uint8), count=hi - lo)
        least = np.minimum(least, level[back])
    return least if levels else least > 0
