"""Substring dedup: exact removal of long passages that an earlier document has, behind a count-min prefilter.

A window is ``size`` consecutive words of a document. First pass: blocks of documents hash all their windows, and
their partial count-min sketches are merged (:mod:`.blocks`); counts are only ever too high, so no repeated window is
lost. Second pass: the windows estimated as repeated, and only those, are grouped exactly by 128 bits of hash: each
block sends its distinct ones with their least doc_id, and gets back a bit for each, whether a smaller doc_id has it
too. A passage of thousands of documents is one entry in each block. Third pass: each block removes the words that
such windows cover, and joins what is left.

Windows are judged on the input. Cases: a null, empty or short text has no window and stays; copies and repeated
rows keep the one with the smallest doc_id, rows that share that doc_id all stay; a window that repeats only within
its own document stays; a null doc_id counts as the greatest; very long texts are read whole; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import varbyte, words

SIZE = 50


def _windows(block: B.Block, size: int) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, window starts, their 64-bit hashes, and the doc_id of each."""
    w = words.split(block.data, block.lengths)
    at, h = w.runs(size)
    return w, at, h, block.ids[w.doc_of(at)]


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and 2 where more than one document of the block has each, else 1."""
    order = np.argsort(h)
    h, doc = h[order], doc[order]
    if not len(h):
        return h, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[new], 1 + (np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new))


def _candidates(block: B.Block, hot: list[dict], bits: int, size: int):
    """Words; starts, docs and entry of each candidate window; and the entries: both hashes and least doc_id."""
    w, at, h, doc = _windows(block, size)
    found, place = words.distinct(h)
    keep = B.looked_up(found, hot, bits)[place]
    at, h, doc = at[keep], h[keep], doc[keep]
    every, second = w.runs(size, 1)
    g = second[keep]
    order = np.lexsort((doc, g, h))
    at, h, g, doc = at[order], h[order], g[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
    return w, at, doc, np.cumsum(new) - 1, h[new], g[new], doc[new]


def _shards(h: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ascending hashes."""
    edge = np.searchsorted(h, (np.arange(1, shards, dtype=np.uint64)) * np.uint64((1 << 64) // shards)) if shards > 1 else np.zeros(0, np.int64)
    return [(s, int(lo), int(hi)) for s, (lo, hi) in enumerate(zip([0, *edge], [*edge, len(h)], strict=True)) if hi > lo]


def dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed and text (the kept words, joined by one space) of every document."""
    blocks, n = B.build(docs)
    facts = blocks.agg(F.sum(F.length("data"))).first()[0] or 0
    bits = B.sketch_bits(facts // 6)  # windows, about
    shards = max(1, facts // (4 << 20))  # as many as the data need: each holds the candidates of some 4 MB

    def keys(row: tuple[B.Block, list]) -> tuple[np.ndarray, np.ndarray]:
        _, _, h, doc = _windows(row[0], size)
        return _distinct(h, doc)

    hot = B.repeated(blocks, n, keys, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, block, (flags,) in B.opened(b):
                _, _, _, _, h, g, least = _candidates(block, flags, bits, size)
                rows = []
                for s, lo, hi in _shards(h, shards):
                    ids, which = words.distinct(least[lo:hi])
                    control, data = varbyte.pack(which)
                    rows.append((s, number, h[lo:hi].astype("<u8").tobytes(), g[lo:hi].astype("<u8").tobytes(), ids.astype("<i8").tobytes(), control, data))
                types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, types, strict=True)], ["shard", "block", "h", "g", "ids", "control", "which"])

    def group(part: pa.Table) -> pa.Table:
        rows = part.to_pylist()
        h, g = (np.concatenate([np.frombuffer(r[c], "<u8") for r in rows]) for c in "hg")
        least = np.concatenate([np.frombuffer(r["ids"], "<i8")[varbyte.unpack(r["control"], r["which"], len(r["h"]) // 8)] for r in rows])
        order = np.lexsort((least, g, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
        smallest = np.empty_like(least)
        smallest[order] = least[order][new][np.cumsum(new) - 1]
        flag, at, out = smallest < least, 0, []
        for r in rows:
            k = len(r["h"]) // 8
            out.append(np.packbits(flag[at : at + k]).tobytes())
            at += k
        return pa.table([part["block"], part["shard"], pa.array(out, pa.binary())], ["block", "shard", "bits"])

    sent = hot.mapInArrow(send, "shard int, block long, h binary, g binary, ids binary, control binary, which binary")
    answers = sent.groupBy("shard").applyInArrow(group, "block long, shard int, bits binary")
    both = B.per_block(answers, hot, n, "seen")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, block, (flags, seen) in B.opened(b):
                w, at, doc, entry, h, _, least = _candidates(block, flags, bits, size)
                bit = {s["shard"]: s["bits"] for s in seen}
                smaller = np.zeros(len(h), bool)
                for s, lo, hi in _shards(h, shards):
                    smaller[lo:hi] = np.unpackbits(np.frombuffer(bit[s], np.uint8), count=hi - lo)
                gone = at[smaller[entry] | (doc > least[entry])]
                edge = np.zeros(len(w.hash) + size + 1, np.int32)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + size, -1)
                removed = np.cumsum(edge)[: len(w.hash)] > 0
                counts = np.diff(w.first)
                lost = np.add.reduceat(np.append(removed, False).astype(np.int64), w.first[:-1]) * (counts > 0) if len(counts) else counts
                texts = []
                for t, lo, hi, k in zip(block.texts(), w.first[:-1].tolist(), w.first[1:].tolist(), lost.tolist(), strict=True):
                    all_words = t.split() if k < hi - lo else []
                    if 0 < k < hi - lo:
                        all_words = [all_words[i] for i in np.flatnonzero(~removed[lo:hi]).tolist()]
                    texts.append(b" ".join(all_words).decode())
                cols = [pa.array(block.ids, pa.int64(), mask=block.ids == B.NONE), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "text"])

    return both.mapInArrow(remove, "doc_id long, n_words long, n_removed long, text string")
