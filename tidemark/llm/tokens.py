"""Whole texts to token ids, by a public tokenizer file, inside Spark tasks.

A batch of texts is cut into units as the byte-level pre-tokenizer does it - runs of letters, digits or other signs,
each with one space before it, and white space - by numpy over its bytes. Units are hashed, and looked up in a cache
of a fixed size; only those that it lacks go to the tokenizers library, each once a batch. Ids are then gathered for
all texts at once. Texts for which bytes do not tell letters from signs (other scripts, typographic signs), and those
that hold an added token literally, are encoded by the library whole, as are all texts under tokenizers of another make.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words

#: Non-ASCII characters other than these, all of them letters, need the library's own pre-tokenizer.
_ODD = "[^\\x00-\\x7f\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02af]"
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_TO_ALPHABET = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))} | {255: 0xFFFF}
_OTHER, _LETTER, _DIGIT, _SPACE = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _LETTER
_CLASS[[i for i in range(128) if chr(i).isalpha()]] = _LETTER
_CLASS[[i for i in range(128) if chr(i).isdigit()]] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
#: Bits of a cache slot's number, and ids that the cache holds: some 20 MB in all. Bytes of a unit that is cached.
SLOTS, POOL, LONGEST = 20, 1 << 22, 48
#: Bytes of text that are encoded at once, about.
BATCH = 1 << 20
U = np.uint64


def units(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the units begin, in the bytes of concatenated texts that end at ``ends``."""
    n = len(data)
    kind = _CLASS[data]
    space = kind == _SPACE
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    last = first[1:]  # the last byte of a text
    first = first[:-1]
    before = np.empty(n, np.uint8)  # class of the byte before; none at the start of a text
    before[0] = 255
    before[1:] = kind[:-1]
    before[first] = 255
    word_next = np.zeros(n, bool)
    word_next[:-1] = ~space[1:]
    word_next &= ~last
    blank = data == 32
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    # a chunk: a word with the space before it, or white space that goes with no word
    chunk = np.where(space, (before != _SPACE) | word_next, (before == 255) | (before == _SPACE) & ~after_blank)
    chunk |= first
    inner = ~space & ~chunk & (before != _SPACE) & (kind != before)
    if (quote := np.flatnonzero(data == 39)).size:  # 's, 't and the like: such words stay whole here
        number = np.cumsum(chunk)
        odd = np.zeros(int(number[-1]) + 1, bool)
        odd[number[quote]] = True
        inner &= ~odd[number]
    return np.flatnonzero(chunk | inner)


class Encoder:
    """Encodes batches of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.pieces = Tokenizer(self.tokenizer.model)  # the same vocabulary and merges, for units already split
        self.kind = np.dtype(width(self.tokenizer.get_vocab_size()))
        # The byte-level pre-tokenizer's pattern (public), for words with an apostrophe and long ones.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = re.compile(_ODD)
        self.known_make = self.tokenizer.normalizer is None and _byte_level(self.tokenizer)
        self.keys = np.zeros(1 << SLOTS, U)
        self.at = np.zeros(1 << SLOTS, np.int32)
        self.size = np.zeros(1 << SLOTS, np.uint8)
        self.pool = np.zeros(POOL, self.kind)
        self.used = 0

    def encode(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, and how many each has."""
        whole = [k for k, u in enumerate(found) if b"'" not in u and len(u) <= LONGEST]
        parts, of = [found[k] for k in whole], whole
        if len(whole) < len(found):
            cut = [(k, x.encode()) for k in sorted(set(range(len(found))).difference(whole)) for x in self.split.findall(found[k].decode())]
            parts, of = parts + [x for _, x in cut], whole + [k for k, _ in cut]
        # byte 255 is in no text
        shown = b"\xff".join(parts).decode("latin-1").translate(_TO_ALPHABET).split("\uffff")
        got = self.pieces.encode_batch([shown], is_pretokenized=True, add_special_tokens=False)[0]
        ids, unit = np.array(got.ids, self.kind), np.array(of, np.int64)[np.array(got.word_ids, np.int64)]
        order = np.argsort(unit, kind="stable")
        return ids[order], np.bincount(unit, minlength=len(found))

    def plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without odd characters, one after the other, and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        raw = b"".join(texts)
        if not raw:
            return np.zeros(0, self.kind), counts
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        start = units(data, ends)
        length = np.diff(np.append(start, len(data)))
        text = np.searchsorted(ends, start, side="right")
        inside = np.arange(len(data)) - np.repeat(start, length)
        value = words.BYTES[data] * words._powers(0xA24BAED4963EE407, int(length.max()))[inside]
        key = words.mix(np.add.reduceat(value, start) + length.astype(U)) | U(1)
        slot = (key >> U(64 - SLOTS)).astype(np.int64)
        short = length <= LONGEST
        hit = (self.keys[slot] == key) & short
        if self.used > POOL * 3 // 4:  # begin anew, so that memory stays bounded
            self.keys[:] = 0
            self.used, hit = 0, np.zeros_like(hit)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        pool = self.pool
        if (miss := np.flatnonzero(~hit & short)).size:
            order = miss[np.argsort(key[miss], kind="stable")]
            new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            one = order[new]
            ids, n = self.encode([raw[s : s + k] for s, k in zip(start[one].tolist(), length[one].tolist(), strict=True)])
            if self.used + len(ids) > len(pool):
                self.pool = pool = np.concatenate([pool[: self.used], np.zeros(len(ids) + POOL, self.kind)])
            pool[self.used : self.used + len(ids)] = ids
            where = self.used + np.cumsum(n) - n
            self.used += len(ids)
            self.keys[slot[one]], self.at[slot[one]], self.size[slot[one]] = key[one], where, n
            each = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            at[order], size[order] = where[each], n[each]
        if (long := np.flatnonzero(~short)).size:
            ids, n = self.encode([raw[s : s + k] for s, k in zip(start[long].tolist(), length[long].tolist(), strict=True)])
            at[long], size[long] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids])
        total = np.cumsum(size)
        out = pool[np.arange(int(total[-1])) + np.repeat(at - total + size, size)]
        counts += np.bincount(text, size, len(texts)).astype(np.int64)
        return out, counts

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        odd = [k for k, t in enumerate(texts) if not self.known_make or any(a in t for a in self.added) or not t.isascii() and self.odd.search(t)]
        if not odd:
            return self.plain([t.encode() for t in texts])
        is_odd = set(odd)
        ids, n = self.plain([t.encode() for k, t in enumerate(texts) if k not in is_odd])
        ends = np.cumsum(n)
        parts: list[np.ndarray] = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        for k in odd:
            parts.insert(k, np.array(self.tokenizer.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids, self.kind))
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _byte_level(tokenizer) -> bool:
    """Whether the tokenizer cuts texts as :func:`units` does, and has no other step."""
    import json

    made = json.loads(tokenizer.to_str())
    cut = made.get("pre_tokenizer") or {}
    return made["model"]["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not made.get("truncation") and not made.get("padding") and not made["model"].get("dropout")


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def encoder(file: str) -> Encoder:
    return Encoder(file)


@lru_cache(maxsize=4)
def vocabulary_size(file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).get_vocab_size()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what Python holds of them at once stays small, whatever the batch size."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def joined(arrays: list[np.ndarray], kind: np.dtype) -> pa.Array:
    """A binary column of one value for each array."""
    return pa.array([a.astype(kind).tobytes() for a in arrays], pa.binary())


def encode(docs: DataFrame, file: str, keep: dict[str, str], end: int = 0) -> tuple[DataFrame, int]:
    """A block table, in buckets of ``block``, and the number of its buckets. A row holds some hundred documents:
    block, the arrays of ``keep`` (output name to input column), ``n`` (array of how many ids each document has,
    ``end`` included) and ``ids`` (binary, see :func:`width`: those of all its documents, one after the other, each
    followed by ``end``). Later steps read ids where they are, and shuffle only what they say of documents. A null text
    counts as empty.
    """
    spark = docs.sparkSession
    scratch.importable(spark)
    kept = docs.select(*(docs[c].alias(n) for n, c in keep.items()), docs["text"].cast("string").alias("text"))
    schema = ", ".join(f"`{n}` array<{t}>" for n, t in kept.dtypes if n != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(file)
        number = TaskContext.get().partitionId() << 20
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            texts = [t or "" for t in rows["text"].to_pylist()]
            ids, n = encode_all(texts)
            place = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
            out = np.full(len(ids) + len(n), end, encode_all.kind)
            out[place] = ids
            lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows[c].combine_chunks()) for c in rows.column_names if c != "text"]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([n + 1], pa.list_(pa.int64())), pa.array([out.tobytes()], pa.binary())], ["block", *(c for c in rows.column_names if c != "text"), "n", "ids"])

        for b in slices(batches, 64):
            held.append(b)
            size += b.column(b.num_columns - 1).nbytes
            if size >= BATCH:
                yield row()
                held, size, number = [], 0, number + 1
        if held:
            yield row()

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return scratch.bucketed(kept.mapInArrow(run, f"block long, {schema}, n array<long>, ids binary"), "ids", "block", buckets), buckets


def documents(blocks: DataFrame) -> DataFrame:
    """A row for each document of a block table, without its ids: row_id (block and place), n_tokens and what else the
    table keeps."""
    each = [c for c in blocks.columns if c not in ("block", "ids")]
    rows = blocks.select("block", F.posexplode(F.arrays_zip(*each)).alias("at", "x"))
    return rows.select((F.shiftleft("block", 20).bitwiseOR(F.col("at").cast("long"))).alias("row_id"), F.col("x.n").alias("n_tokens"), *(F.col(f"x.{c}").alias(c) for c in each if c != "n"))
