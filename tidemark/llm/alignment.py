"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, as relations.

Both tokenizers end a token before a space that follows a sign other than white space: the byte-level pre-tokenizer cuts
there, and no piece of the other vocabulary has a space after another sign (:func:`local` checks both; otherwise a text is
one segment). So a text's tokens are those of its segments, one segment after the other, every segment's end is a cut, and
groups and links lie within segments. Distinct segments are aligned once, for the whole corpus:

tokens are exploded with their positions, windowed sums of lengths give their ends, both sides meet on segment and end (an
equi-join in the form of a grouping: both lie in one partition, and an outer join would shuffle its result), rows with both
are cuts, and the running count of cuts numbers the groups. Links need no join: at each distinct end exactly one pair of
tokens stops to overlap, the next token of either side at or after it. So m tokens of a group cost m rows, not m * m.

Segments are partitioned by their key once, and all of this happens where they are. Documents stay in blocks that know
their segments by number; what is known of segments, a few bytes for each link, comes to blocks by one join.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens, varbyte

#: Bytes of text of a block, about, and its documents at most.
BLOCK, DOCUMENTS = 4 << 20, 1 << 16
#: Segments up to so many bytes stand for themselves as keys; longer ones have a digest.
SHORT = 32
NONE = np.iinfo(np.int64).max
#: Links of documents that are counted at once, about.
STEP = 1 << 18
#: Bits of an id in a packed link, which has both ids and whether a token of either side ends with it; bytes of a link.
ID, LINK = 18, 5
#: Segments that a task gathers by block before it sends them, and bytes of their links, about.
SENT, SENT_BYTES = 1 << 20, 1 << 26
#: What a task tells a block of its segments: gaps of their numbers in the block and links of each, in variable length, and the links.
KNOWN = ("number_control", "number_data", "size_control", "size_data", "links")
_CUT, _BLANKS = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.quick = tokens.Encoder(first)  # for segments without odd characters, some thousand at once
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True  # special strings in texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        back = {c: b for b, c in tokens._TO_ALPHABET.items() if b != 255}  # byte 255 is in no text
        special = set(self.a.get_added_tokens_decoder())
        size = self.a.get_vocab_size()
        if max(size, self.b.get_piece_size()) > 1 << ID:
            raise ValueError(f"ids have up to {ID} bits")
        plain = lambda s: bytes(back[ord(c)] for c in s) if all(ord(c) in back for c in s) else s.encode()
        self.bytes_a = [(t.encode() if i in special else plain(t)) if (t := self.a.id_to_token(i)) is not None else b"" for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        # by segments only if either tokenizer cuts there, whatever stands around
        self.local = tokens._byte_level(self.a) and not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode(" a  b ") == self.b.encode(" a") + self.b.encode(" b ")

    def segments(self, text: str) -> list[str]:
        """The parts of space+text that are encoded apart."""
        whole = " " + text
        body = whole.rstrip(" ")
        if not body or not self.local:
            return [whole]
        if _BLANKS.search(body):
            found = _CUT.split(body)
        else:  # no white space before any space: all of them cut
            found = [f" {w}" for w in body[1:].split(" ")]
        found[-1] += whole[len(body) :]  # spaces at the end begin no segment
        return found

    def encode(self, segments: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which segments have the same bytes on both sides; for each side all ids, and how many each segment has."""
        raw = [s.encode() for s in segments]
        odd = [k for k, s in enumerate(segments) if not self.quick.known_make or not s.isascii() and self.quick.odd.search(s)]
        rest = np.setdiff1d(np.arange(len(segments)), odd)
        one, n = self.quick.plain([raw[k] for k in rest.tolist()])
        if odd:
            more = [np.array(x.ids, np.int64) for x in self.a.encode_batch_fast([segments[k] for k in odd], add_special_tokens=False)]
            of, one = np.append(np.repeat(rest, n), np.repeat(odd, [len(x) for x in more])), np.concatenate([one, *more])
            order = np.argsort(of, kind="stable")
            one, n = one[order], np.bincount(of, minlength=len(segments))
        two = self.b.encode([s[1:] for s in segments], num_threads=1)
        ids, counts = [one.astype(np.int64), np.array([i for x in two for i in x], np.int64)], [n, np.array([len(x) for x in two], np.int64)]
        ok = np.ones(len(segments), bool)
        for table, sizes, i, c in ((self.bytes_a, self.size_a, ids[0], counts[0]), (self.bytes_b, self.size_b, ids[1], counts[1])):
            pieces = [table[k] for k in i.tolist()]
            length = np.bincount(np.repeat(np.arange(len(c)), c), sizes[i], len(c))
            if b"".join(pieces) != b"".join(raw) or (length != [len(r) for r in raw]).any():
                ends = np.cumsum(c).tolist()
                ok &= [b"".join(pieces[e - k : e]) == r for e, k, r in zip(ends, c.tolist(), raw, strict=True)]
        return ok, ids, counts


@lru_cache(maxsize=1)
def pair(first: str, second: str) -> Pair:
    return Pair(first, second)


def forget() -> None:
    """In a task that needs no tokenizers: what earlier tasks of the worker have left goes. Both with their caches are more than a
    block with its links."""
    if pair.cache_info().currsize:
        pair.cache_clear()
        gc.collect()
        scratch.released()


def key(segment: str) -> bytes:
    """What tells a segment from others: itself (a space first), or a zero and a digest."""
    raw = segment.encode()
    return raw if len(raw) <= SHORT else b"\0" + hashlib.blake2b(raw, digest_size=20).digest()


def _blocks(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Blocks of documents: ids, how many segments each has, their numbers in the block, and the block's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pair(first, second).segments
        number, ids, counts, at, known, held = TaskContext.get().partitionId() << 24, [], [], [], {}, 0

        def row() -> pa.RecordBatch:
            of = lambda x: pa.array([x.tobytes()], pa.binary())
            keys = [key(s) for s in known]
            long = [s if k[0] == 0 else None for s, k in zip(known, keys, strict=True)]
            cols = [pa.array([number], pa.int64()), of(np.array([NONE if i is None else i for i in ids], "<i8")), of(np.array(counts, "<i8")), of(np.concatenate(at) if at else np.zeros(0, "<u4")), pa.array([keys], pa.list_(pa.binary())), pa.array([long], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["block", "ids", "counts", "at", "keys", "long"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or ""
                parts = cut(text) if text else []
                ids.append(i)
                counts.append(len(parts))
                at.append(np.array([known.setdefault(s, len(known)) for s in parts], "<u4"))
                held += len(text)
                if held >= BLOCK or len(ids) >= DOCUMENTS:
                    yield row()
                    number, ids, counts, at, known, held = number + 1, [], [], [], {}, 0
                    scratch.released()
        if ids:
            yield row()
        known = {}
        scratch.released()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "block long, ids binary, counts binary, at binary, keys array<binary>, long array<string>")


def _encoded(segments: DataFrame, first: str, second: str) -> DataFrame:
    """key, ok, and the ids and byte lengths of both tokenizers, one after the other, for each row of segments (key, long);
    n_a says how many are of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(first, second)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                keys, long = part.column(0), part.column(1).to_pylist()
                ok, ids, counts = both.encode([x.decode() if s is None else s for x, s in zip(keys.to_pylist(), long, strict=True)])
                n = np.column_stack([np.where(ok, c, 0) for c in counts]).ravel()
                # both sides of a segment, one after the other
                of = np.concatenate([2 * np.repeat(np.arange(len(ok)), c) + side for side, c in enumerate(counts)])
                flat, size = np.concatenate(ids), np.concatenate([both.size_a[ids[0]], both.size_b[ids[1]]])
                order = np.argsort(of, kind="stable")
                order = order[ok[of[order] // 2]]
                offsets = pa.array(np.append(0, np.cumsum(n)[1::2]), pa.int32())
                cols = [keys, pa.array(ok), pa.array(n[::2].astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (flat, size))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "ok", "n_a", "ids", "sizes"])
        scratch.released()

    return segments.mapInArrow(run, "key binary, ok boolean, n_a int, ids array<int>, sizes array<int>")


def align(encoded: DataFrame) -> DataFrame:
    """The distinct ends of the tokens of each segment of ``encoded`` (key, ok, n_a, ids, sizes): key, end, a and b (the
    tokens that end there, null if none), g (the group, counted from the segment's end) and next_a, next_b: the link."""
    each = encoded.filter("ok").select("key", "n_a", F.posexplode(F.arrays_zip("ids", "sizes")).alias("pos", "t"))
    each = each.select("key", (F.col("pos") < F.col("n_a")).alias("is_a"), "pos", F.col("t.ids").alias("id"), F.col("t.sizes").alias("size"))
    to_here = Window.partitionBy("key", "is_a").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.select("key", "is_a", "id", F.sum("size").over(to_here).alias("end"))
    ends = ends.groupBy("key", "end").agg(F.max(F.when(F.col("is_a"), F.col("id"))).alias("a"), F.max(F.when(~F.col("is_a"), F.col("id"))).alias("b"))
    from_end = Window.partitionBy("key").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    return ends.select("key", "end", "a", "b", F.sum(cut).over(from_end).alias("g"), *(F.last(c, ignorenulls=True).over(from_end).alias(f"next_{c}") for c in ("a", "b")))


def packed(rows: DataFrame) -> DataFrame:
    """key, n_groups, and links: :data:`LINK` bytes for each row of :func:`align`, in order."""
    bit = lambda c, k: F.shiftleft(F.col(c).isNotNull().cast("long"), k)
    code = F.shiftleft(F.col("next_a").cast("long"), ID + 2).bitwiseOR(F.shiftleft(F.col("next_b").cast("long"), 2)).bitwiseOR(bit("a", 1)).bitwiseOR(bit("b", 0))
    per = rows.groupBy("key").agg(F.max("g").alias("n_groups"), F.sort_array(F.collect_list(F.struct("end", code.alias("code")))).alias("x"))
    return per.select("key", "n_groups", F.unhex(F.array_join(F.transform("x", lambda x: F.lpad(F.hex(x["code"]), 2 * LINK, "0")), "")).alias("links"))


def _bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of binaries start, and their bytes."""
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _sent(rows: DataFrame) -> DataFrame:
    """block, n and :data:`KNOWN` of rows (block, at, links): what a task knows of a block's segments is one row, as rows of single
    segments are more head than links."""

    def told(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, at, links = (np.concatenate([h[c] for h in held]) if c < 2 else pa.concat_arrays([h[c] for h in held]) for c in range(3))
        order = np.lexsort((at, block))
        block, at = block[order], at[order]
        offsets, raw = _bytes(links.take(pa.array(order)))
        new = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out = []
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(block)], strict=True):
            out.append((int(block[lo]), hi - lo, *varbyte.pack(np.diff(at[lo:hi], prepend=0)), *varbyte.pack(np.diff(offsets[lo : hi + 1]) // LINK), raw[offsets[lo] : offsets[hi]].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), *[pa.binary()] * len(KNOWN)], strict=True)], ["block", "n", *KNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, n, size = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append((b.column("block").to_numpy(), b.column("at").to_numpy(), b.column("links")))
                n, size = n + b.num_rows, size + b.column("links").nbytes
            if n >= SENT or size >= SENT_BYTES:
                yield from told(held)
                held, n, size = [], 0, 0
        if held:
            yield from told(held)
        held = []
        scratch.released()

    return rows.mapInArrow(run, "block long, n int, " + ", ".join(f"{c} binary" for c in KNOWN))


@dataclass
class Block:
    """An opened row: documents, and what is known of the segments of its block, by their numbers."""

    ids: np.ndarray
    counts: np.ndarray
    at: np.ndarray  # segments of all documents
    doc: np.ndarray  # the document of each
    fine: np.ndarray  # documents whose bytes are the same on both sides
    groups: np.ndarray
    a: np.ndarray  # links of all segments
    b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    first: np.ndarray  # of each segment: its first link, and one beyond the last

    @classmethod
    def of(cls, b: pa.RecordBatch, k: int) -> Block:
        ids, counts, at = (np.frombuffer(b.column(c)[k].as_py(), kind) for c, kind in (("ids", "<i8"), ("counts", "<i8"), ("at", "<u4")))
        at, doc, known = at.astype(np.int64), np.repeat(np.arange(len(counts)), counts), b.column("known")[k].values
        n = int(at.max()) + 1 if len(at) else 0
        size, code = np.zeros(n, np.int64), np.zeros(0, np.int64)
        if n:
            numbers, sizes = [], []
            for number_control, number_data, size_control, size_data, m in zip(*(known.field(c).to_pylist() for c in (*KNOWN[:4], "n")), strict=True):
                numbers.append(np.cumsum(varbyte.unpack(number_control, number_data, m), dtype=np.int64))
                sizes.append(varbyte.unpack(size_control, size_data, m).astype(np.int64))
            number, each = np.concatenate(numbers), np.concatenate(sizes)
            _, raw = _bytes(known.field("links"))
            code = np.zeros(len(raw) // LINK, np.int64)
            for c in range(LINK):
                code = code << 8 | raw[c::LINK]
            order = np.argsort(number)
            start, each = (np.cumsum(each) - each)[order], each[order]
            size[number[order]] = each
            code = code[np.arange(len(code)) + np.repeat(start - np.cumsum(each) + each, each)]
        mask = (1 << ID) - 1
        first, ok = np.append(0, np.cumsum(size)), size > 0  # a segment with tokens has a link
        cuts = np.append(0, np.cumsum((code & 3) == 3))
        groups = cuts[first[1:]] - cuts[first[:-1]]
        bad = np.bincount(doc[~ok[at]], minlength=len(counts)) > 0 if n else np.zeros(len(counts), bool)
        return cls(ids, counts, at, doc, ~bad, groups, (code >> (ID + 2)).astype(np.int32), ((code >> 2) & mask).astype(np.int32), (code & 2) > 0, (code & 1) > 0, first)

    def pairs(self) -> np.ndarray:
        return self.a.astype(np.int64) << 32 | self.b

    def sums(self, of_links: np.ndarray) -> np.ndarray:
        """Sums over the links of each segment."""
        total = np.append(0, np.cumsum(of_links, dtype=np.int64))
        return total[self.first[1:]] - total[self.first[:-1]]

    def said(self) -> list[bytes]:
        """The groups of each segment as text, each begun by a semicolon."""
        cut = self.ends_a & self.ends_b
        group = np.cumsum(cut) - cut
        of = [group[self.ends_a], group[self.ends_b]]
        before = [np.append(0, np.cumsum(np.bincount(g, minlength=int(cut.sum())))) for g in of]
        # of a group, all tokens of the first side come before those of the second
        place = [np.arange(len(of[0])) + before[1][of[0]], np.arange(len(of[1])) + before[0][of[1] + 1]]
        ids, mark = np.zeros(len(of[0]) + len(of[1]), np.int64), np.zeros(len(of[0]) + len(of[1]), np.uint8)
        for g, p, i, first in zip(of, place, (self.a[self.ends_a], self.b[self.ends_b]), b";|", strict=True):
            ids[p], mark[p] = i, np.where(np.append(True, g[1:] != g[:-1])[: len(g)], first, ord(","))
        digits = len(str((1 << ID) - 1))
        size = np.ones(len(ids), np.int64)
        text = np.zeros((len(ids), digits + 1), np.uint8)
        for k in range(digits):
            text[:, digits - k] = ids // 10**k % 10 + ord("0")
            size += (ids >= 10**k) if k else 1
        begin = digits + 1 - size
        text[np.arange(len(ids)), begin] = mark
        raw = text[np.arange(digits + 1) >= begin[:, None]].tobytes()
        tokens_of = np.append(0, np.cumsum(self.sums(self.ends_a) + self.sums(self.ends_b)))
        at = np.append(0, np.cumsum(size))[tokens_of].tolist()
        return [raw[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """block, pair, docs: how many documents of a block hold a pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                x = Block.of(batch, k)
                n = len(x.first) - 1
                code = np.unique(x.doc[x.fine[x.doc]] * n + x.at[x.fine[x.doc]])
                if not len(code):
                    continue
                doc, at = np.divmod(code, n)
                pairs, where = np.unique(x.pairs(), return_inverse=True)
                often = np.zeros(len(pairs), np.int64)
                each = np.diff(x.first)[at]
                links, lo = np.cumsum(each), 0
                while lo < len(doc):  # whole documents, some STEP links of them
                    hi = int(np.searchsorted(links, links[lo] + STEP))
                    hi = len(doc) if hi >= len(doc) else max(int(np.searchsorted(doc, doc[hi])), int(np.searchsorted(doc, doc[lo], side="right")))
                    size = each[lo:hi]
                    place = np.arange(int(size.sum())) + np.repeat(x.first[at[lo:hi]] - np.cumsum(size) + size, size)
                    held = np.unique(where[place] * len(x.counts) + np.repeat(doc[lo:hi], size)) // len(x.counts)
                    often += np.bincount(held, minlength=len(pairs))
                    lo = hi
                on = often > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(on.sum()), batch.column("block")[k].as_py())), pa.array(pairs[on]), pa.array(often[on])], ["block", "pair", "docs"])
                del x, code, doc, at, pairs, where, often, each, links, on
                scratch.released()

    return blocks.mapInArrow(run, "block long, pair long, docs long")


def _digests(blocks: DataFrame) -> DataFrame:
    """The result, a row for each document, of blocks with the list ``pairs`` (pair, docs, best)."""
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                x, pairs = Block.of(batch, k), batch.column("pairs")[k].values
                docs = best = np.zeros(len(x.a), np.int64)
                if pairs is not None and len(pairs):
                    key = pairs.field("pair").to_numpy()
                    order = np.argsort(key)
                    where = order[np.minimum(np.searchsorted(key[order], x.pairs()), len(key) - 1)]
                    docs, best = pairs.field("docs").to_numpy()[where], pairs.field("best").to_numpy()[where]
                values = [x.sums(x.ends_a), x.sums(x.ends_b), x.groups, x.sums(np.ones(len(x.a), np.int64)), x.sums(best), x.sums(docs)]
                sums = np.zeros((len(x.counts), len(names)), np.int64)
                last = np.cumsum(x.counts)
                for c, v in enumerate(values):
                    total = np.append(0, np.cumsum(v[x.at], dtype=np.int64))
                    sums[:, c] = total[last] - total[last - x.counts]
                sums[~x.fine] = 0
                said, end, text = x.said(), 0, []
                for fine, size in zip(x.fine.tolist(), x.counts.tolist(), strict=True):
                    text.append(hashlib.sha256(b"".join([said[i] for i in x.at[end : end + size].tolist()])[1:]).hexdigest() if fine and size else "")
                    end += size
                yield pa.RecordBatch.from_arrays([pa.array(x.ids, mask=x.ids == NONE), *(pa.array(sums[:, c]) for c in range(len(names))), pa.array(text)], ["doc_id", *names, "groups_sha256"])
                x = pairs = docs = best = values = said = text = key = order = where = None
                scratch.released()

    return blocks.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", groups_sha256 string")


def segments(docs: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks of documents; where segments are: key, long, block, at; segments: key, ok, n_a, ids, sizes), all written.
    A key is the segment's bytes, or a zero and a digest of a long one, whose text is in ``long``."""
    spark = docs.sparkSession
    scratch.importable(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = scratch.bucketed(_blocks(docs, first, second), "blocks", "block", n)
    placed = blocks.select("block", F.posexplode(F.arrays_zip("keys", "long")).alias("at", "x")).select("block", "at", F.col("x.keys").alias("key"), F.col("x.long").alias("long"))
    keyed = scratch.bucketed(placed.repartition(n, "key"), "keyed", "key", n)
    return blocks, keyed, scratch.bucketed(_encoded(keyed.select("key", "long").distinct(), first, second), "tokens", "key", n)


def digest(docs: DataFrame, first: str, second: str) -> DataFrame:
    """The alignment of space+text by ``first`` (a byte-level file of tokenizers) with text by ``second`` (a model of
    sentencepiece, which adds the space) for each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256. The groups and links themselves are rows of :func:`align` over :func:`segments`.

    Null and empty texts, and those whose joined bytes on either side are not space+text, have no tokens: zeros and ''.
    Repeated rows and null ids count as documents of their own. Texts may be of any length; a text without spaces is one
    segment. Special tokens' strings are plain text. Only the columns named are read; an empty table has no rows.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    begun = set(scratch.written(spark))
    blocks, keyed, encoded = segments(docs, first, second)
    known = encoded.select("key").join(packed(align(encoded)).select("key", "links"), "key", "left")
    known = keyed.select("key", "block", "at").join(known.hint("shuffle_hash"), "key").select("block", "at", F.coalesce("links", F.lit(b"")).alias("links"))
    lists = _sent(known).repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("n", *KNOWN)).alias("known"))
    joined = blocks.select("block", "ids", "counts", "at").join(lists.hint("shuffle_hash"), "block", "left")
    used = [p for p in scratch.written(spark) if p not in begun]
    linked = scratch.bucketed(joined, "linked", "block", n)
    scratch.clear(spark, used)  # the blocks know all of their segments now
    counts = scratch.bucketed(_pair_counts(linked).repartition(n, "pair"), "pairs", "pair", n)
    total = counts.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    most = total.groupBy("a").agg(F.max("docs").alias("most"))
    stats = total.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))  # a row for each id
    sent = counts.select("pair", "block").join(stats, "pair").repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("pairs"))
    return _digests(linked.join(sent.hint("shuffle_hash"), "block", "left"))
