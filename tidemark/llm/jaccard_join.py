"""N-gram Jaccard join: a parity-sketch join.

A document's set holds the 56-bit hashes of its distinct word shingles. The tokens of a set are dealt over the cells
of a sketch, and each cell keeps the XOR of its tokens: 64 parity sketches side by side. Cells in which two sketches
differ are at most as many as tokens in which the sets differ, and linked sets of sizes a and b differ in at most
(a + b) * (1 - t) / (1 + t). So by the pigeonhole principle linked sketches agree in all but that many cells, and
their rarest few must meet: of its filled cells each document sends only its rarest, one more than may differ.
Rarity is the count estimate of a merged count-min sketch of all cells (:mod:`.blocks`), the same for every block;
cells that occur once are never sent. Bands of set sizes share a number of cells; a document whose partners may lie
in the next band stands in both.

Groups of equal sets are one node from the start. Documents that share a cell are then linked in steps that never
form all pairs: each to the first of its cell (a verified star), components of those links, each to the nearest outside of
its component, and last the few cells that still join different components, pair by pair within chunks, where one-bit parity sketches (their Hamming
distance bounds the difference from below) leave little to verify. Every link counts, so components are exact.

Cases: null and wordless texts have an empty set, and are linked with nothing; fewer words than a shingle make one
token of the whole sequence; copies and repeated rows are linked; a null doc_id counts as the greatest, and is the
component's id only if there is no other; very long texts are read whole; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import scratch, words
from .components import components

U = np.uint64
#: Tokens for each cell at most: more leave too few filled cells for the pigeonhole. Sets up to SMALL tokens have a
#: cell for each token, in effect.
LOAD, SMALL, SMALL_CELLS, STEP = 1.8, 100, 1 << 20, 4
#: Seeds of the deal of tokens to cells. A deal under which some set fills too few cells for the pigeonhole is made
#: again; at this load, that is 12 standard deviations from what a set fills.
SEEDS = 8
#: Documents of a chunk in the last steps; rounds of nearest documents before all that are near.
CHUNK, ROUNDS = 512, 2
#: What a cell with several components tells its members.
MIXED = {"keys": "<u8", "largest": "<i8", "chunks": "<i4", "lowest": "<i8"}
#: Documents whose words are taken and whose tokens are sorted at once: with the number of the document before it, a hash has 56 bits.
SORTED, TOKEN = 256, U((1 << 56) - 1)
#: Documents for each file of the tables on the way, at least: partitions beyond that are more head than rows.
FILE = 4096


def token_sets(block: B.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct tokens of a block, in order."""
    out, data, ends = [], memoryview(block.data), np.append(0, np.cumsum(block.lengths))
    for lo in range(0, len(block.ids), SORTED):
        lengths = block.lengths[lo : lo + SORTED]
        w = words.split(data[ends[lo] : ends[lo + len(lengths)]], lengths, lower=True)
        at, h = w.runs(size)
        parts = [w.doc_of(at).astype(U) << U(56) | h >> U(8)]
        count = np.diff(w.first)
        for n in range(1, size):
            if (short := np.flatnonzero(count == n)).size:
                at, h = w.runs(n)
                parts.append(short.astype(U) << U(56) | words.mix(h[np.searchsorted(at, w.first[short])] + U(n)) >> U(8))
        some = np.sort(np.concatenate(parts))
        out.append((lo, some[np.append(True, some[1:] != some[:-1])] if len(some) else some))
    return np.concatenate([lo + (x >> U(56)).astype(np.int64) for lo, x in out] or [np.zeros(0, np.int64)]), np.concatenate([x & TOKEN for _, x in out] or [np.zeros(0, U)])


def cells_of(n: np.ndarray) -> np.ndarray:
    """Cells of the band of sets with ``n`` tokens."""
    out = np.full(len(n), SMALL_CELLS, np.int64)
    band, low = 256, SMALL
    while (n > low).any():
        out[n > low] = band
        low, band = int(band * LOAD), band * STEP
    return out


def may_differ(n: np.ndarray, t: float) -> np.ndarray:
    """Tokens at most by which a set of ``n`` differs from one it is linked with: the largest has n / t tokens."""
    return np.floor((n + np.floor(n / t + 1e-9)) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)


def sketch(doc: np.ndarray, h: np.ndarray, docs: int, t: float, seed: int) -> dict[str, np.ndarray]:
    """Filled cells of all documents in their bands: doc, key (of cell, content and band), tokens."""
    n = np.bincount(doc, minlength=docs)
    own, upper = cells_of(n), cells_of(np.floor(n / t + 1e-9).astype(np.int64))
    found = []
    for cells in np.unique(np.concatenate([own, upper[upper != own]])):
        in_band = (own == cells) | (upper == cells)
        pick = np.flatnonzero(in_band[doc])
        if not len(pick):
            continue
        d, x = doc[pick], h[pick]
        cell = (words.mix(x + U(seed)) & U(int(cells) - 1)).astype(np.int64)
        at = d * int(cells) + cell
        order = np.argsort(at)
        at = at[order]
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        content = np.bitwise_xor.reduceat(x[order], new)
        where = (at[new] % int(cells)).astype(U)
        key = words.mix(content ^ words.mix(where * U(0x9E3779B97F4A7C15) + U(int(cells))))
        found.append((at[new] // int(cells), key, np.diff(np.append(new, len(at))), np.full(len(new), cells)))
    parts = list(zip(*found, strict=True)) or [[np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    return dict(zip(("doc", "key", "tokens", "cells"), map(np.concatenate, parts), strict=True))


def parity_bits(h: np.ndarray, n: int) -> bytes:
    """A parity sketch of one bit a cell, four cells a token or so, of one set; its size follows from the set's."""
    bits = bits_for(n)
    return np.packbits((np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def bits_for(n: int) -> int:
    return 1 << max(6, math.ceil(math.log2(max(1, n))) + 2)


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _rows(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(types), types, strict=True)], names)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def gid(number: int, at: np.ndarray) -> np.ndarray:
    """A number for each row: block and place."""
    return (np.int64(number) << np.int64(20)) | np.asarray(at, np.int64)


def join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, first (whether the row stands for its component) and text_md5 of every
    document."""
    t = percent / 100
    blocks, n = B.build(docs)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, block, _ in B.opened(b):
                doc, h = token_sets(block, size)
                k = np.bincount(doc, minlength=len(block.ids))
                first = np.cumsum(k) - k
                total = np.concatenate([np.zeros(1, U), np.cumsum(words.mix(h), dtype=U)])
                other = np.concatenate([np.zeros(1, U), np.cumsum(words.mix(h ^ U(0x5DEECE66D)), dtype=U)])
                low, high = total[first + k] - total[first], other[first + k] - other[first]
                s = sketch(doc, h, len(block.ids), t, seed)
                filled = np.zeros((2, len(k)), np.int64)
                own = cells_of(k)
                for i, mine in enumerate((s["cells"] == own[s["doc"]], s["cells"] != own[s["doc"]])):
                    filled[i] = np.bincount(s["doc"][mine], minlength=len(k))
                need = may_differ(k, t) + 1
                bad = (k > 0) & ((filled[0] < need) | ((filled[1] > 0) & (filled[1] < need)))
                null = block.ids == B.NONE
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gid(number, np.arange(len(k)))), pa.array(block.ids, pa.int64(), mask=null), pa.array(k), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array(filled.sum(0)), pa.array(bad), pa.array([md5(x).digest() for x in block.texts()], pa.binary())],
                    ["gid", "doc_id", "n", "low", "high", "cells", "bad", "text_md5"],
                )

    for seed in range(SEEDS):
        each = blocks.mapInArrow(facts, "gid long, doc_id long, n long, low long, high long, cells long, bad boolean, text_md5 binary")
        rows, about = scratch.observed(each, "sets", cells=F.sum("cells"), bad=F.max("bad"), docs=F.count(F.lit(1)))
        if not about["bad"]:
            break
    else:
        raise ValueError(f"under each of {SEEDS} seeds some set fills too few cells")
    bits = B.sketch_bits(about["cells"] or 0)
    most = max(1, -(-about["docs"] // FILE))

    # equal sets: the first of them stands for all
    same = rows.filter("n > 0").groupBy("low", "high", "n").agg(F.min("gid").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "gid")).alias("least"), F.count("*").alias("copies"))
    same = scratch.table(same, "equal", most)
    many = same.filter("copies > 1").select("low", "high", "n", "rep")
    extra = rows.join(many, ["low", "high", "n"]).filter("gid <> rep").select(F.shiftright("gid", 20).alias("block"), F.col("gid").bitwiseAND((1 << 20) - 1).cast("int").alias("at"))
    blocks = B.per_block(extra, blocks, n, "copies")

    def cells(block: B.Block, more: list) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        doc, h = token_sets(block, size)
        keep = np.ones(len(block.ids), bool)
        keep[[c["at"] for c in more]] = False
        doc, h = doc[keep[doc]], h[keep[doc]]
        return doc, h, sketch(doc, h, len(block.ids), t, seed)

    def keys(row: tuple[B.Block, list]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(cells(row[0], row[1][0])[2]["key"], return_counts=True)

    hot = B.repeated(blocks, n, keys, bits, levels=True)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, block, (copies, flags) in B.opened(b):
                doc, h, s = cells(block, copies)
                found, back = words.distinct(s["key"])
                level = B.looked_up(found, flags, bits, levels=True)[back].astype(np.int64)
                # of each document and band, the rarest cells; among those the fullest. Cells that occur once come first,
                # and are not sent: where there are enough of them, nothing is
                sizes = np.bincount(doc, minlength=len(block.ids))
                need = may_differ(sizes, t) + 1
                group = s["doc"] * 2 + (s["cells"] != cells_of(sizes)[s["doc"]])
                once = np.bincount(group[level == 0], minlength=2 * len(sizes))
                some = np.flatnonzero((level > 0) & (once < np.repeat(need, 2))[group])
                order = some[np.lexsort((s["key"][some], -np.minimum(s["tokens"][some], 255), level[some], group[some]))]
                new = _starts(group[order])
                place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) + once[group[order]]
                sent = order[place < need[s["doc"][order]]]
                sent = sent[np.argsort(s["key"][sent], kind="stable")]
                first = np.cumsum(sizes) - sizes
                who = np.unique(s["doc"][sent])
                parity = [parity_bits(h[first[d] : first[d] + sizes[d]], int(sizes[d])) for d in who.tolist()]
                yield _rows(["block", "keys", "docs", "who", "sizes", "parity"], [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())], [(number, s["key"][sent].astype("<u8").tobytes(), s["doc"][sent].astype("<i4").tobytes(), gid(number, who).tolist(), sizes[who].tolist(), parity)])

    each = hot.mapInArrow(rarest, "block long, keys binary, docs binary, who array<long>, sizes array<long>, parity array<binary>")
    sent, amount = scratch.observed(each, "cells", most, keys=F.sum(F.length("keys")))
    scratch.settled(docs.sparkSession)
    entries = sent.select("block", "keys", "docs")
    known = sent.select(F.explode(F.arrays_zip("who", "sizes", "parity")).alias("x")).select(F.col("x.who").alias("gid"), F.col("x.sizes").alias("n"), F.col("x.parity").alias("parity"))
    shards = max(1, (amount["keys"] or 0) // (1 << 19))  # some 64,000 entries each

    def shard(h: np.ndarray) -> np.ndarray:
        return (h % U(shards)).astype(np.int64)

    # 1. each document and the first document of each of its cells
    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, d = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["docs"], "<i4")
                new = _starts(h)
                h, d = h[new], np.minimum.reduceat(d, new) if len(new) else d
                s = shard(h)
                order = np.argsort(s, kind="stable")
                for at in np.split(order, _starts(s[order])[1:]) if len(order) else []:
                    yield _rows(["shard", "block", "keys", "docs"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], [(int(s[at[0]]), r["block"], h[at].tobytes(), d[at].tobytes())])

    def star(part: pa.Table) -> pa.Table:
        got = part.to_pylist()
        h = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in got])
        g = np.concatenate([gid(r["block"], np.frombuffer(r["docs"], "<i4")) for r in got])
        order = np.lexsort((g, h))
        new = _starts(h[order])
        least = np.empty_like(g)
        least[order] = np.repeat(g[order][new], np.diff(np.append(new, len(order))))
        at, out = 0, []
        for r in got:
            k = len(r["keys"]) // 8
            less = np.flatnonzero(least[at : at + k] < g[at : at + k])
            out.append((h[at : at + k][less].astype("<u8").tobytes(), least[at : at + k][less].astype("<i8").tobytes()))
            at += k
        return pa.table([part["block"], pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["block", "keys", "first"])

    answers = entries.mapInArrow(firsts, "shard int, block long, keys binary, docs binary").groupBy("shard").applyInArrow(star, "block long, keys binary, first binary")
    answered = entries.join(answers.groupBy("block").agg(F.collect_list(F.struct("keys", "first")).alias("found")), "block", "left")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                h, d = np.frombuffer(r["keys"], "<u8"), gid(r["block"], np.frombuffer(r["docs"], "<i4"))
                if not len(h):
                    continue
                new = _starts(h)
                least = np.minimum.reduceat(d, new)
                distinct = h[new]
                for f in r["found"] or []:
                    least[np.searchsorted(distinct, np.frombuffer(f["keys"], "<u8"))] = np.frombuffer(f["first"], "<i8")
                every = np.repeat(least, np.diff(np.append(new, len(h))))
                other = every != d  # the first document of a cell has met all others of it after this step
                two = np.unique(np.stack([every, d])[:, other], axis=1)
                yield _rows(["block", "keys", "docs", "a", "b"], [pa.int64(), *[pa.binary()] * 4], [(r["block"], h[other].tobytes(), np.frombuffer(r["docs"], "<i4")[other].tobytes(), two[0].tobytes(), two[1].tobytes())])

    entries = scratch.table(answered.mapInArrow(resolve, "block long, keys binary, docs binary, a binary, b binary"), "others", most)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], "<i8")) for c in "ab"], ["a", "b"])

    verify = lambda p, near=False: _verified(p, known, blocks, n, size, percent, near, most)
    links, _ = verify(entries.select("a", "b").mapInArrow(pairs, "a long, b long"))
    labels = components(links, most)

    # 2. cells that hold documents of several components beside their first
    entries = entries.select("block", "keys", "docs")

    def label(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, d = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["docs"], "<i4")
        g = gid(r["block"], d)
        if r["labels"]:
            at = np.array([x["at"] for x in r["labels"]])
            order = np.argsort(at)
            at, to = at[order], np.array([x["label"] for x in r["labels"]])[order]
            k = np.minimum(np.searchsorted(at, d), len(at) - 1)
            return h, g, np.where(at[k] == d, to[k], g)
        return h, g, g

    def holdings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The components in each cell, and how many documents of the block each has there."""
        for b in batches:
            for r in b.to_pylist():
                h, _, to = label(r)
                if not len(h):
                    continue
                order = np.lexsort((to, h))
                h, to = h[order], to[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (to[1:] != to[:-1])))
                n = np.diff(np.append(new, len(h)))
                h, to = h[new], to[new]
                s = shard(h)
                order = np.argsort(s, kind="stable")
                for at in np.split(order, _starts(s[order])[1:]):
                    yield _rows(["shard", "block", "keys", "labels", "counts"], [pa.int32(), pa.int64(), *[pa.binary()] * 3], [(int(s[at[0]]), r["block"], h[at].tobytes(), to[at].tobytes(), n[at].astype("<i4").tobytes())])

    def differing(part: pa.Table) -> pa.Table:
        """For each block, its cells that hold several components: the largest, the chunks of the cell, the lowest."""
        got = part.to_pylist()
        h, to, n = (np.concatenate([np.frombuffer(r[c], t) for r in got]) for c, t in (("keys", "<u8"), ("labels", "<i8"), ("counts", "<i4")))
        order = np.lexsort((to, h))
        h, to, n = h[order], to[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (to[1:] != to[:-1])))
        h, to, n = h[new], to[new], np.add.reduceat(n, new)
        first = _starts(h)
        length = np.diff(np.append(first, len(h)))
        order = np.lexsort((to, n, h))  # of each cell, the largest comes last
        last = order[first + length - 1]
        many = length > 1
        found = [x[many] for x in (h[first], to[last], -(-np.add.reduceat(n, first) // CHUNK), to[first])]
        out = []
        for r in got:
            at = np.flatnonzero(np.isin(found[0], np.frombuffer(r["keys"], "<u8")))
            out.append([x[at].astype(t).tobytes() for x, t in zip(found, MIXED.values(), strict=True)])
        return pa.table([part["block"], *(pa.array([o[i] for o in out], pa.binary()) for i in range(len(MIXED)))], ["block", *MIXED])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                facts = {c: np.frombuffer(b"".join(m[c] for m in r["mixed"]), t) for c, t in MIXED.items()}
                keys = facts.pop("keys")
                order = np.argsort(keys)
                h, g, to = label(r)
                at = order[np.minimum(np.searchsorted(keys[order], h), len(order) - 1)] if len(order) else np.zeros(len(h), np.int64)
                keep = keys[at] == h if len(order) else np.zeros(len(h), bool)
                at = at[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(g[keep]), pa.array(to[keep]), *(pa.array(x[at]) for x in facts.values())], ["key", "gid", "label", *facts])

    def mixed_cells(labels: DataFrame) -> tuple[DataFrame, int]:
        """The members of cells that hold several components (key, gid, label, largest, chunks, lowest), and how many there are, about."""
        mine = labels.select(F.shiftright("node", 20).alias("block"), F.col("node").bitwiseAND((1 << 20) - 1).cast("int").alias("at"), "label")
        labelled = entries.join(mine.groupBy("block").agg(F.collect_list(F.struct("at", "label")).alias("labels")), "block", "left")
        facts = ", ".join(f"{c} binary" for c in MIXED)
        mixed = labelled.mapInArrow(holdings, "shard int, block long, keys binary, labels binary, counts binary").groupBy("shard").applyInArrow(differing, f"block long, {facts}")
        again = labelled.join(mixed.groupBy("block").agg(F.collect_list(F.struct(*MIXED)).alias("mixed")), "block")
        rest, seen = scratch.observed(again.mapInArrow(members, "key long, gid long, label long, largest long, chunks int, lowest long"), "mixed", most)
        scratch.settled(docs.sparkSession)
        return rest, seen["rows"]

    # 3. each document outside of a cell's largest component with the one nearest to it in parity, of another component:
    # the pieces of a group of near copies come together by a pair for each document, not for each two
    rest, some = mixed_cells(labels)
    for _ in range(ROUNDS):
        if not some:
            break
        new, found = verify(_across(rest, known, percent, nearest=True), True)
        if not found:
            break
        links = links.union(new)
        labels = components(links, most)
        rest, some = mixed_cells(labels)

    # 4. what is left, pair by pair
    if some:
        more, found = verify(_across(rest, known, percent), True)
        if found:
            labels = components(links.union(more), most)

    # all rows again
    names = same.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("low", "high", "n", "least", F.coalesce("label", "rep").alias("label"))
    ids = names.groupBy("label").agg(F.min("least").alias("first"))
    named = names.join(ids, "label").select("low", "high", "n", "first")
    out = rows.join(named, ["low", "high", "n"], "left")
    alone = F.col("first").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | (F.col("first.gid") == F.col("gid"))).alias("first"), "text_md5").coalesce(most)


def dedup(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each component: the one with its smallest doc_id. Rows that share doc_id and text are
    one row."""
    found = scratch.table(join(docs, size, percent), "components")
    md5_of = F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    docs = docs.withColumn("tidemark_md5", md5_of)
    if found.groupBy("doc_id", "text_md5").count().filter("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "tidemark_md5"])
    stays = found.filter("first").select(F.col("doc_id").alias("tidemark_id"), F.col("text_md5").alias("tidemark_text"))
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["tidemark_id"]) & (F.col("tidemark_md5") == F.col("tidemark_text")), "left_semi").drop("tidemark_md5")


def _verified(pairs: DataFrame, known: DataFrame, blocks: DataFrame, n: int, size: int, percent: int, are_near: bool, most: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) that are linked, and how many there are, about: first by sizes and parity bits, unless they ``are_near`` in these,
    then by the sets themselves."""
    t = percent / 100
    one, two = (known.select(F.col("gid").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for r in b.to_pylist():
                p, q = (np.unpackbits(np.frombuffer(r[x], np.uint8)) for x in ("pa", "pb"))
                bits = min(len(p), len(q))
                far = np.count_nonzero(_fold_low(p, bits) != _fold_low(q, bits))
                keep.append(far <= (r["na"] + r["nb"]) * (1 - t) / (1 + t) + 1e-9)
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(k) for i in range(2)], ["a", "b"])

    near = pairs.distinct()
    if not are_near:
        # a document with many partners is a skewed key of these joins, which adaptive execution splits
        near = near.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        near = near.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(close, "a long, b long")
    near = scratch.table(near, "near", most)
    needed = near.select(F.col("a").alias("gid")).union(near.select("b")).distinct()
    asked = needed.select(F.shiftright("gid", 20).alias("block"), F.col("gid").bitwiseAND((1 << 20) - 1).cast("int").alias("at"))
    wanted = B.per_block(asked, blocks.select("block", "ids", "lengths", "data"), n, "asked").filter("asked IS NOT NULL")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, block, (ask,) in B.opened(b):
                if not ask:
                    continue
                at = np.sort(np.array([x["at"] for x in ask]))
                texts = np.concatenate([[0], np.cumsum(block.lengths)])
                part = B.Block(block.ids[at], block.lengths[at], b"".join(block.data[texts[i] : texts[i + 1]] for i in at))
                doc, h = token_sets(part, size)
                ends = np.searchsorted(doc, np.arange(len(at) + 1))
                for lo in range(0, len(at), 256):
                    hi = min(len(at), lo + 256)
                    yield pa.RecordBatch.from_arrays([pa.array(gid(number, at[lo:hi])), pa.array([h[ends[i] : ends[i + 1]].astype("<u8").tobytes() for i in range(lo, hi)], pa.binary())], ["gid", "set"])

    each = scratch.table(wanted.mapInArrow(sets, "gid long, set binary"), "tokens", most)
    full = near.join(each.select(F.col("gid").alias("b"), F.col("set").alias("y")), "b").join(each.select(F.col("gid").alias("a"), F.col("set").alias("x")), "a")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                keep.append(linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(k) for i in range(2)], ["a", "b"])

    spark = pairs.sparkSession
    scratch.settled(spark)
    out, seen = scratch.observed(full.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"), "linked", most)
    scratch.settled(spark)
    return out, seen["rows"]


def _fold_low(bits: np.ndarray, to: int) -> np.ndarray:
    return bits.reshape(-1, to).sum(0, dtype=np.int64) & 1 if len(bits) > to else bits


def _gathered(rest: DataFrame) -> DataFrame:
    """``rest`` with all cells of one lowest component as one (``together``, key: the component): together, key, gid, label,
    largest, chunks. Near copies share most of their cells, so a document, with its parity, is sent once instead of for
    each cell. Documents of one cell still meet. Where this would make more rows than the cells apart, they stay apart."""
    docs = rest.groupBy("lowest", "gid", "label").agg(F.sum("chunks").alias("rows"))
    sizes = docs.groupBy("lowest", "label").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"))
    groups = sizes.groupBy("lowest").agg(F.sum("docs").alias("docs"), F.sum("rows").alias("rows"), F.max(F.struct("docs", "label"))["label"].alias("largest"))
    chunks = F.ceil(F.col("docs") / CHUNK).cast("int")
    groups = groups.filter(F.col("docs") * chunks <= F.col("rows")).select("lowest", "largest", chunks.alias("chunks"))
    one = docs.select("lowest", "gid", "label").join(groups, "lowest").select(F.lit(True).alias("together"), F.col("lowest").alias("key"), "gid", "label", "largest", "chunks")
    return one.union(rest.join(groups, "lowest", "left_anti").select(F.lit(False), "key", "gid", "label", "largest", "chunks"))


def _across(rest: DataFrame, known: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Pairs of documents in one cell but different components that may be linked. A cell's documents (those of some
    cells, see :func:`_gathered`) stand in chunks (``base``); all but those of its largest component also visit every chunk
    (``probe``), chunk by chunk, and so meet each other and that component once, CHUNK by CHUNK of them in a group. Pairs
    are formed and dropped inside a task; only those near in parity leave it, or with ``nearest`` of each probe only the
    nearest."""
    t = percent / 100
    rows = _gathered(rest).join(known, "gid")
    own = F.pmod(F.xxhash64("gid"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)

    def visits(base: bool) -> Column:
        return F.transform(every, lambda c: F.struct((own if base else c).alias("chunk"), (c if base else own).alias("other"), F.lit(not base).alias("probe")))

    # both sides from one pass: a union would plan and run all below it twice
    at = F.explode(F.when(F.col("label") != F.col("largest"), F.concat(visits(True), visits(False))).otherwise(visits(True)))
    dealt = rows.select("together", "key", "gid", "label", "n", "parity", at.alias("at")).select("together", "key", "at.chunk", "at.other", "gid", "label", "n", "parity", "at.probe")

    def meet(part: pa.Table) -> pa.Table:
        got = part.select(["gid", "label", "n", "parity", "probe"]).to_pylist()
        sides = [[r for r in got if r["probe"] is p] for p in (True, False)]
        out: list[tuple[int, int]] = []
        if all(sides):
            (gx, lx, nx, bx), (gy, ly, ny, by) = ([np.array([r[c] for r in s]) for c in ("gid", "label", "n")] + [np.array([8 * len(r["parity"]) for r in s])] for s in sides)
            for mine in np.unique(bx):  # sketches of one size at once, those of other sizes folded to the smaller
                some = np.flatnonzero(bx == mine)
                far = np.zeros((len(some), len(gy)), np.int64)
                for theirs in np.unique(by):
                    at, bits = np.flatnonzero(by == theirs), int(min(mine, theirs))
                    x, y = (np.stack([np.packbits(_fold_low(np.unpackbits(np.frombuffer(s[i]["parity"], np.uint8)), bits).astype(np.uint8)).view("<u8") for i in which.tolist()]) for s, which in zip(sides, (some, at), strict=True))
                    for k in range(len(some)):
                        far[k, at] = np.bitwise_count(x[k] ^ y).sum(1)
                for i, d in zip(some.tolist(), far, strict=True):
                    ok = (lx[i] != ly) & (d <= (nx[i] + ny) * (1 - t) / (1 + t) + 1e-9) & (100 * np.minimum(nx[i], ny) >= percent * np.maximum(nx[i], ny))
                    found = gy[ok] if not nearest or not ok.any() else gy[[np.flatnonzero(ok)[d[ok].argmin()]]]
                    out += [(min(int(gx[i]), g), max(int(gx[i]), g)) for g in found.tolist()]
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return dealt.groupBy("together", "key", "chunk", "other").applyInArrow(meet, "a long, b long")
