"""Ranked lexical search: integer BM25 scores by Block-Max WAND over a sharded, compressed index.

Documents are dealt to shards where they are read, so no text is shuffled. A shard's posting lists are cut into blocks of
:data:`POSTINGS` documents: the distance of each document to the block's first and how often it holds the term, in as
few whole bytes as the block needs, with the largest impact any of its postings has. An item is a bag of weighted terms.
In a shard, the ends of its terms' blocks cut the documents into intervals inside of which no list moves to another block.
Shallow moves find the block of every list in every interval from the block table alone; the sum of their largest impacts
bounds every document of the interval. Intervals are opened from the highest bound down; the rest is skipped once the
bound is below the k-th score found so far, which goes on from shard to shard of a task. Inside of opened intervals the
pivot rule of WAND decides what is decompressed: lists whose bounds together stay below that score bring no candidates,
so their blocks (those of frequent terms, the longest) are read only around documents that the other lists leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, words

#: Bytes of text of a shard, about, and its documents at most.
SHARD, DOCUMENTS = 4 << 20, 1 << 16
#: Postings of a block.
POSTINGS = 64
#: Bytes of text of items that are searched at once; more go in several passes.
ITEMS = 32 << 20
#: Parts in which the rows of an item meet before they meet in one.
PARTS = 64
#: Intervals opened first; each next step opens four times as many.
OPENED = 16
U = np.uint64
NONE = np.iinfo(np.int64).max
#: Fixed by the definition of a term: ASCII letters and digits, and all bytes of other characters.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_SHARDS = "shard long, ids binary, lengths binary, terms array<long>, df array<int>, docs binary, often binary"
_INDEX = "shard long, ids binary, norms binary, terms binary, first binary, last binary, most binary, base binary, size binary, wide binary, start binary, data binary"


def _shards(docs: DataFrame) -> DataFrame:
    """Postings of the documents, shard by shard, in the order of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 24, [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            w = words.split(b"".join(texts), lengths, lower=True, apart=APART)
            n = np.diff(w.first)
            terms, place = words.distinct(w.hash)
            code, often = np.unique(place * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
            term, doc = np.divmod(code, len(ids))
            df = np.bincount(term, minlength=len(terms)).astype(np.int32)
            lists = [pa.array([x], pa.list_(kind)) for x, kind in ((terms.view(np.int64), pa.int64()), (df, pa.int32()))]
            of = lambda x: pa.array([x.tobytes()], pa.binary())
            cols = [pa.array([number], pa.int64()), of(np.array([NONE if i is None else i for i in ids], "<i8")), of(n.astype("<i8")), *lists, of(doc.astype("<u2")), of(often.astype("<u4"))]
            return pa.RecordBatch.from_arrays(cols, ["shard", "ids", "lengths", "terms", "df", "docs", "often"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append((t.as_py() or "").encode())
                held += len(texts[-1])
                if held >= SHARD or len(ids) >= DOCUMENTS:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, _SHARDS)


def norms(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """m of documents with n terms, of ``count`` documents that hold ``total`` terms."""
    return 75 + (25 * n * count) // max(1, total)


def impacts(often: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * often) // (1000 * often + 12 * m)


def pack(doc: np.ndarray, often: np.ndarray, impact: np.ndarray, df: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of the posting lists that follow each other in ``doc``, ``df`` postings each: a table of blocks, and data."""
    begin = np.cumsum(df) - df
    inner = np.arange(len(doc)) - np.repeat(begin, df)
    start = np.flatnonzero(inner % POSTINGS == 0)
    size = np.diff(np.append(start, len(doc)))
    block = np.repeat(np.arange(len(start)), size)
    gap, inner = doc - doc[start][block], inner % POSTINGS
    wide_gap, wide_often = np.maximum.reduceat(gap, start) > 255, np.maximum.reduceat(often, start) > 255
    a, b = 1 + wide_gap, 1 + 3 * wide_often
    at = np.cumsum(size * (a + b)) - size * (a + b)
    data = np.zeros(int((size * (a + b)).sum()), np.uint8)
    for values, width, place in ((gap, a[block], at[block] + inner * a[block]), (often, b[block], (at + size * a)[block] + inner * b[block])):
        for k in range(int(width.max())):
            on = width > k
            data[place[on] + k] = (values[on] >> (8 * k)) & 255
    blocks = -(-df // POSTINGS)
    return {"first": np.append(0, np.cumsum(blocks)).astype("<u4"), "last": doc[start + size - 1].astype("<u2"), "most": np.maximum.reduceat(impact, start).astype("<u4"), "base": doc[start].astype("<u2"), "size": size.astype("<u1"), "wide": (wide_gap + 2 * wide_often).astype("<u1"), "start": at.astype("<u8"), "data": data}


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The index of ``docs`` (doc_id, text), written: a row for each shard; (term, df) rows, one for each shard that holds
    the term; and the counts N and L of documents with terms and of their terms. A null text has no terms."""
    raw = scratch.table(_shards(docs), "postings")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.frombuffer(x.as_py(), "<i8") for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in n], pa.int64()), pa.array([int(x.sum()) for x in n], pa.int64())], ["n", "total"])

    count, total = (x or 0 for x in raw.select("lengths").mapInArrow(sums, "n long, total long").agg(F.sum("n"), F.sum("total")).first())

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1)
                n, doc, often = (np.frombuffer(r.column(c)[0].as_py(), kind).astype(np.int64) for c, kind in (("lengths", "<i8"), ("docs", "<u2"), ("often", "<u4")))
                if not len(doc):
                    continue
                m = norms(n, count, total)
                packed = pack(doc, often, impacts(often, m[doc]), r.column("df")[0].values.to_numpy().astype(np.int64))
                terms = r.column("terms")[0].values.to_numpy()
                cols = [r.column("shard"), r.column("ids"), *(pa.array([x.tobytes()], pa.binary()) for x in (m.astype("<i8"), terms, *packed.values()))]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "ids", "norms", "terms", *packed])

    return scratch.table(raw.mapInArrow(seal, _INDEX), "index"), raw.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df")), count, total


class Shard:
    """An opened row of the index; blocks are decompressed when asked for, once."""

    def __init__(self, r: pa.RecordBatch):
        of = lambda c, kind: np.frombuffer(r.column(c)[0].as_py(), kind)
        self.ids, self.norms, self.terms = of("ids", "<i8"), of("norms", "<i8"), of("terms", "<u8")
        self.first, self.last, self.base = (of(c, k).astype(np.int64) for c, k in (("first", "<u4"), ("last", "<u2"), ("base", "<u2")))
        self.most, self.size, self.wide, self.start = of("most", "<u4").astype(np.int64), of("size", "<u1"), of("wide", "<u1"), of("start", "<u8")
        self.data = r.column("data")[0].as_py()
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if k not in self.open:
            n, wide, at = int(self.size[k]), int(self.wide[k]), int(self.start[k])
            doc = np.frombuffer(self.data, "<u2" if wide & 1 else "<u1", n, at).astype(np.int64) + self.base[k]
            often = np.frombuffer(self.data, "<u4" if wide & 2 else "<u1", n, at + n * (1 + (wide & 1))).astype(np.int64)
            self.open[k] = doc, impacts(often, self.norms[doc])
        return self.open[k]

    def scores(self, blocks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents and impacts of the blocks of one list; ``blocks`` ascend, -1 stands for none."""
        blocks = blocks[blocks >= 0]
        for k in blocks[np.append(True, blocks[1:] != blocks[:-1])].tolist() if len(blocks) else ():
            yield self.block(k)

    def search(self, found: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offer to ``best`` what documents of this shard score for the terms at ``found`` of its dictionary."""
        low, high = self.first[found], self.first[found + 1]
        lists = [(a, self.last[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        ends = np.unique(np.concatenate([x for _, x in lists]))
        where = np.empty((len(lists), len(ends)), np.int64)
        for t, (a, last) in enumerate(lists):
            k = a + np.searchsorted(last, ends)  # shallow: only the table of blocks is read
            over = k >= a + len(last)
            k[over] = a
            k[over | (self.base[k] > ends)] = -1  # the list has ended, or has no document up to here
            where[t] = k
        value = np.where(where >= 0, weight[:, None] * self.most[where], 0)
        bound = value.sum(0)
        of = np.searchsorted(ends, np.arange(len(self.ids)))  # the interval of each document
        order, at, step = np.argsort(-bound, kind="stable"), 0, OPENED
        while at < len(order) and bound[order[at]] >= best.least():
            now = order[at : at + step]
            at, step = at + step, step * 4
            self._open(np.sort(now[bound[now] >= best.least()]), of, where, value, weight, best)

    def _open(self, now: np.ndarray, of: np.ndarray, where: np.ndarray, value: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Score the documents of the intervals ``now``. Lists whose bounds together stay below the k-th score make no
        candidates: their blocks are decompressed only where the other lists have left a document that may pass it."""
        least = best.least()
        peak = value[:, now].max(1)
        by = np.argsort(peak, kind="stable")
        few = int(np.searchsorted(np.cumsum(peak[by]), least))
        total = np.zeros(len(self.ids), np.int64)
        for t in by[few:].tolist():
            for doc, score in self.scores(where[t, now]):
                total[doc] += score * weight[t]
        opened = np.zeros(value.shape[1] + 1, bool)
        opened[now] = True
        room = np.append(value[by[:few]].sum(0), 0)
        hit = np.flatnonzero(opened[of] & (total + room[of] >= least))
        for t in by[:few][::-1].tolist():
            if not len(hit):
                return
            place = of[hit]
            room[:-1] -= value[t]
            for doc, score in self.scores(where[t, np.unique(place)]):
                total[doc] += score * weight[t]
            hit = hit[total[hit] + room[place] >= least]
        best.add(total[hit], self.ids[hit])


class Best:
    """The k best of an item so far: highest scores, then smallest ids, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """The lowest score that can still be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score):
            score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
            keep = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[keep], ids[keep]


def _items(items: DataFrame) -> DataFrame:
    """item_id, item (tells rows apart), bytes, term, often."""
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).filter("text IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column("text")[k].as_py().encode()
                terms, place = words.distinct(words.split(text, np.array([len(text)]), lower=True, apart=APART).hash)
                one = lambda x, kind, n=len(terms): pa.array([x] * n, kind)
                yield pa.RecordBatch.from_arrays([one(b.column("item_id")[k].as_py(), pa.int64()), one(b.column("item")[k].as_py(), pa.string()), one(len(text), pa.int64()), pa.array(terms.view(np.int64)), pa.array(np.bincount(place, minlength=len(terms)).astype(np.int64))], ["item_id", "item", "bytes", "term", "often"])

    return rows.withColumn("item", F.md5(F.concat_ws("\n", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text"))).mapInArrow(run, "item_id long, item string, bytes long, term long, often long")


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each row of ``items`` (item_id, text): item_id, rank (from
    1), doc_id, score; equal scores by ascending doc_id.

    Every document is indexed, every item ranked against all. Terms are runs of ASCII letters and digits and of other
    characters than ASCII; A-Z count as a-z. Null and empty texts have no terms: such documents are never found and not
    counted, such items give no row. Rows that repeat an item's id and text count once; rows of one item_id with other
    texts are ranked apart. Repeated documents are ranked each; a null doc_id comes after all others of its score. Only
    the columns named are read. Terms are told apart by 64-bit hashes. The weights of an item's terms are held by tasks,
    some :data:`ITEMS` bytes of item texts at once; more items take more passes over the index.
    """
    spark = docs.sparkSession
    scratch.importable(spark)
    shards, held, count, total = index(docs)
    asked = scratch.table(_items(items), "items")
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * count + 2) / (2.0 * F.col("df") + 1))).cast("long")
    bags = asked.join(df, "term").select("item_id", "item", "bytes", "term", (F.col("often") * weight).alias("weight")).groupBy("item_id", "item").agg(F.first("bytes").alias("bytes"), F.collect_list(F.struct("term", "weight")).alias("bag"))
    bags = scratch.table(bags, "bags")
    passes = max(1, -(-(bags.agg(F.sum("bytes")).first()[0] or 0) // ITEMS))
    out = None
    for p in range(passes):
        rows = bags.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).collect()  # some ITEMS bytes of items
        part = _search(shards, [(r.item_id, r.item, sorted((t & (2**64 - 1), w) for t, w in r.bag)) for r in rows], k)
        out = part if out is None else out.union(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item", "part"], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def _search(shards: DataFrame, items: list[tuple[int | None, str, list[tuple[int, int]]]], k: int) -> DataFrame:
    """The k best of the shards of each task, for each of the items."""
    sent = shards.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        asked = np.unique(np.array([t for _, _, bag in items for t, _ in bag], U))
        bags = [(np.searchsorted(asked, np.array([t for t, _ in bag], U)), np.array([w for _, w in bag], np.int64)) for _, _, bag in items]
        best = [Best(k) for _ in items]
        for b in batches:
            for at in range(b.num_rows):
                shard = Shard(b.slice(at, 1))
                place = np.searchsorted(shard.terms, asked)
                there = place < len(shard.terms)
                there[there] = shard.terms[place[there]] == asked[there]
                for (terms, weight), found in zip(bags, best, strict=True):
                    on = there[terms] & (weight > 0)
                    if on.any():
                        shard.search(place[terms[on]], weight[on], found)
        part = TaskContext.get().partitionId() % PARTS
        for (item_id, item, _), found in zip(items, best, strict=True):
            n = len(found.score)
            if n:
                ids = pa.array(found.id, mask=found.id == NONE)
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * n, pa.int64()), pa.array([item] * n), pa.array([part] * n, pa.int32()), ids, pa.array(found.score)], ["item_id", "item", "part", "doc_id", "score"])

    return shards.mapInArrow(run, "item_id long, item string, part int, doc_id long, score long")
