"""Toxicity by the nearest labelled examples.

Texts become TF-IDF vectors over words: every word of the labelled examples is a term, its document frequency is counted
over all documents, and its weight is (1 + log count) * idf * relevance. Relevance is 1 for most words; one that
labelled documents show to be more frequent in toxic texts counts the root of its G2 statistic instead, if that is
more, so that neighbours are alike in what makes texts toxic before they are alike in topic. No limit decides which
words count, so few labels work like many.

The labelled examples stand in a block-max inverted index: examples in blocks, and for each term and block its largest
weight. The most frequent terms, which are in most blocks, stand apart in a matrix, and give exact parts of all cosines
for a batch of texts at once. A search bounds every block by its best such part and the sum of its weights for the other
terms, opens blocks from the best bound down, and stops when no block can hold a nearer example than the k-th found: exact
cosine. Votes are weighted by cosine (and by how many labelled
documents an example stands for); held to the leave-one-out outcomes of the examples themselves, they become calibrated
scores. The neighbours are returned as evidence.

Examples are a bounded sample: ``per_class`` of each label or so, by a hash of doc_id. Everything else covers all
documents, whole.

Cases: null and empty texts, and texts without a word of any example, get the rate of such texts among the examples;
without labels all scores are 0; conflicting labels of one doc_id both count; examples of one text and label are one,
under their smallest doc_id; repeated rows each get their row; an empty table gives no rows; a null doc_id is not held
out; ties between neighbours go to the smaller doc_id; very long texts are read whole; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, tokens, varbyte, words

#: Labelled examples of each class, about; neighbours that vote; examples in a block of the index; terms in the matrix.
PER_CLASS, NEIGHBOURS, BLOCK, COMMON = 2_500, 15, 64, 256
#: Terms whose document frequencies one task adds up; texts whose result a task remembers.
SHARD, MEMO = 1 << 15, 4_096
U = np.uint64
#: ASCII signs other than letters and digits part words, as white space does.
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[i for i in range(128) if not chr(i).isalnum()]] = 32
_SIGNS = re.compile("[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u2000-\u206f\u3000-\u303f]+")


def hashed(texts: list[str | None]) -> words.Words:
    """The words of some texts, in lower case: 64-bit hashes."""
    raw = [(t.lower() if t.isascii() else _SIGNS.sub(" ", t.lower())).encode() for t in (t or "" for t in texts)]
    data = _KEEP[np.frombuffer(b"".join(raw), np.uint8)]
    return words.split(data.tobytes(), np.array([len(t) for t in raw], np.int64))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, first[1] .. and so on."""
    total = np.cumsum(n)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - total + n, n)


class Terms:
    """The words of the examples."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms  # ascending hashes
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[terms >> U(42)] = True

    def counts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text: its terms, ascending, and how often it has each."""
        w = hashed(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        keep = np.flatnonzero(self.maybe[w.hash >> U(42)])
        h, doc = w.hash[keep], doc[keep]
        at = np.searchsorted(self.terms, h)
        known = self.terms[np.minimum(at, len(self.terms) - 1)] == h if len(self.terms) else np.zeros(len(h), bool)
        both = np.sort(doc[known] * len(self.terms) + at[known])
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        n = np.diff(np.append(new, len(both)))
        edges = np.searchsorted(both[new], np.arange(len(texts) + 1) * max(1, len(self.terms)))
        t = both[new] % max(1, len(self.terms))
        return [(t[lo:hi], n[lo:hi]) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def unit(weight: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TF-IDF vector of a text, of length 1."""
    w = (1 + np.log(counts)) * weight[terms]
    return terms, w / math.sqrt(float((w**2).sum())) if len(terms) else w


class Index:
    """Block-max inverted index of unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, terms: int, common: int = COMMON):
        # alike examples share blocks: order by heaviest term
        heavy = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in vectors], np.int64)
        self.order = np.lexsort((ids, heavy))
        self.ids = ids[self.order]
        self.blocks = -(-len(ids) // BLOCK)
        doc = np.repeat(np.arange(len(ids)), [len(vectors[j][0]) for j in self.order]) if len(ids) else np.zeros(0, np.int64)
        term, weight = (np.concatenate([vectors[j][i] for j in self.order] or [np.zeros(0)]) for i in (0, 1))
        term = term.astype(np.int64)
        # the matrix: a column for each of the most frequent terms
        often = np.bincount(term, minlength=terms)
        self.column = np.full(terms, -1, np.int32)
        top = np.argsort(-often, kind="stable")[:common]
        self.column[top] = np.arange(len(top))
        self.matrix = np.zeros((len(ids), len(top)))
        at = self.column[term]
        self.matrix[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
        doc, term, weight = doc[at < 0], term[at < 0], weight[at < 0]
        by = np.lexsort((doc, term))
        self.doc, self.weight = doc[by].astype(np.int32), weight[by]
        # an entry for each other term and block: its postings, and their peak
        pair = term[by] * max(1, self.blocks) + doc[by] // BLOCK
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        self.first = np.append(new, len(pair)).astype(np.int32)
        self.block = (pair[new] % max(1, self.blocks)).astype(np.int32)
        self.peak = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.of = np.searchsorted(pair[new] // max(1, self.blocks), np.arange(terms + 1)).astype(np.int32)

    def parts(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each text and example, what the common terms add to their cosine."""
        rows = np.zeros((len(vectors), self.matrix.shape[1]))
        for row, (terms, w) in zip(rows, vectors, strict=True):
            at = self.column[terms]
            row[at[at >= 0]] = w[at >= 0]
        return rows @ self.matrix.T

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int, but: int | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (in the order given) and cosines of the k nearest examples with a cosine above 0; ``part``: the text's
        row of :meth:`parts`."""
        place, cosine, least, at, some = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 16
        if not self.blocks:
            return place, cosine
        part = self.parts([vector])[0] if part is None else part
        rare = self.column[vector[0]] < 0
        terms, w = vector[0][rare], vector[1][rare]
        n = self.of[terms + 1] - self.of[terms]
        entry, weight = _ranges(self.of[terms], n), np.repeat(w, n)
        block = self.block[entry]
        bound = np.bincount(block, self.peak[entry] * weight, self.blocks) + np.maximum.reduceat(part, np.arange(0, len(part), BLOCK))
        todo = np.argsort(-bound, kind="stable")
        while at < self.blocks and bound[todo[at]] > 0 and bound[todo[at]] >= least - 1e-9:
            opened = np.zeros(self.blocks, bool)
            opened[todo[at : at + some]] = True
            opened &= bound >= least - 1e-9
            at, some = at + some, 2 * some
            pick = np.flatnonzero(opened[block])
            m = self.first[entry[pick] + 1] - self.first[entry[pick]]
            post = _ranges(self.first[entry[pick]], m)
            score = part + np.bincount(self.doc[post], self.weight[post] * np.repeat(weight[pick], m), len(part))
            new = np.flatnonzero((score > max(0.0, least - 1e-9)) & np.repeat(opened, BLOCK)[: len(part)])
            if but is not None:
                new = new[self.order[new] != but]
            place, cosine = np.concatenate([place, new]), np.concatenate([cosine, score[new]])
            best = np.lexsort((self.ids[place], -cosine.round(12)))[:k]
            place, cosine = place[best], cosine[best]
            least = float(cosine[-1]) if len(cosine) == k else 0.0
        return self.order[place], cosine


class Model:
    """Everything a task needs: bounded by PER_CLASS examples and their words."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, examples: list[tuple[int, int, float, np.ndarray, np.ndarray]]):
        self.terms, self.weight = Terms(terms), weight
        full = [e for e in examples if len(e[3])]
        self.ids = np.array([e[0] for e in full], np.int64)
        self.label = np.array([e[1] for e in full], float)
        self.stands = np.array([e[2] for e in full], float)
        self.index = Index([unit(weight, e[3], e[4]) for e in full], self.ids, len(terms))
        every = sum(e[2] for e in examples)
        self.rate = sum(e[1] * e[2] for e in examples) / every if every else 0.0
        without = [e for e in examples if not len(e[3])]
        self.none = (sum(e[1] * e[2] for e in without) + 0.5 * self.rate) / (sum(e[2] for e in without) + 0.5)

    def votes(self, bags: list[tuple[np.ndarray, np.ndarray]], but: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text: the share of label 1 among the nearest, weighted by cosine (-1 if there are none), and their places
        and cosines."""
        vectors = [unit(self.weight, t, n) for t, n in bags]
        out = []
        for k, (vector, part) in enumerate(zip(vectors, self.index.parts(vectors), strict=True)):
            place, cosine = self.index.nearest(vector, NEIGHBOURS, but[k] if but else None, part)
            w = cosine * self.stands[place]
            out.append((float((w * self.label[place]).sum() / w.sum()) if len(place) else -1.0, place, cosine))
        return out

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        """Outcomes of the examples, each against all others (``votes``), by tenths of the vote; smoothed towards the
        vote and made to rise with it."""
        at = np.clip((votes * 10).astype(int), 0, 9)
        ok = votes >= 0
        n = np.bincount(at[ok], self.stands[ok], 10)
        y = np.bincount(at[ok], (self.stands * self.label)[ok], 10)
        return np.maximum.accumulate((y + 2 * (np.arange(10) + 0.5) / 10) / (n + 2))


class Learned:
    """A broadcast :class:`Model` and its calibration."""

    def __init__(self, shared, bins: np.ndarray):
        self.shared, self.bins = shared, bins


class Scores:
    """What a task computes, once for texts that are alike."""

    def __init__(self, model: Model, bins: np.ndarray):
        self.model, self.bins = model, bins
        self.memo: dict[bytes, tuple[float, list[int], list[float]]] = {}

    def of(self, texts: list[str | None]) -> list[tuple[float, list[int], list[float]]]:
        """Score, neighbours and their cosines of each text."""
        bags = self.model.terms.counts(texts)
        keys = [blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest() for t, n in bags]
        if len(self.memo) > MEMO:
            self.memo.clear()
        todo = {k: i for i, k in enumerate(keys) if k not in self.memo}
        for k, (vote, place, cosine) in zip(todo, self.model.votes([bags[i] for i in todo.values()]), strict=True):
            p = self.model.none if vote < 0 else float(np.interp(vote, (np.arange(10) + 0.5) / 10, self.bins))
            self.memo[k] = (min(1.0, max(0.0, p)), self.model.ids[place].tolist(), cosine.tolist())
        return [self.memo[k] for k in keys]


def relevance(a0: np.ndarray, a1: np.ndarray, d0: int, d1: int) -> np.ndarray:
    """Of terms that ``a0`` of ``d0`` examples labelled 0 and ``a1`` of ``d1`` labelled 1 have."""
    total = d0 + d1

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300))

    g2 = 2 * (part(a1, (a0 + a1) * d1 / total) + part(a0, (a0 + a1) * d0 / total) + part(d1 - a1, (total - a0 - a1) * d1 / total) + part(d0 - a0, (total - a0 - a1) * d0 / total))
    return np.where(a1 * d0 > a0 * d1, np.sqrt(np.maximum(1, g2)), 1.0)


def frequencies(corpus: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many texts of ``corpus`` each term occurs, and how many texts there are. Tasks send their counts in shards
    of terms, as bytes of variable length."""
    size = len(terms.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for b in tokens.slices(batches):
            found = terms.counts(b.column(0).to_pylist())
            df += np.bincount(np.concatenate([t for t, _ in found]), minlength=size)
            n += len(found)
        if n:
            parts = [varbyte.pack(df[lo : lo + SHARD]) for lo in range(0, size, SHARD)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(parts))], pa.int32()), pa.array([n, *[0] * len(parts)], pa.int64()), pa.array([b"", *(zlib.compress(c, 1) for c, _ in parts)], pa.binary()), pa.array([b"", *(zlib.compress(d, 1) for _, d in parts)], pa.binary())], ["shard", "n", "control", "data"])

    def add(part: pa.Table) -> pa.Table:
        shard = part["shard"][0].as_py()
        total = np.zeros(0 if shard < 0 else min(SHARD, size - shard * SHARD), np.int64)
        for control, data in zip(part["control"], part["data"], strict=True) if shard >= 0 else ():
            total += varbyte.unpack(zlib.decompress(control.as_buffer()), zlib.decompress(data.as_buffer()), len(total))
        return pa.table([pa.array([shard], pa.int32()), pa.array([sum(part["n"].to_pylist())], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["shard", "n", "df"])

    df, n = np.zeros(size, np.int64), 0
    sent = corpus.select(corpus["text"].cast("string").alias("text")).mapInArrow(count, "shard int, n long, control binary, data binary")
    for r in sent.groupBy("shard").applyInArrow(add, "shard int, n long, df binary").toLocalIterator():
        if r["shard"] < 0:
            n = r["n"]
        else:
            df[r["shard"] * SHARD : (r["shard"] + 1) * SHARD] = np.frombuffer(r["df"], "<i8")
    return df, n


def learn(docs: DataFrame, labels: DataFrame, corpus: DataFrame, per_class: int = PER_CLASS) -> Learned:
    """A model from ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); document frequencies from ``corpus``."""
    spark = docs.sparkSession
    scratch.importable(spark)
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    totals = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(F.lit(v) for y, n in (totals or {0: 1}).items() for v in (y, min(1.0, per_class / n))))
    picked = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share[F.col("y")] * (1 << 20))
    # per_class bounds what is picked: it is sent to the texts, which are not shuffled for it
    rows = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = scratch.table(rows.groupBy("text", "y").agg(F.min("doc_id").alias("doc_id")), "examples")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, 64):
            w = hashed(b.column(2).to_pylist())
            found = [np.unique(w.hash[lo:hi], return_counts=True) for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h.astype("<u8").tobytes() for h, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary())], ["doc_id", "y", "h", "n"])

    each = scratch.table(rows.select("doc_id", "y", "text").mapInArrow(bags, "doc_id long, y int, h binary, n binary"), "bags")
    found = [(r["doc_id"], r["y"], np.frombuffer(r["h"], "<u8"), np.frombuffer(r["n"], "<i4")) for r in each.toLocalIterator()]  # per_class bounds them
    found.sort(key=lambda e: e[:2])
    terms, at = words.distinct(np.concatenate([e[2] for e in found] or [np.zeros(0, U)]))
    ends = np.cumsum([0, *(len(e[2]) for e in found)]).tolist()
    places = [at[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    seen = [np.bincount(np.concatenate([p for p, e in zip(places, found, strict=True) if e[1] == y] or [np.zeros(0, np.int64)]), minlength=len(terms)).astype(float) for y in (0, 1)]
    df, n = frequencies(corpus, Terms(terms))
    weight = (np.log((1 + n) / (1 + df)) + 1) * relevance(seen[0], seen[1], max(1, sizes.get(0, 0)), max(1, sizes.get(1, 0)))
    stands = {y: totals.get(y, 0) / k for y, k in sizes.items()}
    model = Model(terms, weight, [(i, y, stands[y], p, k) for p, (i, y, _, k) in zip(places, found, strict=True)])
    number = {e[:2]: k for k, e in enumerate(e for e in found if len(e[2]))}
    size = len(number)
    del found, places, at
    shared = spark.sparkContext.broadcast(model)  # PER_CLASS bounds it

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in tokens.slices(batches, 128):
            ids, labels_of, h, n = (b.column(i).to_pylist() for i in range(4))
            keep = [i for i, x in enumerate(h) if x]
            bags_of = [(np.searchsorted(known.terms.terms, np.frombuffer(h[i], "<u8")), np.frombuffer(n[i], "<i4")) for i in keep]
            at = [number[ids[i], labels_of[i]] for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([v for v, _, _ in known.votes(bags_of, at)], pa.float64())], ["id", "vote"])

    votes = np.zeros(size)
    for r in each.mapInArrow(vote, "id long, vote double").collect():  # bounded by per_class
        votes[r["id"]] = r["vote"]
    return Learned(shared, model.calibrated(votes))


def score(docs: DataFrame, learned: Learned, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` with score, predicted (1 if score >= 0.5), neighbours (doc_ids) and cosines; their names
    start with ``prefix``, so that none clashes with a kept column."""
    rows = docs.select(*keep, docs["text"].cast("string").alias(f"{prefix}_t"))
    schema = rows.select(*keep).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType()).add("neighbours", T.ArrayType(T.LongType())).add("cosines", T.ArrayType(T.DoubleType()))
    for field in schema.fields[len(keep) :]:
        field.name = prefix + field.name
    schema = T.StructType(schema.fields)
    shared, bins = learned.shared, learned.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value, bins)
        for b in tokens.slices(batches):
            found = scores.of(b.column(b.num_columns - 1).to_pylist())
            p = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))], schema.names)

    return rows.mapInArrow(run, schema)
