"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are words: ASCII letters in lower case, other ASCII characters than letters and digits part words. A document
leaks an item if some part of it is within ``rate`` of the item's words by edit distance (insert, delete, replace a
word). Every window of the document as long as an item is a candidate, and so is a shorter one that the end of the
document cuts, down to n - d words; if enough of its words are words of items of that length, and some run of words is
intact: d edits leave at least n - d of n words, in d + 1 runs at most, so this step drops no leak. The CGK embedding walks
along a window and, at each of 3 n steps, writes the word it stands on and moves on or stays, as a hash of step and
word says; near windows write mostly the same words at the same steps, so edit distance becomes Hamming distance.
Samples of steps make LSH keys; walks and samples are repeated until windows at the limit meet their item with
probability ``recall`` (measured on the items themselves, randomly edited and only shortened, in a text and at its end;
the worst counts). Where ``REPEATS`` repetitions do not reach that, every candidate counts as met. Windows that meet are
verified by exact edit distance. So a leak at the limit itself is found with probability ``recall``, nearer ones with
more, and what is reported is exact.

Items are taken in groups of bounded size; documents pass once for each group. Cases: null and empty documents and
items leak nothing; items under ``least`` words must be met without an edit; repeated items and documents give a row
each; very long documents are read whole; an empty benchmark or table gives no leaks; all columns of documents are
kept as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch, words

RATE, RECALL, LEAST = 0.2, 0.99, 8
#: Words of an intact run that is looked for first, at most; steps of a sample, repetitions at most, bytes of items in a group.
GRAM, SAMPLE, REPEATS, GROUP = 3, 2, 64, 4 << 20
U = np.uint64
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[i for i in range(128) if not chr(i).isalnum()]] = 32
_KEEP[65:91] += 32
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("distance", T.IntegerType())]))


def split(texts: list[bytes]) -> words.Words:
    data = _KEEP[np.frombuffer(b"".join(texts), np.uint8)]
    return words.split(data.tobytes(), np.array([len(t) for t in texts], np.int64))


def allowed(n: int, rate: float = RATE) -> int:
    """Edits that an item of ``n`` words may be away."""
    return int(n * rate) if n >= LEAST else 0


def embed(windows: np.ndarray, n: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """LSH keys (window, repetition): CGK walks along each row's first ``n`` word hashes, sampled where ``sampled``
    (window, repetition, step) says. Walks differ by repetition only."""
    rows, repeats, steps = sampled.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), U)], axis=1)
    place = np.zeros((rows, repeats), np.int64)
    row, last = np.arange(rows)[:, None], n[:, None]
    walk = U(1 << 20) * np.arange(repeats, dtype=U)
    key = np.zeros((rows, repeats), U)
    for step in range(steps):
        word = padded[row, place]
        if (now := sampled[:, :, step]).any():
            key = np.where(now, words.mix(key + word), key)
        move = words.mix(word + walk + U(step + 1)) & U(1)
        place = np.minimum(place + move.astype(np.int64), last)
    return key


def distance(item: np.ndarray, part: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a stretch of ``part``, and that stretch; ``most`` + 1 if it is further."""
    free = np.arange(len(part) + 1)
    cost = np.zeros(len(part) + 1, np.int64)
    begin = free.copy()
    for i, word in enumerate(item):
        swap = cost[:-1] + (part != word)
        drop = cost[1:] + 1
        best = np.minimum(swap, drop)
        start = np.where(swap <= drop, begin[:-1], begin[1:])
        best, start = np.append(i + 1, best), np.append(0, start)
        # insertions run along the row: least of best[k] + (j - k)
        run = np.minimum.accumulate(best - free)
        where = np.maximum.accumulate(np.where(best - free == run, free, 0))
        cost, begin = run + free, start[where]
    end = int(np.argmin(cost))
    return (int(cost[end]), int(begin[end]), end) if cost[end] <= most else (most + 1, 0, 0)


class Items:
    """The LSH index of a group of items."""

    def __init__(self, ids: list[int], texts: list[bytes], rate: float = RATE, recall: float = RECALL):
        w = split(texts)
        self.rate = rate
        self.items = [(i, w.hash[a:b]) for i, a, b in zip(ids, w.first[:-1], w.first[1:], strict=True) if b > a]
        self.lengths = sorted({len(h) for _, h in self.items})
        of = defaultdict(list)
        for k, (_, h) in enumerate(self.items):
            of[len(h)].append(k)
        self.words = np.unique(np.concatenate([h for _, h in self.items] or [np.zeros(0, U)]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.words >> U(44)] = True
        # which lengths have items with a word: bits, 64 lengths to an array
        self.masks = [np.zeros(len(self.words), U) for _ in range(-(-len(self.lengths) // 64))]
        for c, n in enumerate(self.lengths):
            for k in of[n]:
                self.masks[c // 64][np.searchsorted(self.words, self.items[k][1])] |= U(1 << (c % 64))
        self.gram = max(1, min([GRAM] + [-(-(n - allowed(n, rate)) // (allowed(n, rate) + 1)) for n in self.lengths]))
        at, h = w.runs(self.gram)
        kept = [k for k, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)) if b > a]
        ends = np.searchsorted(w.doc_of(at), np.arange(len(ids) + 1))
        self.own = [h[ends[k] : ends[k + 1]] for k in kept]
        size = np.diff(w.first)[w.doc_of(at)]
        self.grams = np.unique(h)
        self.gram_masks = [np.zeros(len(self.grams), U) for _ in self.masks]
        for c, n in enumerate(self.lengths):
            self.gram_masks[c // 64][np.searchsorted(self.grams, h[size == n])] |= U(1 << (c % 64))
        self.gram_maybe = np.zeros(1 << 20, bool)
        self.gram_maybe[self.grams >> U(44)] = True
        self.of = [of[n] for n in self.lengths]
        self._plan(of, recall)
        self.keys: list[list[dict[int, list[int]]]] = []
        for c, n in enumerate(self.lengths):
            rows = np.stack([self.items[k][1] for k in of[n]])
            keys = self._keys(rows, np.full(len(rows), c))
            met = [defaultdict(list) for _ in range(self.repeats[c])]
            for k, own in zip(of[n], keys.tolist(), strict=True):
                for index, key in zip(met, own, strict=False):
                    index[key].append(k)
            self.keys.append([dict(m) for m in met])
        self.sorted = [[np.array(sorted(m), U) for m in keys] for keys in self.keys]

    def _keys(self, rows: np.ndarray, c: np.ndarray) -> np.ndarray:
        n = np.array(self.lengths)[c]
        wide = np.zeros((len(rows), int(n.max())), U)
        wide[:, : rows.shape[1]] = rows
        most, steps = max(self.repeats[i] for i in np.unique(c)), 3 * int(n.max())
        return embed(wide, n, self.sampled[c, :most, :steps])

    def _plan(self, of: dict[int, list[int]], recall: float) -> None:
        """Samples for each length: as many repetitions as edited items need to meet themselves often enough;
        0 where no number does."""
        rng = np.random.default_rng(7)
        most = max(self.lengths, default=1)
        self.sampled = np.zeros((len(self.lengths), REPEATS, 3 * most), bool)
        for c, n in enumerate(self.lengths):
            for r in range(REPEATS):
                self.sampled[c, r, rng.choice(3 * n, min(SAMPLE, 3 * n), replace=False)] = True
        self.repeats = []
        for c, n in enumerate(self.lengths):
            items, d, edited, true = [self.items[k][1] for k in of[n]], allowed(n, self.rate), [], []
            for case in range(400):  # a hundred of each: any edits or deletions only, inside a text or at its end
                h = items[rng.integers(len(items))]
                new = list(h)
                for _ in range(d):
                    at, kind = int(rng.integers(len(new))), 2 if case & 1 else int(rng.integers(3))
                    if kind == 0:
                        new[at] = U(rng.integers(1 << 62))
                    elif kind == 1:
                        new.insert(at, U(rng.integers(1 << 62)))
                    elif len(new) > 1:
                        del new[at]
                edited.append((new + [U(0) if case & 2 else U(rng.integers(1 << 62)) for _ in range(n)])[:n])
                true.append(h)
            both = [np.concatenate([embed(np.stack(x[lo : lo + 100]).astype(U), np.full(100, n), np.repeat(self.sampled[c : c + 1, :, : 3 * n], 100, 0)) for lo in range(0, 400, 100)]) for x in (edited, true)]
            met = np.maximum.accumulate(both[0] == both[1], axis=1)
            met = np.min([met[case::4].mean(0) for case in range(4)], axis=0)
            self.repeats.append(max(4, int(np.argmax(met >= recall)) + 1) if (met >= recall).any() else 0)

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """Leaks of each text: item_id, code points from and to, edit distance; each item once a text, at its best."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        w = split(texts)
        if len(w.hash) and self.items:
            place, _ = self._intact(w)
            near = np.unique(w.doc_of(place)).tolist()
            for t, found in zip(near, self._search([texts[t] for t in near]), strict=True):
                out[t] = found
        return out

    def _intact(self, w: words.Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs of words that items have, which d edits cannot avoid, and their numbers."""
        place, h = w.runs(self.gram)
        pick = np.flatnonzero(self.gram_maybe[h >> U(44)])
        to = np.minimum(np.searchsorted(self.grams, h[pick]), len(self.grams) - 1)
        same = self.grams[to] == h[pick]
        return place[pick[same]], to[same]

    def _search(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        w = split(texts)
        out: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        n_words = len(w.hash)
        if not n_words or not self.items:
            return [[] for _ in texts]
        known = self.maybe[w.hash >> U(44)]
        at = np.minimum(np.searchsorted(self.words, w.hash[known]), len(self.words) - 1)
        same = self.words[at] == w.hash[known]
        here, ends = np.arange(n_words), np.repeat(w.first[1:], np.diff(w.first))
        pick, to = self._intact(w)
        if not len(pick):
            return [[] for _ in texts]
        run = np.zeros(n_words, U)
        run[pick] = self.grams[to]
        starts, lengths = [], []
        for c, n in enumerate(self.lengths):
            bit = lambda masks: (masks[c // 64] >> U(c % 64)) & U(1)  # noqa: B023, E731
            mine = pick[bit([m[to] for m in self.gram_masks]) > 0]
            d = allowed(n, self.rate)
            if n - d > n_words or not len(mine):
                continue
            intact = np.zeros(n_words + 1, np.int32)
            intact[1 + mine] = 1
            intact = np.cumsum(intact)
            flag = np.zeros(n_words + 1, np.int32)
            flag[1:][known] = bit([m[at] for m in self.masks]).astype(np.int32) * same
            total = np.cumsum(flag)
            stop = np.minimum(here + n, ends)
            good = np.flatnonzero(intact[np.maximum(stop - self.gram + 1, 0)] > intact[:-1])
            good = good[(total[stop[good]] - total[good] >= n - d) & (stop[good] - good >= n - d)]
            starts.append(good)
            lengths.append(np.full(len(good), c))
        start, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths))
        seen: set[tuple[int, int]] = set()
        size = np.array(self.lengths)
        for lo in range(0, len(start), 2048):
            s, c = start[lo : lo + 2048], of[lo : lo + 2048]
            reach = np.arange(int(size[c].max()))
            rows = np.where(reach < np.minimum(size[c], ends[s] - s)[:, None], w.hash[np.minimum(s[:, None] + reach, n_words - 1)], U(0))
            keys = self._keys(rows, c)
            for kind in np.unique(c).tolist():
                mine = np.flatnonzero(c == kind)
                n = self.lengths[kind]
                d = allowed(n, self.rate)
                if not self.repeats[kind]:
                    for first in np.unique(s[mine] // (d + 1)).tolist():
                        for k in self.of[kind]:
                            if (k, first) not in seen:
                                seen.add((k, first))
                                self._verify(k, first * (d + 1), n, d, w, run, out)
                for r, (index, known_keys) in enumerate(zip(self.keys[kind], self.sorted[kind], strict=True)):
                    key = keys[mine, r]
                    for j in mine[known_keys[np.minimum(np.searchsorted(known_keys, key), len(known_keys) - 1)] == key].tolist():
                        for k in index[int(keys[j, r])]:
                            if (near := (k, int(s[j]) // (d + 1))) not in seen:
                                seen.add(near)
                                self._verify(k, near[1] * (d + 1), n, d, w, run, out)
        found, base = [], 0
        for t, text in enumerate(texts):
            rows_of = []
            for k, (far, a, b) in sorted(out[t].items()):
                lo, hi = (len(text[: p - base].decode(errors="ignore")) for p in (int(w.start[a]), int(w.end[b - 1])))
                rows_of.append((self.items[k][0], lo, hi, far))
            found.append(rows_of)
            base += len(text)
        return found

    def _verify(self, k: int, start: int, n: int, d: int, w: words.Words, run: np.ndarray, out: list[dict]) -> None:
        # all windows that begin within d of ``start``, with room for insertions; in which documents they lie
        lo, hi = max(0, start - d), min(len(w.hash), start + n + 3 * d)
        item, part = self.items[k][1], w.hash[lo:hi]
        if not np.isin(run[lo:hi], self.own[k]).any() or np.isin(part, item).sum() < n - d:
            return  # no intact run, or too few of the item's words, for any alignment
        whole = [a for a in np.flatnonzero(part[: len(part) - n + 1] == item[0]).tolist() if np.array_equal(part[a : a + n], item)]
        for doc in range(int(np.searchsorted(w.first, lo, side="right")) - 1, int(np.searchsorted(w.first, hi))):
            first, last = int(w.first[doc]), int(w.first[doc + 1])
            exact = [lo + a for a in whole if first <= lo + a and lo + a + n <= last]
            if exact and out[doc].get(k, (1, 0, 0)) > (0, exact[0], 0):
                out[doc][k] = (0, exact[0], exact[0] + n)
            self._align(k, doc, max(lo, first), min(hi, last), d, w, out)

    def _align(self, k: int, doc: int, lo: int, hi: int, d: int, w: words.Words, out: list[dict]) -> None:
        if hi <= lo or (best := out[doc].get(k)) and best[0] == 0:
            return
        far, a, b = distance(self.items[k][1], w.hash[lo:hi], d)
        if far <= d and b > a and (best is None or (far, lo + a) < best[:2]):
            out[doc][k] = (far, lo + a, lo + b)


def annotate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, name: str = "leaks") -> DataFrame:
    """All columns of ``docs`` and ``name``, which must be new: an array of item_id, start, end (code points) and
    distance."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    spark = docs.sparkSession
    scratch.importable(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length(F.col("text").cast("binary")))).first()[0] or 0
    groups = max(1, -(-size // GROUP))
    text_at = docs.columns.index("text")
    out = docs.withColumn(name, F.array().cast(LEAKS))
    for g in range(groups):  # each group is bounded by GROUP or so, whatever the size of the benchmark
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).orderBy("item_id").collect()
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in part], [r["text"].encode() for r in part], rate, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
            for b in batches:
                lo = 0
                while lo < b.num_rows:
                    hi, held, texts = lo, 0, []
                    while hi < b.num_rows and held < 1 << 20:
                        texts.append((b.column(text_at)[hi].as_py() or "").encode())
                        held += len(texts[-1])
                        hi += 1
                    rows = b.slice(lo, hi - lo)
                    last = rows.num_columns - 1
                    found = [old + [dict(zip(("item_id", "start", "end", "distance"), x, strict=True)) for x in new] for old, new in zip(rows.column(last).to_pylist(), index.search(texts), strict=True)]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:last], pa.array(found, kind)], rows.schema.names)
                    lo = hi

        out = out.mapInArrow(run, out.schema)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, start, end and distance of every leak."""
    found = annotate(docs.select("doc_id", "text"), benchmark, rate, recall)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
