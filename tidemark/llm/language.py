"""Language identification by rank-order profiles.

The profile of a language is its most frequent letter n-grams (1 to 3 letters, words framed by one blank), ranked.
A document's own most frequent n-grams are compared to each profile by the out-of-place distance: the sum of the
differences in rank, with the profile's length for n-grams it lacks. The nearest profile wins.

Profiles are fitted on a bounded sample of labelled documents, ``per_language`` of each language or so, chosen by a
hash of doc_id; every document is classified whole.

Cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the alphabetically first language;
repeated rows each get their row; with no labelled document everything is ``und``; an empty table gives no rows;
a null doc_id is never held out; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, tokens

#: n-grams of a profile; n-grams of a document that are compared; labelled documents per language, about.
PROFILE, COMPARED, PER_LANGUAGE = 400, 300, 4000
#: Languages at most: beyond, the profiles would no longer be a small table, and learning stops with an error.
MAX_LANGUAGES = 1000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.int64)
    known = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
    out[known] = known
    return out


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, packed in 63 bits, and their counts."""
    codes = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    letter = codes > 0
    codes = np.where(letter, codes, 1)  # a blank is a sign of its own: " a" is not "a"
    two = (codes[:-1] << 21) | codes[1:]
    three = (codes[:-2] << 42) | two[1:]
    grams = np.sort(np.concatenate([codes[letter], two, three[letter[1:-1]]]))
    new = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[new], np.diff(np.concatenate([new, [len(grams)]]))


def top(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent n-grams by rank, ties by n-gram."""
    if len(grams) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:n]]


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, size: int = PROFILE) -> dict[str, list[int]]:
    """Language to ranked n-grams, from the columns doc_id, text and lang."""
    scratch.importable(labelled.sparkSession)
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not totals:
        return {}
    part = F.create_map(*(F.lit(x) for k, n in totals.items() for x in (k, min(1.0, per_language / n))))
    sample = known.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams, n = ngrams(text)
                own = seen.setdefault(lang, Counter())
                for g, k in zip(grams.tolist(), n.tolist(), strict=True):
                    own[g] += k
        rows = [(lang, g, k) for lang, own in seen.items() for g, k in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "gram", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    out: dict[str, list[int]] = {k: [] for k in sorted(totals)}
    for r in best.orderBy("lang", "rank").collect():  # size x languages
        out[r["lang"]].append(r["gram"])
    return out


class Profiles:
    def __init__(self, learned: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(learned), size
        self.grams = np.array(sorted({g for x in learned.values() for g in x}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, learned[name]), k] = np.arange(len(learned[name]))

    def classify(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not self.names:
            return "und", 0.0
        own = top(grams, counts, COMPARED)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size)).sum(0)
        near = 1 - far / (self.size * len(own))
        best = int(np.argmax(near))
        other = np.delete(near, best).max(initial=0)
        return self.names[best], float(near[best] / max(near[best] + other, 1e-9))


def classify(docs: DataFrame, learned: dict[str, list[int]], keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns ``keep`` with lang_pred and score, from the text alone; their names start with ``prefix``, so that none
    clashes with a kept column."""
    if clash := {f"{prefix}lang_pred", f"{prefix}score"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are kept and made: give a prefix")
    rows = docs.select(*(docs[c] for c in keep), docs["text"].cast("string").alias(f"{prefix}tidemark_text"))
    schema = docs.select(*keep).schema.add(f"{prefix}lang_pred", "string").add(f"{prefix}score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(learned)
        for b in tokens.slices(batches):
            found = [profiles.classify(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
