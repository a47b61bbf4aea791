"""Operators 11 to 13 against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, lexical_search, mixing, queries, varbyte

SCHEMA = "doc_id long, text string, source string, score long, rank int, size long, bytes long, block string, key string, unit string, part int"


def rows(pairs):
    return [(i, t, f"s{i % 4}" if i is not None and i % 5 else None, 7, 1, 3, 4, "x", "y", "u", 9) for i, t in pairs]


def said(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé日Z9_-") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [None, "", "   ", "one", "One ONE one", "!!! ---", "ab▁cd", "<|endoftext|> <s> <0x41>", "x\n y\t  z ", "日本語テキスト", said(rng, words, 30_000)]
    out += [said(rng, words, rng.randint(1, 300)) for _ in range(60)]
    pairs = list(enumerate(out)) + [(20, out[20]), (20, out[20]), (21, out[22]), (None, out[25]), (None, out[25]), (-5, out[30])]
    return pairs + [(500 + k, out[40]) for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(7)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        scores = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * count // total
            s = sum(c * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in Counter(terms(text)).items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, docs, texts):
    rng = random.Random(9)
    items = [(k, said(rng, terms(texts[10][1]), 25)) for k in range(25)]
    items += [(0, items[0][1]), (1, "one one ONE " + texts[12][1]), (90, None), (91, ""), (92, "!"), (93, "nowhere"), (None, texts[40][1]), (94, texts[10][1])]
    asked = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, doc_id int, rank int")
    for k in (3, 20):
        found = [tuple(r) for r in lexical_search.search(docs, asked, k).collect()]
        assert sorted(found, key=str) == ranked(texts, items, k)


def test_search_in_several_passes(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 200)
    items = [(k, texts[20 + k][1]) for k in range(12)]
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert sorted((tuple(r) for r in found), key=str) == ranked(texts, items, 5)


def test_search_of_empty_tables(docs, empty):
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(docs, empty.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_posting_blocks_round_trip():
    rng = np.random.default_rng(1)
    df = np.array([1, 64, 65, 700, 3])
    doc = np.concatenate([np.sort(rng.choice(60_000, n, replace=False)) for n in df])
    often = rng.integers(1, 5, len(doc))
    often[[5, 200]] = 300, 1 << 22
    m = np.full(60_000, 100)
    p = lexical_search.pack(doc, often, lexical_search.impacts(often, m[doc]), df)
    import pyarrow as pa

    fields = {"ids": np.zeros(60_000, "<i8"), "norms": m.astype("<i8"), "terms": np.arange(5, dtype="<u8"), **p}
    shard = lexical_search.Shard(pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in fields.values()], list(fields)))
    got = [shard.block(k) for k in range(int(shard.first[-1]))]
    assert np.concatenate([d for d, _ in got]).tolist() == doc.tolist()
    assert np.concatenate([s for _, s in got]).tolist() == lexical_search.impacts(often, m[doc]).tolist()
    assert [int(s.max()) for _, s in got] == shard.most.tolist() and [int(d[-1]) for d, _ in got] == shard.last.tolist()


def test_bounds_skip_blocks():
    """A rare term decides: the long list of a frequent term is opened only around its documents."""
    import pyarrow as pa

    df = np.array([20_000, 30])
    doc = np.concatenate([np.arange(20_000), np.arange(30) * 5])
    often, m = np.ones(len(doc), np.int64), np.full(20_000, 100)
    p = lexical_search.pack(doc, often, lexical_search.impacts(often, m[doc]), df)
    fields = {"ids": np.arange(20_000, dtype="<i8"), "norms": m.astype("<i8"), "terms": np.arange(2, dtype="<u8"), **p}
    shard = lexical_search.Shard(pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in fields.values()], list(fields)))
    best = lexical_search.Best(20)
    shard.search(np.array([0, 1]), np.array([10, 6000]), best)
    assert best.id.tolist() == [5 * k for k in range(20)]
    assert len(shard.open) < 30 < len(shard.most)


def spans(pieces):
    at, out = 0, []
    for i, x in pieces:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def aligned(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(queries.tokenizer_file())
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    each, held = [], Counter()
    for d, text in docs:
        raw = f" {text}".encode()
        a = [(i, bytes(back[c] for c in one.id_to_token(i))) for i in one.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)] if text else []
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            each.append((d, None))
            continue
        a, b = spans(a), spans(b)
        cuts = {x[2] for x in a} & {x[2] for x in b}
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        groups = []
        for end in sorted(cuts):
            groups.append(([], [], end))
        for side, row in ((0, a), (1, b)):
            g = 0
            for i, _, e in row:
                while e > groups[g][2]:
                    g += 1
                groups[g][side].append(str(i))
        each.append((d, (len(a), len(b), links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y, _ in groups), len(groups))))
        held.update(set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for d, x in each:
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, links, text, groups = x
            out.append((d, a, b, groups, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def align(docs):
    import public_tokenizers

    return sorted((tuple(r) for r in alignment.digest(docs, queries.tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model")).collect()), key=str)


def test_alignment_equals_brute_force(docs, texts, empty):
    assert align(docs) == aligned(texts)
    assert align(empty) == []


def test_alignment_of_odd_texts(spark):
    rng = random.Random(11)
    signs = [" ", "  ", "\n", "\t", " ", "　", "\x1c", " ", "a", "the", "Bc", "é", "'s", "'ll", "12", "--", "_", "<|endoftext|>", "日本", "🙂", "½", "é", "▁", "<s>", "ﬁ", "don't"]
    odd = list(enumerate("".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(1500)))
    assert align(spark.createDataFrame(odd, "doc_id long, text string").repartition(5)) == aligned(odd)


def test_tasks_without_tokenizers_do_not_keep_them(monkeypatch):
    """A worker that has encoded segments counts and digests blocks later; both tokenizers then go."""
    runs = {}

    class Rows:
        def mapInArrow(self, run, schema):
            runs[schema] = run

    for step in (alignment._sent, alignment._pair_counts, alignment._digests):
        step(Rows())
    assert len(runs) == 3
    for run in runs.values():
        alignment.pair.cache_clear()
        alignment.pair(queries.tokenizer_file(), __import__("public_tokenizers").path("piece_bpe_32k.model"))
        assert list(run(iter([]))) == [] and not alignment.pair.cache_info().currsize


def test_segments_of_a_block_are_sent_as_one_row(spark):
    links = {k: bytes(range(k % 3 * alignment.LINK)) for k in range(40)}
    rows = [(block, at, links[at]) for block in (7, 1 << 24) for at in links if at % 4 != block % 3]
    got = alignment._sent(spark.createDataFrame(rows, "block long, at int, links binary").coalesce(1)).collect()
    assert sorted(r["block"] for r in got) == [7, 1 << 24]
    for r in got:
        mine = [at for block, at, _ in rows if block == r["block"]]
        assert np.cumsum(varbyte.unpack(bytes(r["number_control"]), bytes(r["number_data"]), r["n"])).tolist() == mine
        assert varbyte.unpack(bytes(r["size_control"]), bytes(r["size_data"]), r["n"]).tolist() == [k % 3 for k in mine]
        assert bytes(r["links"]) == b"".join(links[k] for k in mine)


def test_targets_fill_up_to_the_limit(spark):
    def by_hand(sizes):
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
        pool, open_, out = 1.5 * sum(sizes.values()), set(order), {}
        while open_:
            level = pool / sum(weight[s] for s in open_)
            over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
            if not over:
                return out | {s: level * weight[s] for s in open_}
            out |= {s: 2.0 * sizes[s] for s in over}
            pool -= sum(2.0 * sizes[s] for s in over)
            open_ -= over
        return out

    rng = random.Random(2)
    for n in (1, 2, 5, 40):
        sizes = {f"é{k}" if k % 2 else f"Z{k}": rng.choice([0, 3, 50, 1000, 90_000]) for k in range(n)} | {None: 70, "": 30}
        found = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = by_hand(sizes)
        assert {r.source: pytest.approx(r.target) for r in found} == want


def test_mix_is_near_its_targets(spark, docs, empty):
    rng = random.Random(5)
    made = [(k, said(rng, ["ab", "c", "def"], rng.choice([1, 3, 30, 400, 2500])), f"s{min(k % 9, 5)}" if k % 11 else None) for k in range(1200)]
    table = spark.createDataFrame([*made, (3, made[3][1], made[3][2]), (None, None, None), (7000, "", "s1")], "doc_id long, text string, source string").withColumn("target", F.lit("clash"))
    got = mixing.digest(table.repartition(3))
    kept = got.collect()
    assert len(kept) == 1203 and sorted(map(str, kept)) == sorted(map(str, mixing.digest(table.repartition(8)).collect()))
    words = {i: len((t or "").split()) for i, t, _ in made}
    taken, goal = Counter(), {}
    for r in kept:
        assert r.size == words.get(r.doc_id, 0) and r.taken in (0, r.size, 2 * r.size)
        taken[r.target] += r.taken
        goal[r.target] = r.source_size
    assert sum(goal) == pytest.approx(1.5 * sum(r.size for r in kept))
    for target, words_taken in taken.items():
        assert abs(words_taken - target) <= 30 and target <= 2 * goal[target]
    assert mixing.digest(empty).count() == 0
    assert mixing.digest(docs).count() == docs.count()


def test_settle_keeps_sums_and_means():
    rng = np.random.default_rng(4)
    size, share = rng.integers(1, 50, 40), np.full(40, 0.3)
    met = np.zeros(40)
    for k in range(3000):
        out, held = mixing.settle(size, share, rng.integers(-(2**62), 2**62, 40))
        assert (out * size).sum() == pytest.approx((share * size).sum())
        assert all(x in (0.0, 1.0) or i == held or min(abs(x), abs(x - 1)) < 1e-9 for i, x in enumerate(out))
        met += out
    assert np.abs(met / 3000 - 0.3).max() < 0.05


def test_applied_mix_repeats_documents(docs):
    mixed = mixing.apply(docs)
    want = mixing.digest(docs).agg(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0] == want
    assert "copy" in mixed.columns and "rank" in mixed.columns
