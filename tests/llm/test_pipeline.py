"""The pipeline on the smallest tables: each stage's decisions, and the pieces at its end."""

import corpus_pipeline
from tidemark.llm import queries


def test_stages(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, work) in enumerate(corpus_pipeline.STAGES):
        work(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
    toxic, unique, clean, redacted = counts[1:5]
    assert counts[0] > toxic > unique >= clean == redacted > 0.7 * counts[0]
    kept = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert len(kept) == redacted


def test_decontamination_stage_drops_short_leaks(spark, tmp_path):
    """Benchmark items with words missing, alone and at both ends of a text, go; the others stay as they are."""
    item = ["item%d" % i for i in range(30)]
    leaks = [item, item[1:], item[:25], item[5:], item[:14] + item[15:], ["so", "it", "goes", *item[:25]], [*item[5:], "and", "so", "on"]]
    other = [item[:23], item[7:], ["quite", "another", "text"], []]
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(leaks + other)], "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.filter(f"doc_id >= {len(leaks)}").collect()))


def cases(spark):
    """Nulls in any column, empty texts, a very long one, repeated rows, copies under null ids, names that operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, score double, leaks string, first string, ids string"
    some = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (2, "alpha beta gamma delta epsilon zeta", None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "   ", None, "b", 3), (3, None, "en", "a", 0)]
    some += [(None, "no id here one two three four", None, None, 29), (None, "another text without any id at all", "de", "b", 33), (6, "word " * 150_000 + "end", "en", "c", 750_003), (7, "token=abcdefghij1234 in it", "en", "a", 26), (7, "token=abcdefghij1234 in it", "en", "a", 26)]
    return spark.createDataFrame([(*r, 0.5, "x", None, "y") for r in some], schema).repartition(2)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_keep_odd_rows(spark, sf):
    docs = cases(spark)
    rows = lambda d: sorted(map(repr, d.collect()))
    for name in ("toxicity", "decontamination"):
        assert rows(stage(name)(spark, docs, sf)) == rows(docs), name
    kept = stage("near_duplicates")(spark, docs, sf)
    assert kept.columns == docs.columns and rows(kept) == rows(docs.distinct().filter("doc_id is null or doc_id <> 2"))
    clean = stage("secrets")(spark, docs, sf)
    assert clean.columns == docs.columns and clean.schema == docs.schema
    want = [{**r.asDict(), **({"text": "[SECRET] in it", "n_chars": 14} if r["doc_id"] == 7 else {})} for r in docs.collect()]
    assert sorted(map(repr, (r.asDict() for r in clean.collect()))) == sorted(map(repr, want))
    pieces = stage("packing")(spark, docs, sf).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 3) == 2 and len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)


def test_stages_on_an_empty_table(spark, sf):
    empty = cases(spark).limit(0)
    for name, work in corpus_pipeline.STAGES:
        assert work(spark, empty, sf).count() == 0, name


def test_near_duplicates_keep_one_of_each_group(spark, sf):
    """A chain of links, copies, and rows of one doc_id with unlike texts."""
    base = [f"w{i}" for i in range(60)]
    chain = [" ".join(base[k : k + 50]) for k in range(0, 9, 2)]
    docs = spark.createDataFrame([(10 + k, t) for k, t in enumerate(chain)] + [(5, chain[2]), (5, "quite another text of some words"), (5, "quite another text of some words"), (3, "QUITE another text of some words")], "doc_id long, text string")
    kept = sorted(map(tuple, stage("near_duplicates")(spark, docs, sf).collect()))
    assert kept == [(3, "QUITE another text of some words"), (5, chain[2])]


def test_stages_may_be_composed_before_they_are_written(spark, sf):
    docs = cases(spark)
    once = stage("near_duplicates")(spark, docs, sf)
    assert stage("secrets")(spark, stage("decontamination")(spark, once, sf), sf).count() == once.count()
