"""The registered queries of this subpackage: each applies its operator to whole tables under ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binary_tokens, decontamination, jaccard_join, language, lexical_search, main_text, mixing, packing, scratch, secrets, substring_dedup, toxicity, voronoi_knn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi_knn.quantised(table(spark, sf_dir, "embeddings"))
    return voronoi_knn.search(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op2_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch.path(spark, "token-files")
    manifest = binary_tokens.write(table(spark, sf_dir, "documents"), tokenizer_file(), at)
    return binary_tokens.digest(spark, at, manifest)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def remainder(of: int) -> Column:
    """crc32(doc_id as text) mod ``of``, -1 for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(-1))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(remainder(5) != 0), docs)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "neighbours")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return packing.digest(pieces, tokenizer_file())


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language.learn(docs.filter(remainder(3) != 1))
    found = language.classify(docs, learned)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.digest(table(spark, sf_dir, "documents"), tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_binary_tokens": op2_binary_tokens,
    "op3_decontamination": op3_decontamination,
    "op4_main_text": op4_main_text,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_language": op10_language,
    "op11_lexical_search": op11_lexical_search,
    "op12_alignment": op12_alignment,
    "op13_mixing": op13_mixing,
    "pipeline": pipeline,
}
#: White space parts words; md5 stands for a run of words.
_WORDS = r"""d AS (SELECT doc_id, list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents)"""
_TERMS = r"unnest(regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The same results as SQL. Tokens, edit distances, markup, labels' neighbours and entropy windows are beyond it: tests
#: hold those operators against brute force.
ORACLE: dict[str, str] = {
    "op1_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_substring_dedup": f"""WITH {_WORDS.format(text="coalesce(text, '')")}, win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h), cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE m < doc_id),
wd AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d), k AS (SELECT wd.doc_id, count(cov.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY wd.p) FILTER (WHERE cov.p IS NULL), '') AS kept FROM wd LEFT JOIN cov ON cov.doc_id = wd.doc_id AND cov.p = wd.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op7_jaccard_join": f"""WITH RECURSIVE {_WORDS.format(text=_LOWER)}, sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT d.doc_id, coalesce(max(c.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op11_lexical_search": f"""WITH f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS.format(lower=_LOWER)} FROM documents) GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf) AS n FROM f GROUP BY 1),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n), m AS (SELECT doc_id, 75 + (25 * CAST(n AS BIGINT) * docs) // total AS m FROM n, s),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {_TERMS.format(lower=_LOWER)} FROM benchmark) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * max(docs) + 2) / (2.0 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY 1),
r AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0) SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
}
