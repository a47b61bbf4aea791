"""A corpus pipeline of five stages: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows as Parquet and reads them again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, packing, queries, scratch, secrets, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic (op 5, at 0.5) go. Null and empty texts stay unless most examples without words are
    toxic; repeated rows go or stay together; without labels all stay; an empty table stays empty; other columns pass
    through, whatever their names."""
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(queries.remainder(5) != 0), docs)
    scored = toxicity.score(docs, model, tuple(docs.columns), "tidemark_")
    return scored.filter("tidemark_predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links (op 7) stays: the one with the smallest doc_id, a null one last. Rows that
    share doc_id and text are one document, texts without words are linked with nothing, and stay; an empty table stays
    empty; other columns pass through (of repeated rows, those of one of them)."""
    return jaccard_join.dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark (op 3) go. Null and empty texts leak nothing; repeated rows go or stay
    together; without a benchmark all stay; an empty table stays empty; other columns pass through."""
    found = decontamination.annotate(docs, queries.table(spark, sf_dir, "benchmark"), name="tidemark_leaks")
    return found.filter(F.size("tidemark_leaks") == 0).select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets (op 9) are replaced by a mark; documents stay, repeated and empty ones too, and a null text stays
    null. n_chars, where it is a column, follows a changed text; other columns pass through."""
    found = secrets.scan(docs, tuple(docs.columns), "tidemark_found")
    changed = F.size("tidemark_found") > 0
    found = found.select(*docs.columns, changed.alias("tidemark_changed"), secrets.redact(F.col("text"), F.col("tidemark_found")).alias("tidemark_text"))
    new = {"text": F.col("tidemark_text")}
    if "n_chars" in docs.columns:  # of the new text as a column: the fold within another expression of one projection miscounts
        new["n_chars"] = F.when(F.col("tidemark_changed"), F.length("tidemark_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences (op 8), mixed by source. A null or empty text is one token; repeated rows are packed as often
    as they come; a null source is a source; an empty table gives no pieces; other columns play no part."""
    return packing.digest(packing.pack(docs, queries.tokenizer_file()), queries.tokenizer_file())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secrets", secret_spans),
    ("packing", packed),
]
#: Tokens, edit distances and nearest neighbours are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``. What a stage has written on its way goes once its result is stored."""
    docs = queries.table(spark, sf_dir, "documents")
    at = scratch.path(spark, "pipeline")
    for k, (name, work) in enumerate(STAGES):
        known = set(scratch.written(spark))
        work(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        scratch.clear(spark, [p for p in scratch.written(spark) if p not in known])
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
