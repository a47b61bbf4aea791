"""Fits of the library's own boosted trees, and the gates around them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.kept import kept_rows
from . import boosting, evaluation


def fit(rows: DataFrame, features: list[str], label: str = "y", trees: int = 20, depth: int = 3) -> boosting.Forest:
    """Boosted trees on ``features``; missing values are routed as the splits have learned."""
    return boosting.fit(rows, features, label, trees=trees, depth=depth)


def score(model: boosting.Forest, rows: DataFrame) -> DataFrame:
    return boosting.score(model, rows)


def holdout(rows: DataFrame, features: list[str], train: str, label: str = "y") -> DataFrame:
    """AUC on the rows that ``train`` (an SQL condition) leaves out. The rows are made once, for all passes over them."""
    rows = kept_rows(rows)
    scored = score(fit(rows.filter(train), features, label), rows.filter(f"not ({train})"))
    return evaluation.auc(scored if label == "y" else scored.withColumnRenamed(label, "y"))


def ablation(rows: DataFrame, families: dict[str, list[str]], train: str) -> dict[str, float]:
    """AUC without each family of features."""
    every = [c for cs in families.values() for c in cs]
    return {name: holdout(rows, [c for c in every if c not in left_out], train).first()["auc"] for name, left_out in families.items()}


def better(candidate: float, production: float, uplift: float = 0.005) -> bool:
    """Whether a candidate replaces the model in production."""
    return candidate is not None and (production is None or candidate >= production + uplift)
