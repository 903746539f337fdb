"""Matches of strings against many candidates: all above a threshold, the best, the first few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions import similarity
from concordia.operators.semantic_join import fuzzy_pairs


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance if it is at most ``most``, else null; only a band of the table is filled."""
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d)


def matches(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, threshold: float = 0.75) -> DataFrame:
    """query, candidate, similarity: all pairs of distinct strings with edit similarity >= threshold."""
    left = queries.select(F.col(query).alias("lk")).where("lk is not null").distinct()
    right = candidates.select(F.col(candidate).alias("rk")).where("rk is not null").distinct()
    return fuzzy_pairs(left, right, threshold).select(F.col("lk").alias("query"), F.col("rk").alias("candidate"), "similarity")


def top_matches(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, k: int = 5, threshold: float = 0.75) -> DataFrame:
    """matches() with a rank up to ``k``: most similar first, ties in order of the candidates.

    Ranks are cut twice, first within parts of the candidates, so a query with very many
    matches is not one task's work.
    """
    order = [F.col("similarity").desc(), F.col("candidate")]
    found = matches(queries, candidates, query, candidate, threshold).withColumn("part", F.pmod(F.xxhash64("candidate"), F.lit(16)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return found.select("query", "candidate", "similarity", "rank")


def best_match(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, threshold: float = 0.75) -> DataFrame:
    """query, candidate, similarity of the first of top_matches()."""
    return top_matches(queries, candidates, query, candidate, 1, threshold).drop("rank")


def compare(pairs: DataFrame, a: str, b: str, threshold: float = 0.75) -> DataFrame:
    """pairs with ``distance``, ``similarity`` and the mixed score of their two strings."""
    x, y = F.col(a), F.col(b)
    mixed = similarity.mixed(x, y, threshold=threshold)
    return pairs.withColumn("distance", F.levenshtein(x, y)).withColumn("similarity", similarity.edit_similarity(x, y)).withColumn("mixed", mixed)
