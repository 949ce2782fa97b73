"""Keyword retrieval and ranked selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.functions.text import query_terms


def keyword_scores(df: DataFrame, terms: Column, queries: list[str], text: str | None = None) -> DataFrame:
    """Adds (query_no, score): the query's terms found, over the root of the number of the row's terms; rows without a
    common term are left out. A query without terms finds nothing. All queries are matched in one pass over the rows. With
    ``text``, the column that the terms come from, only rows whose text holds a query's term are taken apart into terms."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_no int, q string").select("query_no", query_terms(F.col("q")).alias("q")).collect()
    asked = [(r[0], list(r[1])) for r in asked if r[1]]
    if not asked:
        return df.select("*", F.lit(0).alias("query_no"), F.lit(0.0).alias("score")).limit(0)
    if text is not None:
        words = sorted({w for _, q in asked for w in q})
        df = df.where(F.col(text).rlike("(?i)" + "|".join(words)))
    hits = [F.struct(F.lit(i).alias("query_no"), F.size(F.array_intersect("__terms", F.array(*map(F.lit, q)))).alias("n")) for i, q in asked]
    rows = df.withColumn("__terms", terms).withColumn("__hit", F.explode(F.filter(F.array(*hits), lambda h: h["n"] > 0)))
    return rows.withColumn("query_no", F.col("__hit.query_no")).withColumn("score", F.col("__hit.n") / F.sqrt(F.greatest(F.size("__terms"), F.lit(1)))).drop("__terms", "__hit")


def first_k(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group; the rank limit is applied before the shuffle as well."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col(rank) <= k)


def quota_first(df: DataFrame, source: str, order: list[Column], quota: int, total: int) -> DataFrame:
    """``total`` rows: the first ``quota`` of every source come first, then the best of the rest, each in order.

    Only what can be chosen is ranked together: the first ``total`` of each source at most."""
    ranked = first_k(df, [source], order, max(quota, total), "source_rank")
    return ranked.orderBy((F.col("source_rank") > quota).asc(), *order).limit(total)
