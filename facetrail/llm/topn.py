"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, spread: list[str], subgroups: int | None = None, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group by ``order``, with their rank from 1.

    Stage one hashes ``spread`` into subgroups, as many as the session shuffles into unless told, so that the largest group may
    take all tasks; it ranks and keeps n in each, and only these of every task are shuffled. Stage two ranks the survivors,
    at most n * subgroups of a group however large it is. ``order`` must end in columns that are unique within a group, which makes
    the result the same on every run; rows that still tie share no rank, any of them may come first. Groups with null
    columns are groups of their own, nulls sort as ``order`` says. An empty table gives an empty result; n < 1 is an error.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if subgroups is None:
        subgroups = max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = "__subgroup"
    part = W.partitionBy(*groups, salt).orderBy(*order)
    whole = W.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(subgroups)))
        .withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= n)
        .withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
        .drop(salt)
    )


def best_names(edges: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best-scored distinct names of every face: user_id, face_id, name, rank, edge_id, score.

    An edge counts if its score lies in 0..1 and its name, trimmed and lower case, is not empty; null and NaN scores, null
    and blank names do not count. A name takes its best score, from the smallest edge_id having it; names are in order of
    score descending, then name by code point. Repeated edges count once; albums and faces that are null are groups of their
    own. Names are brought down to one row each before they are ranked, on the map side first.
    """
    name = F.lower(F.trim("name_surface"))
    valid = edges.select("user_id", "face_id", name.alias("name"), "score", "edge_id").where(
        "score >= 0 and score <= 1 and not isnan(score) and name is not null and name <> '' and edge_id is not null"
    )
    # -0.0 and 0.0 are one score; negated, the least struct is the best score with the smallest id
    best = valid.groupBy("user_id", "face_id", "name").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("edge_id").alias("edge_id"))).alias("b"))
    rows = best.select("user_id", "face_id", "name", (-F.col("b.minus")).alias("score"), F.col("b.edge_id").alias("edge_id"))
    return top_n(rows, ["user_id", "face_id"], [F.col("score").desc(), F.col("name").asc()], n, ["name"])
