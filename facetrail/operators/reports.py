"""Run reports: costs, usage by stage, budgets, typed aggregates, flattened records, runs put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cost_summary(calls: DataFrame, by: str) -> DataFrame:
    """Calls of each stage, how many tell their tokens, tokens in all, a call and a user; ratios are null over nothing.

    calls: (by, user_id, tokens), one row a call."""
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    n, told, users = F.count("*"), F.count("tokens"), F.count_distinct("user_id")
    return calls.groupBy(by).agg(
        n.alias("n_calls"), told.alias("n_with_usage"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), users.alias("n_users"), ratio(F.sum("tokens"), told).alias("tokens_per_call"), ratio(F.sum("tokens"), users).alias("tokens_per_user"), ratio(told, n).alias("coverage")
    )


def merged_usage(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Usage of two runs added up by stage, stages of either; the share of calls that tell their tokens."""
    both = a.select(by, "tokens", F.lit(1).alias("a")).unionByName(b.select(by, "tokens", F.lit(0).alias("a")))
    return both.groupBy(by).agg(
        F.count_if(F.col("a") == 1).alias("calls_a"), F.count_if(F.col("a") == 0).alias("calls_b"), F.count("*").alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.count("tokens") / F.count("*"), 6).alias("coverage")
    )


def judge_budget(targets: DataFrame, costs: dict[str, tuple[int, int]]) -> DataFrame:
    """(user_id, kind, n_targets, n_calls, n_words): what judging every non-blank field takes; costs: field -> (calls, words a
    call)."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("v"), F.lit(k).alias("calls"), F.lit(w).alias("words")) for c, (k, w) in costs.items()])
    rows = targets.select("user_id", F.explode(kinds).alias("k")).where("trim(k.v) <> ''")
    return rows.groupBy("user_id", "k.kind").agg(F.count("*").alias("n_targets"), F.sum("k.calls").alias("n_calls"), F.sum(F.col("k.calls") * F.col("k.words")).alias("n_words"))


def typed_aggregate(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Columns named n_... summed, all others averaged (nulls left out)."""
    return df.groupBy(*groups).agg(*[(F.sum(c) if c.startswith("n_") else F.avg(c)).alias(c) for c in columns])


def flattened(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The fields of a struct column as columns with a prefix, structs within it too."""

    def leaves(kind: T.StructType, path: str, name: str) -> list:
        out = []
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, f"{path}.`{f.name}`", f"{name}{f.name}_")
            else:
                out.append(F.col(f"{path}.`{f.name}`").alias(f"{name}{f.name}"))
        return out

    return df.select(*[c for c in df.columns if c != column], *leaves(df.schema[column].dataType, f"`{column}`", prefix))


def recomposed(persons: DataFrame, facts: DataFrame) -> DataFrame:
    """Albums that two runs have: the persons of one with the facts of the other; the owner's face of the first, else of the
    second. persons: (user_id, owner_face, persons), facts: (user_id, owner_face, facts)."""
    b = facts.select("user_id", F.col("owner_face").alias("__face"), "facts")
    return persons.join(b, "user_id").select("user_id", F.coalesce(F.nullif("owner_face", F.lit("")), "__face").alias("owner_face"), "persons", "facts")


def unfinished(users: DataFrame, outputs: DataFrame, faults: DataFrame) -> DataFrame:
    """Users still to be done: those without an output, or whose output an audit finds fault with."""
    done = outputs.select("user_id").distinct().join(faults.select("user_id").distinct(), "user_id", "left_anti")
    return users.select("user_id").distinct().join(done, "user_id", "left_anti")
