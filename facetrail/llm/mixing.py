"""Mixing of sources to target weights.

Hierarchical budgeting: the weights of the leaves make up a tree. A source may be a path (``domain/source``), and under it are
its languages, weighed by their tokens to a power below 1, so that small ones aren't drowned; the wanted size flows from the
root to the leaves in proportion to the weights, a leaf takes at most ``max_repeats`` times its tokens, and what it cannot
take goes to its siblings (the other languages of the source), then to the siblings of its parent (other sources), and so on. Each leaf is filled from seeded epochs: every full epoch holds all its records once, the last a prefix, in tokens, of
the records in the order of a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.llm.tokens import VOCABULARY, count_tokens
from facetrail.session import cut


@dataclass
class Node:
    """A domain, language or source of one mix: weight and capacity are sums over its leaves."""

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)
    leaf: object = None
    budget: float = 0.0


def build_tree(leaves: list[tuple[str, float, float]], separator: str = "/") -> Node:
    """leaves: (path, weight, capacity in tokens)."""
    root = Node()
    for path, weight, capacity in leaves:
        node = root
        parts = path.split(separator)
        for k, part in enumerate([None, *parts]):
            if k:
                node = node.children.setdefault(part, Node())
            node.weight += weight
            # what has no weight takes nothing, so its capacity is not there for others
            node.capacity += capacity if weight > 0 else 0.0
        node.leaf = path
    return root


def give(node: Node, budget: float, out: dict[str, float]) -> None:
    """Shares a budget among the children by weight; those that are full pass their rest to their siblings."""
    node.budget = min(budget, node.capacity)
    if node.leaf is not None and not node.children:
        out[node.leaf] = node.budget
        return
    free = {k: c for k, c in node.children.items() if c.weight > 0 and c.capacity > 0}
    given = {k: 0.0 for k in node.children}
    rest = node.budget
    while free and rest > 1e-9 * max(1.0, node.budget):
        total = sum(c.weight for c in free.values())
        full = {k: c for k, c in free.items() if given[k] + rest * c.weight / total >= c.capacity}
        if not full:
            for k, c in free.items():
                given[k] += rest * c.weight / total
            break
        for k, c in full.items():
            rest -= c.capacity - given[k]
            given[k] = c.capacity
            del free[k]
    for k, c in node.children.items():
        give(c, given[k], out)


def hierarchical_budgets(leaves: list[tuple[str, float, float]], total: float, separator: str = "/") -> dict[str, float]:
    """Tokens of each leaf. leaves: (path, weight, capacity)."""
    out: dict[str, float] = {}
    give(build_tree(leaves, separator), total, out)
    return {path: out.get(path, 0.0) for path, _, _ in leaves}


def source_key(column: str = "source"):
    """Spellings of a source brought together: trimmed, lower case, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")


def language_key(column: str = "lang"):
    """Two or three letters of a language, without case and region; 'und' for anything else."""
    code = F.regexp_extract(F.lower(F.trim(F.col(column).cast("string"))), r"^([a-z]{2,3})([-_].*)?$", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("und"))


def measured(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY, language: str = "lang") -> DataFrame:
    """(doc_id, source, lang, n_tokens), one row per key (a repeated row counts once), written to the shared folder once, as the
    corpus is tokenized only once."""
    lang = language_key(f"`{language}`") if language in documents.columns else F.lit("und")
    rows = documents.select(F.col(f"`{key}`").alias("doc_id"), source_key(f"`{source}`").alias("source"), lang.alias("lang"), F.col(f"`{text}`").alias("text"))
    counted = count_tokens(rows, ["doc_id", "source", "lang"], "text", vocabulary)
    once = counted.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "n_tokens")).alias("r")).select("doc_id", "r.source", "r.lang", "r.n_tokens")
    return cut(once)


def budgets(sizes: DataFrame, targets: DataFrame, language_exponent: float, most_targets: int = 100_000) -> list[tuple]:
    """(mix_id, source, lang, target_share, max_repeats, available, budget) of each language of each row of the targets; a
    source without records has one row without a language.

    The targets are a small table; more than ``most_targets`` rows raise an error. Sizes are summed on the cluster and
    only those of sources that the targets name come to the driver, one for each of its languages (of two or three letters).
    """
    wanted = (
        targets.select("mix_id", source_key().alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int"), F.col("total_ratio").cast("double"))
        .where("mix_id is not null and source is not null")
        .groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("total_ratio").alias("total_ratio"))
    )
    if len(wanted.limit(most_targets + 1).collect()) > most_targets:
        raise ValueError(f"more than {most_targets} targets")
    per_source = sizes.where("n_tokens > 0").groupBy("source", "lang").agg(F.sum("n_tokens").alias("available"))
    corpus = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    rows = wanted.join(per_source, "source", "left").collect()
    mixes: dict = {}
    for r in rows:
        mixes.setdefault(r["mix_id"], []).append(r)
    out = []
    for mix in sorted(mixes):
        group = sorted(mixes[mix], key=lambda r: (r["source"], r["lang"] or ""))
        share = {r["source"]: max(r["target_share"] or 0.0, 0.0) for r in group}
        weights = sum(share.values()) or 1.0
        total = max((r["total_ratio"] or 0.0) for r in group) * corpus
        size = lambda r: (r["available"] or 0) ** language_exponent if r["available"] else 0.0
        of_source: dict = {}
        for r in group:
            of_source[r["source"]] = of_source.get(r["source"], 0.0) + size(r)
        path = lambda r: f"{r['source']}/{r['lang'] or ''}"
        leaves = [(path(r), share[r["source"]] / weights * (size(r) / of_source[r["source"]] if of_source[r["source"]] else 1.0), float(max(r["max_repeats"] or 0, 0) * (r["available"] or 0))) for r in group]
        got = hierarchical_budgets(leaves, total)
        out += [(mix, r["source"], r["lang"], r["target_share"], max(r["max_repeats"] or 0, 0), r["available"] or 0, round(got[path(r)])) for r in group]
    return out


def mix_sources(
    documents: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY, seed: int = 7, rows_per_bucket: int = 50_000,
    language: str = "lang", language_exponent: float = 0.7,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixes and the shares they reach.

    First result: mix_id, source, doc_id, copies (1..max_repeats), n_tokens, one row per record taken. Second: mix_id,
    source, target_share, max_repeats, available_tokens, budget_tokens, actual_tokens, actual_share, n_docs. Third: the same by
    language, mix_id, source, lang, available_tokens, budget_tokens, actual_tokens, n_docs. ``language_exponent`` 1 leaves the
    languages of a source as they are, 0 makes them equal; a source takes the same either way.

    Records with a null or unknown source, and those without tokens, are in no mix but count for the size of the corpus.
    A source without records gets nothing; its share goes to its siblings. Null shares, repeats or ratios count as 0,
    repeated targets once (the largest), repeated keys once. Extra columns are left behind.

    A leaf's prefix needs running sums in hash order. They are taken over buckets of the hash first, then only within the one
    bucket where a leaf's budget ends, so no leaf, however large, is ever sorted in one task.
    """
    spark = documents.sparkSession
    sizes = measured(documents, key, source, text, vocabulary, language)
    plan = budgets(sizes, targets, language_exponent)
    n = max(1, sizes.count())
    buckets = 1 << max(6, (n // rows_per_bucket).bit_length())
    schema = "mix_id int, source string, lang string, target_share double, max_repeats int, available long, budget long"
    leaves = spark.createDataFrame([(int(m), s, g, t, r, int(a), int(b)) for m, s, g, t, r, a, b in plan], schema)
    # full epochs, and what is left for the last one; a leaf with nothing left takes no prefix
    leaves = leaves.withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    leaf = ["mix_id", "source", "lang"]
    # the plan is as small as the targets, whose number budgets() has checked, and their languages
    members = sizes.where("n_tokens > 0").join(F.broadcast(leaves.where("budget > 0").select(*leaf, "epochs", "rest")), ["source", "lang"])
    order = F.xxhash64(F.lit(seed), "mix_id", "epochs", "doc_id")
    members = members.withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 64 - buckets.bit_length() + 1).cast("long"))
    sums = members.where("rest > 0").groupBy(*leaf, "rest", "bucket").agg(F.sum("n_tokens").alias("s"))
    run = W.partitionBy(*leaf).orderBy("bucket")
    edge = (
        sums.withColumn("before", F.sum("s").over(run) - F.col("s"))
        .where("before < rest and before + s >= rest")
        .select(*leaf, F.col("bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("room"))
    )
    # one row per row of the plan
    placed = members.join(F.broadcast(edge), leaf, "left")
    inside = W.partitionBy(*leaf).orderBy("h", "doc_id")
    at_edge = placed.where("bucket = edge").withColumn("before", F.sum("n_tokens").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens"))
    # the record at the end is taken if that brings the leaf nearer to its budget
    taken_at_edge = at_edge.select(*leaf, "doc_id", "n_tokens", (F.col("epochs") + (F.col("before") + F.col("n_tokens") / 2 <= F.col("room")).cast("int")).alias("copies"))
    elsewhere = placed.where("edge is null or bucket <> edge").select(*leaf, "doc_id", "n_tokens", (F.col("epochs") + F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0))).alias("copies"))
    taken = elsewhere.unionByName(taken_at_edge).where("copies > 0")
    mix = taken.select("mix_id", "source", "doc_id", F.col("copies").cast("int").alias("copies"), "n_tokens")
    reached = taken.groupBy(*leaf).agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual"), F.count("*").alias("docs"))
    by_leaf = leaves.join(reached, leaf, "left").select(
        *leaf, "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), F.coalesce("actual", F.lit(0)).alias("actual_tokens"), F.coalesce("docs", F.lit(0)).alias("n_docs")
    )
    shares = by_leaf.groupBy("mix_id", "source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), *[F.sum(c).alias(c) for c in ("available_tokens", "budget_tokens", "actual_tokens", "n_docs")]
    )
    whole = F.sum("actual_tokens").over(W.partitionBy("mix_id"))
    shares = shares.select(
        "mix_id", "source", "target_share", "max_repeats", "available_tokens", "budget_tokens", "actual_tokens", F.coalesce(F.col("actual_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)).alias("actual_share"), "n_docs"
    )
    return mix, shares, by_leaf.where("lang is not null").drop("target_share", "max_repeats")
