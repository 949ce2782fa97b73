"""Connected components of large graphs: local contraction first, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.session import cut, forget, spread

#: Edges that one task contracts at a time.
LOCAL = 200_000
STARS = T.StructType([T.StructField("whole", T.BooleanType()), T.StructField("u", T.StringType()), T.StructField("v", T.StringType())])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v): neighbours are hung on the least node of their neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    moved = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select("v", F.col("m")).toDF("u", "v").unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each group (parts, by, part) as stars on the least node of each of its components. Rows come sorted so."""
    key, parent = None, {}

    def find(x: str) -> str:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        hung = [(u, r) for u in parent if (r := find(u)) != u]
        return pa.RecordBatch.from_arrays([pa.array([key[0] == 1] * len(hung), pa.bool_()), pa.array([u for u, _ in hung], pa.string()), pa.array([v for _, v in hung], pa.string())], names=STARS.fieldNames())

    for batch in batches:
        for parts, by, part, u, v in zip(*(c.to_pylist() for c in batch.columns)):
            if (parts, by, part) != key:
                if parent:
                    yield stars()
                key, parent = (parts, by, part), {}
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield stars()


def components(edges: DataFrame, by: str | None = None, local: int = LOCAL, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of an edge (u, v) the least node that it is connected with.

    Nodes are strings; loops and edges with null nodes are no edges; repeated edges count once. ``by`` names a column whose
    values no edge connects (an album): edges are brought together by it, at most ``local`` or so in a group, contracted by
    their task, and a group that is whole is done. The parts of larger ones go on in rounds, each written to the shared
    folder, the one before deleted; nothing is collected, and lost executors cost no more than one round."""
    e = edges.where("u is not null and v is not null and u <> v").select((F.col(by).cast("string") if by else F.lit("")).alias("by"), F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    sizes = e.groupBy("by").agg(F.count("*").alias("n")).where(F.col("n") > local).select(F.col("by").alias("large"), F.ceil(F.col("n") / local).cast("int").alias("parts"))
    placed = e.join(sizes, F.col("by").eqNullSafe(F.col("large")), "left").select(F.coalesce("parts", F.lit(1)).alias("parts"), "by", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).alias("part"), "u", "v")
    first = cut(spread(placed, "by", "part").sortWithinPartitions("parts", "by", "part").mapInArrow(_contract, STARS))
    done, now = first.where("whole").select("u", "v"), first.where("not whole").select("u", "v")
    if not now.isEmpty():
        written = None
        for _ in range(most_rounds):
            now = cut(_star(_star(now, True), False))
            if written is not None:
                forget(written)
            written = now
            # done when only stars are left: every node hangs on one other, and nothing hangs on a node that hangs
            once = now.agg((F.count("*") == F.count_distinct("u")).alias("ok")).first()["ok"]
            if once and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
                break
        else:
            raise RuntimeError("components did not settle")
        done = done.unionByName(now)
    return done.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(done.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
