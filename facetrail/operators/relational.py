"""Relational operators that Spark lacks: numbering, as-of joins, fallback donors, evictions, one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetrail.session import cut


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the position (from 0) of every row in the order of unique columns, without bringing all rows into one task.

    Rows are spread by range and written once; each partition numbers its own rows and adds the counts of those before."""
    parts = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    # one row per partition
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    local = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    return parts.withColumn("__i", local).join(before, "__p").withColumn(name, (F.col("__i") + F.col("__before")).cast("long")).drop("__p", "__i", "__before")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str, tie: str, bucket_seconds: int = 86400) -> DataFrame:
    """left, with the ``value`` of the latest row of right of the same key whose ``at`` is not later (null if there is none).

    Rows of one instant: the greatest ``tie`` counts. Time is cut into buckets; the last value of each bucket is carried
    over the buckets of a key, and only inside a bucket are rows put in order, so a large key is spread over its buckets."""
    b = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (bucket_seconds * 1_000_000))
    r = right.where(F.col(at).isNotNull() & F.col(key).isNotNull()).select(key, at, F.col(value).alias("__v"), F.col(tie).alias("__t")).withColumn("__b", b)
    rows = left.withColumn("__b", b)
    last = r.groupBy(key, "__b").agg(F.max_by(F.struct("__v"), F.struct(at, "__t")).alias("__last"))
    every = rows.select(key, "__b").distinct().join(last, [key, "__b"], "full")
    w = W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    carried = every.select(key, "__b", F.last("__last", True).over(w).alias("__carry"))
    cols = left.columns
    both = rows.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None)).withColumn("__t", F.lit(None)).select(*cols, "__b", "__side", F.lit(None).cast(f"struct<__v:{dict(r.dtypes)['__v']}>").alias("__s"), F.lit(None).cast(dict(r.dtypes)["__t"]).alias("__t"))
    other = r.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(t).alias(c) for c, t in left.dtypes], "__b", F.lit(0).alias("__side"), F.struct("__v").alias("__s"), "__t")
    inner = W.partitionBy(key, "__b").orderBy(at, "__side", "__t").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.unionByName(other).withColumn("__here", F.last("__s", True).over(inner)).where("__side = 1")
    out = seen.join(carried, [key, "__b"], "left")
    return out.select(*cols, F.coalesce("__here", "__carry")["__v"].alias(value))


def fallback_donors(targets: DataFrame, donors: DataFrame, levels: list[list[str]], ordinal: str, donor_id: str) -> DataFrame:
    """targets with (donor, level): a donor from the first level at which there is one, the (ordinal mod n)-th of its n.

    Each level is an equality join on fewer columns; donors are numbered inside each bucket by their id."""
    out = targets
    for k, cols in enumerate(levels):
        w = W.partitionBy(*cols)
        ranked = donors.select(*cols, F.col(donor_id).alias(f"__d{k}"), (F.row_number().over(w.orderBy(donor_id)) - 1).alias(f"__i{k}"))
        sizes = donors.groupBy(*cols).agg(F.count("*").alias(f"__n{k}"))
        out = out.join(sizes, cols, "left").withColumn(f"__i{k}", (F.col(ordinal) % F.col(f"__n{k}")).cast("int")).join(ranked, [*cols, f"__i{k}"], "left")
    pick = F.coalesce(*[F.col(f"__d{k}") for k in range(len(levels))])
    level = F.coalesce(*[F.when(F.col(f"__d{k}").isNotNull(), F.lit(k)) for k in range(len(levels))])
    return out.select(*targets.columns, pick.alias("donor"), level.alias("level"))


def evictions(entries: DataFrame, size: str, at: str, entry: str, limit: int, keep: float = 0.8) -> DataFrame:
    """The least recently used entries to evict, oldest first, until the rest is within ``keep`` of the limit; none if all
    entries are within the limit. Running sums are taken over days first, then inside each day."""
    day = F.to_date(at)
    e = entries.select(entry, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.col(at).alias("at"), day.alias("day"))
    per_day = e.groupBy("day").agg(F.sum("size").alias("s"))
    # one row per day
    before = per_day.select("day", (F.sum("s").over(W.orderBy(F.col("day").asc_nulls_first())) - F.col("s")).alias("before"), F.sum("s").over(W.partitionBy()).alias("total"))
    inner = W.partitionBy("day").orderBy("at", entry).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = e.join(before, e["day"].eqNullSafe(before["day"])).drop(before["day"]).withColumn("gone", F.col("before") + F.sum("size").over(inner) - F.col("size"))
    return rows.where((F.col("total") > limit) & (F.col("gone") < F.col("total") - F.lit(keep) * limit)).select(entry, "size", F.col("gone").alias("freed_before"))


def assign_one_to_one(pairs: DataFrame, group: str, left: str, right: str, score: str, margin: str, least: float = 0.34, least_margin: float = 0.03, slack: float = 0.08, most_rounds: int = 200) -> DataFrame:
    """(group, left, right, score): each left item in turn, best top score first, takes its best free right item.

    Pairs below ``least`` are out, and those with a margin under ``least_margin`` unless their score is ``slack`` above. Taking
    turns in one order for all is the stable matching in which all right items rank the left ones by that order, so it is
    found in rounds for all groups at once: every left item asks its best remaining right item, each right item holds the
    first in turn, and everyone behind the holder drops it. No group is brought into one task. Equal scores: larger margin,
    then smaller right id; equal top scores: smaller left id."""
    p = pairs.where(f"{score} is not null")
    turn = p.groupBy(group, left).agg(F.max(score).alias("__top")).withColumn("__turn", F.struct((-F.col("__top")).alias("t"), F.col(left).alias("l")))
    kept = p.where((F.col(score) >= least) & ((F.col(margin) >= least_margin) | (F.col(score) >= least + slack)))
    wish = kept.select(group, left, right, score, F.struct((-F.col(score)).alias("s"), (-F.col(margin)).alias("m"), F.col(right).alias("r")).alias("__wish"))
    open_ = cut(wish.join(turn.select(group, left, "__turn"), [group, left]))
    for _ in range(most_rounds):
        asks = open_.groupBy(group, left).agg(F.min_by(F.struct(right, score, "__turn"), "__wish").alias("a")).select(group, left, f"a.{right}", f"a.{score}", "a.__turn")
        holders = asks.groupBy(group, right).agg(F.min("__turn").alias("__holder"))
        left_over = open_.join(holders, [group, right], "left").where("__holder is null or __turn <= __holder").drop("__holder")
        now = cut(left_over)
        if now.count() == open_.count():
            break
        open_ = now
    else:
        raise RuntimeError("the assignment did not settle")
    return asks.select(group, left, right, score)


def unpivot(df: DataFrame, keys: list[str], fields: dict[str, str], kind: str = "target_type", value: str = "target_value") -> DataFrame:
    """One row per key and non-blank field: (keys, kind, value)."""
    entries = F.array(*[F.struct(F.lit(name).alias("k"), F.col(c).cast("string").alias("v")) for c, name in fields.items()])
    return df.select(*keys, F.explode(entries).alias("e")).where("trim(e.v) <> ''").select(*keys, F.col("e.k").alias(kind), F.col("e.v").alias(value))


def batches(df: DataFrame, groups: list[str], order: list[Column], size: int) -> DataFrame:
    """Adds batch_no: rows of each group in order, ``size`` to a batch."""
    return df.withColumn("batch_no", F.floor((F.row_number().over(W.partitionBy(*groups).orderBy(*order)) - 1) / size))
