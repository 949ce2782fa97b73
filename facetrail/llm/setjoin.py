"""All pairs of similar sets, by pigeonhole partitioning.

Two sets of sizes s <= l with Jaccard similarity >= t differ in at most h = floor((1 - t) / (1 + t) * (s + l)) tokens. The
token universe is split by hash into m(s) segments, a number that depends on the smaller size. If the larger set gives every
segment a budget b of 0, 1 or 2 with sum >= h + 1, then in some segment with b > 0 the two sets differ in fewer than b
tokens: they are equal there (b = 1), or equal after one deletion on one side (b = 2). So each set is indexed under its own
size by its segments and their one-deletion neighbours, and looks up, for every smaller size in reach, the segments that
cost least: rare tokens are preferred. The universe is split in SPLITS ways, and a set looks itself up in that which costs
least. Segments that are empty, or would be after a deletion, are in no index: nearly all sets of a size have some. A set
whose budgets can't do without them in any split falls back on segments of one token each, as many of its rarest tokens as it
may miss and one more. Equal sets are joined once, as one.

A pair that meets is looked at only if the parities of 64 hash classes of its tokens differ in no more classes than the
tokens may differ; what is left is verified on the values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.session import cut, spread

#: Odd numbers that spread a hash, one for each way to split the universe.
SPLITS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SINGLE = len(SPLITS)


def most_different(small: int, large: int, threshold: float) -> int:
    """Tokens in which two sets of these sizes may differ at most."""
    return math.floor((1 - threshold) / (1 + threshold) * (small + large) + 1e-9)


def least_common(small: int, large: int, threshold: float) -> int:
    """Tokens that two sets of these sizes must have in common."""
    return math.ceil(threshold / (1 + threshold) * (small + large) - 1e-9)


def segments(small: int, threshold: float) -> int:
    """Number of segments for sets whose smaller size is ``small``."""
    largest = math.floor(small / threshold + 1e-9)
    return max(1, -(-4 * (most_different(small, largest, threshold) + 1) // 5))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(size: int, split: int, segment: np.ndarray) -> np.ndarray:
    """Numbers of segments, one for each size, split and segment."""
    return np.uint64(size << 24 | split << 20) | segment.astype(np.uint64)


def signatures(place: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Keys of segments' contents: the sum of their tokens' hashes, so that a deletion is a subtraction."""
    return scramble(total ^ scramble(place * np.uint64(SPLITS[0]))).view(np.int64)


class Sets:
    """Sets of one size as arrays: hashes and frequencies of their tokens, the rarest first."""

    def __init__(self, h: np.ndarray, p: np.ndarray):
        order = np.lexsort((h, p))
        self.h, self.p = np.take_along_axis(h, order, 1), np.take_along_axis(p, order, 1)
        self.n, self.size = self.h.shape

    def parts(self, m: int, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segment of every token, tokens by segment; number and sum of the tokens of every segment."""
        of = (((self.h * np.uint64(SPLITS[split])) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        mine = of[:, :, None] == np.arange(m)
        return of, mine, mine.sum(1), np.where(mine, self.h[:, :, None], np.uint64(0)).sum(1, dtype=np.uint64)

    def index(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(set, place, content) under which sets can be found."""
        m = segments(self.size, threshold)
        for split in range(len(SPLITS)):
            of, _, count, total = self.parts(m, split)
            rows, j = np.nonzero(count)
            yield rows, places(self.size, split, 2 * j), total[rows, j]
            rows, k = np.nonzero(np.take_along_axis(count, of, 1) > 1)
            j = of[rows, k]
            yield rows, places(self.size, split, 2 * j + 1), total[rows, j] - self.h[rows, k]
        rows = np.repeat(np.arange(self.n), prefix := self.size - least_common(self.size, self.size, threshold) + 1)
        yield rows, places(self.size, SINGLE, np.zeros(len(rows))), self.h[:, :prefix].ravel()

    def probe(self, threshold: float, records: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(set, place, content) that sets look up; segments less one token have odd numbers."""
        for small in range(max(1, math.ceil(threshold * self.size - 1e-9)), self.size + 1):
            m, need = segments(small, threshold), most_different(small, self.size, threshold) + 1
            best, plans = np.full(self.n, np.inf), []
            which = np.full(self.n, SINGLE)
            for split in range(len(SPLITS) if need <= 2 * m else 0):
                of, mine, count, total = self.parts(m, split)
                # expected finds: records times the chance of the same tokens, and of no others in the segment
                rest = np.where(count < small, np.exp(-(small - count) / m), 1.0) * records
                chance = np.exp(np.where(mine, np.log(self.p)[:, :, None], 0.0).sum(1))
                one = np.where(count > 0, chance * rest, np.inf)
                with np.errstate(invalid="ignore"):
                    second = np.where(count > 1, one * (small / m) + rest * chance * np.where(mine, 1 / self.p[:, :, None], 0.0).sum(1), np.inf)
                # the second unit of a budget never costs less than the first, so the cheapest units make up a plan
                units = np.concatenate([one, np.maximum(second, one)], 1)
                picked = np.argsort(units, axis=1, kind="stable")[:, :need]
                cost = np.take_along_axis(units, picked, 1).sum(1)
                budget = np.zeros((self.n, 2 * m), np.int64)
                np.put_along_axis(budget, picked, 1, 1)
                plans.append((of, total, budget[:, :m] + budget[:, m:]))
                better = cost < best
                best[better], which[better] = cost[better], split
            for split, (of, total, budget) in enumerate(plans):
                budget[which != split] = 0
                rows, j = np.nonzero(budget)
                yield rows, places(small, split, 2 * j), total[rows, j]
                # the other set has one token more: its deletion gives this segment
                rows, j = np.nonzero(budget > 1)
                yield rows, places(small, split, 2 * j + 1), total[rows, j]
                # the other set has one token less
                rows, k = np.nonzero(np.take_along_axis(budget, of, 1) > 1)
                j = of[rows, k]
                yield rows, places(small, split, 2 * j), total[rows, j] - self.h[rows, k]
            single = np.flatnonzero(which == SINGLE)
            prefix = self.size - least_common(small, self.size, threshold) + 1
            rows = np.repeat(single, prefix)
            yield rows, places(small, SINGLE, np.zeros(len(rows))), self.h[single, :prefix].ravel()

    def parity(self) -> np.ndarray:
        """For 64 hash classes, whether a set has an odd number of tokens in it."""
        return np.bitwise_xor.reduce(np.uint64(1) << (scramble(self.h) >> np.uint64(58)), axis=1).view(np.int64)


KEYED = T.StructType([T.StructField("rep", T.StringType()), T.StructField("key", T.LongType()), T.StructField("probe", T.BooleanType()), T.StructField("n", T.IntegerType()), T.StructField("parity", T.LongType())])


def _keys(threshold: float, records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), np.int64)
            hs, ps = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            starts = np.cumsum(sizes) - sizes
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                # so many sets at a time that their keys stay within some megabytes
                step = max(1, 400_000 // int(size) ** 2)
                for s in range(0, len(rows), step):
                    part = rows[s : s + step]
                    places = starts[part][:, None] + np.arange(size)
                    sets = Sets(hs[places].astype(np.int64).view(np.uint64), ps[places])
                    names, parity = batch.column(0).take(pa.array(part)), sets.parity()
                    for side, keys in ((False, sets.index(threshold)), (True, sets.probe(threshold, records))):
                        who, place, total = (np.concatenate(x) for x in zip(*keys))
                        if len(who):
                            key = signatures(place, total)
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), pa.array(key), pa.array(np.full(len(who), side)), pa.array(np.full(len(who), size, np.int32)), pa.array(parity[who])], names=KEYED.fieldNames())

    return run


def clean_set(columns: list[str]) -> Column:
    """Distinct values of array columns together, trimmed and lower case, without nulls and empty ones, sorted."""
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    values = F.transform(F.concat(*arrays), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))


def distinct_sets(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records (id, items): (sets: rep, items, with the least id as rep; members: id, rep)."""
    sets = records.groupBy("items").agg(F.min("id").alias("rep"))
    return sets, records.join(sets, "items").select("id", "rep")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b, common, either) of all pairs of different sets (rep STRING, items ARRAY<STRING> sorted, distinct) with
    ``common / either >= threshold``, rep_a < rep_b. Empty and null sets are in no pair."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    sized = sets.where("size(items) > 0")
    exploded = sized.select("rep", F.explode("items").alias("item"))
    frequency = exploded.groupBy("item").agg(F.count("*").alias("f"))
    records = max(1, sized.count())
    weighed = exploded.join(frequency, "item").groupBy("rep").agg(F.collect_list(F.struct(F.xxhash64("item").alias("h"), (F.col("f") / records).alias("p"))).alias("t"))
    keyed = spread(weighed.select("rep", F.col("t.h").alias("h"), F.col("t.p").alias("p")), "rep").mapInArrow(_keys(threshold, records), KEYED)
    index = keyed.where("not probe").select("key", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("parity").alias("px"))
    probe = keyed.where("probe").select("key", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("parity").alias("py"))
    differ = F.floor(F.lit((1 - threshold) / (1 + threshold)) * (F.col("nx") + F.col("ny")) + 1e-9)
    met = index.join(probe, "key").where("nx < ny or (nx = ny and x < y)").where(F.bit_count(F.col("px").bitwiseXOR(F.col("py"))) <= differ)
    found = met.select("x", "y").distinct()
    with_x = found.join(sized.select(F.col("rep").alias("x"), F.col("items").alias("xs")), "x")
    both = with_x.join(sized.select(F.col("rep").alias("y"), F.col("items").alias("ys")), "y")
    common = F.size(F.array_intersect("xs", "ys"))
    either = F.size("xs") + F.size("ys") - F.col("common")
    return (
        both.withColumn("common", common).withColumn("either", either).where(F.col("common") >= F.lit(threshold) * F.col("either") - 1e-9)
        .select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "common", "either")
    )


def record_sets(df: DataFrame, key: str, columns: list[str], least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(sets: rep, items; members: id, rep) of records, as ``similar_records`` takes them; the records are written once."""
    rows = df.select(F.col(key).cast("string").alias("id"), clean_set(columns).alias("items")).where("id is not null").groupBy("id").agg(F.min("items").alias("items")).where(F.size("items") >= least)
    return distinct_sets(cut(rows))


def similar_records(df: DataFrame, key: str, columns: list[str], threshold: float, least: int = 1) -> DataFrame:
    """(id_a, id_b) of all pairs of different records whose sets overlap by ``threshold`` or more, id_a < id_b.

    A record's set holds the values of the array columns together, trimmed, lower case, distinct, without nulls and empty
    ones; records with fewer than ``least`` values, and those with a null key, are in no pair. Of rows with a repeated key
    the least set counts. Other columns don't matter. Only sets that differ are compared; records with equal sets are linked
    through their set.
    """
    sets, members = record_sets(df, key, columns, least)
    pairs = similar_sets(sets, threshold).select("rep_a", "rep_b")
    a, b = members.select(F.col("id").alias("p"), F.col("rep").alias("rep_a")), members.select(F.col("id").alias("q"), F.col("rep").alias("rep_b"))
    across = pairs.join(a, "rep_a").join(b, "rep_b").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    same = a.join(b, F.col("rep_a") == F.col("rep_b")).where("p < q").select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))
    return across.unionByName(same)
