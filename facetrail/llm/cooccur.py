"""Items that appear together, with large-basket blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrail.session import cut, written_bytes

#: Bytes up to which the single counts are sent to every task, and parts that the pairs of one item are else spread over.
SMALL, SALTS = 32 << 20, 32


def whole_baskets(baskets: DataFrame, group: str, basket: str, items: str, chunk: int = 64) -> tuple[DataFrame, DataFrame]:
    """Baskets brought together: (g, items) of the ordinary ones, sorted, and (g, k, parts, c, items) of the chunks of huge
    ones, whose arrays hold more than ``chunk`` items together."""
    rows = baskets.select(F.col(group).alias("g"), F.col(basket).alias("k"), F.array_distinct(F.array_compact(F.col(items))).alias("items")).where(
        "g is not null and k is not null and size(items) > 0"
    )
    # how many items a basket may have at most; only the large ones go on, few or none
    large = rows.groupBy("g", "k").agg(F.sum(F.size("items")).alias("most")).where(F.col("most") > chunk)
    large = large.select("g", "k", F.ceil(F.col("most") / chunk).cast("int").alias("parts"))
    sized = rows.join(large, ["g", "k"], "left")
    whole = sized.where("parts is null").groupBy("g", "k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # each chunk holds the items of one hash class
    single = sized.where("parts is not null").select("g", "k", "parts", F.explode("items").alias("x")).withColumn("c", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    return whole, single.groupBy("g", "k", "parts", "c").agg(F.array_sort(F.collect_set("x")).alias("items"))


def pairs_of(whole: DataFrame, chunks: DataFrame) -> DataFrame:
    """(g, a, b, n) of baskets brought together."""
    # pairs (i <= j) of an ordinary basket
    ordinary = whole.select("g", "items", F.posexplode("items").alias("i", "a")).select("g", "a", F.explode(F.slice("items", F.col("i") + 1, F.size("items"))).alias("b"))
    # products of chunk pairs c <= d meet on (basket, c, d)
    left = chunks.select("g", "k", "c", F.explode(F.sequence("c", F.col("parts") - 1)).alias("d"), F.col("items").alias("xs"))
    right = chunks.select("g", "k", F.explode(F.sequence(F.lit(0), "c")).alias("c"), F.col("c").alias("d"), F.col("items").alias("ys"))
    blocks = left.join(right, ["g", "k", "c", "d"])
    product = blocks.select("g", "c", "d", F.explode("xs").alias("x"), "ys").select("g", "c", "d", "x", F.explode("ys").alias("y")).where("c < d or x <= y")
    split = product.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return ordinary.unionByName(split).groupBy("g", "a", "b").agg(F.count("*").alias("n"))


def pair_counts(baskets: DataFrame, group: str, basket: str, items: str, chunk: int = 64) -> DataFrame:
    """(group, a, b, n): the number of distinct baskets of the group with both items, a <= b; a = b counts the item itself.

    ``items`` is an array per row; rows of one basket are taken together, null and empty arrays and null items are left out,
    repeats count once, rows with a null group or basket are left out. Baskets whose arrays hold more than ``chunk`` items are
    split into item chunks by hash, and each pair of chunks is a row of its own, so the pairs of one huge basket are made by
    many tasks; the counts of all pairs are combined before they are shuffled.
    """
    return pairs_of(*whole_baskets(baskets, group, basket, items, chunk))


def associations(baskets: DataFrame, group: str, basket: str, items: str, min_count: int = 1, min_lift: float = 0.0, chunk: int = 64) -> DataFrame:
    """(group, item_a, item_b, n_ab, n_a, n_b, n_baskets, lift, pmi) of all pairs of two items of a group with
    ``n_ab >= min_count`` and ``n_ab * n_baskets >= min_lift * n_a * n_b``.

    lift is how often the pair occurs against chance, n_ab * N / (n_a * n_b), pmi its logarithm to base 2; N is the number of
    the group's baskets with at least one item. Nulls, repeats and empty arrays as in ``pair_counts``; item_a < item_b. All
    counts are made once and written.
    """
    counts = cut(pair_counts(baskets, group, basket, items, chunk))
    totals = (
        baskets.select(F.col(group).alias("g"), F.col(basket).alias("k"), F.array_compact(F.col(items)).alias("items"))
        .where("g is not null and k is not null and size(items) > 0").select("g", "k").distinct().groupBy("g").agg(F.count("*").alias("n_baskets"))
    )
    # the single counts with the total of their group: one row an item, never joined with the pairs on the group alone
    single = cut(counts.where("a = b").select("g", F.col("a").alias("item"), "n").join(totals, "g"))
    pairs = counts.where(f"a < b and n >= {int(min_count)}").withColumnRenamed("n", "n_ab")
    one = single.select("g", F.col("item").alias("a"), F.col("n").alias("n_a"), "n_baskets")
    two = single.select("g", F.col("item").alias("b"), F.col("n").alias("n_b"))
    if written_bytes(single) <= SMALL:
        both = pairs.join(F.broadcast(one), ["g", "a"]).join(F.broadcast(two), ["g", "b"])
    else:
        # an item in very many pairs: its pairs are spread over SALTS tasks, the single counts go to all of them
        salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
        first = pairs.withColumn("salt", salt("b")).join(salted(one), ["g", "a", "salt"]).drop("salt")
        both = first.withColumn("salt", salt("a")).join(salted(two), ["g", "b", "salt"]).drop("salt")
    out = both.where(F.col("n_ab") * F.col("n_baskets") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n_ab") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    return out.select(F.col("g").alias(group), F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", "n_baskets", lift.alias("lift"), F.log2(lift).alias("pmi"))


def faces_of_photos(photos: DataFrame, face_units: DataFrame) -> DataFrame:
    """(user_id, photo_id, faces): what each record says about the faces of a photo, several rows a photo."""
    seen = photos.select("user_id", "photo_id", F.col("visible_face_ids").alias("faces"))
    units = face_units.select("user_id", "photo_id", F.concat(F.array("face_id"), F.coalesce("co_faces", F.array().cast("array<string>"))).alias("faces"))
    return seen.unionByName(units)
