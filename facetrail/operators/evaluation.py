"""Evaluation of predicted persons against registered ones, calibration, agreement and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrail.functions.text import first_token, fold


def identity_rows(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per variant and registered person: discovered, bound, strict, soft, wrong_face, blank_name.

    A predicted name matches a person if it equals one of the accepted names (folded), or if it is a single word that is the
    first name of this person only. Discovered: any prediction of the album matches; bound: the one at the person's face."""
    t = targets.groupBy("user_id", "person_id").agg(F.min("face_id").alias("face_id"), F.min("canonical_name").alias("canonical_name"), F.min("accepted_aliases").alias("accepted_aliases"), F.min("alignment_difficulty").alias("difficulty"))
    accepted = F.array_compact(F.concat(F.array("canonical_name"), F.coalesce("accepted_aliases", F.array().cast("array<string>"))))
    names = t.select("user_id", "person_id", F.explode(accepted).alias("surface")).select("user_id", "person_id", fold(F.col("surface")).alias("name"), first_token(F.col("surface")).alias("first")).where("name <> ''").distinct()
    p = predicted.groupBy("row_id").agg(*[F.min(c).alias(c) for c in ("user_id", "variant", "face_id", "canonical_name")]).withColumn("name", fold(F.coalesce("canonical_name", F.lit(""))))
    exact = p.join(names.select("user_id", "person_id", "name").distinct(), ["user_id", "name"]).select("row_id", "person_id")
    unique = names.select("user_id", "person_id", "first").distinct().groupBy("user_id", "first").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id")).where("n = 1")
    single = p.where("name <> '' and not contains(name, ' ')").withColumn("first", F.col("name")).join(unique, ["user_id", "first"]).select("row_id", "person_id")
    match = exact.unionByName(single).distinct().join(p.select("row_id", "variant", "face_id"), "row_id")
    found = match.select("variant", "person_id").distinct().withColumn("discovered", F.lit(1.0))
    # the last prediction of a face counts
    at_face = p.where("face_id <> ''").groupBy("variant", "user_id", "face_id").agg(F.max("row_id").alias("row_id"))
    here = at_face.join(p.select("row_id", "name", first_token(F.col("canonical_name")).alias("first")), "row_id")
    variants = p.select("variant").where("variant is not null").distinct()
    base = t.join(variants.join(p.select("variant", "user_id").distinct(), "variant"), "user_id")
    rows = base.join(here, ["variant", "user_id", "face_id"], "left").join(found, ["variant", "person_id"], "left")
    rows = rows.join(match.select("row_id", "person_id").withColumn("bound", F.lit(1.0)), ["row_id", "person_id"], "left")
    rows = rows.join(exact.distinct().withColumn("strict", F.lit(1.0)), ["row_id", "person_id"], "left")
    rows = rows.join(names.select("user_id", "person_id", "first").distinct().withColumn("same_first", F.lit(True)), ["user_id", "person_id", "first"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "variant", "user_id", "person_id", "difficulty", zero("discovered").alias("discovered"), zero("bound").alias("bound"), zero("strict").alias("strict"),
        F.when(F.col("strict") == 1.0, 1.0).when(F.col("same_first"), 0.5).otherwise(0.0).alias("soft"),
        F.when((zero("discovered") == 1.0) & (zero("bound") == 0.0), 1.0).otherwise(0.0).alias("wrong_face"), F.when(F.coalesce("name", F.lit("")) == "", 1.0).otherwise(0.0).alias("blank_name"),
    )


def pir(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Discovery rate, binding rate among the discovered, and their harmonic mean, by group."""
    a = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("discovered").alias("idr"), (F.sum("bound") / F.nullif(F.sum("discovered"), F.lit(0.0))).alias("ibr"), F.avg("strict").alias("strict"), F.avg("soft").alias("soft"), F.avg("wrong_face").alias("wrong_face"), F.avg("blank_name").alias("blank_name"))
    a = a.withColumn("ibr", F.coalesce("ibr", F.lit(0.0)))
    return a.withColumn("pir", F.coalesce(2 * F.col("idr") * F.col("ibr") / F.nullif(F.col("idr") + F.col("ibr"), F.lit(0.0)), F.lit(0.0)))


def calibration_error(rows: DataFrame, groups: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(groups, n, ece): expected calibration error over equal bins of confidence, the last one closed.

    Rows with a null confidence are left out; values are held within 0..1. Two levels: bins first, then their sum."""
    unit = lambda c: F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))
    r = rows.where(F.col(confidence).isNotNull() & ~F.isnan(F.col(confidence).cast("double"))).select(*groups, unit(confidence).alias("c"), F.coalesce(unit(correct), F.lit(0.0)).alias("y"))
    b = r.withColumn("bin", F.least(F.floor(F.col("c") * bins), F.lit(bins - 1))).groupBy(*groups, "bin").agg(F.count("*").alias("k"), F.avg("c").alias("ac"), F.avg("y").alias("ay"))
    return b.groupBy(*groups).agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.abs(F.col("ac") - F.col("ay"))) / F.sum("k")).alias("ece"))


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two sets: 1 if both are empty, 0 if one is. Nulls are empty sets, blank ids don't count."""
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    x, y = clean(a), clean(b)
    common = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(2.0 * common / F.nullif(F.size(x) + F.size(y), F.lit(0)))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(i, j, n) of two scores, each taken to the nearest of 0, 0.5 and 1 (the lower one in the middle)."""
    near = lambda c: F.when(F.col(c) <= 0.25, 0).when(F.col(c) <= 0.75, 1).otherwise(2)
    return rows.where(f"{a} is not null and {b} is not null").groupBy(near(a).alias("i"), near(b).alias("j")).agg(F.count("*").alias("n"))


def weighted_kappa(cells: DataFrame) -> DataFrame:
    """(n, kappa) with quadratic weights from the at most nine cells of a confusion matrix; null where chance gives 0."""
    w = F.pow(F.col("i") - F.col("j"), 2) / 4.0
    total = cells.agg(F.sum("n").alias("t"), (F.sum(w * F.col("n")) / F.sum("n")).alias("o"))
    rows, cols = cells.groupBy("i").agg(F.sum("n").alias("r")), cells.groupBy("j").agg(F.sum("n").alias("c"))
    # three rows by three columns
    expected = rows.join(F.broadcast(cols), F.lit(True)).agg(F.sum(w * F.col("r") * F.col("c")).alias("e"))
    both = total.join(F.broadcast(expected), F.lit(True))
    return both.select(F.col("t").alias("n"), F.round(1 - F.col("o") / F.nullif(F.col("e") / (F.col("t") * F.col("t")), F.lit(0.0)), 6).alias("kappa"))


def kendall(cells: DataFrame, x: str, y: str, n: str) -> DataFrame:
    """(tau): agreeing less disagreeing pairs over both, ties left out, from the cells of two ordered scores.

    Pairs are counted from cumulated counts: for every value of y, the cells before it in x are those of smaller x; the counts
    below and above a cell are sums over the values of y, one row per pair of a cell and a value of y. The domain of y must be
    small (a rating, a rounded value); x may be any score."""
    from pyspark.sql import Window as W

    c = cells.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum(n).alias("n"))
    values = c.select(F.col("y").alias("v")).distinct()
    # for each value of y: its count before every x
    per = c.select("x", F.col("y").alias("v"), "n")
    grid = c.select("x").distinct().join(F.broadcast(values), F.lit(True)).join(per, ["x", "v"], "left").fillna(0, ["n"])
    before = grid.withColumn("before", F.sum("n").over(W.partitionBy("v").orderBy("x")) - F.col("n")).select("x", "v", "before")
    j = c.join(before, "x")
    agree, against = F.sum(F.when(F.col("v") < F.col("y"), F.col("n") * F.col("before"))), F.sum(F.when(F.col("v") > F.col("y"), F.col("n") * F.col("before")))
    zero = lambda s: F.coalesce(s, F.lit(0))
    return j.agg(((zero(agree) - zero(against)) / F.nullif(zero(agree) + zero(against), F.lit(0))).alias("tau"))


def average_ranks(df: DataFrame, groups: list[str], value: str, rank: str) -> DataFrame:
    """Fractional rank of each row in its group, ties sharing their mean rank; from counts per distinct value."""
    from pyspark.sql import Window as W

    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(*groups).orderBy(value))
    ranks = counts.select(*groups, value, (upto - F.col("__n") + (F.col("__n") + 1) / 2.0).alias(rank))
    return df.join(ranks, [*groups, value], "left")


#: Chances of 0, 1, 2, .. times in a draw, cumulated (a Poisson law of mean 1), in steps of 1 / 2^32.
POISSON_STEPS = 2**32


def poisson_steps(most: int = 12) -> list[int]:
    """Bounds of a hashed number below which a unit is drawn at most k times."""
    import math

    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(math.floor(total * POISSON_STEPS))
    return out


def paired_bootstrap(pairs: DataFrame, key: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """(mean_delta, ci_low, ci_high, p_two_sided, n_pairs): resampled means of a - b.

    Every draw weighs each unit by a hashed number of times, of a Poisson law of mean 1 (the bootstrap of a stream): the same on
    every run and engine, in one pass over the units without numbering them, their sums combined before the shuffle; only the
    draws are sorted. A draw without a unit counts as the mean 0."""
    from pyspark.sql import Window as W

    from facetrail.functions.text import stable_integer

    d = pairs.where(f"{a} is not null and {b} is not null").select(F.col(key).cast("string").alias("u"), (F.col(a) - F.col(b)).alias("delta"))
    rows = d.select("u", "delta", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("r"))
    x = stable_integer(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), "u"), POISSON_STEPS)
    times = sum((F.when(x >= s, 1).otherwise(0) for s in poisson_steps()), F.lit(0))
    means = rows.withColumn("w", times).groupBy("r").agg(F.coalesce(F.sum(F.col("w") * F.col("delta")) / F.nullif(F.sum("w"), F.lit(0)), F.lit(0.0)).alias("m"))
    # as many rows as draws
    ranked = means.withColumn("k", F.row_number().over(W.orderBy("m", "r")) - 1)
    stats = ranked.agg(
        F.max(F.when(F.col("k") == int(0.025 * (draws - 1)), F.col("m"))).alias("lo"), F.max(F.when(F.col("k") == int(0.975 * (draws - 1)), F.col("m"))).alias("hi"),
        F.avg((F.col("m") <= 0).cast("double")).alias("le"), F.avg((F.col("m") >= 0).cast("double")).alias("ge"),
    )
    observed = d.agg(F.avg("delta").alias("o"), F.count("*").alias("n_pairs")).where("n_pairs > 0")
    one = observed.join(F.broadcast(stats), F.lit(True))
    p = F.when(F.col("o") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.least("le", "ge")))
    return one.select(F.round("o", 6).alias("mean_delta"), F.round("lo", 6).alias("ci_low"), F.round("hi", 6).alias("ci_high"), F.round(p, 6).alias("p_two_sided"), "n_pairs")
