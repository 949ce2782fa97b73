"""Radius joins of names in a metric space, by pivots.

The distance of two names is the sum of the true Damerau-Levenshtein distances (insert, delete, replace, swap neighbours;
a metric) of their given and family parts, a metric on pairs. Every name is assigned to its nearest pivot and, by the triangle
inequality, also visits every cell whose pivot is at most 2 * radius farther: for two names x, y within the radius,
d(x, p_y) <= d(x, y) + d(y, p_y) <= r + d(y, p_x) <= 2 r + d(x, p_x), so x is seen in the home cell of y. Inside each cell the
join is exact.

There are two levels. A space of up to BLOCK names is divided by its pivots (one name in PIVOTS) inside one task. A larger one
is first divided across tasks by COARSE pivots, whose number is bounded, and again, as long as cells are larger than a block;
each cell is then a space of its own, so no name ever meets all others of its space. Long names go by the one pivot that
everything has, the empty name: their distance to it is their length, so they only meet names whose length is within the
radius, where bounded edit distances are computed in a narrow band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.session import cut, spread

#: Names of a space that one task divides; one name in so many is a pivot; pivots of a space that is divided across tasks;
#: letters from which a name is long.
BLOCK, PIVOTS, COARSE, LONG = 1024, 8, 256, 48
#: Levels of division across tasks at most: cells that copies of near names keep large are joined in blocks afterwards.
LEVELS = 4


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits between two strings, where neighbours may be swapped and edited again: a metric."""
    return bounded(a, b, len(a) + len(b))


def bounded(a: str, b: str, most: int) -> int:
    """The same distance as far as ``most``, any larger number beyond: only cells within ``most`` of the diagonal count."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return n or m
    top = n + m + 1
    rows = {-1: {}, 0: {j: j for j in range(min(m, most) + 1)}}
    seen: dict[str, int] = {}
    for i in range(1, n + 1):
        c, above, row, match = a[i - 1], rows[i - 1], {}, 0
        lo, hi = max(1, i - most), min(m, i + most)
        if lo == 1:
            row[0] = i
        else:
            # the last column left of the band in which b has this letter
            match = b.rfind(c, max(0, lo - 1 - most - 1), lo - 1) + 1
        for j in range(lo, hi + 1):
            k, d = seen.get(b[j - 1], 0), match
            cost = 1
            if c == b[j - 1]:
                cost, match = 0, j
            best = above.get(j - 1, top) + cost
            best = min(best, above.get(j, top) + 1, row.get(j - 1, top) + 1)
            if k and d:
                best = min(best, rows.get(k - 1, {}).get(d - 1, top) + (i - k - 1) + 1 + (j - d - 1))
            row[j] = best
        if min(row.values(), default=0) > most and min(above.values(), default=0) > most:
            return most + 1
        rows[i] = row
        seen[c] = i
        rows.pop(i - most - 3, None)
    return rows[n].get(m, top)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to LONG letters as a matrix of code points, and their lengths."""
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    width = max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(words), width), np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.int32)
    return out, lengths


def pair_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """True Damerau-Levenshtein distances of many pairs of words at once (rows of code points and lengths)."""
    p = len(la)
    n, m = int(la.max(initial=0)), int(lb.max(initial=0))
    if not p:
        return np.zeros(0, np.int64)
    d = np.zeros((n + 1, m + 1, p), np.int16)
    d[:, 0] = np.arange(n + 1, dtype=np.int16)[:, None]
    d[0] = np.arange(m + 1, dtype=np.int16)[:, None]
    at = np.arange(p)
    a, b = np.ascontiguousarray(a[:, :n].T), np.ascontiguousarray(b[:, :m].T)
    # for every place of b, the last row in which a had its letter
    last = np.zeros((m + 1, p), np.int64)
    for i in range(1, n + 1):
        match = np.zeros(p, np.int64)
        for j in range(1, m + 1):
            same = a[i - 1] == b[j - 1]
            best = np.minimum(d[i - 1, j - 1] + ~same, np.minimum(d[i - 1, j], d[i, j - 1]) + 1)
            k = last[j]
            swap = np.flatnonzero((k > 0) & (match > 0))
            if len(swap):
                ks, ds, ps = k[swap], match[swap], at[swap]
                best[swap] = np.minimum(best[swap], d[ks - 1, ds - 1, ps] + (i - ks - 1) + 1 + (j - ds - 1))
            d[i, j] = best
            match[same] = j
        for j in range(1, m + 1):
            last[j][a[i - 1] == b[j - 1]] = i
    return d[la, lb, at].astype(np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .., one after the other."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.arange(total) + np.repeat(start - before, size)


class Names:
    """Names of some spaces as pairs of word numbers; each distance of two words is computed once for a list of pairs."""

    def __init__(self, names: list[tuple[str, str]]):
        numbers: dict[str, int] = {}
        self.given = np.array([numbers.setdefault(g, len(numbers)) for g, _ in names], np.int64)
        self.family = np.array([numbers.setdefault(f, len(numbers)) for _, f in names], np.int64)
        self.code, self.length = codes(list(numbers))
        self.bag = np.zeros((len(numbers), 32), np.int8)
        rows, cols = np.nonzero(self.code)
        np.add.at(self.bag, (rows, self.code[rows, cols] & 31), 1)

    def least(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A lower bound of the distances of the pairs x[k], y[k] of names, by the counts of their letters."""
        out = np.zeros(len(x), np.int16)
        for s in range(0, len(x), 200_000):
            for part in (self.given, self.family):
                diff = self.bag[part[x[s : s + 200_000]]] - self.bag[part[y[s : s + 200_000]]]
                more, less = np.maximum(diff, 0).sum(1, dtype=np.int16), np.maximum(-diff, 0).sum(1, dtype=np.int16)
                out[s : s + 200_000] += np.maximum(more, less)
        return out

    def _words(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = np.flatnonzero(x != y)
        if len(todo):
            n = len(self.length)
            pairs, back = np.unique(np.minimum(x[todo], y[todo]) * n + np.maximum(x[todo], y[todo]), return_inverse=True)
            i, j = pairs // n, pairs % n
            # pairs of like length together, so that short words aren't computed as long ones
            order = np.lexsort((self.length[j], self.length[i]))
            got = np.empty(len(pairs), np.int64)
            for s in range(0, len(pairs), 4_000):
                o = order[s : s + 4_000]
                got[o] = pair_distances(self.code[i[o]], self.length[i[o]], self.code[j[o]], self.length[j[o]])
            out[todo] = got[back]
        return out

    def distances(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the given and the family names of the pairs x[k], y[k]."""
        return self._words(self.given[x], self.given[y]), self._words(self.family[x], self.family[y])

    def cells(self, x: np.ndarray, pivot: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, pivot, home) of the cell each name is at home in and of those it visits by the triangle inequality.

        x[k], pivot[k]: every name with every pivot of its space."""
        low, d = self.least(x, pivot), np.full(len(x), 1 << 29)
        nearest = np.full(len(self.given), 1 << 30)
        known, step = np.zeros(len(x), bool), radius
        while True:
            # first a narrow ring around each name, then wider ones until its nearest pivot is in it
            todo = np.flatnonzero(~known & (nearest[x] > step // 2) & (low <= step + 2 * radius))
            d[todo] = sum(self.distances(x[todo], pivot[todo]))
            known[todo] = True
            np.minimum.at(nearest, x[todo], d[todo])
            if not len(x) or (nearest[x] <= step).all():
                break
            step = step * 2 + 1
        kept = np.flatnonzero(d <= nearest[x] + 2 * radius)
        # of equally near pivots the first is the home
        kept = kept[np.lexsort((pivot[kept], d[kept], x[kept]))]
        name = x[kept]
        home = np.ones(len(name), bool)
        home[1:] = name[1:] != name[:-1]
        return name, pivot[kept], home


def chosen(names: list[tuple[str, str]]) -> np.ndarray:
    """Pivots of a space: one name in PIVOTS by hash, one at least."""
    h = np.array([crc32(f"{g}\x1f{f}".encode("utf-8", "surrogatepass")) for g, f in names], np.int64)
    picked = np.flatnonzero(h % PIVOTS == 0)
    return picked if len(picked) else np.array([int(np.argmin(h))])


def pairs_in_cells(spaces: list[list[tuple[str, str]]], home: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, dg, df), i < j, of all pairs of a space within its radius of which one at least is at home in it, through cells.

    Names are numbered from the first of the first space on; ``home`` by name, ``radius`` by space."""
    sizes = np.array([len(x) for x in spaces], np.int64)
    base = np.cumsum(sizes) - sizes
    n = Names([x for space in spaces for x in space])
    picked = [chosen(x) + b for x, b in zip(spaces, base)]
    each = np.array([len(x) for x in picked], np.int64)
    pivots, first = np.concatenate(picked), np.cumsum(each) - each
    space_of = np.repeat(np.arange(len(spaces)), sizes)
    x = np.repeat(np.arange(len(space_of)), each[space_of])
    found = [np.zeros(0, np.int64)] * 3
    for r in np.unique(radius):
        mine = radius[space_of[x]] == r
        got = n.cells(x[mine], pivots[ranges(first[space_of], each[space_of])][mine], int(r))
        found = [np.concatenate(c) for c in zip(found, got)]
    name, pivot, at_home = found[0], found[1], found[2].astype(bool)
    order = np.lexsort((name, pivot))
    name, pivot, at_home = name[order], pivot[order], at_home[order]
    starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
    width = np.diff(np.r_[starts, len(pivot)])
    cell = np.repeat(np.arange(len(starts)), width)
    own = np.flatnonzero(at_home)
    left = np.repeat(own, width[cell[own]])
    right = ranges(starts[cell[own]], width[cell[own]])
    keep = (name[left] != name[right]) & (~at_home[right] | (name[left] < name[right])) & (home[name[left]] | home[name[right]])
    a, b = name[left[keep]], name[right[keep]]
    most = radius[space_of[a]]
    keep = n.least(a, b) <= most
    both = np.unique(np.minimum(a, b)[keep] * len(space_of) + np.maximum(a, b)[keep])
    i, j = both // len(space_of), both % len(space_of)
    dg, df = n.distances(i, j)
    keep = dg + df <= radius[space_of[i]]
    return i[keep], j[keep], dg[keep], df[keep]


def long_pairs(names: list[tuple[str, str]], home: np.ndarray, radius: int) -> Iterator[tuple[int, int, int, int]]:
    """The same for long names of about one length."""
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if home[i] or home[j]:
                dg = bounded(names[i][0], names[j][0], radius)
                if dg <= radius and (df := bounded(names[i][1], names[j][1], radius - dg)) + dg <= radius:
                    yield i, j, dg, df


FOUND = T.StructType([T.StructField(c, T.StringType()) for c in ("cell", "g1", "f1", "g2", "f2")] + [T.StructField(c, T.IntegerType()) for c in ("dg", "df")])


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every group (cell, block); rows come sorted by both. Small groups are joined together, each in itself."""
    names = FOUND.fieldNames()
    waiting: list = []  # (cell, radius, space, home)
    key, rows = None, []

    def record(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k > 4 else pa.string()) for k, c in enumerate(zip(*out))], names=names)

    def join() -> list:
        out = []
        spaces = [w[2] for w in waiting]
        i, j, dg, df = pairs_in_cells(spaces, np.concatenate([w[3] for w in waiting]), np.array([w[1] for w in waiting]))
        flat = [(w[0], x) for w in waiting for x in w[2]]
        for p, q, g, f in zip(i.tolist(), j.tolist(), dg.tolist(), df.tolist()):
            a, b = sorted((flat[p][1], flat[q][1]))
            if a != b:
                out.append((flat[p][0], *a, *b, g, f))
        waiting.clear()
        return out

    def close() -> list:
        """The group that has come to its end: long names are joined at once, others wait for company."""
        if key is None or len(rows) < 2:
            return []
        cell, _, radius, long = key
        space, home = [(g, f) for g, f, _ in rows], np.array([h for _, _, h in rows], bool)
        if long:
            return [(cell, *sorted((space[i], space[j]))[0], *sorted((space[i], space[j]))[1], g, f) for i, j, g, f in long_pairs(space, home, radius) if space[i] != space[j]]
        waiting.append((cell, radius, space, home))
        return join() if sum(len(w[2]) ** 2 for w in waiting) > 1_000_000 else []

    for batch in batches:
        for cell, block, radius, long, g, f, h in zip(*(c.to_pylist() for c in batch.columns)):
            if key is None or (cell, block, radius, long) != key:
                if out := close():
                    yield record(out)
                key, rows = (cell, block, radius, long), []
            rows.append((g, f, h))
    for out in (close(), join() if waiting else []):
        if out:
            yield record(out)


def divided(now: DataFrame) -> DataFrame:
    """(cell, block, radius, home, given, family): the names of spaces beyond BLOCK names in cells that one task joins each.

    Spaces are divided by COARSE pivots, level by level."""
    where, done = ["cell", "block"], []
    for level in range(LEVELS):
        now = cut(_cells_across_tasks(now, level))
        large = cut(now.groupBy(*where).agg(F.count("*").alias("n")).where(f"n > {BLOCK}"))
        if large.isEmpty():
            break
        done.append(now.join(large, where, "left_anti"))
        now = now.join(large.select(*where), where, "left_semi")
    else:
        now = _in_blocks(now, large)
    return reduce(DataFrame.unionByName, [*done, now])


def _in_blocks(big: DataFrame, large: DataFrame) -> DataFrame:
    """Cells that no pivot divides: every pair of blocks of their names is a space."""
    sized = big.join(large.select("cell", "block", "n"), ["cell", "block"]).withColumn("k", F.ceil(2 * F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("given", "family"), F.col("k")).cast("int")
    other = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    name = F.concat_ws("-", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    return other.select("cell", "radius", "given", "family", F.concat_ws("/", "block", name).alias("block"), "home")


def _cells_across_tasks(big: DataFrame, level: int) -> DataFrame:
    """The names of large spaces in the cells of at most COARSE pivots of each space."""
    where = ["cell", "block"]
    order = F.xxhash64(F.lit(level), "given", "family")
    # the pivots of a space: its names with the least hashes
    packed = F.struct(order.alias("h"), "given", "family")
    picked = big.where("home").withColumn("salt", F.pmod(F.xxhash64("given", "family"), F.lit(64)))
    first = picked.groupBy(*where, "salt").agg(F.slice(F.array_sort(F.collect_list(packed)), 1, COARSE).alias("p")).groupBy(*where).agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, COARSE).alias("p"))
    pivots = first.select(*where, F.transform("p", lambda s: F.struct(s["given"].alias("g"), s["family"].alias("f"))).alias("pivots"))
    fields = "cell string, block string, radius int, home boolean, given string, family string"
    # names of a space go to many tasks in chunks, each with the pivots of its space once
    chunk = F.pmod(F.xxhash64("family", "given"), F.lit(4096))
    groups = big.withColumn("chunk", chunk).groupBy(*where, "radius", "chunk").agg(F.collect_list(F.struct("given", "family", "home")).alias("names")).join(pivots, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, block, radius, names, pivots in zip(*(batch.column(i).to_pylist() for i in range(5))):
                k = len(pivots)
                n = Names([(p["g"], p["f"]) for p in pivots] + [(x["given"], x["family"]) for x in names])
                name, pivot, home = n.cells(np.repeat(np.arange(len(names)) + k, k), np.tile(np.arange(k), len(names)), radius)
                for i, p, h in zip(name.tolist(), pivot.tolist(), home.tolist()):
                    x = names[i - k]
                    out.append((cell, f"{block}/{p}", radius, bool(h and x["home"]), x["given"], x["family"]))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["cell", "block", "radius", "home", "given", "family"])

    return spread(groups.select("cell", "block", "radius", "names", "pivots")).mapInArrow(run, fields)


def radius_join(points: DataFrame, radius: int | None = None) -> DataFrame:
    """(cell, g1, f1, g2, f2, dg, df) of all pairs of different points of one space with dg + df <= radius.

    points: (cell STRING, given STRING, family STRING[, radius INT]), distinct, no nulls; ``cell`` names the space, which has
    one radius. (g1, f1) < (g2, f2). The result is written to the shared folder."""
    if radius is not None:
        points = points.withColumn("radius", F.lit(radius))
    points = cut(points.select("cell", F.col("radius").cast("int").alias("radius"), "given", "family"))
    size = F.length("given") + F.length("family")
    short = points.where(size <= LONG).select("cell", F.lit("").alias("block"), "radius", F.lit(False).alias("long"), "given", "family", F.lit(True).alias("home"))
    # shells around the empty name: a long name is at home in that of its length and visits the longer ones in reach; names
    # a little shorter visit too
    shells = points.where(size > F.lit(LONG) - F.col("radius")).withColumn("s", F.explode(F.sequence(size, size + F.col("radius")))).where(F.col("s") > LONG)
    shells = shells.select("cell", F.concat(F.lit("long"), F.col("s").cast("string")).alias("block"), "radius", F.lit(True).alias("long"), "given", "family", (F.col("s") == size).alias("home"))
    groups = short.unionByName(shells)
    large = cut(groups.groupBy("cell", "block", "long").agg(F.count("*").alias("n")).where(f"n > {BLOCK}"))
    if not large.isEmpty():
        where = ["cell", "block"]
        beyond = groups.join(large.select(*where), where, "left_semi")
        split = divided(beyond.where("not long").drop("long")).withColumn("long", F.lit(False))
        longs = _in_blocks(beyond.where("long"), large).withColumn("long", F.lit(True))
        groups = groups.join(large, where, "left_anti").unionByName(split).unionByName(longs)
    cols = ["cell", "block", "radius", "long", "given", "family", "home"]
    found = spread(groups.select(*cols), "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_join, FOUND)
    return cut(found.distinct())


def cell_counts(points: DataFrame, radius: int) -> DataFrame:
    """(cell, names, pivots, visits): how many names of each space go through cells of how many pivots, and how often a name
    visits a cell that isn't its home. For spaces that one task divides."""
    rows = points.select("cell", "given", "family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                space = [(x["given"], x["family"]) for x in names]
                pivots = chosen(space)
                name, pivot, home = Names(space).cells(np.repeat(np.arange(len(space)), len(pivots)), np.tile(pivots, len(space)), radius)
                out.append((cell, len(set(name.tolist())), len(set(pivot.tolist())), int((~home).sum())))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["cell", "names", "pivots", "visits"])

    return rows.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("given", "family"))).alias("names")).where(F.size("names") <= BLOCK).mapInArrow(run, "cell string, names long, pivots long, visits long")
