"""Mapping of freely typed values to a reference list: a trie of the entries' labels searched with a Levenshtein automaton.

The trie holds a path for every label and other label of an entry and for the aliases made from them: the label without its
vowels, and the initials of labels of three or more words. Every kind of path has its own distance limit by length. The
automaton of a typed value runs down the trie; its state is the row of edit distances between the value and the path, where a
swap of neighbours is one edit, and a branch ends where every distance is beyond the largest allowed. The automata of all
distinct values of a batch run down the trie together, one array operation a trie node for those still alive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.session import cut, written_bytes

#: What people write around a label without changing what it means.
BEFORE = ("my ", "the ", "our ", "likely ", "probably ", "maybe ", "owner's ", "a ", "an ")
AFTER = (" of the owner", " of owner", " (probably)", " (maybe)", " (likely)")
#: A spelling that isn't a label is a word of its own, not a label with errors, if it is met so many times at least, and at
#: least so often for each time that its entry is met in its most frequent spelling: one and the same error isn't made so often.
OWN_WORD, OWN_SHARE = 10, 0.12
#: Bytes of resolved values up to which all are sent to every task; a value is sent alone if a HEAVY-th of all rows have it.
SMALL, HEAVY = 32 << 20, 1000
#: Digits and signs read for letters.
LOOKALIKES = str.maketrans("013457@$", "oieastas")
VOWELS = frozenset("aeiou")


def fold(value: str) -> str:
    """Lower case without accents; separators as single blanks."""
    text = unicodedata.normalize("NFKD", value.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"[\s_\-./,]+", " ", text).strip()


def limit(length: int) -> int:
    """Edits allowed for a length."""
    return 0 if length < 3 else 1 if length < 5 else 2 if length < 8 else 3 if length < 12 else 4


def skeleton(text: str) -> str:
    """Without vowels, but for the first character."""
    return text[:1] + "".join(c for c in text[1:] if c not in VOWELS)


LABEL, SKELETON, INITIALS = 0, 1, 2


def alias_limit(kind: int, length: int) -> int:
    """Edits allowed for an alias: none for initials, one for words without vowels of six letters or more."""
    return 1 if kind == SKELETON and length >= 6 else 0


@dataclass(frozen=True)
class Hit:
    """A path within its distance of a value: edits, entry, kind of path, path."""

    edits: int
    entry: int
    kind: int
    path: str


class Trie:
    """Labels and aliases by character, as a list of nodes in order of depth first."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        root: dict = {}
        self.labels: list[tuple[str, int]] = []
        for entry, label, others in entries:
            for name in [label, *(others or [])]:
                text = fold(name or "")
                if not text:
                    continue
                self.labels.append((text, entry))
                joined = text.replace(" ", "")
                paths = {(text, LABEL), (joined, LABEL)}
                bare = skeleton(joined)
                if len(bare) >= 3:
                    paths.add((bare, SKELETON))
                words = text.split()
                if len(words) >= 3:
                    paths.add(("".join(w[0] for w in words), INITIALS))
                for path, kind in paths:
                    node = root
                    for c in path:
                        node = node.setdefault(c, {})
                    node.setdefault("", set()).add((entry, kind))
        # (depth, character, last character of the path before it, ends here, node behind the branch)
        self.nodes: list[tuple[int, str, str, list[tuple[int, int]], str]] = []
        self.after: list[int] = []
        stack = [(root, 0, "", "", "")]
        while stack:
            node, depth, c, before, path = stack.pop()
            self.nodes.append((depth, c, before, sorted(node.get("", ())), path))
            stack.extend((child, depth + 1, x, c, path + x) for x, child in node.items() if x)
        self.after = [len(self.nodes)] * len(self.nodes)
        open_: list[int] = []
        for i, (depth, *_) in enumerate(self.nodes):
            while open_ and self.nodes[open_[-1]][0] >= depth:
                self.after[open_.pop()] = i
            open_.append(i)

    def search(self, values: list[str], most: list[int]) -> list[list[Hit]]:
        """Of every value, all paths within ``most`` edits of it and within the edits allowed for their kind and length."""
        found: list[list[Hit]] = [[] for _ in values]
        if not values:
            return found
        lengths = np.array([len(v) for v in values])
        # values far longer than any path are within no distance of one
        deepest = max(depth for depth, *_ in self.nodes)
        usable = np.flatnonzero(lengths <= deepest + np.array(most))
        if not len(usable):
            return found
        n, limits = lengths[usable], np.array(most)[usable]
        width = int(n.max())
        code = np.zeros((len(usable), width + 1), np.int32)
        for k, i in enumerate(usable.tolist()):
            code[k, 1 : n[k] + 1] = np.frombuffer(values[i].encode("utf-32-le", "surrogatepass"), np.int32)
        steps = np.arange(width + 1, dtype=np.int16)
        outside = steps[None, :] > n[:, None]
        first = np.where(outside, np.int16(30_000), steps[None, :])
        # of each depth of the path walked: the values still alive, and their rows
        alive: list[np.ndarray] = [np.arange(len(usable))]
        rows: list[np.ndarray] = [first]
        i = 0
        while i < len(self.nodes):
            depth, c, before, ends, path = self.nodes[i]
            if depth:
                del alive[depth:], rows[depth:]
                who, above = alive[depth - 1], rows[depth - 1]
                letters = code[who]
                same = letters == ord(c)
                new = above + 1
                np.minimum(new[:, 1:], above[:, :-1] + ~same[:, 1:], out=new[:, 1:])
                if depth > 1:
                    # a swap: this letter before the last one, as the path has them the other way round
                    swap = np.zeros_like(same)
                    swap[:, 2:] = same[:, 1:-1] & (letters[:, 2:] == ord(before))
                    place, at = np.nonzero(swap)
                    older = rows[depth - 2][np.searchsorted(alive[depth - 2], who[place]), at - 2]
                    new[place, at] = np.minimum(new[place, at], older + 1)
                # insertions: the least of all that lies before, plus the way from there
                new = np.minimum.accumulate(new - steps, axis=1) + steps
                new[outside[who]] = 30_000
                going = new.min(axis=1) <= limits[who]
                if not going.any():
                    i = self.after[i]
                    continue
                alive.append(who[going])
                rows.append(new[going])
            for entry, kind in ends:
                who, last = alive[depth], rows[depth][np.arange(len(alive[depth])), n[alive[depth]]]
                for k, d in zip(who[last <= limits[who]].tolist(), last[last <= limits[who]].tolist()):
                    shorter = min(int(n[k]), depth)
                    if d <= (limit(shorter) if kind == LABEL else alias_limit(kind, shorter)):
                        found[usable[k]].append(Hit(d, entry, kind, path))
            i += 1
        return found


def readings(value: str) -> list[str]:
    """The value without what is written around it, in the ways it may be read."""
    text = unicodedata.normalize("NFKC", value).casefold().replace("’", "'").strip()
    while True:
        was = text
        text = text.strip(" \t\r\n\"'“”«»()[]?!;:*…")
        for x in BEFORE:
            text = text.removeprefix(x)
        for x in AFTER:
            text = text.removesuffix(x)
        if text.endswith("(probably"):
            text = text.removesuffix("(probably")
        if text == was:
            break
    out = [text]
    if text.count(",") == 1:
        a, b = text.split(",")
        out.append(f"{b.strip()} {a.strip()}")
    # a remark behind a dash
    if " - " in text:
        out.append(text.split(" - ")[0])
    return [x for x in out if x.strip()]


def forms_of(text: str) -> tuple[str, str, str]:
    """A reading folded, with signs read as letters, and without blanks."""
    plain = fold(text)
    return plain, plain.translate(LOOKALIKES), plain.replace(" ", "")


def all_hits(trie: Trie, values: list[str]) -> list[list[tuple[str, list[list[Hit]]]]]:
    """Of every value and each of its readings, the hits of its three forms."""
    asked: dict[str, int] = {}
    read = []
    for v in values:
        mine = []
        for text in readings(v):
            forms = forms_of(text)
            if forms[0]:
                mine.append((text, [asked.setdefault(f, len(asked)) for f in (*forms, forms[1].replace(" ", ""))]))
        read.append(mine)
    hits = trie.search(list(asked), [limit(len(f)) for f in asked])
    return [[(text, [hits[i] for i in which]) for text, which in mine] for mine in read]


def resolve(trie: Trie, values: list[str]) -> list[tuple[int, int]]:
    """(entry, edits) of typed values, (0, -1) of those that mean none.

    Exact labels come first, then initials and words without vowels, then labels cut off at a full stop, then the nearest
    label within the distance allowed. Of several entries equally near, one with the same first letter, then of nearer
    length, then the smaller id is taken. An alias that stands for several entries means none of them.
    """
    out = []
    for mine in all_hits(trie, values):
        best: tuple | None = None
        sure: tuple[int, int] | None = None
        for text, forms in mine:
            plain = fold(text)
            joined = plain.replace(" ", "")
            exact = sorted({h.entry for hits in forms for h in hits if not h.edits and h.kind == LABEL})
            if exact:
                sure = exact[0], 0
                break
            bare = not VOWELS & set(joined[1:])
            for kind in (INITIALS, SKELETON):
                alias = [h for h in forms[2] if h.kind == kind and (kind == INITIALS or bare)]
                low = min((h.edits for h in alias), default=0)
                meant = {h.entry for h in alias if h.edits == low}
                if len(meant) == 1:
                    sure = meant.pop(), low
                    break
            if sure is None and text.rstrip().endswith(".") and len(joined) >= 3:
                cut_off = {e for label, e in trie.labels if label.startswith(plain)}
                if len(cut_off) == 1:
                    sure = cut_off.pop(), 0
            if sure is not None:
                break
            for f, hits in zip((plain, plain.translate(LOOKALIKES), joined), forms):
                for h in hits:
                    if h.kind == LABEL:
                        rank = (h.edits, h.path[0] != f[0], abs(len(h.path) - len(f)), h.entry)
                        if best is None or rank < best:
                            best = rank
        out.append(sure or ((best[3], best[0]) if best else (0, -1)))
    return out


def near_entries(trie: Trie, values: list[str]) -> list[list[tuple[int, int]]]:
    """(entry, edits) of all entries within the distance of each value, the nearest reading of each."""
    out = []
    for mine in all_hits(trie, values):
        least: dict[int, int] = {}
        for text, forms in mine:
            bare = not VOWELS & set(fold(text).replace(" ", "")[1:])
            for hits in forms:
                for h in hits:
                    if h.kind != SKELETON or bare:
                        least[h.entry] = min(h.edits, least.get(h.entry, h.edits))
        out.append(sorted(least.items()))
    return out


def _by_kind(entries: DataFrame, most_entries: int) -> dict:
    rows = entries.select("entry_id", "entry_kind", "entry_label", "other_labels").where("entry_id is not null").limit(most_entries + 1).collect()
    if len(rows) > most_entries:
        raise ValueError(f"more than {most_entries} entries")
    by_kind: dict = {}
    for r in sorted(rows, key=lambda r: (r[0], str(r[2]))):
        for k in {r[1], None}:
            by_kind.setdefault(k, []).append((r[0], r[2], [x for x in (r[3] or []) if x]))
    return by_kind


def _search(picked: DataFrame, n: int, by_kind: dict, with_kind: bool, what, types: list[pa.DataType], schema: T.StructType) -> DataFrame:
    """The first n columns of picked, then what(trie, values) of the kind and value behind them, one search per distinct value
    of a batch."""
    extra = schema.fieldNames()[n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict = {}
        memory: dict = {}
        for batch in batches:
            if len(memory) > 500_000:
                memory.clear()
            asked = list(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()))
            fresh: dict = {}
            for k, v in dict.fromkeys(asked):
                if (k, v) not in memory:
                    fresh.setdefault(k if with_kind else None, []).append((k, v))
            for kind, values in fresh.items():
                if kind not in tries:
                    # a row without a kind is looked up in no list
                    tries[kind] = Trie(by_kind.get(kind, []) if kind is not None or not with_kind else [])
                for s in range(0, len(values), 4096):
                    part = values[s : s + 4096]
                    memory.update(zip(part, what(tries[kind], [v for _, v in part])))
            got = list(zip(*(memory[a] for a in asked))) or [()] * len(extra)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, t) for c, t in zip(got, types))], names=schema.fieldNames())

    return picked.mapInArrow(run, schema)


def _picked(df: DataFrame, value: str, kind: str | None, keep: list[str]) -> DataFrame:
    picked = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], (F.col(f"`{kind}`").cast("string") if kind else F.lit("")).alias("kind"), F.col(f"`{value}`").cast("string").alias("value"))
    return picked.where(F.col("value").rlike(r"\S"))


def resolved_values(df: DataFrame, value: str, entries: DataFrame, kind: str | None = None, most_entries: int = 200_000) -> DataFrame:
    """(kind, value, n, entry_id, edits, spelling): every distinct value once, with how many rows have it; written."""
    counts = _picked(df, value, kind, []).groupBy("kind", "value").agg(F.count("*").alias("n"))
    rows = counts.select("kind", "value", "n", F.col("kind").alias("k"), F.col("value").alias("v"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("entry_id", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("spelling", T.StringType())])
    what = lambda trie, values: [(*r, fold(v)) for r, v in zip(resolve(trie, values), values)]
    return cut(_search(rows, 3, _by_kind(entries, most_entries), kind is not None, what, [pa.int64(), pa.int32(), pa.string()], schema))


def own_words(resolved: DataFrame, least: int = OWN_WORD, share: float = OWN_SHARE) -> DataFrame:
    """(kind, spelling): spellings that are words of their own by how often they are met, though near a label.

    All rows count, each once for every time it is there: a spelling's count is compared with that of the most frequent
    spelling of its entry without errors."""
    spelled = resolved.where("entry_id > 0").groupBy("kind", "entry_id", "spelling").agg(F.sum("n").alias("n"), F.max("edits").alias("edits"))
    right = spelled.where("edits = 0").groupBy("kind", "entry_id").agg(F.max("n").alias("right"))
    often = spelled.where(f"edits > 0 and n >= {int(least)}").join(right, ["kind", "entry_id"], "left")
    return often.where(F.col("n") >= F.lit(share) * F.coalesce("right", F.lit(0))).select("kind", "spelling").distinct()


def map_values(df: DataFrame, value: str, entries: DataFrame, kind: str | None = None, keep: list[str] | None = None, most_entries: int = 200_000, least: int | None = OWN_WORD, share: float = OWN_SHARE) -> DataFrame:
    """The columns of ``keep`` (all by default), then entry_id and edits of every typed value.

    entries: entry_id, entry_kind, entry_label, other_labels; with ``kind``, a column of df, only entries of that kind are
    looked at. entry_id is 0 where the value means no entry; rows whose value is null or blank are left out. Null labels are
    skipped, an empty list maps everything to 0, repeated rows and entries change nothing but counts. The list is read by the
    driver and sent to the workers; more than ``most_entries`` raise an error.

    Every distinct value is searched once. Its entry goes back to its rows by a join: with all values at once as long as they
    take up no more than SMALL bytes, else with the values that a HEAVY-th of all rows or more have, which are HEAVY at most,
    and with the others by a shuffle without large keys. A value that stands alone (no "my" before it) and is one of
    ``own_words`` means none; ``least`` null leaves that out.
    """
    keep = df.columns if keep is None else keep
    picked = _picked(df, value, kind, keep)
    resolved = resolved_values(df, value, entries, kind, most_entries)
    found = resolved
    if least is not None:
        own = own_words(resolved, least, share).withColumn("own", F.lit(True))
        none = F.coalesce(F.col("own") & (F.col("edits") > 0), F.lit(False))
        found = resolved.join(own, ["kind", "spelling"], "left").withColumn("entry_id", F.when(none, 0).otherwise(F.col("entry_id"))).withColumn("edits", F.when(none, -1).otherwise(F.col("edits")))
    found = found.select(F.col("kind").alias("__kind"), F.col("value").alias("__value"), "n", F.col("entry_id").alias("__e"), F.col("edits").alias("__d"))
    same = F.col("kind").eqNullSafe(F.col("__kind")) & (F.col("value") == F.col("__value"))
    if written_bytes(resolved) <= SMALL:
        out = picked.join(F.broadcast(found), same)
    else:
        rows = resolved.agg(F.sum("n")).first()[0] or 0
        often = found.where(F.col("n") * HEAVY >= rows)
        with_heavy = picked.join(F.broadcast(often), same, "left")
        out = with_heavy.where("__e is not null").unionByName(with_heavy.where("__e is null").select(picked.columns).join(found, same))
    return out.select(*picked.columns[: len(keep)], "__e", "__d").toDF(*keep, "entry_id", "edits")


def candidates(df: DataFrame, value: str, entries: DataFrame, kind: str | None = None, keep: list[str] | None = None, most_entries: int = 200_000) -> DataFrame:
    """The columns of ``keep`` (all by default), then entry_id and edits: one row for every entry within the distance allowed
    for its labels and aliases; values near none have no row. Nulls and repeats as in ``map_values``."""
    keep = df.columns if keep is None else keep
    n = len(keep)
    picked = _picked(df, value, kind, keep)
    pair = T.ArrayType(T.StructType([T.StructField("e", T.LongType()), T.StructField("d", T.IntegerType())]))
    schema = T.StructType([*picked.schema.fields[:n], T.StructField("near", pair)])
    what = lambda trie, values: [([{"e": e, "d": d} for e, d in near],) for near in near_entries(trie, values)]
    found = _search(picked, n, _by_kind(entries, most_entries), kind is not None, what, [pa.list_(pa.struct([("e", pa.int64()), ("d", pa.int32())]))], schema)
    return found.select(*picked.columns[:n], F.explode("near").alias("x")).select(*picked.columns[:n], "x.e", "x.d").toDF(*keep, "entry_id", "edits")


def typed_relations(predicted: DataFrame, targets: DataFrame) -> DataFrame:
    """from_table, row_id, field_name, kind, value of all typed relations and categories."""
    one = lambda df, name, field, kind: df.select(F.lit(name).alias("from_table"), "row_id", F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), F.col(field).alias("value"))
    return (
        one(predicted, "predicted_persons", "relation_to_owner", "relation")
        .unionByName(one(predicted, "predicted_persons", "relation_category", "category"))
        .unionByName(one(targets, "target_persons", "relation", "relation"))
    )
