import itertools
import random

import pytest
from pyspark.sql import functions as F

from facetrail.llm import canon, metricjoin
from facetrail.llm.canon import Trie, candidates, map_values, resolve
from facetrail.llm.components import components
from facetrail.llm.cooccur import associations, pair_counts
from facetrail.llm.metricjoin import damerau_levenshtein, radius_join
from facetrail.llm.names import linked_records, read, same_person
from facetrail.llm.setjoin import similar_records
from facetrail.llm.topn import best_names, top_n


def test_top_n_with_ties_and_hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", f"i{i:05d}", rng.randrange(20) / 10) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, item string, score double")
    got = {(r.g, r.rank, r.item) for r in top_n(df, ["g"], [F.col("score").desc(), F.col("item")], 5, ["item"], subgroups=4).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        want |= {(g, k + 1, i) for k, (_, i) in enumerate(sorted((-s, i) for h, i, s in rows if h == g)[:5])}
    assert got == want
    with pytest.raises(ValueError):
        top_n(df, ["g"], [F.col("item")], 0, ["item"])


def test_best_names_of_dirty_edges(spark):
    rows = [(1, "u", "f", " Ann ", 0.5), (2, "u", "f", "ann", 0.9), (3, "u", "f", "ANN", 0.9), (4, "u", "f", "Bo", 0.9), (5, "u", "f", None, 0.9), (6, "u", "f", "  ", 0.9), (7, "u", "f", "cy", float("nan")), (8, "u", "f", "cy", 1.1), (9, "u", "f", "dd", None), (10, "u", "f", "z", 1.0), (10, "u", "f", "z", 1.0), (11, "u", "f", "y", 0.0), (12, "u", None, "y", 0.3)]
    df = spark.createDataFrame(rows, "edge_id long, user_id string, face_id string, name_surface string, score double").withColumn("rank", F.lit("clash"))
    got = sorted((str(r.face_id), r["rank"], r.edge_id) for r in best_names(df).collect())
    assert got == [("None", 1, 12), ("f", 1, 10), ("f", 2, 2), ("f", 3, 4)]
    assert best_names(df.where("false")).count() == 0


@pytest.mark.parametrize("chunk", [2, 5, 64])
def test_pair_counts_with_huge_baskets(spark, chunk):
    rng = random.Random(7)
    rows = [("u", f"p{rng.randrange(12)}", [rng.choice([f"i{rng.randrange(15):02d}", None]) for _ in range(rng.randrange(5))]) for _ in range(80)]
    rows += [("u", "big", [f"i{k:02d}" for k in range(15)]), ("v", "p0", ["x", "y", "x"]), ("u", None, ["a", "b"]), (None, "p", ["a", "b"]), ("u", "none", None), ("u", "empty", [])]
    df = spark.createDataFrame(rows, "g string, k string, items array<string>")
    baskets = {}
    for g, k, items in rows:
        if g and k:
            baskets.setdefault((g, k), set()).update(x for x in items or [] if x)
    want = {}
    for (g, _), items in baskets.items():
        for a, b in itertools.combinations_with_replacement(sorted(items), 2):
            want[g, a, b] = want.get((g, a, b), 0) + 1
    assert {(r.g, r.a, r.b): r.n for r in pair_counts(df, "g", "k", "items", chunk).collect()} == want
    total = {g: sum(1 for (h, _), i in baskets.items() if h == g and i) for g in ("u", "v")}
    found = {(r.g, r.item_a, r.item_b) for r in associations(df, "g", "k", "items", 2, 1.2, chunk).collect()}
    assert found == {(g, a, b) for (g, a, b), n in want.items() if a < b and n >= 2 and n * total[g] >= 1.2 * want[g, a, a] * want[g, b, b]}
    assert associations(df.where("false"), "g", "k", "items").count() == 0


ENTRIES = [(1, "relation", "brother", ["bro"]), (2, "relation", "mother-in-law", []), (3, "relation", "great-uncle", None), (4, "relation", "fiancé", []), (5, "category", "family", ["kin"]), (6, "relation", "next-door neighbor", [])]


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def paths_of(entries):
    """(path, kind, entry): labels with and without blanks, words without vowels, initials."""
    out = set()
    for e, _, label, others in entries:
        for text in {canon.fold(x) for x in [label, *(others or [])] if x}:
            joined = text.replace(" ", "")
            out |= {(text, canon.LABEL, e), (joined, canon.LABEL, e)}
            if len(canon.skeleton(joined)) >= 3:
                out.add((canon.skeleton(joined), canon.SKELETON, e))
            if text.count(" ") >= 2:
                out.add(("".join(w[0] for w in text.split()), canon.INITIALS, e))
    return out


def test_trie_finds_what_a_plain_search_finds():
    trie = Trie([(e, a, b or []) for e, _, a, b in ENTRIES])
    rng = random.Random(3)
    paths = paths_of(ENTRIES)
    words = ["", "b", "x" * 500]
    for _ in range(300):
        word = list(rng.choice(sorted(p for p, _, _ in paths)))
        for _ in range(rng.randrange(4)):
            word.insert(rng.randrange(len(word) + 1), rng.choice("abcre "))
            word.pop(rng.randrange(len(word)))
        if rng.random() < 0.5 and len(word) > 1:
            k = rng.randrange(len(word) - 1)
            word[k], word[k + 1] = word[k + 1], word[k]
        words.append("".join(word))
    for w, hits in zip(words, trie.search(words, [3] * len(words))):
        allowed = lambda p, k: min(3, canon.limit(min(len(w), len(p))) if k == canon.LABEL else canon.alias_limit(k, min(len(w), len(p))))
        want = {(osa(w, p), e, k, p) for p, k, e in paths if abs(len(p) - len(w)) <= 3 and osa(w, p) <= allowed(p, k)}
        assert {(h.edits, h.entry, h.kind, h.path) for h in hits} == want


def test_all_entries_within_the_distance(spark):
    values = ["brother", "Borther", "mother in law", "grt-ncl", "MIL", "fiancee", "bro", "far from all", "", None, "  ", "in-law, mother"]
    df = spark.createDataFrame([(i, v, "relation") for i, v in enumerate(values)], "row_id long, value string, kind string")
    entries = spark.createDataFrame(ENTRIES, "entry_id long, entry_kind string, entry_label string, other_labels array<string>")
    paths = paths_of([e for e in ENTRIES if e[1] == "relation"])
    want = set()
    for i, v in enumerate(values):
        for text in canon.readings(v or ""):
            plain = canon.fold(text)
            bare = not canon.VOWELS & set(plain.replace(" ", "")[1:])
            for w in {plain, plain.replace(" ", ""), plain.translate(canon.LOOKALIKES)}:
                for p, k, e in paths:
                    most = canon.limit(min(len(w), len(p))) if k == canon.LABEL else canon.alias_limit(k, min(len(w), len(p)))
                    if (k != canon.SKELETON or bare) and osa(w, p) <= min(most, canon.limit(len(w))):
                        want.add((i, e, osa(w, p)))
    least = {(i, e): min(d for x, y, d in want if (x, y) == (i, e)) for i, e, _ in want}
    got = {(r.row_id, r.entry_id): r.edits for r in candidates(df, "value", entries, "kind", ["row_id"]).collect()}
    assert got == least and len(got) >= 8
    assert candidates(df.where("false"), "value", entries, "kind").count() == 0


@pytest.mark.parametrize("small", [32 << 20, 0])
def test_frequent_words_near_a_label_are_words_of_their_own(spark, monkeypatch, small):
    monkeypatch.setattr(canon, "SMALL", small)
    monkeypatch.setattr(canon, "HEAVY", 4)
    entries = spark.createDataFrame(ENTRIES, "entry_id long, entry_kind string, entry_label string, other_labels array<string>")
    rows = [("brother", 50), ("bro", 5), ("Bother", 8), ("bother", 4), ("brothr", 3), ("my bother", 1)]
    df = spark.createDataFrame([(v, "relation") for v, n in rows for _ in range(n)] + [("brother", None)], "value string, kind string")
    every = map_values(df, "value", entries, "kind").collect()
    assert len(every) == df.count() and [r.entry_id for r in every if r.kind is None] == [0]
    got = {(r.value, r.entry_id) for r in every if r.kind}
    assert got == {("brother", 1), ("bro", 1), ("Bother", 0), ("bother", 0), ("brothr", 1), ("my bother", 1)}
    assert {r.entry_id for r in map_values(df.where("kind is not null"), "value", entries, "kind", least=None).collect()} == {1}


def test_typed_values(spark):
    typed = {
        "brother": 1, " Borther ": 1, "BRO": 1, "my brothr": 1, "(brother)": 1, "owner's brother": 1, "brother of the owner": 1, "in-law, mother": 2, "MIL": 2, "mother in law": 2, "motherinlaw": 2, "grt-ncl": 3, "great_uncle?": 3,
        "fiance": 4, "next-do.": 6, "brother - seen at the lake": 1, "my bother": 1, "a long phrase about nobody": 0, "???": 0, "family": 0,
    }
    df = spark.createDataFrame([(i, v, "relation", "x") for i, v in enumerate([*typed, None, "", "  "])], "row_id long, value string, kind string, entry_id string")
    entries = spark.createDataFrame([*ENTRIES, (9, "relation", None, None)], "entry_id long, entry_kind string, entry_label string, other_labels array<string>")
    got = {r.row_id: r.entry_id for r in map_values(df, "value", entries, "kind", ["row_id"]).collect()}
    assert got == dict(enumerate(typed.values()))
    assert {r.entry_id for r in map_values(df, "value", entries.where("false"), "kind", ["row_id"]).collect()} == {0}
    assert map_values(df.where("false"), "value", entries, "kind", ["row_id"]).count() == 0
    assert resolve(Trie([]), ["x" * 5000, ""]) == [(0, -1), (0, -1)]


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_similar_sets_equal_all_pairs(spark, threshold):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        base = [f"t{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))]
        for k in range(rng.randrange(1, 4)):
            rows.append((f"e{i:03d}_{k}", [*base[: max(1, len(base) - k)], *([" T1 "] if k == 2 else []), None, ""], ["x"] if k else None))
    rows += [rows[0], ("nul", None, None), (None, ["a", "b"], None), ("blank", ["", " "], [])]
    df = spark.createDataFrame(rows, "id string, a array<string>, b array<string>").withColumn("items", F.lit("clash"))
    sets = {k: {x.strip().lower() for x in [*(a or []), *(b or [])] if x and x.strip()} for k, a, b in rows if k}
    want = {(a, b) for a, b in itertools.combinations(sorted(k for k in sets if len(sets[k]) >= 2), 2) if 10 * len(sets[a] & sets[b]) >= round(10 * threshold) * len(sets[a] | sets[b])}
    got = [(r.id_a, r.id_b) for r in similar_records(df, "id", ["a", "b"], threshold, 2).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert similar_records(df.where("false"), "id", ["a", "b"], threshold).count() == 0


def test_metric():
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(40)]
    for a, b, c in itertools.product(words[:14], repeat=3):
        assert damerau_levenshtein(a, c) <= damerau_levenshtein(a, b) + damerau_levenshtein(b, c)
    assert damerau_levenshtein("ca", "abc") == 2 and damerau_levenshtein("ab", "ba") == 1 and damerau_levenshtein("", "abc") == 3


def pairs_of(names, radius):
    dl = damerau_levenshtein
    return {(*a, *b, dl(a[0], b[0]) + dl(a[1], b[1])) for a, b in itertools.combinations(sorted(names), 2) if abs(len(a[1]) - len(b[1])) <= radius and dl(a[0], b[0]) + dl(a[1], b[1]) <= radius}


@pytest.mark.parametrize("block,coarse", [(1024, 256), (32, 8), (16, 2)])
def test_radius_join_in_cells_equals_all_pairs(spark, monkeypatch, block, coarse):
    from facetrail.llm import metricjoin

    monkeypatch.setattr(metricjoin, "BLOCK", block)
    monkeypatch.setattr(metricjoin, "COARSE", coarse)
    monkeypatch.setattr(metricjoin, "LEVELS", 2)
    rng = random.Random(6)
    names = set()
    while len(names) < 250:
        g, f = rng.choice(["anna", "anne", "robert", "rupert", "мария"]), "".join(rng.choice("abc") for _ in range(6))
        names |= {(g, f), (g[:-1], f), (g, f[1:] + "x")}
    # names around and beyond the length from which they go by shells
    for n in (38, 40, 41, 42, 60, 61):
        names |= {("margaret", "ab" * (n // 2)), ("margaret", "ab" * (n // 2) + "c"), ("margarte", "ab" * (n // 2)), ("margaret", "ba" + "ab" * (n // 2 - 1))}
    rows = [("s", g, f) for g, f in names] + [("t", "anna", "aaa"), ("t", "anna", "aab"), ("u", "zoe", "q")]
    got = {(r.cell, r.g1, r.f1, r.g2, r.f2, r.dg + r.df) for r in radius_join(spark.createDataFrame(rows, "cell string, given string, family string"), 2).collect()}
    assert got == {("s", *p) for p in pairs_of(names, 2)} | {("t", "anna", "aaa", "anna", "aab", 1)}


def test_every_name_goes_through_a_cell(spark):
    from facetrail.llm.metricjoin import PIVOTS, cell_counts

    rng = random.Random(2)
    rows = [("s", rng.choice(["anna", "robert", "maria"]), "".join(rng.choice("abcdefgh") for _ in range(7))) for _ in range(400)] + [("one", "zoe", "q")]
    got = {r.cell: r for r in cell_counts(spark.createDataFrame(rows, "cell string, given string, family string").distinct(), 2).collect()}
    n = len({r for r in rows if r[0] == "s"})
    assert got["s"].names == n and n / PIVOTS / 2 < got["s"].pivots < n / PIVOTS * 2 and got["one"].names == got["one"].pivots == 1


def test_bounded_distances():
    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(60)]
    for a, b in itertools.product(words[:30], words[30:]):
        d = damerau_levenshtein(a, b)
        assert all((metricjoin.bounded(a, b, k) == d) if d <= k else (metricjoin.bounded(a, b, k) > k) for k in (0, 1, 2, 4))
    long = "ab" * 20_000
    assert metricjoin.bounded(long, long[:100] + "x" + long[101:], 2) == 1 and metricjoin.bounded(long, long[::-1], 2) <= 2


@pytest.mark.parametrize("local", [200_000, 7])
def test_components(spark, local):
    rng = random.Random(8)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [(f"m{rng.randrange(50):02d}", f"m{rng.randrange(50):02d}") for _ in range(40)] + [("z", "z"), (None, "a")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: min(y for y in parent if find(y) == find(x)) for x in parent}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string"), local=local).collect()} == want
    named = [(a[0], a, b) for a, b in edges if a and b]
    assert {r.node: r.root for r in components(spark.createDataFrame(named, "g string, u string, v string"), "g", local).collect()} == want
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_reading_of_names():
    same = {read(s) for s in ("Anthony Ostmund", "Ostmund, Tony", "the Ostmunds' Anthony", "ANTHONY OSTMUND", "Anthony Ost mund", "AnthonyOstmund", 'Anthony "Tony" Ostmund', "Mr. Anthony B. Ostmund", "Ostmund (Anthony)", "Anthony  Ostmund-Galvane", "Dr. Tony Ostmund")}
    assert same == {("F", "anthony", "ostmund", "")}
    assert read("Ostmund A.") == read("a.ostmund") == read("A.B. Ostmund") == ("I", "a", "ostmund", "")
    assert read("Dr. Ostmund") == ("L", "", "ostmund", "") and read("Uncle Tony") == ("G", "anthony", "", "") and read("Ostmund, Anthony III")[3] == "iii"
    assert read(None) is None and read("  ") is None and read("?!") is None
    assert read("x" * 10_000)[0] == "G"
    assert read("Иван Петров") == ("F", "иван", "петров", "") == read("Петров, Иван") and read("И. Петров")[0] == "I" and read("Γιώργος Παππάς") == ("F", "γιωργος", "παππας", "")
    assert read("王小明") == ("F", "小明", "王", "") and read("王 小明")[0] == "F" and read("محمد علي")[0] == "F"


CLUSTERS = "user_id string, cluster_id string, surfaces array<string>, primary_surface string, first_name string, last_name_candidates map<string,int>, quality_flags array<string>, person string"
PERSONS = "user_id string, person_id string, canonical_name string, accepted_aliases array<string>, rec string"


def test_linked_records(spark):
    c = [
        ("u", "c1", ["Anthony Ostmund", None], "Anthony Ostmund", None, {"Ostmund": 1}, None, "x"), ("u", "c1", ["Anthony Ostmund", None], "Anthony Ostmund", None, {"Ostmund": 1}, None, "x"), ("u", "c2", ["Tony Ostmudn"], "Tony Ostmudn", "Anthony", None, [], "x"),
        ("u", "c3", ["A. Ostmund"], "A. Ostmund", None, None, [], "x"), ("u", "c4", ["Anthony III Ostmund"], "Anthony III Ostmund", None, None, [], "x"), ("u", "c5", ["Gate B"], "Gate B", "Gate", None, ["ocr_like"], "x"), ("u", "c6", ["Gate B"], "Gate B", "Gate", None, ["ocr_like"], "x"),
        ("v", "c7", ["Anthony Ostmund"], "Anthony Ostmund", None, None, [], "x"), ("u", "c8", None, None, None, None, None, "x"), ("u", "c9", ["Ann Ostmund", ""], "Ann Ostmund", None, None, [], "x"), (None, "c10", ["Ann Ostmund"], None, None, None, None, "x"),
    ]
    p = [("u", "p1", "Anthony Ostmund", ["", None, "the Ostmunds' Tony"], "x"), ("u", "p2", "Ann Ostmund", None, "x"), ("u", "p3", None, None, "x")]
    clusters, persons = spark.createDataFrame(c, CLUSTERS), spark.createDataFrame(p, PERSONS)
    got = {(r.rec_a, r.rec_b) for r in linked_records(clusters, persons).collect()}
    # "A. Ostmund" may be Anthony or Ann, so it stays alone
    assert got == {("c1", "c2"), ("c1", "p1"), ("c2", "p1"), ("c9", "p2")}
    who = {r.rec: r.person for r in same_person(clusters, persons).collect()}
    assert set(who) == {"c1", "c2", "c3", "c4", "c7", "c8", "c9", "p1", "p2", "p3"} and who["c3"] == "c3"
    tied = {(r.rec_a, r.rec_b) for r in linked_records(clusters.where("cluster_id <> 'c9'"), persons.where("person_id <> 'p2'")).collect()}
    assert ("c1", "c3") in tied
    assert linked_records(clusters.where("false"), persons.where("false")).count() == 0


def test_surfaces_of_texts_get_persons(spark):
    clusters = spark.createDataFrame([("u", "c1", ["Anthony Ostmund"], "Anthony Ostmund", None, {"Ostmund": 1}, None, "x"), ("u", "c2", ["Gate B"], "Gate B", "Gate", None, ["ocr_like"], "x")], CLUSTERS)
    persons = spark.createDataFrame([("u", "p1", "Ann Kelwick", None, "x")], PERSONS)
    units = spark.createDataFrame([("u", ["Tony Ostmund", "Gate B", None, " "]), ("u", ["Tony Ostmund", "Kelwick, Ann"]), ("v", ["Tony Ostmund"]), ("u", None)], "user_id string, person_surfaces array<string>")
    got = {(r.user_id, r.rec): r.person for r in same_person(clusters, persons, units).collect() if r.rec.startswith("~")}
    assert got == {("u", "~Tony Ostmund"): "c1", ("u", "~Kelwick, Ann"): "p1", ("v", "~Tony Ostmund"): "~Tony Ostmund"}
