import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetrail.llm import bpe, splitting
from facetrail.llm.mixing import hierarchical_budgets, mix_sources
from facetrail.llm.splitting import boundaries, cut_positions, split_texts
from facetrail.llm.tokens import count_tokens, decode_corpus, encode_corpus, vocabulary_path

tiktoken = pytest.importorskip("tiktoken")
SIGNS = " '\n\t\r abst1é,.-llreved漢🙂　\"?!ß'"


@pytest.fixture(scope="module", params=["byte_bpe_50k", "byte_bpe_multi_50k"])
def pair(request):
    import base64

    import public_tokenizers as P

    path = vocabulary_path(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.load(path), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(coder, texts):
    e = coder.texts(pa.array(texts, pa.string()))
    ids, t = e.ids(), e.text_token0
    return [ids[a:b].tolist() for a, b in zip(t, t[1:])]


def test_same_ids_as_the_public_library(pair):
    coder, ref = pair
    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["it's we'll 'tis ''s 's's I'M they'RE", "<|endoftext|>", "\x00\x1c\x85", "a" * 5000, "x y" * 700, "漢字" * 500, " " * 300, "\n" * 99 + "z", "", None]
    assert ids_of(coder, texts) == [ref.encode_ordinary(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_texts(texts):
    coder = bpe.load(vocabulary_path())
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    out = ids_of(coder, texts)
    assert [coder.decode(i).decode() for i in out] == texts
    for t, i in zip(texts, out):
        assert ids_of(coder, [t]) == [i]


def test_long_words_take_linear_time(pair):
    coder, ref = pair
    word = "".join(random.Random(1).choice("abcde") for _ in range(200_000))
    assert len(coder.word(word.encode())) > 1000
    assert list(coder.word(word[:3000].encode())) == ref.encode_ordinary(word[:3000])


def test_corpus_round_trip_of_odd_rows(spark):
    rows = [(1, "one two", "x"), (2, "", "x"), (3, None, None), (None, "no key", "x"), (1, "one two", "x"), (4, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = encode_corpus(df)
    assert enc.columns == ["doc_id", "ids"] and enc.count() == 6
    assert {r.doc_id: r.ids for r in enc.collect() if r.doc_id in (2, 3)} == {2: [], 3: []}
    back = sorted(((r.doc_id, r.text) for r in decode_corpus(enc).collect()), key=repr)
    assert back == sorted(((k, t or "") for k, t, _ in rows), key=repr)
    assert encode_corpus(df.where("false")).count() == 0
    assert {(r.doc_id, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()} == {(r.doc_id, len(r.ids)) for r in enc.collect()}


def one_by_one(total, strength, legal, whole, most, overlap):
    """Greedy cuts of one text, step by step."""
    ok = lambda k: k in (0, total) or legal[k]
    level = lambda k: 0 if k in (0, total) or not legal[k] else strength[k]
    out, start, at = [], 0, 0
    while True:
        if at:
            start = max(at - overlap, 0)
            while not ok(start):
                start -= 1
        end = min(start + most, total)
        if end >= total:
            return [*out, (start, total)]
        options = [[k for k in range(max(at, start + most // 2) + 1, end + 1) if level(k) >= n] for n in (3, 2, 1)]
        options += [[k for k in range(at + 1, end + 1) if level(k) >= 1], [k for k in range(at + 1, end + 1) if ok(k)]]
        cut = next((o[-1] for o in options if o), None)
        if cut is None:
            start, cut = at, [k for k in range(at + 1, min(at + most, total) + 1) if k == total or whole[k]][-1]
        out.append((start, cut))
        at = cut
        if at == total:
            return out


@pytest.mark.parametrize("most,overlap", [(7, 6), (5, 0), (4, 3), (20, 5), (64, 8)])
def test_pointer_doubling_gives_the_greedy_cuts(most, overlap):
    rng = random.Random(most)
    coder = bpe.load(vocabulary_path())
    words = ["alpha", "beta.", "gamma", "delta!\n", "\n\n", "it's", "漢字漢字", "🙂🙂", "x" * 30, "  ", "''a", "'" * 40, "🙂's", "𐍈𐍈𐍈"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(60)]
    enc = coder.texts(pa.array(texts))
    strength, legal, whole, at = boundaries(enc)
    of, a, b = cut_positions(enc.text_token0, strength, legal, whole, most, overlap)
    assert (b - a).max() <= most
    counts = enc.counts()
    assert set(of.tolist()) == {i for i, n in enumerate(counts) if n > most}
    for i in set(of.tolist()):
        t0 = int(enc.text_token0[i])
        n = int(counts[i])
        want = one_by_one(n, *(x[t0 : t0 + n + 1] for x in (strength, legal, whole)), most, overlap)
        m = of == i
        assert list(zip(a[m].tolist(), b[m].tolist())) == want


def test_pieces_are_within_the_limit_and_make_up_the_text(spark):
    rng = random.Random(9)
    texts = ["First one. Second one is longer!\n\nA paragraph follows, it's here. " * 9, "z" * 900, "short", "", None, "漢字" * 200 + ". " + "a b " * 80]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, piece string")
    sets = spark.createDataFrame([(1, 40, 8), (2, 25, 0), (2, 25, 0), (3, None, 5), (4, 0, 0), (5, 10, 50)], "setting_id int, max_tokens int, overlap_tokens int")
    coder = bpe.load(vocabulary_path())
    got = {}
    for r in split_texts(df, sets).collect():
        got.setdefault((r.setting_id, r.doc_id), []).append(r)
    assert {k[0] for k in got} == {1, 2, 5} and {k[1] for k in got} == {0, 1, 5}
    for (s, d), pieces in got.items():
        pieces.sort(key=lambda r: r.piece_no)
        most, overlap = {1: (40, 8), 2: (25, 0), 5: (10, 9)}[s]
        assert [p.piece_no for p in pieces] == list(range(len(pieces)))
        ids = ids_of(coder, [texts[d]])[0]
        for k, p in enumerate(pieces):
            assert p.n_tokens == p.end_token - p.first_token and len(ids_of(coder, [p.piece])[0]) <= p.n_tokens
            assert p.n_tokens <= most
            assert coder.decode(ids[p.first_token : p.end_token]).decode() == p.piece
            if k:
                assert overlap <= p.overlap_tokens <= overlap + 3 or p.first_token == 0 or s == 5
        assert pieces[0].first_token == 0 and pieces[-1].end_token == len(ids)
    assert any(p.boundary == "paragraph" for p in got[1, 0])
    with pytest.raises(ValueError):
        split_texts(df, spark.createDataFrame([(1, 3, 0)], "setting_id int, max_tokens int, overlap_tokens int"))
    assert split_texts(df.where("false"), sets).count() == 0 and split_texts(df, sets.where("false")).count() == 0


def test_budgets_go_to_siblings_before_ancestors():
    leaves = [("a/x", 0.25, 10.0), ("a/y", 0.25, 1000.0), ("b/z", 0.5, 1000.0), ("b/none", 0.0, 500.0)]
    got = hierarchical_budgets(leaves, 100.0)
    assert got == pytest.approx({"a/x": 10, "a/y": 40, "b/z": 50, "b/none": 0})
    got = hierarchical_budgets([("a/x", 0.25, 10.0), ("a/y", 0.25, 20.0), ("b/z", 0.5, 1000.0)], 100.0)
    assert got == pytest.approx({"a/x": 10, "a/y": 20, "b/z": 70})
    assert sum(hierarchical_budgets([("a", 0.5, 3.0), ("b", 0.5, 4.0)], 100.0).values()) == 7


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 30), rng.choice(["A", "a ", "b", "c-d", None])) for i in range(600)]
    rows += [(0, rows[0][1], rows[0][2]), (700, None, "b"), (701, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([(1, "a", 0.5, 2, 0.5), (1, "b", 0.3, 2, 0.5), (1, "nothing", 0.2, 2, 0.5), (2, "c_d", 0.9, 3, 1.2), (2, "a", 0.1, 1, 1.2)], "mix_id int, source string, target_share double, max_repeats int, total_ratio double")
    mix, shares, _ = mix_sources(docs, targets, rows_per_bucket=4)
    s = {(r.mix_id, r.source): r for r in shares.collect()}
    m = mix.collect()
    assert len({(r.mix_id, r.doc_id) for r in m}) == len(m)
    caps = {1: {"a": 2, "b": 2}, 2: {"c_d": 3, "a": 1}}
    assert all(1 <= r.copies <= caps[r.mix_id][r.source] for r in m)
    for key, r in s.items():
        own = [x for x in m if (x.mix_id, x.source) == key]
        assert r.actual_tokens == sum(x.copies * x.n_tokens for x in own) and r.n_docs == len(own)
        assert abs(r.actual_tokens - r.budget_tokens) <= 30
    # the share of the missing source went to the others in proportion
    assert s[1, "nothing"].actual_tokens == 0 and s[1, "a"].actual_share == pytest.approx(0.625, abs=0.02)
    assert s[2, "c_d"].actual_tokens <= 3 * s[2, "c_d"].available_tokens
    again = {(r.mix_id, r.doc_id, r.copies) for r in mix_sources(docs.repartition(7), targets, rows_per_bucket=4)[0].collect()}
    assert again == {(r.mix_id, r.doc_id, r.copies) for r in m}
    empty_mix, empty_shares, _ = mix_sources(docs.where("false"), targets)
    assert empty_mix.count() == 0 and empty_shares.count() == 5


def test_shortages_go_to_other_languages_of_a_source_first(spark):
    rows = [(i, "word " * 20, "a", "de" if i < 10 else ["en", "EN ", "en-US"][i % 3]) for i in range(200)] + [(1000 + i, "word " * 20, "b", None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = spark.createDataFrame([(1, "a", 0.6, 2, 0.9), (1, "b", 0.4, 2, 0.9)], "mix_id int, source string, target_share double, max_repeats int, total_ratio double")
    mix, shares, leaves = mix_sources(docs, targets, rows_per_bucket=16, language_exponent=0.0)
    got = {(r.source, r.lang): r for r in leaves.collect()}
    assert set(got) == {("a", "de"), ("a", "en"), ("b", "und")}
    # half of a's budget would be 54 documents of each language: German has 10, twice each; English takes the rest
    assert got["a", "de"].actual_tokens == 2 * got["a", "de"].available_tokens
    per = {r.source: r for r in shares.collect()}
    assert per["a"].actual_share == pytest.approx(0.6, abs=0.01) and per["a"].actual_tokens == sum(r.actual_tokens for k, r in got.items() if k[0] == "a")
    assert mix.where("source = 'a'").selectExpr("sum(copies * n_tokens)").first()[0] == per["a"].actual_tokens


def test_word_traits():
    assert splitting.word_traits(b"\n\n")[3] == 2 and splitting.word_traits(" end.”".encode())[0] == splitting.SENTENCE
