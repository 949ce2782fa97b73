"""Splitting of oversized texts at natural boundaries by pointer doubling.

Every position between two tokens of a text is a possible end of a piece. Each is joined to its farthest legal successor:
the next piece starts ``overlap`` tokens before it and ends, at most ``max_tokens`` later, at the strongest natural
boundary (paragraph, then sentence or line, then word) of the second half of that reach, else at any natural boundary in
reach, else at the last position that cuts no character. The cuts of all texts of a slice are then the positions reached
from the starts by squaring the successor table: after k rounds every chain of 2^k cuts is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetrail.llm import bpe
from facetrail.llm.tokens import VOCABULARY, vocabulary_path

WORD, SENTENCE, PARAGRAPH = 1, 2, 3
#: The smallest limit: a character takes up to four tokens, and a piece can't hold part of one.
LEAST_LIMIT = 4
#: Signs that end a sentence, and those that may close it.
ENDS, CLOSES = tuple(".!?…。！？"), "\"'”’»)]}"


def word_traits(word: bytes) -> tuple[int, bool, bool, int]:
    """Strength of the boundary after a word, whether white space begins it, whether it is only white space, its lines."""
    text = word.decode("utf-8", "replace")
    bare = text.strip()
    if not bare:
        lines = text.count("\n") + text.count("\r") - text.count("\r\n") + text.count("\u2028") + text.count("\u2029") * 2
        return WORD, True, True, lines
    return (SENTENCE if bare.rstrip(CLOSES).endswith(ENDS) else WORD), text[0].isspace(), False, 0


def boundaries(enc: bpe.Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strength (0..3) and legality of every token position of a slice, whether it cuts no character, and the byte at which
    each token starts."""
    coder = enc.bpe
    ids = enc.ids()
    n = len(ids)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(coder.lengths[ids], out=at[1:])
    traits = [word_traits(w) for w in enc.words]
    after, opens, white, lines = (np.array(x) for x in zip(*traits)) if traits else [np.zeros(0, int)] * 4
    strength = np.zeros(n + 1, np.int8)
    code = enc.code
    if len(code):
        # after word k, before word k + 1: natural if either side is white space
        here = after[code].astype(np.int8)
        gap = white[code].copy()
        gap[:-1] |= opens[code[1:]]
        here[~gap] = 0
        # a white run is one word, or two where its last character stands alone: their lines count together
        breaks = lines[code]
        breaks[1:] += np.where(white[code[1:]] & white[code[:-1]], lines[code[:-1]], 0)
        here = np.where(white[code] & (breaks > 0), np.where(breaks > 1, PARAGRAPH, SENTENCE), here).astype(np.int8)
        # white space after the end of a sentence carries its strength on
        here[1:] = np.where(white[code[1:]] & gap[:-1], np.maximum(here[1:], here[:-1]), here[1:])
        # a word before white space of its own leaves the cut to that white space
        here[:-1] = np.where(white[code[1:]], np.minimum(here[:-1], WORD), here[:-1])
        strength[enc.word_token0[1:]] = here
    data = np.frombuffer(enc.data, np.uint8)
    head = data[np.minimum(at[:-1], max(len(data) - 1, 0))] if n else np.zeros(0, np.uint8)
    legal = np.ones(n + 1, bool)
    legal[:-1] = (head & 0xC0) != 0x80
    whole = legal.copy()
    # inside a word, a piece must not begin with an apostrophe and a letter: alone, it would be read as a contraction
    inside = np.ones(n + 1, bool)
    inside[enc.word_token0] = False
    follows = data[np.minimum(at[:-1] + 1, max(len(data) - 1, 0))] if n else head
    letter = ((follows | 0x20) >= 0x61) & ((follows | 0x20) <= 0x7A)
    legal[:-1] &= ~(inside[:-1] & (head == 0x27) & letter)
    return strength, legal, whole, at


def cut_positions(text_token0: np.ndarray, strength: np.ndarray, legal: np.ndarray, whole: np.ndarray, max_tokens: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, end token) of all pieces of the texts with more than ``max_tokens`` tokens, in order."""
    counts = np.diff(text_token0)
    long = np.flatnonzero(counts > max_tokens)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the positions 0..T of the long texts, laid end to end
    width = counts[long] + 1
    base = np.zeros(len(long) + 1, np.int64)
    np.cumsum(width, out=base[1:])
    source = bpe.spans(text_token0[long], width)
    level, lawful, unbroken = strength[source].copy(), legal[source].copy(), whole[source].copy()
    first, last = np.repeat(base[:-1], width), np.repeat(base[1:] - 1, width)
    where = np.arange(len(source), dtype=np.int64)
    lawful[base[:-1]] = lawful[base[1:] - 1] = unbroken[base[:-1]] = unbroken[base[1:] - 1] = True
    level[base[:-1]] = level[base[1:] - 1] = 0
    level[~lawful] = 0
    upto = lambda mask: np.maximum.accumulate(np.where(mask, where, -1))
    legal_upto = upto(lawful)
    start = np.where(where == first, where, np.maximum(first, legal_upto[np.maximum(where - overlap, first)]))
    limit = np.minimum(start + max_tokens, last)
    half = np.maximum(where, start + max_tokens // 2)
    step = np.full(len(source), -1, np.int64)
    for floor in (half, where):
        for least in (PARAGRAPH, SENTENCE, WORD) if floor is half else (WORD,):
            far = upto(level >= least)[limit]
            step = np.where((step < 0) & (far > floor), far, step)
    hard = legal_upto[limit]
    step = np.where(step < 0, np.where(hard > where, hard, -1), step)
    # no such position in reach, or none beyond the end of the piece before: then the piece starts there, without an overlap,
    # and ends before an apostrophe if need be. A character takes four tokens at most, so within LEAST_LIMIT there is always a
    # position that breaks none
    stuck = step < 0
    start = np.where(stuck, where, start)
    step = np.where(stuck, upto(unbroken)[np.minimum(where + max_tokens, last)], step)
    step = np.where(limit >= last, last, step)
    # pointer doubling
    reached = np.zeros(len(source), bool)
    reached[base[:-1]] = True
    frontier, jump = base[:-1], step
    for _ in range(int(max(width)).bit_length() + 1):
        more = np.unique(jump[np.flatnonzero(reached)])
        more = more[~reached[more]]
        if not len(more):
            break
        reached[more] = True
        jump = jump[jump]
    ends = np.flatnonzero(reached & (where != first))
    text = np.repeat(np.arange(len(long)), width)[ends]
    before = np.empty(len(ends), np.int64)
    before[1:] = ends[:-1]
    fresh = np.ones(len(ends), bool)
    fresh[1:] = text[1:] != text[:-1]
    before[fresh] = base[:-1][text[fresh]]
    return long[text], start[before] - base[text], ends - base[text]


def split_texts(
    df: DataFrame, settings: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, most_settings: int = 1000
) -> DataFrame:
    """Pieces of every text that is longer than ``max_tokens`` of a row of ``settings`` (setting_id, max_tokens, overlap_tokens).

    Result: setting_id, key, piece_no (from 0), first_token, end_token, n_tokens, overlap_tokens (shared with the piece
    before), boundary ('paragraph', 'sentence', 'word', 'none', or 'end' of the text), piece. A piece encoded alone has the
    tokens first_token..end_token of the text, so its size is at most max_tokens (encoded alone it has as many tokens, or fewer
    where white space at its end is read together); pieces with the overlap taken off make up
    the text. Texts within the limit, null and empty ones give no piece. Overlaps are exact in tokens, up to 3 tokens more
    where a cut would break a character, and none where the limit leaves no room for one. Settings with a null or no positive limit are left out, the overlap counts as
    0..max_tokens - 1, repeated settings count once, a limit below LEAST_LIMIT is an error; rows with repeated keys are split each. The settings are a small table,
    read by the driver; more than ``most_settings`` raise an error.
    """
    clean = (
        settings.select("setting_id", F.col("max_tokens").cast("int"), F.col("overlap_tokens").cast("int"))
        .where("max_tokens > 0").fillna(0, ["overlap_tokens"]).distinct().limit(most_settings + 1).collect()
    )
    if len(clean) > most_settings:
        raise ValueError(f"more than {most_settings} settings")
    if any(r[1] < LEAST_LIMIT for r in clean):
        raise ValueError(f"a piece can't be held to fewer than {LEAST_LIMIT} tokens: one character may take so many")
    wanted = sorted(((r[0], r[1], min(max(r[2], 0), r[1] - 1)) for r in clean), key=lambda s: (str(s[0]), s))
    path = vocabulary_path(vocabulary)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    names = pa.array(["none", "word", "sentence", "paragraph", "end"])
    setting_type = settings.schema["setting_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path)
        for batch in batches:
            for first, n in bpe.pieces_of(batch.column(1), 1_000_000):
                part = batch.slice(first, n)
                enc = coder.texts(part.column(1))
                if not wanted or not len(enc.code):
                    continue
                counts = enc.counts()
                strength, legal, whole, at = boundaries(enc)
                for setting, most, overlap in wanted:
                    if counts.max() <= most:
                        continue
                    of, begin, end = cut_positions(enc.text_token0, strength, legal, whole, most, overlap)
                    if not len(of):
                        continue
                    token0 = enc.text_token0[of]
                    a, b = at[token0 + begin], at[token0 + end]
                    data = enc.data
                    fresh = np.ones(len(of), bool)
                    fresh[1:] = of[1:] != of[:-1]
                    number = np.arange(len(of)) - np.maximum.accumulate(np.where(fresh, np.arange(len(of)), 0))
                    shared = np.zeros(len(of), np.int64)
                    shared[1:] = np.where(fresh[1:], 0, end[:-1] - begin[1:])
                    kind = np.where(end == counts[of], 4, strength[token0 + end])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([setting] * len(of)).cast(pa_setting), part.column(0).take(pa.array(of)), pa.array(number, pa.int32()),
                            pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(end - begin, pa.int64()), pa.array(shared, pa.int64()),
                            names.take(pa.array(kind)), pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary()).cast(pa.string()),
                        ],
                        names=["setting_id", "key", "piece_no", "first_token", "end_token", "n_tokens", "overlap_tokens", "boundary", "piece"],
                    )

    from pyspark.sql.pandas.types import to_arrow_type

    pa_setting = to_arrow_type(setting_type)
    long, string = T.LongType(), T.StringType()
    schema = T.StructType(
        [T.StructField("setting_id", setting_type), rows.schema["key"], T.StructField("piece_no", T.IntegerType())]
        + [T.StructField(c, long) for c in ("first_token", "end_token", "n_tokens", "overlap_tokens")]
        + [T.StructField("boundary", string), T.StructField("piece", string)]
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
