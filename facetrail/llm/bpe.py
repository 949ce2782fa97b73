"""Byte-level BPE by backtracking.

A token sequence is the BPE encoding of its bytes exactly when every adjacent pair of tokens is the encoding of the two
tokens' bytes. So a word is encoded by walking left to right over the longest vocabulary matches that an Aho-Corasick
automaton reports, testing each new token against its predecessor in a pair-compatibility table (filled on demand), and
stepping back to shorter prefixes where a pair is refused. Each position is refused at most once, so the walk is linear in
the length of the word, however long it is. Decoding gathers slices of one byte buffer through an offset table.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa

#: Classes of code points for the word splitter.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: White_Space code points of Unicode.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words remembered by an encoder at most; beyond it the memory is emptied, which changes no result.
MEMORY = 400_000


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point, as the published splitting pattern sees it."""
    import regex

    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            if b - a + 1 == m.end() - m.start():
                table[a : b + 1] = kind
            else:
                for c in m.group():
                    table[ord(c)] = kind
    table[WHITE] = SPACE
    return table


def split_words(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all words of texts laid end to end, and the number of the first word of each text.

    data: UTF-8 of all texts; starts: byte offset of each text, then the length of data. The words are those of the
    published pattern of the 50k vocabularies, found for all texts at once with array operations.
    """
    cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(cps)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(starts), np.int64)
    if len(data) == n:
        at, first = None, np.asarray(starts, np.int64)
    else:
        wide = np.ones(n, np.int8)
        for least in (0x80, 0x800, 0x10000):
            wide += cps >= least
        at = np.zeros(n + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        first = np.searchsorted(at, starts)
    kind = code_point_classes()[cps]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    space = kind == SPACE
    blank = cps == 0x20
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    # A white run before other text gives up its last character: a plain blank joins what follows, any other stands alone.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~text_start[1:]
    where = np.flatnonzero(last)
    cut[where] = True
    joins = where[blank[where]]
    cut[joins + 1] = False
    # Contractions count where an apostrophe begins a word.
    quote = np.flatnonzero(cps == 0x27)
    if len(quote):
        before = np.where(quote > 0, kind[quote - 1], SPACE)
        begins = (before != OTHER) & ~((quote > 0) & blank[quote - 1]) | text_start[quote]
        quote = quote[begins]
        one, two = cps[np.minimum(quote + 1, n - 1)], cps[np.minimum(quote + 2, n - 1)]
        in1 = (quote + 1 < n) & ~text_start[np.minimum(quote + 1, n)]
        in2 = in1 & (quote + 2 < n) & ~text_start[np.minimum(quote + 2, n)]
        short = in1 & np.isin(one, [ord(c) for c in "stmd"])
        long = in2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for some, width in ((quote[short], 2), (quote[long & ~short], 3)):
            cut[some] = True
            for k in range(1, width):
                cut[some + k] = False
            cut[some + width] = True
    cut |= text_start
    cuts = np.flatnonzero(cut)
    return (cuts if at is None else at[cuts]), np.searchsorted(cuts, first)


class BacktrackingBPE:
    """Encoder and decoder over a public rank file (base64 token, rank) in the tiktoken text format."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ids.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.lengths = np.array([len(t or b"") for t in self.tokens], dtype=np.int32)
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum(self.lengths, out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(t or b"" for t in self.tokens), dtype=np.uint8)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.lengths_list = self.lengths.tolist()
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.memory: dict[bytes, tuple[int, ...]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token, None for single bytes."""
        known = self.split.get(token, 0)
        if known != 0:
            return known
        data, ids = self.tokens[token], self.ids
        found = None
        for k in range(1, len(data)):
            left, right = ids.get(data[:k]), ids.get(data[k:])
            if left is not None and right is not None and self.rank(left) < token and self.rank(right) < token and self.stay_apart(left, right, token):
                found = (left, right)
                break
        self.split[token] = found
        return found

    def rank(self, token: int) -> int:
        """When a token is made; single bytes are there from the start."""
        return token if self.lengths_list[token] > 1 else -1

    def stay_apart(self, a: int, b: int, before: int) -> bool:
        """Whether no merge with a rank under ``before`` crosses the border of two tokens.

        Goes back in time: the pieces that touch the border are taken apart in reverse order of their making; a crossing
        merge happens if it ranks before the merges that use up either piece (on equal ranks the left one goes first).
        """
        tokens, ids, lengths = self.tokens, self.ids, self.lengths_list
        used_a = used_b = before
        while True:
            cross = ids.get(tokens[a] + tokens[b])
            if cross is not None and cross < before and cross < used_a and cross <= used_b:
                return False
            made_a = a if lengths[a] > 1 else -1
            made_b = b if lengths[b] > 1 else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a >= made_b:
                used_a, a = a, self.halves(a)[1]
            else:
                used_b, b = b, self.halves(b)[0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of two tokens is these two tokens; the table is filled on demand."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.stay_apart(a, b, 1 << 40)
        return known

    def prefix(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = self.shorter[token] = next((self.ids[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ids), -1)
        return known

    def word(self, data: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        longest: list[int] = [-1] * n
        reach = [0] * n
        for end, (length, i) in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > reach[start]:
                reach[start], longest[start] = length, i
        fits = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        tokens, compatible, prefix = self.tokens, self.compatible, self.prefix
        while pos < n:
            while True:
                end = pos + len(tokens[token])
                if fits[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    break
                less = prefix(token)
                if less >= 0:
                    token = less
                    continue
                fits[pos] = 0
                token = out.pop()
                pos -= len(tokens[token])
        return tuple(out)

    def many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        memory = self.memory
        if len(memory) > MEMORY:
            memory.clear()
        out = []
        for w in words:
            ids = memory.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    memory[w] = ids
            out.append(ids)
        return out

    def texts(self, texts: pa.Array) -> "Encoded":
        return Encoded(self, texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids, gathered through the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        return self.bytes[spans(self.offsets[ids], lengths)].tobytes()


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


class Encoded:
    """Encoding of an Arrow array of texts; null and empty texts have no tokens.

    words: distinct words; code: the distinct word of each word; word_text0: first word of each text;
    word_at: byte offset of each word in data; ids are built on request.
    """

    def __init__(self, bpe: BacktrackingBPE, texts: pa.Array):
        self.bpe = bpe
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        base = int(offsets[0]) if len(offsets) else 0
        self.data = b"" if raw is None else raw.slice(base, int(offsets[-1]) - base).to_pybytes()
        self.text_at = offsets - base
        self.word_at, self.word_text0 = split_words(self.data, self.text_at)
        n = len(self.word_at) - 1
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(self.word_at, np.int64)), pa.py_buffer(self.data)])
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy()
        self.words = coded.dictionary.to_pylist()
        self.word_ids = bpe.many(self.words)
        self.word_len = np.fromiter(map(len, self.word_ids), np.int32, len(self.word_ids))
        counts = self.word_len[self.code] if n else np.zeros(0, np.int32)
        self.word_token0 = np.zeros(n + 1, np.int64)
        np.cumsum(counts, out=self.word_token0[1:])
        self.text_token0 = self.word_token0[self.word_text0]

    def counts(self) -> np.ndarray:
        """Tokens of each text."""
        return np.diff(self.text_token0)

    def ids(self) -> np.ndarray:
        """Ids of all texts, one after the other."""
        flat = np.fromiter((i for ids in self.word_ids for i in ids), np.int32)
        if not len(self.code):
            return np.zeros(0, np.int32)
        start = np.zeros(len(self.word_len), np.int64)
        np.cumsum(self.word_len[:-1], out=start[1:])
        return flat[spans(start[self.code], self.word_len[self.code])]


@lru_cache(maxsize=4)
def load(path: str) -> BacktrackingBPE:
    """One encoder a worker process and file."""
    return BacktrackingBPE(path)


def pieces_of(texts: pa.Array, most: int = 2_000_000):
    """Row ranges of an array with about so many bytes; a longer text is a range of its own."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, i - first
            first, total = i, 0
        total += int(size)
    if first < len(sizes):
        yield first, len(sizes) - first
