"""Token counts by compiled finite-state transducers.

The vocabulary's splitting pattern is compiled into a deterministic transducer over character classes: 12 states, and on
each transition how many pre-tokens begin, at the character read (``HERE``) or, where one character of lookahead was needed, at
the one before (``BACK``).  A batch of texts becomes one array of classes with a reset between texts.  It is cut into chunks;
for all chunks at once, and for every state that a chunk might begin in, a pass over the chunk's columns yields its state
map (state to state, with the pre-tokens emitted).  The maps compose associatively, so a parallel prefix scan over chunks
gives each chunk its true first state; a last pass marks where pre-tokens begin.

Inside a pre-token the merges are compiled into a second transducer, over bytes: a state is a prefix, and the transition into it
is annotated with the tokens that its last byte adds (which may be none, or fewer than none, as tokens merge).  The annotation
follows from the merge table alone: the last token of a prefix is the one suffix in the vocabulary that can stand behind the last
token of what comes before it, and the count is one more than there.  Whether two tokens can stand side by side is
decided by undoing merges at their seam, latest first.  That automaton has as many states as the language has prefixes, so it
is compiled on demand, as far as the texts at hand lead, up to ``STATES_KEPT`` states, then anew; whole pre-tokens met before
are looked up.  The library counts nothing, unless its ids don't follow its merges.

Special strings are counted as the library counts them by default: taken out of the text first, one token each.

Defined results: null text is empty: no bytes and no tokens; rows that repeat a doc_id or have none are counted one by one; very
long texts are read whole (a batch of their characters at a time, but never cut within a text); other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspan.llm.vocabulary import LONGEST, REMEMBERED, _merges, default_path, overrides, vocabulary
from fernspan.session import lean, ship

LIMIT = 512
CHUNK = 128
#: Characters that are taken through the transducer at a time.
BATCH_CHARS = 2_000_000
HERE, BACK = 1, 2

#: Character classes. The letters of the contractions 's 't 'm 'd 're 've 'll have classes of their own.
SPACE, WHITE, LETTER, NUMBER, QUOTE, OTHER, ONE, R, V, L, E, RESET = range(12)
LETTERS = (LETTER, ONE, R, V, L, E)
#: States: at a boundary; in a run of letters, numbers or others; after white space (one or more characters, the last a
#: space or not); after a quote that begins a pre-token, and after 'r, 'v and 'l from there.
START, IN_L, IN_N, IN_O, W1_SPACE, W1, W2_SPACE, W2, AT_QUOTE, Q_R, Q_V, Q_L = range(12)
STATES = 12


@lru_cache(maxsize=2)
def classes(odd: tuple[bytes, bytes] = (b"", b"")) -> np.ndarray:
    """The class of every code point, by the properties that the splitting pattern names, save where the library differs (odd)."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for pattern, c in ((r"\s", WHITE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        out[np.frombuffer("".join(regex.findall(pattern, text)).encode("utf-32-le"), "<u4")] = c
    for chars, c in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for x in chars:
            out[ord(x)] = c
    out[np.frombuffer(odd[0], "<u4")] = np.frombuffer(odd[1], np.uint8)
    return out


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks), both by state and class."""
    to, marks = np.zeros((STATES, 12), np.uint8), np.zeros((STATES, 12), np.uint8)
    fresh = {**dict.fromkeys(LETTERS, IN_L), NUMBER: IN_N, OTHER: IN_O, QUOTE: AT_QUOTE, SPACE: W1_SPACE, WHITE: W1}
    joined = fresh | {QUOTE: IN_O}  # after a space that belongs to the pre-token
    for s in range(STATES):
        for c, t in fresh.items():
            to[s, c], marks[s, c] = t, HERE
        to[s, RESET] = START

    def go(s: int, cs, t: int, mark: int = 0) -> None:
        for c in cs:
            to[s, c], marks[s, c] = t, mark

    go(IN_L, LETTERS, IN_L)
    go(IN_N, (NUMBER,), IN_N)
    go(IN_O, (OTHER, QUOTE), IN_O)
    for s in (W1_SPACE, W1, W2_SPACE, W2):
        go(s, (SPACE,), W2_SPACE)
        go(s, (WHITE,), W2)
    for c, t in joined.items():
        if c not in (SPACE, WHITE):
            go(W1_SPACE, (c,), t)
            go(W2_SPACE, (c,), t, BACK)
            go(W2, (c,), fresh[c], BACK | HERE)
    go(AT_QUOTE, (ONE,), START)
    go(AT_QUOTE, (OTHER, QUOTE), IN_O)
    for c, s, end in ((R, Q_R, E), (V, Q_V, E), (L, Q_L, L)):
        go(AT_QUOTE, (c,), s)
        for x in fresh:
            marks[s, x] = HERE | BACK
        go(s, LETTERS, IN_L, BACK)
        go(s, (end,), START)
        marks[s, RESET] = BACK
    return to, marks


def state_maps(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk (row of classes) and first state: the last state, and the pre-tokens begun."""
    to, marks = transducer()
    begun = np.array([0, 1, 1, 2], np.int32)[marks]
    state = np.tile(np.arange(STATES, dtype=np.uint8), (len(c), 1))
    count = np.zeros(state.shape, np.int32)
    flat_to, flat_n, width = to.ravel(), begun.ravel(), to.shape[1]
    for j in range(c.shape[1]):
        at = state.astype(np.int64) * width + c[:, j, None]
        count += flat_n[at]
        state = flat_to[at]
    return state, count


def scan(state: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive parallel prefix scan of maps under composition (doubling)."""
    state, count, d = state.copy(), count.astype(np.int64), 1
    while d < len(state):
        left, then = state[:-d].astype(np.int64), np.arange(d, len(state))[:, None]
        new, more = state[then, left], count[then, left] + count[:-d]
        state[d:], count[d:] = new, more
        d *= 2
    return state, count


def starts(texts: list[str], odd: tuple[bytes, bytes] = (b"", b"")) -> list[np.ndarray]:
    """Where the pre-tokens of each text begin."""
    to, marks = transducer()
    lengths = np.array([len(t) for t in texts])
    chars = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    c = classes(odd)[chars]
    resets = np.concatenate([[0], np.cumsum(lengths + 1)])
    c[resets] = RESET
    rows = -(-len(c) // CHUNK)
    c = np.concatenate([c, np.full(rows * CHUNK - len(c), RESET, np.uint8)]).reshape(rows, CHUNK)
    ends, _ = scan(*state_maps(c))
    state = np.concatenate([[START], ends[:-1, START]]).astype(np.int64)
    out = np.empty(c.shape, np.uint8)
    flat_to, flat_m, width = to.ravel(), marks.ravel(), to.shape[1]
    for j in range(CHUNK):
        at = state * width + c[:, j]
        out[:, j] = flat_m[at]
        state = flat_to[at].astype(np.int64)
    out = out.ravel()
    begin = (out & HERE) > 0
    begin[:-1] |= (out[1:] & BACK) > 0
    where = np.flatnonzero(begin)
    cuts = np.searchsorted(where, resets)
    return [where[a:b] - r - 1 for a, b, r in zip(cuts[:-1], cuts[1:], resets[:-1], strict=True)]


#: States of the merge transducer, and decisions about pairs of tokens, that a worker keeps.
STATES_KEPT = 600_000
PAIRS_KEPT = 1_000_000


class Transducer:
    """Byte-pair merges as a deterministic transducer over bytes, compiled as far as it is run."""

    def __init__(self, ranks: dict[bytes, int], pairs: list[tuple[int, int]]):
        self.merged = {p: 256 + i for i, p in enumerate(pairs)}
        self.left, self.right = ([*range(256), *(p[side] for p in pairs)] for side in (0, 1))
        sound = bytearray([1]) * 256
        for i, (a, b) in enumerate(pairs):  # a token that its own bytes are never merged into ends no prefix
            sound.append(sound[a] and sound[b] and self.beside(a, b, 256 + i))
        # the vocabulary as a tree read backwards, from the last byte of a token to its first
        self.back, self.token = {}, [-1]
        for t, i in ranks.items():
            if i < len(sound) and sound[i]:
                node = 0
                for byte in reversed(t):
                    key = node << 8 | byte
                    node = self.back.get(key, 0)
                    if not node:
                        node = self.back[key] = len(self.token)
                        self.token.append(-1)
                self.token[node] = i
        self.forget()

    def forget(self) -> None:
        self.to: dict[int, int] = {}
        self.last, self.emitted = [-1], [0]
        self.apart: dict[int, bool] = {}

    def beside(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether tokens a and b stay apart side by side, looking at merges below limit only."""
        merged, left, right = self.merged, self.left, self.right
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            # undo the later of the two merges at the seam; what was merged before it is what could have interfered
            if a > b:
                side = 0
            else:
                side = 1
            for _ in range(2):
                if side == 0 and a > 255:
                    limit, a = min(limit, a), right[a]
                    break
                if side == 1 and b > 255:
                    limit, b = min(limit, b + 1), left[b]
                    break
                side = 1 - side
            else:
                return True

    def count(self, word: bytes) -> int:
        """Tokens of a pre-token: the sum of what its transitions emit."""
        if len(self.last) > STATES_KEPT or len(self.apart) > PAIRS_KEPT:
            self.forget()
        to, last, emitted, apart, back, token = self.to, self.last, self.emitted, self.apart, self.back, self.token
        keep = len(word) <= LONGEST
        state, ends, counts = 0, [-1], [0]
        for i in range(1, len(word) + 1):
            key = state << 8 | word[i - 1]
            nxt = to.get(key) if state >= 0 else None
            if nxt is not None:
                state = nxt
                ends.append(last[state])
                counts.append(counts[-1] + emitted[state])
                continue
            node, at = 0, i
            while True:  # one of the tokens that end here fits, and no more than one
                at -= 1
                node = back[node << 8 | word[at]]
                t = token[node]
                if t >= 0:
                    if not at:
                        break
                    pair = ends[at] << 20 | t
                    ok = apart.get(pair)
                    if ok is None:
                        ok = apart[pair] = self.beside(ends[at], t)
                    if ok:
                        break
            ends.append(t)
            counts.append(counts[at] + 1)
            if keep and state >= 0:
                to[key] = state = len(last)
                last.append(t)
                emitted.append(counts[-1] - counts[-2])
            else:
                state = -1
        return counts[-1]


class _Counts(dict):
    """Tokens of whole pre-tokens met before; others go through the transducer."""

    def __init__(self, path: str):
        found = _merges(path)
        if found:
            run = Transducer(*found).count
            self.of = lambda word: run(word.encode("utf-8", "surrogatepass"))
        else:
            tokenizer = vocabulary(path).tokenizer
            self.of = lambda word: len(tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> int:
        n = self.of(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=4)
def _counts(path: str) -> _Counts:
    return _Counts(path)


def count(texts: list[str], path: str, odd: tuple[bytes, bytes] = (b"", b"")) -> list[int]:
    v, get = vocabulary(path), _counts(path).__getitem__
    out, parts, owner = [0] * len(texts), [], []
    size = 0

    def flush() -> None:
        nonlocal size
        for i, t, s in zip(owner, parts, starts(parts, odd), strict=True):
            if len(s):
                s = s.tolist()
                out[i] += sum(map(get, [t[a:b] for a, b in zip(s, [*s[1:], len(t)], strict=True)]))
        parts.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        for part, special in v.segments(text):
            out[i] += special is not None
            parts.append(part)
            owner.append(i)
            if (size := size + len(part)) > BATCH_CHARS:
                flush()
    if parts:
        flush()
    return out


def _count_batches(path: str, odd: tuple[bytes, bytes], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = count(texts, path, odd)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)
    path = path or default_path()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_count_batches(path, overrides(path), limit)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
