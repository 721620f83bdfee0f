"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that stands next to each other inside no token of the vocabulary can never be inside a token of a text either:
wherever it occurs, the text is cut for certain, and no merge on one side depends on the other.  The vocabulary
gives a table of 256 x 256 such pairs.  A group of texts becomes one array of characters; one look into the table for each
pair of neighbours (last byte of one, first byte of the next) cuts all of them at once.  The fragments, words and their like,
repeat all the time: each distinct one is encoded on its own, once, and ids are concatenated in the order of the fragments.

The vocabulary's splitting pattern looks a little to the left and right, so three things keep fragments independent of it:

* no cut before an apostrophe that follows a sign (inside a run of signs it does not begin a contraction, at the beginning
  of a fragment it would);
* no first cut inside a character (what it is decides the pattern; within a pre-token the table then cuts between bytes too);
* a fragment that ends with two or more blanks before something else is a case of its own (the last blank stands apart there).

Inside a fragment pre-tokens are found by the transducer of ``token_count``, all new fragments of a group in one pass, and merged
by lowest rank, leftmost first.  No library encodes or decodes.

Defined results: null text is empty: no ids, the hashes of nothing; special strings are one id each, as the library takes them by
default; rows that repeat a doc_id or have none are encoded one by one; very long texts are read whole (fragments are
cut, never texts); a run without any cut is merged with a heap; other columns are not looked at; an empty table gives an
empty result.  Ids that the vocabulary does not have, and nulls among ids, decode to nothing; bytes that are no UTF-8 decode to
replacement characters.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernspan.llm.token_count import OTHER, QUOTE, SPACE, WHITE, classes, starts
from fernspan.llm.vocabulary import default_path, overrides
from fernspan.session import lean, ship

#: Characters that are cut at a time, distinct fragments that a worker remembers, and the longest that it remembers.
GROUP_CHARS = 1_000_000
REMEMBERED = 400_000
LONGEST = 64
#: Pieces of so many bytes at most are merged in plain lists.
SHORT = 40
NEVER = 1 << 40


class Codec:
    """A byte-level vocabulary: merges, the table of forced boundaries, the bytes of every id."""

    def __init__(self, path: str, odd: tuple[bytes, bytes] = (b"", b"")):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or any(model.get(k) for k in plain):
            raise ValueError(f"not a plain byte-level vocabulary: {path}")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
        vocab = model["vocab"]
        self.single = [0] * 256
        for c, b in byte_of.items():
            self.single[b] = vocab[c]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.joined = {i: b for i, b in self.bytes_of.items()} | {i: s.encode() for s, i in self.special.items()}
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        #: forced[x, y]: no token has byte y right after byte x
        self.forced = np.ones((256, 256), bool)
        for t in self.bytes_of.values():
            if len(t) > 1:
                x = np.frombuffer(t, np.uint8)
                self.forced[x[:-1], x[1:]] = False
        self.odd = odd
        self.known: dict[str | tuple[str], bytes] = {}

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, each with the id of the special string after it (None at the end)."""
        at = 0
        if self._cut is not None and any(s in text for s in self.special):
            for m in self._cut.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def cuts(self, parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """All parts as one string, where its fragments begin (and where it ends), which of them are followed by more after two
        blanks, and each part's first fragment."""
        whole = "".join(parts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = classes(self.odd)[cp]
        first = np.where(cp < 0x80, cp, np.where(cp < 0x800, 0xC0 | cp >> 6, np.where(cp < 0x10000, 0xE0 | cp >> 12, 0xF0 | cp >> 18))).astype(np.uint8)
        last = np.where(cp < 0x80, cp, 0x80 | cp & 0x3F).astype(np.uint8)
        cut = np.ones(len(cp) + 1, bool)
        signs = (kind == OTHER) | (kind == QUOTE)
        cut[1:-1] = self.forced[last[:-1], first[1:]] & ~(signs[:-1] & (kind[1:] == QUOTE))
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        blank = np.concatenate([[False, False], (kind == SPACE) | (kind == WHITE), [True]])
        open_end = blank[:-2] & blank[1:-1] & ~blank[2:]  # by where the fragment ends: two blanks before it, none at it
        cut[begins] = True
        open_end[begins] = False
        inner = np.zeros(len(cp) + 1, bool)
        inner[begins] = True  # blanks of the part before don't count
        open_end[1:] &= ~inner[:-1]
        at = np.flatnonzero(cut)
        if not len(cp):
            at = np.zeros(1, np.int64)
        return whole, at, open_end[at[1:]], np.searchsorted(at, begins)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece of a pre-token: merges by lowest rank, leftmost first."""
        ids = [self.single[b] for b in piece]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, new = self.rank.get, self.merged
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == NEVER:
                break
            i = ranks.index(r)
            ids[i] = new[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, for runs whose length would make looking for the least one costly."""
        n, get, new = len(ids), self.rank.get, self.merged
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = new[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def pieces(self, words: list[bytes]) -> Iterator[list[bytes]]:
        """Pre-tokens, cut once more wherever the table says so, inside characters too; one look for all of them."""
        x = np.frombuffer(b"".join(words), np.uint8)
        begins = np.cumsum([0, *map(len, words)])
        cut = np.zeros(len(x) + 1, bool)
        cut[1:-1] = self.forced[x[:-1], x[1:]]
        cut[begins] = False
        at = np.flatnonzero(cut)
        bounds = np.searchsorted(at, begins)
        at, bounds = at.tolist(), bounds.tolist()
        for w, lo, a, b in zip(words, begins.tolist(), bounds, bounds[1:]):  # noqa: B905
            if a == b:
                yield [w]
            else:
                c = [0, *(p - lo for p in at[a:b]), len(w)]
                yield [w[p:q] for p, q in zip(c, c[1:])]  # noqa: B905

    def learn(self, fragments: set[str | tuple[str]]) -> dict[str | tuple[str], bytes]:
        """Ids of fragments not met before."""
        keys = [*fragments]
        texts = [k if isinstance(k, str) else k[0] + "x" for k in keys]  # any letter stands for what follows
        words, counts = [], []
        for k, t, s in zip(keys, texts, starts(texts, self.odd), strict=True):
            if len(s) == 1 and isinstance(k, str):
                words.append(t.encode("utf-8", "surrogatepass"))
                counts.append(1)
                continue
            end = len(t) if isinstance(k, str) else len(t) - 1
            s = [a for a in s.tolist() if a < end]
            words += [t[a:b].encode("utf-8", "surrogatepass") for a, b in zip(s, [*s[1:], end], strict=True)]
            counts.append(len(s))
        ids = (i for parts in self.pieces(words) for i in [[x for p in parts for x in self.merge(p)]])
        return {k: array("I", [x for _ in range(n) for x in next(ids)]).tobytes() for k, n in zip(keys, counts, strict=True)}

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        if not any(parts):
            return [b""] * len(parts)
        whole, at, open_end, of = self.cuts(parts)
        ends = at.tolist()
        keys: list = [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(open_end).tolist():
            keys[i] = (keys[i],)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if fresh := {k for k in keys if k not in known}:
            known.update(self.learn(fresh))
        get = known.__getitem__
        # a part without text has no fragment; it begins where the next part does
        of = of.tolist()
        out = [b"".join(map(get, keys[a:b])) for a, b in zip(of[:-1], of[1:], strict=True)]
        for k in fresh:
            if len(k if isinstance(k, str) else k[0]) > LONGEST:
                del known[k]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        parts, owner, special, size = [], [], [], 0

        def flush() -> None:
            nonlocal size
            for i, ids, s in zip(owner, self.encode_parts(parts), special, strict=True):
                out[i].append(ids)
                if s is not None:
                    out[i].append(int(s).to_bytes(4, "little"))
            for x in (parts, owner, special):
                x.clear()
            size = 0

        for i, text in enumerate(texts):
            for part, s in self.segments(text):
                parts.append(part)
                owner.append(i)
                special.append(s)
                if (size := size + len(part)) > GROUP_CHARS:
                    flush()
        if parts:
            flush()
        return [np.frombuffer(b"".join(x), "<u4") for x in out]

    def decode(self, ids: list[int | None]) -> str:
        get = self.joined.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, odd: tuple[bytes, bytes] = (b"", b"")) -> Codec:
    """One for each worker process; odd: what overrides() found on the driver."""
    return Codec(path, odd)


def _texts(b: pa.RecordBatch, column: int) -> list[str]:
    return [t or "" for t in b.column(column).to_pylist()]


def _encode_batches(path: str, odd: tuple[bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = codec(path, odd).encode(_texts(b, 1))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return run


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec(path).decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def _digest_batches(path: str, odd: tuple[bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = codec(path, odd)
            n, hashes, decoded = [], [], []
            for x in c.encode(_texts(b, 1)):
                ids = x.tolist()
                n.append(len(ids))
                hashes.append(sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded.append(sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, ids (array of int)."""
    ship(docs.sparkSession)
    path = path or default_path()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_encode_batches(path, overrides(path))), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text."""
    ship(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(lean(_decode_batches(path or default_path())), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256: both ways in one pass, ids never leave the task."""
    ship(docs.sparkSession)
    path = path or default_path()
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_digest_batches(path, overrides(path))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
