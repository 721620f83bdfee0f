"""Token ids of whole texts under a public byte-level vocabulary, as the tokenizers library gives them.

The same vocabulary is also loaded into tiktoken, which gives the same ids several times faster.  Where the two could
differ (characters that only one of them's Unicode version knows; found by asking both) the tokenizers library decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: Pre-tokens that a worker remembers before it starts anew, and the longest that it remembers.
REMEMBERED = 500_000
LONGEST = 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def overrides(path: str) -> tuple[bytes, bytes]:
    """Code points whose class the library sees otherwise than the regex module (their Unicode versions differ), and those classes.

    The library's own splitter is asked about every code point x, as "ax1": where its pieces begin tells a letter (0 2), a
    number (0 1) and anything else (0 1 2).  Computed on the driver, once, and sent to the workers.
    """
    from tokenizers import Tokenizer

    from fernspan.llm import token_count as t

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    own, cps = t.classes(), [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]
    points, kinds = [], []
    for lo in range(0, len(cps), 4096):
        part = cps[lo : lo + 4096]
        begins = {a for _, (a, _) in split("\n".join(f"a{chr(x)}1" for x in part))}
        for i, x in enumerate(part):
            two, three = 4 * i + 1 in begins, 4 * i + 2 in begins
            k = t.LETTER if not two else t.NUMBER if not three else t.OTHER
            mine = own[x]
            same = mine in t.LETTERS if k == t.LETTER else mine == t.NUMBER if k == t.NUMBER else mine not in (*t.LETTERS, t.NUMBER)
            if not same and mine != t.SPACE:
                points.append(x)
                kinds.append(k)
    return np.array(points, "<u4").tobytes(), np.array(kinds, np.uint8).tobytes()


def _merges(path: str) -> tuple[dict[bytes, int], list[tuple[int, int]]] | None:
    """Tokens as bytes with their ids, and the pair that token 256 + i is merged from, if ids follow the order of the merges, so that merging by lowest id is the vocabulary's merging."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token)}
    return ranks, [(vocab[a], vocab[b]) for a, b in merges]


def _ranks(path: str) -> dict[bytes, int] | None:
    found = _merges(path)
    return found[0] if found else None


def _fast(path: str):
    """The same vocabulary in tiktoken, which is several times faster; None if it can't hold it."""
    import public_tokenizers
    import tiktoken

    ranks = _ranks(path)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None


@lru_cache(maxsize=4)
def unusual(path: str) -> str:
    """Characters around which the two libraries may split differently, as their Unicode versions differ. On the driver, once.

    Blocks of code points are encoded by both; where a block's ids differ its code points are tried one by one.
    """
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(path), _fast(path)
    if fast is None:
        return ""
    cps, out = [*range(0xD800), *range(0xE000, sys.maxunicode + 1)], []
    todo = [cps[i : i + 4096] for i in range(0, len(cps), 4096)]
    while todo:
        parts, todo = todo[:8], todo[8:]  # a few at a time: the library's answers are large
        # a letter joins the a, a number the 1, anything else neither
        texts = ["".join(f"a{chr(x)}1\n" for x in part) for part in parts]
        pairs = zip(parts, slow.encode_batch(texts, add_special_tokens=False), fast.encode_ordinary_batch(texts), strict=True)
        wrong = [part for part, x, y in pairs if x.ids != y]
        out += [part[0] for part in wrong if len(part) == 1]
        todo += [part[i : i + max(1, len(part) // 16)] for part in wrong if len(part) > 1 for i in range(0, len(part), max(1, len(part) // 16))]
    return "".join(map(chr, sorted(out)))


class Vocabulary:
    def __init__(self, path: str, odd: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = _fast(path)
        #: texts that have one of these characters are left to the slower library
        self.odd = frozenset(odd)
        #: strings that the library takes out of a text by default, before any other rule
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, each with the id of the special string after it (None at the end)."""
        at = 0
        if self._cut is not None and any(s in text for s in self.special):
            for m in self._cut.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def ids(self, text: str) -> bytes:
        """All ids, as little-endian 4-byte numbers."""
        if self.fast is None or self.odd and not text.isascii() and not self.odd.isdisjoint(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for part, special in self.segments(text):
            out.append(np.array(self.fast.encode_ordinary(part), "<u4").tobytes())
            if special is not None:
                out.append(int(special).to_bytes(4, "little"))
        return out[0] if len(out) == 1 else b"".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str, odd: str = "") -> Vocabulary:
    """One for each worker process; odd: what unusual() found on the driver."""
    return Vocabulary(path, odd)
