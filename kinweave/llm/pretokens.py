"""Pre-tokens: the pattern's matches, with the Unicode classes of the library whose results are to be matched.

The regex module knows a newer Unicode than either tokenizer library, so a few thousand recently assigned characters
are letters to it and not to them. A class probe (one call into the library over every code point) finds those
characters; texts that hold none of them, nearly all, take the plain pattern, others one with the library's classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

#: Code points by which a probe goes; surrogates cannot occur in a text.
SCALARS = [*range(0xD800), *range(0xE000, 0x110000)]
EVERY = "".join(map(chr, SCALARS))


def ranges(points: list[int]) -> str:
    """A character class body for sorted code points."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "".join(out)


def own_members(kind: str) -> set[int]:
    return set(map(ord, regex.findall(rf"\p{{{kind}}}", EVERY)))


class Splitter:
    """findall() of a pattern whose \\p{L}, \\p{N} and \\s mean the classes of the library probed.

    Texts of Latin-1 characters go to the faster re module with the classes written out; others to regex.
    """

    def __init__(self, pattern: str, letters: frozenset[int], numbers: frozenset[int]):
        self.pattern, self.letters, self.numbers = pattern, letters, numbers
        odd = sorted((own_members("L") ^ letters) | (own_members("N") ^ numbers))
        self.plain = regex.compile(pattern).findall
        self.odd = regex.compile(f"[{ranges(odd)}]").search if odd else None
        self.narrow = re.compile(self._written(255)).findall
        self.exact = None

    def _written(self, most: int) -> str:
        """The pattern with its classes written out, for characters up to most."""
        spaces = set(map(ord, regex.findall(r"\s", EVERY)))
        own = {rf"\{k}": ranges(sorted(c for c in v if c <= most)) for k, v in (("p{L}", self.letters), ("p{N}", self.numbers), ("s", spaces), ("S", spaces))}
        inside = lambda m: "[" + "".join(own.get(x, x) for x in regex.findall(r"\\p\{\w\}|\\.|.", m[1])) + "]"
        parts = regex.split(r"(\[[^\]]*\])", self.pattern)
        for k, part in enumerate(parts):
            if part.startswith("["):
                parts[k] = inside(regex.match(r"\[(.*)\]", part))
            else:
                for x, body in own.items():
                    part = part.replace(x, f"[^{body}]" if x == r"\S" else f"[{body}]")
                parts[k] = part
        return "".join(parts)

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.narrow(text)
        most = int(np.frombuffer(text.encode("utf-32-le"), "<u4").max())
        if most < 256:
            return self.narrow(text)
        if self.odd is None or not self.odd(text):
            return self.plain(text)
        if self.exact is None:
            self.exact = regex.compile(self._written(0x10FFFF)).findall
        return self.exact(text)


@lru_cache(maxsize=2)
def tiktoken_classes() -> tuple[frozenset[int], frozenset[int]]:
    """Letters and numbers as tiktoken's patterns have them."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}

    def members(kind: str) -> frozenset[int]:
        coder = tiktoken.Encoding(f"probe-{kind}", pat_str=rf"\p{{{kind}}}", mergeable_ranks=single, special_tokens={})
        return frozenset(map(ord, bytes(coder.encode_ordinary(EVERY)).decode()))

    return members("L"), members("N")


@lru_cache(maxsize=2)
def tokenizers_classes() -> tuple[frozenset[int], frozenset[int]]:
    """Letters and numbers as the tokenizers library's byte-level pre-tokenizer has them: what 'a' or '1' joins."""
    from tokenizers import pre_tokenizers

    split: Callable = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def members(kind: str, joins: str) -> frozenset[int]:
        # What a newer Unicode leaves unassigned no older one has as a letter or number.
        known = [*map(ord, regex.findall(rf"[\p{{{kind}}}\p{{M}}\p{{So}}]", EVERY))]
        found = set()
        for at in range(0, len(known), 4096):
            part = known[at : at + 4096]
            # A text of joins+c+newline parts: one pre-token for joins+c exactly where c is of the class.
            text = "".join(f"{joins}{chr(c)}\n" for c in part)
            ends = {span for _, span in split(text)}
            found.update(c for i, c in enumerate(part) if (3 * i, 3 * i + 2) in ends)
        return frozenset(found)

    return members("L", "a"), members("N", "1")
