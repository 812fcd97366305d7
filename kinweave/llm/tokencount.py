"""Token counts by the whole-token shortcut (operator 8).

Before any text is read, every vocabulary string is encoded by itself; those that come out as the one token that they
spell are proven, and a pre-token equal to one counts 1 without further work. Only the remaining pre-tokens are merged,
each once while it is remembered.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import pieces, ship
from .bpe import Coder, Memory
from .pretokens import Splitter, tokenizers_classes

#: The byte-level pre-tokenizer's pattern: a fixed value, which results must equal.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others for the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Counter:
    """Counts tokens as the tokenizers library does for a byte-level BPE file, special strings in a text included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: only plain byte-level BPE files can be counted this way")
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {bytes([b]): b for b in range(256)} | {spelled(a + b): 256 + k for k, (a, b) in enumerate(merges)}
        self.coder = Coder(ranks)
        whole, self.coder.ranks = self.coder.ranks, {}  # the walk alone, without the lookup of whole pre-tokens
        self.proven = {token for token, i in whole.items() if i in self.coder.halves and self.coder.encode(token) == [i]}
        if any(self.coder.halves.get(256 + k) != (whole[spelled(a)], whole[spelled(b)]) for k, (a, b) in enumerate(merges) if spelled(a + b) in self.proven):
            raise ValueError(f"{path}: merges that other pairs of the same strings precede")
        self.split = Splitter(PATTERN, *tokenizers_classes())
        self.counts = Memory(lambda piece: len(self.coder.encode(piece.encode())))
        self.single = {t.decode(): 1 for t in self.proven if _decodes(t)}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None

    def __call__(self, text: str) -> int:
        n, parts = 0, [text]
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        single, counts = self.single.get, self.counts
        for part in parts:
            found = [single(p) or counts[p] for p in self.split(part)]
            n += sum(found)
        return n


def _decodes(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Rows are independent, texts whole; an empty table gives an empty
    one; other columns of docs are not read, whatever their names.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in pieces(batches):
            sizes, counts = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
