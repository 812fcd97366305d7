"""Byte-level BPE encoding and decoding (operator 6).

The vocabulary's byte strings, mapped to Latin-1, make an Aho-Corasick automaton. A pre-token is encoded by walking from
longest matches and stepping back to shorter ones wherever two neighbours could not both have survived the merges; which
neighbours can is memoised. The token sequence in which all neighbours are compatible is unique and is the one that the
merges give, so no merge is ever simulated, and a pre-token costs time linear in its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import kept, pieces, ship, turn
from .pretokens import Splitter, tiktoken_classes

#: Pre-tokens that a worker remembers in each of two generations; it bounds memory and changes time alone.
REMEMBERED = 300_000
#: Pre-tokens longer than this are encoded afresh each time.
REMEMBERED_LENGTH = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Merges by rank, exactly: ranks maps byte strings to ids, every single byte among them; lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = {i: len(b) for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.longest = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.halves[i] = (i, i)
            elif not self._derive(token, i):
                continue  # no merge makes it; it stands only for a whole pre-token
            self.longest.add_word(token.decode("latin-1"), (len(token) - 1, i))
        self.compatible.clear()  # what held while later merges were unknown need not hold now
        self.longest.make_automaton()
        #: Of each token, the longest reachable token that is a proper prefix of it.
        self.shorter = {i: next((j for n in range(len(t) - 1, 0, -1) if (j := ranks.get(t[:n])) in self.halves), None) for i in self.halves for t in (self.bytes_of[i],)}

    def _derive(self, token: bytes, i: int) -> bool:
        """Record which two tokens merge into this one."""
        get = self.ranks.get
        for n in range(len(token) - 1, 0, -1):
            a, b = get(token[:n]), get(token[n:])
            if a is not None and b is not None and a < i and b < i and a in self.halves and b in self.halves and self._fits(a, b):
                self.halves[i], self.joined[a, b] = (a, b), i
                return True
        return False

    def _fits(self, a: int, b: int) -> bool:
        """Whether the merges can leave a and b side by side: undo the later of the two merges, again and again, and see
        that at no step the parts that touched would have merged earlier than what was then made of them."""
        limit = 1 << 62
        while True:
            made = self.joined.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                first = True
            else:
                first = False
            for side in (first, not first):
                if side:
                    if self.halves[a][1] != a:
                        limit, a = a, self.halves[a][1]
                        break
                elif self.halves[b][0] != b:
                    limit, b = b + 1, self.halves[b][0]
                    break
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        pair = (a, b)
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[pair] = self._fits(a, b)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        best = [0] * n
        for end, (before, i) in self.longest.iter(piece.decode("latin-1")):
            best[end - before] = i  # ends ascend, so the longest from a place comes last
        size_of, shorter, known, fits = self.size_of, self.shorter, self.compatible.get, self.fits
        dead = None  # places from which no compatible rest was found
        out: list[int] = []
        at, last, token = 0, None, best[0]
        while True:
            while token is not None:
                end = at + size_of[token]
                if dead is None or end not in dead:
                    if last is None:
                        break
                    ok = known((last, token))
                    if ok or ok is None and fits(last, token):
                        break
                token = shorter[token]
            if token is None:
                dead = {at} if dead is None else dead | {at}
                token = out.pop()
                at -= size_of[token]
                last = out[-1] if out else None
                continue
            out.append(token)
            if end == n:
                return out
            at, last, token = end, token, best[end]


@kept("bpe")
def coder(path: str) -> Coder:
    return Coder(read_ranks(path))


class Memory(dict):
    """What `work` gives for pre-tokens, worked out once for each; in two generations, so that frequent ones stay."""

    def __init__(self, work, most: int = REMEMBERED):
        super().__init__()
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.work(piece)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


@kept("bpe")
def encoder(path: str, pattern: str):
    """A function from a text to its ids as little-endian unsigned 32-bit integers."""
    split, own = Splitter(pattern, *tiktoken_classes()), coder(path)
    get = Memory(lambda piece: array("I", own.encode(piece.encode())).tobytes()).__getitem__
    return lambda text: b"".join(map(get, split(text)))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, with token_ids (array of int) if with_ids, and the columns to keep.

    A null text counts as empty: 0 tokens and the digests of no bytes. Texts are encoded whole, rows are independent, so
    ties, repeats and an empty table need no rule of their own. Other columns of docs are not read, whatever their names.
    """
    ship(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids array<int>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe")
        encode, token_of = encoder(path, pattern), coder(path).bytes_of
        for batch in pieces(batches, 256):
            counts, coded, decoded, ids = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                own = encode(text.as_py() or "")
                back = memoryview(own).cast("I")
                counts.append(len(back))
                coded.append(hashlib.sha256(own).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(token_of.__getitem__, back))).hexdigest())
                if with_ids:
                    ids.append(own)
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = [0]
                for n in counts:
                    offsets.append(offsets[-1] + n)
                flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(ids))])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*[f.name for f in fields], id_col, text_col).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Texts (id, text) of arrays of ids; null stays null. Bytes that are no UTF-8, as of a cut array, become U+FFFD."""

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("bpe")
        token_of = coder(path).bytes_of
        for batch in pieces(batches):
            texts = [None if ids is None else b"".join(map(token_of.__getitem__, ids)).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")
