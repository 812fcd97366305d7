"""Masked pseudo-likelihood scores (operator 7).

A bidirectional window network predicts each token from WINDOW neighbours on either side: hidden = tanh(the sum of the
neighbours' embeddings, which differ by place, + bias). The symbols are split into GROUPS of MEMBERS, and
p(symbol) = softmax over groups * softmax over the members of its group. A document's score is the sum over its tokens of
log p(word | neighbours) = log p(symbol | neighbours) + log p(word | symbol), each token masked in turn.

Tokens are words. The symbols are the VOCABULARY most frequent words of the whole corpus, and CLASSES classes of the
others by a hash of the word. The network is trained in numpy on every token of every document. Each is masked in one of
MASKED turns, by its place and a hash of the text; what the network is trained on grows with the corpus and stays
distributed. A turn's windows are dealt by their hash into shards of about SHARD, however the input is split, in one shuffle
for all turns. In each turn all its shards start from one network and are trained apart; their networks are averaged in
blocks, and the average, of fixed size, is all that the driver holds.

The finished network's numbers are rounded so far that sums of their products are exact in single precision: a token's
probability depends neither on the batch that it is in nor on the order of sums.

log p(word | symbol) is 0 for a vocabulary word. Of a class it is log(count of the word / (1 + count of the class)), with a
count of 1 for a word that training did not see: over all words of the corpus and an unseen one this sums to 1. The counts
of all words are a table that grows with the corpus and stays distributed. The most frequent words, HEAD at most, are
broadcast; the others of each document are joined to the table.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, pieces, shared_dir, ship

#: Symbols: the text's edge, classes of rare words, frequent words; 2 048 in all, as groups of members.
CLASSES, VOCABULARY = 127, 1920
SYMBOLS = 1 + CLASSES + VOCABULARY
BITS = SYMBOLS.bit_length() - 1
GROUPS, MEMBERS = 32, 64
#: Neighbours on either side, and the places of all, counted from the token.
WINDOW = 2
PLACES = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
HIDDEN = 32
#: Turns, in one of which each token is masked in training; distinct windows of a shard; its steps at least, their windows.
MASKED, SHARD, STEPS, BATCH, RATE = 8, 1 << 20, 25, 4096, 0.02
#: Windows that a task counts at once; rows of windows of a turn and shard, packed().
HELD_WINDOWS = 1 << 20
BUNDLES = "turn int, shard bigint, size bigint, codes binary, n binary"
#: Numbers of the network that a step changes at once; tokens that are scored at once.
PART, AT_ONCE = 1 << 15, 16_384
#: Precision of the normal prior of embeddings and output weights: what few windows don't support stays near 0.
PRIOR = 10.0
#: Partitions that shards are dealt to, at most; parts of the network that are averaged on their own; networks that are
#: averaged at a time before their averages are.
PARTITIONS, BLOCKS, FAN = 16_384, 64, 64
#: Distinct words, and bytes of text, that a task counts at once.
HELD_WORDS, HELD_BYTES = 300_000, 64 << 20
#: At most so many of the most frequent words, of so many bytes at most, are broadcast with their counts.
HEAD, LONGEST = 50_000, 64
#: Logarithms of counts are summed as integers of this fraction, in any order alike; log p of symbols of the other.
UNIT, GRAIN = 2.0**-32, 2.0**-24


def crc_table() -> np.ndarray:
    """What a byte does to a CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = c >> np.uint32(1) ^ np.uint32(0xEDB88320) * (c & np.uint32(1))
    return c


CRC = crc_table()


def symbol_of(vocabulary: list[str]) -> Callable[[bytes], int]:
    """Symbol of a lower-case word: edge 0, classes 1..CLASSES, then the vocabulary."""
    known = {w.encode(): 1 + CLASSES + i for i, w in enumerate(vocabulary)}
    return lambda w: known.get(w) or 1 + zlib.crc32(w) % CLASSES


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z lowered, split at ASCII white space; how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, counts = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.binary_length(words).to_numpy(zero_copy_only=False) == 0  # beside white space at a text's ends
    if empty.any():
        counts -= np.bincount(np.searchsorted(np.cumsum(counts), np.flatnonzero(empty), "right"), minlength=len(counts))
        words = words.filter(pa.array(~empty))
    return words, counts


def crc32(words: pa.Array) -> np.ndarray:
    """CRC-32 of each word of an array that is no slice: a byte of all words at a time, longest words first; words of more
    than LONGEST bytes on their own."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if not size.any():
        return np.zeros(len(size), np.uint32)
    data, start = np.frombuffer(words.buffers()[2], np.uint8), np.cumsum(size) - size
    order = np.argsort((LONGEST + 1 - np.minimum(size, LONGEST + 1)).astype(np.uint8), kind="stable")
    own, at, live = np.full(len(size), 0xFFFFFFFF, np.uint32), start[order], len(size) - np.cumsum(np.bincount(np.minimum(size, LONGEST + 1)))
    alone = live[LONGEST] if len(live) > LONGEST else 0
    for k, end in enumerate(live[:LONGEST].tolist()):
        # live[k] words have a byte at place k.
        now = own[alone:end]
        low = (now ^ data[at[alone:end] + k]) & np.uint32(0xFF)
        now >>= np.uint32(8)
        now ^= np.take(CRC, low)
    out = np.empty(len(size), np.uint32)
    out[order] = ~own
    for i in order[:alone].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
    return out


def symbols(words: pa.Array, known: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its place in known, or -1, and its symbol: that of its place, or else its class."""
    place = pc.fill_null(pc.index_in(words, value_set=known.cast(words.type)), -1).to_numpy(zero_copy_only=False)
    out, other = np.take(np.append(of, 0), place, mode="wrap"), np.flatnonzero(place < 0)
    out[other] = 1 + crc32(words.take(pa.array(other))) % CLASSES
    return place, out


def around(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of each symbol of texts of so many, a row for each place, edges beyond a text's ends; each one's text."""
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(own)) + WINDOW * (1 + row)
    s = np.zeros(len(own) + WINDOW * (1 + len(counts)), np.int64)
    s[at] = own
    return np.stack([np.take(s, at + k) for k in PLACES]), row


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, count) over all texts. A task counts HELD_WORDS distinct words, or HELD_BYTES of text, at a time; Spark adds
    its counts up before it shuffles them."""

    def merged(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        words = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        n = np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in held]), len(words.dictionary))
        return words.dictionary, n.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            words, n = merged(held) if len(held) > 1 else held[0]
            return pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], ["word", "n"])

        held, size = [], 0
        for batch in pieces(batches, 512):
            words, n = split(batch.column(0))[0].value_counts().flatten()
            held.append((words, n.to_numpy()))
            size += batch.nbytes
            if sum(len(n) for _, n in held) > HELD_WORDS:
                held = [merged(held)]
            if len(held[0][0]) > HELD_WORDS or size > HELD_BYTES:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("count"))


def windows(docs: DataFrame, text_col: str, vocabulary: list[str], turns: int = 1, shards: int = 0) -> DataFrame:
    """(turn, code, n): the tokens of all texts that are masked in the first so many turns, with their neighbours, and how
    often each occurs, counted over some HELD_WINDOWS of a partition at a time. code's digits to the base SYMBOLS are the
    neighbours, leftmost first, and the token. In MASKED turns each token is masked once. Of so many shards, if any, they come
    in bundles."""

    def counted(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for turn, own in enumerate(found):
            codes, n = np.unique(np.concatenate(own), return_counts=True)
            if shards:
                yield bundles(turn, codes, n, shards)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), turn, np.int32)), pa.array(codes), pa.array(n.astype(np.int64))], ["turn", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = pa.array(vocabulary, pa.string()), 1 + CLASSES + np.arange(len(vocabulary))
        found, held = [[] for _ in range(turns)], 0
        for batch in pieces(batches, 512):
            words, counts = split(batch.column(0))
            token = symbols(words, known, of)[1]
            near, row = around(token, counts)
            code = np.zeros(len(token), np.int64)
            for digit in [*near, token]:
                code <<= BITS
                code += digit
            # A token's place in its text, less that of the first that is masked.
            first = np.array([zlib.crc32(t.as_buffer()) % MASKED if t.is_valid else 0 for t in batch.column(0)], np.int64)
            masked = ((np.arange(len(token)) - (np.cumsum(counts) - counts + first)[row]) % MASKED).astype(np.uint8)
            for turn, own in enumerate(found):
                own.append(code[masked == turn])
            held += len(code)
            if held > HELD_WINDOWS:
                yield from counted(found)
                found, held = [[] for _ in range(turns)], 0
        if held:
            yield from counted(found)

    return docs.select(text_col).mapInArrow(run, BUNDLES if shards else "turn int, code bigint, n bigint")


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """pmod(xxhash64(code), shards), as Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    x = turned(codes.view(np.uint64) * p2, 31) * p1 ^ (np.uint64(42 + 8) + p5)
    x = turned(x, 27) * p1 + p4
    x ^= x >> np.uint64(33)
    x *= p2
    x ^= x >> np.uint64(29)
    x *= p3
    x ^= x >> np.uint64(32)
    return np.mod(x.view(np.int64), shards)


def packed(values: np.ndarray) -> bytes:
    """Integers as the compressed bytes of their differences, the lowest bytes of all first."""
    steps = np.diff(values, prepend=np.int64(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(data: pa.Buffer, size: int) -> np.ndarray:
    steps = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd"), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view(np.int64).ravel())


def bundles(turn: int, codes: np.ndarray, n: np.ndarray, shards: int) -> pa.RecordBatch:
    """A turn's windows, those of each shard in a row."""
    own = shard_of(codes, shards)
    order = np.argsort(own.astype(np.uint16) if shards <= 1 << 16 else own, kind="stable")
    own, codes, n = own[order], codes[order], n[order]
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    ends = [*starts[1:], len(own)] if len(own) else []
    parts = list(zip(starts, ends, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([turn] * len(parts), pa.int32()), pa.array(own[starts]), pa.array([hi - lo for lo, hi in parts], pa.int64()), *(pa.array([packed(x[lo:hi]) for lo, hi in parts], pa.binary()) for x in (codes, n))],
        ["turn", "shard", "size", "codes", "n"],
    )


def shard_count(tokens: int) -> int:
    return tokens // (MASKED * SHARD) + 1


def deal(found: DataFrame, tokens: int) -> DataFrame:
    """Bundles of windows, or windows of a single turn, of a corpus of so many tokens, as bundles, cut, each shard in one
    partition and its turns' rows together there. Up to PARTITIONS shards have a partition each; of more, shards follow each
    other in one."""
    shards = shard_count(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield bundles(0, *(c.to_numpy() for c in batch.columns), shards)

    if "code" in found.columns:
        found = found.select("code", "n").mapInArrow(run, BUNDLES)
    parts = min(shards, PARTITIONS)
    own = (F.col("shard") % parts).cast("int")
    return cut(found.repartitionById(parts, own).sortWithinPartitions("turn", "shard"))


def digits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours, a row for each place, and tokens of window codes."""
    return np.stack([codes >> BITS * (len(PLACES) - k) & SYMBOLS - 1 for k in range(len(PLACES))]), codes & SYMBOLS - 1


def softmax(z: np.ndarray, own: np.ndarray, small: bool) -> np.ndarray:
    """log p of each column's own row; z then holds the exponentials. Values known to be small need no shift. A column is
    summed from the first row to the last, a single one (which would be summed by pairs) too."""
    if not small:
        z -= np.maximum.reduce(z, 0)
    told = z[own, np.arange(z.shape[1])]
    np.exp(z, out=z)
    total = np.add.reduce(z, 0) if z.shape[1] > 1 else np.add.reduce(np.repeat(z, 2, 1), 0)[:1]
    return told - np.log(total)


def slopes(z: np.ndarray, own: np.ndarray, weight: np.ndarray, small: bool) -> float:
    """The weighted sum of log p of each row's own column under the softmax of the row, which z then holds the slopes of: of
    the sum's negative by the row's values."""
    if not small:
        z -= np.maximum.reduce(z, 1, keepdims=True)
    rows = np.arange(len(own))
    told = z[rows, own]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z *= (weight / total)[:, None]
    z[rows, own] -= weight
    return float(weight @ (told - np.log(total)))


def descend(flat: np.ndarray, slope: np.ndarray, first: np.ndarray, second: np.ndarray, pulls: list[tuple[int, int, float]], rate: float) -> None:
    """A step of Adam down slope, which is overwritten, rate corrected already. first and second are sums of slopes and of
    their squares that fade by 0.9 and 0.99 a step: ten and a hundred times the usual means. pulls are first and last place
    and prior of each stretch; it is taken in parts, that are small enough to stay in the processor's cache between operations."""
    spare = np.empty(min(PART, len(flat)), flat.dtype)
    for start, end, pull in pulls:
        for lo in range(start, end, PART):
            own = slice(lo, min(lo + PART, end))
            w, g, m, v = flat[own], slope[own], first[own], second[own]
            if pull:
                g += np.multiply(w, pull, out=spare[: len(w)])
            m *= 0.9
            m += g
            g *= g
            v *= 0.99
            v += g
            np.sqrt(v, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= rate
            w -= g


def by_group(token: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the tokens by their group, and of each group in it: group, first and last place."""
    g = (token // MEMBERS).astype(np.uint8)
    ends = [0, *np.cumsum(np.bincount(g, minlength=GROUPS)).tolist()]
    return np.argsort(g, kind="stable"), [(k, ends[k], ends[k + 1]) for k in range(GROUPS) if ends[k] < ends[k + 1]]


class Room(NamedTuple):
    """Arrays that one step after the other works in."""

    flat: np.ndarray  # the gradient
    grad: dict[str, np.ndarray]  # its parts
    hidden: np.ndarray
    back: np.ndarray
    spare: np.ndarray
    group: np.ndarray
    member: np.ndarray


class Network:
    def __init__(self, totals: np.ndarray, seed: int = 11):
        """A network whose output biases are those of symbols that occur so often."""
        draw = np.random.default_rng(seed)
        share = np.maximum(totals / max(totals.sum(), 1), 1e-7).reshape(GROUPS, MEMBERS)
        self.parts = {
            "near": draw.normal(0, 0.3, (len(PLACES), SYMBOLS, HIDDEN)),
            "inner": np.zeros(HIDDEN),
            "group": draw.normal(0, 0.1, (GROUPS, HIDDEN)),
            "group_bias": np.log(share.sum(1)),
            "member": draw.normal(0, 0.1, (GROUPS, MEMBERS, HIDDEN)),
            "member_bias": np.log(share),
        }
        self.parts = {k: v.astype(np.float32) for k, v in self.parts.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.parts.values()])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Its numbers in the shapes of the parts."""
        out, at = {}, 0
        for k, v in self.parts.items():
            out[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return out

    def take(self, flat: np.ndarray) -> Network:
        """This network with other numbers."""
        out = object.__new__(Network)
        out.parts = {k: v.astype(np.float32) for k, v in self.views(flat).items()}
        return out

    def rounded(self) -> Network:
        """Output weights in units of 2^-7, below 8; hidden values are taken in units of 2^-6 and biases of 2^-13. A sum
        of HIDDEN products and a bias has 22 bits then, and is exact."""
        out = self.take(self.flat())
        for k in ("group", "member"):
            out.parts[k] = np.clip(np.round(out.parts[k] * 128) / 128, -7.9375, 7.9375)
            out.parts[k + "_bias"] = np.clip(np.round(out.parts[k + "_bias"] * 8192) / 8192, -64, 64)
        return out

    def small(self) -> bool:
        """Whether no softmax of this network needs a shift."""
        p, ones = self.parts, np.ones(HIDDEN, np.float32)
        return all((np.abs(p[k]) @ ones).max() + np.abs(p[k + "_bias"]).max() < 60 for k in ("group", "member"))

    def hidden(self, context: np.ndarray, h: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
        """The hidden values, in h if given."""
        near = self.parts["near"]
        h = np.take(near[0], context[0], 0, out=h, mode="clip")
        for k in range(1, len(PLACES)):
            h += np.take(near[k], context[k], 0, out=spare, mode="clip")
        h += self.parts["inner"]
        return np.tanh(h, out=h)

    def log_p(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """log p of each token between its neighbours; of a rounded network the same in any batch."""
        p, out = self.parts, np.empty(len(token), np.float32)
        small = self.small()
        # Biases as weights of a value that is always 1.
        group, member = (np.concatenate([p[k], p[k + "_bias"][..., None]], -1) for k in ("group", "member"))
        h = None
        for start in range(0, len(token), AT_ONCE):
            order, groups = by_group(token[start : start + AT_ONCE])
            t = token[start : start + AT_ONCE][order]
            if h is None or len(h) != len(t):
                h, g, z = np.ones((len(t), HIDDEN + 1), np.float32), *(np.empty((n, len(t)), np.float32) for n in (GROUPS, MEMBERS))
                own, spare = np.empty((2, len(t), HIDDEN), np.float32)
            self.hidden(np.take(context[:, start : start + AT_ONCE], order, 1), own, spare)
            own *= 64
            np.rint(own, out=own)
            np.multiply(own, 1 / 64, out=h[:, :HIDDEN])
            told = softmax(np.matmul(group, h.T, out=g), t // MEMBERS, small)
            for k, lo, hi in groups:
                np.matmul(member[k], h[lo:hi].T, out=z[:, lo:hi])
            out[start + order] = told + softmax(z, t % MEMBERS, small)
        return out

    def room(self, size: int) -> Room:
        kind = self.parts["near"].dtype
        flat = np.empty(sum(v.size for v in self.parts.values()), kind)
        return Room(flat, self.views(flat), *(np.empty((size, n), kind) for n in (HIDDEN, HIDDEN, HIDDEN, GROUPS, MEMBERS)))

    def gradient(self, context: np.ndarray, token: np.ndarray, weight: np.ndarray, room: Room | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted sum of negative log p, and its gradient, in room if given."""
        p, (_, grad, h, back, spare, g, z) = self.parts, room or self.room(len(token))
        small, (order, groups) = self.small(), by_group(token)
        context, token, weight = np.take(context, order, 1), token[order], weight[order]
        self.hidden(context, h, spare)
        ones = np.ones(len(token), h.dtype)  # products with it are sums
        np.matmul(h, p["group"].T, out=g)
        g += p["group_bias"]
        loss = -slopes(g, token // MEMBERS, weight, small)
        np.matmul(g.T, h, out=grad["group"])
        np.matmul(ones, g, out=grad["group_bias"])
        np.matmul(g, p["group"], out=back)
        for k, lo, hi in groups:
            own = np.matmul(h[lo:hi], p["member"][k].T, out=z[lo:hi])
            own += p["member_bias"][k]
        loss -= slopes(z, token % MEMBERS, weight, small)
        if len(groups) < GROUPS:
            grad["member"][:], grad["member_bias"][:] = 0, 0
        for k, lo, hi in groups:
            own = z[lo:hi]
            np.matmul(own.T, h[lo:hi], out=grad["member"][k])
            np.matmul(ones[lo:hi], own, out=grad["member_bias"][k])
            np.matmul(own, p["member"][k], out=spare[lo:hi])
        back += spare
        h *= h
        back *= np.subtract(1, h, out=h)
        np.matmul(ones, back, out=grad["inner"])
        grad["near"][:] = 0
        pairs = back.view(np.result_type(back, 1j))  # complex numbers: as many sums in half the steps
        held = spare.view(pairs.dtype)
        for k in range(len(PLACES)):
            of = context[k].astype(np.uint16)
            order = np.argsort(of, kind="stable")
            of = of[order]
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            grad["near"][k][of[starts]] = np.add.reduceat(np.take(pairs, order, 0, out=held, mode="clip"), starts).view(back.dtype)
        return loss, grad

    def fit(self, codes: np.ndarray, n: np.ndarray, turn: int = 0) -> list[float]:
        """Adam on the mean negative log p of windows that occur n times, in their order; returns it by step, in nats.
        The rate falls from turn to turn."""
        size = min(BATCH, len(codes))
        steps = max(STEPS, -(-len(codes) // size))
        flat, room = self.flat(), self.room(size)
        self.parts = self.views(flat)
        ends, pull = np.cumsum([0, *(v.size for v in self.parts.values())]).tolist(), PRIOR / float(n.sum())
        pulls = [(lo, hi, 0 if "bias" in k or k == "inner" else pull) for k, lo, hi in zip(self.parts, ends, ends[1:])]
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        losses, at = [], 0
        for step in range(1, steps + 1):
            part = np.arange(at, at + size) % len(codes)
            at = (at + size) % len(codes)
            context, token = digits(codes[part])
            losses.append(self.gradient(context, token, (n[part] / n[part].sum()).astype(np.float32), room)[0])
            rate = RATE * (1 - 0.95 * (turn + step / steps) / MASKED)
            descend(flat, room.flat, first, second, pulls, rate * math.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        return losses


def trained(dealt: DataFrame, network: Network, turn: int, shards: int = 0) -> Network:
    """The average of the networks that a turn's shards of windows, as deal() returns them, make of one, by their numbers of
    windows: of FAN shards at a time, then of FAN such averages, until there is one. shards is their number, where known."""
    if not shards:
        shards = 1 + dealt.agg(F.max("shard")).first()[0]
    held = dealt.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def learn(shard: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            place = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # an order of its own, in any layout
            order = np.argsort(place)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0]))
            codes, n = codes[order[starts]], np.add.reduceat(n[order], starts)
            own = held.value.take(held.value.flat())
            own.fit(codes, n, turn)
            blocks = np.array_split(own.flat(), BLOCKS)
            return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int64()), pa.array([len(codes)] * BLOCKS, pa.int64()), pa.array(blocks, pa.list_(pa.float32()))], ["block", "shard", "n", "mean"])

        now, parts = None, []
        for batch in pieces(batches, 1 << 16):
            for shard, size, codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if parts and shard != now:
                    yield learn(now, parts)
                    parts = []
                now = shard
                parts.append((unpacked(codes.as_buffer(), size), unpacked(n.as_buffer(), size)))
        if parts:
            yield learn(now, parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block's sum over FAN shards, or groups of them, in their order.
        def mean(block: int, group: int, n: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([group], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32)], pa.list_(pa.float32()))], ["block", "shard", "n", "mean"])

        now, n, total = None, 0, 0.0
        for batch in pieces(batches, 64):
            for block, shard, more, values in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if n and now != (block, shard // FAN):
                    yield mean(*now, n, total)
                    n, total = 0, 0.0
                now, n, total = (block, shard // FAN), n + more, total + values.values.to_numpy() * np.float64(more)
        if n:
            yield mean(*now, n, total)

    kind, group = "block int, shard bigint, n bigint, mean array<float>", F.floor(F.col("shard") / FAN)
    learnt = dealt.select("shard", "size", "codes", "n").mapInArrow(run, kind)
    while shards > 1:
        learnt = learnt.repartition("block", group).sortWithinPartitions("block", "shard").mapInArrow(add, kind)
        shards = -(-shards // FAN)
    return network.take(np.concatenate([r["mean"] for r in sorted(learnt.collect(), key=lambda r: r["block"])]))


class Model(NamedTuple):
    vocabulary: list[str]
    network: Network
    totals: np.ndarray  # tokens of each symbol
    words: DataFrame  # (word, count) of the whole corpus


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Vocabulary, network and word counts of all texts; an untrained network where there is no word."""
    ship(docs.sparkSession)
    path = scratch(docs)
    word_counts(docs, text_col).write.parquet(path)
    words = docs.sparkSession.read.parquet(path)
    top = words.orderBy(F.desc("count"), "word").limit(VOCABULARY)
    counts = top.collect()
    totals = np.zeros(SYMBOLS, np.int64)
    totals[1 + CLASSES : 1 + CLASSES + len(counts)] = [r["count"] for r in counts]
    rare = words.join(F.broadcast(top.select("word")), "word", "left_anti").groupBy((1 + F.crc32(F.col("word").cast("binary")) % CLASSES).alias("symbol")).agg(F.sum("count").alias("n"))
    for r in rare.collect():
        totals[r["symbol"]] = r["n"]
    vocabulary, network = [r["word"] for r in counts], Network(totals)
    if tokens := int(totals.sum()):
        dealt = deal(windows(docs, text_col, vocabulary, MASKED, shard_count(tokens)), tokens)
        for turn, shards in sorted(dealt.groupBy("turn").agg(1 + F.max("shard")).collect()):
            network = trained(dealt.where(F.col("turn") == turn), network, turn, shards)
    return Model(vocabulary, network.rounded(), totals, words)


def scratch(docs: DataFrame) -> str:
    return f"{shared_dir(docs.sparkSession)}/kinweave-lm-{uuid.uuid4().hex}"


def least_of_head(words: DataFrame) -> int:
    """The least count of words of which there are HEAD at most with that count or a larger one, by a histogram with 16 bins
    to a doubling, about a thousand in all."""
    bins = words.groupBy(F.floor(F.log2("count") * 16).alias("bin")).agg(F.min("count").alias("least"), F.count("*").alias("n")).collect()
    least, n = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        n += r["n"]
        if n > HEAD:
            break
        least = r["least"]
    return least


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, log_likelihood (the sum of log p over the tokens, in nats), mean_log_likelihood.

    Texts that are null, empty or without a word have 0 tokens, log_likelihood 0 and a null mean. Texts are scored whole,
    rows independently; equal texts score equally; an empty table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    common = (F.col("count") >= least_of_head(model.words)) & (F.octet_length("word") <= LONGEST)
    head = {r["word"]: r["count"] for r in model.words.where(common).collect()}
    for w in model.vocabulary:
        head.pop(w, None)
    # Of each class log(1 + total), in units; 0 for the edge and the vocabulary, whose words are symbols.
    below = np.zeros(SYMBOLS, np.int64)
    below[1 : 1 + CLASSES] = np.round(np.log1p(model.totals[1 : 1 + CLASSES]) / UNIT)
    # Of each known word its symbol and log(count), in units; 0 for the vocabulary, and at the end for other words.
    known, of = [*model.vocabulary, *head], map(symbol_of(model.vocabulary), (w.encode() for w in [*model.vocabulary, *head]))
    above = [*[0] * len(model.vocabulary), *(round(math.log(n) / UNIT) for n in head.values()), 0]
    held = docs.sparkSession.sparkContext.broadcast((pa.array(known, pa.string()), np.array([*of], np.int64), np.array(above, np.int64), below, model.network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of, above, below, network = held.value

        def by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
            return np.diff(np.append(0, np.cumsum(values))[ends])

        for batch in pieces(batches, 512):
            words, counts = split(batch.column(2))
            at, token = symbols(words, known, of)
            ends, other = np.append(0, np.cumsum(counts)), at < 0
            p = np.round(network.log_p(around(token, counts)[0], token).astype(np.float64) / GRAIN).astype(np.int64)
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(other))[ends], pa.int32()), words.filter(pa.array(other)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(by_row(p, ends) * GRAIN), pa.array(by_row(above[at] - below[token], ends)), rest], ["row", id_col, "n_tokens", "symbols", "inside", "rest"])

    # Written once, so that a row's number is the same on both sides of the join.
    kind, path, row = docs.schema[id_col].dataType.simpleString(), scratch(docs), F.monotonically_increasing_id().alias("row")
    docs.select(row, id_col, text_col).mapInArrow(run, f"row bigint, `{id_col}` {kind}, n_tokens bigint, symbols double, inside bigint, rest array<string>").write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    # Words that training did not see have a count of 1, whose logarithm is 0.
    rare = model.words.where((F.col("count") > 1) & ~common).select("word", F.round(F.log("count") / UNIT).cast("long").alias("log"))
    more = rows.select("row", F.explode("rest").alias("word")).join(rare, "word").groupBy("row").agg(F.sum("log").alias("more"))
    total = F.col("symbols") + (F.col("inside") + F.coalesce("more", F.lit(0))) * UNIT
    scored = rows.drop("rest").join(more, "row", "left").select(id_col, "n_tokens", F.when(F.col("n_tokens") > 0, total).otherwise(0.0).alias("log_likelihood"))
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score() of all rows under the model trained on them."""
    return score(docs, train(docs, text_col), id_col, text_col)
