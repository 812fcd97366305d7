"""Near duplicates by a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets (operator 2).

A set's signature is CHUNKS x WIDTH symbols of 16 bits, each the hash of one permutation's minimum; two sets of
similarity s differ in each symbol with probability 1 - s. By pigeonhole, signatures that differ in fewer than
CHUNKS * (ERRORS + 1) symbols have a chunk with at most ERRORS differing ones, so indexing every chunk under all choices
of its WIDTH - ERRORS remaining symbols brings every such pair together in a bucket. With 8 chunks of 5 and one error all
pairs that differ in up to 15 of 40 symbols meet for certain, and of any pair of similarity 0.8 all but two in 100,000.

Equal sets are one class, known by the set's digest, before anything is compared. Buckets join classes whose signatures
differ in at most NEAR symbols into clusters; inside a cluster links are then decided exactly on the full sets. Neither
step emits pairs. A group of bounded weight is one task's, which returns a star for each of its components. A larger one is
dealt into parts: each part's stars leave their centres, the centres are dealt again, and only what no centre has linked is
compared block by block. So a group of mutually near texts costs in proportion to its size, whatever that is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .base import BROADCAST_ROWS, cut, few, pieces, ship, turn
from .bpe import Memory
from .components import components

CHUNKS, WIDTH, ERRORS = 8, 5, 1
SYMBOLS = CHUNKS * WIDTH
#: Differing symbols up to which bucket mates are clustered: at similarity 0.8 more occur in one of ten million pairs.
NEAR = 22
#: Weight of a group that one task compares: signatures, or texts, one for every LIGHT shingles counting once more.
BUCKET_BLOCK, TEXT_BLOCK, LIGHT = 1024, 192, 5000

_draw = np.random.default_rng(20240229)
SALTS = _draw.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
FACTORS = _draw.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX, PRIME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
KEPT = list(combinations(range(WIDTH), WIDTH - ERRORS))


def word_hashes() -> Callable[[bytes], int]:
    return Memory(xxhash.xxh64_intdigest, 300_000).__getitem__


def shingles(text: str | None, n: int, word: Callable[[bytes], int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles of a text, A-Z lowered, split at ASCII white space; with fewer
    words, of the whole sequence."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word, words), np.uint64, len(words))
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[k : len(h) - n + 1 + k] * PRIME
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each set, none of which is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((flat ^ SALTS[k]) * FACTORS[k], starts)
        out[:, k] = ((least ^ (least >> np.uint64(29))) * MIX) >> np.uint64(48)
    return out


def keys(found: np.ndarray) -> np.ndarray:
    """Of each signature its keys, slot by slot: every chunk without every choice of ERRORS symbols."""
    out = np.empty((len(found), CHUNKS * len(KEPT)), np.int64)
    wide = found.astype(np.uint64)
    for c in range(CHUNKS):
        for j, kept in enumerate(KEPT):
            key = np.zeros(len(found), np.uint64)
            for s in kept:
                key = (key << np.uint64(16)) | wide[:, c * WIDTH + s] if len(kept) <= 4 else (key ^ wide[:, c * WIDTH + s]) * MIX
            out[:, c * len(KEPT) + j] = key.view(np.int64)
    return out


def centres(linked: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric boolean matrix the row of its component that most others are linked with."""
    out, degree = np.full(len(linked), -1), linked.sum(1)
    for seed in range(len(linked)):
        if out[seed] >= 0:
            continue
        waiting, members, queue = out < 0, [seed], [seed]
        waiting[seed] = False
        while queue:
            new = np.flatnonzero(linked[queue.pop()] & waiting)
            waiting[new] = False
            queue.extend(new.tolist())
            members.extend(new.tolist())
        out[members] = members[int(degree[members].argmax())]
    return out


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[dict[str, list]]:
    """Consecutive rows with equal first n_keys columns, as lists by column; partitions must be sorted by these."""
    held: list[list] | None = None
    names, last = [], None
    for batch in pieces(batches, 8192):
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        key = list(zip(*columns[:n_keys], strict=True))
        at = 0
        while at < len(key):
            end = at + 1
            while end < len(key) and key[end] == key[at]:
                end += 1
            part = [c[at:end] for c in columns]
            if held is not None and key[at] == last:
                for have, more in zip(held, part, strict=True):
                    have.extend(more)
            else:
                if held is not None:
                    yield dict(zip(names, held, strict=True))
                held, last = part, key[at]
            at = end
    if held is not None:
        yield dict(zip(names, held, strict=True))


def stars(df: DataFrame, by: list[str], link: Callable[[dict[str, list]], np.ndarray]) -> DataFrame:
    """(*by, big, a, b, w): b and w of every row's id and weight, a of the centre of its component within the group of by
    and part. Rows that are their own centre come only of groups marked big."""
    names = [*by, "part", "big", "id", "w", *[c for c in df.columns if c not in (*by, "part", "big", "id", "w")]]
    told_names = [*by, "big", "a", "b", "w"]
    kinds = [*[to_arrow_type(df.schema[c].dataType) for c in (*by, "big")], pa.binary(), pa.binary(), pa.int64()]
    batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], told_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in told_names]
        for g in groups(batches, len(by) + 2):
            n = len(g["id"])
            if n < 2 and not g["big"][0]:
                continue
            centre = centres(link(g)) if n > 1 else np.zeros(1, int)
            told = np.arange(n) if g["big"][0] else np.flatnonzero(centre != np.arange(n))
            for column, value in zip(out, [g[c][0] for c in (*by, "big")], strict=False):
                column.extend([value] * len(told))
            out[-3].extend(g["id"][centre[k]] for k in told)
            out[-2].extend(g["id"][k] for k in told)
            out[-1].extend(g["w"][k] for k in told)
            if len(out[-1]) > 50_000:
                yield batch_of(out)
                out = [[] for _ in out]
        if out[-1]:
            yield batch_of(out)

    schema = ", ".join([*[f"{c} {df.schema[c].dataType.simpleString()}" for c in (*by, "big")], "a binary, b binary, w bigint"])
    return df.select(*names).repartition(*by, "part").sortWithinPartitions(*by, "part").mapInArrow(run, schema)


def across(df: DataFrame, by: list[str], link: Callable[[dict[str, list]], np.ndarray]) -> DataFrame:
    """(a, b): links between rows of different root in groups of by, x, y; own tells of which of two blocks a row is. The
    links returned connect what all of them connect."""
    names = [*by, "x", "y", "own", "root", "id", *[c for c in df.columns if c not in (*by, "x", "y", "own", "root", "id")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, len(by) + 2):
            if len(g["id"]) < 2:
                continue
            root = np.unique(np.array(g["root"], object), return_inverse=True)[1]
            linked = link(g) & (root[:, None] != root)
            if g["x"][0] != g["y"][0]:  # pairs inside a block are another group's
                own = np.array(g["own"])
                linked &= own[:, None] != own
            centre = centres(linked)
            at = np.flatnonzero(centre != np.arange(len(centre)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([g["id"][centre[k]] for k in at], pa.binary()), pa.array([g["id"][k] for k in at], pa.binary())], ["a", "b"])

    return df.select(*names).repartition(*by, "x", "y").sortWithinPartitions(*by, "x", "y").mapInArrow(run, "a binary, b binary")


def links_within(members: DataFrame, payload: DataFrame, by: list[str], size: int, link: Callable[[dict[str, list]], np.ndarray]) -> DataFrame:
    """(a, b), edges that connect what the links within groups connect.

    members: (*by, id, w, total), a row's weight and its group's; payload: (id, ...), from which link() gets a matrix.
    """
    deal = lambda df, turn: df.withColumns({"big": F.col("total") > size, "part": F.when(F.col("total") > size, F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("total") / size))).otherwise(0).cast("int")}).drop("total")
    found = cut(stars(deal(members, 0).join(payload, "id"), by, link))
    rows, n = found.agg(F.count("*"), F.count(F.when(F.col("big"), 1))).first()
    found = few(found, rows)
    edges = found.where("a <> b").select("a", "b")
    if not n:
        return edges.distinct()
    # Groups too large for one task: centres are dealt again while that makes them fewer.
    held = cut(few(found.where("big").select(*by, F.col("b").alias("id"), "w", F.col("a").alias("root")), n))
    before = None
    for turn in range(1, 12):
        tops = few(held.groupBy(*by, "root").agg(F.max(F.when(F.col("id") == F.col("root"), F.col("w"))).alias("w")), n)
        totals = few(tops.groupBy(*by).agg(F.sum("w").alias("total"), F.count("*").alias("roots")).where("roots > 1"), n)
        again = cut(few(tops.join(totals, by), n).select(*by, F.col("root").alias("id"), "w", "total"))
        many, most = again.agg(F.count("*"), F.max("total")).first()
        if not many or before is not None and many > 0.7 * before:
            break
        before = many
        small = F.broadcast if many <= BROADCAST_ROWS else lambda x: x
        dealt = deal(again, turn).withColumn("big", F.lit(True))
        found = few(cut(stars(payload.join(small(dealt), "id"), by, link)), many)
        edges = edges.union(found.where("a <> b").select("a", "b"))
        moved = found.where("a <> b").select(*by, F.col("b").alias("root"), F.col("a").alias("to"))
        held = cut(few(held.join(small(moved), [*by, "root"], "left"), n).select(*by, "id", "w", F.coalesce("to", "root").alias("root")))
        if most <= size:
            break
    # What is left in groups of several roots: blocks of one large root each, and of small roots together.
    tops = few(held.groupBy(*by, "root").agg(F.sum("w").alias("m")), n)
    rest = few(tops.groupBy(*by).agg(F.count("*").alias("roots"), F.sum(F.when(F.col("m") < size, F.col("m")).otherwise(0)).alias("light")).where("roots > 1").drop("roots"), n)
    rest = cut(few(tops.join(rest, by), n))
    if rest.isEmpty():
        return edges.distinct()
    large = F.col("m") >= size
    block = F.struct(F.when(large, F.col("root")).alias("pure"), F.when(large, F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / size))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("light") / size))).cast("int").alias("k"))
    held = cut(few(held.join(rest, [*by, "root"]), n).select(*by, "id", "root", block.alias("block")))
    blocks = few(held.select(*by, "block").distinct(), n)
    x, y = blocks.withColumnRenamed("block", "x"), blocks.withColumnRenamed("block", "y")
    pairs = x.join(y, by).where("x <= y AND NOT (x.pure IS NOT NULL AND y.pure IS NOT NULL AND x.pure = y.pure)")
    sides = pairs.select(*by, "x", "y", F.explode(F.when(F.col("x") == F.col("y"), F.array("x")).otherwise(F.array("x", "y"))).alias("block"))
    numbered = lambda c: F.xxhash64(F.col(c)["pure"], F.col(c)["k"])
    copies = held.join(sides, [*by, "block"]).select(*by, numbered("x").alias("x"), numbered("y").alias("y"), numbered("block").alias("own"), "root", "id")
    return edges.union(across(copies.join(payload, "id"), by, link)).distinct()


def differing(g: dict[str, list]) -> np.ndarray:
    """Which signatures differ in at most NEAR symbols."""
    s = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(-1, SYMBOLS)
    same = np.zeros((len(s), len(s)), np.uint8)
    for k in range(SYMBOLS):
        same += s[:, k, None] == s[:, k]
    return same >= SYMBOLS - NEAR


def similar(n: int, percent: int) -> Callable[[dict[str, list]], np.ndarray]:
    """Which texts' full shingle sets have 100 * intersection >= percent * union."""
    word = None

    def link(g: dict[str, list]) -> np.ndarray:
        nonlocal word
        word = word or word_hashes()
        sets = [shingles(t, n, word) for t in g["text"]]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = df[column] > 1
        column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
        both = np.zeros((len(sets), len(sets)), np.float64)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        width = max(256, 4_000_000 // len(sets))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [at, at + width])
            m = np.zeros((len(sets), int(column[hi - 1]) - at + 1), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            both += m @ m.T
        return 100 * both >= percent * (sizes[:, None] + sizes - both)

    return link


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their sets of n-word shingles; component_id is the
    smallest id reachable over links, the own one included, and kept tells whether it is the own one. Null, empty and
    wordless texts have empty sets and no links. Rows without an id are linked with nothing: component_id null, kept
    true. Every row is a document of its own: rows of one id with different texts have each the links of their text, and
    aren't linked by the id; rows that repeat id and text get the same answer each. ids may be of any type that has an
    order. An empty table gives an empty one; columns other than id and text are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("hash"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("neardup")
        word = word_hashes()
        for batch in pieces(batches, 256, 4 << 20):
            sets = [shingles(t.as_py(), n, word) for t in batch.column(2)]
            full = [k for k, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            if full:
                for k, s in zip(full, signatures([sets[k] for k in full]), strict=True):
                    sig[k] = s.tobytes()
            digest = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["id", "hash", "n", "digest", "sig"])

    rows = cut(texts.mapInArrow(describe, f"id {kind}, hash binary, n bigint, digest binary, sig binary"))
    worded = rows.where("n > 0 AND id IS NOT NULL")
    classes = worded.groupBy("digest").agg(F.min(F.struct("id", "hash", "sig", "n")).alias("x"), F.count("*").alias("rows"))
    classes = cut(classes.select("digest", "x.id", "x.hash", "x.sig", "x.n", "rows"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            if not batch.num_rows:
                continue
            found = keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "keys"])

    signed = classes.select(F.col("digest").alias("id"), "sig")
    indexed = signed.mapInArrow(index, "id binary, keys array<bigint>").select("id", F.posexplode_outer("keys").alias("slot", "key")).where("key IS NOT NULL")
    # Partial aggregation counts a bucket before it is joined; a bucket of one class is gone then.
    shared = indexed.groupBy("slot", "key").agg(F.count("*").alias("total")).where("total > 1")
    mates = indexed.join(shared, ["slot", "key"]).withColumn("w", F.lit(1).cast("long"))
    clusters = cut(components(links_within(mates, signed, ["slot", "key"], BUCKET_BLOCK, differing)).select("id", F.col("component").alias("cluster")))
    n_held = clusters.count()
    near = F.broadcast if n_held <= BROADCAST_ROWS else lambda x: x

    # Texts stay where they are but for those of clusters, one row of each class.
    weighed = cut(few(classes.select(F.col("digest").alias("id"), F.col("id").alias("own"), "hash", (1 + F.floor(F.col("n") / LIGHT)).alias("w")).join(near(clusters), "id"), n_held))
    total = few(weighed.groupBy("cluster").agg(F.sum("w").alias("total")), n_held)
    wanted = weighed.select("hash", F.col("own").alias("id"), F.col("id").alias("of"))
    first = cut(texts.join(near(wanted), ["id", "hash"]).select("of", "text").groupBy("of").agg(F.first("text").alias("text")).withColumnRenamed("of", "id"))
    members = weighed.select("id", "cluster", "w").join(near(total), "cluster")
    links = links_within(members, first, ["cluster"], TEXT_BLOCK, similar(n, percent))
    linked = components(links).select(F.col("id").alias("digest"), F.col("component").alias("root"))
    of_root = few(weighed.select(F.col("id").alias("digest"), "own").join(near(linked), "digest"), n_held)
    of_root = few(of_root.groupBy("root").agg(F.min("own").alias("component")), n_held)
    linked = cut(few(linked.join(near(of_root), "root"), n_held).select("digest", "component"))
    # A class of one row without links needs no join: its component is its own id.
    merged = classes.where("rows > 1").select("digest", F.col("id").alias("component")).join(near(linked.select("digest")), "digest", "left_anti")
    of_class = cut(linked.unionByName(merged))
    found = worded.join(F.broadcast(of_class) if of_class.count() <= BROADCAST_ROWS else of_class, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    out = found.unionByName(rows.where("NOT (n > 0 AND id IS NOT NULL)").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
