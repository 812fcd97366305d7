"""Nearest neighbours by inner product over several shifted Hilbert orderings (operator 5).

Vectors are lifted to one norm, which turns the largest inner product into the smallest distance. Each of CURVES orderings
projects them by its own rotation, shifts its own grid and sorts them along the Hilbert curve through the cells; Spark
range-partitions and sorts the keys, and a row's place in an ordering is its rank. A query is compared, on the original
vectors, with all rows whose rank lies within a window around its own in any ordering, and the windows' best are merged.

How wide a window must be depends on the vectors. Up to SAMPLE queries, chosen by a hash, are answered by brute force over
all rows, and the narrowest window that finds RECALL of their neighbours is taken; so much of the index is fitted on a
bounded sample, as are the grids (GRID_SAMPLE rows). Every row is in every ordering.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, pieces, ship

CURVES, DIMS, BITS = 8, 12, 4
SAMPLE, GRID_SAMPLE, RECALL = 160, 4096, 0.96
BLOCK, QUERIES_AT_ONCE = 4096, 2048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of grid cells, a row of coordinates below 2**bits each; after Skilling (2004)."""
    x = cells.astype(np.uint64).T.copy()
    one, q = np.uint64(1), np.uint64(1 << (bits - 1))
    while q > one:
        low = q - one
        for i in range(len(x)):
            swap = (x[0] ^ x[i]) & low
            high = (x[i] & q) != 0
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
        q >>= one
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > one:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - one), turn)
        q >>= one
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            out = (out << one) | ((row >> np.uint64(b)) & one)
    return out.view(np.int64)


class Curves:
    """Rotations, grids and shifts; fitted on lifted vectors."""

    def __init__(self, lifted: np.ndarray, curves: int, dims: int, bits: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        width = lifted.shape[1]
        dims = min(dims, width)
        self.bits = bits
        self.turns, self.low, self.span = [], [], []
        for _ in range(curves):
            turn = np.linalg.qr(draw.normal(size=(width, width)))[0][:, :dims]
            at = lifted @ turn
            low, high = np.quantile(at, [0.005, 0.995], axis=0)
            span = np.maximum((high - low).max(), 1e-12)
            self.turns.append(turn)
            self.low.append(low - draw.random(dims) * span * 0.5)
            self.span.append(span * 1.5)

    def keys(self, lifted: np.ndarray) -> np.ndarray:
        out = [hilbert(np.clip((lifted @ t - low) / span * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64), self.bits) for t, low, span in zip(self.turns, self.low, self.span, strict=True)]
        return np.stack(out, axis=1)


def length(m: np.ndarray) -> np.ndarray:
    """Norms of the rows, none of which is zero, without overflow on the way."""
    top = np.abs(m).max(1)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((m / top[:, None]) ** 2).sum(1))


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, width)


def best(queries: np.ndarray, ids: list, rows: np.ndarray, row_ids: np.ndarray, k: int, allowed: np.ndarray | None = None, least: np.ndarray | None = None) -> Iterator[tuple]:
    """(query id, row id, score) of the k best rows of each query, ties to the smaller id, without those that fall short
    of the query's least score. Scores are summed for each pair alone, so that equal vectors score equally wherever they
    stand. A product may overflow to an infinity, which counts as such; one without a value, infinity less infinity, is
    no candidate."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ rows.T
        for i, own in enumerate(ids):
            fine = row_ids != own if allowed is None else allowed[i] & (row_ids != own)
            # Large products may overflow in one order of summation and not in another: only the exact score tells then.
            loose = ~np.isfinite(rough[i])
            if least is not None:
                fine &= loose | (rough[i] >= least[i] - 1e-9 * (1 + abs(least[i]))) | ~np.isfinite(least[i])
            at = np.flatnonzero(fine & ~loose)
            if len(at) > k:
                kth = np.partition(rough[i, at], len(at) - k)[len(at) - k]
                at = at[rough[i, at] >= kth - 1e-9 * (1 + abs(kth))]
            at = np.concatenate([at, np.flatnonzero(fine & loose)])
            score = (rows[at] * queries[i]).sum(axis=1)
            at, score = at[~np.isnan(score)], score[~np.isnan(score)]
            for j in np.lexsort((row_ids[at], -score))[:k]:
                yield own, row_ids[at[j]], float(score[j])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v holds the components as 8-byte numbers."""
    whole = F.col(vector_col).cast("array<double>")
    odd = F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), whole.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            flat = np.asarray(batch.column(1).flatten()).tobytes()
            ends = 8 * np.cumsum([0, *[len(x) for x in batch.column(1)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["id", "v"])

    return rows.mapInArrow(pack, f"id {kind}, v binary").groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, curves: int = CURVES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query row, all others being candidates.

    Nearness is the inner product in double precision, the largest first, ties to the smaller id. Rows with a null id or
    a vector that is null, empty, zero or holds null or non-finite components take no part, nor do vectors of another
    length than most; pairs whose product has no value (infinity less infinity) aren't ranked. Of rows repeated under one
    id one counts. With k candidates or fewer all are returned; without
    queries or rows nothing is. Columns other than id and vector are not read, unless is_query does.
    """
    spark = vectors.sparkSession
    ship(spark)
    queries_of = vectors.where(is_query).select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct().withColumn("asks", F.lit(True))
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    sizes = rows.groupBy(F.octet_length("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    empty = spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    if sizes is None:
        return empty
    width = sizes["n"] // 8
    rows = cut(rows.where(F.octet_length("v") == sizes["n"]).join(queries_of, "id", "left").select("id", "v", F.coalesce("asks", F.lit(False)).alias("asks")))
    total, asking = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    if not asking:
        return empty
    hashed = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = lambda wanted, of: hashed < int(min(1.0, 1.3 * wanted / of) * (1 << 30))
    grid = matrix([r["v"] for r in rows.where(share(GRID_SAMPLE, total)).orderBy(hashed, "id").limit(GRID_SAMPLE).select("v").collect()] or [rows.first()["v"]], width)
    asked = rows.where("asks").where(share(SAMPLE, asking)).orderBy(hashed, "id").limit(SAMPLE).select("id", "v").collect() or rows.where("asks").orderBy("id").limit(1).select("id", "v").collect()

    # Norms: the largest lifts all rows to one sphere; queries lie on its equator.
    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            if batch.num_rows:
                m = matrix(batch.column(0).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([pa.array([float(length(m).max())])], ["norm"])

    most = min(rows.select("v").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0], np.finfo(float).max)
    lift = lambda m: np.hstack([m / most, np.sqrt(np.maximum(1 - ((m / most) ** 2).sum(1, keepdims=True), 0))])
    flat = lambda m: np.hstack([unit(m), np.zeros((len(m), 1))])
    index = spark.sparkContext.broadcast(Curves(lift(grid), curves, DIMS, BITS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            if not batch.num_rows:
                continue
            m, asks, names = matrix(batch.column(1).to_pylist(), width), np.asarray(batch.column(2)), batch.column(0).to_pylist()
            for query in (False, True):
                at = np.flatnonzero(asks) if query else np.arange(len(m))
                if not len(at):
                    continue
                found = index.value.keys((flat if query else lift)(m[at]))
                ids = pa.array([names[i] for i in at], batch.schema.types[0])
                for c in range(found.shape[1]):
                    yield pa.RecordBatch.from_arrays([ids, pa.array([query] * len(at)), pa.array([c] * len(at), pa.int32()), pa.array(found[:, c])], ["id", "query", "curve", "key"])

    placed = rows.mapInArrow(place, f"id {kind}, query boolean, curve int, key bigint")
    ordered = cut(placed.repartitionByRange("curve", "key", "id", "query").sortWithinPartitions("curve", "key", "id", "query")).withColumn("row", F.monotonically_increasing_id())
    part, within = F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(ordered.groupBy(part).count().collect())  # a number for each partition
    before = np.cumsum([0, *[r["count"] for r in counts]])
    offsets = spark.createDataFrame([(int(r["part"]), int(b)) for r, b in zip(counts, before, strict=False)], "part bigint, before bigint")
    in_curve = total + asking
    ranks = ordered.join(F.broadcast(offsets), F.shiftright("row", 33) == F.col("part")).select("id", "query", "curve", (F.col("before") + within - F.col("curve") * F.lit(in_curve)).alias("rank"))

    # Brute force for the sample, over all rows, a batch at a time.
    sample_ids, sample = [r["id"] for r in asked], matrix([r["v"] for r in asked], width)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8192):
            if batch.num_rows:
                found = [*best(sample, sample_ids, matrix(batch.column(1).to_pylist(), width), np.array(batch.column(0).to_pylist()), k)]
                columns = [*zip(*found, strict=True)] or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([getattr(x, "tolist", lambda x=x: x)() for x in c], t) for c, t in zip(columns, (batch.schema.types[0], batch.schema.types[0], pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = rows.select("id", "v").mapInArrow(exact, schema).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "vec_id")
    own = ranks.where("query").select(F.col("id").alias("query_id"), F.col("curve").alias("own_curve"), F.col("rank").alias("own_rank"))
    apart = truth.join(own, "query_id").join(ranks.where("NOT query"), (F.col("vec_id") == F.col("id")) & (F.col("curve") == F.col("own_curve")))
    apart = apart.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("rank") - F.col("own_rank"))).alias("apart"))
    needed = np.sort([r["apart"] for r in apart.select("apart").collect()])  # at most SAMPLE * k numbers
    window = max(int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 0, 4 * k)

    # Windows meet blocks of ranks; queries that many windows bring to a block come in groups of bounded size. The blocks
    # in which queries themselves stand come first: what they find bounds what other blocks need to return.
    at_block = max(1, asking * min(in_curve, 2 * window + BLOCK) // max(1, in_curve))
    parts = -(-at_block // QUERIES_AT_ONCE)
    block = lambda c: F.floor(c / BLOCK).cast("int")
    salt = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    own_block, rank = block(F.col("rank")), F.col("rank")
    data = ranks.where("NOT query").select("id", "curve", "rank", own_block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    data = data.join(rows.select("id", "v"), "id")
    reached = F.sequence(block(F.greatest(rank - window, F.lit(0))), block(F.least(rank + window, F.lit(in_curve - 1))))
    asks = ranks.where("query").select(F.col("id").alias("asks_id"), F.col("curve").alias("in_curve"), F.col("rank").alias("asks_rank"), own_block.alias("home"), F.explode(reached).alias("in_block"), salt.alias("in_part"))
    asks = asks.join(rows.where("asks").select(F.col("id").alias("asks_id"), F.col("v").alias("asks_v")), "asks_id")

    def compare(data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asks):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])  # without a type, as ids may be strings
        d, q, least = matrix(data["v"], width), matrix(asks["asks_v"], width), asks["least"].to_numpy()
        near = np.abs(asks["asks_rank"].to_numpy()[:, None] - data["rank"].to_numpy()) <= window
        return pd.DataFrame([*best(q, asks["asks_id"].tolist(), d, data["id"].to_numpy(), k, near, least)], columns=["query_id", "vec_id", "score"])

    def search(asks: DataFrame) -> DataFrame:
        found = data.groupBy("curve", "block", "part").cogroup(asks.groupBy("in_curve", "in_block", "in_part")).applyInPandas(compare, schema)
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    home = cut(search(asks.where("in_block = home").withColumn("least", F.lit(float("-inf")))))
    bound = home.withColumn("rank", F.row_number().over(top)).where(F.col("rank") == k).select(F.col("query_id").alias("asks_id"), F.col("score").alias("least"))
    away = search(asks.where("in_block <> home").join(bound, "asks_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    found = home.unionByName(away).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
