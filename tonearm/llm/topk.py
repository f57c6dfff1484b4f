"""Exact top-k search by vector-approximation files.

1. Vectors of integers get one byte for each component: the number of the quantised cell that it lies in. Blocks of these
   are the approximation file, a table of its own; exact vectors stay in theirs.
2. Every block of queries scans the file once, block after block. Cells bound each inner product from below and above; the
   k-th best lower bound so far is carried along, and what can't reach it is dropped at once. Long files are scanned in
   spans at a time, whose bounds are put together afterwards.
3. The exact vectors of what is left are read in the order of the bounds: first 2k for each query; of the rest only those
   whose upper bound still reaches the k-th exact score. Then the result is certain.

Of equal vectors only the k + 1 smallest ids are candidates: others can't be among the k best of any query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_saved, saved

#: Queries of a block: a 64th of them, between these. Vectors of a block of the file, blocks of a span, vectors compared at a time.
QUERY_BLOCK, CELL_BLOCK, SPAN, SUB = (512, 4096), 16384, 64, 2048
#: A cell is as wide as the range of all components over 2 ** CELL_BITS, rounded up to a power of two. At most 8.
CELL_BITS = 6
#: Parts of a group of equal vectors that are thinned out by themselves first.
SALTS = 8

#: The largest squared length of an integer vector times its dimension: products with any cell, and their sums, then are longs.
LARGEST = 2.0**60

LEAST = np.iinfo(np.int64).min // 2
FILE = "dim int, block int, rows binary, ids binary, data binary"


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as double. Null keys, vectors that are null, empty or hold a null or non-finite component, and those that LARGEST is too small for are left out."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & finite)
    grown = lambda x: F.abs(x.cast("double") * scale) + 1  # noqa: E731  a component that is floored may grow by one
    rows = rows.where(F.aggregate("e", F.lit(0.0), lambda a, x: a + grown(x) * grown(x)) * F.size("e") <= LARGEST)
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def thinned(vectors: DataFrame, most: int) -> DataFrame:
    """The `most` rows of smallest ids of each group of equal vectors; large groups are cut down in parts before they meet."""
    out = vectors.withColumn("_s", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    for by in (("v", "_s"), ("v",)):
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id", "row"))).where(F.col("_r") <= most)
    return out.drop("_s", "_r")


def blocks(vectors: DataFrame, n: int, low: int | None = None, width: int = 1) -> DataFrame:
    """One row for each block (by a hash of the row) and dimension: row numbers, ids, and cells (with low) or exact vectors as bytes."""

    def pack(group: pa.Table) -> pa.Table:
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        data = flat if low is None else ((flat - low) // width).astype(np.uint8)
        rows, ids = (group.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id"))
        one = {"rows": rows.tobytes(), "ids": ids.tobytes(), "data": data.tobytes()}
        return pa.table({"dim": pa.array([len(flat) // len(ids)], pa.int32()), "block": group.column("block")[:1].cast(pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in one.items()}})

    return vectors.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")}).groupBy("dim", "block").applyInArrow(pack, FILE)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly (modulo 2**64): in floats as long as they hold every sum."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class Scan:
    """One block of queries on its way through the file."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, low: int, width: int):
        self.rows, self.ids, self.q, self.k, self.low, self.width = rows, ids, q, k, low, width
        self.base = (width - 1) * np.minimum(q, 0).sum(1)
        self.slack = (width - 1) * np.abs(q).sum(1)
        self.best = np.full((len(q), k), LEAST)  # the k best lower bounds of each query
        self.bar = np.full(len(q), LEAST)
        self.held: list[tuple[np.ndarray, ...]] = []  # query, row, id, lower bound
        self.n = 0

    def look(self, rows: np.ndarray, ids: np.ndarray, cells: np.ndarray) -> None:
        for at in range(0, len(ids), SUB):
            some = slice(at, at + SUB)
            lower = product(self.q, cells[some].astype(np.int64) * self.width + self.low) + self.base[:, None]
            own = self.ids[:, None] == ids[None, some]
            lower[own] = LEAST
            both = np.concatenate([self.best, lower], axis=1)
            self.best = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            self.bar = self.best.min(1)
            i, j = np.nonzero((lower + self.slack[:, None] >= self.bar[:, None]) & ~own)
            self.held.append((i, rows[some][j], ids[some][j], lower[i, j]))
            self.n += len(i)
            if self.n > 8 * self.k * len(self.q):
                self._thin()

    def _thin(self) -> None:
        i, row, near, lower = (np.concatenate(c) for c in zip(*self.held, strict=True))
        able = lower + self.slack[i] >= self.bar[i]
        self.held, self.n = [(i[able], row[able], near[able], lower[able])], int(able.sum())

    def left(self) -> pa.RecordBatch:
        """What may still be among the k best: q_row, row, vec_id, lower, upper."""
        if self.held:
            self._thin()
        i, row, near, lower = self.held[0] if self.held else (np.zeros(0, np.int64),) * 4
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (self.rows[i], row, near, lower, lower + self.slack[i])], names=["q_row", "row", "vec_id", "lower", "upper"])


def scanned(queries: DataFrame, cells: DataFrame, q_blocks: int, c_blocks: int, k: int, low: int, width: int) -> DataFrame:
    """What the scan of the file leaves: q_row, row, vec_id, lower, upper. A task holds one block of queries and one of cells at a time."""
    spans, span = -(-c_blocks // SPAN), SPAN
    asked = queries.select("dim", F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(spans - 1))).alias("span"), F.lit(-1).alias("c_block"), "rows", "ids", "data")
    file = cells.select("dim", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), F.floor(F.col("block") / span).cast("int").alias("span"), F.col("block").alias("c_block"), "rows", "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan = None, None
        for batch in batches:
            for r in batch.to_pylist() if batch.num_rows < 2 else (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                rows, ids = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids"))
                if r["c_block"] < 0:
                    if scan:
                        yield scan.left()
                    now = (r["dim"], r["q_block"], r["span"])
                    scan = Scan(rows, ids, np.frombuffer(r["data"], np.int64).reshape(-1, r["dim"]), k, low, width)
                elif now == (r["dim"], r["q_block"], r["span"]):  # else: no queries of this dimension in the block
                    scan.look(rows, ids, np.frombuffer(r["data"], np.uint8).reshape(-1, r["dim"]))
        if scan:
            yield scan.left()

    by = ("dim", "q_block", "span")
    dealt = asked.unionByName(file).repartition(min(4096, q_blocks * spans), *by).sortWithinPartitions(*by, "c_block")
    return dealt.mapInArrow(run, "q_row long, row long, vec_id long, lower long, upper long")


def top_k(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest integer inner products.

    Queries: the rows whose key is divisible by `every`; candidates: every row but those with the query's own key, of
    the same dimension. Ties go to the smaller vec_id; with fewer than k candidates, all are returned. Rows that repeat a
    key and its vector are one query, but each is a candidate; a key with several vectors is several queries. Vectors that
    are null, empty or hold null or non-finite components take no part, nor do those whose squared length in integers, times their
    dimension, is above 2 ** 60 (64 components of 2 million each), as scores might be no longs. An empty table gives an empty result. Extra
    columns are not read.
    """
    vectors = saved(integer_vectors(df, key, vector, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = saved(vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.min("row").alias("row")), "queries")
    one = vectors.agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    n_queries = asked.count()
    if not n_queries:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = max(QUERY_BLOCK[0], min(QUERY_BLOCK[1], n_queries // 64))
    q_blocks, c_blocks = -(-n_queries // size), -(-one["n"] // CELL_BLOCK)
    low, width = int(one["low"]), 1 << max(0, (-(-(one["high"] - one["low"] + 1) // (1 << CELL_BITS)) - 1).bit_length())
    cells = saved(blocks(thinned(vectors, k + 1), c_blocks, low, width), "cells")
    left = saved(scanned(blocks(asked, q_blocks), cells, q_blocks, c_blocks, k, low, width), "able")
    drop_saved(cells)
    order = Window.partitionBy("q_row").orderBy(F.desc("lower"), "vec_id", "row")
    if c_blocks > SPAN:  # the spans' bounds together
        bars = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("q_row").agg(F.when(F.count("*") == k, F.min("lower")).alias("bar"))
        left = left.join(bars, "q_row").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar"))).drop("bar")

    def exactly(pairs: DataFrame) -> DataFrame:
        """Pairs with the inner products of their exact vectors."""
        met = pairs.join(vectors.select("row", "v"), "row").join(asked.select(F.col("row").alias("q_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "q_row")
        score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x)
        return met.select("q_row", "query_id", "vec_id", score.alias("score"))

    if width == 1:  # the cells hold the vectors whole: nothing but the k best and their ties is left
        read = exactly(left)
    else:
        ranked = left.withColumn("r", F.row_number().over(order))
        first = saved(exactly(ranked.where(F.col("r") <= 2 * k)), "read")
        best = Window.partitionBy("q_row").orderBy(F.desc("score"))
        bars = first.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("q_row").agg(F.when(F.count("*") == k, F.min("score")).alias("bar"))
        rest = ranked.where(F.col("r") > 2 * k).join(bars, "q_row").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar"))).select(*left.columns)
        read = first.unionByName(exactly(rest))
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return read.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
