"""Approximate nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to ``m`` dimensions by Gaussian numbers, a 2-stable law: for a true distance ``d`` the squared
projected distance divided by ``d * d`` follows a chi-square law with ``m`` degrees of freedom. A search looks at its
projected neighbours from the nearest on, verifies their true distances, and stops as soon as the squared projected
distance of all that is left exceeds ``d_k^2`` times the chi-square quantile of ``confidence``, ``d_k`` being the k-th
best true distance so far: each neighbour nearer than that has been seen with at least that probability.

In Spark the tree has two parts. Its upper part, at most ``CELLS`` cells cut at medians of the projected coordinates, is
fitted to a sample of at most ``SAMPLE`` vectors (a bound that only balances the cells). Every vector is indexed in its
cell; cells with more than ``BLOCK`` vectors are dealt to several blocks, so copies of one vector spread over blocks.
The lower part is a kd-tree over each block, built in the task that searches it. Queries first search their own cell.
Their k-th distance and the measured box of each cell tell which other cells the stopping test leaves, and only those
are searched in a second step. The queries that visit a block are dealt to chunks of about ``QUERIES``, so neither side of
a group grows with the table; a block goes once to each chunk of its own queries, and nowhere if it has none.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are only compared
with those of the same length; equal distances go to the smaller id; a row with a null id takes no part; rows
that repeat an id are candidates of their own, but one query; an empty table gives an empty table. Other columns are not read, so names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocatio.llm.common import among_lowest, arrow_map
from vocatio.session import broadcast_if_small, written

DIMENSIONS = 8
CONFIDENCE = 0.98
CELLS = 256
CELL_ROWS = 4096
SAMPLE = 20_000
BLOCK = 32_768
QUERIES = 4096
LEAF = 128
SEED = 11
# Relative room for rounding in comparisons of projected distances.
SLACK = 1e-9


def chi_square_quantile(p: float, m: int) -> float:
    """The value below which a chi-square number of ``m`` (even) degrees of freedom lies with probability ``p``."""
    if m % 2:
        raise ValueError("the number of dimensions must be even")

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def directions(length: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length, m]).standard_normal((length, m))


def projected(vectors: np.ndarray, m: int, seed: int) -> np.ndarray:
    # einsum adds in the same order for every row, so equal vectors stay equal whatever stands beside them.
    return np.einsum("ij,jk->ik", vectors, directions(vectors.shape[1], m, seed))


class Cells:
    """Upper tree: split planes on the projected coordinates, as arrays in heap order."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.plane = np.zeros((1 << levels) - 1, int), np.zeros((1 << levels) - 1)
        parts = {0: sample}
        for node in range((1 << levels) - 1):
            part = parts.pop(node)
            if len(part):
                spread = part.max(axis=0) - part.min(axis=0)
                self.axis[node] = int(spread.argmax())
                self.plane[node] = float(np.median(part[:, self.axis[node]]))
            right = part[:, self.axis[node]] > self.plane[node] if len(part) else np.zeros(0, bool)
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(self.levels):
            right = points[np.arange(len(points)), self.axis[node]] > self.plane[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.levels) - 1)


class KdTree:
    """Lower tree over one block: leaves of about ``LEAF`` points with their boxes, cut at medians."""

    def __init__(self, points: np.ndarray):
        order, parts = np.arange(len(points)), []
        todo = [order]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                parts.append(part)
                continue
            own = points[part]
            axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
            half = len(part) // 2  # by position, so that equal points are cut too
            part = part[np.argpartition(own[:, axis], half)]
            todo += [part[:half], part[half:]]
        self.leaves = parts
        self.low = np.array([points[p].min(axis=0) for p in parts])
        self.high = np.array([points[p].max(axis=0) for p in parts])

    def nearest_first(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves in the order of the squared distance of their boxes, and these distances."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(far, kind="stable")
        return order, far[order]


def search_block(
    ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, starts: np.ndarray,
    bounds: np.ndarray, k: int, quantile: float,
) -> list[tuple[int, int, float]]:
    """(query, id, distance) of the best ``k`` of one block for each query; ``bounds`` are k-th distances known before."""
    tree, found = KdTree(points), []
    for q, query, start, bound in zip(query_ids, queries, starts, bounds):
        order, far = tree.nearest_first(start)
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        for leaf, gap in zip(order, far):
            reach = min(bound, best[-1] if len(best) == k else np.inf)
            if gap > quantile * reach * reach * (1 + SLACK) + SLACK:
                break
            rows = tree.leaves[leaf]
            rows = rows[ids[rows] != q]
            apart = vectors[rows] - query
            distances = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            near = distances <= reach
            best_ids, best = np.concatenate([best_ids, ids[rows][near]]), np.concatenate([best, distances[near]])
            top = np.lexsort((best_ids, best))[:k]
            best_ids, best = best_ids[top], best[top]
        found += [(int(q), int(i), float(d)) for i, d in zip(best_ids, best)]
    return found


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def dealt(items: DataFrame, asked: DataFrame, query_chunk: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``chunk``: the queries of a block (dim, cell, part) in chunks, the items of the block once for each.

    Blocks that no query visits have no chunk, so their items stay where they are; one that at most ``query_chunk``
    queries visit is copied once, whatever the number of queries in all.
    """
    block = ["dim", "cell", "part"]
    counted = asked.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / query_chunk).cast("int").alias("chunks"))
    # One small row for each block that is visited.
    chunks, _ = broadcast_if_small(written(counted, "visited"), F.lit(32))
    copies = items.join(chunks, block).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return copies.drop("chunks"), asked.join(chunks, block).withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("chunks")).cast("int")).drop("chunks")


def _matrix(lists: pd.Series) -> np.ndarray:
    return np.array(lists.tolist(), float)


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", m: int = DIMENSIONS,
    confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS, block: int = BLOCK, query_chunk: int = QUERIES, seed: int = SEED,
) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark, quantile = vectors.sparkSession, chi_square_quantile(confidence, m)
    base = written(usable(vectors, id_col, vector_col), "vectors")
    trees = {}
    for dim, n in base.groupBy("dim").count().collect():  # one row for each length of vectors
        own = base.filter(F.col("dim") == dim).select("v", F.xxhash64("id").alias("h"))
        sample = own.filter(among_lowest("h", SAMPLE, n)).orderBy("h").limit(SAMPLE).select("v").toPandas()
        levels = max(0, min(CELLS, n // cell_rows)).bit_length() - 1 if n >= cell_rows else 0
        trees[dim] = Cells(projected(_matrix(sample["v"]), m, seed), levels)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells, points = np.zeros(len(dims), np.int32), np.zeros((len(dims), m))
            flat = batch.column("v")
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows = flat.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                points[at] = projected(rows, m, seed)
                cells[at] = trees[int(dim)].of(points[at])
            made = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), m).cast(pa.list_(pa.float64()))
            columns = [batch.column("id"), batch.column("v"), batch.column("dim"), pa.array(cells), made]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "dim", "cell", "p"])

    placed = written(arrow_map(base, place, "id long, v array<double>, dim int, cell int, p array<double>"), "placed")
    # One row for each cell: at most CELLS for each length of vectors.
    sides = [f(F.get("p", F.lit(i))).alias(f"{name}{i}") for i in range(m) for name, f in (("low", F.min), ("high", F.max))]
    boxes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), *sides).toPandas()
    boxes["parts"] = (boxes["n"] + block - 1) // block
    low, high = (boxes[[f"{s}{i}" for i in range(m)]].to_numpy() for s in ("low", "high"))
    box_dim, box_cell, box_parts = (boxes[c].to_numpy() for c in ("dim", "cell", "parts"))
    # Rows that repeat a query's id are one query, that of the least vector.
    queries = placed.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "dim", "cell", "p")).alias("q")).select("id", "q.*")

    def visits(first: bool):
        """Blocks that a query searches: those of its own cell, or those of the others that its bound leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
                points = batch.column("p").flatten().to_numpy().reshape(-1, m)
                bounds = np.full(len(dims), np.inf) if first else batch.column("bound").to_numpy(zero_copy_only=False)
                rows, to_cell, to_part = [], [], []
                for i in range(len(dims)):
                    if first:
                        go = (box_dim == dims[i]) & (box_cell == cells[i])
                    else:
                        gap = np.maximum(np.maximum(low - points[i], points[i] - high), 0)
                        far = np.einsum("ij,ij->i", gap, gap)
                        go = (box_dim == dims[i]) & (box_cell != cells[i]) & ~(far > quantile * bounds[i] ** 2 * (1 + SLACK) + SLACK)
                    for b in np.flatnonzero(go):
                        for part in range(int(box_parts[b])):
                            rows.append(i)
                            to_cell.append(box_cell[b])
                            to_part.append(part)
                sent = batch.select(["id", "v", "dim", "p"]).take(pa.array(rows, pa.int64()))
                more = [pa.array(to_cell, pa.int32()), pa.array(to_part, pa.int32()), pa.array(bounds[rows] if rows else [], pa.float64())]
                yield pa.RecordBatch.from_arrays([*sent.columns, *more], names=["id", "v", "dim", "p", "cell", "part", "bound"])

        return run

    parts = {(int(d), int(c)): int(n) for d, c, n in zip(box_dim, box_cell, box_parts)}
    large = [x for (d, c), n in parts.items() if n > 1 for x in (F.lit(f"{d}/{c}"), F.lit(n))]
    of_cell = F.coalesce(F.try_element_at(F.create_map(*large), F.concat_ws("/", "dim", "cell")), F.lit(1)) if large else F.lit(1)
    items = placed.withColumn("part", F.pmod(F.xxhash64("id", "v"), of_cell).cast("int"))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            found = search_block(
                own["id"].to_numpy(), _matrix(own["v"]), _matrix(own["p"]), asked["id"].to_numpy(), _matrix(asked["v"]), _matrix(asked["p"]),
                asked["bound"].to_numpy(), k, quantile,
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    key = ["dim", "cell", "part", "chunk"]

    def step(asked: DataFrame, first: bool) -> DataFrame:
        sent = arrow_map(asked, visits(first), "id long, v array<double>, dim int, p array<double>, cell int, part int, bound double")
        own, sent = dealt(items, sent, query_chunk)
        return own.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")

    near = written(step(queries, True), "near")
    by_score = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = near.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = queries.join(kth.dropDuplicates(["query_id"]), F.col("id") == F.col("query_id"), "left").drop("query_id")
    bounded = bounded.withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    all_found = near.unionByName(step(bounded, False))
    ranked = all_found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
