"""Vector retrieval: exact and cell-probed top-k, ranks, re-ranking, recall.

Scores are inner products in double precision, quantised to six decimals; ties go to the smaller
id. No plan here pairs every query with every item as rows: whole blocks of vectors are multiplied
inside a task and only the best ``k`` of each block leave it.

Three physical forms give the same rows:

* the item side fits the broadcast limit: each query row finds its final top-k on the spot;
* the query side fits: items stay where they are. The best ``k`` of a sample of the items give each query
  a bar that its ``k`` best of all must reach; each task emits only what reaches it, and one shuffle of
  those candidates merges them;
* neither fits: both sides are cut into blocks around pivots. A pair of blocks is multiplied only if the best score
  that it can hold, by the distances of its vectors from their pivots, reaches the ``k`` best that the nearest blocks
  have given. Blocks meet over a shuffle: a task holds some blocks of queries, as many as have room with their results,
  and the items that may matter to them stream past. So memory does not depend on the tables, items are sent once for
  each such stripe of queries, not for each block, and a task returns no more than ``k`` rows a query. Of the tables
  only pivots and one row of bounds a block pass the driver.

Vectors that are null, hold null or non-finite components, or are not of the table's usual size take no part;
:func:`rejected_vectors` counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.hashing import draw
from vocatio.functions.vectors import is_finite
from vocatio.session import broadcast_if_small, written

SCALE = 1_000_000
# Vectors that a task holds at once, as doubles: each Python worker has them, several times while they are read.
BLOCK_BYTES = 16 * 1024 * 1024
# Results that a task holds at once; with many for each query it holds fewer queries.
RESULTS_AT_ONCE = 500_000
# Vectors of items that stream past the queries of one task, as doubles; more are dealt to several tasks.
STREAM_BYTES = 256 * 1024 * 1024
# Blocks around pivots: the smaller they are, the closer their bounds.
PIVOT_BLOCK_BYTES = 4 * 1024 * 1024
# Scores computed in one go, few enough to stay in a core's cache, and items they are computed for.
SCORES_AT_ONCE = 500_000
ITEMS_AT_ONCE = 2_048
# Vectors up to this length are compared in single precision first; products of components below TINY may vanish there.
LONGEST_IN_SINGLE = 1e15
TINY = 1e-30
# Components of pairs whose scores are taken anew at once.
COMPONENTS_AT_ONCE = 1_000_000
# Bytes of item ids that may gather before those of items that lost their place are dropped.
ID_BYTES = 8 * 1024 * 1024
# Items that the bars are taken from: the more, the fewer candidates leave the tasks; any number gives the same rows.
BAR_ITEMS = 50_000
# Cells of one level. More are trained in groups, each vector against the centres of its group alone.
FLAT_CELLS = 2_048
# Vectors for each cell that groups are fitted on, drawn by a hash; a table with fewer is taken whole.
ROWS_PER_CELL = 256
# Groups whose cells are looked at for a vector, at least: the nearest centre may lie beyond the border of a group.
NEAR_GROUPS = 4
# Pivots that blocks lie around; more of them give closer bounds and cost a comparison more for each vector.
PIVOTS = 256


def _arrow_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as one double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(scores: np.ndarray) -> np.ndarray:
    """Scores in whole units of 1e-6."""
    return np.floor(scores * SCALE + 0.5)


class _Leaders:
    """The best ``k`` items so far of each query of a block.

    Once a query has ``k`` items, its lowest score is a bar that most later items fail in one
    comparison; only those that reach it are sorted, by score and then by id. The comparison is made in
    single precision with a bound on its error, unless vectors are too long for that; scores that may
    reach the bar are taken anew in double precision.

    A result is 16 bytes, a row, a number and a score: ids, which may be long, are held once for all queries and under
    their numbers. Those that wait to be sorted are half as many as are kept, or as SCORES_AT_ONCE, and those of one step.
    """

    def __init__(self, queries: np.ndarray, k: int, bar: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.lengths = np.linalg.norm(queries, axis=1)
        self.short = not len(queries) or self.lengths.max() < LONGEST_IN_SINGLE
        self.rough = queries.astype(np.float32) if self.short else queries
        self.bar = np.full(len(queries), -np.inf) if bar is None else bar.copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0
        # Ids of items that have a result, by their numbers, and their bytes, now and when they were last looked through.
        self.ids: list[pa.Array] = []
        self.n_ids = self.id_bytes = self.id_bytes_kept = 0

    def offer(self, items: np.ndarray, ids: pa.Array | np.ndarray, among: np.ndarray | None = None) -> None:
        """``among``: the rows of the queries that the items may matter to, all without it."""
        among = np.arange(len(self.queries)) if among is None else among
        n, ids = len(items), ids if isinstance(ids, pa.Array) else pa.array(ids)
        for at in range(0, n, ITEMS_AT_ONCE):
            self._offer(items[at : at + ITEMS_AT_ONCE], ids[at : at + ITEMS_AT_ONCE], among)

    def _offer(self, items: np.ndarray, ids: pa.Array, among: np.ndarray) -> None:
        n, k, first = len(items), self.k, None
        step, longest = max(1, SCORES_AT_ONCE // n), np.linalg.norm(items, axis=1).max()
        single = self.short and longest < LONGEST_IN_SINGLE
        queries, rough = (self.rough, items.astype(np.float32)) if single else (self.queries, items)
        # A product of single precision is off by no more than this share of the lengths.
        error = (items.shape[1] + 4) * 2.0**-23 * longest if single else 0.0
        for start in range(0, len(among), step):
            asked = among[start : start + step]
            scores = queries[asked] @ rough.T
            bar, off = self.bar[asked], error * self.lengths[asked] + (TINY if single else 0.0)
            new = np.isneginf(bar)
            if n > k and new.any():
                # One unit less, since these scores are rounded otherwise than those of single pairs.
                bar[new] = _units(np.partition(scores[new], n - k, axis=1)[:, n - k].astype(np.float64) - off[new]) - 1
                self.bar[asked] = bar
            # A little below the bar, so that rounding keeps every item that may reach it.
            least = (bar - 0.5 - 1e-3) / SCALE - off
            if single:
                least = (least - 2.0**-22 * np.where(np.isinf(least), 0.0, np.abs(least))).astype(np.float32)
            near = np.flatnonzero(scores >= least[:, None])
            rows, cols = np.divmod(near, n)
            units = self._exact(asked[rows], items, cols)
            kept = units >= bar[rows]
            rows, cols, units = rows[kept], cols[kept], units[kept]
            if not len(rows):
                continue
            if first is None:
                first = self._numbered(ids)
            self.parts.append((asked[rows].astype(np.int32), (first + cols).astype(np.int32), units))
            self.pending += len(rows)
            if self.pending > max(SCORES_AT_ONCE, k * len(self.queries)) // 2 or self.id_bytes > ID_BYTES + 2 * self.id_bytes_kept:
                self._sort()
                first = None  # numbers are given anew

    def _numbered(self, ids: pa.Array) -> int:
        """The number of the first of the ids; they are copied, since a slice would hold the vectors of its batch."""
        first, own = self.n_ids, ids.take(pa.array(np.arange(len(ids))))
        self.ids.append(own)
        self.n_ids, self.id_bytes = first + len(own), self.id_bytes + own.nbytes
        return first

    def _exact(self, rows: np.ndarray, items: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Units of the scores of single pairs, added up in one order whatever the shape of the blocks was."""
        units, step = np.empty(len(rows)), max(1, COMPONENTS_AT_ONCE // max(1, items.shape[1]))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            units[part] = _units(np.einsum("ij,ij->i", self.queries[rows[part]], items[cols[part]]))
        return units

    def _sort(self) -> None:
        rows, numbers, units = (np.concatenate(column) for column in zip(*self.parts))
        self.parts, ids = [], pa.concat_arrays(self.ids)
        order = np.lexsort((-units, rows))
        rows, numbers, units = rows[order], numbers[order], units[order]
        # Ids may be strings, which are slow to sort: only those of equal scores are.
        same = np.flatnonzero((rows[1:] == rows[:-1]) & (units[1:] == units[:-1]))
        if len(same):
            tied = np.union1d(same, same + 1)
            alike, at = np.unique(numbers[tied], return_inverse=True)
            place = np.empty(len(alike), np.int32)
            place[pc.array_sort_indices(ids.take(pa.array(alike))).to_numpy()] = np.arange(len(alike))
            numbers[tied] = numbers[tied][np.lexsort((place[at], -units[tied], rows[tied]))]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        last = place == self.k - 1
        self.bar[rows[last]] = units[last]
        kept = place < self.k
        rows, numbers, units = rows[kept], numbers[kept], units[kept]
        named = np.zeros(len(ids), bool)
        named[numbers] = True
        numbers = (np.cumsum(named, dtype=np.int32) - 1)[numbers]
        self.parts, self.ids, self.pending = [(rows, numbers, units)], [ids.filter(pa.array(named))], 0
        self.n_ids = len(self.ids[0])
        self.id_bytes = self.id_bytes_kept = self.ids[0].nbytes

    def best(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Row numbers of the queries, numbers of the items, ids under those numbers, and scores."""
        if not self.parts:
            return np.empty(0, np.int32), np.empty(0, np.int32), pa.array([], pa.int64()), np.empty(0)
        self._sort()
        (rows, numbers, units), ids = self.parts[0], self.ids[0]
        return rows, numbers, ids, units / SCALE

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of the queries, item ids and scores."""
        rows, numbers, ids, scores = self.best()
        return rows, _ids(ids.take(pa.array(numbers))), scores


def _result_schema(queries: DataFrame, items: DataFrame) -> str:
    query_type = queries.schema["query_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    return f"query_id {query_type}, item_id {item_type}, score double"


def dimension_of(df: DataFrame) -> int:
    """The most frequent size of the table's vectors, the smallest of equals."""
    sizes = df.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def _takes_part(dimension: int) -> Column:
    return (F.size("vector") == dimension) & is_finite(F.col("vector"))


def usable_vectors(df: DataFrame, dimension: int) -> DataFrame:
    """The rows whose vector can be compared."""
    return df.filter(_takes_part(dimension))


def rejected_vectors(df: DataFrame, dimension: int | None = None) -> DataFrame:
    """(reason, count) of the rows that a search leaves out."""
    dimension = dimension_of(df) if dimension is None else dimension
    v = F.col("vector")
    reason = (
        F.when(v.isNull(), "null vector").when(F.size(v) != dimension, "wrong dimension").when(F.exists(v, lambda x: x.isNull()), "null component")
        .when(F.exists(v, lambda x: F.isnan(x)), "NaN").otherwise("infinite")
    )
    return df.filter(F.coalesce(~_takes_part(dimension), F.lit(True))).groupBy(reason.alias("reason")).agg(F.count("*").alias("count"))


def _bytes(df: DataFrame, id_column: str, dimension: int) -> int:
    """Size of a vector table in memory; an id counts as often as the longest is long, since arrays hold all at that width."""
    row = df.agg(F.count("*").alias("n"), F.max(F.length(F.col(id_column).cast("string"))).alias("longest")).first()
    return row["n"] * (dimension * 8 + 64 + 4 * (row["longest"] or 0))


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist())


def _rows_of(df: DataFrame, id_column: str) -> tuple[pa.Array, np.ndarray]:
    """A side of checked size as arrays, for a broadcast variable."""
    table = df.select(id_column, "vector").toArrow()
    return table.column(id_column).combine_chunks(), _arrow_matrix(table.column("vector"))


def _rows_held(k: int, row_bytes: int) -> int:
    """Queries that a task holds at once, with ``k`` results each."""
    return max(1, min(RESULTS_AT_ONCE // max(1, k), BLOCK_BYTES // max(1, row_bytes)))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _results(leaders: _Leaders, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
    rows, numbers, ids, scores = leaders.best()
    for at in range(0, len(rows), RESULTS_AT_ONCE // 10):
        part = slice(at, at + RESULTS_AT_ONCE // 10)
        columns = [query_ids.take(pa.array(rows[part])), ids.take(pa.array(numbers[part])), pa.array(scores[part])]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "item_id", "score"])


def _with_items_everywhere(queries: DataFrame, items: DataFrame, k: int, schema: str) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(_rows_of(items, "item_id"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if batch.num_rows and len(ids):
                for part in _slices(batch, _rows_held(k, 1)):
                    leaders = _Leaders(_arrow_matrix(part.column("vector")), k)
                    leaders.offer(matrix, ids)
                    yield from _results(leaders, part.column("query_id"))

    return queries.select("query_id", "vector").mapInArrow(search, schema)


def _bars(queries: DataFrame, items: DataFrame, k: int, schema: str, n_items: int) -> dict:
    """For queries of checked size the ``k``-th best score among a sample of the items, in units, where there are ``k``.

    The sample is part of the items, so the ``k``-th best of all is no lower.
    """
    share = min(1.0, BAR_ITEMS / max(1, n_items))
    if share == 1.0:
        return {}
    sample = items.filter(draw(F.col("item_id"), 7) < int(share * (1 << 32)))
    best = ranked(_offered(queries, sample, k, schema, {}), k).filter(F.col("rank") == k)
    return {r["query_id"]: float(_units(np.float64(r["score"]))) for r in best.select("query_id", "score").collect()}


def _with_queries_everywhere(queries: DataFrame, items: DataFrame, k: int, schema: str) -> DataFrame:
    return _offered(queries, items, k, schema, _bars(queries, items, k, schema, items.count()))


def _offered(queries: DataFrame, items: DataFrame, k: int, schema: str, bars: dict) -> DataFrame:
    """What each task of the items finds for the queries: at most ``k`` each, none below its bar."""
    ids, matrix = _rows_of(queries, "query_id")
    bar = np.array([bars.get(i, -np.inf) for i in ids.to_pylist()])
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix, bar))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, bar = shared.value
        leaders = _Leaders(matrix, k, bar)
        for batch in batches:
            if batch.num_rows and len(ids):
                leaders.offer(_arrow_matrix(batch.column("vector")), batch.column("item_id"))
        yield from _results(leaders, ids)

    return items.select("item_id", "vector").mapInArrow(search, schema)


def _pivots(items: DataFrame, n_items: int, n: int = PIVOTS) -> np.ndarray:
    """Vectors of at most ``n`` items, drawn by the hashes of their ids, without repeats."""
    share = min(1.0, 4 * n / max(1, n_items))
    drawn = items if share == 1.0 else items.filter(draw(F.col("item_id"), 11) < int(share * (1 << 32)))
    rows = drawn.orderBy(draw(F.col("item_id"), 11), "item_id").select("vector").limit(n).collect()
    return np.unique(np.array([r["vector"] for r in rows], dtype=np.float64), axis=0) if rows else np.zeros((0, 1))


def _around_pivots(side: DataFrame, id_column: str, pivots: np.ndarray, row_bytes: int, block_bytes: int) -> DataFrame:
    """(block, cell, away, id, vector): the nearest pivot and its distance, and a block of the vectors of that pivot.

    A pivot with many vectors, copies of one for example, has many blocks, by the hash of the ids.
    """
    shared = side.sparkSession.sparkContext.broadcast(pivots)
    kinds = dict(side.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        lengths = np.einsum("ij,ij->i", pivots, pivots)
        for batch in batches:
            matrix = _arrow_matrix(batch.column("vector"))
            cells, away = np.zeros(len(matrix), np.int32), np.zeros(len(matrix))
            for at in range(0, len(matrix), ITEMS_AT_ONCE):
                part = matrix[at : at + ITEMS_AT_ONCE]
                near = np.argmin(lengths - 2 * (part @ pivots.T), axis=1)
                cells[at : at + len(part)] = near
                away[at : at + len(part)] = np.linalg.norm(part - pivots[near], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away)], names=[id_column, "vector", "cell", "away"])

    placed = side.select(id_column, "vector").mapInArrow(place, f"{id_column} {kinds[id_column]}, vector {kinds['vector']}, cell int, away double")
    placed = written(placed, "around-pivots")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * row_bytes / block_bytes).cast("long").alias("blocks"))
    part = F.pmod(F.xxhash64(id_column), F.col("blocks"))
    return placed.join(F.broadcast(sizes), "cell").select((F.shiftleft(F.col("cell").cast("long"), 32) + part).alias("block"), "cell", "away", id_column, "vector")


def _bounds(placed: DataFrame) -> DataFrame:
    """One row for each block: its pivot, how far away the farthest of its vectors is, and how many there are."""
    return placed.groupBy("block", "cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))


def _reaches(near, query_norm, query_radius, item_norm, item_radius, bar):
    """Whether the best score, in units, that vectors so far from pivots of these products and lengths can have is as high as the bar."""
    best = near + query_norm * item_radius + item_norm * query_radius + query_radius * item_radius
    best = best + 1e-9 * (1 + np.abs(best))  # more than rounding takes away
    return best * SCALE + 1 >= bar


def _pairs(query_bounds: DataFrame, item_bounds: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(query_block, item_block) of the pairs of blocks that may hold one of the ``k`` best of a query.

    With no column ``bar`` of the query blocks these are the nearest blocks, which hold ``k`` items (seeds); with it, all
    whose best possible score reaches the bar.
    """
    # Bounds are a few numbers for each block of items.
    rows = item_bounds.select("block", "cell", "radius", "n").toPandas().sort_values("block")
    shared = query_bounds.sparkSession.sparkContext.broadcast((pivots, *(rows[c].to_numpy() for c in ("block", "cell", "radius", "n"))))
    seeds = "bar" not in query_bounds.columns

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, blocks, cells, radius, n = shared.value
        norms = np.linalg.norm(pivots, axis=1)
        for batch in batches:
            left, right = [], []
            for row in batch.to_pylist():
                near = pivots[cells] @ pivots[row["cell"]]
                if seeds:
                    order = np.argsort(-near, kind="stable")
                    hit = blocks[order[: np.searchsorted(np.cumsum(n[order]), k) + 1]]
                else:
                    bar = -np.inf if row["bar"] is None else row["bar"] * SCALE
                    hit = blocks[_reaches(near, norms[row["cell"]], row["radius"], norms[cells], radius, bar)]
                left += [row["block"]] * len(hit)
                right += hit.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["query_block", "item_block"])

    columns = ["block", "cell", "radius", *([] if seeds else ["bar"])]
    return query_bounds.select(*columns).mapInArrow(meet, "query_block long, item_block long")


def _sent(side: DataFrame, lists: DataFrame, other: str) -> DataFrame:
    """The rows of each block once for each number that its list names; a list is one row, which Spark broadcasts where they turn out to be few."""
    return side.join(lists, "block").withColumn(other, F.explode("others")).drop("others")


def _listed(pairs: DataFrame, own: str, other: str) -> DataFrame:
    return pairs.groupBy(F.col(own).alias("block")).agg(F.collect_set(other).alias("others"))


def _stripes(query_bounds: DataFrame, most: int) -> DataFrame:
    """(block, stripe): query blocks that one task holds together, ``most`` rows of them unless one block has more."""
    # Bounds are a few numbers for each block of queries.
    blocks, stripes, stripe, held = [], [], 0, 0
    for block, n in query_bounds.select("block", "n").orderBy("block").collect():
        stripe, held = (stripe + 1, n) if held and held + n > most else (stripe, held + n)
        blocks.append(block)
        stripes.append(stripe)
    # Rows given as a list would pass Python workers of another kind, which stay beside those of the search.
    return query_bounds.sparkSession.createDataFrame(pa.table({"block": pa.array(blocks, pa.int64()), "stripe": pa.array(stripes, pa.int64())}))


def _in_pruned_blocks(queries: DataFrame, items: DataFrame, k: int, schema: str, dimension: int, block_bytes: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Candidates of all queries, the pairs of blocks that may hold them, and the blocks of both sides."""
    n_items, row_bytes = items.count(), dimension * 8 + 64
    most = _rows_held(k, row_bytes)
    block_bytes = min(block_bytes, most * row_bytes)
    # Some blocks for each that the items would fill, so that most of their pairs are far apart.
    pivots = _pivots(items, n_items, min(PIVOTS, 4 * _blocks(n_items * row_bytes, block_bytes)))
    if not len(pivots):
        none = queries.sparkSession.createDataFrame([], schema)
        return none, none.select(F.lit(0).alias("query_block"), F.lit(0).alias("item_block")), []
    queries = _around_pivots(queries, "query_id", pivots, row_bytes, block_bytes)
    items = _around_pivots(items, "item_id", pivots, row_bytes, block_bytes)
    query_bounds, item_bounds = written(_bounds(queries), "query-bounds"), written(_bounds(items), "item-bounds")
    seeds = written(_pairs(query_bounds, item_bounds, pivots, k), "seeds")
    asked = queries.withColumn("query_block", F.col("block"))
    offered = _sent(items, _listed(seeds, "item_block", "query_block"), "query_block")
    first = written(_streamed(asked, offered, ["query_block"], k, schema, pivots), "seed-scores")
    bars = ranked(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    barred = written(queries.join(bars, "query_id", "left"), "barred")
    # A block's bar is its lowest; none if a query has not found k items yet.
    low = barred.groupBy("block").agg(F.when(F.count("bar") == F.count(F.lit(1)), F.min("bar")).alias("bar"))
    pairs = written(_pairs(query_bounds.join(low, "block"), item_bounds, pivots, k), "pairs")
    # Stripes enough for all cores; each item is sent to those that have a block of a pair with its own.
    n_queries, cores = query_bounds.agg(F.sum("n")).first()[0] or 0, queries.sparkSession.sparkContext.defaultParallelism
    stripes = written(_stripes(query_bounds, min(most, -(-n_queries // (2 * cores)))), "stripes")
    wanted = pairs.join(stripes.withColumnRenamed("block", "query_block"), "query_block")
    parts = _blocks(n_items * row_bytes, STREAM_BYTES)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    asked = barred.join(F.broadcast(stripes), "block").withColumn("part", copies)
    offered = _sent(items, _listed(wanted, "item_block", "stripe"), "stripe").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    return _streamed(asked, offered, ["stripe", "part"], k, schema, pivots), seeds.unionByName(pairs).distinct(), [query_bounds, item_bounds]


def _streamed(queries: DataFrame, items: DataFrame, keys: list[str], k: int, schema: str, pivots: np.ndarray | None = None) -> DataFrame:
    """The best ``k`` of each query among the items with the same ``keys``.

    The rows of a key come to one task, queries first: it holds those and takes the items as they come. Queries may have
    a ``bar`` that results must reach. With ``pivots`` both sides are blocks around them, and items are multiplied with
    the blocks of queries that they may matter to.
    """
    kind = "array<double>" if queries.schema["vector"].dataType != items.schema["vector"].dataType else queries.schema["vector"].dataType
    placed = ["block", "cell", "away"] if pivots is not None else []

    def side(df: DataFrame, number: int, *columns: str) -> DataFrame:
        return df.select(*keys, F.lit(number).alias("_side"), *columns, F.col("vector").cast(kind).alias("vector"), *placed)

    left = side(queries, 0, "query_id", *(["bar"] if "bar" in queries.columns else []))
    both = left.unionByName(side(items, 1, "item_id"), allowMissingColumns=True).repartition(*keys)
    shared = None if pivots is None else queries.sparkSession.sparkContext.broadcast(pivots)
    return both.sortWithinPartitions(*keys, "_side", *placed[:1]).mapInArrow(_stream_search(keys, k, shared), schema)


def _changes(columns: list[np.ndarray], n: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of rows that agree in the columns."""
    cuts = np.zeros(n, bool)
    for column in columns:
        cuts[1:] |= column[1:] != column[:-1]
    starts = [0, *np.flatnonzero(cuts).tolist()]
    return list(zip(starts, [*starts[1:], n]))


class _Held:
    """Queries of one key and what they have found."""

    def __init__(self, parts: list[pa.RecordBatch], k: int, pivots: np.ndarray | None):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.ids, bar = rows.column("query_id").combine_chunks(), None
        if "bar" in rows.column_names:
            bar = rows.column("bar").to_numpy().astype(np.float64)
            bar = np.where(np.isnan(bar), -np.inf, _units(np.nan_to_num(bar)))
        self.leaders, self.pivots = _Leaders(_arrow_matrix(rows.column("vector")), k, bar), pivots
        if pivots is not None:
            self.products, self.norms = pivots @ pivots.T, np.linalg.norm(pivots, axis=1)
            self.starts = np.array([at for at, _ in _changes([rows.column("block").to_numpy()], rows.num_rows)])
            self.sizes = np.diff(np.append(self.starts, rows.num_rows))
            self.cells = rows.column("cell").to_numpy()[self.starts]
            self.radius = np.maximum.reduceat(rows.column("away").to_numpy(), self.starts)

    def _among(self, cell: int, radius: float) -> np.ndarray:
        """The rows of the blocks that items so far around a pivot may matter to."""
        low = np.minimum.reduceat(self.leaders.bar, self.starts)
        reach = _reaches(self.products[cell, self.cells], self.norms[self.cells], self.radius, self.norms[cell], radius, low)
        return np.flatnonzero(np.repeat(reach, self.sizes))

    def offer(self, items: pa.RecordBatch) -> None:
        stretches = [(0, items.num_rows)] if self.pivots is None else _changes([items.column("block").to_numpy()], items.num_rows)
        for start, end in stretches:
            for part in _slices(items.slice(start, end - start), ITEMS_AT_ONCE):
                among = None
                if self.pivots is not None:
                    among = self._among(part.column("cell")[0].as_py(), part.column("away").to_numpy().max())
                    if not len(among):
                        continue
                self.leaders.offer(_arrow_matrix(part.column("vector")), part.column("item_id"), among)


def _stream_search(keys: list[str], k: int, shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = None if shared is None else shared.value
        key, parts, held = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*keys, "_side")]
            for start, end in _changes(columns, batch.num_rows) if batch.num_rows else []:
                part, here = batch.slice(start, end - start), tuple(c[start] for c in columns[:-1])
                if here != key:
                    if held:
                        yield from _results(held.leaders, held.ids)
                    key, parts, held = here, [], None
                if columns[-1][start] == 0:
                    parts.append(part)
                elif held or parts:
                    if not held:
                        held, parts = _Held(parts, k, pivots), []
                    held.offer(part)
        if held:
            yield from _results(held.leaders, held.ids)

    return search


def _in_blocks(queries: DataFrame, items: DataFrame, k: int, schema: str) -> DataFrame:
    """Top-k within each ``cell`` shared by both sides, block by block.

    Both sides carry ``query_blocks`` and ``item_blocks``, the numbers of blocks their cell is cut
    into by a hash of the ids. They follow from the measured size, so a cell that holds a third of
    all rows becomes many small tasks, not one large one.
    """

    def cut(side: DataFrame, id_column: str, own: str, other: str) -> DataFrame:
        return (
            side.withColumn(own, F.pmod(F.xxhash64(id_column), F.col(f"{own}s")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1)))
            .select("cell", "query_block", "item_block", id_column, "vector")
        )

    left = cut(queries, "query_id", "query_block", "item_block")
    right = cut(items, "item_id", "item_block", "query_block")
    return _streamed(left, right, ["cell", "query_block", "item_block"], k, schema)


def _blocks(n_bytes: int, block_bytes: int) -> int:
    return max(1, -(-n_bytes // block_bytes))


def ranked(candidates: DataFrame, k: int, group: str = "query_id", item: str = "item_id") -> DataFrame:
    """Rank 1..k per group by score, smaller id first on ties; Spark cuts to k before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), F.asc(item))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int = presets.CANDIDATES,
    broadcast_limit: int = BLOCK_BYTES,
    block_bytes: int = PIVOT_BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` most similar items of every query: (query_id, item_id, score, rank).

    ``queries`` has (query_id, vector), ``items`` (item_id, vector). If both carry an ``encoder``
    column, the names must agree: vectors of different encoders cannot be compared.
    """
    _same_encoder(queries, items)
    schema = _result_schema(queries, items)
    dimension = dimension_of(items)
    queries, items = usable_vectors(queries, dimension), usable_vectors(items, dimension)
    if _bytes(items, "item_id", dimension) <= broadcast_limit:
        return ranked(_with_items_everywhere(queries, items, k, schema), k)
    if _bytes(queries, "query_id", dimension) <= broadcast_limit and queries.count() * k <= RESULTS_AT_ONCE:
        return ranked(_with_queries_everywhere(queries, items, k, schema), k)
    return ranked(_in_pruned_blocks(queries, items, k, schema, dimension, block_bytes)[0], k)


def block_pairs(queries: DataFrame, items: DataFrame, k: int = presets.CANDIDATES, block_bytes: int = PIVOT_BLOCK_BYTES) -> tuple[int, int]:
    """How many pairs of blocks a search of two large sides multiplies, and how many there are."""
    dimension = dimension_of(items)
    sides = usable_vectors(queries, dimension), usable_vectors(items, dimension)
    _, pairs, blocks = _in_pruned_blocks(*sides, k, _result_schema(*sides), dimension, block_bytes)
    return pairs.count(), int(np.prod([b.count() for b in blocks])) if blocks else 0


def _same_encoder(queries: DataFrame, items: DataFrame) -> None:
    if "encoder" not in queries.columns or "encoder" not in items.columns:
        return
    both = queries.select("encoder").unionAll(items.select("encoder"))
    names = {r[0] for r in both.distinct().limit(3).collect()}
    if len(names) > 1:
        raise ValueError(f"vectors come from different encoders: {sorted(map(str, names))}")


def cells_for(n: int) -> int:
    """A number of cells that grows with the table: four times the root of its rows, at least the usual number for tables that fill it."""
    return max(1, min(n, max(min(presets.IVF_CELLS, n // 40), 4 * int(n**0.5))))


def train_cells(
    items: DataFrame,
    cells: int | None = None,
    train_rows: int | None = None,
    seed: int = 42,
    rounds: int = presets.IVF_ROUNDS,
    tolerance: float = presets.IVF_TOLERANCE,
    flat_cells: int = FLAT_CELLS,
) -> DataFrame:
    """Cell centres (cell, vector) by k-means, until no centre moves by more than ``tolerance``.

    Without ``cells`` their number follows from the rows. Up to ``flat_cells`` are fitted at once, on all vectors;
    ``train_rows`` asks for a sample instead, drawn by a hash of the id, so the same rows are sampled however the
    table is partitioned. More cells are fitted in groups, as many as the root of their number, and also have ``grp``:
    see :func:`_grouped_cells`.
    """
    items = usable_vectors(items, dimension_of(items))
    total = items.count()
    cells = max(1, cells or cells_for(total))
    if cells > flat_cells:
        return _grouped_cells(items, total, cells, train_rows or ROWS_PER_CELL * cells, seed, rounds, tolerance)
    sample = _sampled(items, total, train_rows, seed)
    return sample.sparkSession.createDataFrame(_means(sample, cells, seed, rounds, tolerance), "cell int, vector array<double>")


def _sampled(items: DataFrame, total: int, rows: int | None, seed: int) -> DataFrame:
    if rows is None or rows >= total:
        return items
    return items.filter(draw(F.col("item_id"), seed) < int(rows / total * (1 << 32)))


def _means(sample: DataFrame, cells: int, seed: int, rounds: int, tolerance: float) -> list[tuple[int, list[float]]]:
    """Centres by Spark's k-means, few enough for the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")).persist()
    try:
        model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=rounds, tol=tolerance).fit(points)
    finally:
        points.unpersist()
    return [(i, [float(x) for x in centre]) for i, centre in enumerate(model.clusterCenters())]


def _grouped_cells(items: DataFrame, total: int, cells: int, rows: int, seed: int, rounds: int, tolerance: float) -> DataFrame:
    """(cell, vector, grp): some ``cells`` centres in groups as many as their root.

    The groups are k-means of few centres. Each group has cells by its share of the vectors, four roots at most, and a
    vector is compared with the centres of its own group alone, so a round costs a root of the cells for each vector.
    Rounds run on executors: blocks of a group's vectors meet its centres, give one sum for each cell, and the sums of the
    blocks make the next centres. Groups of any size become many blocks.
    """
    spark = items.sparkSession
    sample = written(_sampled(items, total, rows, seed).select("item_id", F.col("vector").cast("array<double>").alias("vector")), "cell-sample")
    root = max(1, int(cells**0.5))
    coarse = spark.createDataFrame(_means(sample, root, seed, rounds, tolerance), "cell int, vector array<double>")
    dimension = dimension_of(coarse)
    placed = written(assign_cells(sample, coarse).withColumnRenamed("cell", "grp"), "grouped")
    sizes = {r["grp"]: r["n"] for r in placed.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    n_rows, first, plan = sum(sizes.values()), 0, []
    for grp, n in sorted(sizes.items()):
        own = max(1, min(4 * root, cells * n // n_rows))
        plan.append((grp, first, own, _blocks(n * dimension * 8, BLOCK_BYTES)))
        first += own
    plan = F.broadcast(spark.createDataFrame(plan, "grp int, first int, own int, parts int"))  # a row for each group
    order = Window.partitionBy("grp").orderBy(draw(F.col("item_id"), seed + 1), "item_id")
    drawn = placed.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= 4 * root).join(plan, "grp")
    seeds = drawn.filter(F.col("at") <= F.col("own")).select((F.col("first") + F.col("at") - 1).alias("cell"), "vector", "grp")
    centres = written(seeds, "cell-centres")
    blocks = placed.join(plan, "grp").select("grp", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int").alias("part"), "vector")
    blocks = written(blocks, "cell-blocks")
    for _ in range(rounds):
        copied = centres.join(plan, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cell", "vector")
        schema = "cell int, part int, total array<double>"
        sums = blocks.groupBy("grp", "part").cogroup(copied.groupBy("grp", "part")).applyInArrow(_cell_sums, schema)
        # A row for each block of a group; in their order, so that the sum does not depend on who was first.
        listed = F.array_sort(F.collect_list(F.struct("part", "total")))
        summed = F.aggregate(F.transform(listed, lambda x: x["total"]), F.array_repeat(F.lit(0.0), dimension), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        moved = sums.groupBy("cell").agg(summed.alias("sum")).withColumn("norm", F.sqrt(F.aggregate("sum", F.lit(0.0), lambda a, x: a + x * x)))
        new = F.when(F.col("norm") > 0, F.transform("sum", lambda x: x / F.col("norm"))).otherwise(F.col("vector"))
        step = F.aggregate(F.zip_with("vector", "new", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        after = centres.join(moved, "cell", "left").withColumn("new", new)
        after = written(after.select("cell", F.col("new").alias("vector"), "grp", step.alias("step")), "cell-centres")
        centres = after.drop("step")
        if (after.agg(F.max("step")).first()[0] or 0.0) <= tolerance * tolerance:
            break
    return centres


def _cell_sums(vectors: pa.Table, centres: pa.Table) -> pa.Table:
    """(cell, part, total): the sum of a block's vectors, as units, that are nearest to each centre of their group."""
    names = ["cell", "part", "total"]
    if not vectors.num_rows or not centres.num_rows:
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64()))], names)
    points, heads = _arrow_matrix(vectors.column("vector")), _arrow_matrix(centres.column("vector"))
    lengths = np.linalg.norm(points, axis=1, keepdims=True)
    points = np.divide(points, lengths, out=np.zeros_like(points), where=lengths > 0)
    # Of centres that are equally near, the smallest cell; rows in one order, whatever the shuffle gave.
    order = np.argsort(centres.column("cell").to_numpy())
    heads, cells = heads[order], centres.column("cell").to_numpy()[order]
    points = points[np.lexsort(points.T)]
    step = max(1, SCORES_AT_ONCE // len(heads))
    nearest = np.concatenate([np.argmax(points[at : at + step] @ heads.T, axis=1) for at in range(0, len(points), step)])
    found = np.unique(nearest)
    totals = [points[nearest == i].sum(axis=0) for i in found]
    part = centres.column("part")[0].as_py()
    columns = [pa.array(cells[found], pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array(totals, pa.list_(pa.float64()))]
    return pa.table(columns, names)


def _group_heads(centres: DataFrame) -> DataFrame:
    """(cell, vector): the mean direction of each group's centres; as many rows as groups, each from four roots of the cells at most."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cell", "vector"))), lambda x: x["vector"])
    total = F.reduce(F.slice(listed, 2, F.size(listed)), F.get(listed, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    heads = centres.groupBy("grp").agg(total.alias("sum")).withColumn("norm", F.sqrt(F.aggregate("sum", F.lit(0.0), lambda a, x: a + x * x)))
    unit = F.transform("sum", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(F.lit(0.0)))
    return heads.select(F.col("grp").alias("cell"), unit.alias("vector"))


def _probed_in_groups(queries: DataFrame, centres: DataFrame, probes: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`probed_cells` of grouped centres: nearest groups first, then the cells in them, block by block.

    The groups' heads are few and go to every task; centres meet the queries over a shuffle.
    """
    groups, n_cells = centres.agg(F.count_distinct("grp"), F.count("*")).first()
    near = groups if probes >= n_cells else min(groups, max(NEAR_GROUPS, probes))
    rows = written(queries.select(F.monotonically_increasing_id().alias("_row"), "query_id", "vector"), "probing")
    asked = written(probed_cells(rows.select(F.col("_row").alias("query_id"), "vector"), written(_group_heads(centres), "heads"), near), "near-groups")
    row_bytes = dimension_of(centres) * 8

    held = min(block_bytes, _rows_held(probes, row_bytes) * row_bytes)

    def blocks(df: DataFrame, key: str, name: str, most: int) -> DataFrame:
        return df.groupBy(F.col(key).alias("cell")).agg(F.ceil(F.count("*") * row_bytes / F.lit(most)).alias(name))

    # One row for each group: the root of the cells.
    sizes = F.broadcast(blocks(asked, "cell", "query_blocks", held).join(blocks(centres, "grp", "item_blocks", block_bytes), "cell"))
    items = centres.select(F.col("grp").alias("cell"), F.col("cell").alias("item_id"), "vector").join(sizes, "cell")
    found = ranked(_in_blocks(asked.join(sizes, "cell"), items, probes, "query_id bigint, item_id int, score double"), probes)
    cells = found.select(F.col("query_id").alias("_row"), F.col("item_id").alias("cell"))
    return rows.join(cells, "_row").select("query_id", "vector", "cell")


def assign_cells(items: DataFrame, centres: DataFrame) -> DataFrame:
    """Every item with its nearest cell: (item_id, vector, cell)."""
    return probed_cells(items.withColumnRenamed("item_id", "query_id"), centres, 1).withColumnRenamed(
        "query_id", "item_id"
    )


def probed_cells(queries: DataFrame, centres: DataFrame, probes: int) -> DataFrame:
    """One row per query and probed cell: (query_id, vector, cell).

    Centres of one level go to every task, queries are read once and not shuffled; those of two levels are looked up
    by their groups.
    """
    if "grp" in centres.columns:
        return _probed_in_groups(queries, centres, probes)
    shared = queries.sparkSession.sparkContext.broadcast(_rows_of(centres, "cell"))
    vector_type = queries.schema["vector"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centre = shared.value
        for batch in batches:
            if batch.num_rows:
                for part in _slices(batch, max(1, 2 * ITEMS_AT_ONCE // probes)):
                    leaders = _Leaders(_arrow_matrix(part.column("vector")), probes)
                    leaders.offer(centre, ids)
                    rows, cells, _ = leaders.result()
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(take), part.column("vector").take(take), pa.array(cells, type=ids.type)],
                        names=["query_id", "vector", "cell"],
                    )

    return queries.select("query_id", "vector").mapInArrow(
        probe, f"query_id {query_type}, vector {vector_type}, cell int"
    )


# Vectors of one file of an index; a cell with more is written by several tasks.
ROWS_PER_INDEX_FILE = 100_000


def write_cell_index(items: DataFrame, centres: DataFrame, path: str) -> None:
    """Store the items by cell, with the rows of each cell beside its centre; a search reads the probed folders only.

    A cell goes to as many tasks as its measured size asks for, so it has few files and none is too large.
    """
    placed = written(assign_cells(usable_vectors(items, dimension_of(centres)), centres), "placed")
    counts = written(placed.groupBy("cell").agg(F.count("*").alias("n")), "cell-counts")
    sized = placed.join(broadcast_if_small(counts, F.lit(16))[0], "cell")
    part = F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n") / ROWS_PER_INDEX_FILE))
    dealt = sized.withColumn("_part", part).repartition("cell", "_part").drop("_part", "n")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/items")
    with_counts = centres.join(counts, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    with_counts.write.mode("overwrite").parquet(f"{path}/centres")


def probed_items(placed_items: DataFrame, probed: DataFrame) -> DataFrame:
    """The items of the cells that are probed; their list, bounded by the number of cells, prunes the folders that are read."""
    cells = [r[0] for r in probed.select("cell").distinct().collect()]
    return placed_items.filter(F.col("cell").isin(cells))


def cell_top_k(
    queries: DataFrame,
    placed_items: DataFrame,
    centres: DataFrame,
    k: int = presets.CANDIDATES,
    probes: int = presets.IVF_PROBES,
    block_bytes: int = STREAM_BYTES,
) -> DataFrame:
    """Top-k among the items of the ``probes`` nearest cells of each query.

    Fewer than ``k`` rows come back where the probed cells hold fewer items. Centres of a stored index
    carry the rows of their cells (``n``); for others the items are counted.
    """
    dimension = dimension_of(centres)
    probed = written(probed_cells(usable_vectors(queries, dimension), centres, probes), "probed")
    items = probed_items(placed_items, probed)
    row_bytes = dimension * 8
    held = min(block_bytes, _rows_held(k, row_bytes) * row_bytes)

    def blocks(counts: DataFrame, name: str, most: int) -> DataFrame:
        return counts.select("cell", F.ceil(F.col("n") * row_bytes / F.lit(most)).alias(name))

    stored = centres.filter("n > 0") if "n" in centres.columns else items.groupBy("cell").agg(F.count("*").alias("n"))
    asked = probed.groupBy("cell").agg(F.count("*").alias("n"))
    cells = written(blocks(asked, "query_blocks", held).join(blocks(stored, "item_blocks", block_bytes), "cell"), "cell-blocks")
    cells, _ = broadcast_if_small(cells, F.lit(32))
    schema = _result_schema(queries, placed_items)
    return ranked(_in_blocks(probed.join(cells, "cell"), items.join(cells, "cell"), k, schema), k)


def best_match(scored: DataFrame) -> DataFrame:
    """One row per query: the best score, earliest rank first on ties (anchor, match, score)."""
    # NaN sorts above all numbers in Spark; as null it is below them.
    scored = scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    best = F.max_by(F.struct("item_id", "score"), F.struct(F.col("score"), -F.col("rank")))
    return scored.groupBy(F.col("query_id").alias("anchor")).agg(best.alias("b")).select(
        "anchor", F.col("b.item_id").alias("match"), F.col("b.score").alias("score")
    )


def rerank(matches: DataFrame, keep: int = presets.RERANK_KEEP) -> DataFrame:
    """New order by ``pair_score``; ``change`` is the old rank minus the new one."""
    usable = F.when(~F.isnan("pair_score"), F.col("pair_score"))
    order = Window.partitionBy("query_id").orderBy(usable.desc_nulls_last(), F.asc("rank"))
    return (
        matches.withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= keep)
        .withColumn("change", F.col("rank") - F.col("new_rank"))
    )


def paged(matches: DataFrame, rank: str = "rank", page_size: int = presets.PAGE_SIZE) -> DataFrame:
    return matches.withColumn("page", (F.floor((F.col(rank) - 1) / page_size) + 1).cast("int"))


def recall(matches: DataFrame, truth: DataFrame, known: DataFrame, at: list[int] = presets.RECALL_AT) -> DataFrame:
    """Share of true pairs (anchor, match) found in the first k ranks, for each k.

    Pairs whose anchor is not a known query do not count.
    """
    judged = truth.join(known.select(F.col("query_id").alias("anchor")), "anchor", "left_semi")
    hits = judged.join(
        matches.select(F.col("query_id").alias("anchor"), F.col("item_id").alias("match"), "rank"),
        ["anchor", "match"],
        "left",
    )
    counts = hits.agg(F.count("*").alias("pairs"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in at])
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"hits_{k}").alias("hits"), "pairs") for k in at])).alias("r")
    ).select("r.k", "r.hits", "r.pairs", F.when(F.col("r.pairs") > 0, F.col("r.hits") / F.col("r.pairs")).otherwise(F.lit(0.0)).alias("recall"))


def with_truth(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Mark the pairs (cv_id, job_id) that are known matches."""
    marked = truth.select("cv_id", "job_id").distinct().withColumn("is_ground_truth", F.lit(True))
    return pairs.join(marked, ["cv_id", "job_id"], "left").withColumn(
        "is_ground_truth", F.coalesce("is_ground_truth", F.lit(False))
    )
