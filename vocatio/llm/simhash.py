"""Near-duplicates by SimHash fingerprints and a Gray-ordered hierarchical index.

Documents get a fingerprint of 64 bits, equal fingerprints are one entry of the index. Two entries that differ in at
most ``d`` bits agree in one of ``d + 1`` stretches of their bits, so each entry is sent to as many routes, the value of
a stretch being the shared pattern of the route's root. Within a route entries stand in the order of their Gray rank,
where neighbours share many bits. Runs of ``LEAF`` entries form a leaf, runs of ``FAN`` nodes a node above; a node has
the mask of the bits that all below it share, and their pattern. Two nodes are compared by the differences in the bits
that both share, which only grow from a node to the nodes below it: as soon as they exceed ``d``, all pairs
between the two groups are pruned at once. Routes with more than ``ROUTE_LIMIT`` entries are counted and routed again
by stretches of the bits that they leave free, level by level, until none is above the limit.

From a route only a spanning forest of its links leaves the task, never all pairs. Components follow by alternating
large and small stars over those edges, each round written to the shared folder.

Rows: null and empty texts have fingerprint zero and link like any other; repeated rows fall into one component; a null
id takes part but is never the component's id unless all are null; an empty table gives an empty table. ``components``
reads only id and text, ``keep_one`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm.common import arrow_map, fresh, texts_of, union
from vocatio.session import written

BITS = 64
LEAF, FAN = 32, 8
ROUTE_LIMIT = 20_000
# Node pairs looked at together, to bound the memory of a task.
FRONT = 1 << 17
# Shingles of a document counted together.
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash over the XXH64 values (seed 42) of all shingles of the text's words in lower case (A-Z only)."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # ASCII case and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    total = np.zeros(BITS, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(n, at + CHUNK)], ends[at + shingle - 1 :])
        hashes = np.array([xxh64_intdigest(joined[s : e - 1], 42) for s, e in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, t, fp) of every row: a hash of its text, and the fingerprint's bits as a signed long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in texts_of(batch, "text")], np.uint64)
            columns = [batch.column("id"), batch.column("t"), pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "t", "fp"])

    return arrow_map(rows, run, f"id {dict(rows.dtypes)['id']}, t long, fp long")


def stretches(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in ``n`` stretches of nearly equal length."""
    return [list(map(int, part)) for part in np.array_split(bits, n)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class Forest:
    """Union of entries, each set named by its smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while (up := self.root[r]).tolist() != r.tolist():
            r = up
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.root, b, a)
        self.root = self.find(np.arange(len(self.root)))


def links_in_route(codes: np.ndarray, d: int) -> np.ndarray:
    """For entries of one route in Gray order: the smallest position that each reaches over links of at most ``d`` bits."""
    forest, n = Forest(len(codes)), len(codes)
    levels, starts, width = [], np.arange(0, n, LEAF), 1
    ones, zeros = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    while True:
        levels.append((ones | ~zeros, ones))  # the bits shared by all below, and their pattern
        if len(ones) <= FAN:
            break
        starts = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
    top = len(levels[-1][0])
    stack = [(len(levels) - 1, *np.triu_indices(top))]
    steps = np.arange(FAN)
    while stack:
        level, a, b = stack.pop()
        if len(a) > FRONT:
            stack += [(level, a[FRONT:], b[FRONT:])]
            a, b = a[:FRONT], b[:FRONT]
        mask, pattern = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= d
        a, b = a[near], b[near]
        if not level:
            _compare_leaves(codes, a, b, d, forest)
        elif len(a):
            size = len(levels[level - 1][0])
            x = (a[:, None, None] * FAN + steps[:, None] + 0 * steps).ravel()
            y = (b[:, None, None] * FAN + steps + 0 * steps[:, None]).ravel()
            real = (x <= y) & (x < size) & (y < size)
            stack.append((level - 1, x[real], y[real]))
    return forest.root


def _compare_leaves(codes: np.ndarray, a: np.ndarray, b: np.ndarray, d: int, forest: Forest) -> None:
    """Link the entries of leaf pairs; pairs of leaves whose entries are one component already need no look."""
    n, steps, at_once = len(codes), np.arange(LEAF), FRONT // LEAF**2 * 8
    lasts = np.arange(0, n, LEAF)
    for at in range(0, len(a), at_once):
        low, high = np.minimum.reduceat(forest.root, lasts), np.maximum.reduceat(forest.root, lasts)
        p, q = a[at : at + at_once], b[at : at + at_once]
        apart = (low[p] != high[p]) | (low[q] != high[q]) | (low[p] != low[q])
        p, q = p[apart], q[apart]
        x = (p[:, None, None] * LEAF + steps[:, None] + 0 * steps).ravel()
        y = (q[:, None, None] * LEAF + steps + 0 * steps[:, None]).ravel()
        real = (x < y) & (y < n)
        x, y = x[real], y[real]
        near = np.bitwise_count(codes[x] ^ codes[y]) <= d
        forest.link(x[near], y[near])


def links_in_routes(routes: np.ndarray, codes: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, its smallest linked code's position) over many routes, whose entries stand together."""
    order = np.lexsort((gray_rank(codes), routes))
    routes, codes = routes[order], codes[order]
    firsts = np.flatnonzero(np.append(True, routes[1:] != routes[:-1]))
    sizes = np.diff(np.append(firsts, len(routes)))
    # Routes of at most one leaf are compared together, step by step along the order.
    forest, small = Forest(len(codes)), np.repeat(sizes <= LEAF, sizes)
    for step in range(1, min(LEAF, int(sizes.max(initial=1)))):
        at = np.flatnonzero(small[:-step] & (routes[:-step] == routes[step:]))
        near = np.bitwise_count(codes[at] ^ codes[at + step]) <= d
        if near.any():
            forest.link(at[near], at[near] + step)
    for first, size in zip(firsts[sizes > LEAF], sizes[sizes > LEAF]):
        forest.root[first : first + size] = first + links_in_route(codes[first : first + size], d)
    linked = np.flatnonzero(forest.root != np.arange(len(codes)))
    return codes[linked], codes[forest.root[linked]]


def _route_edges(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(routes: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_in_routes(np.concatenate(routes), np.concatenate(codes), d)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        routes, codes, held = [], [], 0
        for batch in batches:  # in the order of the routes
            r, c = batch.column("route").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if held > BATCH_ENTRIES and len(r) and (cut := int(np.argmax(r != routes[-1][-1]))):
                yield edges([*routes, r[:cut]], [*codes, c[:cut]])
                routes, codes, held, r, c = [], [], 0, r[cut:], c[cut:]
            elif held > BATCH_ENTRIES and len(r) and r[0] != routes[-1][-1]:
                yield edges(routes, codes)
                routes, codes, held = [], [], 0
            if len(r):
                routes.append(r)
                codes.append(c)
                held += len(r)
        if routes:
            yield edges(routes, codes)

    return run


# Entries of whole routes that a task works on together.
BATCH_ENTRIES = 200_000


def _masks(free: int, parts: int) -> list[int]:
    """The bits of ``free`` cut into ``parts`` stretches of like length, as masks."""
    bits = [b for b in range(BITS) if free >> b & 1]
    return [sum(1 << b for b in part) for part in stretches(bits, parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def routed(entries: DataFrame, d: int, limit: int = ROUTE_LIMIT) -> DataFrame:
    """(route, fp): each entry once for every route; pairs within ``d`` bits share one.

    A route fixes one of ``d + 1`` stretches of bits. Routes above ``limit`` are counted and cut again by the bits that
    they leave free, in which their pairs differ by at most ``d`` too, until no route is above the limit. The entries
    must be different: then a route of ``f`` free bits has at most 2^f, and each cut leaves ``d / (d + 1)`` of them.
    """
    spark, frees, done = entries.sparkSession, {(1 << BITS) - 1}, []
    now = entries.select(F.lit(0).cast("long").alias("route"), "fp", F.lit(-1).cast("long").alias("free"))
    while True:
        # At most (d + 1) ^ level different sets of free bits, whatever the table.
        cuts = [(f, m) for f in sorted(frees) for m in _masks(f, d + 1)]
        if len(frees) == 1:
            cut = now.withColumn("mask", F.explode(F.array(*(F.lit(_signed(m)) for _, m in cuts))))
        else:
            masks = spark.createDataFrame([(_signed(f), _signed(m)) for f, m in cuts], "free long, mask long")
            cut = now.join(F.broadcast(masks), "free")
        now = cut.select(
            F.xxhash64("route", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("route"), "fp",
            F.col("free").bitwiseAND(F.bitwise_not("mask")).alias("free"),
        )
        hot = written(now.groupBy("route").count().filter(F.col("count") > limit).select("route"), "hot-routes")
        if hot.isEmpty():
            return union([*done, now.select("route", "fp")])
        done.append(now.join(hot, "route", "left_anti").select("route", "fp"))
        frees = {f & ~m for f, m in cuts}
        # Sets too small to be cut belong to routes of at most 2^d entries.
        frees = {f for f in frees if f.bit_count() > d}
        again = now.join(hot, "route", "left_semi")
        small = F.bit_count("free") <= d
        done.append(again.filter(small).select("route", "fp"))
        if not frees:
            return union(done)
        now = written(again.filter(~small), "routes")


def link_edges(entries: DataFrame, d: int, limit: int = ROUTE_LIMIT) -> DataFrame:
    """Edges (a, b) between fingerprints; their components are those of all pairs within ``d`` bits."""
    if d == 0:  # different fingerprints have no links then
        return entries.limit(0).select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    routes = routed(entries, d, limit)
    placed = routes.repartition("route").sortWithinPartitions("route")
    return arrow_map(placed, _route_edges(d), "a long, b long")


def components_of(edges: DataFrame, name: str = "simhash") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node that it reaches.

    Alternates large and small stars until a round changes nothing; each round's edges are written, so no round
    depends on an executor that is gone.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), f"{name}-edges")
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    state = edges.agg(*mark).first()
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Large star: every greater neighbour of a node is linked to the node's least neighbour.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # Small star: a node and its smaller neighbours are linked to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(edges.filter("a != b").distinct(), f"{name}-stars")
        if (now := edges.agg(*mark).first()) == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, d: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, t, fp) of the rows, and (fp, root) of the different fingerprints."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    entries = written(prints.select("fp").distinct(), "entries")
    roots = components_of(link_edges(entries, d))
    return prints, entries.join(roots, entries.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(
    docs: DataFrame, d: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """For each row its id, ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    The component's id is the smallest id among the rows that a row reaches over links of at most ``d`` bits.
    """
    prints, placed = _grouped(docs, d, shingle, id_col, text_col)
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(placed, "fp")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(named, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), hexed, "component_id")


def keep_one(docs: DataFrame, d: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, nulls last, then of the least text hash.

    Rows that agree in id and text are one row; which of their other columns stay is left open.
    """
    prints, placed = _grouped(docs, d, shingle, id_col, text_col)
    rows = prints.groupBy("fp", "id", "t").agg(F.count(F.lit(1)).alias("n")).join(placed, "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "t", "n")).alias("first")
    leads = rows.groupBy("root").agg(first).select("first.id", "first.t", "first.n")
    # Written, so that its size is known before the joins are planned.
    leads = written(leads.select(*(F.col(c).alias(fresh(docs, f"_{c}")) for c in leads.columns)), "leads")
    i, t, n = leads.columns
    met = F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(t))
    single = docs.join(leads.filter(F.col(n) == 1), met, "left_semi")
    repeated = docs.join(leads.filter(F.col(n) > 1), met, "left_semi")
    return single.unionByName(repeated.dropDuplicates([id_col, text_col]))
