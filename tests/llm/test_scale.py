"""Groups stay bounded: routes of fingerprints, copies of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocatio.llm import ann, simhash


def families(seed=5):
    """Fingerprints that agree in 24 and in 40 bits, and others."""
    rng = np.random.default_rng(seed)
    wide = (np.uint64(0xABCD12) << np.uint64(40)) | rng.integers(0, 1 << 40, 500, dtype=np.uint64)
    close = np.uint64(0x7777_0000_1234_0000) | rng.integers(0, 1 << 12, 300, dtype=np.uint64) | (rng.integers(0, 1 << 10, 300, dtype=np.uint64) << np.uint64(34))
    other = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flipped = other[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    return np.unique(np.concatenate([wide, close, other, flipped]))


@pytest.mark.parametrize("limit", [10_000, 60])
def test_routes_are_cut_until_they_are_small(spark, limit):
    codes = families()
    entries = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    routes = simhash.routed(entries, 3, limit).groupBy("route").agg(F.count("*").alias("n"), F.collect_set("fp").alias("fps")).collect()
    if limit == 60:
        assert max(r["n"] for r in routes) <= limit
    met = set()
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    for r in routes:
        own = sorted(at[f] for f in r["fps"])
        met |= {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if int(codes[a] ^ codes[b]).bit_count() <= 3}
    every = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if int(codes[a] ^ codes[b]).bit_count() <= 3}
    assert met == every and len(every) > 100
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in every:
        root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {r["node"]: r["root"] for r in simhash.components_of(simhash.link_edges(entries, 3, limit)).collect()}
    mine = {}
    for c in codes.view(np.int64):
        mine.setdefault(linked.get(int(c), int(c)), set()).add(at[int(c)])
    truth = {}
    for i in range(len(codes)):
        truth.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, truth.values()))


def test_blocks_are_copied_for_their_own_queries_only(spark):
    """One cell with 25 queries and a chunk of 10 goes three times, one with 4 once, one that nobody visits never."""
    items = spark.range(300).select("id", F.lit(8).alias("dim"), (F.col("id") % 3).cast("int").alias("cell"), F.lit(0).alias("part"))
    asked = spark.range(29).select("id", F.lit(8).alias("dim"), F.when(F.col("id") < 25, 0).otherwise(1).alias("cell"), F.lit(0).alias("part"))
    own, sent = ann.dealt(items, asked, 10)
    assert {(r["cell"], r["count"]) for r in own.groupBy("cell").count().collect()} == {(0, 300), (1, 100)}
    assert sent.count() == 29 and sent.join(own.select("cell", "chunk").distinct(), ["cell", "chunk"]).count() == 29
