"""Operators against brute force on small fixtures, with the paths that large data takes."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.operators import encode, feedback, joins, quality, retrieval, sampling, skills
from vocatio.operators.joins import left_joins
from vocatio.session import written
from vocatio.sources import messages


def vectors(spark, n, name, seed, dim=8):
    rng = np.random.default_rng(seed)
    # Few distinct values, so that many scores tie.
    rows = [(i, [float(x) for x in rng.integers(-1, 2, dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} bigint, vector array<double>")


def brute(queries, items, k):
    out = set()
    for q, v in queries:
        scored = sorted(((-float(np.dot(v, w)), i) for i, w in items))[:k]
        out |= {(q, i, rank, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


def as_set(df):
    return {(r["query_id"], r["item_id"], r["rank"], r["score"]) for r in df.collect()}


def test_all_forms_of_search_agree_with_brute_force(spark):
    q, queries = vectors(spark, 40, "query_id", 1)
    i, items = vectors(spark, 300, "item_id", 2)
    expected = brute(q, i, 7)
    assert as_set(retrieval.top_k(queries, items.repartition(5), 7)) == expected
    # Only the query side fits, then neither does.
    few = 40 * (8 * 8 + 64 + 4 * 2)
    assert as_set(retrieval.top_k(queries, items.repartition(5), 7, broadcast_limit=few)) == expected
    assert as_set(retrieval.top_k(queries, items.repartition(5), 7, broadcast_limit=0)) == expected


def test_bars_let_few_candidates_leave_and_change_no_row(spark, monkeypatch):
    q, queries = vectors(spark, 10, "query_id", 1)
    i, items = vectors(spark, 3000, "item_id", 2)
    monkeypatch.setattr(retrieval, "BAR_ITEMS", 600)
    few = 10 * (8 * 8 + 64 + 4)
    assert as_set(retrieval.top_k(queries, items.repartition(30), 5, broadcast_limit=few)) == brute(q, i, 5)
    schema = "query_id bigint, item_id bigint, score double"
    sent = retrieval._with_queries_everywhere(queries, items.repartition(30), 5, schema).count()
    assert sent < 10 * 5 * 30 / 2  # without bars all tasks would send five for each query


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    q, queries = vectors(spark, 8, "query_id", 1)
    good, _ = vectors(spark, 100, "item_id", 2)
    size, nan, inf = len(good[0][1]), float("nan"), float("inf")
    bad = [(1000, None), (1001, [nan] * size), (1002, [inf] * size), (1003, [1.0] * (size + 2)), (1004, [1.0] * (size - 2)), (1005, []), (1006, [None] * size)]
    bad += [(2000 + n, [nan] + [9.0] * (size - 1)) for n in range(6)]
    items = spark.createDataFrame(good + bad, "item_id bigint, vector array<double>")
    more = queries.unionByName(spark.createDataFrame([(77, [nan] * size), (78, None)], "query_id bigint, vector array<double>"))
    expected = brute(q, good, 5)
    for limit in (64 << 20, 8 * (8 * size + 64 + 8), 0):
        assert as_set(retrieval.top_k(more, items, 5, broadcast_limit=limit)) == expected
    reasons = {r["reason"]: r["count"] for r in retrieval.rejected_vectors(items).collect()}
    assert reasons == {"null vector": 1, "NaN": 7, "infinite": 1, "wrong dimension": 3, "null component": 1}


def test_forms_agree_on_scores_at_a_rounding_edge(spark):
    rng = np.random.default_rng(3)
    rows = [(n, (np.round(rng.normal(size=16), 3) / 1000).tolist()) for n in range(500)]
    items = spark.createDataFrame(rows, "item_id bigint, vector array<double>")
    queries = spark.createDataFrame(rows[:20], "query_id bigint, vector array<double>")
    forms = [as_set(retrieval.top_k(queries, items.repartition(n), 9, limit, block)) for n, limit, block in ((1, 64 << 20, 1 << 20), (7, 20 * 300, 1 << 20), (3, 0, 900))]
    assert forms[0] == forms[1] == forms[2]


def test_a_long_id_counts_for_all_in_the_size_check(spark):
    rows = spark.createDataFrame([("x" * 2000, [1.0])] + [(str(n), [1.0]) for n in range(10)], "item_id string, vector array<double>")
    assert retrieval._bytes(rows, "item_id", 1) >= 11 * 4 * 2000


def test_probing_reads_the_probed_cells_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(n, (np.eye(6)[n % 6] + rng.normal(size=6) / 50).tolist()) for n in range(300)]
    items = spark.createDataFrame(rows, "item_id bigint, vector array<double>")
    centres = spark.createDataFrame([(c, np.eye(6)[c].tolist()) for c in range(6)], "cell int, vector array<double>")
    retrieval.write_cell_index(items.repartition(20), centres, str(tmp_path))
    assert len(list((tmp_path / "items").glob("cell=*/*.parquet"))) == 6
    stored = spark.read.parquet(str(tmp_path / "centres"))
    assert {r["cell"]: r["n"] for r in stored.collect()} == {c: 50 for c in range(6)}
    placed = spark.read.parquet(str(tmp_path / "items"))
    query = spark.createDataFrame([(1, rows[0][1]), (2, [float("nan")] * 6)], "query_id bigint, vector array<double>")
    found = retrieval.cell_top_k(query, placed, stored, 5, 1)
    assert {r[:3] for r in as_set(found)} == {r[:3] for r in brute([(1, rows[0][1])], [r for r in rows if r[0] % 6 == 0], 5)}
    read = retrieval.probed_items(placed, spark.createDataFrame([(0,), (4,)], "cell int"))
    assert "PartitionFilters: [isnotnull" in (plan := read._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [cell" in plan
    assert {f.split("cell=")[1][0] for f in read.select("_metadata.file_path").distinct().toPandas()["file_path"]} == {"0", "4"}


def test_cells_grow_with_the_table():
    assert retrieval.cells_for(0) == 1 and retrieval.cells_for(100) == 40
    assert retrieval.cells_for(1_350_000) > 1500 and retrieval.cells_for(10**10) == 4 * 10**5


def test_nan_scores_come_last(spark):
    rows = [("q", "a", 1, float("nan")), ("q", "b", 2, 0.5), ("q", "c", 3, None)]
    scored = spark.createDataFrame(rows, "query_id string, item_id string, rank int, pair_score double")
    assert [r["item_id"] for r in retrieval.rerank(scored, 1).collect()] == ["b"]
    assert retrieval.best_match(scored.withColumnRenamed("pair_score", "score")).first()["match"] == "b"


def test_a_long_entry_makes_no_rows_where_it_does_not_start(spark):
    long_entry = " ".join(f"w{n}" for n in range(30))
    table = spark.createDataFrame([("python",), ("machine learning",), (long_entry,)], "phrase string")
    texts = spark.createDataFrame([(1, "we use Python and machine learning " * 20), (2, f"so {long_entry} here"), (3, None), (4, "w0 w1")], "id bigint, text string")
    for limit in (64 << 20, 0):
        assert {r["id"]: r["found"] for r in skills.find_phrases(texts, table, "id", "text", limit).collect()} == {
            1: ["machine learning", "python"], 2: [long_entry], 3: [], 4: []
        }
        assert {r["id"]: r["found"] for r in skills.find_phrases_in_order(texts, table, "id", "text", limit).collect()}[1] == ["python", "machine learning"]
    hits = {limit: skills.phrase_hits(texts, table, "id", "text", limit).groupBy("id").count().collect() for limit in (64 << 20, 0)}
    # The trie gives the first place of each phrase, the joins give every place; a text without one keeps a row.
    assert {r["id"]: r["count"] for r in hits[64 << 20]} == {1: 2, 2: 1, 3: 1, 4: 1}
    assert {r["id"]: r["count"] for r in hits[0]} == {1: 41, 2: 2, 3: 1, 4: 1}


def test_phrase_trie_equals_substring_search():
    rng = random.Random(3)
    phrases = {" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    root = skills.phrase_trie(sorted(phrases, key=lambda p: rng.random()))
    for n in (0, 1, 2, 30, 200):
        words = [rng.choice("abcd") for _ in range(n)]
        joined = f" {' '.join(words)} "
        found = skills.walk_trie(words, root)
        assert set(found) == {p for p in phrases if f" {p} " in joined}
        for p, (at, length) in found.items():
            assert words[at : at + length] == p.split() and joined.index(f" {p} ") == len(" ".join(["", *words[:at]]) if at else "")


def test_phrases_are_found_in_time_linear_in_the_text():
    """A dictionary in which every word starts a phrase; steps are counted, so no other work on the machine matters."""

    class Counted(dict):
        steps = 0

        def get(self, *a):
            Counted.steps += 1
            return super().get(*a)

    def counted(node):
        return node if isinstance(node, str) else Counted({w: counted(n) for w, n in node.items()})

    vocabulary = [f"w{n}" for n in range(50)]
    root = counted(skills.phrase_trie([f"{a} {b} {c}" for a in vocabulary for b in vocabulary[:10] for c in vocabulary[:5]] + vocabulary))
    steps = {}
    for n in (1000, 4000, 32_000):
        Counted.steps = 0
        skills.walk_trie([vocabulary[i * 7 % 50] for i in range(n)], root)
        steps[n] = Counted.steps
    assert steps[32_000] <= 33 * steps[1000] and steps[32_000] <= 5 * 32_000


def test_long_texts_with_dense_dictionaries(spark):
    vocabulary = [f"w{n}" for n in range(40)]
    table = spark.createDataFrame([(f"{a} {b}",) for a in vocabulary for b in vocabulary[::3]] + [(a,) for a in vocabulary], "phrase string")
    texts = spark.createDataFrame([(i, " ".join(vocabulary[(i + k * k // 7) % 40] for k in range(4000))) for i in range(4)], "id int, text string")
    one, two = ({r["id"]: r["found"] for r in skills.find_phrases(texts, table, "id", "text", limit).collect()} for limit in (64 << 20, 0))
    assert one == two and all(len(f) > 40 for f in one.values())


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], [3.0, 1.0, 2.0, 2.0, None], [7.0] * 40 + [8.0] * 39, [7.0] * 4 + [8.0] * 4, list(map(float, range(101)))])
def test_median_from_counts(spark, values):
    from statistics import median

    got = quality.distribution(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    present = [v for v in values if v is not None]
    assert got["median"] == (median(present) if present else None) and got["max"] == (max(present) if present else None)


def test_distribution_does_the_work_before_it_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def slow(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = quality.distribution(spark.range(100).mapInArrow(slow, "id long"), "id").first()
    assert got.asDict() == {"min": 0, "max": 99, "mean": 49.5, "median": 49.5} and seen.value == 100


def test_exact_sample_with_repeated_ids(spark):
    rows = spark.createDataFrame([(n % 7,) for n in range(70)] + [(None,)] * 5, "id bigint")
    for n in (0, 1, 5, 33, 74, 75, 80):
        assert sampling.sample_n(rows, "id", n).count() == min(n, 75)


def test_a_hot_id_in_chained_joins_is_split(spark):
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    base = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"), F.col("id").alias("row"))
    one, two = (spark.range(3000).select("id", F.lit(n).alias(n)) for n in ("a", "b"))
    assert joins.enriched(base, one, two).filter("a = 'a' AND b = 'b'").count() == 3000


def test_hot_ids_are_spread_without_session_settings(spark):
    """A third of all rows on one id, copies of one row among them: no task gets much more than another."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    kept = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("false", "-1", "16")):
            spark.conf.set(n, v)
        hot = F.when(F.col("id") % 3 == 0, -7).otherwise(F.col("id"))
        base = spark.range(0, 12_000, 1, 24).select(hot.alias("id"), F.when(hot == -7, 0).otherwise(F.col("id")).alias("row"))
        one = spark.range(12_000).select("id", F.lit("a").alias("a")).union(spark.createDataFrame([(-7, "hot"), (-7, "again"), (None, "x")], "id bigint, a string"))
        two = spark.range(6000).select("id", F.lit("b").alias("b"))
        plain = base.join(one, "id", "left").join(two, "id", "left")
        assert joins.hot_keys(base, ["id", "row"], 500) == {"id": [-7], "row": [0]} and joins.hot_keys(base, ["id"]) == {"id": []}
        found = joins.enriched(base, one, two, hot_rows=500)
        assert found.columns == plain.columns and found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0
        largest = lambda df: max(df.groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"])
        # 8,000 rows of the hot id met in one task; now in as many as there are salts or parts of the input.
        assert largest(plain) >= 8000 and largest(found) <= 3000
        pairs = base.select(F.col("id").alias("anchor"), F.col("row").alias("match"))
        people = spark.createDataFrame([(-7, "hot"), (0, "zero")], "id bigint, text string")
        assert joins.with_texts(pairs, people, people, hot_rows=500).filter("anchor_text = 'hot' AND positive_text = 'zero'").count() == 4000
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)


def test_copies_and_small_steps(spark, monkeypatch):
    """A third of all items are the same vector; every path must break the ties by id."""
    rng = np.random.default_rng(5)
    rows = [(n, [1.0, 1.0, 0.0]) if n % 3 == 0 else (n, [float(x) for x in rng.integers(-1, 2, 3)]) for n in range(400)]
    rng.shuffle(rows)
    leaders = retrieval._Leaders(np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), 9)
    monkeypatch.setattr(retrieval, "ITEMS_AT_ONCE", 32)
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 40)
    matrix, ids = np.array([v for _, v in rows]), np.array([n for n, _ in rows])
    for at in range(0, 400, 70):
        leaders.offer(matrix[at : at + 70], ids[at : at + 70])
    got = list(zip(*(column.tolist() for column in leaders.result())))
    queries = [(0, [1.0, 1.0, 0.0]), (1, [0.0, 0.0, 1.0])]
    assert got == sorted(((q, i, s) for q, i, _, s in brute(queries, rows, 9)), key=lambda r: (r[0], -r[2], r[1]))


def test_many_blocks(spark):
    q, queries = vectors(spark, 50, "query_id", 1)
    i, items = vectors(spark, 200, "item_id", 2)
    found = retrieval.top_k(queries, items, 5, broadcast_limit=0, block_bytes=1024)
    assert as_set(found) == brute(q, i, 5)


def test_two_large_sides_multiply_few_blocks(spark):
    """Groups of vectors in several directions and of a third copies: most pairs of blocks are ruled out, no result is lost."""
    rng = np.random.default_rng(8)
    axes = np.eye(12)
    rows = [(n, (axes[n % 12] + rng.normal(size=12) / 20).tolist()) for n in range(900)]
    rows += [(n, axes[0].tolist()) for n in range(900, 1300)]
    items = spark.createDataFrame(rows, "item_id bigint, vector array<double>")
    asked = [(n, (axes[n % 12] + rng.normal(size=12) / 20).tolist()) for n in range(120)]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    rounded = lambda found: {(q, i, rank, round(s, 6)) for q, i, rank, s in found}
    assert as_set(retrieval.top_k(queries, items, 6, broadcast_limit=0, block_bytes=3000)) == rounded(brute(asked, rows, 6))
    multiplied, pairs = retrieval.block_pairs(queries, items, 6, block_bytes=3000)
    assert multiplied <= 0.15 * pairs
    few = items.filter("item_id < 4")
    assert as_set(retrieval.top_k(queries, few, 6, broadcast_limit=0, block_bytes=300)) == rounded(brute(asked, rows[:4], 6))
    assert retrieval.top_k(queries, items.limit(0), 6, broadcast_limit=0).count() == 0


def test_two_large_sides_leave_the_driver_alone(spark, monkeypatch):
    _, queries = vectors(spark, 60, "query_id", 1)
    _, items = vectors(spark, 90, "item_id", 2)
    monkeypatch.setattr(retrieval, "_rows_of", lambda *_: pytest.fail("a side goes through the driver"))
    assert retrieval.top_k(queries, items, 5, broadcast_limit=0, block_bytes=2048).count() == 300


def test_cells(spark):
    q, queries = vectors(spark, 30, "query_id", 3)
    rows = [(n, [float(x) + 0.01 for x in v]) for n, v in vectors(spark, 200, "item_id", 4)[0]]
    items = spark.createDataFrame(rows, "item_id bigint, vector array<double>")
    centres = retrieval.train_cells(items, 6, train_rows=100)
    placed = retrieval.assign_cells(items, centres)
    assert placed.count() == 200
    full = retrieval.cell_top_k(queries, placed, centres, 10, 6)
    exact = retrieval.top_k(queries, items, 10)
    assert as_set(full) == as_set(exact)
    assert as_set(retrieval.cell_top_k(queries, placed, centres, 10, 6, block_bytes=512)) == as_set(exact)
    some = retrieval.cell_top_k(queries, placed, centres, 10, 1)
    assert 0 < some.count() <= 300 and some.filter("rank > 10").count() == 0


def test_cells_of_two_levels(spark, monkeypatch):
    """Centres in groups: fitted and looked up on executors, near the best cell, and every cell probed is an exact search."""
    rng = np.random.default_rng(8)
    homes = rng.normal(size=(40, 8))
    points = np.concatenate([homes[rng.integers(0, 40, 1200)] + 0.1 * rng.normal(size=(1200, 8)), np.tile(homes[0], (600, 1))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    items = spark.createDataFrame(rows, "item_id bigint, vector array<double>")
    collected, rows_of = [], retrieval._rows_of

    def counted(df, name):
        collected.append(df.count())
        return rows_of(df, name)

    monkeypatch.setattr(retrieval, "_rows_of", counted)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8_000)  # the third of the table that is one vector becomes many blocks
    centres = retrieval.train_cells(items, 64, rounds=4, flat_cells=8)
    heads = centres.orderBy("cell").collect()
    assert 32 <= len(heads) <= 64 and [r["cell"] for r in heads] == list(range(len(heads)))
    placed = written(retrieval.assign_cells(items, centres), "placed")
    assert max(collected) <= 8
    scores = points @ np.array([r["vector"] for r in heads]).T
    got = {r["item_id"]: r["cell"] for r in placed.collect()}
    assert sorted(got) == list(range(len(rows)))
    assert np.mean([scores[i, c] >= scores[i].max() - 1e-6 for i, c in got.items()]) >= 0.9
    asked = [(i, [float(x) for x in points[i]]) for i in range(0, 1200, 60)]
    queries = spark.createDataFrame(asked, "query_id bigint, vector array<double>")
    exact = as_set(retrieval.top_k(queries, items, 10))
    assert as_set(retrieval.cell_top_k(queries, placed, centres, 10, 64)) == exact
    few = as_set(retrieval.cell_top_k(queries, placed, centres, 10, 8))
    assert len({(q, i) for q, i, *_ in few} & {(q, i) for q, i, *_ in exact}) >= 0.9 * len(exact)


def test_mixed_encoders_are_refused(spark):
    _, queries = vectors(spark, 3, "query_id", 1)
    _, items = vectors(spark, 3, "item_id", 2)
    with pytest.raises(ValueError, match="encoders"):
        retrieval.top_k(queries.withColumn("encoder", F.lit("a")), items.withColumn("encoder", F.lit("b")), 1)


def test_rerank_and_best(spark):
    rows = [("q", "a", 1, 0.9, 1.0), ("q", "b", 2, 0.8, 3.0), ("q", "c", 3, 0.7, 3.0)]
    matches = spark.createDataFrame(rows, "query_id string, item_id string, rank int, score double, pair_score double")
    again = {r["item_id"]: (r["new_rank"], r["change"]) for r in retrieval.rerank(matches, 2).collect()}
    assert again == {"b": (1, 1), "c": (2, 1)}
    best = retrieval.best_match(matches.select("query_id", "item_id", "rank", F.col("pair_score").alias("score"))).first()
    assert (best["anchor"], best["match"], best["score"]) == ("q", "b", 3.0)


def test_pages(spark):
    pages = retrieval.paged(spark.range(1, 22).select(F.col("id").alias("rank"))).groupBy("page").count().collect()
    assert {r["page"]: r["count"] for r in pages} == {1: 10, 2: 10, 3: 1}


def naive_phrases(text, phrases):
    import re

    words = re.findall(r"(?:[^\W_]|[+#])+", text.lower())
    runs = {" ".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words))}
    return sorted(runs & set(phrases))


TEXTS = [
    (1, "Senior Python Developer, machine learning and Machine-Learning ops"),
    (2, "C++ and C# but no snake"),
    (3, ""),
    (4, None),
    (5, "learning machine"),
    (6, "big data, big data engineering; data"),
]
PHRASES = ["python", "machine learning", "machine", "c++", "c#", "big data engineering", "big data", "data", "learning ops x y"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_phrases(spark, limit):
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    table = skills.phrases(spark.createDataFrame([(p,) for p in [*PHRASES, "Big  Data", " "]], "skill string"))
    found = {r["id"]: r["found"] for r in skills.find_phrases(texts, table, "id", "text", limit).collect()}
    assert found == {i: naive_phrases(t or "", PHRASES) for i, t in TEXTS}
    ordered = {r["id"]: r["found"] for r in skills.find_phrases_in_order(texts, table, "id", "text", limit).collect()}
    assert ordered[1] == ["python", "machine", "machine learning"]
    assert ordered[6] == ["big data", "big data engineering", "data"] or ordered[6][0] == "big data"
    assert ordered[3] == [] and ordered[4] == []
    assert {i: sorted(v) for i, v in ordered.items()} == found


def test_empty_phrase_table(spark):
    texts = spark.createDataFrame(TEXTS, "id int, text string")
    table = spark.createDataFrame([], "phrase string")
    assert [r["found"] for r in skills.find_phrases(texts, table, "id", "text").collect()] == [[]] * len(TEXTS)


def test_dictionary_keeps_case_and_drops_blanks(spark):
    lists = spark.createDataFrame([("Python, python ,,SQL",), ("SQL",), (None,)], "skills string")
    assert {r["skill"]: r["count"] for r in skills.dictionary(lists).collect()} == {"Python": 1, "python": 1, "SQL": 2}


def test_proposals_and_approvals(spark):
    at = F.to_timestamp(F.lit("2024-01-01"))
    texts = spark.createDataFrame([("Redis here", "Redis there")] * 2 + [("Kafka", None)], "cv string, job string")
    sightings = skills.term_sightings(texts.withColumn("at", at), ["cv", "job"], "at")
    tracked = skills.tracked_skills(sightings, spark.createDataFrame([("KAFKA",)], "skill string"))
    assert {r["skill_name"]: r["frequency"] for r in tracked.collect()} == {"redis": 4}
    flagged = skills.with_approvals(tracked, spark.createDataFrame([("Redis",)], "skill_name string"))
    assert skills.proposals(flagged).count() == 0
    assert skills.skill_statistics(flagged).first().asDict() == {"total_tracked": 1, "pending": 0, "approved": 1}


def test_left_join_with_missing_and_repeated_links(spark):
    postings = spark.createDataFrame([("1", "a"), ("2", None), ("3", "b"), ("4", "a")], "id string, job_link string")
    lists = spark.createDataFrame([("a", "x, y"), ("a", "x, y"), ("a", "z"), (None, "q")], "job_link string, job_skills string")
    got = {r["id"]: r["skills"] for r in joins.with_skills(postings, lists).collect()}
    assert got == {"1": "x, y, z", "2": None, "3": None, "4": "x, y, z"}


def test_one_per_text(spark):
    rows = [(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)]
    kept = joins.one_per_text(spark.createDataFrame(rows, "id int, text string"), "text", "id")
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4]


def test_stable_ids(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    first = joins.with_stable_id(keys, "id")
    second = joins.with_stable_id(keys.repartition(13), "id")
    assert first.exceptAll(second).count() == 0
    assert joins.id_collisions(first).count() == 0
    assert first.filter(~F.col("job_id").rlike(r"^B\d+$")).count() == 0


def test_sample_is_exact_and_repeatable(spark):
    rows = spark.range(2000)
    for n in (0, 1, 999, 2000, 5000):
        sample = sampling.sample_n(rows.repartition(6), "id", n)
        assert sample.count() == min(n, 2000)
    a = {r["id"] for r in sampling.sample_n(rows, "id", 50).collect()}
    assert a == {r["id"] for r in sampling.sample_n(rows.repartition(11), "id", 50).collect()}
    assert a <= {r["id"] for r in sampling.sample_n(rows, "id", 60).collect()}


def test_sample_of_large_bins(spark, monkeypatch):
    rows = spark.range(3000)
    expected = {r["id"] for r in sampling.sample_n(rows, "id", 1234).collect()}
    monkeypatch.setattr(sampling, "SORTED_AT_ONCE", 0)
    assert {r["id"] for r in sampling.sample_n(rows, "id", 1234).collect()} == expected and len(expected) == 1234


def test_sample_with_equal_draws(spark):
    rows = spark.createDataFrame([(7,)] * 10 + [(i,) for i in range(100, 120)], "id bigint")
    for n in range(0, 31, 5):
        assert sampling.sample_n(rows, "id", n).count() == n


def test_allocation(spark):
    counts = spark.createDataFrame([(1, 50), (2, 150), (3, 8000), (4, 1800)], "stratum int, count bigint")
    got = {r["stratum"]: (r["allotted"], r["fraction"]) for r in sampling.allocation(counts, 1000, 100).collect()}
    # 50 rows are all taken, 150 rows would give 15 and get the minimum; 850 remain for 9800 rows.
    assert got[1] == (50, 1.0) and got[2][0] == 100
    assert got[3][0] == int(8000 / 9800 * 850) and got[4][0] == int(1800 / 9800 * 850)
    assert got[3][1] == pytest.approx(got[3][0] / 8000 * 1.1)


def test_splits(spark):
    rows = spark.range(20000).select("id", (F.col("id") % 4).alias("g"))
    split = rows.withColumn("split", sampling.stratified_split(F.col("id"), F.col("g")))
    for r in sampling.split_matrix(split, "g").collect():
        assert abs(r["train"] / 5000 - 0.8) < 0.03 and abs(r["val"] / 5000 - 0.1) < 0.03
        assert r["train"] + r["val"] + r["test"] == 5000
    assert sampling.split_overlap(split, "id").first().asDict() == {"train_val": 0, "train_test": 0, "val_test": 0}
    leaky = split.select("id", "split").unionAll(spark.createDataFrame([(i, "val") for i in range(50)], "id bigint, split string"))
    assert sampling.split_overlap(leaky, "id").first()["train_val"] > 0


def test_feedback_pairs(spark):
    rows = [("j", "c", 1.0), ("j", "c", -0.3), ("j", "d", 0.0), ("k", "c", -1.4)]
    events = spark.createDataFrame(rows, "job_id string, cv_id string, signal_strength double").withColumn("timestamp", F.current_timestamp())
    got = {(r["job_id"], r["cv_id"]): r for r in feedback.aggregated(events).collect()}
    assert got["j", "c"]["cumulative_score"] == pytest.approx(0.7) and got["j", "c"]["normalized_score"] == pytest.approx(0.5)
    assert (got["j", "d"]["positive_count"], got["j", "d"]["negative_count"], got["j", "d"]["normalized_score"]) == (0, 0, 0.0)
    zero = events.withColumn("signal_strength", F.lit(0.0))
    assert {r["normalized_score"] for r in feedback.aggregated(zero).collect()} == {0.0}


def test_weight_grid(spark):
    pairs = spark.createDataFrame([(1.0,), (0.5,), (-1.0,)], "normalized_score double")
    grid = feedback.weight_grid(pairs)
    assert grid.count() == 324
    first = grid.first()
    assert (first["alpha"], first["beta"], first["delta"], first["combo"]) == (0.8, 0.3, 0.3, 3)
    assert first["score"] == pytest.approx(0.3 * 0.75)
    none = feedback.weight_grid(pairs.filter("normalized_score < 0")).first()
    assert none["score"] == 0.0 and none["combo"] == 0
    wide = feedback.weight_grid(pairs, {"alpha": [3.0], "beta": [0.01], "gamma1": [0.1], "gamma2": [0.1], "delta": [0.0]})
    assert wide.first()["score"] == pytest.approx(-0.2)


def test_training_mix_sizes(spark):
    def pairs(n, tag):
        return spark.range(n).select("id", F.concat(F.lit(tag), "id").alias("anchor_text"), F.lit("p").alias("positive_text"))

    mixed = feedback.training_mix(pairs(20, "f"), pairs(500, "o"), "id")
    assert {r["origin"]: r["count"] for r in mixed.groupBy("origin").count().collect()} == {"feedback": 20, "original": 80}
    assert feedback.training_mix(pairs(20, "f"), pairs(30, "o"), "id").count() == 50
    assert feedback.training_mix(pairs(0, "f"), pairs(30, "o"), "id").count() == 0
    assert feedback.training_mix(pairs(3, "f"), pairs(2, "o"), "id").count() == 0


def test_action_reports(spark):
    rows = [(1, "apply", "job_seeker"), (2, "not_interested", "job_seeker"), (3, "skip", "recruiter")]
    log = feedback.logged(spark.createDataFrame(rows, "id int, action string, role string"))
    assert feedback.retrain_due(log, 2).first().asDict() == {"actions": 2, "due": True}
    report = {(r["metric"], r["key"]): (r["count"], r["weight"]) for r in feedback.action_summary(log).collect()}
    assert report["total", ""] == (3, None) and report["action", "not_interested"] == (1, -0.5) and report["role", "job_seeker"] == (2, None)
    assert feedback.latest_model(spark.createDataFrame([], "model_version string"), "base").first()[0] == "base"


def test_action_log_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    for action in ("apply", "dance"):
        feedback.append_actions(spark.createDataFrame([(1, action)], "id int, action string"), path)
    assert {(r["action"], r["weight"]) for r in spark.read.parquet(path).collect()} == {("apply", 1.0), ("dance", 0.0)}


def test_hash_encoder(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, ""), (4, None)], "id int, text string")
    got = {r["id"]: r["vector"] for r in encode.hash_encode(texts.repartition(3), "id", "text").collect()}
    assert got[1] == got[2] and np.linalg.norm(got[1]) == pytest.approx(1)
    assert not any(got[3]) and not any(got[4]) and len(got[1]) == encode.HASH_DIMENSIONS


def test_user_models(spark):
    texts = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(10)], "id int, text string")
    got = encode.encode(texts, "id", "text", lambda batch: np.array([[len(t), 0.0] for t in batch]), "lengths", batch=3)
    assert {(tuple(r["vector"]), r["encoder"]) for r in got.collect()} == {((1.0, 0.0), "lengths")}
    pairs = spark.createDataFrame([(1, "query: ab", "passage: abc")], "id int, l string, r string")
    scored = encode.score_pairs(pairs, "l", "r", lambda batch: np.array([len(a) * 10 + len(b) for a, b in batch]))
    assert scored.first().asDict() == {"id": 1, "l": "query: ab", "r": "passage: abc", "pair_score": 23.0}


def test_model_batches_keep_to_a_token_budget(spark, tmp_path):
    """A counting model sees texts of like length within the budget, is loaded once per worker, and rows keep their values."""
    log, words = str(tmp_path), [1, 50, 2, 49, 3, 48, 400, 1, 2, 3] * 30
    texts = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(words)] + [(999, None)], "id int, text string").coalesce(2)

    def load():
        import os
        import uuid

        open(f"{log}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(batch):
            sizes = [len(t.split()) if t else 1 for t in batch]
            with open(f"{log}/calls-{os.getpid()}", "a") as out:
                out.write(f"{len(batch)} {max(sizes)} {sum(sizes)}\n")
            return np.array([[1.0, s] for s in sizes])

        return model

    model = encode.LoadedOnce(load)
    for _ in range(2):
        got = encode.encode(texts, "id", "text", model, "counted", batch=32, budget=100, size=lambda t: len(t.split()) if t else 1).collect()
        for i, n in [*enumerate(words), (999, 1)]:
            (vector,) = [r["vector"] for r in got if r["id"] == i]
            assert vector[1] / vector[0] == pytest.approx(n)
    calls = [tuple(map(int, line.split())) for f in tmp_path.glob("calls-*") for line in f.read_text().splitlines()]
    assert all(n <= 32 and (n * longest <= 100 or n == 1) for n, longest, _ in calls) and max(n for n, _, _ in calls) == 32
    padded, real = sum(n * longest for n, longest, _ in calls), sum(total for _, _, total in calls)
    assert real == 2 * (sum(words) + 1) and padded < 1.1 * real
    workers = [f.name.split("-")[1] for f in tmp_path.glob("load-*")]
    assert len(workers) == len(set(workers))


def test_row_differences_name_what_is_lost(spark):
    """One lost and one altered row among 10^5, whatever the order; rows of equal buckets are not shuffled."""
    rows = spark.range(100_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id") % 7).alias("v"), F.lit(None).cast("int").alias("n"))
    came = rows.filter("k <> 17").withColumn("v", F.when(F.col("k") == 4242, "other").otherwise(F.col("v"))).repartition(5, "v").withColumn("more", F.lit(1))
    found = quality.row_differences(rows, came, "k")
    assert sorted(tuple(r) for r in found.collect()) == [(17, "lost", 1, 0), (4242, "altered", 1, 1)]
    tree = found._jdf.queryExecution().executedPlan().toString()
    assert tree.split("Initial Plan")[0].count("BroadcastHashJoin") >= 1 and "CartesianProduct" not in tree
    assert quality.row_differences(rows, rows.orderBy(F.desc("k")), "k").count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (2, ""), (3, "x"), (3, "x")], "k int, v string")
    back = spark.createDataFrame([(None, "a"), (1, ""), (2, ""), (3, "x"), (3, "x"), (3, "x"), (4, "new")], "k int, v string")
    got = {tuple(r) for r in quality.row_differences(odd, back, "k", buckets=2).collect()}
    assert got == {(None, "lost", 1, 0), (1, "altered", 1, 1), (3, "added", 0, 1), (4, "added", 0, 1)}
    assert quality.row_differences(odd.limit(0), odd.limit(0), "k").count() == 0


def test_vector_checks(spark):
    rows = [([1.0, 0.0],), ([2.0, 0.0],), ([1.0],), ([float("nan"), 0.0],), ([float("inf"), 0.0],)]
    got = quality.vector_checks(spark.createDataFrame(rows, "v array<double>"), "v", 2).first().asDict()
    assert (got["wrong_dimension"], got["with_nan"], got["with_inf"]) == (1, 1, 1)
    unit = spark.createDataFrame([([1.0, 0.001],), ([0.999, 0.0],)], "v array<double>")
    assert quality.unit_vectors(unit, "v").collect() == unit.collect()
    long = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r["v"] for r in quality.unit_vectors(long, "v").collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_messages(spark):
    values = ['{"id":"1","source":"s"}', "{bad", "[1]", '"x"', '{"id":""}', '{"source":"s"}', '{"id":"1","source":"t"}', '{"id":2}']
    sent = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "value string, at int")
    parsed = messages.parsed(sent)
    kinds = [r["error_type"] for r in parsed.orderBy("at").collect()]
    assert kinds == [None, "JSONDecodeError", "AttributeError", "AttributeError", "ValueError", "ValueError", None, None]
    rows = messages.records(parsed, extra=("at",))
    first = {r["id"]: r["source"] for r in messages.first_of_each_id(rows, "at").collect()}
    assert first == {"1": "s", "2": ""}
    assert messages.dead_letters(parsed).count() == 5
    twice = messages.parsed(spark.createDataFrame([('{"id":"1","id":"2"}',)], "value string")).first()
    assert (twice["error_type"], twice["id"]) == (None, "2")


def test_positions_are_those_of_the_shuffled_order(spark):
    rows = spark.range(500).repartition(7)
    order = [r["id"] for r in sampling.shuffled(rows, "id").collect()]
    placed = {r["position"]: r["id"] for r in sampling.shuffled_positions(rows, "id").collect()}
    assert [placed[n] for n in range(500)] == order and order != sorted(order)
    assert sampling.shuffled_positions(rows.limit(0), "id").count() == 0


def test_terms_of_any_length(spark):
    """Frequent runs equal those of a plain count, however long; a dictionary takes a term of twelve words."""
    long_term = "senior certified cloud platform engineer for distributed data systems and search services"
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [f"we seek a {long_term} now", f"{long_term}!", None, "", "  ", texts[3] + " zz", texts[3]]
    counts = Counter()
    for t in texts:
        words = re.findall(r"[\w+#]+", (t or "").lower())
        counts.update(" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
    for least in (2, 5):
        expected = {r: n for r, n in counts.items() if n >= least and len(r) > 2 and r not in presets.REFRESH_STOP_TERMS}
        got = skills.frequent_terms(spark.createDataFrame([(t,) for t in texts], "t string"), "t", least).collect()
        assert len(got) == len(expected) and {r["skill"]: r["count"] for r in got} == expected
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    known = spark.createDataFrame([("Senior Certified", 4)], "skill string, count bigint")
    fresh = {r["skill"]: r["count"] for r in skills.refreshed_dictionary(known, skills.frequent_terms(frame, "t")).collect()}
    assert fresh[long_term] == 1 and fresh["Senior Certified"] == 4 and "senior certified" not in fresh
    assert skills.frequent_terms(frame.limit(0), "t").count() == 0


def test_rare_words_leave_no_rows(spark, monkeypatch):
    """Only places of frequent words go on: what is written beside the words is as large as the repeats."""
    texts = [" ".join(f"w{n}" for n in range(at, at + 100)) for at in range(0, 2000, 100)] + ["data lake or data lake"]
    rows = []

    def counted(df, name):
        out = written(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(skills, "written", counted)
    got = {r["skill"]: r["count"] for r in skills.frequent_terms(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == {"data": 2, "lake": 2, "data lake": 2}
    assert sum(n for name, n in rows if name != "words") < 50


def test_terms_end_where_clauses_do(spark):
    frame = spark.createDataFrame([("Java, data lake. Java\ndata lake",), (None,), (",",)], "t string")
    got = {r["skill"]: r["count"] for r in skills.frequent_terms(skills.clauses(frame, "t"), "t").collect()}
    assert got == {"java": 2, "data": 2, "lake": 2, "data lake": 2}


def test_hot_runs_are_spread(spark, monkeypatch):
    """A word that is a third of all rows goes to many tasks, and the terms stay the same."""
    frame = spark.createDataFrame([(f"hot w{i} w{i}",) for i in range(400)], "t string")
    plain = sorted(map(tuple, skills.frequent_terms(frame, "t").collect()))
    seen = []
    monkeypatch.setattr(skills, "HOT_ROWS", 100)
    monkeypatch.setattr(skills, "left_joins", lambda base, others, on, hot: seen.extend(hot) or left_joins(base, others, on, hot))
    assert sorted(map(tuple, skills.frequent_terms(frame, "t").collect())) == plain
    assert seen


def test_single_precision_loses_no_item(monkeypatch):
    """Scores that differ in the seventh digit, and vectors too long for single precision, rank as in double precision."""
    rng = np.random.default_rng(3)
    for scale in (1.0, 300.0, 1e16):
        queries = rng.normal(size=(20, 64)) * scale
        base = rng.normal(size=(1, 64))
        items = (base + rng.normal(size=(3000, 64)) * 1e-7) / scale
        units = np.floor(np.stack([np.einsum("ij,ij->i", np.repeat(queries[[q]], len(items), 0), items) for q in range(20)]) * 1e6 + 0.5)
        leaders = retrieval._Leaders(queries, 7)
        for at in range(0, 3000, 500):
            leaders.offer(items[at : at + 500], np.arange(at, at + 500))
        rows, found, _ = leaders.result()
        best = [np.lexsort((np.arange(3000), -units[q]))[:7].tolist() for q in range(20)]
        assert [found[rows == q].tolist() for q in range(20)] == best


def test_a_task_holds_a_bounded_number_of_results(spark, monkeypatch):
    """Queries that ask for many results are dealt to more tasks; what a task holds does not grow with the tables."""
    held, leaders = 40, retrieval._Leaders
    assert retrieval._rows_held(50, 576) * 50 <= retrieval.RESULTS_AT_ONCE
    bounds = spark.createDataFrame([(n, 7) for n in range(100)], "block long, n long")
    sizes = [r["n"] for r in retrieval._stripes(bounds, held).groupBy("stripe").agg((F.count("*") * 7).alias("n")).collect()]
    assert max(sizes) <= held and sum(sizes) == 700
    assert leaders(np.ones((2, 2)), 3).pending == 0
    _, queries = vectors(spark, 300, "query_id", 1)
    _, items = vectors(spark, 400, "item_id", 2)
    exact = as_set(retrieval.top_k(queries, items, 5))
    monkeypatch.setattr(retrieval, "RESULTS_AT_ONCE", 200)
    monkeypatch.setattr(retrieval, "STREAM_BYTES", 4000)
    assert as_set(retrieval.top_k(queries, items, 5)) == exact
    assert as_set(retrieval.top_k(queries, items, 5, broadcast_limit=0)) == exact
    text = retrieval.top_k(queries, items, 5, broadcast_limit=0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in text


def test_results_held_are_small_whatever_the_ids_are(spark):
    """A task's results hold numbers, not ids; bounds reach the executors without Python workers of another kind."""
    import tracemalloc

    rng = np.random.default_rng(4)
    queries, items = rng.normal(size=(2000, 8)), rng.normal(size=(6000, 8))
    names = np.array([f"{n:040}" for n in rng.permutation(6000)])
    tracemalloc.start()
    try:
        leaders = retrieval._Leaders(queries, 50)
        # Few at a time, so that all of the first are results.
        for at in range(0, 6000, 50):
            leaders.offer(items[at : at + 50], names[at : at + 50])
        rows, found, scores = leaders.result()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6
    for q in range(0, 2000, 200):
        units = np.floor(np.einsum("ij,ij->i", np.repeat(queries[[q]], 6000, 0), items) * 1e6 + 0.5)
        best = np.lexsort((names, -units))[:50]
        assert found[rows == q].tolist() == names[best].tolist() and scores[rows == q].tolist() == (units[best] / 1e6).tolist()
    bounds = spark.createDataFrame([(n, 7) for n in range(10)], "block long, n long")
    assert "ExistingRDD" not in retrieval._stripes(bounds, 40)._jdf.queryExecution().toString()


def test_ids_of_items_that_lost_their_place_are_dropped(monkeypatch):
    """Ids are looked through again and again, between and within slices, and numbered anew; ties still go to the smaller id."""
    monkeypatch.setattr(retrieval, "ID_BYTES", 500)
    monkeypatch.setattr(retrieval, "SCORES_AT_ONCE", 64)
    rng = np.random.default_rng(6)
    queries, items = rng.integers(-2, 3, size=(30, 4)).astype(float), rng.integers(-2, 3, size=(2000, 4)).astype(float)
    names = np.array([("é" if n % 3 else "z") + str(n) for n in rng.permutation(2000)])
    leaders = retrieval._Leaders(queries, 6)
    for at in range(0, 2000, 35):
        leaders.offer(items[at : at + 35], names[at : at + 35])
        assert leaders.n_ids <= 2000 and leaders.id_bytes <= 500 + 3 * leaders.id_bytes_kept + 2000
    rows, found, _ = leaders.result()
    for q in range(30):
        best = np.lexsort((names, -(items @ queries[q])))[:6]
        assert found[rows == q].tolist() == names[best].tolist()
    assert leaders.n_ids <= 30 * 6
