"""Quality rules, line dedup, shards and SimHash groups against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.oracle_check import compare, duck
from vocatio.llm import linededup, quality, queries, sharding, simhash
from vocatio.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words, windows, covered = WORD.findall(text), defaultdict(list), set()
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    for starts in windows.values():
        if len(starts) > 1:
            for i in starts:
                covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(docs_of, odd_pairs, spark, sf):
    pairs = [*odd_pairs, *((r.doc_id + 1000, r.text) for r in table(spark, sf, "documents").collect())]
    rows = quality.measure(docs_of(pairs)).collect()
    assert Counter(tuple(r)[:-1] for r in rows) == Counter((i, *base_counts(t)) for i, t in pairs)
    assert all(not (r.base_failed and r.kept) for r in rows)
    assert quality.measure(docs_of(pairs).limit(0)).count() == 0


@pytest.mark.parametrize("line, passes", [
    ("This is a sentence.", True), ('He said "yes."', True), ("Home | About | News | Contact.", False), ("A heading without an end", False),
    ("Buy now!! cheap!! pills!!", False), ("All rights reserved.", False), ("function() { return 1; };", False), ("...", True), ('"', False),
    ("A first sentence ends. " + "and a passage goes on " * 8 + "to the end of the page", True),
    ("A sentence ends. " + "\u00a0".join(["word"] * 60), False), ("\u0939\u093f\u0928\u094d\u0926\u0940 \u0935\u093e\u0915\u094d\u092f\u0964", True),
    ("\u0645\u0627 \u0647\u0630\u0627\u061f", True), ("\u06cc\u06c1 \u0627\u06cc\u06a9 \u062c\u0645\u0644\u06c1 \u06c1\u06d2\u06d4", True),
])
def test_line_rules(line, passes):
    assert quality.line_passes(line) is passes


def test_clean_keeps_good_text_and_columns(docs_of):
    good = "This is a long enough sentence of a clean document, with words and an end.\n" * 1 + "Another line follows here, it ends as well as it should."
    docs = docs_of([(1, good), (2, "x | y | z | w\n" * 9), (3, None), (4, good + "\nAll rights reserved."), (5, good)])
    out = quality.clean(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = {r.doc_id: r for r in out.collect()}
    assert sorted(rows) == [1, 4, 5] and rows[4].text == rows[1].text == good and rows[4].n_chars == len(good) and rows[1].clean_text == "z"
    assert quality.clean(docs.limit(0)).count() == 0


def plain_line_dedup(pairs):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))

    holders = defaultdict(set)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(float("inf") if i is None else i)
    out = []
    for i, t in pairs:
        lines = (t or "").split("\n")
        own = float("inf") if i is None else i
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (7, 3)])
def test_line_dedup(docs_of, odd_pairs, batches, fanout):
    rng = random.Random(2)
    lines = [f"Line number {n} of them all" for n in range(25)] + ["short", "", "  line NUMBER 3 of them all\t"]
    pairs = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for i in rng.sample(range(500), 60)] + odd_pairs
    docs = docs_of(pairs)
    expected = plain_line_dedup(pairs)
    found = linededup.report(docs, batches=batches, fanout=fanout).collect()
    assert Counter(map(tuple, found)) == Counter(e[:4] for e in expected)
    whole = linededup.dedup(docs, batches=batches, fanout=fanout)
    assert whole.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in whole.collect()) == Counter((e[0], e[4], len(e[4])) for e in expected)


def test_line_dedup_of_nothing(docs_of):
    assert linededup.report(docs_of([])).count() == 0


def test_line_dedup_leaves_no_tables(spark, docs_of):
    before = {t.name for t in spark.catalog.listTables()}
    found = linededup.report(docs_of([(i, f"the same long line\nline number {i} of all") for i in range(8)]), batches=4, fanout=2)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert {r.doc_id: r.n_dropped for r in found.collect()} == {i: int(i > 0) for i in range(8)}


def test_runs_are_levelled_and_read_without_a_shuffle(spark):
    state = linededup.LineRuns(spark, buckets=8, fanout=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for at in range(0, 60, 10):
            rows = spark.range(at, at + 20).selectExpr("id", "xxhash64(id) h1", "xxhash64(1, id) h2")
            again = state.add(rows).filter("seen").count()
            assert again == (10 if at else 0)
        assert [len(level) for level in state.levels] == [0, 1, 1]
        plan = spark.table(state.levels[1][0]).join(spark.table(state.levels[2][0]), ["h1", "h2"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        state.drop()


def test_line_dedup_query(spark, sf):
    assert compare(queries.QUERIES["op4_line_dedup_runs"](spark, sf), duck(sf), queries.ORACLES["op4_line_dedup_runs"]) is None


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1025])
def test_feistel_is_a_permutation(spark, n):
    df = sharding.position(spark.range(n).withColumnRenamed("id", "number"), "number", n, 3, "p")
    assert sorted(r.p for r in df.collect()) == list(range(n))


def test_shards(docs_of, odd_pairs):
    pairs = [*odd_pairs, *((i, f"text {i % 3}") for i in range(1000, 1200)), *[(7777, "a copy")] * 90]
    docs = docs_of(pairs)
    rows = sharding.shard(docs).collect()
    size = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, *size(t)) for i, t in pairs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    again = sharding.shard(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert Counter(map(tuple, sharding.shard(docs, seed=1).collect())) != Counter(map(tuple, rows))
    assert sharding.shard(docs.limit(0)).count() == 0


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, d):
    """{fingerprint: smallest fingerprint reached}, by looking at all pairs."""
    codes = sorted(set(prints))
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= d:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def near_texts(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = rng.choices(words, k=300)
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_components(docs_of, odd_pairs):
    pairs = [*odd_pairs, *((i + 1000, t) for i, t in enumerate(near_texts()))]
    prints = [plain_fingerprint(t) for _, t in pairs]
    roots, least = plain_components(prints, 3), {}
    for (i, _), p in zip(pairs, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    expected = Counter((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(pairs, prints))
    docs = docs_of(pairs)
    assert Counter(map(tuple, simhash.components(docs).collect())) == expected
    assert len(set(least)) < len(set(prints))  # some are linked
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.values())
    assert simhash.components(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def clustered(n, flips, seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, 2**64, max(1, n // 50), dtype=np.uint64)
    codes = rng.choice(codes, n)
    for _ in range(flips):
        codes ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return np.unique(codes)


@pytest.mark.parametrize("limit", [10, 100, 20_000])
@pytest.mark.parametrize("d", [0, 1, 3])
def test_links_find_all_components(spark, d, limit):
    codes = clustered(1500, 3, d)
    entries = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    found = {r.node: r.root for r in simhash.components_of(simhash.link_edges(entries, d, limit)).collect()}
    expected = plain_components(list(map(int, codes)), d)
    groups = lambda m: Counter(frozenset(g) for g in _inverse(m).values())
    own = {c: found.get(s, s) for c, s in zip(map(int, codes), map(int, codes.view(np.int64)))}
    assert groups(own) == groups(expected)


def _inverse(mapping):
    groups = defaultdict(set)
    for k, v in mapping.items():
        groups[v].add(k)
    return groups


def test_large_routes_prune_without_losing_links():
    codes = clustered(3000, 4, 9)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    root = simhash.links_in_route(codes, 3)
    expected = plain_components(list(map(int, codes)), 3)
    own = {int(c): int(codes[r]) for c, r in zip(codes, root)}
    assert Counter(map(frozenset, _inverse(own).values())) == Counter(map(frozenset, _inverse(expected).values()))


def test_a_large_group_leaves_a_route_as_a_forest():
    codes = np.unique(np.random.default_rng(0).integers(0, 8, 200, dtype=np.uint64))
    a, b = simhash.links_in_routes(np.zeros(len(codes), np.int64), codes, 3)
    assert len(a) == len(codes) - 1


def test_quality_query(spark, sf):
    assert compare(queries.QUERIES["op6_line_first_quality"](spark, sf), duck(sf), queries.ORACLES["op6_line_first_quality"]) is None
