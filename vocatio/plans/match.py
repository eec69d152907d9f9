"""Queries on vectors, retrieval, ranks and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions import rules, text, vectors
from vocatio.operators import encode, joins, quality, retrieval
from vocatio.plans import views
from vocatio.plans.fields import SKILLED_SQL, skilled_postings
from vocatio.plans.registry import query
from vocatio.session import work_path, written

VEC_SQL = views.with_views("vectors")
RANKED_SQL = VEC_SQL + """, matches AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM pairs),
found AS (SELECT * FROM matches WHERE rank <= 50)
"""


def _long(*columns: str):
    return [F.col(c).cast("bigint").alias(c) for c in columns]


@query("vector_quality", """WITH e AS (SELECT vec_id % 40 AS m, CASE WHEN vec_id % 40 = 30 THEN CAST(embedding AS DOUBLE[])[1:5] ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
n AS (SELECT m, len(v) AS d, sqrt(list_sum([x * x for x in v])) AS norm FROM e)
SELECT count(*) AS rows, count(*) FILTER (WHERE m = 20) AS missing, count(*) FILTER (WHERE d <> 64 AND m <> 20) AS wrong_dimension,
  count(*) FILTER (WHERE abs(norm - 1) > 1e-6 AND m NOT IN (0, 10, 20)) AS norm_off, count(*) FILTER (WHERE m = 0) AS with_nan,
  count(*) FILTER (WHERE m = 10) AS with_inf, round(avg(norm) FILTER (WHERE m NOT IN (0, 10, 20)), 6) AS mean_norm FROM n""")
def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a table in which every tenth vector is spoilt."""
    rows = _with_bad_vectors(views.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"), "vec_id")
    return quality.vector_checks(rows, "vector", 64).withColumn("mean_norm", F.round("mean_norm", 6))


@query(
    "vector_normalise",
    """WITH s AS (SELECT vec_id, [x * (1 + vec_id % 3) for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum([x * x for x in v])) AS norm FROM s)
SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest([x / norm for x in v]), 6) AS value FROM n""",
)
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stretched by different factors, brought back to unit length."""
    stretched = views.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("v")
    )
    unit = quality.unit_vectors(stretched, "v")
    return unit.select("vec_id", F.posexplode("v").alias("dim", "value")).withColumn("value", F.round("value", 6))


def found(spark: SparkSession, sf_dir: str, k: int = presets.CANDIDATES) -> DataFrame:
    return retrieval.top_k(views.cv_vectors(spark, sf_dir).drop("label"), views.job_vectors(spark, sf_dir).drop("label"), k)


@query("knn_jobs_for_cv", RANKED_SQL + "SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM found")
def knn_jobs_for_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


@query(
    "knn_cvs_for_job",
    VEC_SQL
    + """SELECT item_id AS job_id, query_id AS cv_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, query_id) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 10""",
)
def knn_cvs_for_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other direction: ten CVs for every posting."""
    jobs = views.job_vectors(spark, sf_dir).select(F.col("item_id").alias("query_id"), "vector")
    cvs = views.cv_vectors(spark, sf_dir).select(F.col("query_id").alias("item_id"), "vector")
    return retrieval.top_k(jobs, cvs, presets.CVS_PER_JOB).select(F.col("query_id").alias("job_id"), F.col("item_id").alias("cv_id"), "score", "rank")


@query("knn_in_blocks", RANKED_SQL + "SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM found WHERE rank <= 10")
def knn_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for two large sides: blocks around pivots, of which those that may matter are multiplied."""
    queries, items = views.cv_vectors(spark, sf_dir).drop("label"), views.job_vectors(spark, sf_dir).drop("label")
    return retrieval.top_k(queries, items, 10, broadcast_limit=0, block_bytes=512 * 1024)


def _with_bad_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """Every tenth vector spoilt: by NaN, an infinite component, as null, or cut short."""
    v, n = F.col("vector"), F.col(key)
    spoilt = (
        F.when(n % 40 == 0, F.transform(v, lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x.cast("double"))))
        .when(n % 40 == 10, F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("-inf"))).otherwise(x.cast("double"))))
        .when(n % 40 == 20, F.lit(None).cast("array<double>"))
        .when(n % 40 == 30, F.slice(v, 1, 5).cast("array<double>"))
        .otherwise(v.cast("array<double>"))
    )
    return vectors.withColumn("vector", spoilt)


@query(
    "knn_with_rejects",
    VEC_SQL
    + """, good AS (SELECT * FROM job_vec WHERE CAST(substr(item_id, 2) AS BIGINT) % 10 <> 0),
near AS (SELECT query_id, item_id, floor(list_dot_product(q.v, j.v) * 1000000 + 0.5) / 1000000 AS score FROM cv_vec q, good j)
SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM near QUALIFY rank <= 10""",
)
def knn_with_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that cannot be compared take no part, and take no one else's place."""
    jobs = views.job_vectors(spark, sf_dir).drop("label").withColumn("n", F.substring("item_id", 2, 20).cast("bigint"))
    return retrieval.top_k(views.cv_vectors(spark, sf_dir).drop("label"), _with_bad_vectors(jobs, "n").drop("n"), 10)


@query(
    "rejected_vectors",
    """SELECT CASE vec_id % 40 WHEN 0 THEN 'NaN' WHEN 10 THEN 'infinite' WHEN 20 THEN 'null vector' ELSE 'wrong dimension' END AS reason,
  count(*) AS count FROM embeddings WHERE vec_id % 10 = 0 GROUP BY 1""",
)
def rejected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return retrieval.rejected_vectors(_with_bad_vectors(rows, "vec_id"))


CELLS = 16


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cell centres and placed items, stored by cell as a search would find them."""
    items = views.job_vectors(spark, sf_dir).drop("label")
    centres = written(retrieval.train_cells(items, CELLS), "centres")
    path = work_path(spark, "cells")
    retrieval.write_cell_index(items, centres, path)
    placed = spark.read.schema("item_id string, vector array<float>, cell int").parquet(f"{path}/items")
    return centres, placed


@query("ivf_full_probe", RANKED_SQL + "SELECT query_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM found WHERE rank <= 10")
def ivf_full_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing every cell must equal the exact search."""
    centres, placed = _index(spark, sf_dir)
    return retrieval.cell_top_k(views.cv_vectors(spark, sf_dir).drop("label"), placed, centres, 10, CELLS)


@query("ivf_probe")
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres, placed = _index(spark, sf_dir)
    return retrieval.cell_top_k(views.cv_vectors(spark, sf_dir).drop("label"), placed, centres, 10, 4)


@query(
    "cell_probe",
    VEC_SQL
    + """, centres AS (SELECT cell, list(a ORDER BY pos) AS v FROM (SELECT label AS cell, pos, round(avg(x), 6) AS a
    FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM job_vec) GROUP BY 1, 2) GROUP BY 1),
placed AS (SELECT item_id, j.v, cell FROM job_vec j, centres c
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY floor(list_dot_product(j.v, c.v) * 1000000 + 0.5) DESC, cell) = 1),
probed AS (SELECT query_id, q.v, cell FROM cv_vec q, centres c
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY floor(list_dot_product(q.v, c.v) * 1000000 + 0.5) DESC, cell) <= 3),
near AS (SELECT query_id, item_id, floor(list_dot_product(q.v, p.v) * 1000000 + 0.5) / 1000000 AS score FROM probed q JOIN placed p USING (cell))
SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM near QUALIFY rank <= 10""",
)
def cell_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of ten cells probed; the mean vector of each label is its centre."""
    items = views.job_vectors(spark, sf_dir)
    means = items.select("label", F.posexplode("vector")).groupBy("label", "pos").agg(F.round(F.avg("col"), 6).alias("mean"))
    centres = means.groupBy(F.col("label").alias("cell")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("vector")
    )
    centres = written(centres, "label-centres")
    placed = written(retrieval.assign_cells(items.drop("label"), centres), "placed")
    return retrieval.cell_top_k(views.cv_vectors(spark, sf_dir).drop("label"), placed, centres, 10, 3)


# True pair of a CV: the first posting of its label; some pairs name a CV that is not known.
TRUTH_SQL = """, truth AS (SELECT CASE WHEN CAST(substr(query_id, 2) AS BIGINT) % 10 = 0 THEN 'X' || query_id ELSE query_id END AS anchor,
  (SELECT min(item_id) FROM job_vec j WHERE j.label = c.label) AS match FROM cv_vec c)
"""


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cvs = views.cv_vectors(spark, sf_dir).select("query_id", "label")
    firsts = views.job_vectors(spark, sf_dir).groupBy("label").agg(F.min("item_id").alias("match"))
    number = F.substring("query_id", 2, 20).cast("bigint")
    anchor = F.when(number % 10 == 0, F.concat(F.lit("X"), "query_id")).otherwise(F.col("query_id"))
    return cvs.join(firsts, "label").select(anchor.alias("anchor"), "match")


@query(
    "recall_at_k",
    RANKED_SQL
    + TRUTH_SQL
    + """, judged AS (SELECT t.anchor, t.match, f.rank FROM truth t LEFT JOIN found f ON f.query_id = t.anchor AND f.item_id = t.match
  WHERE t.anchor IN (SELECT query_id FROM cv_vec))
SELECT k, count(*) FILTER (WHERE rank <= k) AS hits, count(*) AS pairs, round(count(*) FILTER (WHERE rank <= k)::DOUBLE / count(*), 6) AS recall
FROM judged, (SELECT unnest([1, 5, 10, 50]) AS k) GROUP BY k""",
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = retrieval.recall(found(spark, sf_dir), truth_pairs(spark, sf_dir), views.cv_vectors(spark, sf_dir))
    return scores.withColumn("recall", F.round("recall", 6))


@query(
    "truth_membership",
    RANKED_SQL + TRUTH_SQL + "SELECT query_id AS cv_id, item_id AS job_id, (query_id, item_id) IN (SELECT (anchor, match) FROM truth) AS is_ground_truth FROM found WHERE rank <= 10",
)
def truth_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = found(spark, sf_dir, 10).select(F.col("query_id").alias("cv_id"), F.col("item_id").alias("job_id"))
    truth = truth_pairs(spark, sf_dir).select(F.col("anchor").alias("cv_id"), F.col("match").alias("job_id"))
    return retrieval.with_truth(pairs, truth)


# Scores of the found pairs: the formula with the label as title category and a feedback term.
SCORED_SQL = RANKED_SQL + """, scored AS (
  SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, score,
    floor((score + 0.5 * CASE WHEN query_label = item_label THEN 0.5 ELSE 0.25 END + 0.1 * CAST(query_label = item_label AS INTEGER)
      + 0.1 * (1 - abs(query_label - item_label) / 10.0) + 0.3 * (CAST(substr(item_id, 2) AS BIGINT) % 5 - 2) / 2.0) * 10 * 1000000 + 0.5) / 1000000 AS pair_score
  FROM found)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found pairs with a pair score by the weighted formula, spread over the label bounds."""
    cvs = views.cv_vectors(spark, sf_dir).select("query_id", F.col("label").alias("query_label"))
    jobs = views.job_vectors(spark, sf_dir).select("item_id", F.col("label").alias("item_label"))
    pairs = found(spark, sf_dir).join(cvs, "query_id").join(jobs, "item_id")
    same = F.col("query_label") == F.col("item_label")
    number = F.substring("item_id", 2, 20).cast("bigint")
    total = encode.weighted_score(
        F.col("score"),
        F.when(same, 0.5).otherwise(0.25),
        same.cast("int"),
        1 - F.abs(F.col("query_label") - F.col("item_label")) / 10.0,
        (number % 5 - 2) / 2.0,
        {"delta": 0.3},
    )
    return pairs.select("query_id", "item_id", "rank", "score", vectors.quantised(total * 10).alias("pair_score"))


@query("weighted_score", SCORED_SQL + "SELECT query_id, item_id, rank, score, pair_score FROM scored")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


@query(
    "jaccard_score",
    SKILLED_SQL
    + """, cut AS (SELECT id, string_split(skills, ', ') AS a, string_split(job_title, ' ')[-2:] AS b FROM skilled WHERE skills IS NOT NULL),
both_sides AS (SELECT id, a, [array_to_string(b, ' '), 'red rod'] AS b FROM cut)
SELECT id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM both_sides""",
)
def jaccard_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill overlap of a posting's list and two skills, one of them from its title."""
    words = F.split("job_title", " ")
    own = F.array_join(F.slice(words, -2, 2), " ")
    rows = skilled_postings(spark, sf_dir).filter(F.col("skills").isNotNull())
    overlap = vectors.jaccard(F.split("skills", ", "), F.array(own, F.lit("red rod")))
    return rows.select("id", F.round(overlap, 6).alias("jaccard"))


@query(
    "best_match",
    SCORED_SQL + "SELECT query_id AS anchor, item_id AS match, pair_score AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, rank) = 1",
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.best_match(scored(spark, sf_dir).select("query_id", "item_id", "rank", F.col("pair_score").alias("score")))


RERANKED_SQL = SCORED_SQL + """, reranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, rank) AS INTEGER) AS new_rank FROM scored QUALIFY new_rank <= 30)
"""


@query("rerank", RERANKED_SQL + "SELECT query_id, item_id, rank, score, pair_score, new_rank, rank - new_rank AS change FROM reranked")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(scored(spark, sf_dir))


@query(
    "paginate",
    RERANKED_SQL + "SELECT query_id, item_id, new_rank, CAST(floor((new_rank - 1) / 10.0) + 1 AS INTEGER) AS page FROM reranked",
)
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = retrieval.paged(retrieval.rerank(scored(spark, sf_dir)), "new_rank")
    return pages.select("query_id", "item_id", "new_rank", "page")


@query(
    "match_labels",
    RERANKED_SQL + "SELECT CASE WHEN pair_score > 5 THEN 'GREAT' WHEN pair_score > 0 THEN 'GOOD' ELSE 'WEAK' END AS label, count(*) AS matches FROM reranked GROUP BY 1",
)
def match_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = retrieval.rerank(scored(spark, sf_dir))
    return matches.groupBy(rules.match_label(F.col("pair_score")).alias("label")).agg(F.count("*").alias("matches"))


@query(
    "score_distribution",
    SCORED_SQL
    + """, best AS (SELECT max(pair_score) AS s FROM scored GROUP BY query_id)
SELECT min(s) AS min, max(s) AS max, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median FROM best""",
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.best_match(scored(spark, sf_dir).select("query_id", "item_id", "rank", F.col("pair_score").alias("score")))
    return quality.distribution(best, "score").withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


def _hash_sql(source: str, key: str, name: str, value: str) -> str:
    """Signed token counters of unit norm: (k, v) with v of 64 doubles."""
    return f"""{name}_slots AS (
  SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT % 128 AS slot FROM (SELECT {key} AS k, unnest(regexp_extract_all(lower({value}), '[\\p{{L}}\\p{{N}}+#]+')) AS t FROM {source})),
{name}_sums AS (SELECT k, slot // 2 AS dim, sum(CASE WHEN slot % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_slots GROUP BY 1, 2),
{name}_norms AS (SELECT k, sqrt(sum(x * x)) AS norm FROM {name}_sums GROUP BY k),
{name}_enc AS (SELECT s.k, dim, CASE WHEN norm > 0 THEN x / norm ELSE x END AS x FROM {name}_sums s JOIN {name}_norms n ON n.k = s.k)"""


@query(
    "encode_texts",
    "WITH " + _hash_sql("documents", "doc_id", "doc", "text") + " SELECT k AS doc_id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS value FROM doc_enc WHERE x <> 0",
)
def encode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero entries of the hashed vectors of all documents."""
    vectors_ = encode.hash_encode(views.documents(spark, sf_dir), "doc_id", "text")
    entries = vectors_.select("doc_id", F.posexplode("vector").alias("dim", "value"))
    return entries.filter(F.col("value") != 0).withColumn("value", F.round("value", 6))


def letter_model(texts):
    """Length and two letter counts of each text: a stand-in for a user's encoder."""
    import numpy as np

    return np.array([[len(t), t.count("e"), t.count("a")] for t in texts], dtype=float).reshape(len(texts), 3)


@query(
    "encode_with_model",
    """WITH c AS (SELECT doc_id, [length(text), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'a', ''))]::DOUBLE[] AS v FROM documents)
SELECT doc_id, 'letters' AS encoder, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS dim, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) AS value FROM c""",
)
def encode_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a user's encoder, as unit vectors."""
    encoded = encode.encode(views.documents(spark, sf_dir), "doc_id", "text", letter_model, "letters")
    entries = encoded.select("doc_id", "encoder", F.posexplode("vector").alias("dim", "value"))
    return entries.withColumn("value", F.round("value", 6))


def overlap_model(pairs):
    """Share of the right text's words that the left text has: a stand-in for a user's pair model."""
    import numpy as np

    scores = []
    for left, right in pairs:
        words = set(right.lower().split())
        scores.append(len(words & set(left.lower().split())) / max(len(words), 1))
    return np.array(scores)


HASH_SQL = (
    "WITH "
    + _hash_sql("(SELECT doc_id, 'query: ' || text AS text FROM documents)", "doc_id", "doc", "text")
    + ", "
    + _hash_sql("(SELECT item_id, 'passage: ' || text AS text FROM benchmark)", "item_id", "bench", "text")
    + """, every AS (SELECT doc_id, item_id, text FROM (SELECT doc_id FROM documents), (SELECT item_id, text FROM benchmark)),
dots AS (SELECT a.k AS doc_id, b.k AS item_id, sum(a.x * b.x) AS s FROM doc_enc a JOIN bench_enc b USING (dim) GROUP BY 1, 2),
scored AS (SELECT e.doc_id AS query_id, e.item_id, floor(coalesce(s, 0) * 1000000 + 0.5) / 1000000 AS score, text
  FROM every e LEFT JOIN dots d ON d.doc_id = e.doc_id AND d.item_id = e.item_id),
candidates AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 20)
"""
)


@query(
    "pair_scores",
    HASH_SQL
    + """, worded AS (SELECT query_id, item_id, list_distinct(regexp_extract_all(lower(c.text), '\\S+')) AS r, regexp_extract_all(lower(d.text), '\\S+') AS l
  FROM candidates c JOIN documents d ON doc_id = query_id WHERE rank <= 5)
SELECT query_id, item_id, round(len(list_intersect(r, l))::DOUBLE / greatest(len(r), 1), 6) AS pair_score FROM worded""",
)
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best items of every document, each pair of texts scored by a user's model."""
    queries, items = _texts(spark, sf_dir)
    hits = match(queries, items, 5)
    pairs = hits.join(queries.withColumnRenamed("text", "left"), "query_id").join(items.withColumnRenamed("text", "right"), "item_id")
    scored_pairs = encode.score_pairs(pairs, "left", "right", overlap_model)
    return scored_pairs.select("query_id", "item_id", F.round("pair_score", 6).alias("pair_score"))


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queries = views.documents(spark, sf_dir).withColumnRenamed("doc_id", "query_id")
    return queries, views.table(spark, sf_dir, "benchmark").select("item_id", "text")


def match(
    queries: DataFrame, items: DataFrame, k: int = presets.PAGE_SIZE, candidates: int = presets.CANDIDATES,
    pair_score: Column | None = None,
) -> DataFrame:
    """From texts to ranked matches: prefix, encode, retrieve, score the pairs, keep the best ``k``.

    ``queries`` has (query_id, text), ``items`` (item_id, text). Without a pair score the order of
    retrieval stands.
    """
    asked = queries.withColumn("text", text.ensure_query_prefix(F.col("text")))
    offered = items.withColumn("text", text.ensure_prefix(F.col("text"), presets.PASSAGE_PREFIX))
    candidates = k if pair_score is None else candidates
    # Written, so that measuring and searching the vectors does not encode the texts again.
    query_vectors = written(encode.hash_encode(asked, "query_id", "text"), "query-vectors")
    item_vectors = written(encode.hash_encode(offered, "item_id", "text"), "item-vectors")
    hits = retrieval.top_k(query_vectors, item_vectors, candidates)
    if pair_score is None:
        return hits
    plain = offered.select("item_id", text.strip_prefixes(F.col("text")).alias("item_text"))
    detailed = joins.details(hits, plain).withColumn("pair_score", pair_score)
    return retrieval.rerank(detailed.drop("item_text"), k)


@query(
    "match_end_to_end",
    HASH_SQL
    + """, rescored AS (SELECT query_id, item_id, score, rank, floor((score + length(text) / 10000.0::DOUBLE) * 1000000 + 0.5) / 1000000 AS pair_score FROM candidates)
SELECT query_id, item_id, score, rank, pair_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pair_score DESC, rank) AS INTEGER) AS new_rank,
  rank - new_rank AS change FROM rescored QUALIFY new_rank <= 10""",
)
def match_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark texts; long items get a small bonus as pair score."""
    queries, items = _texts(spark, sf_dir)
    bonus = vectors.quantised(F.col("score") + F.length("item_text") / 10000.0)
    return match(queries, items, 10, 20, bonus)

