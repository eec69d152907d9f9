"""The stages of a full run, each reading and writing tables.

Every stage is a plan over the operators; a stage's output folder is the next one's input, so a
run can stop and go on between stages.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions import cvs, render, rules, text
from vocatio.operators import encode, feedback, joins, retrieval, sampling, skills
from vocatio.session import written
from vocatio.sources import files, messages, postings

Encoder = Callable[[DataFrame, str, str], DataFrame]


def ingest_postings(
    spark: SparkSession, paths: Mapping[str, str], out: str, max_rows: int | None = None, multi_line: bool = True
) -> None:
    """CSV files of the sources to one table of unified rows, and the rows that do not fit to the dead letters.

    Descriptions have line breaks, so files are read with ``multi_line`` unless all are known to have none.
    """
    rows = [postings.unified(postings.read_source(spark, s, p, max_rows, multi_line), s) for s, p in paths.items()]
    files.write_rows(postings.union_all(rows), f"{out}/raw_postings")
    bad = [files.rejected_csv(spark, p, postings.source_schema(s), multi_line) for s, p in paths.items()]
    postings.union_all(bad).write.mode("overwrite").parquet(f"{out}/dead_postings")


def ingest_messages(sent: DataFrame, order: str, out: str, at: Column | None = None) -> None:
    """A batch of messages to unified rows, each id once, and dead letters."""
    parsed = messages.parsed(sent)
    first = messages.first_of_each_id(messages.records(parsed, extra=(order,)), order)
    files.write_rows(first.drop(order, "deliveries"), f"{out}/raw_postings", presets.MESSAGES_PER_FILE)
    messages.dead_letters(parsed, at=at).write.mode("overwrite").parquet(f"{out}/dead_letters")


def ingest_cvs(spark: SparkSession, path: str, source: str, out: str) -> None:
    """JSON lines to CV messages and dead letters."""
    good, bad = files.read_json_lines(spark, path, source)
    files.write_rows(good, f"{out}/raw_cvs")
    bad.write.mode("overwrite").parquet(f"{out}/dead_letters")


def prepare_postings(
    spark: SparkSession, out: str, skills_csv: str, min_count: int = presets.MIN_DICTIONARY_COUNT
) -> None:
    """Skills, seniority and search text of all postings; one row per text.

    Linked postings take their skills from the list of their link, the others from the dictionary
    phrases in their description. Each source is handled once, so no posting appears twice.
    """
    raw = spark.read.parquet(f"{out}/raw_postings")
    lists = files.read_csv(spark, skills_csv, "job_link string, job_skills string")
    linked = joins.with_skills(raw.filter(F.col("source") == "linkedin"), lists)
    skills.dictionary(linked).write.mode("overwrite").parquet(f"{out}/all_skills")

    known = skills.quality_skills(spark.read.parquet(f"{out}/all_skills"), min_count)
    described = raw.filter(F.col("source") != "linkedin")
    found = skills.find_phrases(described, skills.phrases(known), "id", "description")
    others = described.join(found.select("id", F.array_join("found", ", ").alias("skills")), "id", "left")

    every = linked.unionByName(others).withColumn("seniority", rules.seniority_by_substring(F.col("job_title")))
    nothing = F.lit(None)
    rendered = render.job_text_full(
        *[F.col(c) for c in ("job_title", "company", "job_location", "skills", "seniority")],
        nothing.cast("double"), nothing.cast("double"), nothing.cast("string"),
    )
    columns = ["id", "job_title", "company", "job_location", "skills", "seniority", "embedding_text"]
    unified = every.withColumn("embedding_text", rendered).select(*columns)
    files.write_rows(joins.one_per_text(unified, "embedding_text", "id"), f"{out}/unified_jobs")


def prepare_cvs(spark: SparkSession, out: str, as_of: Column) -> None:
    """Normalised fields, skills, education and search text of all CVs, in one pass."""
    parsed = spark.read.parquet(f"{out}/raw_cvs").withColumn("cv", F.from_json("raw_data", cvs.CV_SCHEMA))
    first = F.get(F.col("cv.experience"), 0)
    rows = parsed.select(
        "id",
        "source",
        F.coalesce(rules.clean(first["title"]), F.lit(presets.DEFAULT_TITLE)).alias("title"),
        F.coalesce(rules.clean(first["company"], presets.COMPANY_PLACEHOLDERS), F.lit(presets.DEFAULT_COMPANY)).alias("company"),
        rules.clean(first["level"]).alias("given_level"),
        F.coalesce(cvs.total_years(F.col("cv.experience"), as_of), F.lit(0.0)).alias("total_years"),
        F.array_join(cvs.skill_names(F.col("cv")), ", ").alias("skills"),
        cvs.education(F.col("cv")).alias("education_summary"),
    )
    levelled = joins.default_skills(rows.withColumn("level", rules.cv_level(F.col("given_level"), F.col("total_years"))))
    body = render.cv_text(*[F.col(c) for c in ("title", "total_years", "level", "skills", "education_summary", "company")])
    files.write_rows(
        levelled.drop("given_level").withColumn("text", text.add_prefix(body, presets.QUERY_PREFIX)), f"{out}/cvs"
    )


def sample_postings(spark: SparkSession, out: str, target: int, minimum: int) -> None:
    """Stable ids, occupation groups and a stratified sample with its summary."""
    jobs = joins.with_stable_id(spark.read.parquet(f"{out}/unified_jobs"), "id")
    jobs = jobs.withColumn("isco_code", rules.occupation_group(F.col("job_title")))
    files.write_rows(jobs.select("original_uuid", "job_id"), f"{out}/id_mapping")
    counts = jobs.groupBy(F.col("isco_code").alias("stratum")).agg(F.count("*").alias("count"))
    sample = sampling.stratified_sample(jobs, "job_id", "isco_code", sampling.allocation(counts, target, minimum))
    chosen = sample.select("job_id", text.add_prefix(F.col("embedding_text"), presets.PASSAGE_PREFIX).alias("embedding_text"), "isco_code")
    files.write_rows(chosen, f"{out}/jobs_to_embed")
    kept = spark.read.parquet(f"{out}/jobs_to_embed")
    summary = sampling.stratum_summary(jobs, kept, "isco_code").withColumn("name", rules.occupation_name(F.col("stratum")))
    files.write_summary(summary, f"{out}/isco_distribution")


def embed(spark: SparkSession, out: str, encoder: Encoder = encode.hash_encode) -> None:
    """Vectors of the sampled postings and of all CVs, with the encoder's name.

    Postings keep their text and occupation group beside the vector. All vectors of a table have the
    size of most of them, or the write fails.
    """
    jobs, people = spark.read.parquet(f"{out}/jobs_to_embed"), spark.read.parquet(f"{out}/cvs")
    for rows, id_column, column, beside, name in (
        (jobs, "job_id", "embedding_text", ["embedding_text", "isco_code"], "jobs_embedded"), (people, "id", "text", [], "cvs_embedded"),
    ):
        # Written before it is joined and measured, so that the encoder runs once.
        vectors = written(encoder(rows, id_column, column), "vectors")
        if beside:
            vectors = vectors.join(rows.select(id_column, *beside), id_column)
        files.write_embeddings(vectors, f"{out}/{name}", "vector", retrieval.dimension_of(vectors))


def split(spark: SparkSession, out: str) -> None:
    """Splits of CVs at random and of postings within their occupation group."""
    people, jobs = spark.read.parquet(f"{out}/cvs"), spark.read.parquet(f"{out}/jobs_to_embed")
    people.select(F.col("id").alias("anchor"), sampling.split_of(F.col("id")).alias("split")).write.mode("overwrite").parquet(f"{out}/cv_splits")
    jobs.withColumn("split", sampling.stratified_split(F.col("job_id"), F.col("isco_code"))).select("job_id", "isco_code", "split").write.mode(
        "overwrite"
    ).parquet(f"{out}/job_splits")


def _vectors(spark: SparkSession, out: str, anchors: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    people = spark.read.parquet(f"{out}/cvs_embedded").withColumnRenamed("id", "query_id")
    if anchors is not None:
        people = joins.only(people, anchors.withColumnRenamed("anchor", "query_id"), "query_id")
    jobs = spark.read.parquet(f"{out}/jobs_embedded").select(F.col("job_id").alias("item_id"), "vector", "encoder")
    return people, jobs


def training_pairs(spark: SparkSession, out: str, name: str, scorer: Callable[[DataFrame], DataFrame], k: int = presets.CANDIDATES) -> None:
    """Candidates of the CVs of a split, scored in pairs; the best one per CV with both texts.

    ``scorer`` adds ``pair_score`` to rows with ``anchor_text`` and ``positive_text``.
    """
    anchors = spark.read.parquet(f"{out}/cv_splits").filter(F.col("split") == name)
    hits = retrieval.top_k(*_vectors(spark, out, anchors), k)
    people = spark.read.parquet(f"{out}/cvs").select("id", text.fix_query_case(F.col("text")).alias("text"))
    jobs = spark.read.parquet(f"{out}/jobs_to_embed").select(F.col("job_id").alias("id"), F.col("embedding_text").alias("text"))
    pairs = hits.select(F.col("query_id").alias("anchor"), F.col("item_id").alias("match"), "rank")
    scored = scorer(joins.with_texts(pairs, people, jobs))
    best = retrieval.best_match(
        scored.select(F.col("anchor").alias("query_id"), F.col("match").alias("item_id"), "rank", F.col("pair_score").alias("score"))
    )
    best.write.mode("overwrite").parquet(f"{out}/{name}_pairs")
    best = spark.read.parquet(f"{out}/{name}_pairs")
    files.write_csv(best.select("anchor", "match"), f"{out}/{name}_pairs_csv")
    joins.with_texts(best, people, jobs).select("anchor_text", "positive_text").write.mode("overwrite").parquet(f"{out}/{name}_dataset")


def build_index(spark: SparkSession, out: str, cells: int | None = None, rounds: int = presets.IVF_ROUNDS) -> None:
    """Postings placed in cells for probed search; without ``cells`` their number follows from the postings."""
    _, items = _vectors(spark, out, None)
    retrieval.write_cell_index(items, retrieval.train_cells(items, cells, rounds=rounds), f"{out}/index")


def search(spark: SparkSession, out: str, queries: DataFrame, k: int = presets.CANDIDATES, probes: int = presets.IVF_PROBES) -> DataFrame:
    """Probed search of vectors (query_id, vector) in the stored index."""
    items = spark.read.parquet(f"{out}/index/items")
    return retrieval.cell_top_k(queries, items, spark.read.parquet(f"{out}/index/centres"), k, probes)


def match_texts(
    spark: SparkSession, out: str, queries: DataFrame, scorer: Callable[[DataFrame], DataFrame], encoder: Encoder = encode.hash_encode,
    k: int = presets.CANDIDATES, keep: int = presets.RERANK_KEEP, probes: int = presets.IVF_PROBES,
) -> DataFrame:
    """From texts (query_id, text) to re-ranked postings with their details, over the stored index.

    The texts are encoded as the postings were, the nearest cells are searched, the found postings get
    their texts, and ``scorer`` adds ``pair_score`` to rows with ``anchor_text`` and ``positive_text``.
    """
    asked = queries.withColumn("text", text.ensure_query_prefix(F.col("text")))
    vectors = written(encoder(asked, "query_id", "text"), "query-vectors")
    hits = search(spark, out, vectors, k, probes)
    jobs = spark.read.parquet(f"{out}/jobs_embedded").select(F.col("job_id").alias("item_id"), "embedding_text", "isco_code")
    pairs = joins.details(hits, jobs, "item_id").join(asked.select("query_id", F.col("text").alias("anchor_text")), "query_id")
    scored = scorer(pairs.withColumnRenamed("embedding_text", "positive_text"))
    return retrieval.rerank(scored, keep).select(
        "query_id", "item_id", "score", "rank", "pair_score", "new_rank", "change", F.col("positive_text").alias("embedding_text"), "isco_code"
    )


def record_actions(actions: DataFrame, out: str) -> None:
    """Users' actions with their weights into the action log of the run."""
    feedback.append_actions(actions, f"{out}/action_log")


def evaluate(spark: SparkSession, out: str, name: str = "val") -> DataFrame:
    """Recall of exact search on the pairs of a split."""
    truth = spark.read.parquet(f"{out}/{name}_pairs")
    people, items = _vectors(spark, out, truth.select("anchor"))
    return retrieval.recall(retrieval.top_k(people, items, max(presets.RECALL_AT)), truth, people)


def learn(spark: SparkSession, actions: DataFrame, out: str, version: str, threshold: int = presets.RETRAIN_THRESHOLD, previous: str = "base") -> bool:
    """Dictionary refresh and training mix from the action log, if enough actions are due.

    The dictionary enters as a new version; the model itself is fitted elsewhere, the log of models
    gets the row that says from what.
    """
    began = time.monotonic()
    if not feedback.retrain_due(actions, threshold).first()["due"]:
        return False
    known = spark.read.parquet(f"{out}/all_skills")
    # Many actions show the same CV, so terms end where its clauses do.
    terms = skills.frequent_terms(skills.clauses(actions, "cv_text"), "cv_text")
    files.write_version(skills.refreshed_dictionary(known, terms), f"{out}/dictionary", version)
    labelled = feedback.training_pairs(actions)
    labelled.write.mode("overwrite").parquet(f"{out}/feedback_pairs")
    positives = labelled.filter(F.col("label") == "positive").select(
        F.col("cv_text").alias("anchor_text"), F.col("job_text").alias("positive_text")
    )
    original = spark.read.parquet(f"{out}/train_dataset")
    keyed = original.withColumn("_key", F.sha2(F.concat_ws("\u0001", "anchor_text", "positive_text"), 256))
    feedback.training_mix(positives, keyed, "_key").write.mode("overwrite").parquet(f"{out}/training_mix")
    row = feedback.log_training(
        actions, spark.read.parquet(f"{out}/feedback_pairs"), version, previous, time.monotonic() - began, F.current_timestamp()
    )
    row.coalesce(1).write.mode("append").parquet(f"{out}/model_log")
    return True
