"""Skill dictionary, phrases found in texts, new terms and proposals."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.rules import is_quality_skill
from vocatio.functions.text import candidate_terms, normal_phrase, split_trim, tokens
from vocatio.operators.joins import HOT_KEYS, HOT_ROWS, left_joins
from vocatio.session import bound_batches, written

# Bytes of the largest dictionary that every task holds as a trie; some twenty times as much in a Python worker.
TRIE_BYTES = 8 * 1024 * 1024
# Copies of a dictionary that is too large to broadcast; a frequent phrase is then spread over
# this many shuffle partitions.
SALTS = 32


def dictionary(skill_lists: DataFrame, column: str = "skills") -> DataFrame:
    """(skill, count): frequency of every trimmed skill of comma-separated lists, case kept."""
    return (
        skill_lists.select(F.explode(split_trim(F.col(column))).alias("skill"))
        .filter(F.col("skill") != "")
        .groupBy("skill")
        .agg(F.count("*").alias("count"))
    )


def quality_skills(skills: DataFrame, min_count: int = presets.MIN_DICTIONARY_COUNT) -> DataFrame:
    """Frequent entries that are no stop words or generic words."""
    return skills.filter((F.col("count") >= min_count) & is_quality_skill(F.col("skill")))


def phrases(skills: DataFrame) -> DataFrame:
    """Distinct lookup forms of the skills: lower-case tokens, one blank apart."""
    return (
        skills.select(normal_phrase(F.col("skill")).alias("phrase")).filter(F.col("phrase") != "").distinct()
    )


def _measure(phrase_table: DataFrame) -> tuple[int, int]:
    """Words of the longest phrase and bytes of the whole table."""
    row = phrase_table.agg(
        F.max(F.size(F.split("phrase", " "))).alias("words"),
        F.sum(F.octet_length("phrase") + 16).alias("bytes"),
    ).first()
    return row["words"] or 0, row["bytes"] or 0


def word_runs(texts: DataFrame, text_column: str, longest: int, *keep: str) -> DataFrame:
    """(keep..., pos, words, run): every run of 1..longest words of each text, with its place.

    The words are zipped with themselves shifted by one, two, ... places and unrolled, so runs are
    joined by generated code. A run beyond the last word is null; a text without words keeps one
    row with a null place.
    """
    words = texts.select(*keep, tokens(F.col(text_column)).alias("w"))
    shifted = [F.slice("w", F.lit(n), F.size("w")).alias(f"w{n}") for n in range(1, max(longest, 1) + 1)]
    placed = words.select(*keep, F.posexplode_outer(F.arrays_zip(*shifted)).alias("pos", "z"))

    def run(n: int) -> Column:
        pieces = [piece for i in range(1, n + 1) for piece in (F.lit(" "), F.col(f"z.w{i}"))][1:]
        return F.struct(F.lit(n).alias("words"), F.concat(*pieces).alias("run"))

    runs = F.explode(F.array(*[run(n) for n in range(1, len(shifted) + 1)])).alias("r")
    return placed.select(*keep, "pos", runs).select(*keep, "pos", "r.words", "r.run")


def _starts(phrase_table: DataFrame) -> DataFrame:
    """(first, lengths): the words that start a phrase, and in how many words such phrases are long."""
    words = F.split("phrase", " ")
    return phrase_table.groupBy(F.get(words, 0).alias("first")).agg(F.collect_set(F.size(words)).alias("lengths"))


def _salted(side: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join with a table of a large dictionary.

    It is copied ``SALTS`` times and the rows are spread over the copies, so that a word found in a third of all
    texts does not end in one task.
    """
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = side.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")


def phrase_trie(phrases: list[str]) -> dict:
    """Phrases by their words: a node maps the next word to a node, or to the phrase if none goes on; '' is the phrase that ends there."""
    root: dict = {}
    for phrase in sorted(phrases):  # a phrase comes before those that it begins
        node, words = root, phrase.split(" ")
        for word in words[:-1]:
            child = node.setdefault(word, {})
            if isinstance(child, str):
                child = node[word] = {"": child}
            node = child
        if isinstance(node.get(words[-1]), dict):
            node[words[-1]][""] = phrase
        else:
            node[words[-1]] = phrase
    return root


def walk_trie(words: list[str], root: dict) -> dict[str, tuple[int, int]]:
    """phrase -> (first place, words) of all phrases in a text; from each word on only as far as a phrase goes on."""
    found: dict[str, tuple[int, int]] = {}
    n = len(words)
    for at, word in enumerate(words):
        node, end = root.get(word), at + 1
        while node is not None:
            phrase = node if isinstance(node, str) else node.get("")
            if phrase is not None and phrase not in found:
                found[phrase] = (at, end - at)
            if end == n or isinstance(node, str):
                break
            node, end = node.get(words[end]), end + 1
    return found


def _walked(texts: DataFrame, phrase_table: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, words, phrase) by a trie in every task: each phrase of a text where it stands first."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast([r["phrase"] for r in phrase_table.select("phrase").collect()])
    hit = pa.struct([("pos", pa.int32()), ("words", pa.int32()), ("phrase", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = phrase_trie(shared.value)
        for batch in batches:
            hits = [
                [{"pos": at, "words": n, "phrase": p} for p, (at, n) in walk_trie(text.split(" "), root).items()]
                for text in batch.column("_words").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(hit))], names=[id_column, "_hits"])

    bound_batches(spark)
    words = texts.select(id_column, normal_phrase(F.col(text_column)).alias("_words"))
    schema = f"`{id_column}` {dict(texts.dtypes)[id_column]}, _hits array<struct<pos:int,words:int,phrase:string>>"
    return words.mapInArrow(run, schema).select(id_column, F.explode_outer("_hits").alias("h")).select(id_column, "h.*")


def _joined(texts: DataFrame, phrase_table: DataFrame, id_column: str, text_column: str, longest: int) -> DataFrame:
    """The same by joins with a dictionary of any size: each phrase wherever it stands.

    Only words that start a phrase are looked at further, and only for the lengths of the phrases that they
    start, so one long entry of the dictionary costs nothing where its first word does not occur. Rows that are
    shuffled take along the words that a phrase from there may have, not all.
    """
    words = texts.select(id_column, tokens(F.col(text_column)).alias("w"))
    placed = words.select(id_column, "w", F.posexplode_outer("w").alias("pos", "first"))
    placed = placed.withColumn("w", F.slice("w", F.col("pos") + 1, F.lit(max(longest, 1))))
    spread = F.xxhash64(id_column, "pos")
    found = _salted(placed, _starts(phrase_table), "first", spread)
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    fitting = F.filter("lengths", lambda n: n <= F.size("w"))
    runs = F.transform(fitting, lambda n: F.struct(n.alias("words"), F.array_join(F.slice("w", 1, n), " ").alias("phrase")))
    placed = found.filter(F.col("lengths").isNotNull() | first).select(id_column, "pos", F.explode_outer(runs).alias("r"))
    known = phrase_table.select("phrase", F.lit(True).alias("known"))
    hits = _salted(placed.select(id_column, "pos", "r.words", "r.phrase"), known, "phrase", spread)
    hits = hits.filter(F.col("known") | (F.coalesce(F.col("pos"), F.lit(0)) == 0))
    return hits.select(id_column, "pos", "words", F.when(F.col("known"), F.col("phrase")).alias("phrase"))


def phrase_hits(texts: DataFrame, phrase_table: DataFrame, id_column: str, text_column: str, limit: int = TRIE_BYTES) -> DataFrame:
    """(id, pos, words, phrase): the phrases of the table in each text, and one row at least of every text.

    A dictionary of measured small size is a trie in every task, along which each text is walked once; a larger one
    is joined.
    """
    longest, n_bytes = _measure(phrase_table)
    if n_bytes <= limit:
        return _walked(texts, phrase_table, id_column, text_column)
    return _joined(texts, phrase_table, id_column, text_column, longest)


def find_phrases(
    texts: DataFrame,
    phrase_table: DataFrame,
    id_column: str,
    text_column: str,
    broadcast_limit: int = TRIE_BYTES,
) -> DataFrame:
    """(id, found): sorted distinct phrases of the table that occur in each text; [] if none.

    Overlapping phrases all count. One row of every text is kept in any case, so texts without a phrase stay and
    no text is ever shuffled: what leaves a task is one row per text with its phrases.
    """
    hits = phrase_hits(texts, phrase_table, id_column, text_column, broadcast_limit)
    return hits.groupBy(id_column).agg(F.array_sort(F.collect_set("phrase")).alias("found"))


def find_phrases_in_order(
    texts: DataFrame,
    phrase_table: DataFrame,
    id_column: str,
    text_column: str,
    broadcast_limit: int = TRIE_BYTES,
) -> DataFrame:
    """(id, found): distinct phrases longer than one character by first position, shorter first."""
    usable = phrase_table.filter(F.length("phrase") > 1)
    hits = phrase_hits(texts, usable, id_column, text_column, broadcast_limit)
    # Repeats of a phrase fall away before its first place is remembered.
    firsts = hits.groupBy(id_column, "phrase").agg(F.min(F.struct("pos", "words")).alias("at"))
    listed = F.array_sort(F.collect_list(F.when(F.col("phrase").isNotNull(), F.struct("at.pos", "at.words", "phrase"))))
    return firsts.groupBy(id_column).agg(F.transform(listed, lambda s: s["phrase"]).alias("found"))


def with_counts(found: DataFrame) -> DataFrame:
    """Add the list as text, its length and a flag."""
    return found.withColumns(
        {
            "skills": F.concat_ws(", ", "found"),
            "skill_count": F.size("found"),
            "has_skills": (F.size("found") > 0).cast("int"),
        }
    )


def new_terms(counted: DataFrame, known: DataFrame) -> DataFrame:
    """The counted terms (skill, count) that the dictionary lacks; the anti join sees one row per term."""
    return counted.join(known.select(F.lower("skill").alias("skill")).distinct(), "skill", "left_anti")


def refresh_terms(texts: DataFrame, text_column: str, longest: int) -> DataFrame:
    """Rows of every run of 1..longest words of the texts that may be a term; :func:`frequent_terms` needs no length."""
    runs = word_runs(texts, text_column, longest).select(F.col("run").alias("skill"))
    return runs.filter(_may_be_term())


def _may_be_term() -> Column:
    return (F.length("skill") > 2) & ~F.col("skill").isin(*presets.REFRESH_STOP_TERMS)


def clauses(texts: DataFrame, text_column: str) -> DataFrame:
    """One row for each stretch of a text between marks and line ends: a term does not go beyond them."""
    return texts.select(F.explode(F.split(text_column, presets.CLAUSE_END)).alias(text_column)).filter(F.col(text_column) != "")


def _known(base: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows whose hash ``h`` is counted in ``counts`` (h, n); rows of very frequent ones are spread over tasks."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # At most HOT_KEYS hashes can hold such a share of the rows.
    hot = [r["h"] for r in counts.filter(F.col("n") >= max(HOT_ROWS, total / HOT_KEYS)).select("h").collect()]
    return left_joins(base, [counts.select("h", F.lit(True).alias("known"))], "h", hot).filter("known").drop("known")


def _repeated(runs: DataFrame, min_count: int) -> tuple[DataFrame, bool]:
    """The rows (row, pos, h) whose hash stands in ``min_count`` rows or more, written, and whether there are any.

    Hashes are counted before their shuffle.
    """
    runs = written(runs, "runs")
    counts = written(runs.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count), "run-counts")
    return written(_known(runs, counts), "repeated-runs"), not counts.isEmpty()


def _pairs(words: DataFrame, counted: DataFrame) -> DataFrame:
    """(row, pos, h): the hash of each pair of words whose first is one of the ``counted`` (skill, count)."""
    pair = F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("pos", "z")
    pairs = words.filter(F.size("w") > 1).select("row", pair).filter(F.col("z.b").isNotNull())
    pairs = pairs.select("row", "pos", F.xxhash64("z.a").alias("h"), F.xxhash64("z.b").alias("h2"))
    counts = written(counted.groupBy(F.xxhash64("skill").alias("h")).agg(F.sum("count").alias("n")), "word-counts")
    return _known(pairs, counts).select("row", "pos", F.xxhash64("h", "h2").alias("h"))


def _repeats(longer: DataFrame, min_count: int) -> DataFrame | None:
    """(row, length, pos): the places of each text from which a run of 2, 4, 8, ... words is seen ``min_count`` times; None if there are none.

    Of ``longer``, the pairs, a level doubles the length: a run can be frequent only where both of its halves are, and its hash
    comes from theirs. So runs of n words take log2(n) rounds, and only places that are still frequent go on. Halves meet in a
    window over their text, not in a join of the level with itself.
    """
    levels, length = [], 2
    while True:
        level, some = _repeated(longer, min_count)
        if not some:
            return reduce(DataFrame.unionByName, levels) if levels else None
        levels.append(level.select("row", F.lit(length).cast("long").alias("length"), "pos"))
        behind = Window.partitionBy("row").orderBy("pos").rangeBetween(length, length)
        longer = level.withColumn("h2", F.first("h").over(behind)).filter(F.col("h2").isNotNull()).select("row", "pos", F.xxhash64("h", "h2").alias("h"))
        length *= 2


def _spelled(repeats: DataFrame, words: DataFrame) -> DataFrame:
    """(skill): the runs of 2 words and more that may be frequent, wherever they stand.

    A run that is longer than a level's by less than that again is frequent only if the level's run is at each place on its way,
    so from a place it goes on as far as the places of its level follow each other.
    """
    # A place is one number: the level's length, and behind it 32 bits of the position.
    place = F.shiftleft("length", 32) + F.col("pos")
    placed = repeats.groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("at")).join(words, "row")

    def longest(start: Column, i: Column) -> Column:
        length, pos = F.shiftright(start, 32).cast("int"), start.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
        follow = F.filter(F.sequence(F.lit(1), length - 1), lambda k: F.get("at", i + k) == start + k)
        return F.struct(length.alias("least"), F.slice("w", pos + 1, length + F.size(follow)).alias("w"))

    starts = placed.select(F.explode(F.transform("at", longest)).alias("s"))
    sized = starts.select("s.w", F.explode(F.sequence("s.least", F.size("s.w"))).alias("n"))
    return sized.select(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ").alias("skill"))


def frequent_terms(texts: DataFrame, text_column: str, min_count: int = 2) -> DataFrame:
    """(skill, count): every run of words, of any length, that stands at least ``min_count`` times in the texts.

    Levels of doubling length find how far a frequent run may go from each place; only such runs are spelled out and
    counted by their words, so equal hashes cannot make a term. Single words are counted as they are. Null and empty texts give none.
    The result is as large as the repeats are: of a text that is there twice every run is a term; :func:`clauses` keeps runs short.
    """
    least = max(min_count, 1)
    # A filter on the words before they are written would cut the texts twice.
    words = written(texts.select(F.monotonically_increasing_id().alias("row"), tokens(F.col(text_column)).alias("w")), "words")

    def counted(runs: DataFrame) -> DataFrame:
        return runs.groupBy("skill").agg(F.count("*").alias("count")).filter(F.col("count") >= least)

    single = written(counted(words.select(F.explode("w").alias("skill"))), "single-words")
    repeats = _repeats(_pairs(words, single), least)
    terms = single.filter(_may_be_term())
    return terms if repeats is None else terms.unionByName(counted(_spelled(repeats, words).filter(_may_be_term())))


def refreshed_dictionary(known: DataFrame, counted: DataFrame) -> DataFrame:
    """The dictionary plus its new terms, each entering with count 1."""
    added = new_terms(counted, known).withColumn("count", F.lit(1).cast("bigint"))
    return known.select("skill", "count").unionByName(added)


def term_sightings(texts: DataFrame, columns: list[str], seen_at: str) -> DataFrame:
    """One row per (text, candidate term): a term in both texts of a row is seen twice."""
    both = F.concat(*[candidate_terms(F.col(c)) for c in columns])
    return texts.select(F.explode(both).alias("skill_name"), F.col(seen_at).alias("seen_at"))


def tracked_skills(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(skill_name, frequency, first_seen, last_seen) of terms the dictionary lacks."""
    tracked = sightings.groupBy("skill_name").agg(
        F.count("*").alias("frequency"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )
    if known is None:
        return tracked
    return tracked.join(known.select(F.lower("skill").alias("skill_name")).distinct(), "skill_name", "left_anti")


def with_approvals(tracked: DataFrame, approvals: DataFrame) -> DataFrame:
    """Flag the skills whose lower-case name was approved."""
    approved = approvals.select(F.lower("skill_name").alias("skill_name")).distinct().withColumn("added", F.lit(True))
    return tracked.join(approved, "skill_name", "left").select(
        *tracked.columns, F.coalesce("added", F.lit(False)).alias("added_to_dict")
    )


def proposals(tracked: DataFrame, min_frequency: int = presets.MIN_PROPOSAL_FREQUENCY) -> DataFrame:
    """Skills seen often enough and not added yet, most frequent first."""
    return (
        tracked.filter((F.col("frequency") >= min_frequency) & ~F.col("added_to_dict"))
        .select("skill_name", "frequency")
        .orderBy(F.desc("frequency"), "skill_name")
    )


def skill_statistics(tracked: DataFrame) -> DataFrame:
    return tracked.agg(
        F.count("*").alias("total_tracked"),
        F.count_if(~F.col("added_to_dict")).alias("pending"),
        F.count_if("added_to_dict").alias("approved"),
    )
