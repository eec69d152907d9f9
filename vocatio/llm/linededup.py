"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` keeps the keys of all lines seen so far as runs: tables of 128-bit hashes, bucketed and sorted by hash, so
that a batch meets a run by a merge join that doesn't shuffle the run. A new batch is reduced to its different keys,
merge-anti-joins the runs of all levels, and adds its new keys as a run of level 0. When a level has ``fanout`` runs
they are compacted into one run of the next level, so there are few runs and each key is rewritten once a level.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. Keys of at least
``min_chars`` code points which an earlier batch holds, or a smaller id of the same batch, lose their lines. Fed in the
order of ids, as ``dedup`` does, a key's lines stay in the smallest id alone; within one row repeated lines stay.

Lines travel as (id, position, hash); texts are shuffled once, to meet their dropped positions. Frequent lines are
reduced before their shuffle; where they meet their verdict the join splits skewed partitions.

Rows: null and empty texts are one empty line, a null id counts as larger than all others, rows with the same id are one
document whose lines don't drop each other, an empty table gives an empty table. Other columns are kept by ``dedup`` and
can't clash: internal columns take names that the table doesn't have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.llm.common import fresh, union
from vocatio.session import work_path, written

MIN_CHARS = 10
FANOUT = 3
BATCHES = 4
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines_of(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, t, pos, h1, h2) of every line of (id, t, text) whose key is long enough; the two hashes are one of 128 bits."""
    lines = rows.select("id", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select("id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineRuns:
    """The runs of one corpus, as bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0
        self.paths: dict[str, str] = {}

    def _save(self, df: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        path = self.paths[name] = work_path(self.spark, name)
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", path).saveAsTable(name)
        return name

    def _keys(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("NOT seen").select("h1", "h2")

    def runs(self) -> list[DataFrame]:
        return [self._keys(name) for level in self.levels for name in level]

    def drop(self) -> None:
        """Take all tables out of the catalog once no batch comes any more; the files, and so the verdicts, stay."""
        for i in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i + 1}")

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (id, h1, h2, ...) and return its verdicts: (h1, h2, keeper, seen) of the keys that lose lines.

        ``seen``: an earlier batch holds the key, all its lines go; else they stay in the smallest id, ``keeper``.
        """
        others = F.coalesce(F.min("id") < F.max("id"), F.lit(False)) | (F.min("id").isNotNull() & F.max(F.col("id").isNull()))
        keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), others.alias("many")).withColumn("seen", F.lit(False))
        for run in self.runs():
            met = keys.join(run.withColumn("earlier", F.lit(True)), ["h1", "h2"], "left")
            keys = met.withColumn("seen", F.col("seen") | F.col("earlier").isNotNull()).drop("earlier")
        # One table holds the batch's run, the keys not seen before, and its verdicts.
        name = self._save(keys)
        self._place(name, 0)
        # Read as plain files: lines then meet their verdicts over two shuffles, where skewed partitions can be split.
        verdicts = self.spark.read.schema(keys.schema).parquet(self.paths[name])
        return verdicts.filter("seen OR many").select("h1", "h2", "keeper", "seen")

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            keys = union([self._keys(n) for n in full]).withColumn("seen", F.lit(False))
            self._place(self._save(keys), level + 1)


def batches_of(lines: DataFrame, n: int) -> list[Column]:
    """Conditions that cut the lines into at most ``n`` batches of rising ids, null ids last, of about equal size."""
    shares = [i / n for i in range(1, n)]
    cuts = lines.agg(F.percentile_approx("id", shares, 1000).alias("cuts")).first()["cuts"] if shares else None
    cuts = sorted(set(cuts or []))
    ends = [F.lit(c) for c in cuts]
    within = [F.col("id") <= e for e in ends[:1]]
    within += [(F.col("id") > a) & (F.col("id") <= b) for a, b in zip(ends, ends[1:])]
    last = F.col("id") > ends[-1] if ends else F.lit(True)
    return [*within, F.coalesce(last, F.lit(True))]


def dropped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """(id, t, positions): the lines from 0 that each row loses; ``t`` is a hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    lines = written(lines_of(rows, min_chars), "lines")
    state, lost = LineRuns(docs.sparkSession, fanout=fanout), []
    for within in batches_of(lines, batches):
        batch = lines.filter(within)
        verdicts = state.add(batch)
        met = batch.join(verdicts, ["h1", "h2"])
        lost.append(met.filter("seen OR id IS NULL OR id != keeper").select("id", "t", "pos"))
    state.drop()  # the verdicts are read as files, and nothing meets the runs any more
    return union(lost).groupBy("id", "t").agg(F.collect_set("pos").alias("positions"))


def _with_kept(docs: DataFrame, id_col: str, text_col: str, **how) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the text of its kept lines and the two counts in columns of new names."""
    names = {n: fresh(docs, f"_{n}") for n in ("text", "lines", "dropped")}
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = dropped(docs, id_col, text_col, **how).select(
        F.col("id").alias(fresh(docs, "_id")), F.col("t").alias(fresh(docs, "_t")), F.col("positions").alias(fresh(docs, "_positions"))
    )
    i, t, positions = gone.columns
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(t)), "left")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col(positions))
    # The lines are a lambda's argument, so that they are cut once and then only looked up.
    kept = F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.array_join(F.transform(stay, lambda p: F.get(ls, p)), "\n"))
    return joined.withColumns({
        names["text"]: F.when(F.col(positions).isNull(), text).otherwise(F.get(kept, F.lit(0))),
        names["lines"]: n.cast("long"),
        names["dropped"]: F.coalesce(F.size(positions), F.lit(0)).cast("long"),
    }), names


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """For each row its id, ``n_lines``, ``n_dropped`` and ``kept_sha256`` of the lines that stay."""
    found, names = _with_kept(docs.select(id_col, text_col), id_col, text_col, **how)
    return found.select(
        id_col, F.col(names["lines"]).alias("n_lines"), F.col(names["dropped"]).alias("n_dropped"),
        F.sha2(F.col(names["text"]).cast("binary"), 256).alias("kept_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", **how) -> DataFrame:
    """All rows and columns of ``docs``, the text without its dropped lines; ``n_chars`` follows the text where it exists."""
    found, names = _with_kept(docs, id_col, text_col, **how)
    new = {text_col: F.col(names["text"])}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.length(names["text"]).cast(docs.schema[n_chars_col].dataType)
    return found.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))
