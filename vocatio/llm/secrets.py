"""Secret scans: candidates by a pattern, false positives removed by a random forest.

A candidate is a long run of key characters that mixes letters and digits, a value of 8 characters or more directly
behind a name and ``=``, or a quoted value behind ``=`` or ``:``; names stay in the context of their values. A forest
trained from labelled findings judges each by its length, its classes of characters and the changes between them, the
share that dictionary words cover, words in the path it comes from, and the words that stand beside it.

All of it is expressions of Spark's own and Spark's own forest. Texts stay in place: candidates leave them as rows with
the text beside them, and a redacted text meets only the verdicts on its candidates.

Labelled findings are a table (value, before, after, path, label). ``planted_findings`` makes one from the documents:
values derived from their hashes, in contexts of their own words, under names of secrets (label 1) or as checksums,
commits, ids, file names, addresses, long words and examples (label 0). The planted texts are cut by the pattern of the
scan, so that the forest learns from such rows as it judges. It reads at most ``LABELLED_DOCS`` documents,
those of the smallest hashes: the bound on the rows that the classifier is fitted to. Scanning covers all documents.

Rows: null and empty texts have no candidates; a null path counts as empty, a null id takes part; repeated rows give
repeated findings, and rows that differ in other columns than id and text are redacted alike, by the strictest verdict; an empty table gives none, judged by a forest that then has no labels and calls all candidates secret.
``redact`` keeps all columns, internal ones take names that the table doesn't have.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.llm.common import among_lowest, fresh
from vocatio.session import written

LABELLED_DOCS = 400
CONTEXT = 60  # characters beside a candidate that are looked at
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 7, 17
REDACTED = "[REDACTED]"

# A run of key characters with a letter and a digit, or a value behind an assignment, quoted or not. A run ends before the
# dots behind it: it gives back these alone, as it begins at one place only. Quoted values keep their last dots. An equals
# sign ends a run, a name and its value are two; only signs that nothing follows are padding and belong to it.
_RUN = r"[A-Za-z0-9+/_.-]{%d,}(?<![.])(?![.]*+[A-Za-z0-9+/_-])(?:=++(?![.]*+[A-Za-z0-9+/_-]|[\"'][A-Za-z0-9]))?+"
CANDIDATE = (
    r"(?<=[=:][\"'])[A-Za-z0-9+/_.=-]{8,}+(?<=[.])(?=[\"'])|(?<=[=:] [\"'])[A-Za-z0-9+/_.=-]{8,}+(?<=[.])(?=[\"'])"
    # The length of a mixed run counts with the name before its sign: short values of long names are candidates too.
    r"|(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])(?=[0-9+/_.-]*+[A-Za-z])" + _RUN % 1 + r"(?<=[A-Za-z0-9+/_.=-]{15})"
    r"|(?<=[A-Za-z0-9_.\])-]=)" + _RUN % 8 +
    r"|(?<=[=:][\"'])[^\s\"'<>]{8,}+(?=[\"'])|(?<=[=:] [\"'])[^\s\"'<>]{8,}+(?=[\"'])"
)
SECRET_NAMES = (
    "secret", "token", "passwd", "password", "passphrase", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key",
    "credential", "auth", "bearer", "client_secret", "signing_key",
)
HARMLESS_NAMES = (
    "commit", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "guid", "hash", "revision", "version", "build",
    "example", "sample", "dummy", "fake", "placeholder", "test", "mock", "fixture", "changeme", "http", "www", "file", "image",
)
PATH_NAMES = ("test", "example", "sample", "fixture", "mock", "spec", "docs", "readme", "demo", "tutorial")
DICTIONARY = (
    "access", "account", "address", "admin", "after", "again", "answer", "application", "article", "author", "before", "between",
    "browser", "build", "button", "change", "class", "client", "code", "comment", "company", "config", "content", "copy",
    "country", "daily", "data", "date", "default", "design", "device", "document", "domain", "download", "email", "engine",
    "error", "event", "example", "family", "field", "file", "folder", "format", "forum", "from", "function", "game", "general",
    "group", "guide", "have", "header", "help", "history", "home", "house", "html", "image", "index", "info", "item", "java",
    "language", "last", "learn", "library", "light", "list", "local", "login", "mail", "main", "make", "manager", "market",
    "media", "member", "message", "method", "model", "module", "money", "month", "music", "name", "network", "news", "node",
    "number", "object", "office", "online", "open", "option", "order", "other", "page", "part", "password", "path", "people",
    "phone", "photo", "place", "plan", "post", "price", "private", "product", "program", "project", "public", "python",
    "question", "read", "release", "report", "resource", "result", "review", "sample", "school", "script", "search", "section",
    "secure", "server", "service", "session", "setting", "shop", "site", "size", "software", "source", "state", "static",
    "store", "story", "string", "style", "system", "table", "test", "text", "that", "this", "time", "title", "topic", "type",
    "update", "user", "value", "version", "video", "view", "week", "what", "when", "with", "word", "work", "world", "year",
)
KNOWN_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abps]-|sk_live_|sk-|AIza|eyJ|npm_|pypi-)"


def _any(words: tuple[str, ...]) -> str:
    return "(?i)(" + "|".join(words) + ")"


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{pattern}]", "")) / F.greatest(F.length(value), F.lit(1))


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs, by name."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    changes = {
        "letter_to_digit": "[A-Za-z](?=[0-9])", "digit_to_letter": "[0-9](?=[A-Za-z])", "lower_to_upper": "[a-z](?=[A-Z])",
        "upper_to_lower": "[A-Z](?=[a-z])", "to_mark": "[A-Za-z0-9](?=[^A-Za-z0-9])",
    }
    covered = F.aggregate(
        F.regexp_extract_all(F.lower(value), F.lit("(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"), 1),
        F.lit(0), lambda a, w: a + F.length(w),
    )
    # The last and the first words beside the candidate.
    last = F.regexp_extract(before, r"(\S*\s*\S*\s*)$", 1)
    first = F.regexp_extract(after, r"^(\S*\s*\S*)", 1)
    yes = lambda c: c.cast("int").cast("double")
    return {
        "length": n,
        **{name: F.regexp_count(value, F.lit(p)) / n for name, p in changes.items()},
        "runs": F.size(F.regexp_extract_all(value, F.lit("([a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+)"), 1)) / n,
        "digits": _share(value, "0-9"), "uppers": _share(value, "A-Z"), "lowers": _share(value, "a-z"),
        "vowels": _share(value, "aeiouAEIOU"), "dots": _share(value, r"./_\-"),
        "hex": yes(value.rlike("^[0-9a-fA-F]+$")), "dashed_hex": yes(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "known_prefix": yes(value.rlike(KNOWN_PREFIX)),
        "dictionary": covered / n,
        "harmless_path": yes(path.rlike(_any(PATH_NAMES))),
        "secret_before": yes(last.rlike(_any(SECRET_NAMES))), "harmless_before": yes(last.rlike(_any(HARMLESS_NAMES))),
        "secret_near": yes(before.rlike(_any(SECRET_NAMES))), "harmless_near": yes(F.concat(before, value, after).rlike(_any(HARMLESS_NAMES))),
        "assigned": yes(before.rlike(r"[=:]\s*[\"']?$")), "quoted": yes(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "address_before": yes(before.rlike("[@/]$")), "harmless_after": yes(first.rlike(_any(HARMLESS_NAMES))),
    }


def with_features(findings: DataFrame) -> DataFrame:
    """Add the vector ``features`` to findings (value, before, after, path, ...)."""
    before, after, path = (F.coalesce(c, F.lit("")) for c in ("before", "after", "path"))
    made = features(F.col("value"), F.right(before, F.lit(CONTEXT)), F.left(after, F.lit(CONTEXT)), path)
    wide = findings.withColumns({f"f_{k}": c.cast("double") for k, c in made.items()})
    vector = VectorAssembler(inputCols=[f"f_{k}" for k in made], outputCol="features").transform(wide)
    return vector.drop(*(f"f_{k}" for k in made))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, t, pos, start, value, before, after, path): every candidate of every text, ``pos`` from 0, ``start`` in code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    found = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), path.alias("path"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("values"),
    ).filter(F.size("values") > 0)
    # Between the candidates lie the other parts of the text, one more than there are candidates.
    cut = found.select("id", "t", "path", "values", F.split("text", CANDIDATE, -1).alias("parts"), F.monotonically_increasing_id().alias("row"))
    # A name that is a candidate itself stays before its value.
    part = F.get("parts", F.col("pos"))
    before = F.concat(F.when(part.rlike("^=+[\"']?$"), F.coalesce(F.get("values", F.col("pos") - 1), F.lit(""))).otherwise(""), part)
    rows = cut.select("id", "t", "path", "row", "values", "parts", F.posexplode("values").alias("pos", "value")).select(
        "id", "t", "path", "row", "pos", "value", F.right(before, F.lit(CONTEXT)).alias("before"),
        F.left(F.get("parts", F.col("pos") + 1), F.lit(CONTEXT)).alias("after"), F.length(F.get("parts", F.col("pos"))).alias("gap"),
    )
    sofar = Window.partitionBy("id", "t", "row").orderBy("pos")
    start = F.sum("gap").over(sofar) + F.sum(F.length("value")).over(sofar) - F.length("value")
    return rows.withColumn("start", start.cast("long")).drop("gap", "row")


def planted_findings(docs: DataFrame, text_col: str = "text", limit: int = LABELLED_DOCS) -> DataFrame:
    """Labelled findings (value, before, after, path, label) made from the words and hashes of ``limit`` documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).filter("text != ''")
    n = hashed.agg(F.approx_count_distinct("h")).first()[0]
    # Copies are one row before anything is sorted, so a text that fills a third of the table counts once.
    picked = hashed.filter(among_lowest("h", limit, n)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(limit)
    words = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")
    at = F.pmod("h", F.greatest(F.size("words"), F.lit(1))).cast("int") + 1
    near = picked.select("h", words.alias("words")).filter(F.size("words") > 0)
    near = near.select(
        "h", F.array_join(F.slice("words", at, 5), " ").alias("left"), F.array_join(F.slice(F.reverse("words"), at, 5), " ").alias("right"),
        F.lower(F.regexp_replace(F.array_join(F.slice("words", at, 2), ""), "[^A-Za-z]", "")).alias("word"),
    )
    key = F.col("h").cast("string")
    long_hex = F.sha2(key, 256)
    base = F.regexp_replace(F.base64(F.unhex(long_hex)), "=", "")
    quoted = lambda name: (F.concat(F.col("left"), F.lit(f' {name} = "')), F.concat(F.lit('" '), F.col("right")))
    plain = lambda name: (F.concat(F.col("left"), F.lit(f" {name}")), F.concat(F.lit(" "), F.col("right")))
    uuid = F.regexp_replace(F.md5(key), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod("h", F.lit(len(names))) + 1).cast("int"))
    secret_name, harmless_name = name(SECRET_NAMES), name(HARMLESS_NAMES[:13])
    under = lambda n, sign, end: (F.concat(F.col("left"), F.lit(" "), n, F.lit(sign)), F.concat(F.lit(end), F.col("right")))
    either = lambda a, b: tuple(F.when(F.pmod("h", F.lit(2)) == 0, x).otherwise(y) for x, y in zip(a, b))
    forms = [
        # (value, (before, after), path, label)
        (F.sha1(key), under(secret_name, ' = "', '" '), "", 1), (F.left(long_hex, F.lit(32)), under(secret_name, "=", " "), "", 1),
        (F.left(base, F.lit(40)), under(F.concat(F.lit("APP_"), F.upper(secret_name)), "=", "\n"), "", 1),
        (F.left(base, F.lit(40)), under(secret_name, ': "', '", '), "", 1), (base, under(secret_name, "='", "' "), "", 1),
        (F.concat(F.lit("AKIA"), F.upper(F.left(long_hex, F.lit(16)))), plain(""), "", 1),
        (F.concat(F.lit("ghp_"), F.left(base, F.lit(36))), quoted("value"), "", 1),
        (F.sha1(key), plain("commit "), "", 0), (F.sha1(key), under(harmless_name, ': "', '" '), "", 0),
        (F.md5(key), under(harmless_name, ": ", " "), "", 0), (long_hex, under(harmless_name, "=", " "), "", 0), (uuid, plain("id: "), "", 0),
        (uuid, quoted("uuid"), "", 0), (F.concat(F.lit("mail"), F.pmod("h", F.lit(10)).cast("string"), F.lit(".example.com")), plain("the.12@"), "", 0),
        (F.concat("word", F.lit("-2019/"), "word", F.lit(".html")), plain("http://"), "", 0),
        (F.concat(F.lit("version-"), F.pmod("h", F.lit(99)).cast("string"), F.lit(".2.0-release")), plain(""), "", 0),
        (F.concat(F.lit("example-password-"), "word", F.lit("1")), quoted("password"), "docs/example", 0),
        (F.sha1(key), quoted("token"), "tests/fixture", 0), (F.concat("word", "word", F.lit("2")), either(quoted("title"), plain("title=")), "", 0),
        (F.concat(F.lit("image_"), "word", F.lit("_file_2020.png")), plain("file "), "", 0),
    ]
    rows = [
        F.struct(v.alias("value"), b.alias("before"), a.alias("after"), F.lit(p).alias("path"), F.lit(float(y)).alias("label"))
        for v, (b, a), p, y in forms
    ]
    placed = near.select("h", F.posexplode(F.array(*rows)).alias("form", "f")).select(
        F.struct("h", "form", "f.label", F.length("f.before").alias("first"), F.length(F.concat("f.before", "f.value")).alias("end")).alias("id"),
        F.concat("f.before", "f.value", "f.after").alias("text"), "f.path",
    )
    # What the scan finds in the planted text, where it meets the planted value.
    found = candidates(placed, "id", "text", "path").filter("start < id.end AND start + length(value) > id.first")
    return found.select("id.h", "id.form", "start", "value", "before", "after", "path", "id.label")


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Model | None:
    """A forest fitted to labelled findings; None where they hold no two classes.

    ``labelled`` must be bounded by its maker: it is laid in order into one partition, so that the same findings give the
    same forest on every cluster.
    """
    rows = with_features(labelled).select("features", "label", *[c for c in ("h", "form", "start") if c in labelled.columns])
    order = [c for c in ("h", "form", "start") if c in rows.columns]
    placed = (rows.coalesce(1).sortWithinPartitions(*order) if order else rows).select("features", "label")
    if placed.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(placed)


def judged(findings: DataFrame, forest: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``probability`` and ``is_secret``; without a forest every candidate counts as a secret."""
    if forest is None:
        return findings.withColumn("probability", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    scored = forest.transform(with_features(findings)).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(*findings.columns, F.round("p", 6).alias("probability"), (F.round("p", 6) >= threshold).alias("is_secret"))


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All candidates with their verdicts: id, ``t`` (hash of the text), ``pos``, ``start``, ``value``, context, ``probability``, ``is_secret``.

    ``labelled``: findings to train from; by default those that ``planted_findings`` makes of ``docs``.
    """
    if path_col is not None and path_col not in docs.columns:
        path_col = None
    labelled = planted_findings(docs, text_col) if labelled is None else labelled
    forest = train(written(labelled, "labelled"))
    return judged(candidates(docs, id_col, text_col, path_col), forest, threshold)


def redact(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
    threshold: float = THRESHOLD, mark: str = REDACTED, n_chars_col: str = "n_chars",
) -> DataFrame:
    """All rows and columns of ``docs``, each secret in their texts replaced by ``mark``."""
    found = scan(docs, labelled, id_col, text_col, path_col, threshold)
    names = [fresh(docs, n) for n in ("_id", "_t", "_verdicts")]
    # Rows of one id and text may differ in their paths: a candidate is a secret if any of them makes it one.
    each = found.groupBy("id", "t", "pos").agg(F.max("is_secret").alias("is_secret"))
    hits = each.groupBy("id", "t").agg(F.max("is_secret").alias("any"), F.array_sort(F.collect_list(F.struct("pos", "is_secret"))).alias("each"))
    hits = hits.filter("any").select("id", "t", F.transform("each", lambda e: e["is_secret"]).alias("verdicts"))
    # Written, so that its size is known before the join is planned: only then may it be broadcast.
    hits = written(hits, "secrets").select(*(F.col(c).alias(n) for c, n in zip(("id", "t", "verdicts"), names)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    i, t, verdicts = names
    joined = docs.join(hits, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(t)), "left")
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    whole = F.raise_error(F.lit("a text has not as many candidates as verdicts"))
    values = F.when(F.size(values) == F.size(verdicts), values).otherwise(whole)
    swapped = F.zip_with(values, F.col(verdicts), lambda v, secret: F.when(secret, F.lit(mark)).otherwise(v))
    pairs = F.zip_with(F.split(text, CANDIDATE, -1), swapped, lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    new = {text_col: F.when(F.col(verdicts).isNull(), F.col(text_col)).otherwise(F.array_join(pairs, ""))}
    kept = joined.withColumns({fresh(joined, "_new"): new[text_col]})
    made = kept.columns[-1]
    out = {text_col: F.col(made)}
    if n_chars_col in docs.columns:
        kind = docs.schema[n_chars_col].dataType
        out[n_chars_col] = F.when(F.col(verdicts).isNull(), F.col(n_chars_col)).otherwise(F.length(made)).cast(kind)
    return kept.select(*(out.get(c, F.col(c)).alias(c) for c in docs.columns))
