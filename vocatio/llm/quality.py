"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much text are rejected.

Rules of a line (white space around it does not count, blank lines are neither judged nor counted):

* punctuation: it ends with a terminal mark, perhaps followed by closing quotes or brackets, or is a passage of more than
  ``PASSAGE_WORDS`` words with such a mark inside; and at most ``MAX_MARKED`` of its words end in two or more marks
  ("cheap!! now!!", "word### word&&&");
* navigation: it is no row of links, that is at least ``NAV_SEPARATORS`` separators and one for every four words;
* boilerplate: a line of at most ``BOILERPLATE_WORDS`` words has none of the fixed phrases, and no line has a brace.

A document is rejected if its base counts fail, or if the lines that stay hold less than ``MIN_KEPT`` of its words.

Rows: null and empty texts have no words and are rejected with zero counts, very long texts are read whole, repeated
rows are judged alike, an empty table gives an empty table. ``measure`` reads only id and text, so names can't clash;
``clean`` keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm.common import arrow_map, fresh, texts_of

MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
WINDOW = 8
MIN_KEPT = 0.5
MAX_MARKED = 0.3
PASSAGE_WORDS = 30
NAV_SEPARATORS = 3
BOILERPLATE_WORDS = 30
SYMBOLS = "#*$%&|<>"
# Full stops and question marks of Latin, East Asian, Indic, Arabic, Ethiopic, Armenian, Khmer and Burmese texts.
TERMINAL = ".!?…:;。！？｡।॥؟۔؛።։។။"
CLOSING = "\"'”’»)]}"
SENTENCE_END = re.compile(f"[{re.escape(TERMINAL)}][ \\t-\\r]")
SEPARATORS = re.compile(r"[|»›·•→]|[ \t-\r][>/-][ \t-\r]")
MARKS = r"[!?#*$%&|<>~^=+_]{2,}"
MARKED = re.compile(MARKS + r"(?=[ \t-\r]|$)")
BOILERPLATE = re.compile(
    "|".join(
        [
            "all rights reserved", "accept (?:all )?cookies", "use of cookies", "uses cookies", "cookie policy", "privacy policy",
            "terms of (?:use|service)", "enable javascript", "lorem ipsum", "click here", "sign (?:in|up)", "log in",
            "skip to (?:main )?content", "share (?:this|on)", "follow us", "subscribe (?:now|to our)", "back to top", "read more",
        ]
    ),
    re.IGNORECASE,
)
BLANK = " \t\n\v\f\r"
# An odd multiplier for the rolling hash of windows, and one that tells the documents of a batch apart.
STEP, APART = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def line_passes(line: str) -> bool:
    """Whether a line with at least one word passes all rules."""
    bare = line.strip(BLANK)
    n = len(bare.encode().split())  # ASCII white space, as the words' definition has it
    end = bare.rstrip(CLOSING)[-1:]
    if not (end and end in TERMINAL) and not (n > PASSAGE_WORDS and SENTENCE_END.search(bare)):
        return False
    if len(MARKED.findall(bare)) > MAX_MARKED * n:
        return False
    separators = len(SEPARATORS.findall(bare))
    if separators >= NAV_SEPARATORS and 4 * separators >= n:
        return False
    if "{" in bare or "}" in bare:
        return False
    return n > BOILERPLATE_WORDS or not BOILERPLATE.search(bare)


def judge_lines(text: str) -> tuple[str, int, int]:
    """The text of the lines that pass (blank lines between them stay), its words, and the repeated lines of the whole text."""
    kept, n_kept, n_repeated, seen = [], 0, 0, set()
    for line in text.split("\n"):
        n = len(line.encode().split())
        if not n:
            kept.append(line)
            continue
        if line in seen:
            n_repeated += 1
        seen.add(line)
        if line_passes(line):
            kept.append(line)
            n_kept += n
    return "\n".join(kept), n_kept, n_repeated


def repeated_words(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each document of a batch the words in windows of ``WINDOW`` words that are in its text twice or more.

    Windows are compared by a rolling hash of 64 bits over the words' hashes, all documents of the batch at once.
    """
    repeated, n = np.zeros(len(counts), np.int64), len(hashes)
    if n < WINDOW:
        return repeated
    with np.errstate(over="ignore"):
        rolled = hashes[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            rolled *= STEP
            rolled += hashes[k : n - WINDOW + 1 + k]
        doc = np.repeat(np.arange(len(counts)), counts)
        rolled ^= rolled >> np.uint64(29)
        rolled += doc[: len(rolled)].astype(np.uint64) * APART
    at = np.flatnonzero(doc[: len(rolled)] == doc[WINDOW - 1 :])
    order = at[np.argsort(rolled[at], kind="stable")]
    same = rolled[order][1:] == rolled[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = order[twice]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    np.add.at(repeated, doc[covered], 1)
    return repeated


def _run(id_col: str, text_col: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, hashes = texts_of(batch, text_col), [], []
            for text in texts:
                words = text.encode().split()  # ASCII white space, as the words' definition has it
                hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
                chars = len(text) - sum(map(text.count, BLANK))
                rows.append((len(words), chars, sum(map(text.count, SYMBOLS)), *judge_lines(text)))
            n_words = np.array([r[0] for r in rows], np.int64)
            repeats = repeated_words(n_words, np.concatenate([*hashes, np.empty(0, np.int64)]).view(np.uint64))
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n_words)
            kept = ~failed & (np.array([r[4] for r in rows], np.int64) >= MIN_KEPT * n_words)
            columns = {
                id_col: batch.column(id_col), "n_words": n_words, "word_chars": [r[1] for r in rows], "n_symbols": [r[2] for r in rows],
                "n_dup_lines": [r[5] for r in rows], "n_repeat_words": repeats, "base_failed": failed, "kept": kept,
            }
            if with_text:
                columns["clean_text"] = [r[3] for r in rows]
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return run


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """For each row its id, the base counts, ``base_failed`` and the verdict ``kept``; ``with_text`` adds ``clean_text``."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {COUNTS}" + ", clean_text string" * with_text
    return arrow_map(docs.select(id_col, text_col), _run(id_col, text_col, with_text), schema)


def clean(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The rows whose documents are kept, with the lines that passed as their text; all other columns as they were.

    A column ``n_chars`` of the input is brought up to date with the new text.
    """
    own, names = fresh(docs, "clean_text"), docs.columns
    cut = docs.withColumn(own, F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _run("_id", text_col, True)
        for batch in batches:
            only = pa.RecordBatch.from_pydict({"_id": pa.nulls(batch.num_rows), text_col: batch.column(text_col)})
            (found,) = judge(iter([only]))
            at = batch.schema.get_field_index(own)
            whole = batch.set_column(at, own, pa.array(found.column("clean_text").to_pylist(), batch.schema.field(at).type))
            yield whole.filter(found.column("kept"))

    kept = arrow_map(cut, run, cut.schema)
    texts = kept.withColumn(text_col, F.col(own))
    if n_chars_col in names:
        texts = texts.withColumn(n_chars_col, F.length(own).cast(docs.schema[n_chars_col].dataType))
    return texts.select(*names)
