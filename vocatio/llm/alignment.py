"""Alignment of two tokenizers over the same texts, by a galloping intersection of their token ends.

Each text is encoded by a byte-level vocabulary (A, with one space put before the text) and by a piece vocabulary (B,
which puts that space itself). The byte offsets at which tokens end are two rising lists. The shorter one drives: each
of its ends is looked for in the longer one from where the search before it stood, in steps that double, and then by
binary search in the last step. Common ends cut both token lists into groups (their indices are slices of them), and the
two tokens that end at a common end are linked. Texts of one block lie behind one another, so that one intersection
serves a block; the steps of many ends are taken together as array operations.

Spark counts each linked pair of ids over all documents and finds the highest count of each B id; documents meet the
counts of their own pairs again. The counts are broadcast where their measured size allows it; beyond that only those of
the pairs that many documents hold are, and the others meet their documents over a shuffle, so no pair gathers in a task.

Rows: null and empty texts have no tokens; the same holds for texts whose tokens don't add up to their bytes (those with
U+2581); repeated rows give repeated results but count each time; an empty table gives an empty table. Other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm.bpe import BEYOND_LATIN, byte_letters
from vocatio.llm.common import Remembered, arrow_map, texts_of
from vocatio.llm.packing import LATIN_WORD
from vocatio.llm.tokencounts import MARK, PieceCounter
from vocatio.session import BROADCAST_LIMIT_BYTES, written

BLOCK_CHARS = 1 << 20  # texts whose ends are intersected together, unless one text alone is longer
STRIDE = 8
WORDS = 400_000  # words and pre-tokens whose ids a task remembers
PAIR_BYTES = 32  # of a pair with its count in a broadcast table
HEAVY_ROWS = 100_000  # documents' pairs that may meet in one task


class ByteTokens:
    """Ids of whole texts under a byte-level vocabulary of the tokenizers library; special strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        self.memory, self.odd = Remembered(self.encoded, WORDS), False

    def encoded(self, text: str) -> bytes:
        """Ids as 32-bit numbers; ``odd`` is set if their bytes are not those of the text."""
        ids = self.library.encode(text, add_special_tokens=False).ids
        self.odd = self.odd or b"".join([self.bytes[i] for i in ids]) != text.encode()
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        return self.encoded(text) if BEYOND_LATIN.search(text) else b"".join(map(self.memory.__getitem__, LATIN_WORD.findall(text)))


class PieceTokens:
    """The same for a model of the sentencepiece library, which puts a space before the text itself."""

    def __init__(self, path: str):
        self.pieces = PieceCounter(path)
        self.library = self.pieces.library
        self.bytes = [self._bytes_of(self.library.id_to_piece(i), i) for i in range(self.library.get_piece_size())]
        self.memory, self.odd = Remembered(self.encoded, WORDS), False

    def _bytes_of(self, piece: str, i: int) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(re.fullmatch("<0x([0-9A-F]{2})>", piece)[1], 16)])
        return piece.replace(MARK, " ").encode()

    def encoded(self, token: str) -> bytes:
        # Behind a line end a token keeps its ids; the space and the line end before it are two tokens more.
        ids = self.library.encode("\n" + token, num_threads=1)[2:]
        self.odd = self.odd or b"".join([self.bytes[i] for i in ids]) != token.encode()
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, self.pieces.cut(" " + text)))


def gallop(wanted: np.ndarray, among: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of ``wanted`` the first index from ``start`` on whose value in the rising ``among`` is not below it."""
    low, last = start.astype(np.int64), len(among) - 1
    high, step = low.copy(), 1
    live = np.flatnonzero((high <= last) & (among[np.minimum(high, last)] < wanted))
    while live.size:
        low[live] = high[live] + 1
        high[live] = np.minimum(high[live] + step, last + 1)
        step *= 2
        at = high[live]
        live = live[(at <= last) & (among[np.minimum(at, last)] < wanted[live])]
    live = np.flatnonzero(low < high)
    while live.size:
        middle = (low[live] + high[live]) // 2
        below = among[middle] < wanted[live]
        low[live[below]] = middle[below] + 1
        high[live[~below]] = middle[~below]
        live = live[low[live] < high[live]]
    return low


def places(wanted: np.ndarray, among: np.ndarray) -> np.ndarray:
    """``gallop`` from the start for rising ``wanted``: every STRIDE-th is found first, the others go on from the one before them."""
    n = len(wanted)
    anchors = places(wanted[::STRIDE], among) if n > STRIDE else np.zeros(1, np.int64)
    return gallop(wanted, among, np.repeat(anchors, STRIDE)[:n])


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the values that two rising lists share, in each of them. The shorter list is looked up in the longer one."""
    if len(a) > len(b):
        found = common_ends(b, a)
        return found[1], found[0]
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = places(a, b)
    hit = np.flatnonzero((at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a))
    return hit, at[hit]


class Aligner:
    """Aligns whole texts under the vocabulary files ``a`` (tokenizers) and ``b`` (sentencepiece)."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteTokens(a), PieceTokens(b)
        self.lengths = [np.array([len(t) for t in side.bytes], np.int64) for side in (self.a, self.b)]
        self.shown = np.array([f"{i}{c}".encode() for n, c in ((len(self.a.bytes), ","), (len(self.a.bytes), "|"), (len(self.b.bytes), ","), (len(self.b.bytes), ";")) for i in range(n)])

    def tokens(self, text: str) -> tuple[bytes, bytes]:
        """Ids of both sides, empty where the text has none."""
        if not text:
            return b"", b""
        if MARK in text:
            return b"", b""
        a, b = self.a.ids(" " + text), self.b.ids(text)
        # As long as every piece so far had its own bytes, so have the texts.
        if self.a.odd or self.b.odd:
            whole = (" " + text).encode()
            if any(b"".join([side.bytes[i] for i in memoryview(ids).cast("I")]) != whole for side, ids in ((self.a, a), (self.b, b))):
                return b"", b""
        return a, b

    def align(self, texts: list[str]) -> Iterator[dict]:
        """For each text ``n_a``, ``n_b``, ``n_groups``, the groups as text, and its linked pairs (A id * 65536 + B id) with their counts."""
        tokens = [self.tokens(t) for t in texts]
        ids = [np.frombuffer(b"".join([t[side] for t in tokens]), np.uint32).astype(np.int64) for side in (0, 1)]
        per = [np.array([len(t[side]) // 4 for t in tokens], np.int64) for side in (0, 1)]
        ends = [np.cumsum(self.lengths[side][ids[side]]) for side in (0, 1)]
        ia, ib = common_ends(*ends)
        first = [np.concatenate([[0], np.cumsum(p)]) for p in per]
        group = np.searchsorted(ia, first[0])  # groups before each text
        pairs = (ids[0][ia] << 16) | ids[1][ib]
        # The places of all ids in the text of groups: A ids of a group, then its B ids.
        n_a, n_b = np.diff(ia, prepend=-1), np.diff(ib, prepend=-1)
        of_a, of_b = np.repeat(np.arange(len(ia)), n_a), np.repeat(np.arange(len(ib)), n_b)
        before_a, before_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        signs_a, signs_b = ids[0].copy(), ids[1] + 2 * len(self.a.bytes)
        signs_a[ia] += len(self.a.bytes)
        signs_b[ib] += len(self.b.bytes)
        signs = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        signs[np.arange(len(ids[0])) + before_b[of_a]] = signs_a
        signs[np.arange(len(ids[1])) + before_a[of_b + 1]] = signs_b
        place = first[0] + first[1]
        owner = np.repeat(np.arange(len(texts)), np.diff(group))
        linked, counts = np.unique((owner << 32) | pairs, return_counts=True)
        cuts = np.searchsorted(linked, np.arange(len(texts) + 1) << 32)
        linked &= 0xFFFFFFFF
        for i in range(len(texts)):
            # Entries are padded with NULs, which the digits don't hold.
            shown = self.shown[signs[place[i] : place[i + 1]]].tobytes().replace(b"\0", b"")[:-1]
            own = slice(cuts[i], cuts[i + 1])
            yield {
                "n_a": int(per[0][i]), "n_b": int(per[1][i]), "n_groups": int(group[i + 1] - group[i]), "groups": shown.decode(),
                "pairs": linked[own], "counts": counts[own],
            }


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """For each row: id, n_a, n_b, n_groups, n_links, ``pairs`` and ``counts`` (arrays), and the groups as text or its SHA-256."""
    kind = dict(docs.dtypes)[id_col]
    last = "groups_sha256" if digest else "groups"
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "pairs", "counts", last]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)
        for batch in batches:
            rows = [r for block in blocks(texts_of(batch, text_col)) for r in aligner.align(block)]
            show = lambda g: (hashlib.sha256(g.encode()).hexdigest() if g else "") if digest else g
            lists = [pa.array([r[c] for r in rows], pa.list_(t)) for c, t in (("pairs", pa.int64()), ("counts", pa.int32()))]
            numbers = [pa.array([r[c] for r in rows], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_groups")]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *numbers, *lists, pa.array([show(r["groups"]) for r in rows], pa.string())], names=names)

    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, pairs array<long>, counts array<int>, {last} string"
    return arrow_map(docs.select(id_col, text_col), run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, docs, best): links of each pair over all rows, the rows that hold it, and whether its count is its B id's highest."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    counts = written(each.groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("docs")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    # One row for each B id: the size of a vocabulary.
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest"))
    joined = counts.join(F.broadcast(highest), b_id == F.col("b_id"))
    return joined.select("pair", "count", "docs", (F.col("count") == F.col("highest")).alias("best"))


def score(rows: DataFrame, counts: DataFrame, limit: int = BROADCAST_LIMIT_BYTES, heavy: int = HEAVY_ROWS) -> DataFrame:
    """(row, n_best, count_sum) of rows (row, pairs, counts) that have links."""
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.counts").alias("n"))
    table = counts.select("pair", "count", "best")
    if counts.count() * PAIR_BYTES <= limit:
        joined = each.join(F.broadcast(table), "pair")
    else:
        # The frequent pairs are broadcast, as many as the limit allows.
        while counts.filter(F.col("docs") >= heavy).count() * PAIR_BYTES > max(limit, PAIR_BYTES):
            heavy *= 4
        hot = counts.filter(F.col("docs") >= heavy).select("pair", "count", "best")
        marked = each.join(F.broadcast(hot), "pair", "left")
        found = marked.filter("count IS NOT NULL")
        rest = marked.filter("count IS NULL").select("row", "pair", "n").join(counts.filter(F.col("docs") < heavy).select("pair", "count", "best"), "pair")
        joined = found.select("row", "n", "count", "best").unionByName(rest.select("row", "n", "count", "best"))
    n = F.col("n").cast("long")
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), n).otherwise(0)).alias("n_best"), F.sum(n * F.col("count")).alias("count_sum"))


def align(
    docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, limit: int = BROADCAST_LIMIT_BYTES,
    heavy: int = HEAVY_ROWS,
) -> DataFrame:
    """For each row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, and the groups as text (``groups``) or its digest."""
    rows = written(aligned(docs, a, b, id_col, text_col, digest).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(rows), "pairs")
    scores = score(rows.select("row", "pairs", "counts"), counts, limit, heavy)
    last = "groups_sha256" if digest else "groups"
    joined = rows.join(scores, "row", "left")
    total = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(id_col, "n_a", "n_b", "n_groups", "n_links", total("n_best"), total("count_sum"), last)
