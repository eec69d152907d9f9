"""Byte pair encoding and decoding of whole texts with a word vocabulary, by contiguous rank arrays.

A word is cut into its letters' bytes and merged by the vocabulary's rules: an array holds the parts, another the rank
of each adjacent pair. The smallest rank is searched by a scan, its boundary deleted, and the two neighbouring ranks
are looked up anew. For the short words of real texts this is faster than any queue; words beyond ``LONG_WORD`` use a
heap with the same order (rank, then position), since repeated scans would be quadratic there.

Rows: null texts count as empty, an empty text has no tokens, repeated rows give repeated results, an empty table gives
an empty table. Other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vocatio.llm.common import Remembered, arrow_map, texts_of

LONG_WORD = 200
NONE = 1 << 60

# The vocabulary's pattern of words, 's|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+, spelt out for texts below
# U+023A, where every letter's lower case is a letter below U+0250 or is followed by a mark that is no letter, and where
# composed normal form changes nothing. Only an apostrophe starts two of its branches, so letters may come first.
LATIN_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
LATIN_WHITE = "\t-\r \x85\xa0"
BEYOND_LATIN = re.compile("[^\x00-\u0239]")
LATIN_WORD = re.compile(
    f"[{LATIN_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{LATIN_NUMBERS}]|[^{LATIN_WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: itself, or the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library (byte-level BPE with word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.names = [""] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocabulary.items():
            self.names[i] = token
        letters = byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.last = [vocabulary[c + self.suffix] for c in letters]
        # (left id, right id) as one number -> rank; rank -> the merged id
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[vocabulary[a] << 32 | vocabulary[b]] = rank
            self.merged.append(vocabulary[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.names[i] = token
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.memory = Remembered(self.tokens_of)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word's bytes."""
        inner = self.inner
        parts = [inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        rank, merged = self.ranks.get, self.merged
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order, with a heap over a linked list."""
        n = len(parts)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := rank(parts[x] << 32 | parts[y], NONE)) != NONE:
                    heapq.heappush(heap, (s, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special strings."""
        if text.isascii() or not BEYOND_LATIN.search(text):
            return LATIN_WORD.findall(text.lower())
        # Beyond Latin the library's own tables of properties decide.
        text = self.library.normalizer.normalize_str(text)
        return [bytes_of(word).decode() for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def tokens_of(self, word: str) -> tuple[bytes, str]:
        ids = self.merge(word.encode())
        return array("I", ids).tobytes(), " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of the text as little-endian unsigned 32-bit numbers, and its tokens joined by spaces."""
        found: list[tuple[bytes, str]] = []
        for piece in self.cut.split(text):
            if piece in self.special:
                found.append((struct.pack("<I", self.special[piece]), piece))
            elif piece:
                found += map(self.memory.__getitem__, self.words(piece))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        """Text of little-endian 32-bit ids: this vocabulary has no decoder, so tokens are joined by spaces."""
        numbers = array("I")
        numbers.frombytes(ids)
        return " ".join(map(self.names.__getitem__, numbers))


def bytes_of(shown: str, _byte={c: i for i, c in enumerate(byte_letters())}) -> bytes:
    """Bytes of a word written in the letters of ``byte_letters``."""
    return bytes(map(_byte.__getitem__, shown))


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encode and decode every whole text with the vocabulary file at ``vocabulary``.

    Returns id, ``n_tokens``, ``ids`` (array of int) and ``decoded``; with ``digest`` the SHA-256 of the ids as
    little-endian unsigned 32-bit numbers and of the decoded text instead of both.
    """
    id_type = dict(docs.dtypes)[id_col]
    rest = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocabulary)
        for batch in batches:
            found = [bpe.encode(t) for t in texts_of(batch, text_col)]
            counts = pa.array([len(ids) // 4 for ids, _ in found], pa.int64())
            decoded = [bpe.decode(ids) for ids, _ in found]
            if digest:
                columns = [pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string())]
                columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()))
            else:
                columns = [pa.array([list(struct.unpack(f"<{len(i) // 4}I", i)) for i, _ in found], pa.list_(pa.int32()))]
                columns.append(pa.array(decoded, pa.string()))
            names = [id_col, "n_tokens", *(c.split()[0] for c in rest.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), counts, *columns], names=names)

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_tokens long, {rest}")
