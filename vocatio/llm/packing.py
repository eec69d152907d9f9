"""Packing by power-of-two decomposition: no padding, and no sequence that crosses documents.

A document's tokens (its ids and an end id) are cut into as many pieces of the longest length as it holds, and the rest
into one piece for each bit of its binary length, longest first. Each piece is a sequence of its own whose length is a
power of two, so a batch of equal lengths needs no padding. Sequences are numbered length by length: all of the longest
length first, so that equal lengths stand together, and a number depends on the documents alone.

Spark tokenises in Arrow batches, keeps one row of piece digests for each document, and numbers the documents within
ranges of their ids; only the sums of each range are gathered.

Rows: null texts count as empty and pack as the end id alone; repeated rows are packed as often as they occur, each into
sequences of its own; an empty table packs to an empty table. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatio.llm.bpe import BEYOND_LATIN, LATIN_LETTERS, LATIN_NUMBERS, LATIN_WHITE, byte_letters
from vocatio.llm.common import Remembered, arrow_map, numbered, texts_of

# The words of byte-level vocabularies, '(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+, spelt out for
# texts of Latin letters; other texts are left to the library whole.
LATIN_WORD = re.compile(
    f" ?[{LATIN_LETTERS}]+|'(?:[sdmt]|ll|ve|re)| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
    f"|[{LATIN_WHITE}]+(?![^{LATIN_WHITE}])|[{LATIN_WHITE}]+"
)


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them, each different word merged once.

    Where the vocabulary numbers its tokens in the order of its merges, the words are merged by tiktoken, which then
    gives the same ids several times faster; otherwise by the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.memory = Remembered(self.quick(path) or self.slow)

    def quick(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, byte = model["vocab"], {c: b for b, c in enumerate(byte_letters())}
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(vocabulary[a + b] != 256 + i for i, (a, b) in enumerate(parts)) or {vocabulary[c] for c in byte} != {*range(256)}:
            return None
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if i < 256 + len(parts)}
        merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        return lambda word: array("I", merge(word.encode())).tobytes()

    def slow(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if BEYOND_LATIN.search(text) or self.special.search(text):
            return self.slow(text)
        return b"".join(map(self.memory.__getitem__, LATIN_WORD.findall(text)))


def pieces(n: int, longest: int) -> list[int]:
    """Lengths that ``n`` tokens are cut into: whole ``longest`` ones, then the bits of the rest."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents into sequences of power-of-two lengths up to ``longest`` (itself a power of two).

    One row for each piece: id, ``start`` (tokens of the document before it), ``length``, ``ids_crc32`` (of its ids as
    little-endian unsigned 32-bit numbers), ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (0: a piece is
    a sequence), and with ``with_ids`` the ids themselves.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer)
        for batch in batches:
            totals, crcs, ids = [], [], []
            for text in texts_of(batch, text_col):
                tokens = memoryview(bpe.ids(text) + end)
                totals.append(len(tokens) // 4)
                at, own, cut = 0, [], []
                for length in pieces(totals[-1], longest):
                    piece = tokens[4 * at : 4 * (at + length)]
                    own.append(zlib.crc32(piece))
                    if with_ids:
                        cut.append(array("I", piece.tobytes()).tolist())
                    at += length
                crcs.append(own)
                ids.append(cut)
            columns = [batch.column(id_col), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_col, "doc_tokens", "crcs", *["ids"] * with_ids]
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, doc_tokens long, crcs array<long>" + ", ids array<array<int>>" * with_ids
    packed = arrow_map(docs.select(id_col, text_col), run, schema)

    n, top = F.col("doc_tokens"), longest.bit_length() - 1
    counts = {f"_n{b}": (F.floor(n / longest) if b == top else F.shiftright(n, b).bitwiseAND(F.lit(1))) for b in range(top + 1)}
    firsts = numbered(packed, names, counts)
    # One row of sums: how many sequences each length has, hence where the numbers of the next length begin.
    totals = firsts.agg(*(F.coalesce(F.sum(c * F.col("copies")), F.lit(0)).alias(w) for w, c in counts.items())).first()
    base, before = {}, 0
    for b in range(top, -1, -1):
        base[b], before = F.lit(before), before + int(totals[f"_n{b}"])
    numbered_docs = firsts.withColumn("_copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    first = {b: base[b] + F.col(f"_n{b}") + F.col("_copy") * counts[f"_n{b}"] for b in range(top + 1)}
    whole = F.floor(n / longest)
    each = numbered_docs.select(
        id_col, "doc_tokens", whole.alias("_whole"), F.array(*(first[b] for b in range(top + 1))).alias("_first"),
        F.posexplode("crcs").alias("_pos", "ids_crc32"), *([F.col("ids").alias("_ids")] if with_ids else []),
    )
    # Behind the whole pieces stand the bits of the rest from the highest: the bit of a piece follows from its position.
    bits = F.expr(f"filter(sequence({max(top - 1, 0)}, 0, -1), b -> {'false' if top == 0 else 'shiftright(doc_tokens, b) % 2 = 1'})")
    bit = F.when(F.col("_pos") < F.col("_whole"), F.lit(top)).otherwise(F.get(bits, (F.col("_pos") - F.col("_whole")).cast("int")))
    each = each.withColumn("_bit", bit)
    start = F.when(F.col("_bit") == top, F.col("_pos").cast("long") * longest).otherwise(n - F.expr("doc_tokens % shiftleft(2L, _bit)"))
    number = F.get("_first", F.col("_bit")) + F.when(F.col("_bit") == top, F.col("_pos")).otherwise(F.lit(0))
    return each.select(
        id_col, start.alias("start"), F.expr("shiftleft(1L, _bit)").alias("length"), "ids_crc32", "doc_tokens",
        number.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        *([F.get("_ids", F.col("_pos")).alias("ids")] if with_ids else []),
    )
