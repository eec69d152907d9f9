"""Shards by a Feistel permutation of global row numbers, with cycle walking: a reproducible shuffle in DataFrame terms.

Rows get global numbers in the order of id, size and checksum. A Feistel network of ``ROUNDS`` rounds permutes the
numbers below the smallest power of four that holds all rows; a number that lands beyond the last row is permuted again
until it lands on one. The result is a permutation of the row numbers that follows from a number, the number of rows
and the seed alone: position ``p`` lies in shard ``p % shards`` at slot ``p div shards``. So counts of shards differ by
one at most (law ``rows``) and slots have no gaps. ``position`` computes it for any number, without the table.

Only ids, sizes and checksums are shuffled, never texts. Equal rows are counted before the shuffle and get their numbers
apart, so a group of copies doesn't meet in one task; the law spreads groups of equal texts like all other rows.

Rows: null texts have size 8 and the checksum of no bytes, null ids are numbered first, repeated rows get slots of their
own, an empty table gives an empty table. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.llm.common import numbered

ROUNDS = 6
# Walks of the first pass, and of the second, which only rows beyond the first see. A walk lands with a probability of a
# quarter or more; that a row needs more than the second pass has, is less likely than one in 10^100.
FIRST_WALKS, LAST_WALKS = 8, 1000


def half_bits(n: int) -> int:
    """Bits of each half of the numbers below the smallest power of four that is at least ``n``."""
    return max(1, (max(n, 2) - 1).bit_length() + 1 >> 1)


def feistel(number: Column, n: int, seed: int) -> Column:
    """One pass of ``number`` through the network: a permutation of the numbers below the power of four for ``n``."""
    half = 1 << half_bits(n)
    start = F.struct(F.shiftrightunsigned(number, half_bits(n)).alias("l"), number.bitwiseAND(F.lit(half - 1)).alias("r"))

    def turn(s: Column, k: Column) -> Column:
        mixed = F.pmod(s["l"] + F.xxhash64(s["r"], k, F.lit(seed).cast("long")).bitwiseAND(F.lit(half - 1)), F.lit(half))
        return F.struct(s["r"].alias("l"), mixed.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * half + s["r"])


def walked(number: Column, n: int, seed: int, walks: int) -> Column:
    """``number`` sent through the network until it is below ``n``, at most ``walks`` times."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(walks)), number, lambda p, i: F.when((i == 1) | (p >= n), feistel(p, n, seed)).otherwise(p)
    )


def position(df: DataFrame, number: str, n: int, seed: int, name: str) -> DataFrame:
    """Add as ``name`` the position in the shuffle of ``n`` rows of each row number."""
    df = df.withColumn(name, walked(F.col(number), n, seed, FIRST_WALKS))
    df = df.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(walked(F.col(name), n, seed, LAST_WALKS)))
    return df.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def shard(
    docs: DataFrame, shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """For each row its id, ``size`` (UTF-8 bytes of the text and 8), ``text_crc32``, ``law``, ``shard``, ``slot`` and
    ``grown_shard`` (null: under this law one more shard deals all rows anew)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    counted = numbered(rows, [id_col, "size", "text_crc32"])
    n = int(counted.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    each = counted.withColumn("row_number", F.explode(F.expr("sequence(row_number, row_number + copies - 1)")))
    each = position(each, "row_number", max(n, 1), seed, "position")
    return each.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
