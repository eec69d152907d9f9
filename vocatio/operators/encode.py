"""Texts to vectors and pairs of texts to scores, with user functions plugged in.

The default encoder is signed feature hashing of tokens and the default scorer is the weighted
formula of :func:`weighted_score`; neither is meant to equal a neural model.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio import presets
from vocatio.functions.text import strip_prefixes, tokens

HASH_DIMENSIONS = 64
HASH_ENCODER = "token-hash-64"


def _token_slots(text: Column, dimensions: int) -> Column:
    """Slot number of every token: twice the dimension, odd slots count negative."""
    return F.transform(
        tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(2 * dimensions)).cast("int")
    )


def hash_encode(df: DataFrame, id_column: str, text_column: str, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """(id, vector, encoder) by hashing tokens into ``dimensions`` signed counters of unit norm.

    Tokens are cut and hashed by Spark; the counters of a whole Arrow batch are added up at once.
    Texts without tokens, and those whose counters cancel out, keep the zero vector.
    """
    id_type = df.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, slots = batch.num_rows, batch.column("slots")
            ends = slots.offsets.to_numpy()
            row = np.repeat(np.arange(n), np.diff(ends))
            flat = slots.flatten().to_numpy(zero_copy_only=False)
            cell = row * dimensions + flat // 2
            signs = 1.0 - 2.0 * (flat % 2)
            sums = np.bincount(cell, weights=signs, minlength=n * dimensions).astype(np.float64).reshape(n, dimensions)
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit = np.divide(sums, length, out=sums, where=length > 0)
            vectors = pa.ListArray.from_arrays(
                pa.array(np.arange(0, n * dimensions + 1, dimensions, dtype=np.int32)), pa.array(unit.ravel())
            )
            yield pa.RecordBatch.from_arrays([batch.column(id_column), vectors], names=[id_column, "vector"])

    slots = df.select(id_column, _token_slots(F.col(text_column), dimensions).alias("slots"))
    return slots.mapInArrow(count, f"{id_column} {id_type}, vector array<double>").withColumn(
        "encoder", F.lit(HASH_ENCODER)
    )


_LOADED: dict[str, Callable] = {}


class LoadedOnce:
    """A model that is loaded at its first use in a Python worker and stays there for all later batches and tasks.

    Only ``load`` travels to the workers, so it must be serialisable; the model itself need not be.
    """

    def __init__(self, load: Callable[[], Callable]):
        self.load = load
        self.key = uuid.uuid4().hex

    def __call__(self, items: list) -> np.ndarray:
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load()
        return _LOADED[self.key](items)


def _approximate_tokens(text: str | None) -> int:
    """Words and a token more for every four bytes beyond them: a bound good enough to fill batches evenly."""
    return 1 + max(len(text.split()), len(text.encode()) // 4) if text else 1


def budgeted(sizes: np.ndarray, batch: int, budget: int | None) -> Iterator[np.ndarray]:
    """Positions of items in batches: items of like size together, longest first, so that the largest batch comes first.

    A batch has at most ``batch`` items and, padded to its longest, at most ``budget`` tokens; an item beyond the budget
    is a batch of its own.
    """
    order = np.argsort(-sizes, kind="stable")
    start = 0
    while start < len(order):
        longest = max(1, int(sizes[order[start]]))
        take = batch if budget is None else max(1, min(batch, budget // longest))
        yield order[start : start + take]
        start += take


def _in_budget(
    items: list, sizes: list[int], model: Callable[[list], np.ndarray], batch: int, budget: int | None
) -> np.ndarray | None:
    """Results of ``model`` in the order of ``items``; None where there are no items."""
    out = None
    for at in budgeted(np.asarray(sizes, dtype=np.int64), batch, budget):
        got = np.asarray(model([items[i] for i in at]), dtype=np.float64)
        if len(got) != len(at):
            raise ValueError(f"the model gave {len(got)} results for {len(at)} items")
        if out is None:
            out = np.empty((len(items), *got.shape[1:]))
        out[at] = got
    return out


def encode(
    df: DataFrame, id_column: str, text_column: str, model: Callable[[list[str]], np.ndarray], name: str, batch: int = 256,
    budget: int | None = None, size: Callable[[str], int] = _approximate_tokens,
) -> DataFrame:
    """(id, vector, encoder) by a user's model, called with lists of up to ``batch`` texts of like length.

    ``budget`` bounds the tokens of a call as a model pads them, texts times the longest; ``size`` counts the tokens of a
    text. ``model`` must be serialisable; :class:`LoadedOnce` loads weights once per worker. Texts are sorted within an
    Arrow batch only (bounded by :func:`vocatio.session.bound_batches`), so nothing is shuffled and rows keep their order.
    """
    id_type = df.schema[id_column].dataType.simpleString()

    def run(frames):
        for frame in frames:
            texts = frame[text_column].tolist()
            matrix = _in_budget(texts, [size(t) for t in texts], model, batch, budget)
            if matrix is not None:
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                unit = np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
                frame = frame[[id_column]].assign(vector=list(unit))
                yield frame

    return (
        df.select(id_column, text_column)
        .mapInPandas(run, f"{id_column} {id_type}, vector array<double>")
        .withColumn("encoder", F.lit(name))
    )


def score_pairs(
    pairs: DataFrame, left: str, right: str, model: Callable[[list[tuple[str, str]]], np.ndarray], batch: int = 128,
    budget: int | None = None, size: Callable[[str], int] = _approximate_tokens,
) -> DataFrame:
    """Add ``pair_score`` from a user's model of two texts; prefixes are taken off first.

    Batches are formed as in :func:`encode`; the size of a pair is that of both texts.
    """
    prepared = pairs.withColumn("_left", strip_prefixes(F.col(left))).withColumn("_right", strip_prefixes(F.col(right)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(frames):
        for frame in frames:
            texts = list(zip(frame["_left"], frame["_right"]))
            scores = _in_budget(texts, [size(a) + size(b) for a, b in texts], model, batch, budget)
            if scores is not None:
                yield frame.drop(columns=["_left", "_right"]).assign(pair_score=scores)

    return prepared.mapInPandas(run, f"{fields}, pair_score double")


def weighted_score(
    cosine: Column, jaccard: Column, title_match: Column, title_similarity: Column, feedback: Column,
    weights: dict[str, float] | None = None,
) -> Column:
    """alpha*cosine + beta*jaccard + gamma1*title match + gamma2*title similarity + delta*feedback."""
    w = {**presets.SCORE_WEIGHTS, **(weights or {})}
    return (
        cosine * w["alpha"]
        + jaccard * w["beta"]
        + title_match * w["gamma1"]
        + title_similarity * w["gamma2"]
        + feedback * w["delta"]
    )
