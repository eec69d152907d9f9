"""A trie of conversation prefixes, its subtrees summed by an Euler tour.

Conversations are rebuilt so that those of one hundred share beginnings: the first ``h`` turns of the hundred's first
conversation, then the own turns behind the first ``h``. Each different beginning is a node. It is told by its depth and
the sum, turn by turn, of 128 bits of a SHA-256 of the turn with its depth: sums run over ranges of rows, so that a
conversation may be as long as the table, and no text leaves the first shuffle.

The tour enters each node, visits its children from the smallest conversation on, and leaves it: two arcs a node, each
with its successor. The arcs are ranked over Spark: one in ``EVERY`` arcs is picked by its hash, every arc doubles its
jumps until it reaches a picked one, the picked ones are a shorter list that is ranked in the same way, down to a list of
at most ``ALONE`` arcs. What a subtree holds is the difference of prefix sums at the positions of its two arcs.

Rows: a null turn comes first, ties of a turn go by role, then text; null role and text are empty; rows without conv_id
belong to no conversation; repeated rows are turns of their own; an empty table has no nodes, not even the root. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.llm.common import laid, running, union
from vocatio.session import written

HUNDRED = 100
SHARED = 6  # fewer than so many turns are shared
EVERY = 32
ALONE = 1 << 14
BLOCK = 4096  # ids in one piece of a node's list
END = -1
WORDS = ["s1", "s2", "s3", "s4"]
KEY = ["depth", *WORDS]


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred: CRC-32 of its decimal id, modulo ``SHARED``."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, depth, word of the turn, its characters) for each rebuilt turn, laid by conversation; and (conv) for all conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
    )
    said = rows.withColumns({
        "said": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), "chars": F.length("text").cast("long"),
    })
    placed = written(running(laid(said, ["conv", "turn", "role", "text"], ["conv", "said", "chars"]), ["conv"], {"pos": F.lit(1)}).drop("_at"), "turns")
    convs = written(placed.select("conv").distinct(), "conversations")
    own = placed.filter(F.col("pos") > shared_turns(F.col("conv"))).select("conv", F.lit(1).alias("part"), "pos", "said", "chars")
    base = placed.filter((F.col("conv") % HUNDRED == 0) & (F.col("pos") < SHARED)).withColumnRenamed("conv", "base")
    # At most a few turns of the first meet the conversations of one hundred.
    heirs = convs.select("conv", (F.col("conv") - F.col("conv") % HUNDRED).alias("base"))
    taken = heirs.join(base, "base").filter(F.col("pos") <= shared_turns(F.col("conv"))).select("conv", F.lit(0).alias("part"), "pos", "said", "chars")
    return running(laid(union([own, taken]), ["conv", "part", "pos"]), ["conv"], {"depth": F.lit(1)}), convs


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, sums, words of the last turn, its characters): one row for each beginning of each conversation."""
    salted = F.sha2(F.concat("said", F.lit("/"), F.col("depth").cast("string")).cast("binary"), 256)
    words = {f"w{i + 1}": F.conv(F.substring(salted, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    rows = turns.withColumns(words)
    summed = running(rows, ["conv"], {s: F.col(f"w{i + 1}") for i, s in enumerate(WORDS)})
    return written(summed.select("conv", *KEY, *words, "chars"), "prefixes")


def nodes_of(parts: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: its key, ``node`` (a number), ``conv`` (smallest member), ``n_convs``, ``up1``.. (sums of its parent), ``chars``."""
    inner = parts.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        *(F.max(F.col(s) - F.col(f"w{i + 1}")).alias(f"up{i + 1}") for i, s in enumerate(WORDS)),
    )
    none = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        none.alias("depth"), *(none.alias(s) for s in WORDS), "conv", "n_convs", none.alias("chars"), *(F.lit(None).cast("long").alias(f"up{i + 1}") for i in range(4)),
    )
    return written(union([inner.withColumn("depth", F.col("depth").cast("long")), root]).withColumn("node", F.monotonically_increasing_id()), "nodes")


def family(nodes: DataFrame) -> DataFrame:
    """Each node before its children, in the order of the tour: (kind 0: a node, 1: a child of ``parent``, ``node``, ``next``).

    ``next`` is the first child of a node, or the next sibling of a child. ``parent_conv`` belongs to the parent.
    """
    parents = nodes.select(*KEY, F.lit(0).alias("kind"), "conv", "node")
    up = {"depth": F.col("depth") - 1} | {s: F.col(f"up{i + 1}") for i, s in enumerate(WORDS)}
    children = nodes.filter("depth > 0").select(*(c.alias(n) for n, c in up.items()), F.lit(1).alias("kind"), "conv", "node")
    rows = laid(union([parents, children]), [*KEY, "kind", "conv"])
    # One row of each family has kind 0, so sums over it are its values.
    first = F.col("kind") == 0
    sums = {"parent": F.when(first, F.col("node")).otherwise(0), "parent_conv": F.when(first, F.col("conv")).otherwise(0)}
    return written(running(rows, KEY, sums, {"next": "node"}).select("depth", "kind", "node", "parent", "parent_conv", "next"), "family")


def tour(rows: DataFrame) -> DataFrame:
    """(arc, to): arc 2v enters node v, 2v + 1 leaves it; the last arc leads to ``END``."""
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    down = rows.filter("kind = 0").select(enter.alias("arc"), F.coalesce(F.col("next") * 2, leave).alias("to"))
    on = rows.filter("kind = 1").select(leave.alias("arc"), F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1).alias("to"))
    last = rows.filter("kind = 0 AND depth = 0").select(leave.alias("arc"), F.lit(END).cast("long").alias("to"))
    return union([down, on, last])


def _rank_alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat([pd.DataFrame({"arc": [], "to": [], "steps": []}, dtype="int64"), *batches])
    before = {to: (arc, steps) for arc, to, steps in rows.itertuples(index=False)}
    found, at, after = [], END, 0
    while at in before:
        at, steps = before[at]
        after += steps
        found.append((at, after))
    yield pd.DataFrame(found, columns=["arc", "after"], dtype="int64")


def list_ranks(links: DataFrame, alone: int = ALONE, every: int = EVERY, level: int = 0) -> DataFrame:
    """(arc, after): steps from each arc to the end, for a list of (arc, to) and perhaps ``steps``."""
    if "steps" not in links.columns:
        links = links.withColumn("steps", F.lit(1).cast("long"))
    todo = written(links.select("arc", "to", "steps"), "links")
    if todo.count() <= alone:
        return todo.coalesce(1).mapInPandas(_rank_alone, "arc long, after long")
    picked = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(level)), F.lit(every)) == 0
    at_stop = (F.col("to") == END) | picked("to")
    stopped, still = [todo.filter(at_stop)], todo.filter(~at_stop)
    while not still.isEmpty():
        targets = union([*stopped, still]).select(F.col("arc").alias("to"), F.col("to").alias("then"), F.col("steps").alias("more"))
        jumped = still.join(targets, "to").select("arc", F.col("then").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        jumped = written(jumped, "jumps")
        stopped.append(jumped.filter(at_stop))
        still = jumped.filter(~at_stop)
    reached = union(stopped)
    rest = list_ranks(reached.filter(picked("arc")), alone, every, level + 1)
    joined = reached.join(rest.select(F.col("arc").alias("to"), F.col("after").alias("rest")), "to", "left")
    return joined.select("arc", (F.col("steps") + F.coalesce(F.col("rest"), F.lit(0))).alias("after"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's list from its pieces, which come node by node and in order."""
    node, running_hash = None, None
    for batch in batches:
        done = []
        for n, piece in zip(batch["node"], batch["piece"]):
            if n != node:
                if node is not None:
                    done.append((node, running_hash.hexdigest()))
                node, running_hash = n, hashlib.sha256(piece.encode())
            else:
                running_hash.update(b"," + piece.encode())
        yield pd.DataFrame(done, columns=["node", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(node, running_hash.hexdigest())], columns=["node", "ends_sha256"])


def ends_of(parts: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end. Lists are cut into pieces, and hashed piece by piece."""
    last = parts.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("k"))
    keys = [F.coalesce(F.col(f"k.{c}").cast("long"), F.lit(0)).alias(c) for c in KEY]
    rows = laid(convs.join(last, "conv", "left").select("conv", *keys), [*KEY, "conv"])
    block = F.shiftright(F.col("_at"), 12)
    pieces = rows.groupBy(*KEY, block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("piece"))
    named = pieces.join(nodes.select(*KEY, "node"), KEY).select("node", "block", "piece")
    return named.repartition("node").sortWithinPartitions("node", "block").mapInPandas(_digests, "node long, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", alone: int = ALONE,
) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes
    of the subtree), saved_tokens (over the subtree: members but one, times the code points of the node's last text), and
    ends_sha256 of the conversations that end at the node.
    """
    rows, convs = rebuilt(turns, conv_col, turn_col, role_col, text_col)
    parts = prefixes(rows)
    nodes = nodes_of(parts, convs)
    kin = family(nodes)
    ranks = list_ranks(tour(kin), alone)
    children = kin.filter("kind = 1").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, "node", "left").join(kin.filter("kind = 1").select("node", "parent_conv"), "node", "left").select(
        "node", "conv", "depth", "parent_conv", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), *WORDS,
    )
    own = written(own.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "own")
    # Weights lie on the arcs that enter; arcs are ranked from the end, so the order of the tour is that of falling ranks.
    arcs = ranks.select((-F.col("after")).alias("position"), F.floor(F.col("arc") / 2).cast("long").alias("node"), (F.col("arc") % 2).alias("side"))
    weighed = arcs.join(own.select("node", "leaf", "own"), "node").select(
        "position", "node", *(F.when(F.col("side") == 0, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "own")),
    )
    passed = running(laid(weighed, ["position"]), [], {"leaves": F.col("leaf"), "saved": F.col("own")})
    # Sums rise along the tour: what lies between the two arcs of a node is the larger less the smaller, and the node's own.
    subtree = passed.groupBy("node").agg(*((F.max(c) - F.min(c)).alias(c) for c in ("leaves", "saved")))
    return own.join(subtree, "node").join(ends_of(parts, convs, nodes), "node", "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"),
        F.col("n_convs").cast("long").alias("n_convs"), "n_children", (F.col("leaves") + F.col("leaf")).cast("long").alias("n_leaves"),
        (F.col("saved") + F.col("own")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
