r"""Chat formatting of reply trees.

Messages answer each other: ``links`` holds for each message of a tree its number there and the number of the message
that it answers. Iterative self-joins enumerate the root-to-leaf paths: in each round every message doubles how far it
points up its tree, and each path's rows take as many ancestors more as they have, so a thread of n turns needs log n
rounds. Paths are ranked by the mean score of their messages (higher first, then the smaller leaf), and each chosen
path is formatted as one conversation. A table of turns is a tree without branches, in which each turn answers the one
before.

Each turn is written ``[INST] role [/INST] text </s>``. Where a role or text holds such a mark, perhaps behind
backslashes, one backslash more goes before it, which reading takes away: no mark inside a text can be taken for the
template's, and every text comes back as it was. ``loss`` lists the spans (start, length; code points of the output)
under the loss mask: the texts of the assistant's turns.

All of it is expressions and joins of Spark's own. A conversation's texts cross one shuffle, to the row that holds them.
A tree of more than ``WHOLE`` messages and several paths is not held as one row: its texts join their paths' rows.

Rows: null turns come first, ties of a turn go by role, then text; null role and text are empty; rows without a
conversation id form one conversation of theirs; repeated rows are turns of their own; an empty table gives none; other
columns are not read. A message whose parent is not in the tree is a root; circles of replies raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.llm.common import laid, running, union
from vocatio.session import written

OPEN, BETWEEN, CLOSE = "[INST] ", " [/INST] ", " </s>"
CONTROL = r"\[/?INST\]|</?s>"
LEARNT = "assistant"
WHOLE = 10_000


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"(\\*+)({CONTROL})"), F.lit(r"\\$1$2"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"\\(\\*+)({CONTROL})"), F.lit("$1$2"))


def thread_links(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(tree, at, up, score): the turns of each conversation as a chain of replies, numbered from 1."""
    rows = laid(turns.select(F.col(conv_col).alias("tree")), ["tree"])
    placed = running(rows, ["tree"], {"at": F.lit(1)})
    up = F.when(F.col("at") > 1, F.col("at") - 1)
    return placed.select("tree", F.col("at").cast("long").alias("at"), up.cast("long").alias("up"), F.lit(None).cast("double").alias("score"))


def reply_links(messages: DataFrame, tree: str, id_col: str, parent: str, score: str | None = None) -> DataFrame:
    """The same for a table of messages; ids are told apart within their tree, the first row of an id takes the replies."""
    value = F.col(score).cast("double") if score else F.lit(None).cast("double")
    rows = messages.select(F.col(tree).alias("tree"), F.col(id_col).alias("id"), F.col(parent).alias("parent"), value.alias("score"))
    placed = written(running(laid(rows, ["tree", "id", "parent", "score"]), ["tree"], {"at": F.lit(1)}).drop("_at"), "messages")
    first = placed.groupBy(F.col("tree").alias("t"), F.col("id").alias("i")).agg(F.min("at").cast("long").alias("up"))
    linked = placed.join(first, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")), "left")
    return linked.select("tree", F.col("at").cast("long").alias("at"), "up", "score")


def reply_paths(links: DataFrame) -> DataFrame:
    """(tree, leaf, height, at): for each leaf the messages above it, itself at height 0."""
    links = written(links.select("tree", "at", "up"), "links")
    inner = links.filter("up IS NOT NULL").select("tree", F.col("up").alias("at")).distinct()
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    leaves = links.alias("l").join(inner.alias("i"), same("l", "i") & (F.col("l.at") == F.col("i.at")), "left_anti")
    found = [written(leaves.select("tree", F.col("at").alias("leaf"), F.lit(0).cast("long").alias("height"), "at"), "paths")]
    jumps, reach, n = links.filter("up IS NOT NULL"), 1, links.count()
    while not jumps.isEmpty():
        if reach > n:
            raise ValueError("replies form a circle")
        rows = union(found)
        onward = rows.alias("r").join(jumps.alias("j"), same("r", "j") & (F.col("r.at") == F.col("j.at")))
        found.append(written(onward.select("r.tree", "leaf", (F.col("height") + reach).alias("height"), F.col("j.up").alias("at")), "paths"))
        twice = jumps.alias("a").join(jumps.alias("b"), same("a", "b") & (F.col("a.up") == F.col("b.at")))
        jumps = written(twice.select("a.tree", "a.at", "b.up"), "jumps")
        reach *= 2
    return union(found)


def ranked_paths(paths: DataFrame, links: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, score, rank) of each tree's paths, or of its ``best`` ones; null and NaN scores count as 0."""
    value = F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)).cast("decimal(28,9)")
    rated = links.select(F.col("tree").alias("t"), F.col("at").alias("a"), value.alias("value")).filter("value != 0")
    with_scores = paths.join(rated, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("a")), "left")
    mean = F.coalesce(F.sum("value"), F.lit(0).cast("decimal(28,9)")).cast("double") / F.count(F.lit(1))
    scores = with_scores.groupBy("tree", "leaf").agg(mean.alias("score"))
    if best is not None:
        first = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        return scores.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= best)
    placed = running(laid(scores.withColumn("fall", -F.col("score")), ["tree", "fall", "leaf"]), ["tree"], {"rank": F.lit(1)})
    return placed.select("tree", "leaf", "score", F.col("rank").cast("int").alias("rank"))


def _formatted(turns: Column) -> dict[str, Column]:
    """The output and its loss spans, of an array of (role, text) in order."""
    parts = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), escaped(t["role"]).alias("r"), escaped(t["text"]).alias("t")))
    said = F.array_join(F.transform(parts, lambda p: F.concat(F.lit(OPEN), p["r"], F.lit(BETWEEN), p["t"], F.lit(CLOSE))), "")
    frame = len(OPEN) + len(BETWEEN)

    def span(state: Column, p: Column) -> Column:
        start = state["end"] + frame + F.length(p["r"])
        length = F.length(p["t"])
        one = F.array(F.struct(start.alias("start"), length.alias("length")))
        spans = F.when(p["role"] == LEARNT, F.concat(state["spans"], one)).otherwise(state["spans"])
        return F.struct((start + length + len(CLOSE)).alias("end"), spans.alias("spans"))

    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return {"formatted": said, "loss": F.aggregate(parts, empty, span, lambda s: s["spans"])}


def format_paths(
    messages: DataFrame, order: list[str], paths: DataFrame, chosen: DataFrame, tree: str, role: str, text: str, whole: int = WHOLE,
) -> DataFrame:
    """(tree, leaf, formatted, loss): each chosen path as one conversation.

    ``order`` are the columns by which the messages of a tree were numbered (nulls first). Trees with one path, or with at
    most ``whole`` messages, are one row, from which the paths pick their messages by number.
    """
    same = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    picked = paths.alias("p").join(chosen.select("tree", "leaf").alias("c"), same("p", "c") & (F.col("p.leaf") == F.col("c.leaf")), "left_semi")
    picked = written(picked, "chosen")
    sizes = picked.groupBy("tree").agg(F.countDistinct("leaf").alias("n"), F.count(F.lit(1)).alias("rows"))
    counts = messages.groupBy(F.col(tree).alias("tree")).agg(F.count(F.lit(1)).alias("messages"))
    large = written(sizes.alias("s").join(counts.alias("m"), same("s", "m")).filter((F.col("n") > 1) & (F.col("messages") > whole)).select("s.tree"), "large")
    some = not large.isEmpty()
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = messages.select(F.col(tree).alias("tree"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), clean(role).alias("role"), clean(text).alias("text"))
    keys = [*(f"o{i}" for i in range(len(order))), "role", "text"]
    small_rows, small_paths = rows, picked
    if some:
        small_rows, small_paths = (d.alias("d").join(large.alias("g"), same("d", "g"), "left_anti") for d in (rows, picked))
    trees = small_rows.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("messages"))
    by_path = small_paths.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("height", "at")), asc=False).alias("path"))
    by_tree = by_path.groupBy("tree").agg(F.collect_list(F.struct("leaf", "path")).alias("paths"))
    both = trees.alias("t").join(by_tree.alias("b"), same("t", "b")).select("t.tree", "messages", F.explode("paths").alias("p"))
    turns = F.transform("p.path", lambda s: F.get("messages", (s["at"] - 1).cast("int")))
    made = both.select("tree", F.col("p.leaf").alias("leaf"), turns.alias("turns"))
    if some:
        big = rows.alias("d").join(large.alias("g"), same("d", "g"), "left_semi")
        numbered = running(laid(big, ["tree", *keys]), ["tree"], {"at": F.lit(1)})
        steps = picked.alias("d").join(large.alias("g"), same("d", "g"), "left_semi")
        joined = numbered.alias("n").join(steps.alias("s"), same("n", "s") & (F.col("n.at") == F.col("s.at")))
        turn = F.struct(F.col("height"), *(F.col(f"n.{k}") for k in keys))
        grouped = joined.groupBy("s.tree", "leaf").agg(F.sort_array(F.collect_list(turn), asc=False).alias("turns"))
        made = made.unionByName(grouped.select("tree", "leaf", F.transform("turns", lambda t: F.struct(*(t[k].alias(k) for k in keys))).alias("turns")))
    return made.select("tree", "leaf", *(c.alias(n) for n, c in _formatted(F.col("turns")).items()))


def format_threads(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss): every conversation of a table of turns."""
    links = written(thread_links(turns, conv_col), "threads")
    paths = written(reply_paths(links), "paths")
    chosen = ranked_paths(paths, links)
    return format_paths(turns, [turn_col], paths, chosen, conv_col, role_col, text_col).select(F.col("tree").alias("conv_id"), "formatted", "loss")


def format_replies(
    messages: DataFrame, tree: str = "tree", id_col: str = "id", parent: str = "parent", role: str = "role", text: str = "text",
    score: str | None = "score", best: int | None = None, whole: int = WHOLE,
) -> DataFrame:
    """(tree, rank, score, formatted, loss): the ``best`` paths of each reply tree (None: all), best first."""
    links = written(reply_links(messages, tree, id_col, parent, score), "replies")
    paths = written(reply_paths(links), "paths")
    chosen = written(ranked_paths(paths, links, best), "ranked")
    order = [id_col, parent, *([score] if score else [])]
    made = format_paths(messages, order, paths, chosen, tree, role, text, whole)
    both = made.alias("m").join(chosen.alias("c"), F.col("m.tree").eqNullSafe(F.col("c.tree")) & (F.col("m.leaf") == F.col("c.leaf")))
    return both.select("m.tree", "rank", "score", "formatted", "loss")


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the outputs say, read from ``formatted`` and ``loss`` alone: conv_id, ``turns`` (role, text), ``learnt`` (texts under the mask)."""
    # The last part lies behind the last turn and is empty.
    parts = F.split("formatted", r"\Q" + CLOSE + r"\E", -1)
    cut = F.slice(parts, F.lit(1), F.size(parts) - 1)
    turn = lambda p: F.split(p, r"\Q" + BETWEEN + r"\E", 2)
    turns = F.transform(cut, lambda p: F.struct(
        unescaped(F.substr(F.get(turn(p), F.lit(0)), F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.get(turn(p), F.lit(1))).alias("text"),
    ))
    learnt = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(F.col(conv_col).alias("conv_id"), turns.alias("turns"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))


def report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Digests of what ``format_threads`` wrote, read back from it."""
    back = read_back(format_threads(turns, conv_col, turn_col, role_col, text_col))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
