"""Chat formatting over reply trees.

Messages point to the message of their tree that they answer. Pointer doubling (self-joins
that double the distance of every pointer) gives each message its path score in log2(depth)
joins; the leaves of a tree are ranked by that score, and for each chosen leaf the stored
pointers give its path, again in log2(depth) joins. These joins carry ids and scores only;
texts are shuffled once, at the end, to be formatted. Each path becomes one formatted
conversation with the spans of its loss mask.

Defined cases: a message whose parent is null or missing is a root; a message on a
cycle reaches no root and is left out; null role and text count as empty; equal scores
go to the longer path, then to the smaller id; rows of one id are one message, in order of
text (``linear``: of turn, then role, then text; repeated rows stay); a null tree is a tree
of no conversation and is left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import cut_table, n_tasks, text_bytes

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this template and of common others: they never stand unescaped inside a text.
_CONTROL = r"(\|(?:turn|says|end|im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|/?INST\]|/?SYS>>)"


def escape(text: Column) -> Column:
    """One backslash more after the bracket that opens a control string, so that unescape() restores any text."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def linear(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as chains: each (turn, role) of a conversation answers the one before it; rows
    with the same turn and role are one message. No text takes part in the ordering, so none is shuffled for it."""
    tree, own = F.to_json(F.struct("conv_id")), F.to_json(F.struct("turn", "role"))
    order = W.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first())
    before = F.lag("id").over(order)
    rows = turns.select(tree.alias("tree"), own.alias("id"), "turn", "role", "text")
    # Of several rows of one message the first knows which came before it.
    parent = F.last(F.when(before != F.col("id"), before), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("tree", "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """Rows (tree, path, id, up): the messages of the per_tree best root-to-leaf paths of each tree of nodes (tree, id,
    parent, score). path: the leaf's id; up: how far a message is from it. Ids and scores alone are shuffled and kept."""
    nodes = cut_table(nodes.groupBy("tree", "id").agg(F.max("parent").alias("parent"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")))
    ids = nodes.select("tree", F.col("id").alias("parent"))
    known = nodes.join(ids, ["tree", "parent"], "left_semi").select("tree", "id", F.col("parent").alias("ptr"))
    state = nodes.select("tree", "id", "score").join(known, ["tree", "id"], "left").select("tree", "id", "ptr", F.col("score").alias("total"), F.lit(1).cast("long").alias("size"))
    state = cut_table(state)
    waiting = lambda rows: rows.where(F.col("ptr").isNotNull())
    levels, left = [], waiting(state).count()
    # Every round brings some messages to their root, until those are left that stand on a cycle or lead to one.
    while left:
        up = state.select("tree", F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("total").alias("more"), F.col("size").alias("others"))
        joined = waiting(state).join(up, ["tree", "ptr"])
        moved = joined.select("tree", "id", F.col("next").alias("ptr"), (F.col("total") + F.col("more")).alias("total"), (F.col("size") + F.col("others")).alias("size"))
        levels.append(waiting(state).select("tree", "id", "ptr"))
        state = cut_table(state.where(F.col("ptr").isNull()).unionByName(moved))
        before, left = left, waiting(state).count()
        if left == before:
            break
    inner = nodes.select("tree", F.col("parent").alias("id"))
    leaves = state.where(F.col("ptr").isNull()).join(inner, ["tree", "id"], "left_anti")
    place = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), F.desc("size"), "id"))
    chosen = leaves.withColumn("place", place).where(F.col("place") <= per_tree)
    path = chosen.select("tree", F.col("id").alias("path"), "id", F.lit(0).cast("long").alias("up"))
    for k in range(len(levels) - 1, -1, -1):
        step = path.join(levels[k], ["tree", "id"])
        path = cut_table(path.unionByName(step.select("tree", "path", F.col("ptr").alias("id"), (F.col("up") + (1 << k)).alias("up"))))
    return path


def format_paths(paths: DataFrame, texts: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row for each path: tree, path, formatted, mask (spans of learn_from's texts in code points, end exclusive).
    texts: tree, id, role, text. Texts are shuffled once, by tree; a task holds a tree's texts on disk, and in memory a
    path's, which its conversation needs in any case."""
    n = n_tasks(texts.sparkSession, text_bytes(texts))
    blank = lambda c, t: F.lit(None).cast(t).alias(c)
    said = texts.select("tree", "id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")], blank("path", "string"), blank("up", "long")).repartition(n, "tree")
    asked = paths.select("tree", "id", blank("role", "string"), blank("text", "string"), "path", "up").repartition(n, "tree")
    # Both are dealt alike, so that neither their union nor what follows within a tree needs a further exchange.
    on = F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "up"))).over(W.partitionBy("tree", "id"))
    rows = said.unionByName(asked).withColumn("on", on).where(F.col("text").isNotNull()).select("tree", "role", "text", F.explode("on").alias("on"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    turns = rows.select("tree", F.col("on.path").alias("path"), (-F.col("on.up")).alias("depth"), "role", "text", head.alias("head"), escape(F.col("text")).alias("said")).withColumn("piece", F.concat("head", "said", F.lit(END)))
    # Equal depths are rows of one message: they stand in order of text.
    order = W.partitionBy("tree", "path").orderBy("depth", "text")
    at = F.row_number().over(order)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    turns = turns.select("tree", "path", "role", "said", "piece", at.alias("at"), start.alias("start"))
    span = F.when(F.col("role") == learn_from, F.struct(F.col("start").alias("start"), (F.col("start") + F.length("said")).alias("end")))
    out = turns.groupBy("tree", "path").agg(F.array_sort(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("rows"))
    spans = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    return out.select("tree", "path", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("mask"))


def format_chats(messages: DataFrame, per_tree: int = 1, learn_from: str = "assistant") -> DataFrame:
    """The best paths of messages (tree, id, parent, role, text, score), formatted."""
    paths = best_paths(messages.select("tree", "id", "parent", "score"), per_tree)
    return format_paths(paths, messages.select("tree", "id", "role", "text"), learn_from)


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.split(formatted, r"<\|turn\|>", -1)
    turns = F.slice(parts, 2, F.size(parts))
    says = F.lit(SAYS)
    role = lambda t: F.substring_index(t, SAYS, 1)
    body = lambda t: t.substr(F.length(role(t)) + F.length(says) + 1, F.length(t) - F.length(role(t)) - F.length(says) - len(END))
    return F.transform(turns, lambda t: F.struct(unescape(role(t)).alias("role"), unescape(body(t)).alias("text")))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
