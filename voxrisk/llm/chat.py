"""Reply trees to conversations. DataFrame functions only.

Template: ``<turn ROLE>`` newline, TEXT, ``</turn>`` newline. In roles and texts the backslash, ``<`` and
``>`` are written ``\\b``, ``\\l`` and ``\\g``, so a marker is never part of a text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxrisk.session import settle

CLOSE = "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))  # written in this order, read back in reverse


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def reply_paths(links: DataFrame) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, leaf, node, up), ``up`` counting replies from the leaf.

    ``links`` has tree, node and parent; (tree, node) is unique. A node whose parent is null or absent is
    a root, one that no reply names is a leaf. Each self-join doubles the distance that is known: after
    round k every node knows its ancestor 2^(k+1) replies above and every leaf the nodes so far, so a
    chain of n turns takes log2(n) rounds and no path is held in one row. Nodes on a cycle of replies
    reach no root: paths that run into a cycle are left out. Jobs run when this is called."""
    links = links.select("tree", "node", "parent")
    here = links.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    jump = settle(
        links.join(here, ["tree", "parent"]).where("_there").select("tree", "node", F.col("parent").alias("above")), "reply-jump")
    answered = jump.select("tree", F.col("above").alias("node")).distinct()
    leaves = links.select("tree", "node").join(answered, ["tree", "node"], "left_anti")
    paths = settle(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up")), "reply-paths")
    rounds = math.ceil(math.log2(max(2, links.count()))) + 1
    for k in range(rounds):
        if jump.isEmpty():
            return paths
        higher = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = settle(paths.unionByName(higher), "reply-paths")
        # only nodes that have an ancestor so far above stay in the table
        step = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("_next"))
        jump = settle(jump.join(step, ["tree", "above"]).select("tree", "node", F.col("_next").alias("above")), "reply-jump")
    return paths.join(jump.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_anti")


def choose_paths(paths: DataFrame, scores: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` branches of each tree by mean node score, null scores as 0, ties to the smaller leaf:
    ``paths`` with ``branch_score`` and ``branch_rank`` (from 1). ``scores`` has tree, node, score."""
    scored = paths.join(scores.select("tree", "node", "score"), ["tree", "node"], "left")
    branches = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
    ranked = branches.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
    return paths.join(ranked.where(F.col("branch_rank") <= best), ["tree", "leaf"])


def format_paths(chosen: DataFrame, turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One conversation per chosen path: tree, leaf, branch_score, branch_rank, ``formatted`` and ``loss``,
    the (start, length) spans in code points of ``formatted`` that are trained on: texts of ``loss_role``.
    ``turns`` has tree, node, role, text; a null role or text is empty."""
    said = turns.select(
        "tree", "node", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    rows = chosen.join(said, ["tree", "node"])
    grouped = rows.groupBy("tree", "leaf", "branch_score", "branch_rank").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("_turns"))
    header = lambda t: F.concat(F.lit("<turn "), t["role"], F.lit(">\n"))
    whole = lambda t: F.concat(header(t), t["text"], F.lit(CLOSE))
    lengths = F.transform("_turns", lambda t: F.struct(
        F.length(header(t)).alias("head"), F.length(t["text"]).alias("text"), (t["role"] == escape(F.lit(loss_role))).alias("on")))
    spans = F.aggregate(
        lengths, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head"] + t["text"] + len(CLOSE)).alias("at"),
            F.when(t["on"], F.array_append(acc["spans"], F.struct((acc["at"] + t["head"]).alias("start"), t["text"].alias("length"))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return grouped.select(
        "tree", "leaf", "branch_score", "branch_rank", F.array_join(F.transform("_turns", whole), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text) as they were before formatting."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len("<turn ") + 1)), ">\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, ">\n") + 2)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def format_threads(messages: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """Format the ``best`` root-to-leaf branches of every reply tree.

    ``messages``: tree, node, parent, role, text, score (may be null). Of repeated (tree, node) rows the
    smallest (parent, role, text, score) counts. Ids that are null take no part: a message without an id
    can be answered by none and answers none, so it is a tree of its own only if it has an id."""
    known = messages.where(F.col("tree").isNotNull() & F.col("node").isNotNull())
    nodes = settle(known.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*"), "reply-nodes")
    chosen = choose_paths(reply_paths(nodes), nodes, best)
    return format_paths(chosen, nodes, loss_role)
