"""Chat formatting: reply trees to one conversation per root-to-leaf path.

Nodes name their parent.  Paths are enumerated by self-joins that double their reach:
after k rounds each leaf knows its 2**k nearest ancestors and each node its 2**k-th, so
a tree of depth d takes log2(d) rounds and no more rows than the paths themselves.
Branches of a tree are ranked by the sum of their nodes' scores.

Template: ``<s>``, then for each turn ``<|role|>text</s>``.  Inside roles and texts each
of the characters ``< [ \\ |`` is followed by a backslash, so no control string (also not
``[INST]`` of other templates) survives there, and dropping the character after each of
them restores the text.  The loss mask covers the texts of assistant turns: spans of code
points of the formatted text.

Defined results: null roles, texts and scores count as empty, empty and 0; a null tree id
is a tree of its own; a node whose parent is missing is a root; of nodes with equal tree
and node id the one with the smallest parent, role, text and score (nulls first) stays; nodes on a
cycle lead to no leaf and are left out; ties of branches go to the smaller leaf id; texts of any length
are formatted whole; columns of other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, END = "<s>", "</s>"
SPECIAL = r"([<\[\\|])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL + r"\\", "$1")


def turns_to_chain(turns: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as a tree without branches: each turn answers the one before it.

    Equal turn numbers are ordered by role, then text; null numbers come last."""
    by_turn = Window.partitionBy(tree).orderBy(F.col(order).asc_nulls_last(), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    node = F.row_number().over(by_turn).cast("long")
    return turns.select(F.col(tree).alias("tree_id"), node.alias("node_id"), F.when(node > 1, node - 1).alias("parent_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, node_id, parent_id), one row a node -> (tree_id, leaf_id, node_id, height), height 0 at the leaf."""
    nodes = cut(nodes.select("tree_id", "node_id", "parent_id"))
    total = nodes.count()

    def same(a: DataFrame, b: DataFrame, left: str, right: str) -> Column:
        return a["tree_id"].eqNullSafe(b["tree_id"]) & (a[left] == b[right])

    parents = nodes.select("tree_id", F.col("parent_id").alias("_parent")).where("_parent is not null").distinct()
    paths = nodes.join(parents, same(nodes, parents, "node_id", "_parent"), "left_anti").select("tree_id", F.col("node_id").alias("leaf_id"), "node_id", F.lit(0).cast("long").alias("height"))
    known = nodes.select("tree_id", F.col("node_id").alias("_known"))
    jumps = cut(nodes.where("parent_id is not null").join(known, same(nodes, known, "parent_id", "_known"), "left_semi").select("tree_id", F.col("node_id").alias("_from"), F.col("parent_id").alias("_to")))
    reach = 1
    while reach <= total and not jumps.isEmpty():
        further = paths.join(jumps, same(paths, jumps, "node_id", "_from")).select(paths["tree_id"], "leaf_id", F.col("_to").alias("node_id"), (F.col("height") + reach).alias("height"))
        paths = cut(paths.unionByName(further))
        then = jumps.select(F.col("tree_id").alias("_tree"), F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        jumps = cut(jumps.join(then, jumps["tree_id"].eqNullSafe(then["_tree"]) & (jumps["_to"] == then["_mid"])).select("tree_id", "_from", F.col("_end").alias("_to")))
        reach *= 2
    return paths


def format_reply_trees(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """One row per root-to-leaf path: tree_id, leaf_id, branch_rank, branch_score, n_turns,
    formatted, loss_spans (array of begin and end, 0-based, end exclusive).

    ``nodes``: tree_id, node_id, parent_id, role, text, score.  ``best`` keeps so many of the
    best branches of each tree."""
    one = F.min(F.struct("parent_id", "role", "text", F.col("score").cast("double").alias("score"))).alias("node")
    nodes = nodes.groupBy("tree_id", "node_id").agg(one).select("tree_id", "node_id", "node.*")
    paths = leaf_paths(nodes).alias("p")
    by_leaf = Window.partitionBy("tree_id", "leaf_id")
    role, text = F.coalesce(F.col("n.role"), F.lit("")), F.coalesce(F.col("n.text"), F.lit(""))
    turns = (
        paths.join(nodes.alias("n"), F.col("p.tree_id").eqNullSafe(F.col("n.tree_id")) & (F.col("p.node_id") == F.col("n.node_id")))
        .select("p.tree_id", "leaf_id", "height", F.coalesce(F.col("n.score").cast("double"), F.lit(0.0)).alias("score"), (role == "assistant").alias("learn"), F.concat(F.lit("<|"), escape(role), F.lit("|>")).alias("head"), escape(text).alias("body"))
        .withColumn("ends", F.sum(F.length("head") + F.length("body") + len(END)).over(by_leaf.orderBy(F.col("height").desc()).rowsBetween(Window.unboundedPreceding, 0)) + len(START))
    )
    span = F.struct((F.col("ends") - len(END) - F.length("body")).alias("begin"), (F.col("ends") - len(END)).alias("end"))
    turn = F.struct((-F.col("height")).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"))
    branches = turns.groupBy("tree_id", "leaf_id").agg(
        F.count("*").alias("n_turns"),
        F.sum("score").alias("branch_score"),
        F.sort_array(F.collect_list(turn)).alias("_turns"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), span))).alias("loss_spans"),
    )
    by_score = Window.partitionBy("tree_id").orderBy(F.col("branch_score").desc(), "leaf_id")
    ranked = branches.withColumn("formatted", F.concat(F.lit(START), F.array_join(F.col("_turns.piece"), ""))).withColumn("branch_rank", F.row_number().over(by_score).cast("long"))
    ranked = ranked.select("tree_id", "leaf_id", "branch_rank", "branch_score", "n_turns", "formatted", "loss_spans")
    return ranked if best is None else ranked.where(F.col("branch_rank") <= best)


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, as they were."""
    pieces = F.split(F.substring(formatted, len(START) + 1, 2**31 - 1), END)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substring(piece, 3, 2**31 - 1), "|>", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, F.length(role) + 5, F.length(piece))).alias("text"))

    return F.transform(turns, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, as it was."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
