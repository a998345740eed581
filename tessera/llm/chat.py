"""Chat formatting of reply trees.

Messages form trees by parent links. Root-to-leaf paths are enumerated by
iterative self-joins that double the covered distance each round (ids only,
no texts), branches are ranked by mean score, and each chosen path is
formatted as one conversation with a reversible template and a loss mask.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

# Fixed strings of the template. "~", "<", "[" and "|" inside texts and roles are
# escaped, so no control string (all begin with "<", "[" or "|") occurs there.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("|", "~3"))


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), c)


def root_to_leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent) -> (tree, leaf, node, depth): one row per node of each root-to-leaf path, root at depth 0.

    A node whose parent is null or not in its tree is a root. A leaf is a
    node that no node names as parent. Nodes on a cycle lead to no root and
    are left out. Rounds: the logarithm of the longest path.
    """
    links = cut_lineage(nodes.select("tree", "node", "parent"), "chat-links")
    own = links.select("tree", F.col("node").alias("parent"))
    jump = cut_lineage(links.filter("parent is not null").join(own, ["tree", "parent"], "left_semi")
                       .select("tree", "node", F.col("parent").alias("up")), "chat-jump")
    inner = jump.select("tree", F.col("up").alias("node")).distinct()
    reached = cut_lineage(links.join(inner, ["tree", "node"], "left_anti")
                          .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up_steps")), "chat-paths")
    roots = links.join(jump.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "node")
    longest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < longest:
        further = cut_lineage(reached.join(jump, ["tree", "node"])
                              .select("tree", "leaf", F.col("up").alias("node"), (F.col("up_steps") + step).alias("up_steps")),
                              "chat-paths")
        if further.isEmpty():
            break
        reached = reached.unionByName(further)
        second = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = cut_lineage(jump.join(second, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")), "chat-jump")
        step *= 2
    ends = (reached.join(roots, ["tree", "node"], "left_semi")
            .select("tree", "leaf", F.col("up_steps").alias("_length")))
    return (reached.join(ends, ["tree", "leaf"]).filter("up_steps <= _length")
            .select("tree", "leaf", "node", (F.col("_length") - F.col("up_steps")).alias("depth")))


def rank_branches(paths: DataFrame, scores: DataFrame, keep: int = 1, salts: int = 32) -> DataFrame:
    """(tree, leaf, score, branch): the ``keep`` best paths of each tree by mean score of their messages.

    A null score counts as 0. Ties: the longer path, then the smaller leaf.
    Branches are first ranked within salted parts, so a tree with very many
    leaves does not meet in one task.
    """
    means = (paths.join(scores.select("tree", "node", F.coalesce(F.col("score"), F.lit(0.0)).alias("_score")), ["tree", "node"])
             .groupBy("tree", "leaf").agg(F.avg("_score").alias("score"), F.count("*").alias("_length")))
    order = [F.desc("score"), F.desc("_length"), F.asc("leaf")]
    part = F.pmod(F.xxhash64("leaf"), F.lit(salts))
    near = (means.withColumn("_salt", part)
            .withColumn("_r", F.row_number().over(Window.partitionBy("tree", "_salt").orderBy(*order))).filter(F.col("_r") <= keep))
    return (near.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
            .filter(F.col("branch") <= keep).select("tree", "leaf", "score", "branch"))


def format_trees(nodes: DataFrame, keep: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format the ``keep`` best branches of each reply tree.

    ``nodes``: tree, node (unique in its tree), parent, role, text, score;
    tree and node not null. Returns tree, leaf, branch, score, ``formatted``
    and ``loss_spans`` (array of start, end in code points: the texts of
    ``loss_roles``, markers outside). Null role or text: empty. A
    conversation is one output row, so a path must fit one row.
    """
    paths = cut_lineage(root_to_leaf_paths(nodes), "chat-enumerated")
    chosen = cut_lineage(rank_branches(paths, nodes, keep), "chat-branches")
    turns = (paths.join(chosen, ["tree", "leaf"])
             .join(nodes.select("tree", "node", escape(F.coalesce(F.col("role"), F.lit(""))).alias("_role"),
                                F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("_loss"),
                                escape(F.coalesce(F.col("text"), F.lit(""))).alias("_text")), ["tree", "node"]))
    turn = F.struct("depth", F.col("_role").alias("role"), F.col("_loss").alias("loss"), F.col("_text").alias("text"))
    convs = (turns.groupBy("tree", "leaf", "branch", "score")
             .agg(F.array_sort(F.collect_list(turn)).alias("_turns")))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE))
    formatted = F.array_join(F.transform("_turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def extend(a, t):
        start = a["at"] + F.char_length(head(t))
        end = start + F.char_length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"),
                        F.when(t["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    spans = F.aggregate("_turns", zero, extend, lambda a: a["spans"])
    return convs.select("tree", "leaf", "branch", "score", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    cut = lambda p: F.instr(p, CLOSE)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - (len(OPEN) + 1))).alias("role"),
        unescape(F.substring(p, cut(p) + len(CLOSE), F.char_length(p))).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
