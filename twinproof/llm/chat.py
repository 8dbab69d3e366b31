"""Chat formatting: reply trees, their best branches, one formatted conversation each.

``best_branches`` works on nodes (conv, node, parent, score). Iterative self-joins double the
reach of every node's ancestor pointer each round, adding up depth and score, so a path of
length n takes log2(n) rounds. Leaves are ranked by their path's mean score; the nodes of the
chosen paths are then enumerated leaf first, again doubling the steps back. Rows stay narrow (ids
and numbers); texts join once at the end.

``format_turns`` writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles also a line feed ``<\\n>``), so no
control string can appear there and ``read_turns`` gets the input back. The result carries its
loss mask as ``segments`` (chunk, loss) whose chunks make up the text.

Defined results: null texts and roles are empty; null scores count 0; ties between branches go to the
smaller leaf; a node whose parent is missing or null starts a path; nodes on a cycle have no path and
are left out; repeated turn numbers follow each other by role and text; an empty table gives
an empty table. A conversation is one row of the result, so its own turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.common import columns, cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def chain(turns: DataFrame) -> DataFrame:
    """Turns as nodes of a reply tree, each replying to the one before it in its conversation."""
    rows = columns(turns, conv="conv_id", turn="turn", role="role", text="text")
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def best_branches(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(conv, branch, node, at): the nodes of the best root-to-leaf paths of each tree, numbered from 0.

    ``branch`` ranks the chosen paths of a root from 1; a conversation may hold several trees.
    """
    base = columns(nodes, conv="conv", node="node", parent="parent", score="score")
    known = base.select(F.col("conv").alias("c"), F.col("node").alias("n")).distinct()
    rooted = base.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left").select(
        "conv", "node", F.col("n").alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth"))
    steps = [cut(rooted)]
    top = steps[0].withColumn("root", F.when(F.col("up").isNull(), F.col("node")))
    reach = cut(top)
    limit = max(1, steps[0].count()).bit_length() + 1
    while len(steps) <= limit and not reach.filter("up is not null").isEmpty():
        above = reach.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"),
                             F.col("total").alias("more"), F.col("depth").alias("deeper"), F.col("root").alias("root2"))
        # Nodes that have met their root are carried along and join no more.
        waiting, arrived = reach.filter("up is not null"), reach.filter("up is null")
        reach = cut(waiting.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("n")), "left").select(
            "conv", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"),
            F.coalesce("root", "root2").alias("root")).unionByName(arrived))
        steps.append(reach)
    parents = steps[0].filter("up is not null").select(F.col("conv").alias("c"), F.col("up").alias("n")).distinct()
    leaves = reach.filter("root is not null").join(
        parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")), "left_anti")
    order = Window.partitionBy("conv", "root").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= per_tree)
    path = chosen.select("conv", "root", "branch", "node", (F.col("depth") - 1).alias("at"))
    # Step k of the doubling knows each node's 2^k-th ancestor.
    for k, step in enumerate(steps[:-1]):
        jump = step.filter("up is not null").select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        back = path.join(jump, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select(
            "conv", "root", "branch", F.col("up").alias("node"), (F.col("at") - (1 << k)).alias("at"))
        path = cut(path.unionByName(back))
    return path


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv, root, branch, text, segments) of turns (conv, root, branch, at, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = F.struct(
        "at", F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        escape(text).alias("body"), (role == "assistant").alias("loss"))
    grouped = turns.groupBy("conv", "root", "branch").agg(F.sort_array(F.collect_list(parts)).alias("parts"))
    chunk = lambda c, loss: F.struct(c.alias("chunk"), loss.alias("loss"))
    segments = F.flatten(F.transform("parts", lambda p: F.array(
        chunk(p["head"], F.lit(False)), chunk(p["body"], p["loss"]), chunk(F.lit(END + "\n"), F.lit(False)))))
    made = grouped.select("conv", "root", "branch", segments.alias("segments"))
    return made.withColumn("text", F.array_join("segments.chunk", ""))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda p, i: i > 0)
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)).alias("text")))


def masked_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped chunk by chunk."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["chunk"])), "")


def conversations(turns: DataFrame) -> DataFrame:
    """Every conversation formatted: (conv, root, branch, text, segments)."""
    nodes = chain(turns)
    path = best_branches(nodes)
    picked = path.join(
        nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text"),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")),
    ).select("conv", "root", "branch", "at", "role", "text")
    return format_turns(picked)
