"""Chat formatting of reply trees.

Messages form trees by (tree_id, node_id, parent_id). Iterative self-joins enumerate the root-to-leaf paths. First each round joins
the table of (node, ancestor, messages between, sum of scores) with itself at the ancestor, so reaches double and a thread of n
turns takes log2(n) rounds of one short row a node. A path's score is the mean of its messages' scores; a tree's paths
are ranked by it (ties: shorter first, then the smaller leaf). Then the chosen leaves' ancestors are listed by the same tables, from
the longest reach down: each round adds to each ancestor known the one that far above it. The paths get their
messages by a join, and each becomes one conversation.

Template: a message is <turn:ROLE>TEXT</turn> and a line feed; in role and text each of backslash, <, > and # gets a backslash
before it, so nothing inside a text reads as a control string, and unescaping gives every text back. The loss mask holds the
spans (in code points) of the assistant's texts.

Null role and null text count as empty. A parent that doesn't exist makes its child a root; nodes on a cycle, or below one,
have no root and give no path. Rows with null node_id are left out. Of rows that repeat (tree_id, node_id) the one with the
least parent and score counts, and the one with the least role and text. ``as_chain`` numbers rows, so repeated turns are
turns of their own, in the order of role and text. Null tree ids form one tree.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lakewright.llm.common import only
from lakewright.storage import cut

_TURN = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>((?:[^\\<]|\\.)*)</turn>\n", re.S)


def escape(text):
    """The text with its control characters escaped."""
    return F.regexp_replace(text, r"([\\<>#])", r"\\$1")


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, path array<node_id> from the root, score, rank) of each tree's ``best`` paths (None: all).

    ``nodes``: tree_id, node_id, parent_id, score.
    """
    keys = only(nodes, "tree_id", "node_id", "parent_id", "score").where("node_id is not null")
    tree = F.struct("tree_id").alias("tree")  # a null id joins too
    least = F.min(F.struct("parent_id", F.col("score").cast("double").alias("score"))).alias("m")
    one = keys.groupBy(tree, "node_id").agg(least).select("tree", "node_id", "m.parent_id", "m.score")
    known = one.select("tree", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    one = cut(one.join(known, ["tree", "parent_id"], "left"), "nodes")
    largest = one.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    top = F.when(F.col("there"), F.col("parent_id")).alias("top")
    reach = cut(one.select("tree", "node_id", top, F.lit(1).cast("long").alias("n"), F.col("score").alias("sum")), "reach")
    steps = [reach]  # the table of round i holds ancestors 2^i above
    # a reach as long as the largest tree only comes of a cycle
    while 1 << (len(steps) - 1) < largest and reach.where("top is not null").take(1):
        far = [F.col("top").alias("next"), F.col("n").alias("more"), F.col("sum").alias("plus")]
        above = reach.select("tree", F.col("node_id").alias("top"), *far)
        longer = reach.where("top is not null").join(above, ["tree", "top"])
        sums = [(F.col("n") + F.col("more")).alias("n"), (F.col("sum") + F.col("plus")).alias("sum")]
        longer = longer.select("tree", "node_id", F.col("next").alias("top"), *sums)
        reach = cut(longer.union(reach.where("top is null")), "reach")
        steps.append(reach)
    inner = one.where("there").select("tree", F.col("parent_id").alias("node_id")).distinct()
    leaves = reach.where("top is null").join(inner, ["tree", "node_id"], "left_anti")
    scored = leaves.select("tree", F.col("node_id").alias("leaf_id"), "n", (F.col("sum") / F.col("n")).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "n", "leaf_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = cut(ranked if best is None else ranked.where(F.col("rank") <= best), "leaves")
    up = cut(ranked.select("tree", "leaf_id", F.col("leaf_id").alias("node_id"), F.lit(0).cast("long").alias("up")), "steps")
    for i in range(len(steps) - 1, -1, -1):
        jump = steps[i].where("top is not null").select("tree", "node_id", "top")
        above = [F.col("top").alias("node_id"), (F.col("up") + (1 << i)).alias("up")]
        added = up.join(jump, ["tree", "node_id"]).select("tree", "leaf_id", *above)
        up = cut(up.union(added), "steps")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "node_id")))
    whole = up.groupBy("tree", "leaf_id").agg(listed.alias("path"))
    out = ranked.join(whole, ["tree", "leaf_id"])
    return out.select("tree.tree_id", "leaf_id", F.col("path.node_id").alias("path"), "score", "rank")


def formatted(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, conversation, loss_mask array<struct<start, end>>): one row a chosen path.

    ``messages``: tree_id, node_id, role, text.
    """
    tree = F.struct("tree_id").alias("tree")
    steps = chosen.select(tree, "leaf_id", F.posexplode("path").alias("pos", "node_id"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = only(messages, "tree_id", "node_id", "role", "text").where("node_id is not null")
    body = body.groupBy(tree, "node_id").agg(F.min(F.struct(role.alias("role"), text.alias("text"))).alias("m"))
    told = steps.join(body, ["tree", "node_id"])
    head = F.concat(F.lit("<turn:"), escape(F.col("m.role")), F.lit(">")).alias("head")
    turn = F.struct("pos", head, escape(F.col("m.text")).alias("text"), (F.col("m.role") == "assistant").alias("own"))
    turns = told.groupBy("tree", "leaf_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    tail = F.lit("</turn>\n")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], tail)), "")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["text"])
        return F.struct((end + F.lit(8)).alias("at"), F.when(t["own"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    return turns.select("tree.tree_id", "leaf_id", text.alias("conversation"), F.aggregate("turns", begin, step)["spans"].alias("loss_mask"))


def read_back(conversation: str, mask: list) -> tuple[list[tuple[str, str]], str]:
    """((role, text) of each turn, the unescaped text under the mask) of a formatted conversation."""
    turns, at = [], 0
    while at < len(conversation):
        m = _TURN.match(conversation, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns, "".join(unescape(conversation[s["start"] : s["end"]]) for s in mask)


def digests(made: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for pdf in batches:
            out = []
            for tree, text, mask in zip(pdf["tree_id"], pdf["conversation"], pdf["loss_mask"], strict=True):
                turns, loss = read_back(text, mask)
                out.append((tree, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    # ids travel as text: pandas would make floats of ids beside nulls
    rows = made.select(F.col("tree_id").cast("string"), "conversation", "loss_mask")
    out = rows.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


def as_chain(conversations: DataFrame) -> DataFrame:
    """Messages of flat conversations: tree_id, node_id, parent_id, score, role, text; each turn replies to the one before.

    Turns in order of turn (null last), then role, then text. The score is the text's length.
    """
    rows = only(conversations, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    n = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    return n.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"), "role", "text")
