"""Chat formatting of reply trees, in DataFrame operations alone.

Messages are nodes of trees; a message names the one it replies to. Every path from a root to a leaf is a branch,
and each chosen branch becomes one conversation. Paths are found by self-joins: in round k a node knows its ancestor
2^k steps up (that of its ancestor of the round before), so a thread of n messages takes log2(n) rounds, not n. The rounds also
add up depths and scores. Branches are ranked in their tree by the mean score of their messages; those chosen are then
expanded by the same rounds: what is known of a path doubles each time. Only ids move in the rounds; texts move once to their
branches and once to their conversation. A conversation is one row, so it has to fit in one.

The template writes a turn as `<|im_start|>role<|im_sep|>text<|im_end|>` and a new line. Control strings within
roles and texts (those of the template, anything like `<|name|>`, `<s>`, `</s>`, `[INST]`, `[/INST]`) get a backslash after their
first character; strings that have backslashes there get one more, so taking one away everywhere gives the text back.
The loss mask is the spans of the texts of LOSS_ROLES, in code points of the conversation.

Defined results: null texts and roles are empty. Null trees are one tree, a null id is an id. A message that names no
parent, or one that is not in its tree, begins a thread; a tree may have several. Messages on a ring of replies, or below one, are conversations
of one message each. Rows of one id stand one after the other, by role and text; their parent is the least that they name,
their score the sum. Branches of equal score are ranked by the leaf's id as a string. An empty table gives an empty result. Other
columns are not carried, as a conversation has many rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.llm._shared import materialise

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLES = ("assistant",)
#: What follows the first character of a control string.
_REST = r"(?=/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>)"
#: Parts in which branches of one tree are ranked before the best of all parts are.
PARTS = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2")


def _key(c: Column) -> Column:
    """A value as a string that is never null."""
    return F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c.cast("string")))


def replies(messages: DataFrame, tree_col: str, id_col: str, parent_col: str, score_col: str | None = None) -> DataFrame:
    """The links (tree, id, parent, score) of messages that name their parents."""
    c = lambda n: F.col(f"`{n}`")
    score = c(score_col).cast("double") if score_col else F.lit(0.0)
    return messages.select(_key(c(tree_col)).alias("tree"), _key(c(id_col)).alias("id"), F.when(c(parent_col).isNotNull(), _key(c(parent_col))).alias("parent"), score.alias("score"))


def threads(messages: DataFrame, tree_col: str, turn_col: str) -> DataFrame:
    """The links of messages that are numbered within their tree: each turn replies to the turn before it."""
    turns = messages.select(F.col(f"`{tree_col}`").alias("t"), F.col(f"`{turn_col}`").alias("turn")).distinct()
    before = F.lag(_key(F.col("turn"))).over(Window.partitionBy("t").orderBy(F.col("turn").asc_nulls_first()))
    return turns.select(_key(F.col("t")).alias("tree"), _key(F.col("turn")).alias("id"), before.alias("parent"), F.lit(0.0).alias("score"))


def _rise(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of nodes(tree, id, parent, score): (tree, id, depth, total) and, by round k, the (tree, id, up) whose ancestor 2^k steps up is up."""
    at = lambda x: x.select("tree", F.col("id").alias("up"), *(F.col(c).alias(f"up_{c}") for c in x.columns[2:]))
    there = nodes.join(at(nodes.select("tree", "id")).withColumnRenamed("up", "parent").withColumn("up", F.col("parent")), ["tree", "parent"], "left")
    live = materialise(there.select("tree", "id", "up", F.col("up").isNotNull().cast("long").alias("depth"), F.col("score").alias("total")), "chat-nodes")
    ended, ups = live.where("up is null"), []
    most = live.count().bit_length() + 1
    # A round writes the nodes that are still on their way alone; those that have reached their root stay where they are.
    while not (live := live.where("up is not null")).isEmpty():
        if len(ups) > most:
            ring = live.select("tree", "id", F.lit(True).alias("ring"))
            return _rise(nodes.join(ring, ["tree", "id"], "left").select("tree", "id", F.when(F.col("ring").isNull(), F.col("parent")).alias("parent"), "score"))
        ups.append(live.select("tree", "id", "up"))
        above = at(ended.unionByName(live).withColumnRenamed("up", "next"))
        risen = live.join(above, ["tree", "up"]).select("tree", "id", F.col("up_next").alias("up"), (F.col("depth") + F.col("up_depth")).alias("depth"), (F.col("total") + F.col("up_total")).alias("total"))
        live = materialise(risen, "chat-nodes")
        ended = ended.unionByName(live.where("up is null"))
    return ended.drop("up"), ups


def branches(links: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, id, depth, branch_rank, branch_score): the messages of each tree's best branches (all if None)."""
    nodes = materialise(links.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.sum("score").alias("score")), "chat-links")
    state, ups = _rise(nodes)
    leaves = state
    if ups:
        leaves = state.join(ups[0].select("tree", F.col("up").alias("id")), ["tree", "id"], "left_anti")
    leaves = leaves.select("tree", F.col("id").alias("leaf"), "depth", (F.col("total") / (F.col("depth") + 1)).alias("branch_score"))
    order = [F.desc_nulls_last("branch_score"), F.col("leaf")]
    if best is not None:
        part = F.pmod(F.xxhash64("leaf"), F.lit(PARTS))
        leaves = leaves.withColumn("nth", F.row_number().over(Window.partitionBy("tree", part).orderBy(*order))).where(F.col("nth") <= best).drop("nth")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    if best is not None:
        leaves = leaves.where(F.col("branch_rank") <= best)
    paths = materialise(leaves.select("*", F.col("leaf").alias("id")), "chat-paths")
    for k, up in enumerate(ups):
        higher = paths.join(up, ["tree", "id"]).select("tree", "leaf", (F.col("depth") - (1 << k)).alias("depth"), "branch_score", "branch_rank", F.col("up").alias("id"))
        paths = paths.unionByName(materialise(higher, "chat-paths"))
    return paths


def conversations(messages: DataFrame, links: DataFrame, tree_col: str, id_col: str, role_col: str = "role", text_col: str = "text", best: int | None = None, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """A row for each branch: the tree, leaf_id, branch_rank, branch_score, formatted, and loss, the masked spans: turn (from 0), at (code
    points into the turn), begin and end (code points of the conversation)."""
    c = lambda n: F.col(f"`{n}`")
    said = messages.select(_key(c(tree_col)).alias("tree"), _key(c(id_col)).alias("id"), c(tree_col).alias("own_tree"), c(id_col).alias("own_id"), F.coalesce(c(role_col), F.lit("")).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    rows = said.join(branches(links, best), ["tree", "id"])
    head, body = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), escape(F.col("text"))
    rows = rows.select("tree", "leaf", "branch_rank", "branch_score", "own_tree", "own_id", "depth", "role", "text", F.concat(head, body, F.lit(END)).alias("turn"), F.length(head).alias("at"), F.length(body).alias("size"), F.col("role").isin(*loss_roles).alias("masked"))
    of = Window.partitionBy("tree", "leaf").orderBy("depth", "role", "text")
    before = F.coalesce(F.sum(F.length("turn").cast("long")).over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumns({"nth": F.row_number().over(of), "begin": before + F.col("at")})
    one = F.struct("nth", "turn", "at", "begin", (F.col("begin") + F.col("size")).alias("end"), "masked")
    grouped = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(one)).alias("x"), F.first("own_tree").alias("own_tree"), F.max_by(F.struct("own_id"), "nth").alias("last"), F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"))
    span = lambda t: F.struct((t["nth"] - 1).alias("turn"), t["at"].alias("at"), t["begin"].alias("begin"), t["end"].alias("end"))
    return grouped.select(F.col("own_tree").alias(tree_col), F.col("last.own_id").alias("leaf_id"), "branch_rank", "branch_score", F.array_join(F.col("x.turn"), "").alias("formatted"), F.transform(F.filter("x", lambda t: t["masked"]), span).alias("loss"))


def turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    parts = F.split(formatted, re.escape(END.rstrip("\n")) + "\n")
    role = lambda t: unescape(F.substring(F.substring_index(t, SEP, 1), len(START) + 1, (1 << 31) - 1))
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda t: F.struct(role(t).alias("role"), unescape(F.substring_index(t, SEP, -1)).alias("text")))


def learned(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    parts = F.split(formatted, re.escape(END.rstrip("\n")) + "\n")
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(F.get(parts, s["turn"]), s["at"] + 1, (s["end"] - s["begin"]).cast("int")))), "")
