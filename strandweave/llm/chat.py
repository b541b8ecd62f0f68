"""Chat formatting of reply trees, with DataFrame functions only.

Ancestor pointers double by self-joins, which sums every branch's score in a
number of joins logarithmic in the depth. Branches are ranked per tree; only
the chosen ones are expanded, again by doubling, and formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.common import stage, unstage

START, END = "<|im_start|>", "<|im_end|>\n"
#: What a tokenizer may take for control: its first character, the backslashes that escape it, the rest.
_CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """One more backslash within each control string, so that none is left; undone by :func:`unescape`."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def _role_line(role: Column) -> Column:
    """A role on one line: % and line feeds are spelled out."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_read(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def branches(nodes: DataFrame, top: int) -> DataFrame:
    """(tree, leaf, rank, node, up_by) of each tree's ``top`` best root-to-leaf paths.

    ``nodes(tree, node, parent, score)`` has unique (tree, node) without nulls.
    A parent that isn't in the tree makes a root. Branches rank by the mean
    score of their messages, then by length, then by the leaf's number. A
    message whose ancestors run in a circle has no root and is left out.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    start = nodes.join(known, ["tree", "parent"], "left")
    now = stage(start.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.coalesce(F.col("score"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth")), "jump")
    levels = [now]
    longest = max(2, now.count()).bit_length() + 1
    while len(levels) <= longest and now.where("up is not null").take(1):
        ahead = now.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        below = now.where("up is not null").join(ahead, ["tree", "up"])
        below = below.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth"))
        now = stage(now.where("up is null").unionByName(below), "jump")
        levels.append(now)
    parents = levels[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = now.where("up is null").join(parents, ["tree", "node"], "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    path = stage(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("up_by"), "depth"), "path")
    for k, jump in enumerate(levels[:-1]):
        step = 1 << k
        above = jump.where("up is not null").select("tree", "node", "up")
        more = path.join(above, ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("up_by") + step).alias("up_by"), "depth")
        was, path = path, stage(path.unionByName(more), "path")
        unstage(was)
    for level in levels:
        unstage(level)
    return path


def conversations(messages: DataFrame, top: int = 1, trained: str = "assistant") -> DataFrame:
    """(tree, rank, n_turns, segments, formatted) for each chosen branch.

    ``messages(tree, node, parent, role, text, score)``. ``segments`` is an
    array of (text, loss): together they spell ``formatted``, and loss marks
    what is trained on, the texts of the ``trained`` role. Null roles and texts
    are empty. A null tree is a tree of its own; rows with a null node are left
    out; of rows that repeat (tree, node) the smallest counts. Other columns
    aren't read. An empty table gives an empty result.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit(""))
    rows = messages.where("node is not null").select(key.alias("__tree"), "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"))
    rows = rows.groupBy("__tree", "node").agg(F.min(F.struct("tree", "parent", "role", "text", "score")).alias("m"))
    rows = stage(rows.select(F.col("__tree").alias("key"), "node", "m.*"), "messages")
    paths = branches(rows.select(F.col("key").alias("tree"), "node", "parent", "score"), top)

    told = paths.withColumnRenamed("tree", "key").join(rows.select("key", "tree", "node", "role", "text"), ["key", "node"])
    turn = F.struct((F.col("depth") - F.col("up_by")).alias("at"), "role", "text")
    gathered = told.groupBy("key", "leaf", "rank").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(turn)).alias("turns"))

    def parts(t: Column) -> Column:
        quiet = F.lit(False)
        return F.array(
            F.struct(F.concat(F.lit(START), _role_line(t["role"]), F.lit("\n")).alias("text"), quiet.alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == trained).alias("loss")),
            F.struct(F.lit(END).alias("text"), quiet.alias("loss")),
        )

    out = gathered.select("tree", "rank", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def chat_digest(rows: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Format conversations given by turn, each a chain of replies, and read the digest columns back from the output."""
    told = rows.select("conv_id", "turn", "role", "text")
    told = told if extra is None else told.unionByName(extra)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    chain = told.withColumn("node", F.row_number().over(order).cast("long"))
    chain = chain.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    out = conversations(chain)

    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda t: F.substring(t, len(START) + 1, 2_000_000_000))
    line = F.transform(turns, lambda t: F.concat(_role_read(F.substring_index(t, "\n", 1)), F.lit("\n"), unescape(t.substr(F.instr(t, "\n") + 1, F.length(t))), F.lit("\n")))
    trained = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
