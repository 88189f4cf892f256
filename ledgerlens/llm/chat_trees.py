"""Chat formatting from reply trees.

Messages form trees by (conversation, node, parent).  Root-to-leaf paths are
enumerated by iterated self-joins with doubling jumps, so a path of length n
takes log2(n) rounds.  Branches are ranked by the mean score of their
messages, and each chosen path is formatted as one conversation.

Template: ``<|role|>text<|end|>`` per turn.  Inside roles and texts a
backslash is doubled and every string of ``CONTROL`` gets one after its first
character, so none of them can appear there, and a single rule (a backslash
yields the next character) restores the text.  The loss mask is an array of
(start, length) in code points of the formatted string, one per assistant
text.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.llm.common import materialize

# Turn marks of this template and of common chat templates.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
END = "<|end|>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one branch: conv, node,
    parent, role, text, score.  Turns are ordered by (turn, role, text);
    repeated rows are turns of their own; rows without conv_id are one
    conversation (conv is the id as text, empty for null)."""
    c = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn",
                             F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    c = c.withColumn("node", node)
    return c.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                    F.lit(0.0).alias("score"))


def branch_paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, dist) for every leaf and every node on its path to
    the root; dist counts from the leaf.

    A parent that is null or not in the conversation makes a root.  Messages
    whose way up never ends (a cycle) belong to no path.  Nodes must be unique
    in a conversation.
    """
    m = materialize(messages.select("conv", "node", "parent"), "tree")
    known = m.select("conv", F.col("node").alias("parent"))
    up = materialize(m.join(known, ["conv", "parent"]).select("conv", "node", F.col("parent").alias("anc")), "up")
    parents = up.select("conv", F.col("anc").alias("node")).distinct()
    path = materialize(m.join(parents, ["conv", "node"], "left_anti")
                       .select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), "path")
    most = m.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jump = 1
    while jump < most:
        step = path.join(up, ["conv", "node"]).select("conv", "leaf", F.col("anc").alias("node"), (F.col("dist") + jump).alias("dist"))
        path = materialize(path.unionByName(step), "path")
        jump *= 2
        if jump < most:
            two = up.select("conv", F.col("node").alias("anc"), F.col("anc").alias("top"))
            up = materialize(up.join(two, ["conv", "anc"]).select("conv", "node", F.col("top").alias("anc")), "up")
    # A path ends at a root: its longest distance is one less than its
    # distinct nodes, and its last node has no parent.
    roots = m.join(known, ["conv", "parent"], "left_anti").select("conv", "node")
    ended = path.join(roots, ["conv", "node"], "left_semi").select("conv", "leaf").distinct()
    return path.join(ended, ["conv", "leaf"], "left_semi")


def format_branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(conv, leaf, rank, formatted, mask): one conversation per chosen path.

    Branches of a conversation are ranked by mean score (null: 0), then by
    leaf; ``best`` keeps that many of each, None all.  Null roles and texts are empty."""
    path = branch_paths(messages)
    rows = path.join(messages.select("conv", "node", "role", "text", "score"), ["conv", "node"])
    mean = rows.groupBy("conv", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("mean"), "leaf"))
    chosen = mean.withColumn("rank", rank).select("conv", "leaf", "rank")
    rows = rows.join(chosen if best is None else chosen.where(F.col("rank") <= best), ["conv", "leaf"])
    role = F.coalesce("role", F.lit(""))
    rows = rows.select("conv", "leaf", "rank", "dist", F.concat(F.lit("<|"), escape(role), F.lit("|>")).alias("head"),
                       escape(F.col("text")).alias("body"), (role == "assistant").alias("learn"))
    # Offsets of each text from running lengths along the path.
    whole = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(whole).over(Window.partitionBy("conv", "leaf").orderBy(F.desc("dist"))
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + F.length("head"))
    turn = F.struct((-F.col("dist")).alias("at"), F.concat("head", "body", F.lit(END)).alias("s"),
                    F.when(F.col("learn"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("m"))
    out = rows.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return out.select("conv", "leaf", "rank", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"),
                      F.filter(F.transform("t", lambda x: x["m"]), lambda x: x.isNotNull()).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv, leaf, at, role, text, loss) of every turn, from the formatted
    string and its mask alone; loss is the unescaped text under the mask (null
    outside it)."""
    pieces = formatted.select("conv", "leaf", F.posexplode(F.split("formatted", F.lit(r"\Q<|end|>\E"), -1)).alias("at", "piece"))
    pieces = pieces.where("piece <> ''")  # after the last end mark
    before = F.coalesce(F.sum(F.length("piece") + len(END)).over(
        Window.partitionBy("conv", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.locate("|>", F.col("piece"), 3) + 1  # characters up to and with the head's end
    pieces = pieces.withColumn("head", head).withColumn("start", before + F.col("head"))
    mask = formatted.select("conv", "leaf", F.explode("mask").alias("m")).select("conv", "leaf", F.col("m.start").alias("start"), "m.length")
    t = pieces.join(mask, ["conv", "leaf", "start"], "left")
    return t.select("conv", "leaf", "at",
                    unescape(F.col("piece").substr(F.lit(3), F.col("head") - 4)).alias("role"),
                    unescape(F.col("piece").substr(F.col("head") + 1, F.length("piece"))).alias("text"),
                    unescape(F.col("piece").substr(F.col("head") + 1, F.col("length").cast("int"))).alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """Per formatted conversation its turns and loss text, read back."""
    t = read_back(formatted).groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "loss"))).alias("t"))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    sized = formatted.select("conv", "leaf", F.length("formatted").cast("long").alias("formatted_chars"))
    return t.join(sized, ["conv", "leaf"]).select(
        "conv", "leaf", F.size("t").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
