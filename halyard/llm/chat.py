"""Chat formatting of reply trees.

Messages are nodes (conversation, node, parent).  All steps are joins of the
narrow link table with itself: in each round every message's pointer jumps twice
as far towards the root, adding up depths and scores on the way, so a tree of
depth d takes log d rounds.  Each leaf is one root-to-leaf path; branches are
ranked by their mean score, then depth, then node.  The chosen leaves' paths are
marked by walking the saved jumps from the longest to the shortest, again by
joins, and only the messages on them meet their texts.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line break, per turn.  In roles
and texts, a backslash is doubled and ``<|`` becomes ``<\\|``, which is undone by
the reverse replacements in reverse order.  The loss mask holds (start, length)
in code points of each assistant text, as escaped.

Defined cases: a null text is empty, a null role is the empty role; a null
conversation id is a conversation; rows with equal turns follow one another by
role and text; messages whose parent doesn't exist are roots; cycles, which no
root reaches, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import dropped, new_path, stored

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def threads(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as reply trees of one branch: conv, node, parent, score, role, text."""
    order = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), role_col, text_col)
    rows = conversations.select(F.col(conv_col).alias("conv"), F.row_number().over(order).cast("long").alias("node"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _at(*names: str) -> Column:
    """Equality with the renamed columns c and n of the other side."""
    conv, node = names
    return F.col(conv).eqNullSafe(F.col("c")) & (F.col(node) == F.col("n"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv, branch (rank from 1), depth (from 1) and node, for the messages on each conversation's best paths."""
    links = stored(messages.select("conv", "node", "parent", "score"), "chat-links")
    known = links.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    tree = links.join(known, _at("conv", "parent"), "left").select("conv", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").cast("double").alias("total"))
    now = stored(tree, "chat-jumps")
    saved = []
    size = now.count()
    # a path in a tree of n nodes has at most n steps: more rounds would only follow cycles
    while now.where("up is not null").limit(1).count() and 1 << len(saved) <= size:
        saved.append(now)
        above = now.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("total").alias("sum"))
        # only messages that haven't reached their root take part
        joined = now.where("up is not null").join(above, _at("conv", "up"))
        onward = joined.select("conv", "node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("sum")).alias("total"))
        now = stored(now.where("up is null").union(onward), "chat-jumps")
    inner = links.select(F.col("conv").alias("c"), F.col("parent").alias("n")).where("n is not null").distinct()
    leaves = now.where("up is null").join(inner, _at("conv", "node"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("steps")), F.desc("steps"), "node"))
    marked = stored(leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("conv", "branch", "node"), "chat-marked")
    for jump in reversed(saved):
        up = jump.where("up is not null").select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        onward = marked.join(up, _at("conv", "node")).select("conv", "branch", F.col("up").alias("node"))
        more = stored(marked.union(onward).distinct(), "chat-marked")
        dropped(marked)
        marked = more
    depth = now.select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("steps").alias("depth"))
    return marked.join(depth, _at("conv", "node")).select("conv", "branch", "depth", "node")


def format_chats(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv, branch, n_turns, formatted, loss (array of start, length in code points)."""
    path = best_paths(messages, branches).toDF("c", "branch", "depth", "n")
    turns = messages.join(path, _at("conv", "node")).select("conv", "branch", "depth", "role", escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("conv", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", (before + F.length("head")).cast("long"))
    rows = F.array_sort(F.collect_list(F.struct("depth", "role", "head", "body", "start")))
    chats = turns.groupBy("conv", "branch").agg(rows.alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["role"] == loss_role), lambda x: F.struct(x["start"].alias("start"), F.length(x["body"]).cast("long").alias("length")))
    return chats.select("conv", "branch", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), loss.alias("loss"))


def parsed_turns(formatted: Column) -> Column:
    """The formatted text's turns as (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, "<\\|turn\\|>"), 2, 1_000_000_000)
    body = lambda x: F.substring_index(F.substring_index(x, TEXT, -1), END, 1)
    return F.transform(pieces, lambda x: F.struct(unescaped(F.substring_index(x, TEXT, 1)).alias("role"), unescaped(body(x)).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int")))), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted chats: n_turns, digests of turns and loss, lengths."""
    turns, loss = parsed_turns(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss"))
    rows = chats.select("conv", "branch", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(F.col("conv").alias("conv_id"), "branch", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")


def through_format(messages: DataFrame, path: str | None = None, branches: int = 1) -> DataFrame:
    """Formats, writes, reads back and digests."""
    spark = messages.sparkSession
    path = path or new_path(spark, "chats")
    format_chats(messages, branches).write.option("compression", "zstd").parquet(path)
    return chat_digests(spark.read.parquet(path))
