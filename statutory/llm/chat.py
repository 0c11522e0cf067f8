"""Chat formatting: reply trees to root-to-leaf conversations with a loss mask.

Messages form trees by (tree, node, parent). Iterative self-joins give every message the
one 1, 2, 4, ... places above it; by the binary digits of their distance these lead from
each leaf to all messages above it, once each. The rounds grow with the logarithm of the
depth, and the rows with the length of the paths. Of the paths of a tree the best by score
are chosen and formatted as one text each.

The template is `<s>[role]text</s>` per turn. `&`, `<`, `[` and `]` inside roles and texts
(and line breaks inside roles) are written as character references, so no control string
can come out of a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.llm.common import materialize

TURN, END = "<s>", "</s>"
#: Characters and what stands for them; the first is undone last.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def escape(text: Column) -> Column:
    for plain, reference in REFERENCES:
        text = F.replace(text, F.lit(plain), F.lit(reference))
    return text


def unescape(text: Column) -> Column:
    for plain, reference in reversed(REFERENCES):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return text


def paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path: tree, leaf, path (array of node, from the root) and score.

    messages has tree, node (unique in its tree), parent (null: a root) and score; null
    scores count as 0. A path's score is the mean of its messages'. A message whose parent
    is missing is a root. Messages in a circle have no root, so they are on no path. Other
    columns are ignored; no rows give no rows.
    """
    rows = materialize(messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    nodes = rows.select("tree", F.col("node").alias("parent"))
    up = materialize(rows.select("tree", "node", "parent").join(nodes, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")))
    leaves = rows.select("tree", "node").join(up.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti")
    jumps, n = [up], rows.count()
    while 2 ** (len(jumps) - 1) < n:  # the 1st, 2nd, 4th, ... message above, for those that have one
        last = jumps[-1]
        higher = last.select("tree", F.col("node").alias("above"), F.col("above").alias("higher"))
        after = materialize(last.join(higher, ["tree", "above"]).select("tree", "node", F.col("higher").alias("above")))
        if after.isEmpty():
            break
        jumps.append(after)
    else:  # what has a message so many places above is on or below a circle
        leaves = leaves.join(jumps[-1].select("tree", "node").distinct(), ["tree", "node"], "left_anti")
    steps = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):  # every message above a leaf once, by the binary digits of its distance
        further = steps.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up"))
        steps = materialize(steps.unionByName(further))
    scored = steps.join(rows.select("tree", "node", "score"), ["tree", "node"])
    found = scored.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("down"), "node"))).alias("steps"), F.avg("score").alias("score"))
    return found.select("tree", "leaf", F.transform("steps", lambda x: x["node"]).alias("path"), "score")


def best_paths(found: DataFrame, per_tree: int = 1) -> DataFrame:
    """The per_tree best paths of every tree, with their rank; ties go to the smaller leaf."""
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)


def format_paths(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """One text per chosen path: tree, rank, formatted and loss (spans of code points to learn from).

    The loss mask covers every assistant text, without the template around it. Null roles
    and texts are empty; steps without a message are passed over; a message that is given
    twice is two turns; no paths give no rows.
    """
    steps = chosen.select("tree", "rank", F.posexplode("path").alias("place", "node"))
    turns = steps.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    turn = F.struct(
        "place",
        F.concat(F.lit(TURN + "["), role, F.lit("]")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        (F.col("role") == "assistant").alias("learn"),
    )
    lists = turns.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:long,length:long>>)").alias("spans"))

    def add(held: Column, t: Column) -> Column:
        begin = held["at"] + F.char_length(t["head"])
        size = F.char_length(t["body"]).cast("long")
        span = F.struct(begin.alias("start"), size.alias("length"))
        return F.struct(
            (begin + size + len(END)).alias("at"),
            F.when(t["learn"], F.concat(held["spans"], F.array(span))).otherwise(held["spans"]).alias("spans"),
        )

    return lists.select("tree", "rank", formatted.alias("formatted"), F.aggregate("turns", start, add, lambda h: h["spans"]).alias("loss"))


def read_turns(formatted: str | Column) -> Column:
    """The turns of a formatted text, as an array of role and text."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    parts = F.slice(F.split(column, TURN), 2, F.greatest(F.size(F.split(column, TURN)) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        close = F.instr(part, "]")
        role = F.substring(part, F.lit(2), close - 2)
        text = F.substring(part, close + 1, F.char_length(part) - close - len(END))
        return F.struct(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees without branches.

    Every row answers the one before it by turn; rows of equal turn follow each other by
    role and text, so repeated rows are repeated turns, and null turns come first.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("tree"),  # no id is the tree "null"
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.lit(None).cast("double").alias("score"),
        "role",
        "text",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The best path of every conversation as one text: conv_id, formatted, loss.

    Null texts and roles are empty; rows with a null conv_id are one conversation of their
    own; other columns are ignored; no rows give no rows.
    """
    messages = materialize(linear_trees(conversations))
    done = format_paths(best_paths(paths(messages)), messages)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return done.select(F.expr(f"if(tree = 'null', null, try_cast(substring(tree, 2) as {kind}))").alias("conv_id"), "formatted", "loss")


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted texts."""
    done = format_conversations(conversations)
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    read = done.select("conv_id", "formatted", read_turns("formatted").alias("turns"), learnt.alias("learnt"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


CONTROL_CONVERSATION = ((0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]"))


def with_control_conversation(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1 (of their type of id), whose texts hold control strings."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    extra = rows.sparkSession.createDataFrame([(-1, *turn) for turn in CONTROL_CONVERSATION], "conv_id long, turn long, role string, text string")
    kind = rows.schema["conv_id"].dataType
    return rows.unionByName(extra.withColumn("conv_id", F.col("conv_id").cast(kind)))


CHAT_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;') AS body FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + length(role) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
