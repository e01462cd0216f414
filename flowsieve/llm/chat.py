"""Reply trees to chat conversations, with DataFrame functions alone.

Messages form trees by a parent column. Iterative self-joins double the distance a message can look up
(1, 2, 4, ... ancestors) and add up the scores on the way, so paths of any length take a logarithmic number of joins and a row for
each message. That gives each leaf its root and its path's score; the branches of a root are ranked by it. Only then the
messages of the chosen paths are enumerated, by the same joins, and only at last the texts join them to be formatted as one
conversation a path.

Template: every turn is ``<|turn|>`` role, newline, text, ``<|end|>``, newline. Control strings inside a
role or text (those of this template and the usual ones of others: ``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) get one more backslash after their first character, which is undone by taking one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, files_for

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
CONTROL = r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """One more backslash into every control string; no control string is left."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, r"$1$2$3")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    # the escapes of a backslash, then between them those of a newline; no character is set apart for this
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(turns: Column) -> Column:
    """The formatted conversation of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, chars) in the formatted conversation, in code points from 0, of each text that carries the loss."""
    sized = F.transform(turns, lambda t: F.struct((F.char_length(_role(t["role"])) + len(OPEN) + 1).alias("head"), F.char_length(escape(t["text"])).alias("chars"), (t["role"] == role).alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))
    step = lambda a, t: F.struct(
        (a["at"] + t["head"] + t["chars"] + len(CLOSE)).alias("at"),
        F.when(t["loss"], F.array_append(a["spans"], F.struct((a["at"] + t["head"]).alias("start"), t["chars"].alias("chars")))).otherwise(a["spans"]).alias("spans"),
    )
    return F.aggregate(sized, start, step, lambda a: a["spans"])


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation was made of."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p, i: i > 0)
    body = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.char_length(p) - len(CLOSE)))
    cut = F.transform(body, lambda p: F.struct(p.alias("p"), F.instr(p, "\n").alias("n")))
    return F.transform(cut, lambda x: F.struct(_unrole(F.substring(x["p"], F.lit(1), x["n"] - 1)).alias("role"), unescape(F.substring(x["p"], x["n"] + 1, F.char_length(x["p"]))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["chars"]))), "")


def climb(nodes: DataFrame, space: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """Of ``nodes`` (id, parent, score): (id, root, score, n) with the sum and number of the scores from the message to its root,
    and tables (id, anc) of the ancestors 1, 2, 4, ... up.

    A parent that is null or not among the ids makes a root. Messages that reach no root (cycles, and what hangs on them) are left out.
    The loop ends when no message has an ancestor that far up: log2 of the deepest path plus one rounds."""
    known = nodes.select(F.col("id").alias("anc"))
    files = files_for(total := nodes.count(), 1 << 15)
    start = nodes.join(known, nodes["parent"] == known["anc"], "left").select("id", "anc", F.col("id").alias("root"), "score", F.lit(1).cast("long").alias("n"))
    reach, steps, done = space.write(start, "reach0", files), [], 1
    while done <= total:
        ways = reach.filter("anc is not null").select("id", "anc")
        if ways.isEmpty():
            break
        steps.append(ways)
        above = reach.select(F.col("id").alias("__id"), F.col("anc").alias("__anc"), F.col("root").alias("__root"), F.col("score").alias("__score"), F.col("n").alias("__n"))
        higher = reach.filter("anc is not null").join(above, F.col("anc") == F.col("__id")).select("id", F.col("__anc").alias("anc"), F.col("__root").alias("root"), (F.col("score") + F.col("__score")).alias("score"), (F.col("n") + F.col("__n")).alias("n"))
        reach = space.write(reach.filter("anc is null").unionByName(higher), f"reach{done}", files)
        done *= 2
    return reach.filter("anc is null").drop("anc"), steps


def root_paths(leaves: DataFrame, steps: list[DataFrame], space: Workspace) -> DataFrame:
    """``leaves`` (leaf, ...) once for each message between the leaf and its root: node, and ``up``, its distance to the leaf."""
    paths = leaves.withColumns({"node": F.col("leaf"), "up": F.lit(0).cast("long")})
    for k, ways in enumerate(steps):
        further = paths.join(ways, paths["node"] == ways["id"]).withColumns({"node": F.col("anc"), "up": F.col("up") + (1 << k)}).select(*paths.columns)
        paths = space.write(paths.unionByName(further), f"paths{k}")
    return paths


def format_trees(messages: DataFrame, top: int | None = None, loss_role: str = "assistant", id: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """One row per chosen path: root, leaf, rank, path_score, n_turns, formatted, loss_spans.

    Rows with a null id are ignored. Of rows with one id the one of the lowest (parent, score, hash of role and text) counts, once. Null roles and
    texts are empty; a null score is 0, as are all without ``score``. Messages on a cycle or below one are on no path.
    Paths of a root are ranked by the mean score of their messages, highest first, then by leaf id; ``top`` keeps the best so
    many (None: all). Other columns are not read. An empty table gives an empty result."""
    space = Workspace(messages.sparkSession, "chat")
    body = messages.filter(F.col(id).isNotNull()).select(
        F.col(id).alias("id"), F.col(parent).alias("parent"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.coalesce(F.col(score), F.lit(0)) if score else F.lit(0)).cast("double").alias("score"),
    ).withColumn("said", F.xxhash64("role", "text"))
    nodes = body.groupBy("id").agg(F.min(F.struct("parent", "score", "said")).alias("m")).select("id", "m.*")
    nodes = space.write(nodes, "nodes")
    reached, steps = climb(nodes, space)
    replied = nodes.select(F.col("parent").alias("id")).filter("id is not null")
    leaves = reached.join(replied, "id", "left_anti").select("root", F.col("id").alias("leaf"), (F.col("score") / F.col("n")).alias("path_score"))
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("path_score"), "leaf")))
    keys = ["root", "leaf", "rank", "path_score"]
    chosen = (ranked if top is None else ranked.filter(F.col("rank") <= top)).select(*keys)
    paths = root_paths(chosen, steps, space).join(nodes.select(F.col("id").alias("node"), "said"), "node")
    said = body.select(F.col("id").alias("node"), "said", "role", "text").dropDuplicates(["node", "said"])
    lines = paths.join(said, ["node", "said"])
    turns = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    grouped = lines.groupBy(*keys).agg(turns.alias("turns"))
    return grouped.select(*keys, F.size("turns").cast("long").alias("n_turns"), format_turns(F.col("turns")).alias("formatted"), loss_spans(F.col("turns"), loss_role).alias("loss_spans"))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages that each reply to the one before: id, parent, root and the texts.

    Rows go by turn (null first), then role and text, so repeated turns have an order as well, and repeated rows are messages each. A null
    conv_id is a conversation. Other columns are not read. An empty table gives an empty result."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    numbered = conversations.select("conv_id", "role", "text", place.alias("n"))
    name = lambda n: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), n.cast("string"))
    return numbered.select("conv_id", "role", "text", name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"))
