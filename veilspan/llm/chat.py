"""Chat formatting from reply trees, with DataFrame functions only.

Turns form trees by parent. Root-to-leaf paths are enumerated by iterative self-joins that double their
reach (pointer jumping): after k rounds every turn knows its 2^k-th ancestor, its distance and the sum of
scores up to there, so a chain of L turns needs log2(L) joins of L rows each. Leaves rank by the score of
their path; the turns of each chosen leaf are found by walking the same jumps back, and are formatted as
one conversation.

Template (fixed values): a turn of the role ``assistant`` is ``<s>role\\ntext</s>``, any other turn is
``[INST]role\\ntext[/INST]``. Inside roles and texts, a backslash is put after the bracket of every
control string (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, with any number of backslashes after the
bracket already), and taken off when read back. Line feeds in roles become ``\\n`` the same way.

Defined cases: null text and null role count as empty; a parent that doesn't exist makes a root; of ties
the smaller node_id wins; cycles raise an error; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.common import Scratch

_OPENED = r"([<\[])(\\*)(?=/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(?=/?(?:s>|INST\]))"


def escape(col):
    return F.regexp_replace(col, _OPENED, r"$1$2\\")


def unescape(col):
    return F.regexp_replace(col, _ESCAPED, "$1$2")


def _role_out(col):
    """A role on one line: backslashes doubled, line feeds as \\n, then escaped as text."""
    return escape(F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(col):
    parts = F.split(unescape(col), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def chains(turns: DataFrame) -> DataFrame:
    """Nodes of plain conversations: each turn answers the one before it, by turn, role and text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    rows = rows.withColumn("node_id", at)
    return rows.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, scratch: Scratch, branches: int = 1, max_rounds: int = 40) -> DataFrame:
    """conv_id, leaf_id, rank, node_id, depth of the turns on the chosen root-to-leaf paths."""
    slim = nodes.select("conv_id", "node_id", "parent_id", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    known = slim.select("conv_id", F.col("node_id").alias("parent_id"))
    slim = slim.join(known.withColumn("_there", F.lit(True)).dropDuplicates(), ["conv_id", "parent_id"], "left")
    slim = slim.select("conv_id", "node_id", F.when(F.col("_there"), F.col("parent_id")).alias("up"), "score")
    # jump: up is the ancestor at reach 2^k; steps and total cover the turns from node_id to before up.
    jump = scratch.save(slim.select("conv_id", "node_id", "up", F.lit(1).cast("bigint").alias("steps"), F.col("score").alias("total")), "jump0")
    jumps = [jump]
    for k in range(1, max_rounds + 1):
        if jump.where("up IS NOT NULL").isEmpty():
            break
        above = jump.select("conv_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        moved = jump.where("up IS NOT NULL").join(above, ["conv_id", "up"])
        moved = moved.select("conv_id", "node_id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("total") + F.col("_total")).alias("total"))
        jump = scratch.save(moved.unionByName(jump.where("up IS NULL")), f"jump{k}")
        jumps.append(jump)
    else:
        raise ValueError("replies form a cycle, or are deeper than 2^max_rounds")
    leaves = jump.join(jumps[0].where("up IS NOT NULL").select("conv_id", F.col("up").alias("node_id")).distinct(), ["conv_id", "node_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "node_id"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    walk = scratch.save(chosen.select("conv_id", F.col("node_id").alias("leaf_id"), "rank", "node_id"), "walk0")
    for k in range(len(jumps) - 1, -1, -1):
        up = jumps[k].where("up IS NOT NULL").select("conv_id", "node_id", "up")
        reached = walk.join(up, ["conv_id", "node_id"]).select("conv_id", "leaf_id", "rank", F.col("up").alias("node_id"))
        walk = scratch.save(walk.unionByName(reached), f"walk{k + 1}-{k}")
    depth = jump.select("conv_id", "node_id", F.col("steps").alias("depth"))
    return walk.join(depth, ["conv_id", "node_id"])


def format_chats(nodes: DataFrame, branches: int = 1, train_role: str = "assistant") -> DataFrame:
    """conv_id, rank, formatted: one string for each chosen path.

    nodes: conv_id, node_id (one of its own in the conversation), parent_id, role, text, score.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    nodes = scratch.save(nodes.select("conv_id", "node_id", "parent_id", "role", "text", "score"), "nodes")
    chosen = paths(nodes, scratch, branches)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.concat(_role_out(role), F.lit("\n"), escape(text))
    turn = F.when(role == train_role, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
    rows = chosen.join(nodes.select("conv_id", "node_id", turn.alias("piece")), ["conv_id", "node_id"])
    made = rows.groupBy("conv_id", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "piece"))).alias("pieces"))
    return made.select("conv_id", "rank", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"))


def parse_chats(formatted: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Reads formatted conversations back: adds turns (array of role, text, trained)."""
    pieces = F.filter(F.split("formatted", r"</s>|\[/INST\]", -1), lambda x: x != "")

    def turn(piece):
        trained = piece.startswith("<s>")
        body = F.when(trained, F.substr(piece, F.lit(4))).otherwise(F.substr(piece, F.lit(7)))
        at = F.locate("\n", body)
        role = F.call_function("left", body, at - 1)
        return F.struct(_role_in(role).alias("role"), unescape(F.substr(body, at + 1)).alias("text"), trained.alias("trained"))

    return formatted.withColumn("turns", F.transform(pieces, turn))


def digests(parsed: DataFrame) -> DataFrame:
    """Adds n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of parsed conversations."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
