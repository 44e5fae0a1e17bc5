"""Reply trees to chat training text, in DataFrame operations only.

Messages name the message they answer. A path runs from a root to a leaf; each path that is
kept becomes one conversation. The paths are enumerated by iterative self-joins with doubling
reach: a table of jumps 1, 2, 4, ... levels up is made by joining the last one to itself, and
only messages that are that deep stay in it, so a tree of depth d takes log2(d) rounds. The
scores between a message and its root add up along the jumps and rank the branches. From each
chosen leaf the jumps, largest first, then reach every message above it exactly once. Texts
are joined to the paths once, at the end.

The template marks a turn as ``<|start|>role<|text|>text<|end|>``. Control strings inside roles
and texts, of this template and of other common ones, lose their first character to an escape,
and the escape sign itself is escaped, so ``unescape`` gives back any text exactly.

Defined results: null role and null text are empty; a message whose parent is null or not in
its tree is a root; messages on a cycle or below one have no root and form no path; of rows
with equal tree and id one is kept; rows without an id are left out; null trees are one tree;
null scores count as 0; branches of equal score are ranked by leaf id; an empty table gives no
rows; other columns are not looked at. A path is one row, so its text must fit into one (2 GB).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallycast.llm.common import keep

# The control strings of the template, and what opens those of other templates.
START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
ESCAPES = {"<": "&lt;", "[": "&lsqb;"}
ROLE_WITH_LOSS = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for string in CONTROL:
        text = F.replace(text, F.lit(string), F.lit(ESCAPES[string[0]] + string[1:]))
    return text


def unescape(text: Column) -> Column:
    for sign, escaped in ESCAPES.items():
        text = F.replace(text, F.lit(escaped), F.lit(sign))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _above(rows: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """``rows`` joined to the row of ``others`` whose id is in column ``on``; null trees match each other."""
    others = others.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("sum").alias("_sum"))
    return rows.join(others, rows["tree"].eqNullSafe(others["_tree"]) & (rows[on] == others["_id"]))


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def chosen_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, id, above): every message of each chosen path, ``above`` levels up from its leaf.

    ``messages`` has tree, id, parent and score. ``best`` keeps so many paths of each tree, by
    the sum of their scores; None keeps all.
    """
    named = messages.filter("id is not null").groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("m"))
    named = keep(named.select("tree", "id", "m.parent", F.coalesce(F.col("m.score").cast("double"), F.lit(0.0)).alias("sum")))
    there = named.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.lit(True).alias("_there"))
    started = keep(
        named.join(there, named["tree"].eqNullSafe(there["_tree"]) & (named["parent"] == there["_id"]), "left")
        .select("tree", "id", F.when(F.col("_there"), F.col("parent")).alias("up"), "sum"))
    answered = started.select(F.col("tree").alias("_tree"), F.col("up").alias("_id")).filter("_id is not null").distinct()
    is_answered = started["tree"].eqNullSafe(answered["_tree"]) & (started["id"] == answered["_id"])
    leaves = started.join(answered, is_answered, "left_anti").select("tree", "id")

    # after round k a message knows the one 2^k levels up, or none, and the scores from itself to below that one
    rooted, moving, jumps = [started.filter("up is null")], started.filter("up is not null"), []
    reach, total = 1, named.count()
    while reach <= total and not moving.isEmpty():
        jumps.append(moving)
        longer = keep(_above(moving, _all([*rooted, moving]), "up").select(
            "tree", "id", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum")))
        rooted.append(longer.filter("up is null"))
        moving = longer.filter("up is not null")
        reach *= 2

    scored = _above(leaves, _all(rooted), "id").select("tree", "id", "_sum")  # on a cycle or below: never rooted
    if best is not None:
        ranked = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("_sum"), "id"))
        scored = scored.withColumn("_rank", ranked).filter(F.col("_rank") <= best)
    paths = [keep(scored.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("above")))]
    for level in reversed(range(len(jumps))):
        further = _above(_all(paths), jumps[level], "id")
        paths.append(keep(further.select("tree", "leaf", F.col("_up").alias("id"), (F.col("above") + (1 << level)).alias("above"))))
    return _all(paths)


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, formatted, spans): one conversation per path.

    ``spans`` has for each turn its start and length in ``formatted``, in code points, and
    those of its text under the loss mask (length 0 for turns without loss).
    """
    texts = messages.filter("id is not null").groupBy("tree", "id").agg(F.min(F.struct(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    texts = texts.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "m.role", escape(F.col("m.text")).alias("body"))
    turns = paths.join(texts, paths["tree"].eqNullSafe(texts["_tree"]) & (paths["id"] == texts["_id"]))
    opening = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    in_order = Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))
    before = F.sum("length").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    turns = (
        turns.withColumn("turn", F.concat(opening, "body", F.lit(END)))
        .withColumns({"length": F.char_length("turn").cast("long"), "opening": F.char_length(opening).cast("long"),
                      "loss": F.when(F.col("role") == ROLE_WITH_LOSS, F.char_length("body")).otherwise(F.lit(0)).cast("long")})
        .withColumn("start", F.coalesce(before, F.lit(0)))
    )
    entry = F.struct((-F.col("above")).alias("place"), "turn", "start", "length",
                     (F.col("start") + F.col("opening")).alias("loss_start"), F.col("loss").alias("loss_length"))
    return turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(entry)).alias("turns")).select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"),
                                                t["loss_start"].alias("loss_start"), t["loss_length"].alias("loss_length"))).alias("spans"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``learned``, the text under the loss mask, read from ``formatted``."""
    pieces = F.split("formatted", END.replace("|", "\\|"))
    cut = conversations.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))  # behind the last end there is nothing
    body = lambda piece: F.split(F.substring(piece, len(START) + 1, 2**31 - 1), TEXT.replace("|", "\\|"))
    turn = lambda piece: F.struct(unescape(body(piece)[0]).alias("role"), unescape(body(piece)[1]).alias("text"))
    learned = F.zip_with("_pieces", "spans", lambda piece, span: unescape(F.substring(
        piece, (span["loss_start"] - span["start"] + 1).cast("int"), span["loss_length"].cast("int"))))
    return cut.withColumns({"turns": F.transform("_pieces", turn), "learned": F.array_join(learned, "")}).drop("_pieces")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch, each turn answering the one before.

    Turns of equal number follow by role and text; repeated rows are turns of their own.
    """
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.withColumn("id", F.row_number().over(in_order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"),
                           F.lit(1.0).alias("score"), "role", "text")


def format_conversations(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The chosen paths of ``messages`` (tree, id, parent, score, role, text) as conversations."""
    return format_paths(chosen_paths(messages.select("tree", "id", "parent", "score"), best), messages)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and checksums of what ``read_back`` finds."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
