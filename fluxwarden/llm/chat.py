"""Chat formatting of reply trees: paths from root to leaf, ranked by score, each chosen one formatted as a conversation.

Messages stand in trees: (tree, node, parent, role, text, score). Iterative self-joins double the reach of a table of jumps: its level k
has for each message the ancestor 2 ** k replies above, the replies between and the scores summed over them. After log2(depth) joins
each message has its depth and the score of its branch. Leaves are ranked in their tree by mean score (ties: the longer branch, then the smaller node),
the best ones are chosen, and the same tables are joined in reverse to enumerate the messages of their paths: level k adds to each
message that a path has so far the one 2 ** k above, so a path of n messages takes log2(n) joins however long it is.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and texts are escaped by a ``~`` between ``<`` and ``|`` (and one
more where there are some already), a line feed in a role as ``<|n|>``; nothing inside a text can then be read as a mark, and reading takes one ``~`` off.
A conversation is cut into parts of ``PART_TURNS`` turns, in order, so that a long one isn't held by one task; the loss mask is a list of spans of each
part, in code points: the texts (not the marks) of the roles that are learned.

Odd input: a null role or text is empty, a null score 0. A null tree is a tree of its own. Messages with a null node are left out. A parent that is null or
not there makes a root. Of several messages with one tree and node the smallest (parent, role, text) stands; in a table by turns every row is a turn, equal ones
too, with ties put in order by role and text and null turns first. Messages on or below a loop of parents have no root and are in no path. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
LINE_FEED = "<|n|>"
#: Turns of a part. Also rows of one tree that are numbered in one task: those whose turns lie within so many of each other.
PART_TURNS, SLICE_TURNS = 64, 4096
LEARNED = ("assistant",)
MESSAGE = ("tree", "node", "parent", "role", "text", "score")


def _key(c: Column) -> Column:
    """A tree's name as text in which null is a value like others."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _name(key: Column) -> Column:
    return F.when(key != "", F.substring(key, F.lit(2), F.char_length(key)))


def reply_trees(table: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None = None) -> DataFrame:
    """Messages of a table whose rows name the message that they reply to."""
    value = F.coalesce(F.nanvl(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)) if score else F.lit(0.0)
    rows = table.where(F.col(node).isNotNull()).select(
        _key(F.col(tree)).alias("tree"), F.col(node).alias("node"), F.struct(F.col(parent).alias("parent"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), value.alias("score")).alias("m")
    )
    return rows.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*")


def turn_chains(table: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of a table by turns, each replying to the turn before. Rows are numbered within slices of turns, so a conversation that holds much of the
    table is sorted by many tasks."""
    rows = table.select(_key(F.col(tree)).alias("tree"), F.col(turn).alias("_turn"), F.floor(F.col(turn) / SLICE_TURNS).alias("_slice"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    per = rows.groupBy("tree", "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("tree").orderBy(F.col("_slice").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("tree").alias("_tree"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    w = Window.partitionBy("tree", "_slice").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("_place", F.row_number().over(w)).join(per, (F.col("tree") == F.col("_tree")) & F.col("_slice").eqNullSafe(F.col("_of")))
    node = (F.col("_place") + F.col("_before")).cast("long")
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def jumps(messages: DataFrame) -> list[DataFrame]:
    """Levels of (tree, node, up, hops, total): ``up`` is the ancestor 2 ** level replies above or null, ``hops`` the replies and ``total`` the scores
    from the message up to it (without it), or to the root with it. In the last level no ``up`` is left, but for those of loops."""
    ids = messages.select(F.col("tree").alias("_tree"), F.col("node").alias("up"))
    first = messages.select("tree", "node", "parent", "score").join(ids, (F.col("tree") == F.col("_tree")) & (F.col("parent") == F.col("up")), "left")
    first = first.select("tree", "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("score").alias("total"))
    levels = [written(first, "jumps")]
    most = messages.count().bit_length()
    while len(levels) <= most and not (far := levels[-1].where("up is not null")).isEmpty():
        over = levels[-1].select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("total").alias("_total"))
        joined = far.join(over, (F.col("tree") == F.col("_tree")) & (F.col("up") == F.col("_node")))
        joined = joined.select("tree", "node", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("total") + F.col("_total")).alias("total"))
        levels.append(written(levels[-1].where("up is null").unionByName(joined), "jumps"))
    return levels


def paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, branch, score, length, depth, node): the messages of the ``best`` branches of each tree (None: of all), branch 1 the best one, depth 0 the root.
    ``messages`` is read several times."""
    levels = jumps(messages)
    rooted = levels[-1].where("up is null").select("tree", "node", "hops", "total")
    answered = levels[0].where("up is not null").select("tree", F.col("up").alias("node"))
    leaves = rooted.join(answered, ["tree", "node"], "left_anti").withColumn("score", F.col("total") / (F.col("hops") + 1))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("hops"), "node")
    leaves = leaves.withColumn("branch", F.row_number().over(order))
    if best is not None:
        leaves = leaves.where(F.col("branch") <= best)
    found = leaves.select("tree", "branch", "score", (F.col("hops") + 1).alias("length"), "node")
    for level in reversed(levels[:-1]):
        above = level.where("up is not null").select("tree", "node", "up")
        found = found.join(above, ["tree", "node"], "left").withColumn("node", F.explode(F.array_compact(F.array("node", "up")))).drop("up")
    return found.join(rooted.select("tree", "node", F.col("hops").alias("depth")), ["tree", "node"]).select("tree", "branch", "score", "length", "depth", "node")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", "<$1~|")


def unescape(text: str) -> str:
    return re.sub(r"<(~*)~\|", r"<\1|", text)


def format_paths(found: DataFrame, messages: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv, branch, score, part, n_turns, text, loss): the chosen paths as conversations in parts; conv is the tree's name as a string, loss an array of spans
    (start, stop) of the part's text in code points."""
    rows = found.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE_FEED))
    rows = rows.withColumn("_head", F.concat(F.lit(START), role, F.lit("\n"))).withColumn("_text", escape(F.col("text")))
    rows = rows.select("tree", "branch", "score", "depth", F.floor(F.col("depth") / PART_TURNS).cast("int").alias("part"), F.concat("_head", "_text", F.lit(f"{END}\n")).alias("turn"), F.col("role").isin(*learned).alias("learned"), F.char_length("_head").alias("head"), F.char_length("_text").alias("n"))
    before = Window.partitionBy("tree", "branch", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.col("head")
    rows = rows.withColumn("span", F.when(F.col("learned"), F.struct(start.alias("start"), (start + F.col("n")).alias("stop"))))
    held = rows.groupBy("tree", "branch", "part").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("depth", "turn", "span"))).alias("t"))
    spans = F.filter(F.col("t.span"), lambda s: s.isNotNull())
    return held.select(_name(F.col("tree")).alias("conv"), "branch", "score", "part", F.size("t").cast("long").alias("n_turns"), F.array_join("t.turn", "").alias("text"), spans.alias("loss"))


def format_table(messages: DataFrame, best: int | None = 1, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """The chosen paths of messages (see ``reply_trees`` and ``turn_chains``), formatted and written; what is returned is read from the files."""
    messages = written(messages, "messages")
    return written(format_paths(paths(messages, best), messages, learned), "formatted")


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted part."""
    out = []
    for turn in text.split(f"{END}\n")[:-1]:
        if not turn.startswith(START):
            raise ValueError("a turn has no start")
        role, _, said = turn[len(START) :].partition("\n")
        out.append((unescape(role.replace(LINE_FEED, "\n")), unescape(said)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """(conv, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, read back from its parts. The parts of a
    conversation pass a task in order, which holds a batch of them and the state of two digests."""

    def run(batches):
        at, state = None, None

        def result() -> pa.RecordBatch:
            turns, said, n, chars, loss = state
            rows = [{"conv": at[0], "branch": at[1], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss, "loss_sha256": said.hexdigest(), "formatted_chars": chars}]
            return pa.RecordBatch.from_pylist(rows, pa.schema([("conv", pa.string()), ("branch", pa.int32()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                conv, branch, text, loss = (batch.column(k)[i].as_py() for k in range(4))
                if (conv, branch) != at:
                    if state:
                        done.append(result())
                    at, state = (conv, branch), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, said in read_turns(text):
                    state[0].update(f"{role}\n{said}\n".encode())
                    state[2] += 1
                for span in loss:
                    said = unescape(text[span["start"] : span["stop"]])
                    state[1].update(said.encode())
                    state[4] += len(said)
                state[3] += len(text)
            yield from done
        if state:
            yield result()

    parts = formatted.repartition("conv", "branch").sortWithinPartitions("conv", "branch", "part").select("conv", "branch", "text", "loss")
    return parts.mapInArrow(run, "conv string, branch int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
