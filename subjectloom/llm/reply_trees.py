"""Chat formatting of reply trees.

Messages form trees (``node``, ``parent``).  Iterative self-joins walk every node's
pointer to its root, doubling the stride each round, so a path of n messages takes
log2(n) rounds, and summing scores on the way.  Leaves are ranked within their tree
by the mean score of their path, the ``best`` first ones are chosen, and a second
round of doubling joins lists each chosen path's messages; each path becomes one
conversation.

The template marks turns with control strings and escapes every control string
inside a text: ESCAPE and a letter stand for it, and ESCAPE itself is escaped first,
so unescaping is exact.  The loss mask is a list of code-point ranges of the formatted
string that cover the assistant texts and nothing else.

All columns are built in; the joins carry ids and scores, never texts.  A group is
collected only where it is one output row (the turns of one conversation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import is_empty, spread_join, stage

# Control strings of common chat templates; each is written as
# ESCAPE and the letter at its place.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "<s>", "<unk>", "<pad>")
ESCAPE = "␛"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
START, END = "<|im_start|>", "<|im_end|>"
CLOSE = END + "\n"


def escape(text: Column) -> Column:
    """The text with ESCAPE and all control strings escaped."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for letter, control in zip(LETTERS, CONTROLS, strict=False):
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + letter))
    return out


def escape_role(role: Column) -> Column:
    """As ``escape``; a role's line breaks are escaped as well, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "z"))


def unescape(text: Column) -> Column:
    """The inverse of both: every ESCAPE opens a code, and ESCAPE's own comes last."""
    out = F.replace(text, F.lit(ESCAPE + "z"), F.lit("\n"))
    for letter, control in zip(LETTERS, CONTROLS, strict=False):
        out = F.replace(out, F.lit(ESCAPE + letter), F.lit(control))
    return F.replace(out, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def root_paths(nodes: DataFrame, rounds: int = 40) -> tuple[DataFrame, list[DataFrame]]:
    """``node, root, depth, total`` of each node, and the staged pointer tables:
    table r has ``node, up`` with up the ancestor 2**r steps above.

    A node is written again only until its root is known.  A parent that is no node is
    treated as none (its child is a root); a node in a cycle has no root and is an
    error after ``rounds`` doublings.
    """

    def children(rows: DataFrame, to: str) -> DataFrame:
        return rows.where(F.col(to).isNotNull()).groupBy(to).agg(F.count("*").alias("n_rows"))

    # A message may have a large share of all replies, and be the ancestor of as many: both
    # joins know how many rows ask for a key, and deal those of the hot ones.
    known = children(nodes, "parent").join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi").withColumn("known", F.lit(True))
    state = spread_join(nodes.select("node", "parent", "score"), known, "parent", ["node"], "left")
    state = state.select("node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    state = stage(state.withColumn("root", F.when(F.col("up").isNull(), F.col("node"))), "up0")
    tables, done = [], None
    for r in range(rounds + 1):
        ended, going = state.where("up is null"), state.where("up is not null")
        done = ended if done is None else done.union(ended)
        if is_empty(going):
            return done.select("node", "root", "depth", "total"), tables
        tables.append(going.select("node", "up"))
        above = done.union(going).select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"), F.col("root").alias("root2"))
        # An ancestor stands in exactly one of the tables: a node that has ended is in none of the later ones.
        above = above.join(children(going, "up"), "up")
        state = stage(spread_join(going.select("node", "up", "total", "depth"), above, "up", ["node"]).select("node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("root2").alias("root")), f"up{r + 1}")
    raise ValueError(f"a reply path does not end within 2**{rounds} messages: the parents have a cycle")


def chosen_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """``path, root, rank, node, position`` of the ``best`` leaves of every tree: the path
    is named by its leaf, positions count from the root.  Leaves are ranked by mean
    score (higher first), then depth (longer first), then leaf id."""
    paths, tables = root_paths(nodes)
    inner = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = paths.join(inner, "node", "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    chosen = stage(leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best), "leaves")
    # Doubling: after round r all ancestors fewer than 2**r steps above the leaf are listed.
    listed = chosen.select(F.col("node").alias("path"), "node", F.lit(0).cast("long").alias("steps"))
    for r, table in enumerate(tables):
        more = listed.join(table, "node").select("path", F.col("up").alias("node"), (F.col("steps") + (1 << r)).alias("steps"))
        listed = stage(listed.union(more), f"listed{r}")
    tops = chosen.select(F.col("node").alias("path"), "root", "depth", "rank")
    return listed.join(tops, "path").select("path", "root", "rank", "node", (F.col("depth") - F.col("steps") - 1).alias("position"))


def format_turns(turns: Column) -> tuple[Column, Column]:
    """The formatted string and the loss ranges of an array of (position, role, text)."""
    pieces = F.transform(turns, lambda x: F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(CLOSE)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("mask"))

    def step(acc, x):
        s = acc["at"] + F.length(escape_role(x["role"])) + len(START) + 1
        e = s + F.length(escape(x["text"]))
        mask = F.when(x["role"] == "assistant", F.concat(acc["mask"], F.array(F.struct(s.alias("s"), e.alias("e"))))).otherwise(acc["mask"])
        return F.struct((e + len(CLOSE)).alias("at"), mask.alias("mask"))

    return F.array_join(pieces, ""), F.aggregate(turns, start, step, lambda acc: acc["mask"])


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string: no control string is left inside."""
    pieces = F.array_remove(F.split(formatted, r"<\|im_end\|>\n"), "")
    body = lambda x: F.substring(x, F.lit(len(START) + 1), F.length(x))
    cut = lambda x: F.instr(x, "\n")
    return F.transform(F.transform(pieces, body), lambda x: F.struct(unescape(F.substring(x, F.lit(1), cut(x) - 1)).alias("role"), unescape(F.substring(x, cut(x) + 1, F.length(x))).alias("text")))


def format_conversations(messages: DataFrame, *, best: int = 1) -> DataFrame:
    """``tree, path, rank, formatted, mask`` of each chosen path of ``messages(node,
    parent, tree, role, text, score)``; ``mask``: ranges (s, e) of ``formatted``.

    Defined results: null role or text is empty, null score 0; ``node`` must be
    unique and not null; an empty table gives an empty result; equal trees give
    equal conversations of their own.
    """
    nodes = messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    paths = chosen_paths(nodes, best)
    said = messages.select("node", "tree", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths.join(said, "node").groupBy("path", "rank").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))
    formatted, mask = format_turns(F.col("turns"))
    return rows.select("tree", "path", "rank", formatted.alias("formatted"), mask.alias("mask"))


def chain(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each row answers the
    row before it, by turn; rows with one turn stand in the order of role and text."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order))
    node = lambda i: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), i.cast("string"))
    return rows.select(node(F.col("i")).alias("node"), F.when(F.col("i") > 1, node(F.col("i") - 1)).alias("parent"), F.col("conv_id").alias("tree"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all
    from the formatted string and its mask."""
    rows = formatted.select("tree", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform("mask", lambda m: unescape(F.substring("formatted", m["s"] + 1, m["e"] - m["s"]))), "").alias("loss"))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op8_reply_trees(spark, sf_dir: str) -> DataFrame:
    """The whole of ``conversations``, and conversation -1 (two rows of control strings)."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    # Staged: the texts pass through the ordering of turns once, not once for each reader.
    return read_back(format_conversations(stage(chain(rows.union(extra)), "messages")))


def oracle() -> str:
    escaped = "replace({0}, chr(9243), chr(9243) || '0')"
    for letter, control in zip(LETTERS, CONTROLS, strict=False):
        escaped = f"replace({escaped}, '{control}', chr(9243) || '{letter}')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
      coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
      sum(length({escaped.format('role')}) + length({escaped.format('text')}) + {len(START) + 1 + len(CLOSE)})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
