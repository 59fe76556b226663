"""Chat formatting: reply trees, their root-to-leaf paths, and one formatted conversation for each chosen path.

Messages are rows (tree, id, parent, score, role, text).  Paths come from iterative self-joins that double
their reach: after round i each message knows its ancestor 2**i replies up and the score on the way, so a tree
of depth d takes log2(d) rounds and no path is stored while branches are ranked.  The chosen leaves then expand
into their paths by the same pointers, from the longest jump down; what this makes is as long as the paths are.
Only DataFrame functions are used.

Template: `<|turn|>` role `<|text|>` text `<|end|>` for every turn.  A backslash in a role or text is doubled and
control strings (those of the template, and the usual sentence and instruction marks) get a backslash after their
first character; taking each backslash away and keeping what follows it undoes both.

Very long texts are formatted whole.  Extra columns are ignored.  An empty table has no conversations.
Null roles and texts are empty.  A parent that its tree does not have makes a root.  Messages on a cycle lie on no
path from a root and are left out.  Equal scores: the longer path, then the smaller leaf id.  Repeated (tree, id)
rows are numbered by the caller (see turns_as_replies, which orders ties by role and text).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsect.llm.common import Scratch, with_clear_names

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    """No control string is left, and unescape() gives the text back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, r"<(\|[A-Za-z_]+\|>|/?s>)", r"<\\$1")
    return F.regexp_replace(out, r"\[(/?INST\])", r"[\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def choose_branches(messages: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """(tree, leaf, place, id): the messages of each tree's best root-to-leaf paths, place counted from the leaf.

    messages: tree, id, parent, score; (tree, id) is unique.  A tree's paths are ranked by the sum of their scores.
    """
    base = messages.select("tree", "id", "parent", F.col("score").cast("double").alias("score"))
    known = base.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    state = base.join(known, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("hops"))
    state = scratch.save(state, "jump")
    largest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    done, levels = state.filter("up is null"), [state.filter("up is not null")]
    for _ in range(math.ceil(math.log2(largest)) + 1 if largest > 1 else 0):
        open_ones = levels[-1]  # messages that have reached a root are only looked up from now on
        if not open_ones.head(1):
            break
        above = done.unionByName(open_ones).select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("hops").alias("further"))
        state = scratch.save(open_ones.join(above, ["tree", "up"]).select("tree", "id", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("hops") + F.col("further")).alias("hops")), "jump")
        done, levels = done.unionByName(state.filter("up is null")), [*levels, state.filter("up is not null")]
    inner = levels[0].select("tree", F.col("up").alias("id")).distinct()
    leaves = done.join(inner, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("hops"), "id")
    chosen = leaves.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top)  # limited in each task before the shuffle
    paths = chosen.select("tree", F.col("id").alias("leaf"), F.lit(0).cast("long").alias("place"), "id")
    for i in reversed(range(len(levels))):
        jumps = levels[i].select("tree", "id", "up")
        more = paths.join(jumps, ["tree", "id"]).select("tree", "leaf", (F.col("place") + (1 << i)).alias("place"), F.col("up").alias("id"))
        paths = scratch.save(paths.unionByName(more), "paths")
    return paths


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.split(p, r"<\|text\|>")[0]).alias("role"),
            unescape(F.regexp_replace(F.split(p, r"<\|text\|>")[1], r"<\|end\|>\z", "")).alias("text"),
        ),
    )


def turns_as_replies(rows: DataFrame) -> DataFrame:
    """Conversations by turn, as trees in which each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (
        with_clear_names(rows, "conv_id", "turn", "role", "text")
        .withColumn("id", F.row_number().over(order).cast("long"))
        .select(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("tree"), "conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
    )


def format_conversations(messages: DataFrame, scratch: Scratch, top: int = 1, learned: str = "assistant") -> DataFrame:
    """(tree, leaf, formatted, loss_runs): one row for each chosen path.

    loss_runs is the loss mask, run by run over the whole formatted text: n code points, learned or not, and the place
    (byte, from 0) and size in bytes, by which the text under the mask is cut out.
    """
    paths = choose_branches(messages, scratch, top)
    text = lambda c: escape(F.coalesce(F.col(c), F.lit("")))
    turns = paths.join(messages.select("tree", "id", "role", "text"), ["tree", "id"])
    turns = turns.select("tree", "leaf", "place", F.concat(F.lit(TURN), text("role"), F.lit(TEXT)).alias("head"), text("text").alias("body"), F.coalesce(F.col("role") == learned, F.lit(False)).alias("learned"))
    size = lambda c: F.octet_length(c).cast("long")
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size(F.col("head")) + size(F.col("body")) + len(END)).over(before), F.lit(0))
    run = lambda c, flag, byte: F.struct(F.length(c).cast("long").alias("n"), flag.alias("learned"), byte.alias("byte"), size(c).alias("bytes"))
    head, body, off = F.col("head"), F.col("body"), F.lit(False)
    runs = F.array(run(head, off, F.col("at")), run(body, F.col("learned"), F.col("at") + size(head)), run(F.lit(END), off, F.col("at") + size(head) + size(body)))
    placed = turns.withColumn("at", at).select("tree", "leaf", F.struct((-F.col("place")).alias("place"), F.concat(head, body, F.lit(END)).alias("said"), runs.alias("runs")).alias("turn"))
    gathered = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return gathered.select("tree", "leaf", F.array_join("turns.said", "").alias("formatted"), F.flatten("turns.runs").alias("loss_runs"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back, and what stands under their loss masks."""
    read = formatted.select("*", parse_turns(F.col("formatted")).alias("turns"), F.encode("formatted", "UTF-8").alias("raw"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    cut = lambda r: F.decode(F.substring(F.col("raw"), (r["byte"] + 1).cast("int"), r["bytes"].cast("int")), "UTF-8")
    learned = F.array_join(F.transform(F.filter("loss_runs", lambda r: r["learned"]), lambda r: unescape(cut(r))), "")
    return read.withColumn("under", learned).select(
        F.when(F.col("tree") != "none", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).selectExpr("inline(array(named_struct('conv_id', -1L, 'turn', 0L, 'role', 'user'), named_struct('conv_id', -1L, 'turn', 1L, 'role', 'assistant')))").withColumn("text", F.lit(said))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    scratch = Scratch(spark, "chat")
    messages = scratch.save(turns_as_replies(rows), "messages")
    out = scratch.save(digests(format_conversations(messages, scratch)), "digests")
    scratch.leave(out)
    return out


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\|[A-Za-z_]+\|>|/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS safe_role,
         regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\|[A-Za-z_]+\|>|/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS safe_text
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe_role) + length(safe_text) + 23)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
