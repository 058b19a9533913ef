"""Chat formatting of reply trees.

A conversation is a tree of messages (node, parent). Root-to-leaf paths are
enumerated by iterative self-joins that double their reach: after round k a leaf
knows its ancestors up to distance 2**k, so depth d takes log2(d) joins, and rows
hold ids only. Branches are ranked by the sum of their messages' scores, and each
chosen path is formatted as one conversation. All of that is DataFrame operations;
reading back parses each formatted string in its task.

Template: every turn is ``<|im_start|>`` role newline text ``<|im_end|>`` newline.
Control strings in a role or text are escaped: a backslash is doubled, and a
backslash goes between the first and the second character of every string of
``CONTROL``, so none is left and removing one backslash of each escape gives the
text back. The loss mask is the spans (code points, end exclusive) of the
assistant's texts in the formatted string.

Cases: a null text or role is empty; a message whose parent is null or missing is
a root; messages whose chain never ends (a cycle) are on no path; equal scores go
to the smaller leaf; rows of one conversation with equal turns come by role, then
text; null conversation ids form one conversation, null turns come first; other
columns are ignored; no rows give no conversations.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playstat.llm.storage import materialise, table

# fixed values: control strings of common chat templates (first character, rest)
CONTROL = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>",
           "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|startoftext|>")
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"

_SPECIAL = "|".join(sorted((c[1:].replace("|", "\\|").replace("]", "\\]") for c in CONTROL), key=len, reverse=True))
_CONTROL_RE = rf"(<|\[)({_SPECIAL})"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL_RE, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _chars(text: Column) -> Column:
    return F.length(text).cast("long")


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, branch, node, height) of the ``branches`` best root-to-leaf paths
    of each conversation; height counts from the leaf. ``nodes``: conv_id, node, parent, score."""
    own = nodes.select("conv_id", "node", F.col("parent").alias("up"), "score")
    known = own.select(F.col("conv_id").alias("c"), F.col("node").alias("at")).distinct()
    linked = own.join(known, _same("conv_id", "c") & (F.col("up") == F.col("at")), "left") \
        .select("conv_id", "node", F.col("at").alias("up"), "score")
    linked = materialise(linked, "chat-links")
    jump = linked.where("up is not null").select(F.col("conv_id").alias("c"), F.col("node").alias("at"), "up")
    inner = jump.select("c", F.col("up").alias("at")).distinct()
    leaves = linked.join(inner, _same("conv_id", "c") & (F.col("node") == F.col("at")), "left_anti")
    reach = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("height"))
    most = linked.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    step = 1
    while step < most:
        further = reach.join(jump, _same("conv_id", "c") & (F.col("node") == F.col("at"))) \
            .select("conv_id", "leaf", F.col("up").alias("node"), (F.col("height") + step).alias("height"))
        # ancestors nearer than ``step`` are known, so each row is new
        reach = materialise(reach.unionByName(further), "chat-reach")
        step *= 2
        if step < most:
            next_ = jump.select(F.col("c").alias("c2"), F.col("at").alias("mid"), F.col("up").alias("far"))
            jump = materialise(jump.join(next_, _same("c", "c2") & (F.col("up") == F.col("mid")))
                               .select("c", "at", F.col("far").alias("up")), "chat-jump")
            if jump.isEmpty():
                break
    at = linked.select(F.col("conv_id").alias("c"), F.col("node").alias("at"), "up", "score")
    whole = reach.join(at, _same("conv_id", "c") & (F.col("node") == F.col("at"))) \
        .groupBy("conv_id", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"),
                                        F.bool_or(F.col("up").isNull()).alias("rooted"))
    best = Window.partitionBy("conv_id").orderBy(F.desc("total"), "leaf")
    chosen = whole.where("rooted").withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches) \
        .select(F.col("conv_id").alias("c"), F.col("leaf").alias("l"), "branch")
    return reach.join(chosen, _same("conv_id", "c") & (F.col("leaf") == F.col("l"))) \
        .select("conv_id", "leaf", "branch", "node", "height")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def format_paths(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per path: conv_id, leaf, branch, formatted, loss (array of start, end).

    ``nodes``: conv_id, node, role, text."""
    p = chosen.select(F.col("conv_id").alias("c"), "leaf", "branch", F.col("node").alias("at"), "height")
    turns = p.join(nodes, _same("conv_id", "c") & (F.col("node") == F.col("at")))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), F.regexp_replace(escape(role), "\n", "\\\\\n"), F.lit("\n"))
    close = F.lit(END + "\n")
    written = turns.select("conv_id", "leaf", "branch", "height", head.alias("head"), escape(text).alias("body"),
                           (role == LOSS_ROLE).alias("learned"))
    until = Window.partitionBy("conv_id", "leaf", "branch").orderBy(F.desc("height"), "head", "body")
    end = F.sum(_chars(F.col("head")) + _chars(F.col("body")) + _chars(close)) \
        .over(until.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - _chars(close)
    placed = written.withColumn("end", end)
    listed = placed.groupBy("conv_id", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct(
        "end", "learned", (F.col("end") - _chars(F.col("body"))).alias("start"),
        F.concat("head", "body", close).alias("turn")))).alias("turns"))
    return listed.select(
        "conv_id", "leaf", "branch", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]),
                    lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss"))


_HEADER = re.compile(r"(?s)((?:[^\\\n]|\\.)*)\n")
_ESCAPE = re.compile(r"(?s)\\(.)")


def parse(formatted: str) -> list[dict[str, str]]:
    """The turns of a formatted conversation: role, text."""
    turns = []
    for piece in formatted.split(END + "\n")[:-1]:
        header = _HEADER.match(piece, len(START))
        turns.append({"role": _ESCAPE.sub(r"\1", header.group(1)), "text": _ESCAPE.sub(r"\1", piece[header.end():])})
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and learned (the unescaped texts under the loss
    mask) parsed from ``formatted`` and ``loss``.

    SQL's substring walks to its place from the string's start, for every span; tasks cut
    each string once instead."""
    names = formatted.columns
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            turns, learned = [], []
            for text, loss in zip(b.column("formatted"), b.column("loss")):
                text = text.as_py()
                turns.append(parse(text))
                learned.append([_ESCAPE.sub(r"\1", text[s["start"]:s["end"]]) for s in loss.as_py()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(turns, kind),
                                              pa.array(learned, pa.list_(pa.string()))], [*names, "turns", "learned"])

    more = F.array().cast("array<struct<role:string,text:string>>"), F.array().cast("array<string>")
    schema = formatted.select(*names, more[0].alias("turns"), more[1].alias("learned")).schema
    return formatted.mapInArrow(run, schema)


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations given as rows by turn, as trees without branches."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(),
                                                  F.col("text").asc_nulls_first())
    return conversations.select("conv_id", F.row_number().over(order).cast("long").alias("node"), "role", "text") \
        .withColumn("parent", F.col("node") - 1).withColumn("score", F.lit(0.0))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations plus conversation -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Contract digest, read back from the formatted conversations."""
    nodes = materialise(linear(with_probe(spark, table(spark, sf_dir, "conversations"))), "chat-nodes")
    done = read_back(format_paths(nodes.select("conv_id", "node", "role", "text"), paths(nodes)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        _chars(learned).alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        _chars(F.col("formatted")).alias("formatted_chars"))


_SQL_RE = _CONTROL_RE.replace("'", "''")
_FIXED = len(START) + 1 + len(END) + 1


def _sql_escape(x: str) -> str:
    return rf"regexp_replace(replace({x}, '\', '\\'), '{_SQL_RE}', '\1\\\2', 'g')"


OP6_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x) said,
             coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = '{LOSS_ROLE}'), '') learned,
             sum({_FIXED} + length({_sql_escape("r")}) + length({_sql_escape("x")})) size
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) turns_sha256, length(learned)::BIGINT loss_chars, sha256(learned) loss_sha256,
       size::BIGINT formatted_chars FROM g
"""
