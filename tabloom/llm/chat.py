"""Reply trees as training conversations, in DataFrame operations only.

Messages reply to messages. Self-joins by pointer doubling list the nodes of
every path from a root to a leaf in as many rounds as the depth has binary
digits; the paths of a tree are ranked by score, and each chosen path becomes
one text with a mask of what is to be learned. Control strings inside texts are
escaped, so the text reads back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.llm.common import staged
from tabloom.operators.ordered import position


@dataclass(frozen=True)
class Template:
    """A turn is ``turn``, the role, a line break, the text, ``end``.

    In texts a control string gets a backslash behind its first character, one more than stands there, so no text
    holds one and nothing else changes. Every control string must begin with ``<`` or ``[``, and none may begin
    inside another one.
    """

    turn: str = "<|turn|>"
    end: str = "</s>"
    others: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")  # control strings of common templates
    learned: str = "assistant"

    def _rest(self) -> str:
        return "|".join(re.escape(c[1:]) for c in (self.turn, self.end, *self.others))

    def escape(self, c: Column) -> Column:
        return F.regexp_replace(c, rf"([<\[])(\\*)({self._rest()})", r"$1\\$2$3")

    def unescape(self, c: Column) -> Column:
        return F.regexp_replace(c, rf"([<\[])\\(\\*)({self._rest()})", "$1$2$3")

    def escape_role(self, c: Column) -> Column:
        """Also keeps a role on one line."""
        return self.escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))

    def unescape_role(self, c: Column) -> Column:
        return F.replace(F.replace(self.unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist, score) of all nodes of all root-to-leaf paths; ``dist`` counts from the leaf.

    ``nodes``: tree, id (unique in the tree), up (an id of the tree below the own one, or null), score and up_score.
    One table holds the way marks of a round: from a leaf to the nodes within ``hop`` steps (dist is set), and from every
    node to the one ``hop`` steps up. Its join with the latter doubles both.
    """
    below = nodes.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
    leaves = nodes.join(below, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("u")), "left_anti")
    start = leaves.select("tree", F.col("id").alias("who"), F.col("id").alias("node"), F.lit(0).cast("long").alias("dist"), "score")
    links = nodes.where("up is not null").select("tree", F.col("id").alias("who"), F.col("up").alias("node"), F.lit(None).cast("long").alias("dist"), F.col("up_score").alias("score"))
    marks, hop, jump = staged(start.unionAll(links), "marks"), 1, None
    listed = [marks.where("dist is not null")]
    while not (jump := marks.where("dist is null")).isEmpty():
        step = jump.select(F.col("tree").alias("t"), F.col("who").alias("from"), F.col("node").alias("to"), F.col("score").alias("to_score"))
        walked = _union([*listed, jump]).join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("from")))
        marks = staged(walked.select("tree", "who", F.col("to").alias("node"), F.col("dist") + hop, F.col("to_score").alias("score")).toDF(*marks.columns), "marks")
        listed.append(marks.where("dist is not null"))
        hop *= 2
    return _union(listed).withColumnRenamed("who", "leaf")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _best(listed: DataFrame, keep: int) -> DataFrame:
    """(tree, leaf, rank, score) of each tree's ``keep`` best paths: by the sum of scores, then the smaller leaf."""
    scored = listed.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    # a limit by row number is applied before the exchange as well, so a wide tree sends few rows
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep).select("tree", "leaf", "rank", "score")


def format_paths(messages: DataFrame, keep: int = 1, template: Template = Template()) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, n_turns, formatted, loss.

    ``messages``: tree, id (not null, unique in its tree), parent, role, text, score. A message whose parent is null,
    missing or not smaller than itself begins a tree part of its own, so there are no circles. ``loss`` has for every
    learned turn (turn number from 0, start and length in code points inside that turn's part of the text). A null
    text, role or score counts as empty, empty and zero.
    """
    known = messages.select(F.col("tree").alias("t"), F.col("id").alias("p"), F.col("score").alias("up_score"))
    link = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")) & (F.col("p") < F.col("id"))
    nodes = staged(messages.select("tree", "id", "parent", "score").join(known, link, "left").select("tree", "id", F.col("p").alias("up"), "score", "up_score"), "nodes")
    listed = paths(nodes)
    best = _best(listed, keep).select(F.col("tree").alias("bt"), F.col("leaf").alias("bl"), "rank", F.col("score").alias("total"))
    chosen = listed.join(best, F.col("tree").eqNullSafe(F.col("bt")) & (F.col("leaf") == F.col("bl"))).select(
        F.col("tree").alias("t"), "leaf", "node", "dist", "rank", "total")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(template.turn), template.escape_role(role), F.lit("\n"))
    made = messages.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("node")))
    made = made.select("tree", "leaf", "rank", "total", (-F.col("dist")).alias("place"), head.alias("head"), template.escape(text).alias("body"),
                       (role == template.learned).alias("learned"))
    turn = F.struct("place", F.concat("head", "body", F.lit(template.end)).alias("part"),
                    F.when(F.col("learned"), F.char_length("head")).alias("start"), F.char_length("body").alias("length"))
    whole = made.groupBy("tree", "leaf", "rank", "total").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform("turns", lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("tree", "leaf", "rank", F.col("total").alias("score"), F.size("turns").cast("long").alias("n_turns"),
                        F.array_join("turns.part", "").alias("formatted"), F.filter(spans, lambda x: x["start"].isNotNull()).alias("loss"))


def reply_trees(messages: DataFrame, keep: int = 1, template: Template = Template()) -> DataFrame:
    """``format_paths`` for messages as they come: of rows with the same tree and id the least counts, rows without id stand alone."""
    rest = F.struct("parent", "role", "text", "score")
    columns = ["tree", "id", "parent", "role", "text", "score"]
    messages = messages.select("tree", "id", "parent", "role", "text", F.col("score").cast("double").alias("score"))
    once = messages.where("id is not null").groupBy("tree", "id").agg(F.min(rest).alias("m")).select("tree", "id", "m.*")
    out = format_paths(staged(once.select(*columns), "messages"), keep, template)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(template.turn), template.escape_role(role), F.lit("\n"))
    span = F.struct(F.lit(0).alias("turn"), F.char_length(head).alias("start"), F.char_length(template.escape(text)).alias("length"))
    alone = messages.where("id is null").select(
        "tree", F.col("id").alias("leaf"), F.lit(1).alias("rank"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("long").alias("n_turns"),
        F.concat(head, template.escape(text), F.lit(template.end)).alias("formatted"),
        F.when(role == template.learned, F.array(span)).otherwise(F.array().cast("array<struct<turn:int,start:int,length:int>>")).alias("loss"))
    return out.unionAll(alone)


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of ``conversations``: every row replies to the one before it, by turn (nulls first), then role, then the text's hash.

    Rows of a null conv_id are one conversation; repeated rows are turns of their own.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("h"))
    placed = position(rows, ["conv_id"], ["turn", "role", "h"], "id")
    return placed.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` with ``turns``: array<struct<role, text>>, and ``learned``: the texts under the mask."""
    parts = F.split("formatted", re.escape(template.end), -1)
    formatted = formatted.withColumn("__parts", F.slice(parts, F.lit(1), F.size(parts) - 1))
    whole = rf"(?s)\A{re.escape(template.turn)}([^\n]*)\n(.*)\z"
    turns = F.transform("__parts", lambda p: F.struct(template.unescape_role(F.regexp_extract(p, whole, 1)).alias("role"),
                                                      template.unescape(F.regexp_extract(p, whole, 2)).alias("text")))
    learned = F.transform("loss", lambda x: template.unescape(F.substring(F.get("__parts", x["turn"]), x["start"] + 1, x["length"])))
    return formatted.withColumns({"turns": turns, "learned": learned}).drop("__parts")


# What the query adds to the table: a conversation that says control strings.
EXTRA = "select -1L as conv_id, id as turn, element_at(array('user', 'assistant'), cast(id + 1 as int)) as role, '</s>[INST] ok [/INST]' as text from range(2)"


def report(conversations: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted text."""
    conversations = conversations.select("conv_id", "turn", "role", "text")
    extra = conversations.sparkSession.sql(EXTRA).select(*[F.col(c).cast(t).alias(c) for c, t in conversations.dtypes])
    out = read_back(format_paths(staged(chains(conversations.unionAll(extra)), "messages")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return out.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                      F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, n, case when n = 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from (select unnest([0, 1]) as n)),
r as (select *, replace(replace(role, '%', '%25'), chr(10), '%0A') as label from c),
e as (select *, 8 + length(label) + 1 + length(text) + 4
    + len(regexp_extract_all(label, '[<\[]\\*(?:\|turn\|>|/s>|s>|INST\]|/INST\]|<SYS>>|</SYS>>)'))
    + len(regexp_extract_all(text, '[<\[]\\*(?:\|turn\|>|/s>|s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) as chars from r)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""
