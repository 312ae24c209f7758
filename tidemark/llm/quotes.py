"""Quotation linking: conversations in reply order, without the quotes they carry.

A message's lines are parsed into nested quote levels.  Quoted blocks and their lines, normalised, are hashed and joined
to the hashes of what earlier messages of the conversation said themselves (whole, by paragraph and by line); the
originals are reduced to the first message for each hash before the join.  The shallowest linked quote names the message
that is answered; a message that quotes nothing it can be linked by answers the turn before it.  The first answer to a
message goes on with its branch, every other answer begins one.  Threads and branches follow from these links by pointer
doubling over messages, so no conversation is gathered; a branch, written out in pieces of bounded size, is a
conversation in reply order, tagged by role.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: A quoted line needs so many normalised characters to link on its own; whole blocks and messages link at any length.
LEAST_LINE = 12
#: Messages in a piece of a written conversation.
PIECE = 256

_PREFIX = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"^[ \t]*(?:On\b.{0,200}\bwrote|.{1,80}\b(?:wrote|said|schrieb|a écrit|escribió))[ \t]*:[ \t]*$", re.I)
_NOISE = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    return _NOISE.sub(" ", text.lower()).strip()


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)
    return h - (1 << 64) if h >> 63 else h


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own words, and its quoted blocks as (level, text) in order."""
    own: list[str] = []
    blocks: list[tuple[int, list[str]]] = []
    level = 0
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        m = _PREFIX.match(line)
        if m:
            now = m[1].count(">")
            if now != level or not blocks:
                blocks.append((now, []))
            blocks[-1][1].append(line[m.end() :])
            level = now
            continue
        level = 0
        after = next((x for x in lines[i + 1 : i + 3] if x.strip()), "")
        if not (_ATTRIBUTION.match(line) and _PREFIX.match(after)):
            own.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n "), [(n, "\n".join(x)) for n, x in blocks]


def _keys(text: str, least: int) -> list[int]:
    """Hashes of a text as a whole and of its paragraphs and lines (those of least characters or more)."""
    whole = normalised(text)
    if not whole:
        return []
    parts = {normalised(p) for p in [*re.split(r"\n\s*\n", text), *text.split("\n")]}
    return [_hash(whole), *sorted(_hash(p) for p in parts if len(p) >= least and p != whole)]


def _parsed(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parse(t) for t in pdf["text"]]
            quotes = [[(k, n, h, j) for k, (n, q) in enumerate(qs) for j, h in enumerate(_keys(q, least))] for _, qs in got]
            yield pd.DataFrame({"mid": pdf["mid"], "content": [o for o, _ in got], "n_quotes": [len(q) for _, q in got], "own": [_keys(o, least) for o, _ in got], "quotes": quotes})

    return run


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, to) without cycles, one row a node -> (node, end, steps): where its pointers lead, and over how many.

    to and end are structs (mid, turn), so what is wanted of an end need not be joined to it afterwards.  Nodes whose target has no pointer are done and take no part in later rounds, so what all lead to is no hot key.
    """
    now = cut(pointers.select("node", "to", F.lit(1).cast("long").alias("steps"), F.lit(False).alias("done")))
    while True:
        far = now.select(F.col("node").alias("at"), F.col("to").alias("far"), F.col("steps").alias("more"))
        moved = now.where("NOT done").withColumn("at", F.col("to.mid")).join(far, "at", "left")
        moved = moved.select("node", F.coalesce("far", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNull().alias("done"))
        after = cut(moved.unionByName(now.where("done")))
        drop_cut(now)
        now = after
        if not now.where("NOT done").limit(1).count():
            return now.select("node", F.col("to").alias("end"), "steps")


def link_conversations(messages: DataFrame, least_line: int = LEAST_LINE, implicit: bool = True) -> DataFrame:
    """A row per message: conv_id, turn, role, content, n_quotes, n_linked, parent_turn, thread_turn, depth, branch_turn,
    position, message, thread, branch.

    content is the message without quotes and attribution lines; parent_turn that of the message it answers: the one that
    its shallowest linked quote is from or, if none is linked and implicit, one of the turn before (null if there is
    none).  thread_turn and depth tell the message where its thread begins and how many answers lie between; branch_turn
    and position the same for its branch, a run of first answers.  message, thread and branch are numbers of messages,
    which tell apart those that share a turn.

    Null text: empty content, no quotes.  Null conv_id or turn: kept, linked with nothing, a thread of its own.  Repeated
    rows, or several messages with one turn: each is kept and linked by itself; the first of them as read stands for
    what they said, and is what the next turn answers.  Quotes link only to earlier turns of the same conversation.  Very
    long texts are parsed whole.  Empty table: no rows.  Other columns are not looked at.
    """
    m = cut(messages.select("conv_id", "turn", "role", "text").withColumn("mid", F.monotonically_increasing_id()))
    p = cut(m.select("mid", "text").mapInPandas(_parsed(least_line), "mid long, content string, n_quotes int, own array<long>, quotes array<struct<block:int,level:int,hash:long,rank:int>>"))
    quoted = p.where("n_quotes > 0").select("mid", F.explode("quotes").alias("q")).select("mid", "q.*")
    ids = m.select("mid", "conv_id", "turn")
    asked = quoted.join(ids, "mid").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = p.select("mid", F.explode("own").alias("hash")).join(ids, "mid").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    # only what is quoted somewhere goes on; one row for each hash of a conversation: its first message
    first = said.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "mid")).alias("origin"))
    hits = asked.join(first, ["conv_id", "hash"]).where("origin.turn < turn")
    per_block = hits.groupBy("mid", "block").agg(F.min(F.struct("rank", "level", "origin")).alias("x"))
    late = F.struct("x.level", (-F.col("x.origin.turn")).alias("late"), F.col("x.origin.mid").alias("parent"))
    linked = per_block.groupBy("mid").agg(F.count("*").alias("n_linked"), F.min(late).alias("y")).select("mid", "n_linked", F.col("y.parent").alias("quoted"))
    linked = ids.join(linked, "mid", "left")
    if implicit:
        before = ids.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("mid").alias("before"))
        linked = linked.join(before, ["conv_id", "turn"], "left")
    else:
        linked = linked.withColumn("before", F.lit(None).cast("long"))
    linked = cut(linked.select("mid", "turn", "n_linked", F.coalesce("quoted", "before").alias("parent")))
    above = ids.select(F.col("mid").alias("parent"), F.col("turn").alias("parent_turn"))
    answers = cut(linked.where("parent IS NOT NULL").select("mid", "turn", "parent").join(above, "parent"))
    to = F.struct(F.col("parent").alias("mid"), F.col("parent_turn").alias("turn")).alias("to")
    # the first answer by turn goes on with its parent's branch
    goes_on = answers.groupBy("parent", "parent_turn").agg(F.min(F.struct("turn", "mid"))["mid"].alias("mid"))
    thread = _ends(answers.select(F.col("mid").alias("node"), to)).select(F.col("node").alias("mid"), F.col("end").alias("t"), F.col("steps").alias("depth"))
    branch = _ends(goes_on.select(F.col("mid").alias("node"), to)).select(F.col("node").alias("mid"), F.col("end").alias("b"), F.col("steps").alias("position"))
    out = m.select("mid", "conv_id", "turn", "role").join(p.select("mid", "content", "n_quotes"), "mid").join(linked.select("mid", "n_linked"), "mid").join(answers.select("mid", "parent_turn"), "mid", "left").join(thread, "mid", "left").join(branch, "mid", "left")
    none = F.lit(0).cast("long")
    own = F.struct("mid", "turn")
    out = out.withColumns({"t": F.coalesce("t", own), "b": F.coalesce("b", own)})
    out = out.withColumns({"thread": F.col("t.mid"), "thread_turn": F.col("t.turn"), "branch": F.col("b.mid"), "branch_turn": F.col("b.turn")})
    return out.select("conv_id", "turn", "role", "content", F.col("n_quotes").cast("long"), F.coalesce("n_linked", none).alias("n_linked"), "parent_turn", "thread_turn", F.coalesce("depth", none).alias("depth"), "branch_turn", F.coalesce("position", none).alias("position"), F.col("mid").alias("message"), "thread", "branch")


def conversations(messages: DataFrame, least_line: int = LEAST_LINE, implicit: bool = True, piece: int = PIECE) -> DataFrame:
    """Conversations in reply order: conv_id, thread_turn, branch_turn, answers_turn, piece, messages, text.

    A row per branch and piece messages of it, numbered from 0; messages is an array of (position, depth, turn, role,
    content) in order, text the same with each message tagged by its role; answers_turn is the turn of the message that
    the branch's first one answers (null where it begins its thread, and in later pieces).  Every message is in one row.
    Nulls, ties, repeated rows and an empty table as in link_conversations; a null role is tagged unknown.
    """
    m = link_conversations(messages, least_line, implicit)
    one = F.struct("position", "depth", "turn", "role", "content")
    by = m.groupBy("conv_id", "thread_turn", "branch_turn", "thread", "branch", F.floor(F.col("position") / piece).alias("piece"))
    rows = by.agg(F.sort_array(F.collect_list(one)).alias("messages"), F.min(F.when(F.col("position") == 0, F.col("parent_turn"))).alias("answers_turn"))
    tagged = F.transform("messages", lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("unknown")), F.lit("|>\n"), x["content"]))
    return rows.select("conv_id", "thread_turn", "branch_turn", "answers_turn", "piece", "messages", F.array_join(tagged, "\n").alias("text"))
