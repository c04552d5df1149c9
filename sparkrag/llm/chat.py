"""Chat formatting over reply trees.

`message_tree` turns (conversation, turn) rows into nodes with a parent, `root_paths` joins the
nodes with themselves, doubling the length of the known paths each round, until every leaf has its
path to the root; `rank_branches` orders the leaves of a tree by score; `format_paths` writes each
chosen path as one conversation with its loss mask; `parse_formatted` reads one back.

Template: `<|im_start|>role\\n` text `<|im_end|>\\n` for each turn. Inside a text every `<`, any
number of backslashes, `|` gets one backslash more, so no text can hold a control string, and taking
it away restores the text. Backslashes and line ends of a role are written as `\\\\` and `\\n`.

Cases: a null text or role is empty; a null turn comes first; rows with equal turns are ordered by
role, then text; repeated rows are turns of their own; a null conversation id is a conversation of
its own; in a reply tree a repeated node id counts once, and nodes on a cycle or under one have no path;
an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrag.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def message_tree(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes (tree, node, parent, role, text, score) of conversations in which each turn replies to the one before."""
    clean = rows.select(
        F.col(conv).cast("long").alias("tree"), F.col(turn).alias("at"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("at").asc_nulls_first(), "role", "text")).cast("long")
    return clean.select("tree", node.alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with one row for each (tree, node): of rows that repeat an id the smallest by parent, role and text counts."""
    rest = [c for c in ("parent", "role", "text", "score") if c in nodes.columns]
    return nodes.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("n")).select("tree", "node", *[F.col(f"n.{c}").alias(c) for c in rest])


def root_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for each leaf the nodes on its path to the root, up steps above it.

    Round k joins the paths known so far with a table of jumps over 2**k nodes, made of the table before
    joined with itself, so a path of n nodes takes log2(n) rounds, no more rows are made than the paths have
    steps, and short trees leave the work early. Nodes whose parent is missing count as roots. Ids are
    unique in a tree (see `unique_nodes`). What still jumps after as many rounds as the largest tree can
    need leads into a cycle: such nodes have no root, and the leaves among them no path.
    """
    jump = nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("to"))
    jump = stored(jump.alias("j").join(nodes.alias("n"), _same("j", "n", "to", "node"), "left_semi"), "jumps")
    leaves = stored(nodes.alias("n").join(jump.alias("j"), _same("n", "j", "node", "to"), "left_anti").select("tree", F.col("node").alias("leaf")), "leaves")
    largest = jump.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while len(jumps) <= largest.bit_length() and not jump.isEmpty():
        jumps.append(jump)
        a, b = jump.alias("a"), jump.alias("b")
        jump = stored(a.join(b, _same("a", "b", "to", "node")).select("a.tree", "a.node", "b.to"), "jumps")
    steps = leaves.alias("l").join(jump.alias("j"), _same("l", "j", "leaf", "node"), "left_anti").select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    known = stored(steps, "steps")
    for k, jump in enumerate(jumps):
        more = known.alias("s").join(jump.alias("j"), _same("s", "j", "node", "node")).select("s.tree", "s.leaf", F.col("j.to").alias("node"), (F.col("s.up") + 2**k).alias("up"))
        known = known.unionByName(stored(more, "steps"))
    return known


def _same(a: str, b: str, left: str, right: str) -> Column:
    """The same tree, which may be null, and node `left` of a is node `right` of b."""
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def rank_branches(paths: DataFrame, nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """(tree, leaf, score, branch) for each leaf: the mean score along its path; branch 1 is the best
    of a tree, ties to the smaller leaf id. keep bounds branch."""
    scored = paths.alias("p").join(nodes.alias("n"), _same("p", "n", "node", "node")).groupBy("p.tree", "p.leaf").agg(F.avg("n.score").alias("score"))
    ranked = scored.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked if keep is None else ranked.where(F.col("branch") <= keep)


def format_paths(paths: DataFrame, nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """(tree, leaf, branch, score, formatted, loss_spans): one conversation per chosen branch.

    loss_spans are [start, end) positions, in code points of `formatted`, of the assistants' texts.
    """
    turns = paths.alias("p").join(nodes.alias("n"), _same("p", "n", "node", "node"))
    role = F.replace(F.replace(F.col("n.role"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), F.regexp_replace(role, r"<(\\*)\|", r"<$1\\|"), F.lit("\n"))
    body = F.regexp_replace("n.text", r"<(\\*)\|", r"<$1\\|")
    turn = F.struct((-F.col("p.up")).alias("at"), head.alias("head"), body.alias("body"), (F.col("n.role") == "assistant").alias("learn"))
    gathered = turns.groupBy("p.tree", "p.leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chosen = gathered.alias("g").join(branches.alias("b"), _same("g", "b", "leaf", "leaf"))
    return chosen.select(
        "g.tree", "g.leaf", "b.branch", "b.score",
        F.array_join(F.transform("g.turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        _spans("g.turns").alias("loss_spans"),
    )


def _spans(turns: str):
    """Spans of the turns to learn, by a running position over the turns in order."""
    tail = len(END) + 1
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + tail).cast("long").alias("at"), F.when(t["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda acc: acc["spans"])


def parse_formatted(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
        out.append((role, unescape(m[2])))
        at = m.end()
    return out


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, mask in zip(formatted, spans, strict=True):
        turns = parse_formatted(text)
        learned = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        rows.append((len(turns), sha, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])


def read_back(formatted: Column, spans: Column) -> Column:
    """Counts and digests of what a formatted conversation and its loss mask say, read from them alone."""
    return F.pandas_udf(_read_back, DIGEST)(formatted, spans)


def format_conversations(rows: DataFrame, keep: int | None = None) -> DataFrame:
    """Rows of conversations to (tree, leaf, branch, score, formatted, loss_spans)."""
    return _formatted(message_tree(rows), keep)


def format_trees(nodes: DataFrame, keep: int | None = None) -> DataFrame:
    """As `format_conversations`, of nodes (tree, node, parent, role, text, score) of any reply trees."""
    return _formatted(unique_nodes(nodes), keep)


def _formatted(nodes: DataFrame, keep: int | None) -> DataFrame:
    nodes = stored(nodes, "nodes")
    paths = root_paths(nodes)
    return format_paths(paths, nodes, rank_branches(paths, nodes, keep))
