"""Chat formatting: root-to-leaf paths of reply trees by self-joins, ranked by score, one conversation per path.

Messages are rows (tree, node, parent, role, text, score). Pointer doubling self-joins find each leaf's ancestors in a number of
joins that grows with the logarithm of the depth. Only ids travel through them; texts join once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzline.session import discard, written

#: Marks of the template: role, text and end of a turn. Inside roles and texts no raw < remains, so no mark can occur there.
ROLE, TEXT, END = "<turn>", "<text>", "</turn>\n"


def escape(s: Column) -> Column:
    """\\ becomes \\\\ and < becomes \\l."""
    return F.replace(F.replace(F.coalesce(s, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(s: Column) -> Column:
    """The inverse of escape: escaped text holds no raw <, so < may stand for \\ while \\l is undone; then the two are swapped."""
    return F.translate(F.replace(F.replace(s, F.lit("\\\\"), F.lit("<")), F.lit("\\l"), F.lit("\\")), "<\\", "\\<")


def as_nodes(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before. Ties of turn are ordered by role and text, nulls first."""
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    d = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    d = d.withColumn("node", F.row_number().over(w).cast("long"))
    return d.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each (tree, node): of repeated rows the one of the smallest parent, score, role and text."""
    rest = [c for c in ("parent", "score", "role", "text") if c in nodes.columns]
    return nodes.groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("row")).select("tree", "node", "row.*")


def best_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, up): the nodes of the keep best root-to-leaf paths of each tree, up being the steps to the leaf.

    nodes: (tree, node, parent, score), written before; of rows that repeat a node the one of the smallest parent and score counts. A path's
    score is the mean of its nodes' scores, null as 0; ties go to the longer path, then to the smaller leaf. A node whose parent
    is missing is a root. Nodes on a cycle, and below one, reach no root and are left out; a node that is its own parent is such a cycle.
    """
    ids = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("row")).select("tree", "node", "row.*")
    ids = written(ids, "path-ids")
    inner = ids.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    reach = written(ids.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    there = ids.select("tree", F.col("node").alias("parent"))
    jump = written(ids.where(F.col("parent").isNotNull()).join(there, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("far")), "jumps")
    most = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < most and not jump.isEmpty():  # no path has more nodes than its tree
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("far").alias("node"), (F.col("up") + step).alias("up"))
        onward = jump.select("tree", F.col("node").alias("from"), F.col("far").alias("node"))
        before = reach, jump
        reach = written(reach.unionByName(further), "paths")
        jump = written(onward.join(jump, ["tree", "node"]).select("tree", F.col("from").alias("node"), "far"), "jumps")
        discard(*before)
        step *= 2
    if not jump.isEmpty():  # what can still go up goes round in a cycle
        reach = reach.join(jump.select("tree", F.col("node").alias("leaf")).distinct(), ["tree", "leaf"], "left_anti")
    ranked = reach.join(ids.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"), F.count("*").alias("depth"))
    w = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("depth"), F.asc("leaf"))
    best = ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("tree", "leaf", "rank")
    return reach.join(best, ["tree", "leaf"]).select("tree", "leaf", "rank", "node", "up")


def format_paths(nodes: DataFrame, keep: int = 1, distinct: bool = False) -> DataFrame:
    """(tree, rank, formatted, loss_spans): one conversation per chosen path.

    loss_spans: the (start, end) code points of the assistant's escaped texts within formatted. distinct: whether no node repeats; repeated
    ones are reduced by distinct_nodes() otherwise.
    """
    if not distinct:
        nodes = written(distinct_nodes(nodes), "path-nodes")
    paths = best_paths(nodes, keep)
    turn = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT), escape(F.col("text")), F.lit(END))
    parts = paths.join(nodes.select("tree", "node", "role", turn.alias("part"), F.length(escape(F.col("role"))).alias("r")), ["tree", "node"])
    parts = parts.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "part", (F.col("role") == "assistant").alias("loss"), "r"))).alias("parts"))
    head, tail = len(ROLE) + len(TEXT), len(END)

    def step(a, p):
        end = a["end"] + F.length(p["part"])
        spans = F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["end"] + head + p["r"]).alias("start"), (end - tail).alias("end"))))).otherwise(a["spans"])
        return F.struct(end.alias("end"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return parts.select("tree", "rank", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), F.aggregate("parts", zero, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, all from the formatted string and its spans alone."""
    pieces = F.slice(F.split("formatted", END, -1), 1, F.size(F.split("formatted", END, -1)) - 1)

    def turn(s):
        both = F.split(F.substring(s, len(ROLE) + 1, 2**31 - 1), TEXT, 2)
        return F.struct(unescape(F.get(both, 0)).alias("role"), unescape(F.get(both, 1)).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(masked, "")})


def chat_digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of linear conversations, read back from the output.

    Null roles and texts are empty. Repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are
    left out. Other columns are ignored.
    """
    nodes = written(as_nodes(rows.where(F.col("conv_id").isNotNull())), "chat-nodes")
    d = read_back(format_paths(nodes, distinct=True))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), e AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<]', '', 'g')) + 20 AS part FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(part)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""
