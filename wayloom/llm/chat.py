"""Chat formatting over a prefix tree of conversations.

Every turn becomes a segment ``<turn>role\\ntext</turn>\\n`` whose control strings are escaped reversibly. A turn's node is
the chained hash of everything up to it, so conversations that share initial turns share nodes. Conversations are sorted
by their node paths, which is depth-first order of the tree's leaves; each emits only the turns that the conversation
before it in that order doesn't share, so every shared segment is written once. The stream offsets of segments are prefix
sums over that order; a segment's position id is the length of its ancestors, and its attention is the intervals of the
stream that hold them.

The order is a range partitioning; what crosses partitions is one row per partition (its last path, its length).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

# The template.
OPEN, CLOSE, END = "<turn>", "</turn>", "</turn>\n"
LOSS_ROLE = "assistant"
BREAK = r"\n"


def escape(s: str) -> str:
    """Doubles backslashes and turns the < of a control string into \\l; a role's line ends become \\n besides."""
    return re.sub(r"<(?=/?turn>)", r"\\l", s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    out, at = [], 0
    while (to := s.find("\\", at)) >= 0:
        out += [s[at:to], {"\\": "\\", "l": "<", "n": "\n"}[s[to + 1]]]
        at = to + 2
    return "".join([*out, s[at:]])


def segment(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of it under the loss mask (code points; empty for other roles)."""
    head = f"{OPEN}{escape(role).replace(chr(10), BREAK)}\n"
    body = escape(text)
    start = len(head)
    return head + body + END, start, start + len(body) if role == LOSS_ROLE else start


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("node", pa.string()), ("parent", pa.string()), ("segment", pa.string()), ("n", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            paths, nodes = [], []
            for turns in part.column("turns").to_pylist():
                at, path, own, length = "", [], [], 0
                for t in turns:
                    s, a, b = segment(t["role"] or "", t["text"] or "")
                    parent, at = at or None, hashlib.blake2b(at.encode() + s.encode(), digest_size=16).hexdigest()
                    path.append(at)
                    own.append({"node": at, "parent": parent, "segment": s, "n": len(s), "position": length, "loss_start": a, "loss_end": b})
                    length += len(s)
                paths.append(path)
                nodes.append(own)
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.array(paths, pa.list_(pa.string())), pa.array(nodes, pa.list_(kind))], ["conv_id", "path", "nodes"])


def format_chats(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(segments, index) of conversations given as rows (conv_id, turn, role, text).

    segments, one row per node of the tree: tree (its root's node), node, segment, stream_start, stream_end,
    position_start, loss_start and loss_end within the segment, attends: intervals of the stream that its tokens attend
    to besides their own segment's earlier ones. index, one row per (conv_id, turn number k): node.
    Rows are ordered by turn (null first), ties by role and text; repeated rows are turns of their own; null roles and
    texts are empty; the rows of a null conv_id are one conversation. No rows give no segments. Other columns are not
    read.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    node = "struct<node:string,parent:string,segment:string,n:bigint,position:bigint,loss_start:bigint,loss_end:bigint>"
    paths = convs.mapInArrow(_paths, f"conv_id long, path array<string>, nodes array<{node}>")
    # Ties are dealt by conv_id, so even a path that a third of all conversations share is spread out.
    ordered = scratch.save(paths.repartitionByRange("path", "conv_id").withColumn("pid", F.spark_partition_id()))
    line = Window.partitionBy("pid").orderBy("path", "conv_id")
    parts = Window.orderBy("pid")
    last = ordered.groupBy("pid").agg(F.max(F.struct("path", "conv_id")).alias("last")).select("pid", F.lag("last.path").over(parts).alias("carried"))
    lagged = ordered.withColumn("before", F.lag("path").over(line)).join(last, "pid").withColumn("before", F.coalesce("before", "carried")).drop("carried")
    shared = F.size(F.array_intersect("path", F.coalesce("before", F.array().cast("array<string>"))))
    fresh = lagged.withColumn("shared", shared).withColumn("own", F.expr("slice(nodes, shared + 1, greatest(size(nodes) - shared, 0))"))
    fresh = fresh.where(F.size("own") > 0).withColumns({"head": F.col("own")[0]["node"], "first": F.col("own")[0]["position"]})
    fresh = fresh.withColumn("length", F.element_at("own", -1)["position"] + F.element_at("own", -1)["n"] - F.col("first")).drop("nodes")
    fresh = scratch.save(fresh.select("pid", "conv_id", "path", "shared", "own", "head", "first", "length"))
    sums = fresh.groupBy("pid").agg(F.sum("length").alias("n")).select("pid", F.coalesce(F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = F.coalesce(F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = fresh.select("pid", "conv_id", "path", "head", "first", "length").withColumn("run", run).join(sums, "pid")
    runs = runs.select("head", F.col("path")[0].alias("tree"), (F.col("run") + F.col("base")).alias("run_start"), "first")
    # Only scalars stand beside a turn once its conversation is exploded, so bytes grow with the turns, not their square.
    turns = fresh.select("head", F.explode("own").alias("x")).select("head", "x.*").join(runs, "head")
    at = F.col("run_start") + F.col("position") - F.col("first")
    emitted = scratch.save(turns.select("tree", "node", "parent", "segment", at.alias("stream_start"), (at + F.col("n")).alias("stream_end"), F.col("position").alias("position_start"), "loss_start", "loss_end", "head", "run_start"))
    # Ancestors: those above a run's first segment are looked up, those inside the run lie before it in the stream.
    above = fresh.where("shared > 0").select("head", F.posexplode(F.expr("slice(path, 1, shared)")).alias("level", "node"))
    spans = above.join(emitted.select("node", F.col("stream_start").alias("a"), F.col("stream_end").alias("b")), "node").groupBy("head").agg(F.sort_array(F.collect_list(F.struct("level", "a", "b"))).alias("spans"))
    own = F.expr("if(stream_start > run_start, array(struct(2147483647 as level, run_start as a, stream_start as b)), array())")
    merge = """aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (acc, s) ->
        if(size(acc) > 0 and try_element_at(acc, -1).b = s.a,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', try_element_at(acc, -1).a, 'b', s.b))),
           concat(acc, array(named_struct('a', s.a, 'b', s.b)))))"""
    segments = emitted.join(spans, "head", "left").withColumn("spans", F.concat(F.coalesce("spans", F.array().cast("array<struct<level:int,a:bigint,b:bigint>>")), own.cast("array<struct<level:int,a:bigint,b:bigint>>")))
    segments = segments.withColumn("attends", F.expr(merge)).drop("spans", "head", "run_start")
    index = ordered.select("conv_id", F.posexplode("path").alias("k", "node"))
    return segments, index


def read_back(segments: DataFrame, index: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation's formatted text and its masked spans, from the emitted segments."""
    rows = index.join(segments.select("node", "segment", "loss_start", "loss_end"), "node")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "segment", "loss_start", "loss_end"))).alias("x"))
    return whole.select(
        "conv_id", F.array_join(F.transform("x", lambda s: s["segment"]), "").alias("formatted"),
        F.filter(F.transform("x", lambda s: F.substring(s["segment"], (s["loss_start"] + 1).cast("int"), (s["loss_end"] - s["loss_start"]).cast("int"))), lambda s: s != "").alias("loss"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for formatted, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = parse(formatted)
            masked = "".join(map(unescape, loss))
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    segments, index = format_chats(rows.unionByName(extra), Scratch(spark, "chat"))
    return read_back(segments, index).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (SELECT *, 15 + length(role) + length(text) + length(role) - length(replace(role, chr(10), ''))
    + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
    + (length(role) - length(replace(role, '<turn>', '')) + length(text) - length(replace(text, '<turn>', ''))) // 6
    + (length(role) - length(replace(role, '</turn>', '')) + length(text) - length(replace(text, '</turn>', ''))) // 7 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
