"""Operator 8, chat formatting as prefix trees.

Template of a turn: ``<|turn|>ROLE<|text|>TEXT<|end|>``.  Inside roles and texts a backslash
becomes ``\\\\``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\b``: no control string, of this or of
the usual other templates, can appear there, and reading back is exact.

Conversations that share initial turns are merged into a tree whose nodes are turns.  Each
tree is laid out depth first, so a shared turn is emitted once; a token's position id is its
place in its own conversation (that of the node's parent's end, and on), and a node attends to itself
and to the intervals of its ancestors.  Ancestors that lie side by side are one interval, so a
long conversation that shares nothing has one interval a node, and their number grows with the
branchings on the path, not with its turns; the turns themselves are the chain of parents.  Tokens are code points (ids from ``ord``), so offsets are
characters; the loss mask covers the escaped texts of the trained role.

Conversations are range-dealt by the hashes of their turns with the id as tie-break, so a
first turn, or a whole conversation, that a third of all rows share is spread over as many
tasks as its size needs; the number of ranges grows with the characters (RANGE_CHARS each).
Within a task neighbours are packed into trees of at most about PACK_CHARS characters, one row
each: memory is bounded by a pack and the longest conversation, which is one row and must fit a
task.  A turn that more conversations share than a pack holds is emitted once in each pack.

Cases: rows are ordered by turn (null turns last), then role and text; null roles and texts
are empty; a null conversation id is a conversation like any other; repeated rows are turns
of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import partitions, query, table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PACK_CHARS = 1 << 18
RANGE_CHARS = 1 << 26

NODE = "struct<start:int,stop:int,parent:int,position:int,loss_start:int,loss_stop:int,attends:array<struct<start:int,stop:int>>>"
PACK = f"pack long, text string, tokens array<int>, positions array<int>, nodes array<{NODE}>, ends array<struct<conv:bigint,node:int>>"


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(s: str) -> str:
    out, i = [], 0
    while True:
        j = s.find("\\", i)
        if j < 0:
            return "".join(out) + s[i:]
        out += [s[i:j], {"\\": "\\", "l": "<", "b": "["}[s[j + 1]]]
        i = j + 2


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of the escaped text in it)."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


class Pack:
    """A tree under construction; conversations are added in path order."""

    def __init__(self, train_role: str):
        self.train_role, self.parts, self.nodes, self.ends = train_role, [], [], []
        self.size, self.path, self.turns = 0, [], []  # path: open nodes and their turns

    def add(self, conv: int | None, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.turns)) and turns[same] == self.turns[same]:
            same += 1
        del self.path[same:], self.turns[same:]
        for role, text in turns[same:]:
            s, a, b = format_turn(role, text)
            parent = self.path[-1] if self.path else -1
            position = self.nodes[parent]["position"] + self.nodes[parent]["stop"] - self.nodes[parent]["start"] if self.path else 0
            trained = role == self.train_role
            self.nodes.append({
                "start": self.size, "stop": self.size + len(s), "parent": parent, "position": position,
                "loss_start": self.size + a if trained else 0, "loss_stop": self.size + b if trained else 0,
                "attends": self.intervals(),
            })
            self.path.append(len(self.nodes) - 1)
            self.turns.append((role, text))
            self.parts.append(s)
            self.size += len(s)
        self.ends.append({"conv": conv, "node": self.path[-1] if self.path else -1})

    def intervals(self) -> list[dict]:
        """What the open path covers: its last node's intervals and the node itself, joined where they
        touch."""
        if not self.path:
            return []
        last = self.nodes[self.path[-1]]
        before = last["attends"]
        if before and before[-1]["stop"] == last["start"]:
            return [*before[:-1], {"start": before[-1]["start"], "stop": last["stop"]}]
        return [*before, {"start": last["start"], "stop": last["stop"]}]

    def row(self, pack: int) -> dict:
        text = "".join(self.parts)
        tokens = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
        positions = np.concatenate([np.arange(n["stop"] - n["start"], dtype=np.int32) + n["position"] for n in self.nodes]) if self.nodes else np.zeros(0, np.int32)
        return {"pack": pack, "text": text, "tokens": tokens, "positions": positions, "nodes": self.nodes, "ends": self.ends}


def format_trees(conversations: DataFrame, train_role: str = "assistant", pack_chars: int = PACK_CHARS) -> DataFrame:
    """One row per pack: text, tokens, position ids, nodes, and each conversation's last node."""
    turn = F.struct(F.col("turn").isNull().alias("n"), F.col("turn").alias("o"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("t"))
    convs = conversations.groupBy(F.col("conv_id").cast("long").alias("conv")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # one number per turn that stands for all turns up to it: equal prefixes, equal numbers
    step = lambda acc, t: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), t["r"], t["t"])))
    convs = convs.withColumn("path", F.aggregate("turns", F.array(F.lit(0).cast("long")), step))
    keys = [F.get("path", F.lit(i)) for i in (1, 2, 3)]
    chars = conversations.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    n = partitions(conversations.sparkSession, chars // RANGE_CHARS)
    convs = convs.repartitionByRange(n, *keys, "conv").sortWithinPartitions("path", "conv")
    kinds = pa.schema([("pack", pa.int64()), ("text", pa.string()), ("tokens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())),
                       ("nodes", pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "stop", "parent", "position", "loss_start", "loss_stop")] + [("attends", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]))),
                       ("ends", pa.list_(pa.struct([("conv", pa.int64()), ("node", pa.int32())])))])

    def run(batches):
        from pyspark import TaskContext

        number, pack = TaskContext.get().partitionId() << 32, Pack(train_role)
        for batch in batches:
            for i in range(batch.num_rows):
                conv, turns = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                pack.add(conv, [(t["r"], t["t"]) for t in turns])
                if pack.size >= pack_chars:
                    yield pa.RecordBatch.from_pylist([pack.row(number)], schema=kinds)
                    number, pack = number + 1, Pack(train_role)
        if pack.ends:
            yield pa.RecordBatch.from_pylist([pack.row(number)], schema=kinds)

    return convs.select("conv", "turns").mapInArrow(run, PACK)


def read_back(text: str, nodes: list[dict], node: int) -> tuple[list[tuple[str, str]], list[str], int]:
    """(turns, texts under the loss mask, formatted characters) of the conversation that ends
    at ``node``, from the emitted text alone."""
    if node < 0:
        return [], [], 0
    chain = []
    while node >= 0:
        chain.append(nodes[node])
        node = nodes[node]["parent"]
    turns, loss = [], []
    for n in reversed(chain):
        s = text[n["start"] + len(TURN) : n["stop"] - len(END)]
        role, body = s.split(TEXT, 1)
        turns.append((unescape(role), unescape(body)))
        if n["loss_start"] > 0:
            loss.append(unescape(text[n["loss_start"] : n["loss_stop"]]))
    return turns, loss, sum(n["stop"] - n["start"] for n in chain)


def digests(packs: DataFrame) -> DataFrame:
    """Per conversation what the output says of it: counts and SHA-256 sums."""
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for e in row["ends"]:
                    turns, loss, chars = read_back(row["text"], row["nodes"], e["node"])
                    trained = "".join(loss)
                    out.append((e["conv"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(trained), sha(trained), chars))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return packs.select("text", "nodes", "ends").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


@query(
    "op8_chat",
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
               UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    f AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b'))
                  + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b')) + 23 AS chars FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id
    """,
)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted trees of all conversations and conversation -7."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return digests(format_trees(rows.unionByName(extra)))
