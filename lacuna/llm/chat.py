"""Chat formatting in a prefix tree.

Conversations that begin with the same turns share the nodes of these turns. The forest is laid out depth first as one sequence of tokens in which each node
stands once; a node has its place, the position ids of its tokens as continued from its parent, and the intervals of the
sequence that its tokens may attend to besides themselves: its ancestors. All of it is grouped and ordered by ranges, so that neither a first
turn nor a whole conversation that a third of the conversations share gathers in one task.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, settle

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of texts into pieces that the vocabulary was made for. Fixed value.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escape(text: str) -> str:
    """Puts a backslash after each `<` that backslashes, or none, and a bar follow; so no control string is left, and unescape undoes it."""
    return re.sub(r"<(?=\\*\|)", r"<\\", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(?=\\*\|)", "<", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Codec:
    """Byte-level BPE with two control tokens; made anew in each Python worker from the vocabulary's bytes."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        top = max(table.values()) + 2  # one id beyond the ranks is the vocabulary's own
        self.open, self.close = top, top + 1
        self.bpe = tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=table, special_tokens={OPEN: self.open, CLOSE: self.close})

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(tokens, first token of the text, past its last)"""
        head = [self.open, *self.bpe.encode_ordinary(escape_role(role) + "\n")]
        body = self.bpe.encode_ordinary(escape(text))
        return [*head, *body, self.close, *self.bpe.encode_ordinary("\n")], len(head), len(head) + len(body)

    def read(self, tokens: list[int]) -> tuple[str, str]:
        """Role and text of a turn's tokens."""
        if tokens[0] != self.open or tokens.count(self.close) != 1:
            raise ValueError("not the tokens of a turn")
        role, text = self.bpe.decode_bytes(tokens[1 : tokens.index(self.close)]).decode().split("\n", 1)
        return unescape_role(role), unescape(text)


def build(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, paths, convs) for a table of turns.

    nodes, a row for each different beginning of a conversation: node, depth, start and end (its place in the sequence), position (the position id of its first
    token), attends (ascending intervals of the sequence, adjoining ones merged), tokens, loss_from and loss_to (its tokens under the loss mask: an
    assistant's text). paths: leaf and path (the nodes from the first turn). convs: conv and leaf.
    Turns stand by `turn`, then role, then text; null roles and texts count as empty; equal conversations share all nodes. A null conversation id is one
    conversation, and stays null. A conversation's own turns are read in one task, as a stream. Empty tables give empty results.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("c", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))

    def chain(batches):
        at, depth, parent = None, 0, ""
        for pdf in batches:
            out = []
            for c, r, t in zip(pdf["c"], pdf["role"], pdf["text"], strict=True):
                if c != at:
                    at, depth, parent = c, 0, ""
                h = hashlib.sha256(f"{parent}\x00{len(r)}\x00{r}{t}".encode()).hexdigest()[:32]
                out.append((c, depth, h, r, t))
                depth, parent = depth + 1, h
            yield pd.DataFrame(out, columns=["c", "depth", "node", "role", "text"])

    chained = settle(rows.repartition("c").sortWithinPartitions("c", "turn", "role", "text").select("c", "role", "text").mapInPandas(chain, "c string, depth int, node string, role string, text string"), "chat-turns")
    with open(tokenizer, "rb") as f:  # under a megabyte, whatever the data
        held = spark.sparkContext.broadcast(f.read())

    def encode(batches):
        codec = Codec(held.value)
        for pdf in batches:
            out = []
            for n, d, r, t in zip(pdf["node"], pdf["depth"], pdf["role"], pdf["text"], strict=True):
                tokens, lo, hi = codec.turn(r, t)
                out.append((n, d, len(tokens), tokens, lo, hi if r == TRAINED else lo))
            yield pd.DataFrame(out, columns=["node", "depth", "n", "tokens", "loss_from", "loss_to"])

    first = chained.groupBy("node").agg(F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))
    coded = settle(first.mapInPandas(encode, "node string, depth int, n long, tokens array<int>, loss_from int, loss_to int"), "chat-tokens")
    convs = chained.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("path")).withColumn("leaf", F.element_at("path", -1))
    convs = settle(convs, "chat-convs")
    # depth first: paths in order; a node belongs to the first path that has it, and a path's own nodes follow by depth
    paths = convs.groupBy("leaf").agg(F.first("path").alias("path"))
    paths = settle(paths.orderBy("path").withColumn("rank", F.monotonically_increasing_id()), "chat-paths")
    steps = settle(paths.select("rank", F.posexplode("path").alias("depth", "node")), "chat-steps")
    own = steps.groupBy("node").agg(F.min("rank").alias("rank")).join(coded.select("node", "depth", "n"), "node").withColumn("range", F.shiftright("rank", 33))
    own = settle(own, "chat-owners")
    bases = own.groupBy("range").agg(F.sum("n").alias("sum"))
    bases = bases.withColumn("base", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")  # a row for each range
    run = F.sum("n").over(Window.partitionBy("range").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("run", run).join(bases, "range").withColumn("end", F.col("base") + F.col("run"))
    own = settle(own.select("node", F.col("rank").alias("owner"), "depth", (F.col("end") - F.col("n")).alias("start"), "end"), "chat-places")
    # a first turn that many paths share is one node: such nodes meet their paths in a broadcast
    seen = meet(steps.select("rank", "node"), own, "node").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("depth", "start", "end", "node", "owner"))).alias("x"))

    def intervals(batches):
        for pdf in batches:
            out = []
            for rank, path in zip(pdf["rank"], pdf["x"], strict=True):
                above: list[list[int]] = []
                position = 0
                for s in path:
                    if s["owner"] == rank:
                        out.append((s["node"], position, [{"start": a, "end": b} for a, b in above]))
                    if above and above[-1][1] == s["start"]:
                        above[-1][1] = s["end"]
                    else:
                        above.append([s["start"], s["end"]])
                    position += s["end"] - s["start"]
            yield pd.DataFrame(out, columns=["node", "position", "attends"])

    placed = own.drop("owner", "depth").join(seen.mapInPandas(intervals, "node string, position long, attends array<struct<start: long, end: long>>"), "node")
    placed = settle(placed, "chat-nodes")
    return placed.join(coded.drop("n"), "node"), paths.select("leaf", "path"), convs.select(F.when(F.col("c") != "", F.expr("substring(c, 2)")).alias("conv"), "leaf")


def read_back(nodes: DataFrame, paths: DataFrame, convs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each conversation, from the laid-out tokens alone: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    with open(tokenizer, "rb") as f:
        held = nodes.sparkSession.sparkContext.broadcast(f.read())
    steps = settle(paths.select("leaf", F.posexplode("path").alias("depth", "node")), "chat-read")
    steps = meet(steps, nodes.select("node", "tokens", "loss_from", "loss_to"), "node", many=2000)  # texts of hot nodes: few may be broadcast

    def digest(batches):
        codec = Codec(held.value)
        leaf, acc = None, None

        def done():
            return (leaf, acc[0], acc[1].hexdigest(), acc[2], acc[3].hexdigest(), acc[4])

        for pdf in batches:
            out = []
            for x, tokens, lo, hi in zip(pdf["leaf"], pdf["tokens"], pdf["loss_from"], pdf["loss_to"], strict=True):
                if x != leaf:
                    if acc:
                        out.append(done())
                    leaf, acc = x, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                tokens = [int(t) for t in tokens]
                role, text = codec.read(tokens)
                loss = unescape(codec.bpe.decode_bytes(tokens[lo:hi]).decode())
                acc[0] += 1
                acc[1].update(f"{role}\n{text}\n".encode())
                acc[2] += len(loss)
                acc[3].update(loss.encode())
                acc[4] += len(codec.bpe.decode_bytes(tokens).decode())
            if out:
                yield pd.DataFrame(out, columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        if acc:
            yield pd.DataFrame([done()], columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = steps.repartition("leaf").sortWithinPartitions("leaf", "depth").select("leaf", "tokens", "loss_from", "loss_to")
    read = ordered.mapInPandas(digest, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return convs.join(read, "leaf").drop("leaf")
