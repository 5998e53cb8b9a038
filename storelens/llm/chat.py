"""Conversations as one prefix tree: shared first turns are formatted and encoded once.

A node is a turn with everything before it. Nodes lie depth-first in one long row of
tokens; each has the position its first token takes in its conversation and the intervals
of that row its tokens may attend to: those of its ancestors, and its own up to the token.

A node belongs to the smallest conversation that has it; a conversation's own nodes are a
chain that hangs on a node of another one. Chains lie whole, each before those that hang on
it, the deepest hung first. Where a chain starts is a sum over the chains before it, got by
pointer doubling: as many joins as the depth of hanging has binary digits. No path is ever
spelled out, and no subtree, however many conversations share it, is gathered in one place.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import new_folder, worker_store, written
from storelens.llm.tokens import vocabulary_file

# Rows and bytes, whichever come first, that a task puts into a batch at once.
ROWS = 2_000
BATCH_BYTES = 8_000_000
ITEM_BYTES = 64  # what an item of a list counts for
LEARNED = "assistant"

# The template: <turn role> newline text newline </turn> newline. Inside roles and texts a
# backslash precedes what would end them or could be taken for a mark.
_IN_TEXT = re.compile(r"\\|<(?=/?turn)")
_IN_ROLE = re.compile(r"[\\<>\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return _IN_TEXT.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, str, str]:
    """What precedes a turn's text, the text, and what follows it, as written."""
    return "<turn " + _IN_ROLE.sub(r"\\\g<0>", role) + ">\n", escaped(text), "\n</turn>\n"


_TURN = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n((?:\\.|[^\\])*?)\n</turn>\n", re.DOTALL)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns: the inverse of `formatted`."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(text)]


class ByteTokenizer:
    """The byte-level vocabulary: decoding gives every text back."""

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def _tokenizer(file: str) -> ByteTokenizer:
    return worker_store(f"byte_tokenizer_{zlib.crc32(file.encode())}", lambda: ByteTokenizer(file))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) if isinstance(v, str) else ITEM_BYTES * len(v) for v in row if isinstance(v, str | list))
        if len(held) == ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _schema(**kinds: pa.DataType) -> pa.Schema:
    return pa.schema(list(kinds.items()))


def paths(conversations: DataFrame) -> DataFrame:
    """Each turn with its node: conv_id, nth (turn, from 0), node, parent, role, text.

    Rows go by turn; equal turns by role, then text, NULL first. A NULL text or role is
    empty; rows whose conv_id is NULL make one conversation. A conversation streams
    through its task, which keeps the last node alone, so its length is not bounded by memory.
    """
    schema = _schema(conv_id=pa.int64(), nth=pa.int64(), node=pa.string(), parent=pa.string(), role=pa.string(), text=pa.string())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, nth, node = object(), 0, ""
            for conv_id, role, text in _rows(batches):
                if conv_id != last:
                    last, nth, node = conv_id, 0, ""
                own = hashlib.md5(f"{node}\n{len(role)}\n{role}{text}".encode("utf-8", "surrogatepass")).hexdigest()
                yield conv_id, nth, own, node or None, role, text
                node, nth = own, nth + 1

        yield from _batches(rows(), schema)

    filled = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = filled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(walk, "conv_id long, nth long, node string, parent string, role string, text string")


def _encoded(owned: DataFrame, file: str) -> DataFrame:
    """Nodes chain by chain, with their tokens and how many precede them in their partition."""
    schema = _schema(
        part=pa.int32(), node=pa.string(), parent=pa.string(), owner=pa.int64(), nth=pa.int64(), role=pa.string(),
        before=pa.int64(), ids=pa.list_(pa.int32()), loss_from=pa.int32(), loss_to=pa.int32(),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(file)
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            before = 0
            for node, parent, owner, nth, role, text in _rows(batches):
                head, body, tail = (tokenizer.encode(p) for p in formatted(role, text))
                ids = head + body + tail
                loss = (len(head), len(head) + len(body)) if role == LEARNED else (0, 0)
                yield part, node, parent, owner, nth, role, before, ids, *loss
                before += len(ids)

        yield from _batches(rows(), schema)

    ordered = owned.repartitionByRange("owner", "nth").sortWithinPartitions("owner", "nth").select("node", "parent", "owner", "nth", "role", "text")
    return ordered.mapInArrow(encode, (
        "part int, node string, parent string, owner long, nth long, role string, before long, "
        "ids array<int>, loss_from int, loss_to int"))


def _based(rows: DataFrame, size: Column) -> DataFrame:
    """The rows with `laid`: the sizes of all before them, by `part` and `before` in it.

    The driver gets one row per partition."""
    bases, total = [], 0
    for r in sorted(rows.groupBy("part").agg(F.max(F.col("before") + size).alias("n")).collect(), key=lambda r: r["part"]):
        bases.append((r["part"], total))
        total += r["n"]
    based = rows.join(rows.sparkSession.createDataFrame(bases, "part int, base long"), "part")
    return based.withColumn("laid", F.col("base") + F.col("before")).drop("part", "base", "before")


def _chain(conv_id: str) -> Column:
    """The name of a conversation's chain; the empty one for a NULL id."""
    return F.coalesce(F.col(conv_id).cast("string"), F.lit(""))


def _with_subtrees(chains: DataFrame) -> DataFrame:
    """The chains with `whole`: their own size and that of all that hang on them, at whatever distance.

    A round adds to each chain those twice as far away as the round before reached.
    """
    cur = written(chains.select("chain", F.col("up").alias("far"), F.col("own").alias("whole")))
    while cur.where("far IS NOT NULL").limit(1).count():
        more = written(cur.where("far IS NOT NULL").groupBy("far").agg(F.sum("whole").alias("more")).withColumnRenamed("far", "chain"))
        further = cur.select(F.col("chain").alias("far"), F.col("far").alias("further"))
        cur = written(cur.join(more, "chain", "left").join(further, "far", "left").select(
            "chain", F.col("further").alias("far"), (F.col("whole") + F.coalesce("more", F.lit(0))).alias("whole")))
    return chains.join(cur.select("chain", "whole"), "chain")


def _starts(chains: DataFrame) -> DataFrame:
    """(chain, start): the sizes of all chains before each one.

    `chains` has chain, up (the chain it hangs on, or NULL), depth (where) and own (its
    size). Chains that hang on one lie behind it, the deepest hung first, then by name.
    """
    siblings = _with_subtrees(chains).select("chain", "up", "depth", "own", "whole")
    schema = _schema(part=pa.int32(), chain=pa.string(), up=pa.string(), whole=pa.int64(), before=pa.int64())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            before = 0
            for chain, up, whole in _rows(batches):
                yield part, chain, up, whole, before
                before += whole

        yield from _batches(rows(), schema)

    order = ["up", F.desc("depth"), "chain"]
    ordered = siblings.repartitionByRange(*order).sortWithinPartitions(*order).select("chain", "up", "whole")
    summed = _based(written(ordered.mapInArrow(add_up, "part int, chain string, up string, whole long, before long")), F.col("whole"))
    # A chain starts behind the one it hangs on and the siblings before it.
    roots = F.col("up").isNull()
    firsts = written(summed.where(~roots).groupBy("up").agg(F.min("laid").alias("first")).join(
        chains.select(F.col("chain").alias("up"), "own"), "up"))
    least = F.when(roots, F.lit(0)).otherwise(F.col("first") - F.col("own"))  # roots are sorted first
    cur = written(summed.join(firsts, "up", "left").select("chain", F.col("up").alias("far"), (F.col("laid") - least).alias("start")))
    while cur.where("far IS NOT NULL").limit(1).count():
        further = cur.select(F.col("chain").alias("far"), F.col("far").alias("further"), F.col("start").alias("more"))
        cur = written(cur.join(further, "far", "left").select(
            "chain", F.col("further").alias("far"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start")))
    return cur.select("chain", "start")


def _placed(nodes: DataFrame) -> DataFrame:
    """node, owner, first_token and n_tokens of every node, in depth-first order."""
    n_tokens = F.size("ids").cast("long")
    laid = written(_based(nodes.select("part", "before", "node", "parent", "owner", "nth", n_tokens.alias("n_tokens")), F.col("n_tokens")))
    chains = laid.groupBy("owner").agg(
        F.min(F.struct("nth", "parent")).alias("head"), F.sum("n_tokens").alias("own"), F.min("laid").alias("laid")
    ).select(_chain("owner").alias("chain"), F.col("head.nth").alias("depth"), F.col("head.parent").alias("parent"), "own", "laid")
    chains = written(chains)
    hung_on = laid.select(F.col("node").alias("parent"), _chain("owner").alias("up"))
    chains = written(chains.join(hung_on, "parent", "left").select("chain", "up", "depth", "own", "laid"))
    shifts = written(_starts(chains).join(chains, "chain").select("chain", (F.col("start") - F.col("laid")).alias("shift")))
    return laid.withColumn("chain", _chain("owner")).join(shifts, "chain").select(
        "node", "owner", (F.col("laid") + F.col("shift")).alias("first_token"), "n_tokens")


def _with_ancestors(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per node: its first token, the position of that and its ancestors' token intervals.

    A node's conversation of the smallest id is walked; each node lies in one such.
    """
    schema = _schema(
        node=pa.string(), first_token=pa.int64(), position=pa.int64(), intervals=pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, position, intervals = object(), 0, []
            for conv_id, node, first, size, owns in _rows(batches):
                if conv_id != last:
                    last, position, intervals = conv_id, 0, []
                if owns:
                    yield node, first, position, [{"from": a, "to": b} for a, b in intervals]
                position += size
                if intervals and intervals[-1][1] == first:
                    intervals[-1] = (intervals[-1][0], first + size)
                else:
                    intervals.append((first, first + size))

        yield from _batches(rows(), schema)

    own = F.col("owner").eqNullSafe(F.col("conv_id"))
    joined = turns.select("conv_id", "nth", "node").join(sizes, "node").select("conv_id", "nth", "node", "first_token", "n_tokens", own.alias("owns"))
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "nth").select("conv_id", "node", "first_token", "n_tokens", "owns")
    return ordered.mapInArrow(walk, "node string, first_token long, position long, intervals array<struct<from:long,to:long>>")


def write_tree(conversations: DataFrame, folder: str, file: str | None = None) -> None:
    """Write the prefix tree of all conversations to `folder`.

    `nodes` has one row per node: node, parent, role, first_token (in depth-first order over
    the whole corpus), ids, loss_from and loss_to (its learned tokens within ids), position
    (of its first token in a conversation) and intervals (tokens of its ancestors). `turns`
    says which nodes make up a conversation: conv_id, nth, node. An empty table makes empty ones.
    """
    file = file or vocabulary_file("byte_bpe_50k.json")
    turns = written(paths(conversations))
    owners = turns.groupBy("node").agg(F.min(F.struct("conv_id", "nth")).alias("o")).select("node", F.col("o.conv_id").alias("owner"), F.col("o.nth").alias("own_nth"))
    owned = turns.join(owners, "node").where(F.col("conv_id").eqNullSafe(F.col("owner")) & (F.col("nth") == F.col("own_nth")))
    nodes = written(_encoded(owned, file))
    complete = nodes.select("node", "parent", "role", "ids", "loss_from", "loss_to").join(_with_ancestors(turns, _placed(nodes)), "node")
    complete.select("node", "parent", "role", "first_token", "ids", "loss_from", "loss_to", "position", "intervals").write.parquet(f"{folder}/nodes")
    turns.select("conv_id", "nth", "node").write.parquet(f"{folder}/turns")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_conversations(spark: SparkSession, folder: str, file: str | None = None) -> DataFrame:
    """Each conversation's digests (DIGEST), from the written tree: its nodes' tokens are decoded in turn."""
    file = file or vocabulary_file("byte_bpe_50k.json")
    schema = _schema(conv_id=pa.int64(), n_turns=pa.int64(), turns_sha256=pa.string(), loss_chars=pa.int64(), loss_sha256=pa.string(), formatted_chars=pa.int64())
    nodes = spark.read.parquet(f"{folder}/nodes").select("node", "ids", "loss_from", "loss_to")
    joined = spark.read.parquet(f"{folder}/turns").join(nodes, "node")
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "nth").select("conv_id", "ids", "loss_from", "loss_to")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(file)

        def rows() -> Iterator[tuple]:
            last = None
            for conv_id, ids, loss_from, loss_to in _rows(batches):
                if last is None or conv_id != last[0]:
                    if last is not None:
                        yield digest(last)
                    last = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = tokenizer.decode(ids)
                for role, said in parsed(text):
                    last[1] += 1
                    last[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learned = unescaped(tokenizer.decode(ids[loss_from:loss_to]))
                last[3] += len(learned)
                last[4].update(learned.encode("utf-8", "surrogatepass"))
                last[5] += len(text)
            if last is not None:
                yield digest(last)

        def digest(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        yield from _batches(rows(), schema)

    return ordered.mapInArrow(read, DIGEST)


def format_conversations(conversations: DataFrame, file: str | None = None) -> DataFrame:
    """Write the tree to a new folder of the shared one, and read the digests back."""
    folder = new_folder(conversations.sparkSession)
    write_tree(conversations, folder, file)
    return read_conversations(conversations.sparkSession, folder, file)
