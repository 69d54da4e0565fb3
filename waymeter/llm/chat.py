"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

A node is a distinct sequence of turns from the start. Tokens are the code points of the formatted text. Each node has its place in
the emitted stream, position ids that continue its parent's, and the intervals of the stream that its tokens may attend to besides
their own node: its ancestors'.

Turns are read in the order of (conv_id, turn) in range partitions; a node's name is a chained hash of the turns up to it, and what a
partition needs from those before it are one count, one length and two hashes, so that a conversation may span any number of tasks.
Nodes without siblings follow their parents in the stream and form one segment with them. Only segments have keys, the chain of
their ancestors' hashes, so that sorting keys visits the tree depth first; a conversation passes few of them, however long it is.

Only a node's own text is carried, once; a first turn that a third of all conversations share is one row after partial aggregation,
and the partners of keys of more than ``HOT`` rows go by themselves. Offsets are sums inside range partitions plus the partitions before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, discard, few, materialise, stored_bytes
from .words import U, mix

# The template, fixed values: a user's turn, an assistant's, and any other role's.
USER, OTHER, CLOSE_USER, CLOSE_OTHER, CLOSE_ASSISTANT = "<s>[INST] ", "<s>[ROLE={}] ", " [/INST]", " [/ROLE]", "</s>"
_BODY = r"[^\\<\[\]]*(?:\\.[^\\<\[\]]*)*"
_TURN = re.compile(rf"<s>\[INST\] (?P<user>{_BODY}) \[/INST\]|<s>\[ROLE=(?P<role>{_BODY})\] (?P<other>{_BODY}) \[/ROLE\]|(?P<assistant>{_BODY})</s>", re.S)
_CONTROL, _ESCAPED = re.compile(r"[\\<\[\]]"), re.compile(r"\\(.)", re.S)
#: Bytes of a segment's key for each segment above it.
KEY_BYTES = 8
#: Rows of one key from which on its join partner is broadcast.
HOT = 100_000
#: Bytes on disk of right rows that are broadcast, and copies of them otherwise.
HOT_BYTES, SALTS = 16 << 20, 64


def escape(text: str) -> str:
    """No control string of the template is left: each begins or ends with a character that now follows a backslash."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and the span in it that the loss covers."""
    body = escape(text)
    if role == "assistant":
        return body + CLOSE_ASSISTANT, 0, len(body)
    if role == "user":
        return USER + body + CLOSE_USER, 0, 0
    return OTHER.format(escape(role)) + body + CLOSE_OTHER, 0, 0


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError on anything else."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        kind = m.lastgroup
        turns.append(("user", unescape(m["user"])) if kind == "user" else ("assistant", unescape(m["assistant"])) if kind == "assistant" else (unescape(m["role"]), unescape(m["other"])))
        at = m.end()
    return turns


_LOCAL = "part int, conv_id long, i long, position long, one long, two long, one_before long, two_before long, text string, n int, loss_from int, loss_to int"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = 2**64 - 1
ROOT = b"\0" * 16


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a key once.

    The right rows of keys that more than ``HOT`` rows of ``left`` share are written, and broadcast if their files hold ``HOT_BYTES`` at
    most; else they are there ``SALTS`` times, and the left rows are dealt over them. ``left`` is counted first: it should be a table.
    """
    if left.count() <= HOT:
        return left.join(right, key, how)
    hot = left.groupBy(key).count().where(F.col("count") > HOT).select(key)
    if hot.isEmpty():
        return left.join(right, key, how)
    hot = few(materialise(hot, "hot"))
    own, theirs = left.join(hot, key, "left_semi"), materialise(right.join(hot, key, "left_semi"), "hot_rows")
    if stored_bytes(theirs) <= HOT_BYTES:
        spread = own.join(F.broadcast(theirs), key, how)
    else:
        salted = own.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.lit(SALTS)))
        copies = theirs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        spread = salted.join(copies, [key, "_salt"], how).drop("_salt")
    return spread.unionByName(left.join(hot, key, "left_anti").join(right, key, how))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order, formatted, with how many turns and tokens of their conversation are before them in this partition, and the hashes with and without them."""
    conv, i, position, h = "none yet", 0, 0, (0, 0)
    for batch in batches:
        out = []
        for part, c, role, said in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if c != conv:
                conv, i, position, h = c, 0, 0, (0, 0)
            text, lo, hi = format_turn(role, said)
            d = hashlib.blake2b(len(role).to_bytes(8, "big") + role.encode() + said.encode(), digest_size=16).digest()
            now = tuple((x * b + int.from_bytes(d[8 * k : 8 * k + 8], "big")) & _MASK for k, (x, b) in enumerate(zip(h, _BASES, strict=True)))
            out.append((part, c, i, position, *map(_signed, (*now, *h)), text, len(text), lo, hi))
            i, position, h = i + 1, position + len(text), now
        kinds = (pa.int32(), *[pa.int64()] * 7, pa.string(), *[pa.int32()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 12, kinds, strict=True)], [f.split()[0] for f in _LOCAL.split(", ")])


def _carried(edges: list) -> dict[int, tuple]:
    """Of each partition that goes on with a conversation: its id, and the count, length and hashes that it has before. One row a partition comes in, in order."""
    out, conv, state = {}, "none yet", (0, 0, 0, 0)
    for e in edges:
        if e["first"] == conv:
            out[e["part"]] = (conv, *state)
        else:
            state = (0, 0, 0, 0)
        if e["last"] != e["first"]:
            state = (0, 0, 0, 0)
        h = (((state[2 + k] * pow(b, e["n"], 2**64)) + x) & _MASK for k, (b, x) in enumerate(zip(_BASES, (e["one"], e["two"]), strict=True)))
        conv, state = e["last"], (state[0] + e["n"], state[1] + e["size"], *h)
    return out


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """base**n modulo 2**64."""
    out, square, n = np.ones(len(n), U), U(base), n.astype(np.int64)
    while (n > 0).any():
        out = np.where(n & 1, out * square, out)
        with np.errstate(over="ignore"):
            square = square * square
        n = n >> 1
    return out


_STEPS = "conv_id long, i long, node binary, parent binary, text string, n int, position long, loss_from int, loss_to int"


def _names(h: list[np.ndarray]) -> list[bytes]:
    return [a + b for a, b in zip(*(np.ascontiguousarray(mix(x, 41 + k)).view("V8").tolist() for k, x in enumerate(h)), strict=True)]


def _chained(carried: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv, i, position = (batch.column(k).to_pylist() for k in range(4))
            before = [c[1:] if (c := carried.get(p)) and c[0] == v else (0, 0, 0, 0) for p, v in zip(part, conv, strict=True)]
            i = np.array(i, np.int64)
            names = []
            for more, columns in ((1, (4, 5)), (0, (6, 7))):
                h = []
                for k, column in enumerate(columns):
                    own = batch.column(column).to_numpy().view(U) if len(batch) else np.zeros(0, U)
                    h.append(own + np.array([b[2 + k] for b in before], U) * _powers(_BASES[k], i + more))
                names.append(_names(h))
            at = i + np.array([b[0] for b in before], np.int64)
            parents = [ROOT if k == 0 else p for k, p in zip(at.tolist(), names[1], strict=True)]
            places = [p + b[1] for p, b in zip(position, before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at), pa.array(names[0], pa.binary()), pa.array(parents, pa.binary()), batch.column(8), batch.column(9), pa.array(places, pa.int64()), batch.column(10), batch.column(11)], [f.split()[0] for f in _STEPS.split(", ")])

    return run


def steps_of(conversations: DataFrame) -> DataFrame:
    """Each turn as a step (``_STEPS``) of its conversation, written to the shared folder."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spread = turns.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    local = materialise(spread.select(F.spark_partition_id().alias("part"), "conv_id", "role", "text").mapInArrow(_local, _LOCAL), "local")
    # one row a partition: its first conversation, and its last with what it has of it
    place = F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id", "i")
    last = F.max(F.struct(place.alias("at"), (F.col("i") + 1).alias("n"), (F.col("position") + F.col("n")).alias("size"), "one", "two")).alias("e")
    edges = local.groupBy("part").agg(F.min(place).alias("f"), last).orderBy("part").select("part", F.col("f.conv_id").alias("first"), F.col("e.at.conv_id").alias("last"), "e.n", "e.size", "e.one", "e.two").collect()
    carried = _carried([{**e.asDict(), "one": e["one"] & _MASK, "two": e["two"] & _MASK} for e in edges])
    steps = materialise(local.mapInArrow(_chained(carried), _STEPS), "steps")
    discard(local)
    return steps


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the segments that a path owns their keys."""
    for batch in batches:
        heads, keys = [], []
        for path in batch.column(0).to_pylist():
            key = b""
            for x in path:
                key += x["head"][:KEY_BYTES]
                if x["own"]:
                    heads.append(x["head"])
                    keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(keys, pa.binary())], ["head", "key"])


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the segments that a path owns what stands before them on it; a child that follows its parent in the stream goes on with its interval."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        heads, before = [], []
        for path in batch.column(0).to_pylist():
            runs: list[list[int]] = []
            for x in path:
                if x["own"]:
                    heads.append(x["head"])
                    before.append([{"start": a, "end": b} for a, b in runs])
                if runs and runs[-1][1] == x["from"]:
                    runs[-1][1] += x["size"]
                else:
                    runs.append([x["from"], x["from"] + x["size"]])
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(before, kind)], ["head", "above"])


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of a table (conv_id, turn, role, text).

    nodes: node, text, n_tokens, start (in the stream, which visits the trees depth first), position (of its first token; others
    follow one by one), loss_from, loss_to (offsets in ``text``; equal where nothing is learnt), ancestors (array of (start, end) in
    the stream, in order, adjoining ones joined). members: conv_id, i, leaf, node, the nodes of each conversation from i = 0.

    Turns are ordered by turn, nulls first, then by role and text; null roles and texts are empty. Rows without a conv_id are one
    conversation. Repeated rows are turns said twice. Neither a tree nor a conversation is gathered; what is gathered of a
    conversation are the segments that it passes, one more than the places where others leave it.
    """
    bound_batches(conversations.sparkSession)
    steps = steps_of(conversations)
    # conversations go by a number that is never null
    conv = F.coalesce("conv_id", F.lit(-(2**63)))
    numbered = steps.withColumn("c", conv)
    what = F.struct("c", "i", "parent", "text", "n", "position", "loss_from", "loss_to")
    nodes = materialise(numbered.groupBy("node").agg(F.min_by(what, F.struct("c", "i")).alias("w")).select("node", "w.*"), "nodes")
    split = nodes.where(F.col("parent") != F.lit(ROOT)).groupBy("parent").count().where("count > 1").select("parent", F.lit(True).alias("splits"))
    heads = spread_join(nodes.where(F.col("parent") != F.lit(ROOT)).select("parent", "node"), materialise(split, "split"), "parent").select("node")
    heads = materialise(heads.unionByName(nodes.where(F.col("parent") == F.lit(ROOT)).select("node")), "heads")
    # conversations that end alike are one path, the smallest one's
    ends = materialise(numbered.groupBy("c").agg(F.max_by("node", "i").alias("leaf")), "ends")
    chosen = materialise(ends.groupBy("leaf").agg(F.min("c").alias("c")), "chosen")
    own = nodes.select("node", F.col("c").alias("owner"))
    passed = spread_join(numbered.select("c", "i", "node"), spread_heads(heads, own), "node")
    passed = materialise(passed.join(chosen.select("c"), "c", "left_semi").select("c", "i", F.col("node").alias("head"), (F.col("owner") == F.col("c")).alias("own")), "passed")
    paths = passed.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "head", "own"))).alias("path"))
    keys = paths.select("path").mapInArrow(_keys, "head binary, key binary")
    # each node's segment is the last one that its path has begun
    placed = spread_join(nodes, materialise(paths, "paths"), "c").withColumn("head", F.expr("element_at(filter(path, p -> p.i <= i), -1).head")).drop("path")
    placed = materialise(placed, "placed")
    sizes = placed.groupBy("head").agg(F.sum("n").alias("size"), F.min("position").alias("at"))
    ordered = materialise(keys.join(sizes, "head").repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ordered")
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("key", "head").rowsBetween(Window.unboundedPreceding, -1))
    parts = ordered.groupBy("part").agg(F.sum("size").alias("all"))
    before = F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    segments = ordered.withColumn("inside", F.coalesce(inside, F.lit(0))).join(parts.select("part", F.coalesce(before, F.lit(0)).alias("base")), "part")
    segments = materialise(segments.select("head", "size", "at", (F.col("base") + F.col("inside")).alias("from")), "segments")
    runs = spread_join(passed, segments.select("head", "size", "from"), "head").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "head", "own", "from", "size"))).alias("path"))
    above = runs.select("path").mapInArrow(_intervals, "head binary, above array<struct<start:bigint,end:bigint>>")
    at = spread_join(placed, materialise(segments.join(above, "head").select("head", "at", "from", "above"), "above"), "head")
    at = at.withColumn("start", F.col("from") + F.col("position") - F.col("at"))
    last = F.element_at("above", -1)
    joined = F.when((F.size("above") > 0) & (F.try_element_at("above", F.lit(-1))["end"] == F.col("from")), F.concat(F.slice("above", 1, F.size("above") - 1), F.array(F.struct(last["start"].alias("start"), F.col("start").alias("end")))))
    ancestors = F.when(F.col("start") == F.col("from"), F.col("above")).otherwise(F.coalesce(joined, F.concat("above", F.array(F.struct(F.col("from").alias("start"), F.col("start").alias("end"))))))
    out = materialise(at.select("node", "text", F.col("n").alias("n_tokens"), "start", "position", "loss_from", "loss_to", ancestors.alias("ancestors")), "tree")
    members = materialise(spread_join(numbered.select("c", "conv_id", "i", "node"), ends, "c").select("conv_id", "i", "leaf", "node"), "members")
    discard(steps, nodes, heads, ends, chosen, passed, placed, ordered, segments)
    return out, members


def spread_heads(heads: DataFrame, own: DataFrame) -> DataFrame:
    """(node, owner) of nodes that begin a segment."""
    return materialise(heads.join(own, "node"), "owners")


def position_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``position_ids``, one for each token."""
    return nodes.withColumn("position_ids", F.when(F.col("n_tokens") > 0, F.expr("sequence(position, position + n_tokens - 1)")).otherwise(F.array().cast("array<int>")))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in the order of (leaf, i), each with its formatted text: what they say, path by path. Of a path only digests are held."""
    leaf, state = None, None
    names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 6
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

    def close() -> None:
        if leaf is not None:
            turns, said, chars, loss, size = state
            done.append((leaf, turns, said.hexdigest(), chars, loss.hexdigest(), size))

    for batch in batches:
        for of, text, lo, hi in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if of != leaf:
                close()
                leaf, state = of, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse_turns(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            learnt = unescape(text[lo:hi])
            state[2] += len(learnt)
            state[3].update(learnt.encode())
            state[4] += len(text)
        yield flush()
    close()
    yield flush()


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Each conversation as its nodes say it, one after another: counts and digests of its turns and of what the loss covers.

    Conversations that end in one leaf are read once. A digest is one sequence: a conversation's turns pass through one task, one after another.
    """
    first = materialise(members.where("i = 0").groupBy("leaf").agg(F.min(F.coalesce("conv_id", F.lit(-(2**63)))).alias("_c")), "first")
    own = spread_join(members.withColumn("_c", F.coalesce("conv_id", F.lit(-(2**63)))).select("_c", "leaf", "i", "node"), first.select("_c", F.lit(True).alias("_read")), "_c")
    said = spread_join(own.select("leaf", "i", "node"), nodes.select("node", "text", "loss_from", "loss_to"), "node")
    said = said.repartition("leaf").sortWithinPartitions("leaf", "i").select("leaf", "text", "loss_from", "loss_to")
    digests = materialise(said.mapInArrow(_read_back, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"), "digests")
    return spread_join(members.where("i = 0").select("conv_id", "leaf"), digests, "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
