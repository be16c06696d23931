"""A prefix trie over conversations from adaptive radix trees of bounded size.

Each turn has an id of fixed width, the head of a digest of its role and text, written big-endian. A
conversation is cut into keys of at most ``SEGMENT`` turns; a key starts with a name of all turns before it, as
wide as a turn. A task puts a bounded number of keys into one adaptive radix tree and gives a row for each node
at a turn's end, named by the chain of its turns; rows of a name from all trees are added up. So neither a
prefix that a third of all conversations share nor a conversation of any length comes into one task.

Sums over subtrees need no walk over levels. The least member of a node owns it, and owns what lies below it on
its own path; so one number for each conversation, the bytes before its first own node, says what it shares,
and a second run of the trees adds these up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import ordered
from .common import cut, streamed_sha256

#: bytes of a turn's id
WIDTH = 16
#: turns of a key, and keys and bytes of keys in one tree
SEGMENT = 64
TREE_KEYS, TREE_BYTES = 8192, 1 << 23
#: conversations in a row of those that end at a node
ENDS = 1 << 16
START = b"\0" * WIDTH


class Few:
    """Up to 4, then up to 16 children: their bytes side by side."""

    __slots__ = ("letters", "kids", "room")

    def __init__(self, room: int = 4):
        self.letters, self.kids, self.room = bytearray(), [], room

    def get(self, letter: int) -> Node | None:
        at = self.letters.find(letter)
        return self.kids[at] if at >= 0 else None

    def put(self, letter: int, kid: Node) -> Few | Indexed:
        if len(self.kids) == 16:
            grown = Indexed()
            for x, k in zip(self.letters, self.kids):
                grown.put(x, k)
            return grown.put(letter, kid)
        if len(self.kids) == self.room:
            self.room = 16
        self.letters.append(letter)
        self.kids.append(kid)
        return self


class Indexed:
    """Up to 48 children: a place for every byte says which."""

    __slots__ = ("places", "kids")

    def __init__(self):
        self.places, self.kids = bytearray(256), []

    def get(self, letter: int) -> Node | None:
        at = self.places[letter]
        return self.kids[at - 1] if at else None

    def put(self, letter: int, kid: Node) -> Indexed | Full:
        if len(self.kids) == 48:
            grown = Full()
            for x, at in enumerate(self.places):
                if at:
                    grown.put(x, self.kids[at - 1])
            return grown.put(letter, kid)
        self.kids.append(kid)
        self.places[letter] = len(self.kids)
        return self


class Full:
    """A child for any byte."""

    __slots__ = ("all",)

    def __init__(self):
        self.all: list[Node | None] = [None] * 256

    @property
    def kids(self) -> list[Node]:
        return [k for k in self.all if k is not None]

    def get(self, letter: int) -> Node | None:
        return self.all[letter]

    def put(self, letter: int, kid: Node) -> Full:
        self.all[letter] = kid
        return self


class Node:
    """What all keys below have in common after the parent's byte, the children, and the keys that end here."""

    __slots__ = ("path", "kids", "here")

    def __init__(self, path: bytes):
        self.path, self.kids, self.here = path, None, []

    def add(self, letter: int, kid: Node) -> None:
        self.kids = (self.kids or Few()).put(letter, kid)


def _common(a: bytes, b: bytes) -> int:
    """How many bytes at the start are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def insert(root: Node, key: bytes, row: tuple) -> None:
    node, at = root, 0
    while True:
        if not key.startswith(node.path, at):
            same = _common(node.path, key[at : at + len(node.path)])
            lower = Node(node.path[same + 1 :])
            lower.kids, lower.here = node.kids, node.here
            letter, node.path, node.kids, node.here = node.path[same], node.path[:same], None, []
            node.add(letter, lower)
        at += len(node.path)
        if at == len(key):
            node.here.append(row)
            return
        kid = node.kids.get(key[at]) if node.kids else None
        if kid is None:
            kid = Node(key[at + 1 :])
            kid.here.append(row)
            node.add(key[at], kid)
            return
        node, at = kid, at + 1


def in_order(root: Node) -> list[tuple[Node, int, int]]:
    """``node, its parent's place, bytes down to its end``; parents come first."""
    out, waiting = [], [(root, -1, len(root.path))]
    while waiting:
        node, parent, end = waiting.pop()
        out.append((node, parent, end))
        for kid in node.kids.kids if node.kids else ():
            waiting.append((kid, len(out) - 1, end + 1 + len(kid.path)))
    return out


# a row of a tree: key, conv_id, bytes of its turns, turns and bytes before it, name after it, whether it is the
# last of its conversation, and what its conversation shares and whether it owns a leaf
KEY, CONV, SIZES, TURNS, BEFORE, AFTER, LAST, SHARED, LEAF = range(9)


def turn_nodes(root: Node, segment: int) -> Iterator[tuple]:
    """``name, parent's name, depth, bytes of the last turn, bytes so far, rows below, rows that end here``.

    Rows below come as (how many, the least conv_id, its shared bytes, all shared bytes, leaves).
    """
    order = in_order(root)
    below: list[list] = []
    some: list[tuple | None] = []
    for node, _, _ in order:
        least = min(node.here, key=lambda r: r[CONV], default=None)
        some.append(least)
        below.append(
            [len(node.here), least and least[CONV], least and least[SHARED], sum(r[SHARED] for r in node.here), sum(r[LEAF] for r in node.here)]
        )
    for i in range(len(order) - 1, 0, -1):
        mine, up = below[i], below[order[i][1]]
        if up[1] is None or mine[1] < up[1]:
            up[1:3] = mine[1:3]
        up[0] += mine[0]
        up[3] += mine[3]
        up[4] += mine[4]
        some[order[i][1]] = some[order[i][1]] or some[i]
    reached: list[tuple] = []  # name, bytes so far and depth in bytes at the last turn's end of each node
    for i, (node, parent, end) in enumerate(order):
        row, name, total, at = some[i], *(reached[parent] if parent >= 0 else (None, 0, 0))
        while row and at + WIDTH <= end:
            at += WIDTH
            turn = at // WIDTH - 1
            if not turn:
                name, total = row[KEY][:WIDTH], row[BEFORE]
                if not row[TURNS]:
                    yield name, None, 0, 0, 0, below[i], node.here if at == end else []
                continue
            up, size = name, row[SIZES][turn - 1]
            name = row[AFTER] if turn == segment else sha256(up + row[KEY][at - WIDTH : at]).digest()[:WIDTH]
            total += size
            yield name, up, row[TURNS] + turn, size, total, below[i], node.here if at == end else []
        reached.append((name, total, at))


NODES = "name binary, parent binary, depth bigint, conv_id bigint, n_convs bigint, size bigint, total bigint, ends array<bigint>"
SUMS = "name binary, n_leaves bigint, saved_tokens bigint"


def _node_row(name, up, depth, size, total, below, here) -> tuple:
    return name, up, depth, below[1], below[0], size, total, [r[CONV] for r in here if r[LAST]]


def _sum_row(name, up, depth, size, total, below, here) -> tuple:
    before = total - size
    return name, below[4], below[3] - below[0] * before + max(0, before - below[2])


def _trees(keys: DataFrame, schema: str, row_of: Callable[..., tuple]) -> DataFrame:
    """One row for each node at a turn's end of each tree."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    segment, most_keys, most_bytes = SEGMENT, TREE_KEYS, TREE_BYTES

    def flush(root: Node) -> Iterator[pa.RecordBatch]:
        out = []
        for found in turn_nodes(root, segment):
            out.append(row_of(*found))
            if len(out) >= most_keys:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), types)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held, size = Node(b""), 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                key = r["start"] + b"".join(r["ids"])
                insert(root, key, (key, r["conv_id"], r["sizes"], r["turns"], r["before"], r["after"], r["last"], r["shared"], r["leaf"]))
                held, size = held + 1, size + len(key)
                if held == most_keys or size >= most_bytes:
                    yield from flush(root)
                    root, held, size = Node(b""), 0, 0
        if held:
            yield from flush(root)

    return keys.mapInArrow(rows, schema)


def turn_id(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, id, size``: the turns of each conversation from 0 on.

    They are ordered by turn, null first, then by role and text; a null role or text is empty. Rows without
    a conv_id belong to no conversation.
    """
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    ).where("conv_id IS NOT NULL")
    placed = ordered(rows, ["conv_id"], ["turn", "role", "text"], split="turn").scan(index="at").rows()
    return placed.select("conv_id", "at", turn_id(F.col("role"), F.col("text")).alias("id"), F.octet_length("text").cast("bigint").alias("size"))


def with_shared_openings(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of the first of their family; also those without any turn left.

    Conversation c takes the first h turns of conversation c - c % family (all if fewer, none if absent) and
    goes on with its own after its first h; h is the crc32 of c's decimal number % longest.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % longest
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"first": F.col("conv_id") - F.col("conv_id") % family, "h": h})
    heads = own.select(F.col("conv_id").alias("first"), F.col("n").alias("have"))
    convs = cut(own.join(heads, "first", "left").select("conv_id", "first", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")))
    opening = turns.where(F.col("at") < longest - 1).withColumnRenamed("conv_id", "first").join(convs, "first").where("at < h")
    rest = turns.join(convs, "conv_id").where("at >= h").withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "at", "id", "size"]
    return opening.select(*columns).union(rest.select(*columns)), convs.select("conv_id")


def _keys(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The keys of all conversations, one without turns too."""
    turn = F.struct("at", "id", "size")
    some = turns.select("conv_id", F.floor(F.col("at") / SEGMENT).alias("part"), turn.alias("t"))
    none = convs.select("conv_id", F.lit(0).cast("bigint"), F.lit(None).cast(some.schema["t"].dataType))  # not collected
    held = some.union(none).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("t"))
    held = held.select("conv_id", "part", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))
    bytes_here = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    full = F.size("ids") == SEGMENT
    weight = {f"w{s}": F.when(full, F.xxhash64(F.lit(s), "part", "ids")).otherwise(0).cast("decimal(38,0)") for s in (1, 2)}
    rows = held.withColumn("here", bytes_here).withColumns(weight)
    o = ordered(rows, ["conv_id"], ["part"], split="part")
    o = o.scan(sums={"upto": F.col("here"), "s1": F.col("w1"), "s2": F.col("w2")}, following={"next": F.lit(1)})

    def name(part: Column, one: Column, two: Column) -> Column:
        chained = F.unhex(F.substring(F.sha2(F.concat_ws(":", part, one, two), 256), 1, 2 * WIDTH))
        return F.when(part == 0, F.lit(START)).otherwise(chained)

    s1, s2 = F.col("s1"), F.col("s2")
    return o.rows().select(
        "conv_id", "ids", "sizes", (F.col("part") * SEGMENT).alias("turns"), (F.col("upto") - F.col("here")).alias("before"),
        name(F.col("part"), s1 - F.col("w1"), s2 - F.col("w2")).alias("start"),
        F.when(full, name(F.col("part") + 1, s1, s2)).alias("after"),
        F.col("next").isNull().alias("last"), "upto",
    )


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns, from the empty one on.

    ``turns`` (conv_id, at from 0 without gaps, id, size) and ``convs`` (conv_id, every conversation once). The
    columns: conv_id, the least member; depth; parent_conv_id, the parent's conv_id; n_convs, members; n_children;
    n_leaves, childless nodes of the subtree; saved_tokens, (members - 1) times the size of the last turn, summed
    over the subtree; ends_sha256, the digest of the ascending conv_ids that end there. No conversation, no row.
    """
    keys = cut(_keys(turns, convs))
    zero = F.lit(0).cast("bigint")
    parts = cut(_trees(keys.withColumns({"shared": zero, "leaf": zero}), NODES, _node_row))
    nodes = cut(
        parts.groupBy("name").agg(
            F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.min("size").alias("size"), F.min("total").alias("total"), F.sum(F.size("ends")).alias("n_ends"),
        )
    )
    owned = nodes.groupBy("conv_id").agg(F.min(F.col("total") - F.col("size")).alias("owned"), F.max((F.col("n_ends") == F.col("n_convs")).cast("bigint")).alias("leaf"))
    whole = keys.where("last").select("conv_id", F.col("upto").alias("whole"))
    shared = whole.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("owned", "whole").alias("shared"), F.coalesce("leaf", zero).alias("leaf")
    )
    sums = _trees(keys.join(shared, "conv_id"), SUMS, _sum_row)
    sums = sums.groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "name")
    ends = parts.select("name", F.explode("ends").alias("c")).groupBy("name", F.floor(F.col("c") / ENDS).alias("no"))
    ends = ends.agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("data"))
    digests = streamed_sha256(ends, "name", "no", "data", ",").withColumnRenamed("sha256", "ends_sha256")
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = nodes.join(sums, "name").join(children, "name", "left").join(digests, "name", "left").join(parents, "parent", "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
