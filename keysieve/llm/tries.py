"""Prefix trie of conversations, built as burst tries.

A turn becomes a number of 20 bytes (hash of role and text, and the text's length), a
conversation the array of its turns' numbers, and equal conversations one row. All start
in one container. A container of more than ``BURST`` different conversations is burst:
the turns that all of them share become trie nodes at once, and each conversation moves
to the container under its next turn. What is left are small containers of suffixes;
a task sorts them and sweeps over them with a stack of open nodes.

A round of bursting shuffles only rows of conversations that still share a large
container, pre-aggregates before it, and writes its result to the shared folder. As many
rounds are needed as a conversation meets branches with more than ``BURST`` different
continuations; shared turns without a branch cost none. Memory of a task is one small
container and one conversation's turn numbers.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.llm import common as K

#: Containers of more different conversations than this burst.
BURST = 512
#: Conversations share the first turns of the one whose id is the last multiple of this.
FAMILY = 5
#: A conversation shares less turns than this.
MOST_SHARED = 9
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = b"\0" * 16


def turn_number(role: Column, text: Column) -> Column:
    """20 bytes: half of a SHA-256 of role and text, and the number of UTF-8 bytes of the text."""
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.left(F.sha2(named, 256), F.lit(32)), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def _text_bytes(number: Column) -> Column:
    return F.conv(F.hex(F.substring(number, 17, 4)), 16, 10).cast("long")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its family's first one."""
    return F.crc32(conv_id.cast("string")) % MOST_SHARED


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): the turn numbers of every conversation as it stands."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    )
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), turn_number(F.col("role"), F.col("text")).alias("id"))
    listed = F.array_sort(F.collect_list(F.struct("at", "id")))
    return placed.groupBy("conv_id").agg(F.transform(listed, lambda t: t["id"]).alias("seq"))


def rebuilt(chats: DataFrame) -> DataFrame:
    """(conv_id, seq): the first turns of the family's first conversation, then the own turns after as many."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = chats.withColumns({"_first": first, "_h": shared_turns(F.col("conv_id")).cast("int")})
    heads = chats.where(F.col("conv_id") == first).select(
        F.col("conv_id").alias("_first"), F.slice("seq", 1, MOST_SHARED - 1).alias("_head")
    )
    none = F.array().cast("array<binary>")
    return own.join(heads, "_first", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h")),
        F.slice("seq", F.col("_h") + 1, F.size("seq")),
    ).alias("seq"))


def _streamed_ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per key of sorted (key, conv_id) rows: rows, least id and the digest of all ids."""
    now, out = None, []
    names = ["key", "n_convs", "least", "ends"]

    def ended() -> None:
        if now is not None:
            out.append((now[0], now[1], now[2], now[3].hexdigest()))

    for frame in frames:
        for key, conv in zip(frame["key"], frame["conv_id"]):
            if now is None or key != now[0]:
                ended()
                now = [key, 0, conv, hashlib.sha256()]
            else:
                now[3].update(b",")
            now[1] += 1
            now[3].update(str(conv).encode())
        if out:
            yield pd.DataFrame(out, columns=names)
            out = []
    ended()
    if out:
        yield pd.DataFrame(out, columns=names)


def different(chats: DataFrame) -> DataFrame:
    """(seq, n_convs, least, ends): equal conversations as one row; ids are streamed in order, never gathered."""
    key = F.unhex(F.left(F.sha2(F.array_join(F.transform("seq", F.hex), ""), 256), F.lit(32)))
    keyed = chats.withColumn("key", key)
    schema = "key binary, n_convs long, least long, ends string"
    counted = (
        keyed.select("key", F.col("conv_id").cast("long").alias("conv_id"))
        .repartition("key").sortWithinPartitions("key", "conv_id").mapInPandas(_streamed_ends, schema)
    )
    return counted.drop("key").join(chats.select(F.col("conv_id").cast("long").alias("least"), "seq"), "least")


def _common(low: Column, high: Column) -> Column:
    """How many first items two sorted arrays share."""
    same = F.zip_with(low, high, lambda a, b: a.eqNullSafe(b))
    at = F.array_position(same, False).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(low))


def burst(rows: DataFrame, limit: int = BURST) -> tuple[DataFrame, DataFrame | None]:
    """Small containers of conversations, and the ones that had to burst.

    Rows of the first: seq, n_convs, least, ends, container, depth (turns all of it
    share) and path (the burst containers above). Rows of the second: container, depth,
    path, n_convs, least, top (turn number of its first node), chain (numbers of the
    turns shared below that) and ends (of a conversation that ends after them).
    """
    live = K.settled(rows.select(
        "seq", "n_convs", "least", "ends", F.lit(_ROOT).alias("container"), F.lit(0).alias("depth"),
        F.array().cast("array<binary>").alias("path"),
    ))
    small, large = [], []
    while True:
        suffix = F.slice("seq", F.col("depth") + 1, F.size("seq"))
        counts = live.groupBy("container").agg(F.count(F.lit(1)).alias("rows"))
        big = K.settled(counts.where(F.col("rows") > limit).select("container"))
        if big.isEmpty():
            small.append(live)
            break
        small.append(live.join(big, "container", "left_anti").select(*live.columns))
        held = live.join(big, "container")
        found = K.settled(
            held.withColumn("suffix", suffix).groupBy("container", "depth", "path").agg(
                F.min("suffix").alias("low"), F.max("suffix").alias("high"), F.sum("n_convs").alias("n_convs"),
                F.min("least").alias("least"), F.min("seq").alias("one"),
            ).select(
                "container", "depth", "path", "n_convs", "least", F.get("one", F.col("depth") - 1).alias("top"),
                F.slice("low", F.lit(1), _common(F.col("low"), F.col("high"))).alias("chain"),
            )
        )
        at = held.join(found.select("container", F.size("chain").alias("shared")), "container")
        at = at.withColumn("at", F.col("depth") + F.col("shared"))
        ending = at.where(F.size("seq") == F.col("at")).select("container", "ends")
        large.append(K.settled(found.join(ending, "container", "left")))
        onward = F.get("seq", F.col("at"))
        live = K.settled(at.where(F.size("seq") > F.col("at")).select(
            "seq", "n_convs", "least", "ends", F.unhex(F.left(F.sha2(F.concat("container", onward), 256), F.lit(32))).alias("container"),
            (F.col("at") + 1).alias("depth"), F.array_append("path", F.col("container")).alias("path"),
        ))
    union = lambda tables: tables[0] if len(tables) == 1 else union([tables[0].unionByName(tables[1]), *tables[2:]])
    return union(small), union(large) if large else None


class _Node:
    """An open node of the sweep."""

    __slots__ = ("depth", "bytes", "n", "least", "children", "leaves", "saved", "ends", "below")

    def __init__(self, depth: int, size: int):
        self.depth, self.bytes, self.n, self.least = depth, size, 0, None
        self.children = self.leaves = self.saved = 0
        self.ends, self.below = NO_ENDS, []

    def take(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None or least < self.least else self.least


_NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top", "path"]
_NODE_TYPES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long,"
    " ends_sha256 string, top boolean, path array<binary>"
)


def _size(number: bytes) -> int:
    return int.from_bytes(number[16:20], "big")


def sweep(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Nodes of each container of sorted (container, depth, path, seq, n_convs, least, ends) rows."""
    stack: list[_Node] = []
    done: list[tuple] = []
    now, path, before = None, [], []

    def close(keep: int) -> None:
        while len(stack) > keep:
            node = stack.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.bytes
            # What hangs below waits for this node's smallest member.
            done.extend((*below[:2], node.least, *below[3:]) for below in node.below)
            own = (node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends, not stack, path)
            if stack:
                up = stack[-1]
                up.take(node.n, node.least)
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
                up.below.append(own)
            else:
                done.append(own)

    for container, depth, own_path, seq, n, least, ends in rows:
        if container != now:
            close(0)
            if done:
                yield done
                done = []
            now, path, before = container, own_path, []
            stack.append(_Node(depth, _size(seq[depth - 1]) if depth else 0))
        tail = seq[depth:]
        shared = 0
        while shared < len(before) and shared < len(tail) and before[shared] == tail[shared]:
            shared += 1
        close(shared + 1)
        stack.extend(_Node(depth + i + 1, _size(tail[i])) for i in range(shared, len(tail)))
        stack[-1].ends = ends
        stack[-1].take(n, least)
        before = tail
    close(0)
    if done:
        yield done


def _swept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for frame in frames:
            for container, depth, path, seq, n, least, ends in zip(*(frame[c] for c in ("container", "depth", "path", "seq", "n_convs", "least", "ends"))):
                yield container, depth, list(path), list(seq), int(n), int(least), ends

    held: list[tuple] = []
    for nodes in sweep(rows()):
        held.extend(nodes)
        if len(held) >= 5_000:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def _frame(nodes: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(nodes, columns=_NODES)
    return frame.astype({"parent_conv_id": "Int64"})


def _burst_nodes(large: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the burst containers: one for the top and one for each turn that all of a container share."""
    numbers = F.concat(F.array("top"), F.col("chain"))
    sizes = F.transform(numbers, lambda b: F.coalesce(_text_bytes(b), F.lit(0).cast("long")))
    own = large.withColumn("sizes", sizes)
    whole = (F.col("n_convs") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    above = F.explode("path").alias("container")
    zero = F.lit(0).cast("long")
    nearest = F.element_at("path", -1)
    below = (
        tops.select("saved_tokens", "n_leaves", nearest.alias("parent"), above)
        .unionByName(own.where(F.size("path") > 0).select(whole.alias("saved_tokens"), zero.alias("n_leaves"), nearest.alias("parent"), above))
        .groupBy("container").agg(
            F.sum("saved_tokens").alias("saved"), F.sum("n_leaves").alias("leaves"),
            F.count_if(F.col("parent") == F.col("container")).alias("children"),
        )
    )
    parents = large.select(F.col("container").alias("_up"), F.col("least").alias("_up_least"))
    up = F.when(F.size("path") > 0, F.element_at("path", -1))
    rest = F.sum("size").over(Window.partitionBy("container").orderBy(F.desc("at")))
    first, last = F.col("at") == 0, F.col("at") == F.col("shared")
    return (
        own.join(below, "container").join(parents, up == F.col("_up"), "left")
        .select("container", "depth", "least", "n_convs", "leaves", "children", "saved", "ends", "_up_least",
                F.size("chain").alias("shared"), F.posexplode("sizes").alias("at", "size"))
        .select(
            F.col("least").alias("conv_id"), (F.col("depth") + F.col("at")).cast("long").alias("depth"),
            F.when(first, F.col("_up_least")).otherwise(F.col("least")).alias("parent_conv_id"), "n_convs",
            F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
            F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        )
    )


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(chats: DataFrame, limit: int = BURST) -> DataFrame:
    """One row per node of the prefix trie of ``chats`` (conv_id, seq), from the root at depth 0.

    conv_id is the node's smallest member, parent_conv_id that of its parent (the
    root: null). ends_sha256 is the digest of the ids that end there, in numeric order.
    No conversations have no nodes, not even a root; conversations without turns end
    at the root. Ids are unique; ids other than long are read as long.
    """
    small, large = burst(different(chats), limit)
    with K.small_batches(chats.sparkSession):
        swept = K.settled(
            small.repartition("container").sortWithinPartitions("container", "seq").mapInPandas(_swept, _NODE_TYPES)
        )
    if large is None:
        return swept.select(*RESULT)
    tops = swept.where("top")
    parents = large.select(F.col("container").alias("_up"), F.col("least").alias("_up_least"))
    nearest = F.when(F.col("top") & (F.size("path") > 0), F.element_at("path", -1))
    inner = swept.where(~F.col("top")).select(*RESULT)
    hung = tops.join(parents, nearest == F.col("_up"), "left").withColumn("parent_conv_id", F.col("_up_least")).select(*RESULT)
    return inner.unionByName(hung).unionByName(_burst_nodes(large, tops).select(*RESULT))


def conversation_trie(turns: DataFrame, limit: int = BURST) -> DataFrame:
    """The trie of rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    Null turns come first, equal turns are ordered by role and text; repeated rows are
    turns of their own. Null roles and texts are empty. Rows without a conv_id belong to
    no conversation and are left out. Further columns are ignored. A conversation is
    one row of 20 bytes a turn, so its texts may be of any length.
    """
    return trie(K.settled(rebuilt(K.settled(conversations(turns)))), limit)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
