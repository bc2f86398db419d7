"""Prefix trie of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from keysieve.llm import tries as T

TURNS = "conv_id long, turn long, role string, text string, seq string, container string, depth int"


def plain(rows):
    own = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv is not None:
            own.setdefault(conv, []).append((role or "", text or ""))
    members = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        whole = own.get(conv - conv % 5, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((conv, len(whole)))
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) or 1
        saved[node] = sum(saved[b] for b in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    least = {node: min(c for c, _ in held) for node, held in members.items()}
    ends = lambda node: ",".join(str(c) for c, n in sorted(members[node]) if n == len(node))
    return {
        (least[n], len(n), least[n[:-1]] if n else None, len(members[n]), len(children.get(n, [])), leaves[n], saved[n],
         hashlib.sha256(ends(n).encode()).hexdigest()) for n in members
    }


def got(spark, rows, limit=T.BURST):
    table = spark.createDataFrame([(*r, "s", "c", 1) for r in rows], TURNS).repartition(3)
    found = [tuple(r) for r in T.conversation_trie(table, limit).collect()]
    assert len(found) == len(set(found))
    return set(found)


def chats(seed, convs, longest, texts):
    rng = random.Random(seed)
    return [(c, i, rng.choice(["user", "assistant"]), f"t{rng.randrange(texts)}é") for c in range(convs) for i in range(rng.randrange(longest + 1))]


@pytest.mark.parametrize("limit", [1, 4, 512])
def test_containers_burst_at_any_size(spark, limit):
    rows = chats(1, 120, 7, 2)
    assert got(spark, rows, limit) == plain(rows)


def test_shared_turns_without_branches_take_no_round(spark):
    shared = [("user" if i % 2 else "assistant", f"turn {i}") for i in range(40)]
    rows = [(5 * c, i, role, text) for c in range(12) for i, (role, text) in enumerate([*shared, ("user", f"own {c}")])]
    rows += [(1000, i, role, text) for i, (role, text) in enumerate(shared[:25])]
    small, large = T.burst(T.different(T.rebuilt(T.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))), 5)
    assert large.count() == 2 and sorted(r.depth for r in small.collect()) == [41] * 12
    assert got(spark, rows, 5) == plain(rows)


def test_copies_nulls_ties_and_long_texts(spark):
    rows = [
        (None, 1, "user", "nobody's"), (3, None, None, None), (3, None, "user", None), (3, 2, "user", "x"), (3, 2, "user", "x"), (3, 2, "user", "a"),
        (7, 0, "user", "y" * 300_000), (8, 0, "user", "y" * 300_000), (9, 0, "usery", "y" * 299_999), (0, 0, "", ""),
    ]
    rows += [(c, i, "user", f"same {i}") for c in range(100, 160) for i in range(6)]
    assert got(spark, rows, 2) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    lone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "a"), (lone, 1, "assistant", "b")]
    ((conv, depth, parent, *rest),) = got(spark, rows)
    assert (conv, depth, parent) == (lone, 0, None) and rest == [1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest()]


def test_no_conversations_have_no_nodes(spark):
    assert got(spark, []) == set()
