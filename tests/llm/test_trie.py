from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from motes.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_turns(rows):
    """Conversation -> turns in order; ties by the digest of the turn."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is None:
            continue
        role, text = role or "", text or ""
        said = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        by[c].append(((turn is not None, turn or 0), said, (role, text)))
    return {c: [t[2] for t in sorted(ts)] for c, ts in by.items()}


def plain_trie(conversations):
    """Every prefix by itself: conversation id -> turns in order."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in cs if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(kids), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in df.select(*names).collect())


def rows_of(*conversations):
    return [(c, i, "user" if i % 2 == 0 else "bot", t) for c, ts in conversations for i, t in enumerate(ts)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        rows_of((3, ["a b"])),
        rows_of((1, ["a", "b c", "d"]), (2, ["a", "b c", "e f g"]), (3, ["a"]), (4, ["a", "b c", "d"]), (5, ["x"]), (-7, ["a", "b c", "d", "e", "f"])),
        rows_of(*[(i, ["same opening"] * 3 + [f"t{i % 4}"] * (i % 6)) for i in range(40)]),
        # null and equal turns, null roles and texts, repeated rows, ids that are null
        [(1, None, None, None), (1, None, "user", "x"), (1, 2, "user", ""), (1, 2, "user", ""), (2, 0, "", ""), (2, 1, "user", "x"), (None, 1, "user", "lost"), (2, 1, None, "x\ty")],
    ],
)
def test_trie(spark, rows):
    turns = pt.turn_digests(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found(pt.prefix_trie(turns)) == Counter(plain_trie(plain_turns(rows)))


def test_conversations_without_turns_end_at_the_root(spark):
    rows = rows_of((1, ["a"]), (2, ["b"]))
    turns = pt.turn_digests(spark.createDataFrame(rows, SCHEMA))
    others = spark.createDataFrame([(2,), (9,), (5,), (None,)], "conv_id long")
    assert found(pt.prefix_trie(turns, others)) == Counter(plain_trie(plain_turns(rows) | {9: [], 5: []}))


def test_a_long_conversation_takes_no_rounds(spark):
    """A third of all turns are one conversation, another third copies of one, which all share an opening."""
    rows = rows_of((0, ["hi", *[f"w{i} x" for i in range(300)]]), *[(i, ["hi", "same", "end"]) for i in range(1, 101)], *[(i, ["hi", f"own {i}"]) for i in range(200, 350)])
    clashing = {"node": F.lit("n"), "path": F.lit(1), "words": F.lit("w"), "place": F.lit(0)}
    turns = pt.turn_digests(spark.createDataFrame(rows, SCHEMA).withColumns(clashing))
    got = pt.prefix_trie(turns)
    assert found(got) == Counter(plain_trie(plain_turns(rows)))
