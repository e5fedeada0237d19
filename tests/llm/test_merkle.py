from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from motes.llm import merkle as mk
from tests.llm.helpers import awkward, nothing

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def plain_tree(leaves):
    """Root and, for each leaf, the siblings from the leaf up."""
    ways = [[] for _ in leaves]
    at = list(range(len(leaves)))
    nodes = leaves
    while len(nodes) > 1:
        for i, p in enumerate(at):
            if p ^ 1 < len(nodes):
                ways[i].append(nodes[p ^ 1])
            at[i] = p // 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], ways


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups["" if r["lang"] is None else "+" + r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    tops = {g: plain_tree([x[2] for x in sorted(ls)]) for g, ls in groups.items()}
    order = sorted(groups, key=str.encode)
    root, upper = plain_tree([tops[g][0] for g in order])
    out = []
    for g, more in zip(order, upper, strict=True):
        for (_, _, leaf), way in zip(sorted(groups[g]), tops[g][1], strict=True):
            out.append((leaf, tops[g][0], root, tuple(way + more)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_sweeps(n):
    leaves = [h(str(i)) for i in range(n)]
    nodes, levels = mk.sweep(leaves, 12)
    root, ways = plain_tree(leaves)
    assert nodes == [root]
    for leaf, way, (siblings, sides) in zip(leaves, ways, mk.proofs(leaves, levels), strict=True):
        assert siblings == way and len(sides) == levels
        assert mk.fold(leaf, siblings, sides) == root and mk.fold(h("x"), siblings, sides) != root


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest(spark, levels):
    """Small blocks take several rounds; null and repeated ids, groups of one and of hundreds."""
    rows = [(i, f"t{i}", lang, None if i % 5 else "s", i) for lang, m in [("de", 1), ("en", 2), ("fr", 37), (None, 5), ("é", 3), ("", 9)] for i in range(m)]
    rows += [(None, "x", "fr", "s", None), (7, "y", "fr", None, 3), (7, "y", "fr", None, 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = plain_manifest([r.asDict() for r in df.collect()])
    found = mk.manifest(df.repartition(5), COLUMNS, "lang", ["doc_id"], deep=levels)
    got = found.collect()
    assert Counter((r.digest, r.subroot, r.root, tuple(r.siblings)) for r in got) == Counter(expected)
    checked = mk.folded(found, F.when(F.col("row.doc_id") == 7, F.lit("0")).otherwise(F.col("digest")), ["row", "root"]).collect()
    assert all((r.folded_root == r.row.root) == (r.row.row.doc_id != 7) for r in checked)


def test_a_hot_group(spark):
    """A third of all rows are one row; another group has the rest, over many ranges."""
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"),
    )
    expected = plain_manifest([r.asDict() for r in df.collect()])
    got = mk.manifest(df, COLUMNS, "lang", ["doc_id"]).collect()
    assert Counter((r.digest, r.subroot, r.root, tuple(r.siblings)) for r in got) == Counter(expected)


def test_awkward(spark):
    df = awkward(spark)
    expected = plain_manifest([r.asDict() for r in df.collect()])
    got = mk.manifest(df, COLUMNS, "lang", ["doc_id"], keep=df.columns).collect()
    assert Counter((r.digest, r.subroot, r.root, tuple(r.siblings)) for r in got) == Counter(expected)
    assert {r.row.label for r in got} == {"l"}
    assert mk.manifest(nothing(spark), COLUMNS, "lang", ["doc_id"]).count() == 0
