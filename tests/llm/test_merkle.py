"""The Merkle manifest against a plain recursive one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parzelle.llm import merkle
from tests.llm.conftest import SCHEMA


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root and, for each node, its siblings as (left, right) from the bottom up."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, members in enumerate(below):
            run = i - i % 8
            step = ("".join(nodes[run:i]), "".join(nodes[i + 1:run + 8]))
            for m in members:
                paths[m].append(step)
        below = [sum(below[i:i + 8], []) for i in range(0, len(nodes), 8)]
        nodes = [sha(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    upper = str.maketrans(merkle.UPPER, merkle.UPPER.lower())
    trees = {}
    for r in rows:
        trees.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    roots, parts = [], []
    for name in sorted(trees):
        own = sorted(trees[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subroot, paths = tree([leaf(r, r[1]) for r in own])
        roots.append(subroot)
        parts.append((own, paths))
    if not roots:
        return []
    root, tops = tree(roots)
    out = []
    for subroot, (own, paths), top in zip(roots, parts, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            path = path + top
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(upper)
            node = leaf(r, text)
            for left, right in path:
                node = sha(left, node, right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha(*(a + b for a, b in path)), node,
                        node == root))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def check(df, rows):
    got = sorted((tuple(r) for r in merkle.verify(df, merkle.tampered()).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def test_edge_rows(spark, edge):
    got = check(edge, [tuple(r) for r in edge.collect()])
    assert {r[6] for r in got} == {True}  # nothing there is in capital letters where 3 divides


def test_empty_and_clashing(spark, empty, clashing, edge):
    assert merkle.verify(empty, merkle.tampered()).collect() == []
    plain = merkle.verify(edge, merkle.tampered()).collect()
    own = clashing.withColumns({c: F.lit("own") for c in ("tree", "leaf", "__salt", "n", "place", "root")})
    assert sorted(map(tuple, merkle.verify(own, merkle.tampered()).collect()), key=key) == \
        sorted(map(tuple, plain), key=key)


@pytest.mark.parametrize("sizes", [(1,), (8, 9, 1), (64, 65, 63), (512, 513, 7), (4200, 600, 3)])
def test_trees_of_many_sizes(spark, sizes):
    rows, doc = [], 0
    for lang, n in zip(("de", None, "en"), sizes, strict=False):
        for _ in range(n):
            doc += 1
            rows.append((doc * 7 % 10_007, f"Text {doc}" if doc % 11 else None, lang,
                         None if doc % 5 == 0 else "Quelle", doc if doc % 7 else None))
    rows += rows[:3] if len(rows) > 3 else []  # repeated rows
    got = check(spark.createDataFrame(rows, SCHEMA), rows)
    if len(rows) > 50:
        assert {r[6] for r in got} == {True, False}


def test_many_trees(spark):
    rows = [(i, "A", f"l{i % 700:03}", "s", 1) for i in range(900)]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_only_every_third_level_is_stored(spark):
    frame = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang"),
                                      F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    made = merkle.build(frame, "lang", "doc_id", [])
    # 5,000 leaves, 10 blocks; the 12 interior levels' nodes between are nowhere
    assert [level.count() for level in made.levels] == [10, 1]
    assert [level.select(F.sum(F.size("rows"))).first()[0] for level in made.levels] == [5_000, 10]
    assert made.root == tree([sha(str(i)) for i in range(5_000)])[0]
