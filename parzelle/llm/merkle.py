"""Merkle manifest of a dataset by checkpoint and recompute.

Every row is a leaf, the hash of its fields. The leaves of a tree stand in order, and while
several nodes remain each run of ``FAN`` consecutive ones becomes their hash; the trees' roots
are the leaves of one more tree, whose root stands for the dataset.

Only every ``KEPT``-th level is stored. A stored row is an aligned block of up to
``FAN ** KEPT`` (512) nodes with the place of the block, so a level is a table 1/512 as long
as the one below, and a block is all a task needs for what lies between it and its node on
the next stored level. Proofs are extracted from the top down: a block meets the proof of its
own node, the missing interior nodes of its subtree are hashed again from the stored ones, each
node gets its siblings at those levels followed by the block's proof, and the interior nodes
are gone with the row. No interior node is stored, and what is joined is blocks, not leaves.

The places come from ranges of the order dealt over all tasks, so one tree may hold all rows.
A tree of n leaves takes ceil(log(n) / log(512)) stored levels: four for 68 billion.

Defined cases: null fields are hashed as ``-``, which no value is; null trees (``lang``) and
null ids stand first; rows equal in id are ordered by their leaf, rows equal in all fields are
leaves of their own and interchangeable; a lone leaf is its tree's root, with an empty proof; an
empty table has no root and no rows. Texts of any length are hashed whole. Extra columns don't
take part and can't clash, as no other column of the input is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parzelle.llm.common import let
from parzelle.operators.grouping import with_position
from parzelle.session import materialize

FAN = 8
#: Levels from one stored level to the next; a block has ``FAN ** KEPT`` nodes at most.
KEPT = 3
BLOCK = FAN ** KEPT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_of(*values: Column) -> Column:
    """The hash of fields, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text),
                          F.lit("-"))
    return sha256(*(field(v) for v in values))


def _hash_runs(nodes: Column) -> Column:
    """The next level: the hash of each run of ``FAN`` nodes."""
    last = F.floor((F.size(nodes) - 1) / FAN).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(
        F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def _within(nodes: Column, n: Column, body) -> Column:
    """``body(levels)`` with the levels of a block's subtree below its top, hashed once each.

    ``n`` is how many nodes the tree has on the block's level: it says how many levels are
    left. A level that the tree doesn't have is the one below it, unchanged.
    """
    def climb(level: Column, least: int, levels: list[Column]) -> Column:
        if len(levels) == KEPT:
            return body([*levels, level])
        up = F.when(n > least, _hash_runs(level)).otherwise(level)
        return let(up, lambda x: climb(x, least * FAN, [*levels, level]))
    return let(nodes, lambda x: climb(x, 1, []))


def _siblings(levels: list[Column], n: Column, j: Column) -> Column:
    """The siblings left and right of the block's node ``j`` and of the nodes above it."""
    steps, at, least = [], j, 1
    for level in levels[:KEPT]:
        first = at - at % FAN
        step = F.struct(
            F.array_join(F.slice(level, first + 1, at - first), "").alias("left"),
            F.array_join(F.slice(level, at + 2, first + FAN - 1 - at), "").alias("right"))
        steps.append(F.when(n > least, step))
        at, least = F.floor(at / FAN).cast("int"), least * FAN
    return F.array_compact(F.array(*steps))


def _stored(nodes: DataFrame, longest: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of trees and their roots ``(tree, node)``.

    ``nodes`` are ``tree, place, node, n`` (n: nodes of the tree on this level) and, with
    the lowest level, the columns that the leaves carry along.
    """
    kept, level = [], nodes
    while True:
        row = F.struct("place", "node", *(carried if not kept else []))
        blocks = materialize(
            level.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block"))
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(row)).alias("rows")),
            f"merkle-{len(kept)}")
        kept.append(blocks)
        top = _within(F.transform("rows", lambda r: r["node"]), F.col("n"),
                      lambda levels: F.get(levels[-1], 0))
        level = blocks.select("tree", F.col("block").alias("place"), top.alias("node"),
                              F.ceil(F.col("n") / BLOCK).alias("n"))
        longest = -(-longest // BLOCK)
        if longest <= 1:
            return kept, materialize(level.select("tree", "node"), "merkle-roots")


def _below(blocks: DataFrame, above: DataFrame, out) -> DataFrame:
    """A row for each node of a stored level from the proofs of the level above it
    (``tree, place, path, *more``): ``out(row, path)`` gives its columns."""
    a = above.withColumnsRenamed({"tree": "__tree", "place": "__place"})
    met = blocks.join(a, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__place")))
    more = [c for c in above.columns if c not in ("tree", "place", "path")]
    made = _within(
        F.transform("rows", lambda r: r["node"]), F.col("n"), lambda levels: F.transform(
            "rows", lambda r, j: let(F.concat(_siblings(levels, F.col("n"), j), F.col("path")),
                                     lambda path: out(r, path))))
    return met.select("tree", *more, F.inline(made))


@dataclass
class Manifest:
    """The stored levels of a dataset's trees (lowest first) and of the tree over their roots.

    ``trees``: ``tree, node`` (the subroot) in the trees' order; ``root`` is null without rows.
    """

    levels: list[DataFrame]
    trees: DataFrame
    top: list[DataFrame]
    root: str | None


def build(leaves: DataFrame, tree: str, order: str, carried: list[str]) -> Manifest:
    """The manifest of ``leaves`` (a written table): column ``leaf``, trees told apart by
    the column ``tree`` and ordered by it, leaves in the order of the column ``order``.

    ``carried`` columns stand beside their leaf on the lowest stored level.
    """
    # equal rows are dealt over several tasks by the last key; they are interchangeable
    placed = with_position(leaves.withColumn("__salt", F.monotonically_increasing_id()),
                           [tree], [order, "leaf", "__salt"], "place")
    counts = materialize(leaves.groupBy(F.col(tree).alias("__name")).agg(F.count("*").alias("n")),
                         "merkle-counts")
    trees = materialize(with_position(counts, [], ["__name"], "tree"), "merkle-trees")
    sizes = trees.agg(F.count("*").alias("trees"), F.max("n").alias("longest")).first()
    nodes = placed.join(trees, placed[tree].eqNullSafe(F.col("__name"))).select(
        "tree", "place", F.col("leaf").alias("node"), "n", *carried)
    levels, roots = _stored(nodes, sizes["longest"] or 0, carried)
    over = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "node",
                        F.lit(sizes["trees"]).cast("long").alias("n"))
    top, root = _stored(over, sizes["trees"], [])
    found = root.first()
    return Manifest(levels, roots, top, found and found["node"])


def _path_only(row: Column, path: Column) -> Column:
    return F.struct(row["place"].alias("place"), path.alias("path"))


def proofs(manifest: Manifest, out) -> DataFrame:
    """A row for each leaf: ``subroot`` and what ``out(row, path)`` makes of the leaf's
    stored row (``place, node`` and what it carries) and its proof.

    A proof is an array of ``left`` and ``right``: the siblings' digests, put together, on each
    level from the leaf up to the root of the dataset.
    """
    spark = manifest.trees.sparkSession
    paths = spark.range(1).select(F.col("id").alias("tree"), F.lit(0).cast("long").alias("place"),
                                  F.array().cast(PATH).alias("path"))
    for blocks in reversed(manifest.top):
        paths = _below(blocks, paths, _path_only).select("tree", "place", "path")
    above = (paths.drop("tree").withColumnRenamed("place", "tree").join(manifest.trees, "tree")
             .select("tree", F.lit(0).cast("long").alias("place"), "path",
                     F.col("node").alias("subroot")))
    for blocks in reversed(manifest.levels[1:]):
        above = _below(blocks, above, _path_only)
    return _below(manifest.levels[0], above, out).drop("tree")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by a proof."""
    return F.aggregate(path, leaf, lambda node, step: sha256(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a proof, from the leaf up and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verify(docs: DataFrame, shown: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    The manifest and its proofs are of the documents as they are; ``shown`` is the text
    that is presented with the proof, by which ``folded_root`` is worked out.
    """
    others = [F.col(c) for c in FIELDS[:-1]]
    leaf = leaf_of(*others, F.col("text"))
    same = shown.eqNullSafe(F.col("text"))
    leaves = materialize(docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(
        ~same, leaf_of(*others, shown)).alias("shown")), "merkle-leaves")
    manifest = build(leaves, "lang", "doc_id", ["doc_id", "shown"])
    root = F.lit(manifest.root).cast("string")
    rows = proofs(manifest, lambda row, path: F.struct(
        row["doc_id"].alias("doc_id"), row["node"].alias("leaf"),
        proof_digest(path).alias("proof_sha256"),
        folded(F.coalesce(row["shown"], row["node"]), path).alias("folded_root")))
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256",
                       "folded_root", (F.col("folded_root") == root).alias("verified"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered() -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the id; null stays."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
