"""Substring dedup by compacting a De Bruijn graph of tokens.

The edges of the graph are the k-word windows of all documents; an edge runs from its
first k - 1 words to its last. What is wanted are the edges that occur twice or more.

A document is a path. It is cut into stretches of windows that have the same minimiser
(the least hash of the ``anchor``-word runs in the window): the minimiser depends on the
window alone, so equal edges always lie in stretches of the same anchor. A stretch is a
path compacted before anything is shuffled; it is told by one hash of all its words.

1. Anchors that occur at one place only hold no repeated edge; they end here.
2. If all stretches of an anchor are equal, the path is nonbranching and repeated: its
   occurrences are joined to it as they are, without looking at single edges.
3. Where stretches of an anchor differ, or one runs through its anchor twice, the
   graph branches. Equal ones are compacted to
   one path with a count; those that count twice are repeated. One copy of each
   is opened into its edges, the edges are counted, and the repeated ones are joined
   back to the stretches that occur once.
4. The repeated stretches and edges of a document, as coordinates, make up its long
   repeated spans. The words at the coordinates are hashed once more and must agree
   with the joined paths before they are removed.

Hot anchors and paths meet as counts (combined before the shuffle) and as joins with one
row on the other side, which are split where they are skewed; nothing pairs two
occurrences. Two 64-bit hashes, of the anchor and of the path or edge, tell windows apart.

Defined cases: null and empty texts have no words; texts of fewer than k words keep all;
a window may overlap its own copy; rows equal in id and text are copies of one another;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.llm.common import keyed, same_document
from parzelle.llm.windows import Sums, sliding_min, window_starts
from parzelle.llm.words import SPACES, batches, texts_of
from parzelle.session import materialize

K = 35
ANCHOR = 10


def _stretches(k: int, anchor: int):
    """``doc_id, digest, at, n, anchor, path, loops``: stretches of n windows from ``at``."""
    def run(tables):
        for rows in tables:
            for batch in batches(texts_of(rows), k - 1):
                start, text = window_starts(batch, k)
                if not len(start):
                    continue
                grams, width = Sums(batch, 1).every(anchor), k - anchor + 1
                least = sliding_min(grams, width)[start]
                new = np.flatnonzero(np.concatenate(
                    [[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
                n = np.diff(np.concatenate([new, [len(start)]]))
                path = Sums(batch, 2).runs(start[new], n + (k - 1))
                # the minimiser at two places: the stretch may repeat an edge itself
                place = np.arange(width)
                lows = least[new][:, None]
                begin, end = start[new], start[new] + n - 1
                left = (grams[begin[:, None] + place] == lows).argmax(1) + begin
                right = end + width - 1 - (grams[end[:, None] + place[::-1]] == lows).argmax(1)
                of = text[new]
                at = start[new] - batch.offsets[of] + batch.first[of]
                row = pa.array(batch.rows[of])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(row), rows.column("digest").take(row),
                     pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(least[new].view(np.int64)), pa.array(path.view(np.int64)),
                     pa.array(left != right)],
                    ["doc_id", "digest", "at", "n", "anchor", "path", "loops"])
    return run


def _edges(k: int):
    """``anchor, edge, doc_id, digest, at, repeated`` of every edge of the stretches
    ``parts`` that come with a text."""
    def run(tables):
        for rows in tables:
            parts = rows.column("parts").to_pylist()
            for batch in batches(texts_of(rows), k - 1):
                sums = Sums(batch, 2)
                out = []
                for i, row in enumerate(batch.rows.tolist()):
                    base = int(batch.offsets[i]) - int(batch.first[i])
                    low, high = int(batch.offsets[i]), int(batch.offsets[i + 1]) - k
                    for p in parts[row]:
                        start = np.arange(max(base + p["at"], low),
                                          min(base + p["at"] + p["n"], high + 1))
                        out.append((start, row, p, start - base))
                if not out:
                    continue
                start = np.concatenate([o[0] for o in out])
                size = [len(o[0]) for o in out]
                row = pa.array(np.repeat([o[1] for o in out], size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([o[2]["anchor"] for o in out], np.int64), size)),
                     pa.array(sums.runs(start, k).view(np.int64)),
                     rows.column("doc_id").take(row), rows.column("digest").take(row),
                     pa.array(np.concatenate([o[3] for o in out]).astype(np.int32)),
                     pa.array(np.repeat([o[2]["repeated"] for o in out], size))],
                    ["anchor", "edge", "doc_id", "digest", "at", "repeated"])
    return run


def covered_words(text: bytes, spans, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, and which of them the spans cover.

    A span (at, n) is n windows of k words from word ``at``.
    """
    raw = np.frombuffer(text, np.uint8)
    space = SPACES[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    change = np.zeros(len(starts) + 1, np.int64)
    for at, n in spans:
        change[at] += 1
        change[at + n + k - 1] -= 1
    return starts, ends, np.cumsum(change[:-1]) > 0


def _removed(k: int):
    def run(tables):
        for rows in tables:
            n_words, n_removed, digests = [], [], []
            checked = _checker(rows, k)
            for i, text in enumerate(texts_of(rows)):
                text = text or b""
                starts, ends, gone = covered_words(text, checked(i), k)
                kept = np.flatnonzero(~gone)
                if len(kept) == len(starts):
                    rest = b" ".join(text.split())
                else:
                    rest = b" ".join(text[a:b] for a, b in zip(
                        starts[kept].tolist(), ends[kept].tolist(), strict=True))
                n_words.append(len(starts))
                n_removed.append(len(starts) - len(kept))
                digests.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def _checker(rows: pa.RecordBatch, k: int):
    """The spans of a row, after a look at the words at their coordinates."""
    spans = rows.column("spans").to_pylist()
    wanted = [[s for s in spans[i] or () if s["path"] is not None] for i in range(rows.num_rows)]
    texts = [t if w else b"" for t, w in zip(texts_of(rows), wanted, strict=True)]
    longest = max((s["n"] for w in wanted for s in w), default=0) + k - 1
    bad = set()
    for batch in batches(texts, longest):
        sums = None
        for i, row in enumerate(batch.rows.tolist()):
            base = int(batch.offsets[i]) - int(batch.first[i])
            here = [s for s in wanted[row] if int(batch.offsets[i]) <= base + s["at"]
                    and base + s["at"] + s["n"] + k - 1 <= int(batch.offsets[i + 1])]
            if here:
                sums = sums or Sums(batch, 2)
                start = np.array([base + s["at"] for s in here])
                size = np.array([s["n"] + k - 1 for s in here])
                if (sums.runs(start, size).view(np.int64) != [s["path"] for s in here]).any():
                    bad.add(row)
    if bad:
        raise ValueError(f"{len(bad)} documents changed while they were read")
    return lambda i: [(s["at"], s["n"]) for s in spans[i] or ()]


def repeated_spans(docs: DataFrame, k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, digest, at, n, path``: n windows from word ``at`` that also start
    elsewhere. ``path`` is the hash of the stretch, null for single edges."""
    texts = keyed(docs)
    types = {f.name: f.dataType.simpleString() for f in texts.schema}
    who = f"doc_id {types['doc_id']}, digest long"
    stretches = texts.mapInArrow(
        _stretches(k, anchor), f"{who}, at int, n int, anchor long, path long, loops boolean")
    anchors = materialize(
        stretches.groupBy("anchor").agg(F.count("*").alias("c"), F.min("path").alias("a"),
                                        F.max("path").alias("b"), F.max("loops").alias("loops"))
        .where("c > 1 or loops")
        .select("anchor", (F.col("loops") | (F.col("a") != F.col("b"))).alias("branching")), "anchors")
    found = materialize(stretches.drop("loops").join(anchors, "anchor"), "stretches")
    straight = found.where("not branching")
    branching = found.where("branching")
    one = F.min(F.struct("doc_id", "digest", "at"))
    paths = materialize(branching.groupBy("anchor", "path", "n").agg(
        F.count("*").alias("c"), one.alias("one")), "paths")
    again = branching.join(paths.where("c > 1").select("anchor", "path", "n"),
                           ["anchor", "path", "n"], "left_semi")
    part = F.struct(F.col("one.at").alias("at"), "n", "anchor", (F.col("c") > 1).alias("repeated"))
    parts = paths.groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.digest").alias("digest")
                          ).agg(F.collect_list(part).alias("parts"))
    edges = same_document(texts, parts, "inner").mapInArrow(
        _edges(k), f"anchor long, edge long, {who}, at int, repeated boolean")
    # written, so that the join below can split an edge that very many documents share
    twice = materialize(
        edges.groupBy("anchor", "edge")
        .agg(F.count("*").alias("c"), F.max("repeated").alias("repeated"))
        .where("c > 1 or repeated").select("anchor", "edge"), "edges")
    single = (edges.where("not repeated").join(twice, ["anchor", "edge"])
              .select("doc_id", "digest", "at", F.lit(1).alias("n"),
                      F.lit(None).cast("long").alias("path")))
    spans = ["doc_id", "digest", "at", "n", "path"]
    return straight.select(*spans).union(again.select(*spans)).union(single)


def remove_repeats(docs: DataFrame, k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document."""
    spans = (repeated_spans(docs, k, anchor).groupBy("doc_id", "digest")
             .agg(F.collect_set(F.struct("at", "n", "path")).alias("spans")))
    joined = same_document(keyed(docs), spans, "left")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        _removed(k), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
