"""SimHash near-dedup with Golay-code keys.

A document's fingerprint has a bit set where more than half of its shingles' hashes
have it. Two fingerprints link if they differ in at most four bits. Candidates are
found by cutting the 64 bits into three segments and reading each as a word of the
binary Golay code, in which every 23-bit word lies within three bits of exactly one
codeword:

* If a segment has no differing bit, both decode to the same codeword with the same
  error pattern: the whole segment is the key.
* Otherwise each segment differs, four bits in all, so two of the three differ in one
  bit only. Two words one bit apart always share a codeword between the nearest one of
  the first and the codewords within four bits of the second (there are six of those
  if the nearest is three bits away, else one). So a pair of segments is filed under
  one pair of codewords and looked up under up to 36.

Every link differing in 1 to 4 bits has such a key; candidates are verified in the
join. Equal fingerprints are one node, so copies make no pairs.

Defined cases: null and empty texts have no words and fingerprint 0, linked like any
other; texts of fewer words than a shingle have one shingle, the whole sequence;
texts of any length are read whole. A component's id is its smallest non-null ``doc_id``
(null if it has none). Rows equal in id and text have the same component; ``keep_one``
leaves one of them. An empty table gives no rows. Other columns are kept by ``keep_one``,
whatever their names, and not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.llm import graph
from parzelle.llm.common import free_name
from parzelle.llm.words import Batch, batches, texts_of, xxh64
from parzelle.session import materialize

SHINGLE = 4
MAX_BITS = 4
#: Bits of the three segments, from the lowest.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xAE3


def _add_bits(batch: Batch, shingle: int, counts: np.ndarray, totals: np.ndarray) -> None:
    """Add the shingles of a batch to the bit counts and shingle counts of its rows."""
    words = np.diff(batch.offsets)
    # one window a shingle; a whole short text (only uncut ones are) is one as well
    windows = np.where((words > 0) & (words < shingle) & (batch.first == 0), 1,
                       np.maximum(words - shingle + 1, 0))
    piece = np.repeat(np.arange(len(words)), windows)
    begin = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin += batch.offsets[piece]
    end = np.minimum(begin + shingle, batch.offsets[piece + 1]) - 1
    hashes = xxh64(batch.buffer, batch.starts[begin], batch.ends[end])
    edges = np.cumsum(windows)
    for i in np.flatnonzero(windows):
        part = hashes[edges[i] - windows[i]:edges[i]]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts[batch.rows[i]] += bits.sum(0, dtype=np.int64)
    np.add.at(totals, batch.rows, windows)


def _fingerprints(shingle: int):
    def run(tables):
        for rows in tables:
            counts = np.zeros((rows.num_rows, 64), np.int64)
            totals = np.zeros(rows.num_rows, np.int64)
            # A-Z only: bytes.lower leaves all others
            for batch in batches((t and t.lower() for t in texts_of(rows)), shingle - 1):
                _add_bits(batch, shingle, counts, totals)
            bits = np.packbits(2 * counts > totals[:, None], axis=1)
            prints = bits.view(">u8").ravel().astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in rows.schema.names if c != "text"), pa.array(prints)],
                [*(c for c in rows.schema.names if c != "text"), "print"])
    return run


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` of every document and ``print``, its 64 bits as a long."""
    docs = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_fingerprints(shingle), f"{schema}, print long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes the error patterns of up to four bits (at most
    six), and how many there are."""
    unit = np.array([_syndrome_of(1 << i) for i in range(23)])
    patterns = np.zeros((2048, 6), np.int64)
    number = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            s = int(np.bitwise_xor.reduce(unit[list(bits)])) if bits else 0
            # beside a pattern of up to two bits there is no other of up to four
            patterns[s, number[s]] = sum(1 << b for b in bits)
            number[s] += 1
    return patterns, number


def _syndrome_of(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for bit in range(23):
        out ^= ((words >> bit) & 1) * _syndrome_of(1 << bit)
    return out


def codewords(words: np.ndarray, patterns: np.ndarray, number: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits, nearest first, and their number."""
    s = _syndromes(words)
    return (words[:, None] ^ patterns[s]) >> 11, number[s]


def _keys(tables):
    """``key, print, probe`` of every fingerprint: the keys it is filed under
    (``probe`` false) and those it is looked up under (true)."""
    patterns, number = golay_tables()
    for rows in tables:
        prints = np.asarray(rows.column("print")).view(np.uint64)
        parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)
                 for at, n in SEGMENTS]
        found = [codewords(p, patterns, number) for p in parts]
        every = np.arange(len(prints))
        out = []
        for s, part in enumerate(parts):
            out.append((part << 3 | s, every, False))
        for p, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            (ci, ni), (cj, nj) = found[i], found[j]
            out.append(((ci[:, 0] << 12 | cj[:, 0]) << 3 | (3 + p), every, False))
            for x, y in itertools.product(range(6), range(6)):
                on = np.flatnonzero((ni > x) & (nj > y))
                out.append(((ci[on, x] << 12 | cj[on, y]) << 3 | (3 + p), on, True))
        for key, on, probe in out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(prints[on].view(np.int64)),
                 pa.array(np.full(len(on), probe))], ["key", "print", "probe"])


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a below b, of distinct fingerprints that differ in 1 to
    ``max_bits`` (at most 4) bits."""
    if not 1 <= max_bits <= 4:
        raise ValueError("the keys are complete for 1 to 4 bits")
    keys = prints.mapInArrow(_keys, "key long, print long, probe boolean")
    filed = keys.where("not probe").select("key", F.col("print").alias("a"))
    exact = F.col("key").bitwiseAND(7) < 3
    looked = (keys.where(F.col("probe") | exact).select(F.col("key").alias("sought"),
                                                         F.col("print").alias("b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, max_bits)
    # a segment's own key meets itself, so one direction is enough there
    once = ~exact | (F.col("a") < F.col("b"))
    # a fingerprint makes up to a hundred keys, which the planner doesn't count: neither side is broadcast
    return (filed.join(looked.hint("merge"), (F.col("key") == F.col("sought")) & near & once)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def component_ids(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(print, component_id)`` of every distinct fingerprint of ``(doc_id, print)``."""
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("low")), "prints")
    roots = materialize(graph.components(links(nodes.select("print"), max_bits)), "roots")
    joined = nodes.join(roots, F.col("print") == F.col("node"))
    lowest = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = roots.join(lowest, "root").select("node", "component_id")
    return (nodes.join(linked, F.col("print") == F.col("node"), "left")
            .select("print", F.when(F.col("node").isNotNull(), F.col("component_id"))
                    .otherwise(F.col("low")).alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    prints = materialize(fingerprints(docs, ["doc_id"], shingle), "doc-prints")
    groups = materialize(component_ids(prints, max_bits), "components")
    return prints.join(groups, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, one of each component: that with the smallest ``doc_id`` (null
    last), of several the one with the smallest hash of its text.

    Rows equal in id and text are told apart by nothing; one of them stays.
    """
    digest = F.xxhash64("text")
    keyed = docs.select("doc_id", digest.alias("digest"), "text")
    prints = materialize(fingerprints(keyed, ["doc_id", "digest"], shingle), "doc-prints")
    roots = component_groups(prints, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    best = (prints.join(roots, "print").groupBy("root").agg(first.alias("best"))
            .select(F.col("best.doc_id").alias("doc_id"), F.col("best.digest").alias("digest")))
    times = prints.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    doc, digest = free_name(docs, "doc"), free_name(docs, "digest")
    best = best.withColumnsRenamed({"doc_id": doc, "digest": digest})
    kept = materialize(
        best.join(times, F.col(doc).eqNullSafe(F.col("doc_id")) & (F.col(digest) == F.col("digest")))
        .select(doc, digest, "n"), "kept")

    def rows(of: DataFrame) -> DataFrame:
        return docs.join(of, docs["doc_id"].eqNullSafe(F.col(doc))
                         & (F.xxhash64(docs["text"]) == F.col(digest)), "left_semi")

    single = rows(kept.where("n = 1"))
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return single
    return single.union(rows(repeated).dropDuplicates(["doc_id", "text"]))


def component_groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(print, root)`` of every distinct fingerprint; the root is one of them."""
    nodes = materialize(prints.select("print").distinct(), "prints")
    roots = materialize(graph.components(links(nodes, max_bits)), "roots")
    return (nodes.join(roots, F.col("print") == F.col("node"), "left")
            .select("print", F.coalesce("root", "print").alias("root")))
