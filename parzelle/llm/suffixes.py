"""Substring dedup with a sparse suffix array.

Of all suffixes of all documents only those are retained that start at a minimiser: the
``anchor``-word run with the least hash in some window of ``length`` words. The choice
depends on the window's words alone, so a passage of ``length`` words that occurs twice
holds, in both places, a retained suffix at the same word of it.

1. The retained suffixes are sorted by their anchor and their neighbourhood: all words
   within which a passage of ``length`` words can hold the suffix at this word. They are
   dealt by ranges, so that a suffix shared by many documents may fill several tasks,
   and each is compared with its neighbours. A suffix without a neighbour of the same
   anchor is unique and ends here. Equal neighbourhoods are a repeated passage.
2. Where neighbours share the anchor but not the whole neighbourhood, the match has to be
   extended to the left and right to where it really ends: one suffix of each distinct
   neighbourhood is opened into the suffixes at its words, these are sorted in the same
   manner, and neighbours with ``length`` equal words are the passage.
3. Matches of a document that overlap or touch are put together to its repeated spans.

Nothing but a row's neighbours is looked at, however often a passage occurs. Two 64-bit
hashes, of the anchor and of the words compared, tell suffixes apart.

Defined cases: null and empty texts have no suffixes; a passage may repeat within its
own document; rows equal in id and text are copies of one another and give their spans
once; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.llm.common import keyed, same_document
from parzelle.llm.windows import Sums, sliding_min, window_starts
from parzelle.llm.words import batches, texts_of
from parzelle.session import materialize

LENGTH = 50
ANCHOR = 16


def _places(grams: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The leftmost least of the ``width`` grams from each start."""
    least = sliding_min(grams, width)[start]
    place = np.empty(len(start), np.int64)
    step = 1 << 16
    for a in range(0, len(start), step):
        part = start[a:a + step]
        place[a:a + step] = part + (
            grams[part[:, None] + np.arange(width)] == least[a:a + step, None]).argmax(1)
    return place


def _retained(length: int, anchor: int):
    """``anchor, around, doc_id, digest, low, high`` of every retained suffix: words
    ``low`` to ``high`` are its neighbourhood."""
    def run(tables):
        for rows in tables:
            for batch in batches(texts_of(rows), length - 1):
                start, text = window_starts(batch, length)
                if not len(start):
                    continue
                grams = Sums(batch, 1).every(anchor)
                place = _places(grams, start, length - anchor + 1)
                new = np.flatnonzero(np.concatenate(
                    [[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
                last = np.concatenate([new[1:], [len(start)]]) - 1
                # the windows that have this suffix are a run: from the first's first
                # word to the last's last
                low, high = start[new], start[last] + length
                of = text[new]
                around = Sums(batch, 2).runs(low, high - low)
                base = batch.first[of] - batch.offsets[of]
                row = pa.array(batch.rows[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[place[new]].view(np.int64)), pa.array(around.view(np.int64)),
                     rows.column("doc_id").take(row), rows.column("digest").take(row),
                     pa.array((low + base).astype(np.int32)),
                     pa.array((high + base).astype(np.int32))],
                    ["anchor", "around", "doc_id", "digest", "low", "high"])
    return run


KEY = ("anchor", "around")


def _neighbours(tables):
    """Compare sorted suffixes with their neighbours.

    Added are ``equal`` (a neighbour has the same key), ``partner`` and ``partner_low``
    (that neighbour), ``meets`` (a neighbour has the same anchor but another key) and
    ``edge`` (first or last row of the task, whose other neighbour is in another task).
    """
    held, judged = None, False
    for rows in tables:
        rows = pa.Table.from_batches([rows])
        table = rows if held is None else pa.concat_tables([held, rows])
        yield from _judge(table, judged, False)
        judged = judged or table.num_rows > 1
        # the last row waits for its successor, the one before is needed to compare
        held = table.slice(max(table.num_rows - 2, 0))
    if held is not None:
        yield from _judge(held, judged, True)


def _judge(table: pa.Table, judged: bool, ended: bool):
    """The rows of interest among those whose neighbours are in the table.

    ``judged``: the first row has been given out already; ``ended``: no row follows.
    """
    n = table.num_rows
    first, stop = (1 if judged else 0), (n if ended else n - 1)
    if stop <= first:
        return
    anchor, around = (table.column(c).to_numpy() for c in KEY)
    same = np.concatenate([[False], anchor[1:] == anchor[:-1], [False]])
    equal = np.concatenate([[False], same[1:-1] & (around[1:] == around[:-1]), [False]])
    meets = same & ~equal
    before, after = equal[:-1], equal[1:]
    edge = np.zeros(n, bool)
    edge[0] |= not judged
    edge[-1] |= ended
    own = np.arange(n)
    partner = pa.array(np.where(before, own - 1, own + 1), mask=~(before | after))
    flags = {"equal": before | after, "meets": meets[:-1] | meets[1:], "edge": edge}
    table = table.combine_chunks()
    for name, column in (("partner", "doc_id"), ("partner_low", "low")):
        table = table.append_column(name, table.column(column).take(partner))
    for name, flag in flags.items():
        table = table.append_column(name, pa.array(flag))
    wanted = np.flatnonzero(flags["equal"] | flags["meets"] | edge)
    wanted = wanted[(wanted >= first) & (wanted < stop)]
    if len(wanted):
        yield from table.take(pa.array(wanted)).combine_chunks().to_batches()


def _opened(length: int):
    """The suffixes at every word of the neighbourhoods ``parts`` of a text, with the
    hash of their first ``length`` words."""
    def run(tables):
        for rows in tables:
            parts = rows.column("parts").to_pylist()
            for batch in batches(texts_of(rows), length - 1):
                sums = Sums(batch, 2)
                out = []
                for i, row in enumerate(batch.rows.tolist()):
                    base = int(batch.offsets[i]) - int(batch.first[i])
                    for p in parts[row]:
                        start = np.arange(
                            max(base + p["low"], int(batch.offsets[i])),
                            min(base + p["high"], int(batch.offsets[i + 1])) - length + 1)
                        out.append((start, row, p["anchor"], start - base))
                out = [o for o in out if len(o[0])]
                if not out:
                    continue
                size = [len(o[0]) for o in out]
                row = pa.array(np.repeat([o[1] for o in out], size))
                low = np.concatenate([o[3] for o in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([o[2] for o in out], np.int64), size)),
                     pa.array(sums.runs(np.concatenate([o[0] for o in out]), length).view(np.int64)),
                     rows.column("doc_id").take(row), rows.column("digest").take(row),
                     pa.array(low.astype(np.int32)), pa.array((low + length).astype(np.int32))],
                    ["anchor", "around", "doc_id", "digest", "low", "high"])
    return run


def _merged(tables):
    """A document's matches that overlap or touch as one span, with the partner of the
    longest match."""
    for rows in tables:
        out = []
        for i, matches in enumerate(rows.column("matches").to_pylist()):
            spans = []
            for m in sorted(matches, key=lambda m: (m["low"], m["high"])):
                if spans and m["low"] <= spans[-1]["high"]:
                    s = spans[-1]
                    s["high"] = max(s["high"], m["high"])
                    if m["high"] - m["low"] > s["best"]["high"] - s["best"]["low"]:
                        s["best"] = m
                else:
                    spans.append({"low": m["low"], "high": m["high"], "best": m})
            out += [(i, s["low"], s["high"] - s["low"], s["best"]["with"]["partner"],
                     s["best"]["with"]["partner_low"]) for s in spans]
        if out:
            row, low, size, partner, place = zip(*out, strict=True)
            ids = rows.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(low, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(partner, ids.type), pa.array(place, pa.int64())],
                ["doc_id", "start_word", "n_words", "other_doc_id", "other_start_word"])


def _compared(suffixes: DataFrame, kind: str) -> DataFrame:
    """Sort suffixes over all tasks and compare neighbours."""
    order = [*KEY, "doc_id", "digest", "low", "high"]
    return (suffixes.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)
            .mapInArrow(_neighbours, f"anchor long, around long, doc_id {kind}, digest long, "
                        f"low int, high int, partner {kind}, partner_low int, "
                        "equal boolean, meets boolean, edge boolean"))


def matches(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, digest, low, high, partner, partner_low``: words ``low`` to ``high`` of a
    document also occur in the partner, from ``partner_low`` on."""
    texts = keyed(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    types = f"anchor long, around long, doc_id {kind}, digest long, low int, high int"
    sparse = materialize(_compared(texts.mapInArrow(_retained(length, anchor), types), kind),
                         "suffixes")
    parts = (sparse.where("meets or edge").groupBy("doc_id", "digest")
             .agg(F.collect_set(F.struct("low", "high", "anchor")).alias("parts")))
    dense = materialize(_compared(same_document(texts, parts, "inner")
                                  .mapInArrow(_opened(length), types), kind), "opened")
    # a task's first and last rows may have an equal neighbour in another task
    edges = dense.where("edge")
    ends = F.min(F.struct("doc_id", "low")).alias("a"), F.max(F.struct("doc_id", "low")).alias("b")
    met = edges.groupBy(*KEY).agg(F.count("*").alias("c"), *ends).where("c > 1")
    own = F.struct("doc_id", "low") == F.col("a")
    across = (edges.where("not equal").join(met, list(KEY))
              .withColumn("partner", F.when(own, F.col("b.doc_id")).otherwise(F.col("a.doc_id")))
              .withColumn("partner_low", F.when(own, F.col("b.low")).otherwise(F.col("a.low"))))
    names = ["doc_id", "digest", "low", "high", "partner", "partner_low"]
    return (sparse.where("equal").select(*names).union(dense.where("equal").select(*names))
            .union(across.select(*names)))


def repeated_passages(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """A row for each repeated span: ``doc_id, start_word, n_words, other_doc_id,
    other_start_word``.

    The other document is one that holds (the longest match in) the span; its span ends
    where that match does.
    """
    found = (matches(docs, length, anchor).groupBy("doc_id", "digest", "low", "high")
             .agg(F.min(F.struct("partner", "partner_low")).alias("with")))
    kind = found.schema["doc_id"].dataType.simpleString()
    return (found.groupBy("doc_id", "digest")
            .agg(F.collect_list(F.struct("low", "high", "with")).alias("matches"))
            .mapInArrow(_merged, f"doc_id {kind}, start_word long, n_words long, "
                        f"other_doc_id {kind}, other_start_word long"))
