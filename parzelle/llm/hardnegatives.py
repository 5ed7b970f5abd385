"""Hard negatives by Fagin's threshold algorithm.

Vectors are made integer (``floor(scale * x)``), a row's score is its inner product with an
anchor. For each anchor two searches are made, both by the threshold algorithm: first for the
best rows of its own label (the positives), then, for the window of scores that each positive
opens, for the best rows of other labels within it (the negatives).

The threshold algorithm, on a block of rows: each dimension has the block's rows in the order
of their component. An anchor goes down all lists at once, from the large end where its own
component is positive and from the small end where it is negative. A row met for the first
time is scored in full (random access). The scores of rows not met yet are at most the
threshold, the sum of the anchor's components times the last value read from each list. The
anchor stops when the threshold is strictly below what each of its windows still needs, its
``k``-th best score or, if there are fewer, its lower end, so rows of equal score are all seen.

The rows are dealt to blocks by a hash of the row, the anchors to blocks of their own, and
every block of anchors meets every block of rows in one task of bounded size: a fixed set of
queries against all rows, in blocks. Each meeting gives ``k`` rows a window; the best of all
blocks are ranked in Spark, where the limit is taken before the shuffle too. Hot labels and
frequent vectors fill no block, as labels play no part in the dealing.

Defined cases: rows with a null label, a null vector or a null or non-finite component take
no part; a null id is no anchor and is later than any other id among equal scores; rows equal in id,
label and vector are one row, rows that differ in label or vector only are rows of their own
(after the id they are ordered by a hash of both); components missing in a shorter vector
count as 0; an anchor of zeros scores every row 0; an anchor without another row of its label
gives nothing; an empty table gives no rows. Scores are exact as long as they fit in 63 bits; beyond that
they are given as the largest or smallest long. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parzelle.session import materialize

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Window of a positive's score, in percent of it.
LOWEST, HIGHEST = 30, 90
#: Rows and anchors of one meeting; with 1,024 dimensions they are some 300 MB.
ROWS_TOGETHER, ANCHORS_TOGETHER = 16_384, 1_024
#: Places read from every list before the threshold is looked at first; the next reads double.
FIRST_READ = 32
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def integers(vectors: list, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of the components as one array, short vectors filled with 0.

    Doubles hold it exactly; only if sums of products could pass 53 bits are the numbers
    Python's own (arrays of objects).
    """
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    largest = float(np.abs(out).max(initial=0.0)) * scale
    if width * (largest + 1) ** 2 < EXACT:
        return np.floor(out * scale)
    big = np.zeros(out.shape, object)
    for at, x in np.ndenumerate(out):
        numerator, denominator = float(x).as_integer_ratio()
        big[at] = numerator * scale // denominator
    return big


class Lists:
    """A block of rows with its lists: the rows in the order of each dimension's component."""

    def __init__(self, values: np.ndarray, ties: np.ndarray):
        self.values, self.ties = values, ties
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)

    def search(self, anchor: np.ndarray, wanted: np.ndarray, windows: list[tuple], k: int
               ) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window ``(lowest, highest)`` the ``k`` best of the ``wanted`` rows whose
        score lies in it: rows and scores, ties by ``self.ties``."""
        n = len(self.values)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, met = np.zeros(n, bool), np.zeros(n, bool)
        best = [(np.zeros(0, np.int64), np.zeros(0, self.values.dtype)) for _ in windows]
        open_ = [i for i, (low, high) in enumerate(windows) if low is None or low <= high]
        at, step = 0, FIRST_READ
        while open_ and at < n:
            end = min(n, at + step)
            if len(up) + len(down):
                met[self.order[up, n - end:n - at]] = True
                met[self.order[down, at:end]] = True
            else:
                met[:], end = True, n  # an anchor of zeros has no order of rows
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[wanted[new]]
            scores = self.values[new] @ anchor  # random access
            threshold = ((anchor[up] * self.sorted[up, n - end]).sum()
                         + (anchor[down] * self.sorted[down, end - 1]).sum())
            still = []
            for i in open_:
                low, high = windows[i]
                inside = slice(None) if low is None else (scores >= low) & (scores <= high)
                rows = np.concatenate([best[i][0], new[inside]])
                found = np.concatenate([best[i][1], scores[inside]])
                if len(rows) > k:
                    top = np.lexsort((self.ties[rows], -found))[:k]
                    rows, found = rows[top], found[top]
                best[i] = rows, found
                need = found.min() if len(rows) == k else low
                if need is None or not threshold < need:
                    still.append(i)
            open_ = still
            at, step = end, 2 * step
        return best


def usable(rows: DataFrame, label: Column | None = None, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``vec_id, label, vector, row``: the rows that take part, each once; ``row`` is a hash
    that tells rows of one id apart."""
    given = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>")
                        .alias("vector"), (F.col("label") if label is None else label)
                        .cast("long").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    return (given.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
            .withColumn("row", F.xxhash64("label", "vector")).dropDuplicates(["vec_id", "row"]))


RESULT = "anchor_id long, anchor long, positive_id long, positive long, positive_score long," \
         " vec_id long, row long, score long"


def _longs(scores: np.ndarray) -> list[int]:
    return [min(max(int(s), LEAST), MOST) for s in scores]


def _window(score: int, lowest: int, highest: int) -> tuple[int, int]:
    return -(-lowest * score // 100), highest * score // 100


def _meeting(scale: int, k: int, bounds: tuple[int, int] | None):
    """What a block of anchors finds in a block of rows: without bounds the best rows of the
    anchor's label, else the best of other labels for each of its windows."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(8)]
        if len(anchors) and len(rows):
            vectors = [*anchors.column("vector").to_numpy(), *rows.column("vector").to_numpy()]
            values = integers(vectors, scale)
            questions, values = values[:len(anchors)], values[len(anchors):]
            ids, hashes = rows.column("vec_id"), rows.column("row").to_numpy()
            labels = rows.column("label").to_numpy()
            ties = np.empty(len(rows), np.int64)
            ties[np.lexsort((hashes, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))] = \
                np.arange(len(rows))
            ids = ids.to_pylist()
            every = np.arange(len(rows))
            if bounds is None:
                blocks = {label: every[labels == label] for label in np.unique(labels)}
            else:
                blocks = {None: every}
            lists = {at: Lists(values[part], ties[part]) for at, part in blocks.items()}
            for question, a in zip(questions, anchors.drop_columns("vector").to_pylist(), strict=True):
                at = a["label"] if bounds is None else None
                if at not in lists:
                    continue
                part, positives = blocks[at], a.get("positives")
                if bounds is None:  # its own label, itself left out
                    me = (hashes[part] == a["row"]) & np.array([ids[r] == a["vec_id"] for r in part]) \
                        if a["row"] in hashes[part] else np.zeros(len(part), bool)
                    wanted, positives, windows = ~me, [None], [(None, None)]
                else:
                    wanted = labels != a["label"]
                    windows = [_window(p["score"], *bounds) for p in positives]
                for p, (found, scores) in zip(positives, lists[at].search(
                        question, wanted, windows, k), strict=True):
                    n = len(found)
                    p = p or {"vec_id": None, "row": None, "score": None}
                    for column, value in zip(out, (
                            [a["vec_id"]] * n, [a["row"]] * n, [p["vec_id"]] * n, [p["row"]] * n,
                            [p["score"]] * n, [ids[r] for r in part[found]],
                            hashes[part[found]].tolist(), _longs(scores)), strict=True):
                        column += value
        return pa.table([pa.array(c, pa.int64()) for c in out],
                        [field.split()[0] for field in RESULT.split(", ")])
    return run


def _met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, run,
         together: tuple[int, int]) -> DataFrame:
    """Every block of anchors with every block of rows."""
    a_blocks, r_blocks = (max(1, -(-n // t)) for n, t in zip((n_anchors, n_rows), together, strict=True))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "row"), F.lit(n))
        return df.withColumn(own, block.cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    a = dealt(anchors, "a_block", a_blocks, "r_block", r_blocks)
    r = dealt(rows, "r_block", r_blocks, "a_block", a_blocks)
    keys = ["a_block", "r_block"]
    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(run, RESULT)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         lowest: int = LOWEST, highest: int = HIGHEST, scale: int = SCALE,
         together: tuple[int, int] = (ANCHORS_TOGETHER, ROWS_TOGETHER)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from the
    rows of ``usable``: for each anchor and each of its first ``positives`` rows of its label the
    first ``negatives`` rows of other labels whose score is between ``lowest`` and ``highest``
    percent of the positive's. ``is_anchor`` is a condition on ``vec_id``.
    """
    rows = materialize(rows, "vectors")
    anchors = materialize(rows.where(F.col("vec_id").isNotNull() & is_anchor), "anchors")
    n_anchors, n_rows = anchors.count(), rows.count()
    own = _met(anchors, rows, n_anchors, n_rows, _meeting(scale, positives, None), together)
    own = materialize(_first(own, ["anchor_id", "anchor"], positives), "positives")
    asked = own.groupBy("anchor_id", "anchor").agg(
        F.collect_list(F.struct("vec_id", "row", "score")).alias("positives"))
    asking = anchors.join(asked, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor"))) \
        .drop("anchor_id", "anchor")
    found = _met(asking, rows, n_anchors, n_rows, _meeting(scale, negatives, (lowest, highest)), together)
    return _first(found, ["anchor_id", "anchor", "positive_id", "positive"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
