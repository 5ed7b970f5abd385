"""Hard negatives by the threshold algorithm against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parzelle.llm import hardnegatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=5, positives=5, negatives=10, low=30, high=90):
    kept = {}
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        kept[vec_id, label, tuple(vector)] = ints
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(kept[a], kept[b], strict=False))
    for a in kept:
        if a[0] is None or a[0] % every:
            continue
        others = sorted(((-score(a, b), b[0] is None, b[0] or 0, b) for b in kept if b != a),
                        key=lambda t: t[:3])
        own = [(b, -s) for s, _, _, b in others if b[1] == a[1]][:positives]
        for p, ps in own:
            fit = [(b, -s) for s, _, _, b in others
                   if b[1] != a[1] and low * ps <= 100 * -s <= high * ps][:negatives]
            out += [(a[0], p[0], i, b[0], ps, s) for i, (b, s) in enumerate(fit, 1)]
    return out


def key(row):
    return tuple((v is None, v) for v in row)


def mined(spark, rows, every=5, schema=SCHEMA, **more):
    frame = H.usable(spark.createDataFrame(rows, schema))
    return sorted((tuple(r) for r in H.mine(frame, F.col("vec_id") % every == 0, **more).collect()), key=key)


def vectors(seed, n, width, labels=4, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, [c + r.gauss(0, spread) for c in centres[i % labels]], i % labels) for i in range(n)]


@pytest.mark.parametrize("together", [(1_024, 16_384), (7, 40)])
def test_blocks_of_any_size_give_the_same(spark, together):
    rows = vectors(1, 300, 12)
    assert mined(spark, rows, together=together) == sorted(brute(rows), key=key)


def test_ties_copies_and_small_numbers(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((-0.004, 0.0, 0.004, 0.5)) for _ in range(3)], r.randrange(3)) for i in range(200)]
    rows += [(1_000 + i, [0.5, 0.5, 0.5], 1) for i in range(150)]  # a frequent vector
    got = mined(spark, rows, every=10)
    assert got == sorted(brute(rows, every=10), key=key)
    assert len(got) > 100


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(5, 40, 4, spread=0.5) + [
        (100, None, 1), (105, [1.0, 1.0, 1.0, 1.0], None), (110, [1.0, None, 1.0, 1.0], 1),
        (115, [nan, 1.0, 1.0, 1.0], 1), (120, [inf, 1.0, 1.0, 1.0], 1), (None, [9.0, 9.0, 9.0, 9.0], 1),
        (125, [0.0, 0.0, 0.0, 0.0], 2), (130, [], 3), (135, [2.0], 0), (140, [1.0, 1.0, 1.0, 1.0], 9)]
    rows += rows[:3]  # repeated rows
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("own") for c in ("row", "vector", "score", "rank", "a_block", "anchor")})
    got = sorted((tuple(r) for r in H.mine(H.usable(frame), F.col("vec_id") % 5 == 0).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert {r[0] for r in got} >= {0, 5} and 140 not in {r[0] for r in got}


def test_empty(spark):
    assert mined(spark, []) == []


def test_numbers_beyond_the_exact_doubles(spark):
    rows = [(i, [float(2**40 + i * 2**20), 3.0 * i, -float(2**30)], i % 2) for i in range(24)]
    got = mined(spark, rows, schema="vec_id long, embedding array<double>, label int")
    assert {r[4] for r in got} == {H.MOST} or got == []
    rows = [(i, [float(2**22 + i), 3.5 * i, 0.25], i % 2) for i in range(24)]
    got = mined(spark, rows, schema="vec_id long, embedding array<double>, label int", highest=101)
    want = {(i, j): sum(math.floor(256 * a) * math.floor(256 * b)
                        for a, b in zip(rows[i][1], rows[j][1], strict=True)) for i in range(24) for j in range(24)}
    assert got and all(want[a, p] == ps and want[a, n] == ns for a, p, _, n, ps, ns in got)


def test_the_search_stops_early_where_it_may():
    """A block whose best row stands out is not read to the end."""
    r = np.random.default_rng(7)
    values = np.floor(r.normal(0, 20, (4_000, 6)))
    values[17] = 900
    lists = H.Lists(values, np.arange(4_000))
    read = []
    lists.order = _Watched(lists.order, read)
    found, scores = lists.search(np.full(6, 5.0), np.ones(4_000, bool), [(None, None)], 1)[0]
    assert found.tolist() == [17] and scores.tolist() == [27_000.0]
    assert max(read) < 4_000 / 4


class _Watched:
    """An array that notes how far from the end it was read."""

    def __init__(self, array, read):
        self.array, self.read = array, read

    def __getitem__(self, at):
        part = self.array[at]
        if part.size:
            self.read.append(self.array.shape[1] - at[1].start)
        return part
