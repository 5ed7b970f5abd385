import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parzelle.llm import graph, simhash
from tests.llm.conftest import edge_rows, prose, words


def fingerprint(text, shingle=4):
    w = [x.encode().lower().decode() for x in words(text)]
    runs = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=4):
    """The lowest index that each index is connected to."""
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return [top(i) for i in range(len(prints))]


def near_rows():
    """Documents and copies of them with a few words changed."""
    r = random.Random(4)
    rows = list(edge_rows())
    for i in range(25):
        w = prose(100 + i, r.randint(60, 300)).split()
        for c in range(r.randint(1, 5)):
            x = list(w)
            for _ in range(c):
                x[r.randrange(len(x))] = f"z{r.randrange(99)}"
            rows.append((100 + 10 * i + c, " ".join(x), "en", "a", 0))
    return rows


def test_every_document_has_its_fingerprint_and_component(spark, clashing):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    prints = [fingerprint(r[1]) for r in rows]
    top = groups(prints)
    lowest = {}
    for r, t in zip(rows, top, strict=True):
        if r[0] is not None:
            lowest[t] = min(lowest.get(t, r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", str(lowest.get(t)))
                  for r, p, t in zip(rows, prints, top, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"]))
                 for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert len(set(top)) < len(set(prints)) < len(rows)
    assert simhash.near_duplicates(clashing).count() == len(edge_rows())


def test_one_document_of_each_component_stays(spark, empty, clashing):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    top = groups([fingerprint(r[1]) for r in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(top))
    first = {}
    for r, t in zip(rows, top, strict=True):
        first[t] = min(first.get(t, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(str(i) for i in ids) == sorted(str(None if n else i) for n, i in first.values())
    assert simhash.keep_one(empty).count() == simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(clashing).columns == clashing.columns


def test_links_are_complete(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 150, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base:
        for flips in range(1, 7):
            x = int(b)
            for bit in r.choice(64, flips, replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for bits in (4, 2):
        got = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in
               simhash.links(spark.createDataFrame(signed, "print long"), bits).collect()}
        got = {tuple(sorted(p)) for p in got}
        want = {p for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= bits}
        assert got == want
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "print long"), 5)


def test_keys_are_not_broadcast(spark):
    # a few fingerprints have very many keys: neither side of the join goes through the driver
    prints = spark.range(60).select(F.when(F.col("id") < 50, F.xxhash64("id")).otherwise(F.col("id")).alias("print"))
    links = simhash.links(prints)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan
    near = {(a, b) for a, b in itertools.combinations(range(50, 60), 2) if (a ^ b).bit_count() <= 4}
    assert {tuple(r) for r in links.collect()} == near


def test_golay_words_one_bit_apart_share_a_codeword():
    patterns, number = simhash.golay_tables()
    assert sorted(np.unique(number)) == [1, 6]
    words_ = np.arange(0, 1 << 23, 37)
    near, _ = simhash.codewords(words_, patterns, number)
    for bit in range(23):
        other, n = simhash.codewords(words_ ^ (1 << bit), patterns, number)
        assert ((near[:, :1] == other) & (np.arange(6) < n[:, None])).any(1).all()


@pytest.mark.parametrize("edges, want", [
    ([], {}), ([(1, 1)], {}), ([(2, 1), (1, 2)], {1: 1, 2: 1}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(9, i) for i in range(9)] + [(20, 21)], {**{i: 0 for i in range(10)}, 20: 20, 21: 20})])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in graph.components(df).collect()} == want
