import collections
import zlib

import pytest
from pyspark.sql import functions as F

from parzelle.llm import mixing, queries, sharding
from tests.llm.conftest import SCHEMA, edge_rows, words


def fill(sizes, weights, most):
    """Clamp and share the excess again until no source is above its cap."""
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        weight = sum(weights[s] for s in sizes if s not in capped)
        target = {s: capped.get(s, weights[s] * rest / weight if weight else 0.0) for s in sizes}
        over = [s for s in sizes if s not in capped and target[s] > most * sizes[s]]
        if not over:
            return target
        capped |= {s: float(most * sizes[s]) for s in over}


def sources_of(rows):
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    return sizes


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 2000, "d": 3, None: 10},
    {"a": 0, "b": 7}, {"a": 5}, {chr(97 + i): 10 ** (i % 5) for i in range(12)}])
def test_water_filling(spark, sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()],
                               "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df).collect()}
    want = fill(sizes, weights, 3)
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_words_taken_come_near_their_target(edge):
    rows = mixing.mix_words(edge).collect()
    sizes = sources_of(edge_rows())
    assert len(rows) == len(edge_rows())
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
    targets = {r["source"]: r["target"] for r in rows}
    assert targets == pytest.approx(
        fill(sizes, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, 3))
    for s, t in targets.items():
        # the document across the mark is on the nearer side (the repeated row counts twice)
        assert abs(taken[s] - t) <= max(largest[s] / 2, 1)
    assert rows == mixing.mix_words(edge).collect() or sorted(map(str, rows)) == sorted(
        map(str, mixing.mix_words(edge).collect()))


def test_mix_repeats_rows_and_keeps_columns(clashing):
    out = mixing.mix(clashing)
    assert out.columns == clashing.columns
    times = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = collections.Counter()
    for r, t in ((r, r["repetitions"]) for r in mixing.mix_words(clashing).select(
            "doc_id", "size", "repetitions").collect()):
        want[r["doc_id"], r["size"]] += t
    by_size = collections.Counter()
    for (doc_id, text), n in times.items():
        by_size[doc_id, len(words(text))] += n
    assert +by_size == +want


def test_mix_of_nothing(empty):
    assert mixing.mix_words(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_order_is_seeded(spark):
    docs = spark.range(2_000).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"),
        F.when(F.col("id") < 1_500, "a").otherwise("b").alias("source"))
    def taken(seed):
        return {r["doc_id"]: r["taken"] for r in mixing.mix_words(docs, seed=seed).collect()}
    one, two = taken(1), taken(2)
    assert one != two and sum(one.values()) == pytest.approx(8_000, abs=4)




@pytest.mark.parametrize("bucket_rows", [2, 10_000])
def test_shards_are_even_gapless_and_match_the_mixture(spark, bucket_rows):
    docs = spark.range(1_003).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"),
        F.expr("case when id < 700 then 'a' when id < 1000 then 'b' end").alias("source"))
    rows = sharding.interleave(docs, 16, bucket_rows=bucket_rows).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1_003))
    slots = collections.defaultdict(list)
    mixture = collections.defaultdict(collections.Counter)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        mixture[r["source"]][r["shard"]] += 1
    assert sorted(slots) == list(range(16))
    assert {len(s) for s in slots.values()} == {62, 63}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for counts in mixture.values():
        total = sum(counts.values())
        assert all(abs(counts[s] - total * len(slots[s]) / 1_003) <= 2 for s in range(16))


def test_order_is_that_of_the_fractional_ranks(spark):
    docs = spark.range(97).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"),
        F.expr("case when id < 50 then 'a' when id < 90 then 'b' else 'c' end").alias("source"))
    rows = sharding.interleave(docs, 5, bucket_rows=3).collect()
    firsts = [0, 20, 40, 59, 78]  # 97 = 20 + 20 + 19 + 19 + 19
    merged = [r["source"] for r in sorted(rows, key=lambda r: firsts[r["shard"]] + r["slot"])]
    want = sorted(((2 * r - 1) / (2 * n), s) for s, n in (("a", 50), ("b", 40), ("c", 7))
                  for r in range(1, n + 1))
    assert merged == [s for _, s in want]


def test_edge_rows_all_get_a_place(edge, empty, clashing):
    rows = sharding.interleave(edge, 16).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(edge_rows())
    assert sharding.interleave(empty).count() == 0
    out = sharding.interleave(clashing, 4)
    assert set(out.columns) == set(clashing.columns) | {"shard", "slot"}
    assert out.count() == len(edge_rows())


def test_query_reports_sizes_and_checksums(spark, edge, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: edge)
    rows = queries.op7_shards(spark, "").collect()
    got = sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows)
    want = sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                  for d, t, *_ in edge_rows())
    assert got == want and {r["law"] for r in rows} == {"rows"}
    assert {r["grown_shard"] for r in rows} == {None}


def test_any_number_of_sources(spark, monkeypatch):
    """More sources than may be broadcast, and columns of any name come through."""
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 5)
    rows = [(i, f"t{i}", "en", None if i % 41 == 0 else f"s{i * i % 37}", i) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("_n", "_s", "row", "at", "_share")})
    got = sharding.interleave(frame, 7)
    assert got.columns == [*frame.columns, "shard", "slot"]
    got = got.collect()
    many = collections.defaultdict(list)
    for r in got:
        many[r["source"]].append(r)
    names = sorted(k for k in many if k is not None) + [None]
    sizes = collections.Counter(r["shard"] for r in got)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    start = {s: sum(sizes[t] for t in range(s)) for s in sizes}
    order = [(r["source"]) for r in sorted(got, key=lambda r: start[r["shard"]] + r["slot"])]
    want = sorted(((2 * k + 1) / (2 * len(many[n])), i) for i, n in enumerate(names) for k in range(len(many[n])))
    assert order == [names[i] for _, i in want]
