import re

import pytest
from pyspark.sql import functions as F

from parzelle.llm import decontamination as D
from tests.llm.conftest import edge_rows, prose


def tokens(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def leaks(docs, items):
    """Compare every document with every item along every diagonal."""
    found = set()
    for doc_id, text in docs:
        d = tokens(text)
        for item_id, item in items:
            b = tokens(item)
            for g in {i - j for i, x in enumerate(d) for j, y in enumerate(b) if x == y}:
                lo, hi = max(0, -g), min(len(b), len(d) - g)
                f = [d[j + g] == b[j] for j in range(lo, hi)]
                w = min(12, len(b))
                if (len(f) >= w and max(sum(f[j:j + w]) for j in range(len(f) - w + 1)) >= 0.8 * w
                        or len(f) >= 12 and sum(f) >= 0.8 * len(f)):
                    found.add((doc_id, item_id))
    return found


ITEM = prose(50, 20)


def changed(text, *places):
    w = text.split()
    for p in places:
        w[p] = "other"
    return " ".join(w)


def rows():
    before, after = prose(51, 40), prose(52, 30)
    return [
        (1, f"{before} {ITEM} {after}"), (2, f"{before} {changed(ITEM, 3, 9, 14)} {after}"),
        (3, f"{before} {changed(ITEM, *range(0, 20, 3))} {after}"),
        (4, ITEM.upper().replace(" ", "&&& ")), (5, f"{before} {' '.join(ITEM.split()[4:17])}"),
        (6, f"{before} {' '.join(ITEM.split()[:8])} {after}"), (7, before + " " + after),
        (8, ITEM), (8, ITEM), (9, None), (10, ""), (11, "tiny thing"), (12, "a tiny thing here"),
        (None, ITEM), (13, (ITEM + " ") * 50)]


ITEMS = [(1, ITEM), (2, prose(53, 30)), (3, "Tiny, thing!"), (4, ""), (5, None), (None, ITEM), (1, ITEM)]


def frames(spark):
    return (spark.createDataFrame(rows(), "doc_id long, text string"),
            spark.createDataFrame(ITEMS, "item_id long, text string"))


def test_leaks_equal_brute_force(spark):
    docs, items = frames(spark)
    found = D.leaks(docs, items).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got == leaks(rows(), ITEMS)
    assert {(1, 1), (2, 1), (4, 1), (5, 1), (8, 1), (None, None), (11, 3), (12, 3)} <= got
    assert not {3, 6, 7, 9, 10} & {d for d, _ in got}
    one = next(r for r in found if r["doc_id"] == 2 and r["item_id"] == 1)
    assert (one["n_item"], one["n_overlap"], one["n_equal"], one["doc_start"]) == (20, 20, 17, 40)


def test_large_tables_are_joined_without_a_broadcast(spark, monkeypatch):
    docs, items = frames(spark)
    monkeypatch.setattr(D, "_if_small", lambda df: df)
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()} == leaks(rows(), ITEMS)


def test_seeds_of_documents_are_not_broadcast(spark, monkeypatch, tmp_path):
    # written texts are small to the planner, whatever the number of their seeds
    for df, name in zip(frames(spark), ("docs", "items"), strict=True):
        df.write.parquet(str(tmp_path / name))
    docs, items = (spark.read.parquet(str(tmp_path / name)) for name in ("docs", "items"))
    plans = {}
    monkeypatch.setattr(D, "materialize", lambda df, name, f=D.materialize: plans.update(
        {name: df._jdf.queryExecution().executedPlan().toString()}) or f(df, name))
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()} == leaks(rows(), ITEMS)
    assert "BroadcastHashJoin" in plans["hits"] and "BuildRight" in plans["hits"]
    monkeypatch.setattr(D, "_if_small", lambda df: df)
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()} == leaks(rows(), ITEMS)
    assert "SortMergeJoin" in plans["hits"] and "Broadcast" not in plans["hits"]


def test_decontaminated_documents(spark, empty, clashing):
    docs, items = frames(spark)
    bad = {d for d, _ in leaks(rows(), ITEMS)}
    out = D.decontaminate(docs.withColumn("digest", F.lit(1)), items)
    assert out.columns == ["doc_id", "text", "digest"]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(
        r[0] for r in rows() if r[0] not in bad)
    assert D.decontaminate(empty, items).count() == 0
    assert D.decontaminate(clashing, items.limit(0)).count() == len(edge_rows())
    assert D.leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("length, substitutions", [(12, 2), (15, 3)])
def test_masks_hit_every_pattern(length, substitutions):
    from itertools import combinations
    for places in combinations(range(length), substitutions):
        assert any(all(i + p not in places for p in m)
                   for m in D.MASKS for i in range(length - m[-1]))


@pytest.mark.parametrize("n", range(1, 12))
def test_short_items_are_found_whatever_words_are_replaced(spark, n):
    from itertools import combinations
    allowed = next(r for r in range(n, -1, -1) if n - r >= 0.8 * n)
    masks = [*D.short_masks(n), *(m for m in D.MASKS if m[-1] < n)]
    for places in combinations(range(n), allowed):
        assert any(not set(places) & set(m) for m in masks), places


def test_short_items_against_brute_force(spark):
    from itertools import combinations
    docs, items = [], []
    for n in (4, 5, 6, 7, 8, 10, 11):
        words = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for r in (1, 2, 3):
            for places in list(combinations(range(n), r))[::7]:
                changed = [w if k not in places else "other" for k, w in enumerate(words)]
                docs.append((len(docs), " ".join(["before", "it", *changed, "after"])))
    found = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                    spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == leaks(docs, items)
    assert len(found) > 20
