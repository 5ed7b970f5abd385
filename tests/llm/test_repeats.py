"""Substring operators against plain Python over whole texts."""

import collections
import hashlib

import numpy as np
import pytest
import xxhash

from parzelle.llm import debruijn, suffixes
from parzelle.llm import words as W
from tests.llm.conftest import edge_rows, words


def covered(texts, k):
    """For each text which words lie in a k-word window that starts at two places."""
    split = [words(t) for t in texts]
    count = collections.Counter(
        tuple(w[i:i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for w in split:
        flags = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i:i + k])] > 1:
                flags[i:i + k] = [True] * k
        out.append((w, flags))
    return out


def removed(rows, k):
    for (doc_id, *_), (w, flags) in zip(rows, covered([r[1] for r in rows], k), strict=True):
        kept = " ".join(x for x, f in zip(w, flags, strict=True) if not f)
        yield doc_id, len(w), sum(flags), hashlib.sha256(kept.encode()).hexdigest()


def spans(rows, k):
    for (doc_id, *_), (_, flags) in zip(rows, covered([r[1] for r in rows], k), strict=True):
        edges = np.flatnonzero(np.diff([0, *map(int, flags), 0]))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            yield doc_id, int(a), int(b - a)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("k, anchor", [(35, 10), (6, 3)])
def test_removed_words(edge, k, anchor):
    got = [tuple(r) for r in debruijn.remove_repeats(edge, k, anchor).collect()]
    assert ordered(got) == ordered(removed(edge_rows(), k))


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rows = edge_rows()
    monkeypatch.setattr(W, "BATCH_BYTES", 500)
    monkeypatch.setattr(W.batches, "__defaults__", (500,))
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c long")
    got = [tuple(r) for r in debruijn.remove_repeats(docs).collect()]
    assert ordered(got) == ordered(removed(rows, 35))


def test_random_small_alphabet(spark):
    r = np.random.default_rng(8)
    rows = [(i, " ".join(r.choice(list("ab"), int(r.integers(0, 60))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in debruijn.remove_repeats(docs, 9, 3).collect()]
    assert ordered(got) == ordered(removed(rows, 9))
    found = [tuple(x)[:3] for x in suffixes.repeated_passages(docs, 9, 3).collect()]
    assert sorted(found) == sorted(spans(rows, 9))


def test_no_documents_and_extra_columns(empty, clashing):
    assert debruijn.remove_repeats(empty).count() == 0
    assert suffixes.repeated_passages(empty).count() == 0
    got = [tuple(r) for r in debruijn.remove_repeats(clashing).collect()]
    assert ordered(got) == ordered(removed(edge_rows(), 35))


def test_no_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i}x{j}" for j in range(80))) for i in range(9)],
                                 "doc_id long, text string")
    assert {r["n_removed"] for r in debruijn.remove_repeats(docs).collect()} == {0}
    assert suffixes.repeated_passages(docs).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_passages(edge, clashing, partitions):
    texts = {(d, t): words(t) for d, t, *_ in edge_rows()}
    by_id = collections.defaultdict(list)
    for (d, _), w in texts.items():
        by_id[d].append(w)
    found = suffixes.repeated_passages(clashing.repartition(partitions)).collect()
    # rows equal in id and text give their spans once
    rows = list(dict.fromkeys((r[0], r[1]) for r in edge_rows()))
    extra = [r for r in edge_rows() if r[0] == 8][:1]
    want = spans([*rows, *((r[0], r[1]) for r in extra)], 50)
    assert ordered([tuple(r)[:3] for r in found]) == ordered(set(want))
    for r in found:
        # the partner holds fifty words of the span
        a = [w[r["start_word"]:r["start_word"] + r["n_words"]] for w in by_id[r["doc_id"]]]
        b = [w[r["other_start_word"]:][:50] for w in by_id[r["other_doc_id"]]]
        assert any(y in (x[i:i + 50] for i in range(len(x) - 49)) for x in a for y in b)


def test_neighbours_across_tasks(spark):
    # one passage in many documents, sorted into many tasks: every copy is found
    passage = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame(
        [(i, f"{'a ' * (i % 7)}x{i} {passage} y{i} {'b ' * (i % 5)}") for i in range(300)],
        "doc_id long, text string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        found = suffixes.repeated_passages(docs).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sorted(r["doc_id"] for r in found) == list(range(300))
    assert {r["n_words"] for r in found} == {50}


def test_hashes_of_words_and_windows():
    texts = [b"a bb  ccc\n" + bytes(range(33, 90)) * 3, None, b"", "ß漢 \t x".encode(), b"y" * 31]
    batch = next(W.batches(texts, 1))
    split = [w for t in texts for w in (t or b"").split()]
    assert [bytes(batch.buffer[a:b]) for a, b in zip(batch.starts, batch.ends, strict=True)] == split
    assert W.word_hashes(batch).tolist() == [xxhash.xxh64_intdigest(w, 42) for w in split]
    assert np.diff(batch.offsets).tolist() == [len((t or b"").split()) for t in texts]
