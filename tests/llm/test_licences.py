"""The licence index against a plain search, and on texts with known licences."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parzelle.llm import licences as L
from tests.llm.conftest import SCHEMA, prose

TEXT = {(label, i): text for i, (label, text, _) in enumerate(L.TEMPLATES)}
FULL = {label: text for (label, _), text in sorted(TEXT.items(), key=lambda t: len(t[1]))}


def brute(texts):
    """Every beginning of every template is tried, word by word."""
    split = [L.words(t or "") for t in texts]
    df = collections.Counter(w for ws in split for w in set(ws))
    out = []
    for ws in split:
        found = [(i, label) for phrase, label in L.BASE for i in range(len(ws))
                 if ws[i:i + len(p := L.words(phrase))] == p]
        labels, best = {label for _, label in found}, 0.0
        for label, text, phrases in L.TEMPLATES:
            t = L.words(text)
            looked = sorted(set(t) & set(ws), key=lambda w: (df[w], w))[:12]
            needed = (min(12, len(set(t))) + 1) // 2
            begins = {(f - q, w) for f, w in enumerate(ws) if w in looked
                      for q, x in enumerate(t) if x == w}
            for shift in (0, 8):
                bands = collections.defaultdict(set)
                for d, w in begins:
                    bands[(d + shift) // 16].add(w)
                for band, members in bands.items():
                    first = band * 16 - shift
                    part = ws[max(0, first):max(0, first + 15 + len(t))]
                    both = collections.Counter(part) & collections.Counter(t)
                    share = sum(both.values()) / len(t)
                    joined = " " + " ".join(part) + " "
                    if len(members) >= needed and share >= 0.5 and all(f" {p} " in joined for p in phrases):
                        labels.add(label)
                        best = max(best, share)
        at = [i for i, _ in found]
        out.append((len(ws), len(at), min(at, default=None), max(at, default=None),
                    ",".join(sorted({label for _, label in found})), ",".join(sorted(labels)),
                    0.5 + 0.5 * best if labels else 0.0))
    return out


def texts():
    r = random.Random(4)
    out = [None, "", " \n", "MIT License", "the mit-license, mit license. MIT\nLICENSE", "CC BY-NC 4.0 CC BY",
           "ΜIT License", "İ mit license"]
    for label, text in FULL.items():
        w = text.split()
        out += [text, prose(5, 300) + "\n# " + text.replace(" ", "\n * ") + "\n" + prose(6, 200),
                " ".join(w[:len(w) // 3]),  # too little of it
                " ".join(x for x in w if r.random() > 0.1),  # words left out
                " ".join(y for x in w for y in ((x, "noise") if r.random() < 0.05 else (x,))),
                label + " " + prose(7, 40)]
    out += ["\n".join(FULL.values()), "license " * 3_000 + FULL["mit"],  # a frequent word
            (FULL["isc"] + " ") * 30, prose(8, 20_000, 3_000) + " " + FULL["bsd"],
            " ".join(sorted(L.words(FULL["mit"])))]  # the words without their order
    return out


def scanned(df):
    return [tuple(r)[1:] for r in L.scan(df).orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts())]
    got = scanned(spark.createDataFrame(rows, SCHEMA))
    assert [g[:6] for g in got] == [w[:6] for w in brute(texts())]
    assert [g[6] for g in got] == pytest.approx([w[6] for w in brute(texts())])


def test_known_texts(spark):
    rows = [(i, prose(i, 50) + " " + text, "en", "a", 1) for i, text in enumerate(FULL.values())]
    got = scanned(spark.createDataFrame(rows, SCHEMA))
    assert all(label in g[5].split(",") and g[6] == 1.0 for label, g in zip(FULL, got, strict=True))
    got = scanned(spark.createDataFrame([(1, " ".join(sorted(L.words(FULL["mit"]))), "", "", 1)], SCHEMA))
    assert got[0][4:] == ("", "", 0.0)


def test_edge_rows_empty_and_clashing(spark, edge, empty, clashing):
    rows = [tuple(r) for r in edge.collect()]
    want = sorted(zip((r[0] for r in rows), brute([r[1] for r in rows]), strict=True), key=repr)
    for frame in (edge, clashing, edge.withColumns({c: F.lit(0) for c in ("labels", "word", "n_words")})):
        assert sorted(((r[0], tuple(r)[1:]) for r in L.scan(frame).collect()), key=repr) == want
    assert L.scan(empty).collect() == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    index = L.Index()
    text = (prose(1, 900) + " Ärger " + FULL["apache-2.0"] + " MIT License " + "x" * 700).encode()
    whole = [ids for ids, _ in index.read([text])][0]
    for size in (1, 64, 333):
        monkeypatch.setattr(L, "BATCH_BYTES", size)
        (ids, offsets), = index.read([text])
        assert np.array_equal(ids, whole) and offsets.tolist() == [0, len(whole)]
    assert [index.vocabulary[i] if i >= 0 else None for i in whole] == [
        w if w in index.vocabulary else None for w in L.words(text.decode())]
