import collections
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from parzelle.llm import mixing, queries, tokencounts, toxicity
from tests.llm.conftest import SCHEMA, SF, edge_rows, prose, words
from tests.llm.test_decontamination import leaks
from tests.llm.test_mixing_sharding import fill, sources_of
from tests.llm.test_simhash import fingerprint, groups

has_tables = pytest.mark.skipif(not SF.exists(), reason="test tables not present")
has_vocabulary = pytest.mark.skipif(not Path(tokencounts.VOCABULARY).exists(),
                                    reason="vocabulary not present")


@has_vocabulary
@pytest.mark.parametrize("partitions, block, together", [(1, 7, 2), (3, 1_000, 3), (2, 1 << 20, 9)])
def test_token_counts_equal_direct_tokenisation(edge, clashing, partitions, block, together):
    import tiktoken
    encode = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, special_tokens={},
                               mergeable_ranks=tokencounts.vocabulary()).encode_ordinary
    blocks, listed, end_id = tokencounts.write_streams(
        clashing.repartition(partitions), block_tokens=block)
    counts = tokencounts.count_tokens(blocks, end_id, together).collect()
    want = [(r[0], len(encode(r[1] or ""))) for r in edge_rows()]
    assert sorted(c["n_tokens"] for c in counts) == sorted(n for _, n in want)
    assert all(c["ended"] for c in counts)
    whole = b"".join(r["data"] for r in blocks.orderBy("stream", "place").collect())
    assert np.frombuffer(whole, "<u2").tolist().count(end_id) == len(want)
    assert sum(len(r["ids"]) for r in listed.collect()) == len(want)


@has_vocabulary
def test_token_counts_of_documents(edge, empty):
    import tiktoken
    encode = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, special_tokens={},
                               mergeable_ranks=tokencounts.vocabulary()).encode_ordinary
    rows = tokencounts.document_counts(edge).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted(
        (str(d), len(encode(t or ""))) for d, t, *_ in edge_rows())
    assert tokencounts.document_counts(empty).count() == 0


@has_vocabulary
@pytest.mark.parametrize("n, together", [(3, 4), (4, 4), (5, 4), (8, 4), (4_096, None)])
def test_token_counts_of_partitions_that_fill_their_lists(spark, n, together):
    docs = spark.range(n).selectExpr("id as doc_id", "concat('one two ', id) as text").coalesce(1)
    more = {} if together is None else {"ids_together": together}
    import tiktoken
    encode = tiktoken.Encoding("t", pat_str=tokencounts.PATTERN, special_tokens={},
                               mergeable_ranks=tokencounts.vocabulary()).encode_ordinary
    got = {r["doc_id"]: r["n_tokens"] for r in tokencounts.document_counts(docs, **more).collect()}
    assert got == {i: len(encode(f"one two {i}")) for i in range(n)}


def test_scan_of_flat_files(spark, tmp_path):
    r = random.Random(3)
    want = []
    for f, share in (("a", 0.02), ("b", 0.0), ("c", 0.5), ("d", 0.001)):
        tokens = [9 if r.random() < share else r.randrange(9) for _ in range(3_000)]
        if f == "d":
            tokens[-1] = 9
        np.array(tokens, "<u2").tofile(tmp_path / f"{f}.bin")
        cur = number = 0
        for t in tokens:
            if t == 9:
                want.append((f, number, cur, True))
                number, cur = number + 1, 0
            else:
                cur += 1
        if cur:
            want.append((f, number, cur, False))
    (tmp_path / "empty.bin").touch()
    blocks = tokencounts.read_streams(spark, str(tmp_path), 9, 10)
    got = [(x["stream"][-5], x["number"], x["n_tokens"], x["ended"])
           for x in tokencounts.count_tokens(blocks, 9, 7).collect()]
    assert sorted(got) == sorted(want)


def corpus():
    rows = list(edge_rows())
    for i in range(40):
        text = prose(200 + i, 120)
        toxic = i % 4 == 0
        w = text.split()
        if toxic:
            w[10:10] = [f"blarg{i}", "blargen", "blarg"]
        rows.append((200 + i, " ".join(w), "en", "abcd"[i % 4], 1))
        rows.append((300 + i, " ".join([*w[:100], "tail", *w[101:]]), "en", "abcd"[(i + 1) % 4], 1))
    item = prose(900, 25)
    rows.append((400, f"{prose(901, 50)} {item} {prose(902, 50)}", "en", "a", 1))
    labels = [(d, 1, int("blarg" in (t or ""))) for d, t, *_ in rows if d is not None and d % 3]
    return rows, [(1, item), (2, prose(903, 30))], labels


def test_each_stage_does_its_work_on_all_that_the_one_before_kept(spark, tmp_path):
    rows, items, labels = corpus()
    tables = {"documents": (rows, SCHEMA), "benchmark": (items, "item_id long, text string"),
              "labels": (labels, "doc_id long, quality int, toxic int")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        before = [tuple(r)[:5] for r in docs.collect()]
        docs = spark.read.parquet(out)
        seen[name] = (before, [tuple(r) for r in docs.collect()])
        if name != "sharding":
            assert docs.columns == columns
    key = str

    before, after = seen["toxicity"]
    frame = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(*toxicity.examples(frame, known))
    score = [toxicity.logit(r[1] or "", model.gram_logits()) + model.offset() for r in before]
    assert sorted(after, key=key) == sorted((r for r, z in zip(before, score, strict=True) if z < 0), key=key)
    toxic = [sum("blarg" in (r[1] or "") for r in part) for part in (before, after)]
    assert toxic[1] < toxic[0] / 2 and len(before) - len(after) <= toxic[0] + 2  # few examples

    before, after = seen["simhash_near_dedup"]
    top = groups([fingerprint(r[1]) for r in before])
    first = {}
    for r, t in zip(before, top, strict=True):
        first[t] = min(first.get(t, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(str(r[0]) for r in after) == sorted(str(None if n else d) for n, d in first.values())

    before, after = seen["benchmark_decontamination"]
    bad = {d for d, _ in leaks([r[:2] for r in before], items)}
    assert 400 in bad
    assert sorted(after, key=key) == sorted((r for r in before if r[0] not in bad), key=key)

    before, after = seen["mixing"]
    sizes = sources_of(before)
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    taken = sources_of(after)
    times = collections.Counter(after)
    assert set(times) <= set(before) and max(times.values()) <= 3
    for s, t in target.items():
        largest = max(len(words(r[1])) for r in before if r[3] == s)
        assert abs(taken[s] - t) <= largest / 2 + 1

    before, after = seen["sharding"]
    assert collections.Counter(r[:5] for r in after) == collections.Counter(before)
    per_shard = collections.Counter(r[5] for r in after)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1
    assert len({(r[5], r[6]) for r in after}) == len(after)

    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=key) == sorted(after, key=key)


def test_stages_on_empty_documents(spark, tmp_path, empty):
    _, items, labels = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@has_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry_module.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want


def test_every_operator_is_registered():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert "pipeline" in entry_module.queries()
    assert mixing.CYCLE == (5, 2, 1)
