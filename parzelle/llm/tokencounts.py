"""Token counts by a separator scan over flat token streams.

A token stream is what a tokenised corpus usually is on disk: token ids of a fixed width
one after the other, each document followed by an end-of-document id, without an index.
It is read as blocks of a fixed number of tokens, which don't care for documents.

1. Each block is searched for the end-of-document id at once. It gives the number of
   ends, the tokens before the first end and after the last, and the counts between.
2. A prefix scan over the blocks of a stream stitches the boundaries: how many documents
   ended before a block, and how many tokens of the document it begins in lie before it
   (the tokens since the last end, however many blocks ago). The scan has two levels, so
   that no task orders all blocks of a long stream.
3. Each end then has a document number and a token count.

Defined cases: null and empty texts are documents without tokens; texts that contain the
separator's name have it as ordinary text; tokens after the last end of a stream are an
unfinished document, given with ``ended`` false; an empty table has no streams. Extra
columns are not read.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parzelle.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits a text before its merges.
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
BLOCK_TOKENS = 8_192
#: Blocks that one task orders at the lower level of the scan.
BLOCKS_TOGETHER = 4_096
#: Ids of documents in a row of a stream's list of documents.
IDS_TOGETHER = 4_096


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Tokenizer:
    """A vocabulary that builds its encoder once in each process it is used in."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.state = ranks, pattern
        self.encoder = None

    def __reduce__(self):
        return Tokenizer, self.state

    def encode(self, text: str) -> list[int]:
        if self.encoder is None:
            import tiktoken

            ranks, pattern = self.state
            self.encoder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks,
                                             special_tokens={})
            self.state = None  # it is in the encoder now
        return self.encoder.encode_ordinary(text)


def token_type(end_id: int) -> np.dtype:
    return np.dtype("<u2" if end_id < 1 << 16 else "<u4")


def _streams(shared, end_id: int, block_tokens: int, ids_together: int):
    """``stream, place, data, ids``: blocks of tokens (``place`` is the block's number) and,
    apart from them, the documents' ids in order (``place`` is the first one's number)."""
    def run(tables):
        encode = shared.value.encode
        kind = token_type(end_id)
        width = block_tokens * kind.itemsize
        stream, block, held = TaskContext.get().partitionId(), 0, bytearray()
        listed, ids, type_ = 0, [], pa.int64()

        def rows(blocks, documents):
            n = len(blocks) + len(documents)
            return pa.RecordBatch.from_arrays(
                [pa.array([stream] * n, pa.int32()),
                 pa.array([p for p, _ in blocks] + [p for p, _ in documents], pa.int64()),
                 pa.array([d for _, d in blocks] + [None] * len(documents), pa.binary()),
                 pa.array([None] * len(blocks) + [d for _, d in documents], pa.list_(type_))],
                ["stream", "place", "data", "ids"])

        for table in tables:
            type_ = table.schema.field("doc_id").type
            for doc_id, text in zip(table.column("doc_id").to_pylist(), table.column("text"),
                                    strict=True):
                held += np.array([*encode(text.as_py() or ""), end_id], kind).tobytes()
                ids.append(doc_id)
                while len(held) >= width:
                    yield rows([(block, bytes(held[:width]))], [])
                    block += 1
                    del held[:width]
                if len(ids) == ids_together:
                    yield rows([], [(listed, ids)])
                    listed, ids = listed + len(ids), []
        # each on its own: the list may just have been handed out and tokens still be held
        if held:
            yield rows([(block, bytes(held))], [])
        if ids:
            yield rows([], [(listed, ids)])
    return run


def write_streams(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN,
                  block_tokens: int = BLOCK_TOKENS, ids_together: int = IDS_TOGETHER
                  ) -> tuple[DataFrame, DataFrame, int]:
    """Tokenise documents into one stream for each task: the blocks ``(stream, place,
    data)``, the documents in the streams' order ``(stream, place, ids)``, and the id that
    ends a document. The vocabulary, read on the driver, is of a fixed size."""
    ranks = vocabulary(path)
    end_id = max(ranks.values()) + 1
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(ranks, pattern))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(docs.select("doc_id", "text").mapInArrow(
        _streams(shared, end_id, block_tokens, ids_together),
        f"stream int, place long, data binary, ids array<{kind}>"), "token-streams")
    return (rows.where("data is not null").select("stream", "place", "data"),
            rows.where("ids is not null").select("stream", "place", "ids"), end_id)


def read_streams(spark: SparkSession, path: str, end_id: int,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files (of up to 2 GB); a stream is a file's path."""
    width = block_tokens * token_type(end_id).itemsize
    files = spark.read.format("binaryFile").load(path)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / width) - 1, F.lit(0)).cast("int"))
    return (files.where("length > 0").select(
        F.col("path").alias("stream"), F.posexplode(F.transform(starts, lambda i: F.substring(
            F.col("content"), i * width + 1, F.lit(width)))).alias("place", "data"))
        .withColumn("place", F.col("place").cast("long")))


def _searched(end_id: int):
    """``stream, place, n, tail, counts`` of every block: ends, tokens after the last end (all
    without one), and the tokens before each end since the one before or the block's start."""
    def run(tables):
        kind = token_type(end_id)
        for rows in tables:
            n, tail, counts = [], [], []
            for data in rows.column("data"):
                tokens = np.frombuffer(data.as_buffer(), kind)
                ends = np.flatnonzero(tokens == end_id)
                n.append(len(ends))
                tail.append(len(tokens) - (int(ends[-1]) + 1 if len(ends) else 0))
                counts.append(np.diff(ends, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("stream"), rows.column("place"), pa.array(n, pa.int64()),
                 pa.array(tail, pa.int64()), pa.array(counts, pa.list_(pa.int64()))],
                ["stream", "place", "n", "tail", "counts"])
    return run


def _scan(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Add what lies before each part of ``(n, tail)``: ``ends`` (documents ended) and
    ``carried`` (tokens since the last end)."""
    before = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    tails = F.coalesce(F.sum("tail").over(before), F.lit(0))
    # the tail of the last part with an end counts, the tails before it don't
    last = F.last(F.when(F.col("n") > 0, F.col("_tails")), ignorenulls=True).over(before)
    return (parts.withColumn("_tails", tails)
            .withColumn("carried", F.col("_tails") - F.coalesce(last, F.lit(0)))
            .withColumn("ends", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("_tails"))


def count_tokens(blocks: DataFrame, end_id: int,
                 together: int = BLOCKS_TOGETHER) -> DataFrame:
    """``stream, number, n_tokens, ended`` of every document of the streams."""
    kind = blocks.schema["stream"].dataType.simpleString()
    parts = blocks.select("stream", "place", "data").mapInArrow(
        _searched(end_id), f"stream {kind}, place long, n long, tail long, counts array<long>")
    parts = materialize(parts.withColumn("run", F.floor(F.col("place") / together)), "searched")
    local = _scan(parts, ["stream", "run"], "place")
    final = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    runs = (local.groupBy("stream", "run")
            .agg(F.sum("n").alias("n"), F.max_by(final, "place").alias("tail")))
    runs = materialize(_scan(runs, ["stream"], "run"), "runs").select(
        "stream", "run", F.col("ends").alias("run_ends"), F.col("carried").alias("run_carried"),
        F.col("n").alias("run_n"), F.col("tail").alias("run_tail"))
    stitched = local.join(runs, ["stream", "run"]).withColumn(
        "carried", F.col("carried") + F.when(F.col("ends") == 0, F.col("run_carried")).otherwise(0)
    ).withColumn("ends", F.col("ends") + F.col("run_ends"))
    ended = stitched.select("stream", "ends", "carried", F.posexplode("counts").alias("i", "n")).select(
        "stream", (F.col("ends") + F.col("i")).alias("number"),
        (F.col("n") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("ended"))
    rest = runs.groupBy("stream").agg(F.max_by(F.struct(
        (F.col("run_ends") + F.col("run_n")).alias("number"),
        (F.col("run_tail") + F.when(F.col("run_n") == 0, F.col("run_carried")).otherwise(0))
        .alias("n_tokens")), "run").alias("r")).where("r.n_tokens > 0")
    return ended.union(rest.select("stream", "r.number", "r.n_tokens", F.lit(False)))


def document_counts(docs: DataFrame, path: str = VOCABULARY,
                    ids_together: int = IDS_TOGETHER) -> DataFrame:
    """``doc_id, n_tokens, stream, number`` of every document."""
    blocks, listed, end_id = write_streams(docs, path, ids_together=ids_together)
    counts = count_tokens(blocks, end_id).select("stream", "number", "n_tokens")
    ids = listed.select("stream", "place", F.posexplode("ids").alias("i", "doc_id")).select(
        "doc_id", "stream", (F.col("place") + F.col("i")).alias("number"))
    return ids.join(counts, ["stream", "number"], "left").select(
        "doc_id", "n_tokens", "stream", "number")
