"""What several operators share: words, table access, sums over ordered buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the five control characters
#: tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: A table of at most this many rows may be broadcast by hint (a few dozen bytes a
#: row); larger ones are joined as the planner decides.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """A seeded place for a document, the same in every run: 32 hex digits."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), doc, text).cast("binary"))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document belongs to the fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, text``: the id and a hash of the text tell documents apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")


def same_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on ``doc_id`` (null-safe) and ``digest``."""
    r = right.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    return left.join(r, left["doc_id"].eqNullSafe(F.col("_id"))
                     & (left["digest"] == F.col("_digest")), how).drop("_id", "_digest")
