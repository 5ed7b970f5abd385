"""Sharding by proportional stratified interleaving.

Within each source the rows are put in a seeded order; the row of rank r of n has the
fractional rank (2r - 1) / 2n. In the order of the fractional ranks the sources
alternate in proportion to their sizes, so a cut into runs of equal length gives
shards that each match the mixture (every source to within one row or so), and whose
row counts differ by one at most.

No source is ordered by one task: rows are filed in buckets of the seeded order, the
number of buckets of a source follows its row count, and a rank is the rows of the
buckets before plus the place in the bucket. The place in the merged order comes from ranges
of it dealt over all tasks: the rows of the ranges before plus the place in the own one. There
is no list of the sources on the driver and no bound on their number.

Defined cases: null is a source of its own, after all others; rows are ordered by a hash of id
and text, and rows equal in both are interchangeable (a null text counts as empty); equal
fractional ranks follow the order of the sources; an empty table gives no rows; fewer rows
than shards leave the last shards empty. Columns of the input that have the name of a result
are replaced by it, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parzelle.llm.common import BROADCAST_ROWS, order_key
from parzelle.operators.grouping import with_position
from parzelle.session import materialize

SEED = 29
SHARDS = 16
#: Rows that a bucket holds on average at most.
BUCKET_ROWS = 4_000
MAX_BUCKET_BITS = 24


def _sources(docs: DataFrame) -> DataFrame:
    """``_name, _n, _s``: the sources' row counts and numbers, by code point and null last."""
    counts = (docs.groupBy(F.col("source").alias("_name")).agg(F.count("*").alias("_n"))
              .withColumn("_null", F.col("_name").isNull()))
    return materialize(with_position(counts, [], ["_null", "_name"], "_s").drop("_null"), "shard-sources")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED,
               bucket_rows: int = BUCKET_ROWS, key: str | None = None) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (from 0) and ``slot`` (from 0 in the shard).

    ``key`` names a column with the seeded order (``order_key``) where it is known
    already, so that the texts need not come along.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")))
    base = docs.select(row.alias("row"), "source", (F.col(key) if key else order_key(seed)).alias("key"))
    sources = _sources(base)
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    bits = F.greatest(F.lit(0), F.least(F.lit(MAX_BUCKET_BITS), F.ceil(
        F.log2(F.col("_n") / F.lit(float(bucket_rows)))))).cast("int")
    # the leading bits of the key: as many as the source has buckets for
    bucket = F.expr(f"cast(conv(substring(key, 1, {MAX_BUCKET_BITS // 4}), 16, 10) as long)"
                    f" div shiftleft(1L, {MAX_BUCKET_BITS} - _bits)")
    numbered = F.broadcast(sources) if n_sources <= BROADCAST_ROWS else sources
    filed = (base.join(numbered, base["source"].eqNullSafe(F.col("_name")))
             .withColumn("_bits", bits).withColumn("_bucket", bucket)
             .select("row", "key", "_s", "_n", "_bucket"))
    rows = materialize(filed.groupBy("_s", "_bucket").agg(F.count("*").alias("rows")), "shard-buckets")
    before = F.sum("rows").over(W.partitionBy("_s").orderBy("_bucket").rowsBetween(
        W.unboundedPreceding, W.currentRow)) - F.col("rows")
    offsets = rows.select("_s", "_bucket", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_s", "_bucket").orderBy("key"))
    ranked = filed.withColumn("_place", place).join(offsets, ["_s", "_bucket"]).select(
        "row", "_s", ((2 * (F.col("_before") + F.col("_place")) - 1) / (2.0 * F.col("_n"))).alias("_share"))
    at = F.col("at")
    each, larger = divmod(total, shards)
    edge = larger * (each + 1)  # the first shards have a row more
    shard = F.when(at < edge, F.floor(at / (each + 1))).otherwise(
        larger + F.floor((at - edge) / max(each, 1)))
    return (with_position(ranked, [], ["_share", "_s"], "at").withColumn("_shard", shard.cast("int"))
            .select("row.*", F.col("_shard").alias("shard"), (
                at - F.col("_shard").cast("long") * each - F.least(F.col("_shard"), F.lit(larger))).alias("slot")))
