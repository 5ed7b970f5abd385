"""Mixing sources to target weights: capped water-filling and seeded repetition.

Every source has a size (its words) and a weight. The sources share a number of words
in proportion to their weights, but none may be repeated more than a maximum number
of epochs: a source that would be is clamped there, and its excess goes to the others
by weight, until none is above. A document is then taken a whole number of times, the
same for its whole source, and the remaining fraction of an epoch is filled with the
source's documents in a seeded order.

Defined cases: a null text has size 0; null is a source of its own, ordered last; rows
equal in id and text stand at one place of the seeded order and are taken together;
sources without words are taken not at all; an empty table gives an empty mix. Columns
of the input with the names of the operator's own results are not read or changed by
``mix``; only ``doc_id``, ``text`` and ``source`` are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parzelle.llm.common import BROADCAST_ROWS, free_name, order_key, word_count
from parzelle.session import materialize

SEED = 17
MAX_EPOCHS = 3
CYCLE = (5, 2, 1)
#: Hex digits of the order key that make a bucket: 4,096 buckets a source.
DIGITS = 3


def cyclic_weights(sources: DataFrame, cycle: Sequence[int] = CYCLE) -> DataFrame:
    """Add ``weight``: the values of ``cycle`` in turn, by code point, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    choices = F.array(*(F.lit(float(c)) for c in cycle))
    return sources.withColumn("weight", F.get(choices, place % len(cycle)))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS,
               total: Column | None = None) -> DataFrame:
    """Add ``target`` to rows ``(source, source_size, weight)``.

    In order of the level at which a source reaches its cap, a source is clamped if
    the level that the rest would share is not below its own; the clamped ones are
    therefore the first of this order, and one pass replaces the repeated clamping.
    The table has a row for each source of the mixture, which is its configuration.
    """
    total = F.sum("source_size").over(W.partitionBy()) if total is None else total
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_level = W.orderBy("_level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    onward = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = (sources.withColumn("_cap", cap)
              .withColumn("_level", F.col("_cap") / F.col("weight"))
              .withColumn("_total", total.cast("double"))
              .withColumn("_spent", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
              .withColumn("_open", F.sum("weight").over(onward)))
    clamped = F.col("_cap") * F.col("_open") <= F.col("weight") * (F.col("_total") - F.col("_spent"))
    whole = W.partitionBy()
    return (ranked.withColumn("_clamped", clamped)
            .withColumn("_rest", F.col("_total") - F.coalesce(
                F.sum(F.when(F.col("_clamped"), F.col("_cap"))).over(whole), F.lit(0.0)))
            .withColumn("_share", F.sum(F.when(~F.col("_clamped"), F.col("weight"))).over(whole))
            .withColumn("target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(
                F.col("weight") * F.col("_rest") / F.col("_share")))
            .select(*sources.columns, "target"))


def mixing_plan(sizes: DataFrame, weigh=cyclic_weights, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: ``source, source_size, target, epochs, cut``.

    ``sizes`` has ``(source, size, key)``. A document is taken ``epochs`` times, and
    once more if its key is not above ``cut``. Sizes are added up per bucket of the
    key first, so that only the documents of the one bucket in which the fraction ends
    are put in order; the document across the mark is taken if that is nearer.
    """
    bucket = F.substring("key", 1, DIGITS)
    sums = materialize(sizes.groupBy("source", bucket.alias("bucket"))
                       .agg(F.sum("size").alias("size")), "mix-buckets")
    sources = weigh(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0,
                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = materialize(
        water_fill(sources, max_epochs).withColumn("epochs", epochs)
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "mix-sources")
    cumulative = (W.partitionBy("source").orderBy("bucket")
                  .rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = (sums.withColumn("until", F.sum("size").over(cumulative))
            .join(_small(sources), sums["source"].eqNullSafe(sources["source"]))
            .where((F.col("rest") > 0) & (F.col("until") - F.col("size") <= F.col("rest"))
                   & (F.col("until") > F.col("rest")))
            .select(sums["source"], "bucket", (F.col("until") - F.col("size")).alias("before"),
                    "rest"))
    ends = materialize(ends, "mix-ends")
    inside = (sizes.withColumn("bucket", bucket).groupBy("source", "bucket", "key")
              .agg(F.sum("size").alias("size")))
    e = _small(ends.withColumnsRenamed({"source": "_s", "bucket": "_b"}))
    inside = inside.join(e, F.col("source").eqNullSafe(F.col("_s"))
                         & (F.col("bucket") == F.col("_b")))
    in_bucket = (W.partitionBy("source", "bucket").orderBy("key")
                 .rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = (inside.withColumn("_until", F.sum("size").over(in_bucket))
             .where(2 * (F.col("before") + F.col("_until")) - F.col("size") <= 2 * F.col("rest"))
             .groupBy("source").agg(F.max("key").alias("last")))
    cut = F.when(F.col("rest") > 0, F.coalesce("last", "bucket", F.lit(""))).otherwise("")
    s, t, b = sources.alias("s"), taken.alias("t"), ends.drop("rest").alias("b")
    return materialize(
        s.join(t, F.col("s.source").eqNullSafe(F.col("t.source")), "left")
        .join(b, F.col("s.source").eqNullSafe(F.col("b.source")), "left")
        .select("s.source", "source_size", "target", "epochs", cut.alias("cut")), "mix-plan")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table after a look at its size."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, key)`` of every document, written once."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                   order_key(seed).alias("key")), "mix-sizes")


def repetitions(key: Column) -> Column:
    return (F.col("epochs") + F.when(key <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix_words(docs: DataFrame, seed: int = SEED, weigh=cyclic_weights,
              max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What the mix takes of each document: ``doc_id, size, source, source_size, target,
    repetitions, taken``."""
    sizes = sized(docs, seed)
    plan = mixing_plan(sizes, weigh, max_epochs).withColumnRenamed("source", "_source")
    times = repetitions(F.col("key"))
    return (sizes.join(_small(plan), F.col("source").eqNullSafe(F.col("_source")))
            .select("doc_id", "size", "source", "source_size", "target",
                    times.alias("repetitions"), (times * F.col("size")).alias("taken")))


def mix(docs: DataFrame, seed: int = SEED, weigh=cyclic_weights,
        max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it.

    The texts are not shuffled: the plan is a row for each source, and each document's
    key tells whether it belongs to the fraction.
    """
    plan = mixing_plan(sized(docs, seed), weigh, max_epochs)
    names = {c: free_name(docs, c) for c in plan.columns}
    plan = _small(plan.withColumnsRenamed(names))
    times = (F.col(names["epochs"])
             + F.when(order_key(seed) <= F.col(names["cut"]), 1).otherwise(0)).cast("int")
    copy = free_name(docs, "copy")
    return (docs.join(plan, docs["source"].eqNullSafe(F.col(names["source"])))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), times)))
            .select(*docs.columns))
