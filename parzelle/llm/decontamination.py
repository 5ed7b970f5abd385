"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens: the tokens at its positions are hashed,
those between are ignored, so a hit survives substitutions there. The seeds of the
benchmark items are joined with the seeds of all documents; every hit fixes a diagonal
(document position minus item position), along which the two texts are then compared
word by word. An item leaks into a document if along a diagonal with a hit

* some ``window`` consecutive words of the item (all, if it has fewer) have at least
  ``window_share`` equal words, or
* the whole overlap of the two is at least ``window`` words long and ``overlap_share``
  of them are equal.

With the two masks below every run of 12 words with 2 substitutions, and of 15 words
with 3, holds a hit, whatever words are replaced. An item of fewer than 12 words is one
window, of which a fifth may differ: one word of 5 to 9, two of 10 and 11. It has masks of
its own besides, which leave out every choice of one of three, or two of four, parts of it
(all words, for fewer than 5), so again some mask misses all replaced words.

Tokens are runs of letters and digits in lower case, so marks glued to a word don't
hide it. Defined cases: null and texts without tokens leak nothing and receive
nothing; texts of any length are read whole; equal diagonals are told apart by their
earlier start; rows equal in id and text are one document (and are kept or dropped
together); an empty table on either side gives no rows; other columns are kept by
``decontaminate``, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parzelle.llm.common import BROADCAST_ROWS, free_name, let
from parzelle.session import materialize

#: Positions of the masks within eight and six tokens (five positions each).
MASKS = ((0, 3, 4, 5, 7), (0, 1, 2, 3, 5))
WINDOW = 12
WINDOW_SHARE = 0.8
OVERLAP_SHARE = 0.8
#: Fixed value: a token is a run of letters, marks and digits.
TOKEN_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def tokens(text: Column) -> Column:
    # a break at the start leaves one empty token, none at the end is kept
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + TOKEN_BREAK, ""))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(plain, TOKEN_BREAK + "$", ""), TOKEN_BREAK))


def short_masks(n: int, window_share: float = WINDOW_SHARE) -> list[tuple[int, ...]]:
    """Masks for items of ``n`` words, fewer than the window: one misses all replaced words
    wherever as many are replaced as the share allows."""
    replaced = n - math.ceil(window_share * n - 1e-9)
    parts = 1 if not replaced else replaced + 2
    if parts > n:  # nearly every word may be replaced: each place alone
        return [(i,) for i in range(n)]
    part_of = [i * parts // n for i in range(n)]
    return [tuple(i for i in range(n) if part_of[i] not in left_out)
            for left_out in itertools.combinations(range(parts), replaced)]


def _seeds_of(hashes: Column, mask: int, positions: tuple[int, ...], n: int | None,
              is_item: bool) -> Column:
    """The seeds of a mask at every place; ``n`` is the length of the items it is for."""
    span = n or positions[-1] + 1
    fits = F.size(hashes) == span if n and is_item else F.size(hashes) >= span
    return F.when(fits, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - span),
        lambda i: F.xxhash64(F.lit(mask), *(F.get(hashes, i + p) for p in positions)))).otherwise(
        F.array().cast("array<bigint>"))


def _seed_rows(texts: DataFrame, keys: list[str], masks: list[tuple[tuple[int, ...], int | None]],
               is_item: bool) -> DataFrame:
    """``keys, seed, at`` for every place of every mask."""
    hashes = F.transform("_tokens", lambda w: F.xxhash64(w))
    lists = texts.select(*keys, let(hashes, lambda h: F.array(
        *(_seeds_of(h, m, p, n, is_item) for m, (p, n) in enumerate(masks)))).alias("_seeds"))
    return (lists.select(*keys, F.explode("_seeds").alias("_list"))
            .select(*keys, F.posexplode("_list").alias("at", "seed")))


def _if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table only after counting it; else the planner decides."""
    return F.broadcast(df) if df.count() <= most else df


def _total(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0), lambda n, x: n + x)


def _compared(doc: Column, item: Column, diagonal: Column, window: Column) -> Column:
    """How two token lists agree along a diagonal: a struct of ``n_overlap, n_equal,
    best_window, doc_start``.

    The lists and the list of flags are bound, so that each is worked out once.
    """
    begin = F.greatest(F.lit(0), -diagonal)

    def flags(d: Column) -> Column:
        stop = F.least(F.size(item), F.size(d) - diagonal)
        return F.transform(F.sequence(begin, stop - 1), lambda j: F.when(
            F.get(d, j + diagonal) == F.get(item, j), 1).otherwise(0))

    def best(f: Column) -> Column:
        return F.when(F.size(f) >= window, F.array_max(F.transform(
            F.sequence(F.lit(0), F.size(f) - window),
            lambda j: _total(F.slice(f, j + 1, window))))).otherwise(0)

    return let(let(doc, flags), lambda f: F.struct(
        F.size(f).alias("n_overlap"), _total(f).alias("n_equal"), best(f).alias("best_window"),
        (begin + diagonal).alias("doc_start")))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
          window_share: float = WINDOW_SHARE, overlap_share: float = OVERLAP_SHARE) -> DataFrame:
    """``doc_id, digest, item_id, n_item, n_overlap, n_equal, best_window, doc_start``: a
    row for each document and item that leaks into it, for its best diagonal.

    ``digest`` is the hash of the text that tells documents of one id apart.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("_tokens"))
    items = materialize(items.where(F.size("_tokens") > 0).distinct()
                        .withColumn("item_digest", F.xxhash64("_tokens")), "items")
    short = items.select(F.size("_tokens").alias("n")).where(F.col("n") < window).distinct()
    masks = [*((m, None) for m in MASKS),
             *((m, r["n"]) for r in short.orderBy("n").collect() for m in short_masks(r["n"], window_share))]
    seeds = materialize(
        _seed_rows(items, ["item_id", "item_digest"], masks, True)
        .withColumnRenamed("at", "item_at").distinct(), "seeds")
    digest = F.xxhash64("text")
    texts = docs.select("doc_id", digest.alias("digest"), tokens(F.col("text")).alias("_tokens"))
    # the planner takes the exploded side to be far shorter than it is: that side is never broadcast
    hits = materialize(
        _seed_rows(texts, ["doc_id", "digest"], masks, False).hint("merge").join(_if_small(seeds), "seed")
        .select("doc_id", "digest", "item_id", "item_digest",
                (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "hits")
    d = docs.select("doc_id", digest.alias("digest"), "text").alias("d")
    h, i = _if_small(hits).alias("h"), _if_small(items).alias("i")
    pairs = (d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
                    & (F.col("d.digest") == F.col("h.digest")))
             .join(i, F.col("h.item_id").eqNullSafe(F.col("i.item_id"))
                   & (F.col("h.item_digest") == F.col("i.item_digest")))
             .select("h.doc_id", "h.digest", "h.item_id", F.size("i._tokens").alias("n_item"),
                     F.least(F.lit(window), F.size("i._tokens")).alias("w"),
                     _compared(tokens(F.col("d.text")), F.col("i._tokens"), F.col("diagonal"),
                               F.least(F.lit(window), F.size("i._tokens"))).alias("v")))
    # written, or the filter below would work the comparison out again and again
    compared = materialize(pairs.select("doc_id", "digest", "item_id", "n_item", "w", "v.*"),
                           "compared")
    near = ((F.col("best_window") >= window_share * F.col("w"))
            | ((F.col("n_overlap") >= window)
               & (F.col("n_equal") >= overlap_share * F.col("n_overlap"))))
    value = F.struct("best_window", "n_equal", (-F.col("doc_start")).alias("before"),
                     "n_overlap", "n_item")
    return (compared.where(near).groupBy("doc_id", "digest", "item_id")
            .agg(F.max(value).alias("v"))
            .select("doc_id", "digest", "item_id", "v.n_item", "v.n_overlap", "v.n_equal",
                    "v.best_window", (-F.col("v.before")).alias("doc_start")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaks."""
    doc, digest = free_name(docs, "doc"), free_name(docs, "digest")
    bad = materialize(leaks(docs, benchmark).select(
        F.col("doc_id").alias(doc), F.col("digest").alias(digest)).distinct(), "leaks")
    return docs.join(_if_small(bad), docs["doc_id"].eqNullSafe(F.col(doc))
                     & (F.xxhash64(docs["text"]) == F.col(digest)), "left_anti")
