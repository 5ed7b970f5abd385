"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is read in passages of ``PASSAGE`` words, as a few words would drown in the
average of a long document. Each passage is the bag of its character n-grams (word
boundaries count as a character), each n-gram has a vector, and the average of the
vectors goes through a linear softmax. The document's score is that of its worst passage.
Vectors and softmax are trained jointly: first on averages of whole documents, then
on each document's worst passage. Words never seen share n-grams with seen ones.

Defined cases: null is the empty text; a text without n-grams has the score of the bias
alone; documents without a label or with a null one teach nothing; without examples of
both classes the score is the share of toxic examples (0 without any). Only ``text`` is
an input of a score, and all of it; repeated rows are scored each on its own; an empty table
gives no rows. Extra columns are kept by ``score`` as they are, unless they have
the name of its result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parzelle.llm.common import free_name, held_out, word_count

#: Most documents of each class that are learned from, and most words of one: at most
#: 1,800 texts of 1,200 words come to the driver.
EXAMPLES = {0: 1_000, 1: 800}
EXAMPLE_WORDS = 1_200
PASSAGE = 48
#: Passages with fewer n-grams are averaged as if they had that many.
LEAST_GRAMS = 400
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIMENSION = 8
#: What the toxic examples weigh together; about two and a half times their share of a
#: corpus, as a passage that speaks for a toxic document may not be the toxic one.
PRIOR = 0.25
#: Characters handled at once; longer texts are cut between words.
CHUNK = 1_000_000


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def gram_logits(self) -> np.ndarray:
        """What an n-gram adds to log(p1 / p0), before the average."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def _separators() -> np.ndarray:
    out = np.ones(128, bool)
    for first, last in ("09", "az", "AZ"):
        out[ord(first):ord(last) + 1] = False
    return out


SEPARATORS = _separators()


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and passage of every n-gram of a text, once a passage."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    cut = SEPARATORS[np.minimum(codes, 127)] & (codes < 128)
    kept = ~cut
    kept[1:] |= ~cut[:-1]
    kept[0] = True
    codes, cut = codes[kept], cut[kept]
    symbols = np.where(cut, 0, codes).astype(np.uint64)
    cuts = np.cumsum(cut)
    ids, passages = [], []
    for n in SIZES:
        last = len(symbols) - n
        if last < 0:
            continue
        # no boundary inside, only at the ends
        at = np.flatnonzero(cuts[n - 2:n - 2 + last + 1] == cuts[:last + 1])
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ symbols[at + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        ids.append((h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1))
        passages.append((cuts[at] - 1) // PASSAGE)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bag = np.unique(np.concatenate(passages) * BUCKETS + np.concatenate(ids))
    return bag % BUCKETS, bag // BUCKETS


def _chunks(text: str):
    at = 0
    while len(text) - at > CHUNK:
        end = at + CHUNK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def logit(text: str, gram_logits: np.ndarray) -> float:
    """The worst passage's log(p1 / p0) without the bias; 0 for a text without n-grams."""
    worst = -np.inf
    for chunk in _chunks(text):
        ids, passage = grams(chunk)
        if len(ids):
            total = np.bincount(passage, gram_logits[ids])
            number = np.bincount(passage)
            on = number > 0
            worst = max(worst, float((total[on] / np.maximum(number[on], LEAST_GRAMS)).max()))
    return worst if np.isfinite(worst) else 0.0


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Adam:
    def __init__(self, *values: np.ndarray, rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m = [np.zeros_like(v) for v in values]
        self.v = [np.zeros_like(v) for v in values]

    def step(self, *gradients: np.ndarray) -> None:
        self.t += 1
        for x, g, m, v in zip(self.values, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-8)


def train(texts: Sequence[str], toxic: Sequence[int], rounds: int = 12, refresh: int = 8,
          rate: float = 0.15, decay: float = 1e-6, prior: float | None = PRIOR,
          seed: int = 5) -> Model:
    """Learn vectors and softmax from whole texts and their labels (0 or 1).

    After ``refresh`` steps on whole documents there are ``rounds`` of as many steps, each
    on the passages that were the worst at its start. ``prior`` is the weight of the toxic
    examples together (as many as there are if ``None``).
    """
    y = np.asarray(toxic, np.float64)
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSION))
    weights = random.normal(0, 0.1, (DIMENSION, 2))
    bias = np.zeros(2)
    if not 0 < y.sum() < len(y):
        share = y.mean() if len(y) else 0.0
        bias[1] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return Model(np.zeros_like(vectors), weights, bias)
    # the classes weigh as given, however many examples there are of each
    positive = y.mean() if prior is None else prior
    weight = np.where(y == 1, positive / y.sum(), (1 - positive) / (len(y) - y.sum()))
    bags, document = [], []
    for i, text in enumerate(texts):
        ids, passage = grams(text)
        cuts = np.flatnonzero(np.diff(passage)) + 1
        bags += np.split(ids, cuts)
        document += [i] * (len(cuts) + 1)
    document = np.array(document)
    first = np.concatenate([[True], document[1:] != document[:-1]])
    adam = _Adam(vectors, weights, bias, rate=rate)

    def step(chosen: np.ndarray, share: np.ndarray) -> None:
        """One step in which the chosen passages speak for their documents."""
        size = np.array([len(bags[c]) for c in chosen])
        ids = np.concatenate([bags[c] for c in chosen])
        of = np.repeat(np.arange(len(chosen)), size)
        length = np.maximum(size, LEAST_GRAMS)
        for _ in range(refresh):
            direction = weights[:, 1] - weights[:, 0]
            mean = np.bincount(of, (vectors @ direction)[ids], minlength=len(chosen)) / length
            z = np.bincount(document[chosen], mean * share, minlength=len(y)) + bias[1] - bias[0]
            error = (_sigmoid(z) - y) * weight
            pull = np.bincount(ids, (error[document[chosen]] * share / length)[of],
                               minlength=BUCKETS)
            slope = vectors.T @ pull
            adam.step(np.outer(pull, direction) + decay * vectors,
                      np.stack([-slope, slope], 1) + decay * weights,
                      np.array([-error.sum(), error.sum()]))

    everything = np.arange(len(bags))
    step(everything, 1 / np.bincount(document)[document])
    for _ in range(rounds):
        logits = vectors @ (weights[:, 1] - weights[:, 0])
        mean = np.array([logits[b].sum() / max(len(b), LEAST_GRAMS) for b in bags])
        order = np.lexsort((mean, document))
        worst = order[np.concatenate([np.flatnonzero(first)[1:], [len(bags)]]) - 1]
        step(worst, np.ones(len(worst)))
    return Model(vectors.astype(np.float32), weights.astype(np.float32), bias)


def examples(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None,
             words: int = EXAMPLE_WORDS) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample: of each class those with the lowest hash of
    the id, outside of the fold kept for tests, and of at most ``words`` words."""
    most = EXAMPLES if most is None else most
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = None
    for label, number in most.items():
        part = known.where(F.col("toxic") == label).orderBy(*by_hash).limit(number)
        chosen = part if chosen is None else chosen.union(part)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .where(word_count(F.col("text")) <= words)
            .orderBy(*by_hash, "text").limit(sum(most.values())).collect())
    return [r["text"] or "" for r in rows], [r["toxic"] for r in rows]


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the probability that a text is toxic. The model is of a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast((model.gram_logits(), model.offset()))
    kept = [f for f in docs.schema if f.name.lower() != name.lower()]

    def run(tables):
        gram_logits, offset = shared.value
        for rows in tables:
            scores = [_sigmoid(logit(t.as_py() or "", gram_logits) + offset)
                      for t in rows.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(scores, pa.float64())], [*rows.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, f"{schema}, `{name}` double")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold."""
    name = free_name(docs, "score")
    return score(docs, model, name).where(F.col(name) < threshold).drop(name)
