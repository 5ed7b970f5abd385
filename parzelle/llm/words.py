"""Words of whole batches of texts as numpy arrays.

A batch of texts becomes one byte buffer in which every word is followed by exactly
one space, so a run of words is a slice of the buffer. Hashes are taken of all words
or shingles of the batch at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once by a task; longer texts are cut between words.
BATCH_BYTES = 2_000_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Batch:
    """Words of several text pieces; ``offsets[i]:offsets[i + 1]`` are those of piece i.

    ``rows`` are the pieces' rows in the input, ``first`` the number of words of the
    same row before the piece, ``last`` whether the row ends with it.
    """

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray


def texts_of(rows: pa.RecordBatch) -> Iterator[bytes | None]:
    return (t.as_py() for t in rows.column("text").cast(pa.binary()))


def flatten(pieces: list[tuple[int, int, bool, bytes]]) -> Batch:
    rows, first, last, texts = zip(*pieces, strict=True)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = SPACES[raw]
    after = np.empty_like(space)
    after[0] = True
    after[1:] = space[:-1]
    word_starts = np.flatnonzero(~space & after)
    cuts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    offsets = np.concatenate([[0], np.searchsorted(word_starts, cuts)])
    kept = raw[~(space & after)]
    kept = np.where(SPACES[kept], np.uint8(32), kept)
    ends = np.flatnonzero(kept == 32)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    # room to read eight bytes at any place
    return Batch(np.concatenate([kept, np.zeros(8, np.uint8)]), starts, ends, offsets,
                 np.array(rows), np.array(first), np.array(last))


def _cut(text: bytes, limit: int, lap: int) -> Iterator[tuple[int, bool, bytes]]:
    """Pieces of a long text; each but the first repeats the ``lap`` words before it."""
    space = SPACES[np.frombuffer(text, np.uint8)]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    at = 0
    while True:
        end = int(np.searchsorted(starts, starts[at] + limit)) if len(starts) else 0
        end = max(end, at + lap + 1)
        if end >= len(starts):
            yield at, True, text[int(starts[at]) if len(starts) else 0:]
            return
        yield at, False, text[int(starts[at]):int(starts[end])]
        at = end - lap


def batches(texts: Iterable[bytes | None], lap: int, limit: int = BATCH_BYTES) -> Iterator[Batch]:
    """The words of the texts, a bounded number of bytes at a time.

    Null is a text without words. A text that is cut gives pieces that overlap by
    ``lap`` words, so that each run of ``lap + 1`` words lies whole in exactly one.
    """
    pieces: list[tuple[int, int, bool, bytes]] = []
    held = 0
    for row, text in enumerate(texts):
        text = text or b""
        parts = [(0, True, text)] if len(text) <= limit else _cut(text, limit, lap)
        for first, last, part in parts:
            if pieces and held + len(part) > limit:
                yield flatten(pieces)
                pieces, held = [], 0
            pieces.append((row, first, last, part))
            held += len(part)
    if pieces:
        yield flatten(pieces)


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161,
    9650029242287828579, 2870177450012600261))  # fixed values: the primes of XXH64


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of a buffer that ends with eight spare bytes."""
    size = (ends - starts).astype(np.int64)
    out = np.empty(len(size), np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        view, one = memoryview(buffer), xxhash.xxh64_intdigest
        out[long] = np.fromiter((one(view[a:b], seed) for a, b in zip(
            starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    short = np.flatnonzero(size < 32)
    if not len(short):
        return out
    eights = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    fours = np.ndarray((len(buffer) - 3,), "<u4", buffer, strides=(1,))
    size, at = size[short], starts[short].astype(np.int64)
    h = np.uint64(seed) + P5 + size.astype(np.uint64)
    for lane in range(3):
        on = np.flatnonzero(size >= 8 * (lane + 1))
        if not len(on):
            break
        k = _turn(eights[at[on] + 8 * lane] * P2, 31) * P1
        h[on] = _turn(h[on] ^ k, 27) * P1 + P4
    at += size & ~7
    on = np.flatnonzero(size & 4)
    h[on] = _turn(h[on] ^ (fours[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at += size & 4
    for byte in range(3):
        on = np.flatnonzero((size & 3) > byte)
        h[on] = _turn(h[on] ^ (buffer[at[on] + byte].astype(np.uint64) * P5), 11) * P1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    out[short] = h
    return out


def word_hashes(batch: Batch, seed: int = 42) -> np.ndarray:
    return xxh64(batch.buffer, batch.starts, batch.ends, seed)
