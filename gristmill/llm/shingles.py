"""Hashes of words and word shingles for a batch of texts at once, on the bytes of Arrow strings."""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


#: A-Z as a-z, and every byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
PLACES = seeds(5, 23) | U(1)


def let_go() -> None:
    """Give back what a worker process keeps of earlier tasks: a tokenizer, functions pickled by value, and memory that its allocators hold free."""
    if sys.__dict__.pop("_gristmill_tokenizers", None) is not None:
        gc.unfreeze()
    gc.collect()
    gc.freeze()  # what is left is not searched again by each task
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string array; a null has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(batch: pa.RecordBatch, column: int, most: int = 2 << 20):
    """Slices of a batch with about ``most`` bytes of text."""
    import pyarrow.compute  # noqa: F401

    start, size = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist() if batch.num_rows else []
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def lists(table: np.ndarray) -> pa.ListArray:
    """A list a row."""
    rows, width = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(table.ravel()))


def _hash_words(data: np.ndarray, starts: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and their first bytes, of ``data``; a word also begins at each of ``starts``.

    A word is read in blocks of eight bytes, each scrambled with its place; so words of up to
    eight bytes have different hashes if they differ, and no sum over single bytes can cancel.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    word = ~BLANK[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.logical_not(word[:-1], out=edge[1:])
    edge[starts[starts < len(data)]] = True
    first = np.flatnonzero(word & edge)
    if not len(first):
        return np.zeros(0, U), first
    stop = np.empty(len(data), bool)
    stop[-1] = True
    stop[:-1] = edge[1:] | ~word[1:]
    size = np.flatnonzero(word & stop) + 1 - first
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = fold[data]
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))  # the eight bytes from each place
    blocks = (size + 7) >> 3
    begin = np.cumsum(blocks) - blocks
    j = np.arange(int(blocks.sum())) - np.repeat(begin, blocks)
    held = np.minimum(np.repeat(size, blocks) - 8 * j, 8)
    value = eight[np.repeat(first, blocks) + 8 * j] & (U(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * held).astype(U))
    sums = np.add.reduceat(mix(mix(value) + (j + 1).astype(U) * STEP), begin)
    return mix(sums + size.astype(U)), first


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)``: a 64-bit hash of each word in order, and the words of each text.

    Texts are hashed in runs of about ``CHUNK`` bytes, a longer text in pieces that end at
    blanks, so memory follows the longest word, not the longest text.
    """
    hashes, counts, n = [], [], len(offsets) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= CHUNK:
            h, first = _hash_words(data[lo:hi], offsets[i:j] - lo, fold)
            hashes.append(h)
            counts.append(np.diff(np.searchsorted(first, offsets[i : j + 1] - lo)))
        else:
            total = 0
            while lo < hi:
                stop = min(hi, lo + CHUNK)
                while stop < hi and not BLANK[data[stop]]:
                    gap = np.flatnonzero(BLANK[data[stop : min(hi, stop + CHUNK)]])
                    stop = stop + int(gap[0]) if len(gap) else min(hi, stop + CHUNK)
                h, _ = _hash_words(data[lo:stop], np.zeros(1, np.int64), fold)
                hashes.append(h)
                total += len(h)
                lo = stop
            counts.append(np.array([total]))
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, counts)`` of the runs of ``size`` words of each text; a shorter text is one run, an empty one none."""
    ends = np.cumsum(counts)
    n = np.where(counts >= size, counts - size + 1, counts > 0).astype(np.int64)
    out = np.zeros(int(n.sum()), U)
    begin = np.cumsum(n) - n
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, U)
        for k in range(size):
            runs += words[k : len(words) - size + 1 + k] * PLACES[k]
        long = np.flatnonzero(counts >= size)
        m = n[long]
        within = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        out[np.repeat(begin[long], m) + within] = runs[np.repeat((ends - counts)[long], m) + within]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[ends[i] - counts[i] : ends[i]]
        out[begin[i]] = (w * PLACES[: len(w)]).sum(dtype=U) + U(len(w))
    return mix(out), n


def distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and how many."""
    sets, start = [], 0
    for n in counts.tolist():
        x = np.sort(hashes[start : start + n])
        sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if n else x)
        start += n
    return (np.concatenate(sets) if sets else hashes), np.array([len(s) for s in sets], np.int64)


def text_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw_bytes(texts)
    return distinct(*shingle_hashes(*word_hashes(data, offsets), size))
