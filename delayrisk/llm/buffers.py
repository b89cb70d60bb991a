"""Work on the Arrow buffers of whole batches of texts: runs of bytes, and hashes of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 22  # bytes of text worked on at once, if no document is longer
PIECE = 1 << 20  # bytes whose words are hashed at once
LONG = 4096  # words from here on are hashed one by one

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space.
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False

_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(LONG, _STEP, np.uint64))), dtype=np.uint64)


def slices(b: pa.RecordBatch, text: str, size: int = SLICE):
    """Runs of rows that hold about ``size`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, end - at)
        at = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each text and, last, the end); nulls must be filled."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every maximal run, inside a text, of bytes that ``table`` marks."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    goes_on = inside & ~edge
    goes_on[1:] &= inside[:-1]
    goes_on[0] = False
    starts = np.flatnonzero(inside & ~goes_on)
    ends = np.flatnonzero(inside[:-1] & ~goes_on[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased: a sum of random numbers of bytes times powers, mixed."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        n = np.minimum(lengths[at:end], LONG)
        first = np.cumsum(n) - n
        place = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
        terms = _BYTE[buf[place + np.repeat(starts[at:end], n)]] * _POWERS[place]
        out[at:end] = np.add.reduceat(terms, first)
        at = end
    for k in np.flatnonzero(lengths > LONG):
        out[k] = xxhash.xxh3_64_intdigest(LOWER[buf[starts[k]:ends[k]]].tobytes())
    return mixed(out + lengths.astype(np.uint64) * _STEP)


def shingle_hashes(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the hashes of its word shingles, in its order; fewer words than ``size`` make one; nulls must be filled."""
    buf, offsets = text_buffer(texts)
    starts, ends, doc = runs(buf, offsets, IN_WORD)
    w = word_hashes(buf, starts, ends)
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words

    def joined(at: np.ndarray, length: int) -> np.ndarray:
        h = np.full(len(at), length, np.uint64)
        for k in range(length):
            h = h * _STEP + w[at + k]
        return mixed(h)
    full = joined(np.flatnonzero(doc[size - 1:] == doc[:len(doc) - size + 1]) if len(doc) >= size else np.zeros(0, np.int64), size)
    made = np.maximum(words - size + 1, 0)
    out = np.split(full, np.cumsum(made)[:-1]) if len(texts) else []
    for length in range(1, size):
        short = np.flatnonzero(words == length)
        for k, h in zip(short.tolist(), joined(first[short], length)):
            out[k] = np.array([h], np.uint64)
    return out
