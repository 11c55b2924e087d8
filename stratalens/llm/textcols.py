"""Words and n-grams of Arrow text columns in numpy, over bytes: no Python object for any word.

Texts are taken whole, in chunks of about CHUNK bytes of whole documents; a longer document is a chunk of its own. Hashes are of 64 bits and don't depend on where chunks are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
U = np.uint64
_BASE, _NGRAM = U(0x9E3779B97F4A7C55), U(0xD6E8FEB86659FD93)
SPACED = np.arange(256) > 32
#: Letters and digits of ASCII, and all bytes of other characters.
WORDLIKE = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U))[0])


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i up to n."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            a = np.cumprod(np.concatenate([[U(1)], np.full(size, base, U)]))
            b = np.cumprod(np.concatenate([[U(1)], np.full(size, U(pow(int(base), -1, 2**64)), U)]))
        got = (a, b)
        if size <= 1 << 20:
            _powers[int(base)] = got
    return got


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, len + 1 bounds in the bytes); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, bounds: np.ndarray, inside: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that `inside` has, and for each document the index of its first word (one more at the end)."""
    solid = inside[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[bounds[:-1][bounds[:-1] < len(buf)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK) -> np.ndarray:
    """64-bit hashes of buf[start:end] for spans in order; memory stays near that of limit bytes however long buf is, unless one span is longer."""
    out = np.empty(len(starts), U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
            lo = starts[i]
            seg = buf[lo : ends[j - 1]]
            p, q = powers(_BASE, len(seg) + 1)
            h = np.zeros(len(seg) + 1, U)
            np.cumsum((seg.astype(U) + U(1)) * p[: len(seg)], out=h[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((h[e] - h[s]) * q[s] + (e - s).astype(U) * U(0xA24BAED4963EE407))
            i = j
    return out


def ngrams(wh: np.ndarray, n: int) -> np.ndarray:
    """Hash of wh[i:i + n] for each i at which n words are left in the array."""
    m = len(wh) - n + 1
    if m <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        if n <= 4:
            acc = wh[:m].copy()
            for t in range(1, n):
                acc = acc * _NGRAM + wh[t : t + m]
            return mix(acc + U(n))
        p, q = powers(_NGRAM, len(wh) + 1)
        h = np.zeros(len(wh) + 1, U)
        np.cumsum(wh * p[: len(wh)], out=h[1:])
        return mix((h[n:] - h[:m]) * q[:m] + U(n))


def room(first: np.ndarray) -> np.ndarray:
    """For each word, the words of its document from it on."""
    return np.repeat(first[1:], np.diff(first)) - np.arange(first[0], first[-1])


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the documents' words."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[first[1:]] - c[first[:-1]]
